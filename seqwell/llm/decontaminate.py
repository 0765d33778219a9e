"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and bytes beyond ASCII. The automaton of all items
reads a text's words one by one and knows at each the longest match that ends there; from a match of `window` words on, the
last `window` words are a hit, and an item of fewer words is a hit as a whole. The state says which items hold the window.
Only stretches whose neighbouring words are also neighbours in some item are streamed, found with numpy: no match can
leave such a stretch.

Items are a reference set: they are sorted and cut into parts of `PART_WORDS` words at most, a longer item into pieces that
share `window` - 1 words. A part's automaton is arrays whose size is in proportion to its words (`ROOM` bytes a word at most):
an item is listed once for each of its windows, not at every state. It is broadcast, and a worker holds one part at a time;
each batch of texts is read once and goes through all parts, whose hits are merged in place.

Defined results: a null text has no words and no hit and stays null; an empty benchmark hits nothing; a null item_id marks
words but is not listed; items without words are ignored; repeated rows are judged each alone, very long texts whole; item
ids may be of any type that sorts; in the output a new column replaces one of the same name, other columns pass through.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqwell.llm.words import ALNUM, Block, blocks, mixed, tidy

PART_WORDS = 1 << 18
#: Bytes of an automaton a word of its items, at most: 2 states of 16, 3 transitions of 12, a word and a pair of 8, 20 for the items.
ROOM = 104


class Automaton:
    """Suffix automaton of several word lists, as arrays. names: what each list is called; several may share a name."""

    def __init__(self, items: list[np.ndarray], window: int, names: list | None = None) -> None:
        self.window, self.names = window, list(range(len(items))) if names is None else names
        every = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *items]))
        self.words = every
        pairs = [mixed(x[:-1] + mixed(x[1:])) for x in items if len(x) > 1]
        self.pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *pairs]))
        lists = [np.searchsorted(every, x).tolist() for x in items]
        self._build(lists)
        self.least = min([window, *(len(x) for x in lists)])

    def _build(self, lists: list[list[int]]) -> None:
        width = max(1, len(self.words))
        nxt: dict[int, int] = {}
        after: list[list[int]] = [[]]
        link, length = [-1], [0]

        def made(size: int, up: int, words: list[int]) -> int:
            after.append(words)
            length.append(size)
            link.append(up)
            return len(length) - 1

        def split(p: int, c: int, q: int) -> int:
            """A state for what p and c make, out of q, whose longest string is longer."""
            new = made(length[p] + 1, link[q], list(after[q]))
            for x in after[q]:
                nxt[new * width + x] = nxt[q * width + x]
            link[q] = new
            while p >= 0 and nxt.get(p * width + c) == q:
                nxt[p * width + c] = new
                p = link[p]
            return new

        for x in lists:
            last = 0
            for c in x:
                q = nxt.get(last * width + c)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else split(last, c, q)
                    continue
                p, new = last, made(length[last] + 1, 0, [])
                while p >= 0 and p * width + c not in nxt:
                    nxt[p * width + c] = new
                    after[p].append(c)
                    p = link[p]
                if p >= 0:
                    q = nxt[p * width + c]
                    link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
                last = new
        del after
        # of each state that can match `window` words the one that stands for its last `window` words
        top, window = [-1] * len(length), self.window
        order = sorted(range(1, len(length)), key=length.__getitem__)
        for s in order:
            if length[s] >= window:
                top[s] = s if length[link[s]] < window else top[link[s]]
        holds: set[tuple[int, int]] = set()
        short: list[tuple[int, int, int]] = []
        for i, x in enumerate(lists):
            s = 0
            for n, c in enumerate(x, 1):
                s = nxt[s * width + c]
                if n >= window:
                    holds.add((top[s], i))
            if 0 < len(x) < window:
                short.append((s, len(x), i))
        at = np.array(sorted(holds), dtype=np.int32).reshape(-1, 2)
        self.held, self.items = at[:, 0], at[:, 1]
        # items of fewer words: where each ends, and of each state the nearest one at or above it that ends some
        self.short = np.array(sorted(short), dtype=np.int32).reshape(-1, 3)
        ends, near = {s for s, _, _ in short}, [0] * len(length)
        for s in order:
            near[s] = s if s in ends else near[link[s]]
        self.link, self.length, self.top, self.near = (np.array(x, dtype=np.int32) for x in (link, length, top, near))
        self.step = np.fromiter(nxt.keys(), dtype=np.int64, count=len(nxt))
        self.to = np.fromiter(nxt.values(), dtype=np.int32, count=len(nxt))

    def size(self) -> int:
        """Bytes of the arrays."""
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def ready(self) -> Automaton:
        """With the forms that reading wants, which are not sent."""
        if not hasattr(self, "go"):
            self.go = dict(zip(self.step.tolist(), self.to.tolist(), strict=True))
            self.up, self.long, self.tops, self.nears = (array("i", x.tobytes()) for x in (self.link, self.length, self.top, self.near))
            self.first_bits = np.zeros(1 << 16, dtype=bool)
            self.first_bits[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.ending: dict[int, list[tuple[int, int]]] = {}
            for s, n, i in self.short.tolist():
                self.ending.setdefault(s, []).append((n, i))
        return self

    def stretches(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each run of words that can hold a match, and all words' numbers (-1: in no item)."""
        own = block.hashes()
        number = np.full(len(own), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.first_bits[(own & np.uint64(0xFFFF)).astype(np.int64)]) if len(self.words) else np.zeros(0, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.words, own[maybe]), max(0, len(self.words) - 1))
        same = self.words[place] == own[maybe] if len(maybe) else np.zeros(0, dtype=bool)
        number[maybe[same]] = place[same]
        known = np.concatenate([number >= 0, [False]])
        ends = np.zeros(len(own) + 1, dtype=bool)
        ends[block.at[1:] - 1] = True  # the last word of a text has no next one
        two = np.flatnonzero(known[:-1] & known[1:] & ~ends[:-1])
        pair = mixed(own[two] + mixed(own[np.minimum(two + 1, len(own) - 1)])) if len(two) else np.zeros(0, dtype=np.uint64)
        place = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        joined = np.zeros(len(own), dtype=bool)
        if len(self.pairs) and len(two):
            joined[two[self.pairs[place] == pair]] = True
        start = np.flatnonzero(known[:-1] & ~np.concatenate([[False], joined[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
        stop = np.flatnonzero(known[:-1] & ~joined) + 1
        long = stop - start >= self.least
        return start[long], stop[long], number

    def stream(self, numbers: list[int], tops: set[int], items: set[int]) -> list[tuple[int, int]]:
        """Hit spans [begin, end) of a stretch, merged; adds the windows met to `tops` and short items to `items`."""
        go, up, long, window, width = self.go, self.up, self.long, self.window, max(1, len(self.words))
        s = n = 0
        hits: list[tuple[int, int]] = []

        def hit(begin: int, end: int) -> None:
            while hits and begin <= hits[-1][1]:
                begin = min(begin, hits.pop()[0])
            hits.append((begin, end))

        for i, c in enumerate(numbers):
            while s and s * width + c not in go:
                s = up[s]
                n = long[s]
            t = go.get(s * width + c)
            if t is not None:
                s = t
                n += 1
            if n >= window:
                tops.add(self.tops[s])
                hit(i + 1 - window, i + 1)
            x = self.nears[s]
            while x:
                for size, item in self.ending[x]:
                    if n >= size:
                        items.add(item)
                        hit(i + 1 - size, i + 1)
                x = self.nears[up[x]]
        return hits

    def read(self, block: Block) -> dict[int, tuple[list[tuple[int, int]], set]]:
        """By text of the block its hit spans, in words from the text's first, and the names of the items hit."""
        self.ready()
        spans: dict[int, list[tuple[int, int]]] = {}
        tops: dict[int, set[int]] = {}
        items: dict[int, set[int]] = {}
        start, stop, number = self.stretches(block)
        text = np.searchsorted(block.at, start, side="right") - 1
        for t, a, b in zip(text.tolist(), start.tolist(), stop.tolist(), strict=True):
            hits = self.stream(number[a:b].tolist(), tops.setdefault(t, set()), items.setdefault(t, set()))
            base = a - int(block.at[t])
            spans.setdefault(t, []).extend((x + base, y + base) for x, y in hits)
        out = {}
        for t, own in spans.items():
            if own:
                found = np.array(sorted(tops[t]), dtype=np.int32)
                begin, end = np.searchsorted(self.held, found, side="left"), np.searchsorted(self.held, found, side="right")
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    items[t].update(self.items[a:b].tolist())
                out[t] = (own, {self.names[i] for i in items[t]})
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for block in blocks(pa.array(texts, pa.large_string()), ALNUM):
        own = block.hashes()
        out += [own[block.at[i] : block.at[i + 1]] for i in range(block.n)]
    return out


def automata(benchmark: DataFrame, window: int, key: str, text: str) -> list:
    """Broadcast automata, one for each part of the items."""
    sc, parts = benchmark.sparkSession.sparkContext, []
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).orderBy("k", "t")
    held: list[tuple[object, np.ndarray]] = []

    def close() -> None:
        parts.append(sc.broadcast(Automaton([x for _, x in held], window, [k for k, _ in held])))
        held.clear()

    size = 0
    for k, t in rows.toLocalIterator():
        (own,) = _item_words([t])
        start = 0
        while start < len(own):
            if size >= PART_WORDS:
                close()
                size = 0
            piece = own[start : start + max(window, PART_WORDS - size)]
            # what is left over is never shorter than a window, so no piece counts as a short item
            held.append((k, piece))
            size += len(piece)
            start += len(piece)
            if start < len(own):
                start -= window - 1
    if held or not parts:
        close()
    return parts


SPANS = "array<struct<begin:int,end:int>>"


def hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """`docs` with n_words (long), hits (spans [begin, end) of words, merged) and items (sorted ids of the items hit)."""
    kind = benchmark.schema[item_key].dataType
    new = {"n_words": "long", "hits": SPANS, "items": f"array<{kind.simpleString()}>"}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    at = base.columns.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + [f"{k} {v}" for k, v in new.items()])
    parts = automata(benchmark, window, item_key, item_text)
    item = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(len(batch), dtype=np.int64)
            found: dict[int, tuple[list[tuple[int, int]], set]] = {}
            for k, shown in enumerate(parts):
                automaton = shown.value
                for block in blocks(batch.column(at), ALNUM):
                    if k == 0:
                        n[block.first : block.first + block.n] = np.diff(block.at)
                    for t, (spans, items) in automaton.read(block).items():
                        own = found.setdefault(block.first + t, ([], set()))
                        own[0].extend(spans)
                        own[1].update(items)
                if len(parts) > 1:
                    del automaton, shown._value  # read again for the next batch: one part is held at a time
            spans, items = [[]] * len(batch), [[]] * len(batch)
            for t, own in found.items():
                spans[t] = [{"begin": a, "end": b} for a, b in merged(own[0])]
                items[t] = sorted(own[1] - {None})
            columns = [pa.array(n), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(item))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    return base.mapInArrow(tidy(run), schema)


def n_hit(spans: str = "hits"):
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["begin"]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 10, max_percent: int = 50, **names) -> DataFrame:
    """`docs` without their hit spans: text is cut, n_cut (long) counts the words that went, over_limit says whether more than `max_percent` % of the words did."""
    found = hits(docs, benchmark, text=text, window=window, **names)
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "items", "n_cut", "over_limit")]
    found = found.select(*[F.col(f"`{c}`") for c in kept], F.col("n_words"), F.col("hits"))
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(pa.compute.list_value_length(batch.column(len(kept) + 1)).fill_null(0).to_numpy(zero_copy_only=False))
            texts = batch.column(at)
            if len(hit):
                # only texts with a hit leave Arrow
                some, new = pa.array(hit), []
                for text_, spans in zip(texts.take(some), batch.column(len(kept) + 1).take(some), strict=True):
                    raw, spans = text_.as_buffer().to_pybytes(), spans.as_py()
                    block = Block(0, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), ALNUM)
                    end, left = 0, []
                    for x in spans:
                        left.append(raw[end : block.starts[x["begin"]]])
                        end = int(block.ends[x["end"] - 1])
                    new.append(b"".join([*left, raw[end:]]).decode())
                mask = np.zeros(len(batch), dtype=bool)
                mask[hit] = True
                texts = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=batch.schema.names)

    cut = found.mapInArrow(tidy(run), found.schema)
    gone = n_hit()
    return cut.select(*[F.col(f"`{c}`") for c in kept], gone.alias("n_cut"), (gone * 100 > F.col("n_words") * max_percent).alias("over_limit"))
