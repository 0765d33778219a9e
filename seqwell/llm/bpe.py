"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

A text is cut by the public pattern into pieces. Pieces not met before are put, by length, into matrices of token ids padded
on the right; in each round every row merges its leftmost pair of least rank, all rows at once: ranks come from a hashed
table of pairs by a few vector look-ups, and the row is compacted. Rows without a pair that merges are done and leave. A
piece of more than `LONG` bytes, for which rows would cost its length squared, goes through a heap in the same order.

Ranks of pairs are those of the joined bytes, as the reference semantics of rank files have it, so a pair may join tokens of
any split. Results of pieces are kept in a bounded cache.

Defined results: a null text is the empty text, without ids, and decodes to no bytes; an id outside the vocabulary raises
when decoded; repeated rows are encoded each alone; new columns replace those of the same name, others pass through.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqwell.llm.words import tidy

LONG = 64
#: Pieces that a worker keeps the ids of, and pieces that are merged at once.
CACHE, TOGETHER = 200_000, 20_000
NONE = np.int32(2**31 - 1)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.size = max(self.ranks.values()) + 1
        token = [b""] * self.size
        for t, i in self.ranks.items():
            token[i] = t
        self.token_length = np.array([len(t) for t in token], dtype=np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(token), dtype=np.uint8)
        self._forget()
        self.slots: np.ndarray | None = None

    def _forget(self) -> None:
        """No piece is known: pieces have numbers, and by number where their ids begin in one array, and how many they are."""
        self.known: dict[str, int] = {}
        self.start, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def _pairs(self) -> None:
        """The table of pairs, which only encoding needs."""
        pairs = [(self.ranks[t[:i]] * self.size + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        key, rank = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        # open addressing, a quarter full at most; a slot without a key holds -1
        self.shift = np.uint64(64 - int(np.ceil(np.log2(len(key) * 4))))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.merged = np.full(len(self.slots), NONE, dtype=np.int32)
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.slots[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            self.slots[slot], self.merged[slot] = key[free[first]], rank[free[first]]
            left = self.slots[at] != key
            key, rank, at = key[left], rank[left], (at[left] + 1) & (len(self.slots) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair joined, or NONE."""
        if self.slots is None:
            self._pairs()
        key = a.astype(np.int64) * self.size + b
        at = self._slot(key)
        found = self.slots[at]
        out = np.where(found == key, self.merged[at], NONE)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found = self.slots[at[left]]
            same = found == key[left]
            out[left[same]] = self.merged[at[left[same]]]
            left = left[~same & (found >= 0)]
        return out

    def merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of at most LONG bytes and of about one length."""
        n, width = len(rows), max(map(len, rows))
        length = np.array([len(r) for r in rows], dtype=np.int64)
        ids = np.zeros((n, width), dtype=np.int32)
        ids[np.arange(width) < length[:, None]] = self.bytes[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        ranks = np.full((n, width), NONE, dtype=np.int32)
        r, c = np.nonzero(np.arange(1, width) < length[:, None])
        ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        out: list[np.ndarray] = [ids[0]] * n
        row = np.arange(n)
        while True:
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            done = best == NONE
            for i in np.flatnonzero(done).tolist():
                out[row[i]] = ids[i, : length[i]].copy()
            live = np.flatnonzero(~done)
            if not len(live):
                return out
            width = int(length[live].max())
            ids, ranks, row, length, at, best = ids[live, :width], ranks[live, :width], row[live], length[live] - 1, at[live], best[live]
            here = np.arange(len(row))
            # one column less: what stands right of the merged pair moves left
            take = np.arange(width - 1)
            take = take + (take > at[:, None])
            ids[here, at] = best
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ranks[here, np.minimum(at, width - 2)] = NONE
            right = np.flatnonzero(at + 1 < length)
            ranks[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])

    def merge_long(self, piece: bytes) -> np.ndarray:
        token = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        part = [piece[i : i + 1] for i in range(len(piece))]
        before, after = list(range(-1, len(piece) - 1)), [*range(1, len(piece)), -1]
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(piece) - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] is not a or j < 0 or part[j] is not b:
                continue
            part[i], token[i], part[j] = a + b, r, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get(part[x] + part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return np.array([t for t, p in zip(token, part, strict=True) if p is not None], dtype=np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Puts the ids of new pieces into the cache."""
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        found: list = [None] * len(pieces)
        for i, p in enumerate(pieces):
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                found[i] = (whole,)
            elif len(raw) > LONG:
                found[i] = self.merge_long(raw)
            else:
                buckets.setdefault(-(-len(raw) // 4), []).append((i, raw))
        for rows in buckets.values():
            for k in range(0, len(rows), TOGETHER):
                some = rows[k : k + TOGETHER]
                for (i, _), ids in zip(some, self.merge_rows([r for _, r in some]), strict=True):
                    found[i] = ids.tolist()
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(count.sum()))])

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last one's end."""
        pieces = [self.pattern.findall(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(pieces))
        number = np.fromiter(map(self.known.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            new = list(dict.fromkeys(flat[i] for i in missing))
            if len(self.known) + len(new) > CACHE:
                self._forget()
                new, missing = list(dict.fromkeys(flat)), range(len(flat))
            self.learn(new)
            number[missing] = [self.known[flat[i]] for i in missing]
        n = self.count[number]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.start[number] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        places = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[places]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, places = self.encode_all(texts)
        return [ids[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError("an id is not in the vocabulary")
        n = self.token_length[ids]
        total = int(n.sum())
        return self.token_bytes[np.repeat(self.token_start[ids] - np.cumsum(n) + n, n) + np.arange(total)]

    def split(self, ids: np.ndarray, places: np.ndarray) -> list[bytes]:
        """The bytes of the ids between each place and the next."""
        raw = self.decode(ids).tobytes()
        cut = np.concatenate([[0], np.cumsum(self.token_length[ids])])[places]
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


#: Bytes of text, or ids, that are worked on at once.
BLOCK = 1 << 18


def encode(docs: DataFrame, ranks: str, *, text: str = "text", decoded: bool = False) -> DataFrame:
    """`docs` with ids (array of int) and, if asked for, decoded (binary), the bytes of these ids. ranks: path of a rank file on every machine."""
    new = ["ids", "decoded"] if decoded else ["ids"]
    base = docs.select(*[f"`{c}`" for c in docs.columns if c not in new])
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(ranks)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).cumsum()
            row = 0
            while row < len(batch):
                end = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + BLOCK, side="right")))
                some = batch.slice(row, end - row)
                flat, places = own.encode_all(some.column(at).to_pylist())
                columns = [pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(flat))]
                if decoded:
                    columns.append(pa.array(own.split(flat, places), pa.binary()))
                yield pa.RecordBatch.from_arrays([*some.columns, *columns], names=[*batch.schema.names, *new])
                row = end

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["ids array<int>"] + ["decoded binary"] * decoded
    return base.mapInArrow(tidy(run), ", ".join(schema))


def decode(encoded: DataFrame, ranks: str, *, ids: str = "ids") -> DataFrame:
    """`encoded` with decoded (binary), the bytes of its ids; null ids decode to nothing."""
    base = encoded.select(*[f"`{c}`" for c in encoded.columns if c != "decoded"])
    at = base.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(ranks)
        for batch in batches:
            out: list[bytes] = []
            for i in range(0, len(batch), 256):
                lists = batch.column(at).slice(i, 256)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(counts)])
                k = 0
                while k < len(lists):  # up to BLOCK ids at once
                    to = max(k + 1, int(np.searchsorted(ends, ends[k] + BLOCK, side="right")) - 1)
                    out += own.split(flat[ends[k] : ends[to]], ends[k : to + 1] - ends[k])
                    k = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return base.mapInArrow(tidy(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["decoded binary"]))
