"""Language ID by prediction by partial matching: variable-order byte context trees with frozen statistics.

For each language the tree of contexts of up to `ORDER` bytes keeps how often each byte followed; an escape leads from a
context to the next shorter one (method C: a context seen n times with d distinct successors escapes with d / (n + d)), the
empty context escapes to all 256 bytes alike. A text's code length under a language is the sum of its bytes' code lengths,
exactly; the shortest wins and the score is the posterior of the winner at even priors.

The trees of `TABLE` languages are merged to one table per order, from the hash of (context, byte) to the code length in
each of them, so that a text is scored by a few numpy lookups a byte; more languages take further tables. Code lengths are
whole numbers of 1 / `UNIT` bits, so that their sums do not depend on what else is in a table. Every label is learnt. The
size of a table is bounded by the training sample: `SAMPLE` rows a language at most, chosen by a hash of id and text, and
`LONGEST` characters of each at most, of a longer text a stretch from a place that the hash gives. Only training is bounded;
every text is scored whole.

Defined results: a text that is null or has no letter is `und` with score 0; with nothing to learn from every text is
`und`; rows with null lang or text are not learnt from; equal code lengths go to the first language by name; rows of one id
and text are learnt from once; repeated rows are judged each alone; an empty table gives no rows; new columns replace those
of the same name, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwell.llm.words import arrow_bytes, tidy

ORDER = 3
#: Labelled rows that are learnt from, a language, and the characters of each, at most.
SAMPLE, LONGEST = 300, 8000
#: Languages in a score table at most; it has a code length of every n-gram for each of them. And n-grams of the longest
#: order times languages, of 4 bytes each, in a table of several languages at most.
TABLE, CELLS = 16, 1 << 24
#: Code lengths are counted in so many parts of a bit.
UNIT = 1 << 20
#: Bits a byte, those of raw bytes, beyond which a text is no text of a learnt language.
MOST_BITS = 8.0
#: Code lengths that are held at once: bytes times languages of a table, or texts times languages.
HELD = 1 << 21


@dataclass
class Model:
    langs: list[str]
    #: By order 0 to ORDER: sorted keys (context and byte), their code lengths by language; sorted contexts, their escapes by language.
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def _grams(data: np.ndarray, inside: np.ndarray, order: int) -> np.ndarray:
    """Keys of the bytes that have `order` bytes before them in their text: inside counts a byte's predecessors."""
    at = np.flatnonzero(inside >= order)
    key = np.zeros(len(at), dtype=np.uint32)
    for i in range(order, -1, -1):
        key = (key << np.uint32(8)) | data[at - i]
    return key


def _inside(offsets: np.ndarray) -> np.ndarray:
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def _units(ratio: np.ndarray) -> np.ndarray:
    return np.rint(np.log2(ratio) * UNIT).astype(np.int32)


def learn(texts: dict[str, list[str]]) -> Model:
    langs = sorted(texts)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in langs:
        data, offsets = arrow_bytes(pa.array(texts[lang], pa.large_string()))
        inside = _inside(offsets)
        counts.append([np.unique(_grams(data, inside, k), return_counts=True) for k in range(ORDER + 1)])
    keys, bits, contexts, escapes = [], [], [], []
    for k in range(ORDER + 1):
        every = np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *(c[k][0] for c in counts)]))
        over = np.unique(every >> np.uint32(8)) if k else np.zeros(1, dtype=np.uint32)
        bit, escape = np.zeros((len(every), len(langs)), dtype=np.int32), np.zeros((len(over), len(langs)), dtype=np.int32)
        for j, c in enumerate(counts):
            key, n = c[k]
            own, start = np.unique(key >> np.uint32(8), return_index=True)
            total = np.add.reduceat(n, start) if len(n) else np.zeros(0)
            kinds = np.diff(np.concatenate([start, [len(key)]]))
            escape[np.searchsorted(over, own), j] = _units((total + kinds) / kinds)
            seen = np.searchsorted(every, key)
            unseen = np.ones(len(every), dtype=bool)
            unseen[seen] = False
            bit[seen, j] = _units(np.repeat(total + kinds, kinds) / n)
            rest = every[unseen]
            if k == 0:
                bit[unseen, j] = escape[0, j] + 8 * UNIT
            else:
                lower = bits[k - 1][np.searchsorted(keys[k - 1], rest & np.uint32((1 << 8 * k) - 1)), j]
                bit[unseen, j] = escape[np.searchsorted(over, rest >> np.uint32(8)), j] + lower
        keys.append(every)
        bits.append(bit)
        contexts.append(over)
        escapes.append(escape)
    return Model(langs, keys, bits, contexts, escapes)


class _Lookup:
    """Open addressing for 32-bit keys: the number of a key, or -1."""

    def __init__(self, keys: np.ndarray) -> None:
        self.size = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.key, self.place = np.zeros(1 << self.size, dtype=np.uint32), np.full(1 << self.size, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), self._at(keys)
        while len(left):
            free = self.place[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.place[slot], self.key[slot] = left[won], keys[left[won]]
            stay = np.ones(len(left), dtype=bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.size) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        out = self.place[at]
        left = np.flatnonzero((self.key[at] != keys) & (out >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.size) - 1)
            found = self.place[at]
            out[left] = found
            more = (self.key[at] != keys[left]) & (found >= 0)
            left, at = left[more], at[more]
        return out


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.of = [_Lookup(x) for x in model.keys]
        self.context = [_Lookup(x) for x in model.contexts]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        m = self.model
        inside = np.minimum(_inside(offsets), ORDER)
        bits = np.zeros((len(data) + 1, len(m.langs)), dtype=np.int32)
        last = np.zeros(len(data), dtype=np.uint32)
        padded = np.concatenate([np.zeros(ORDER, dtype=np.uint8), data])
        for i in range(ORDER, -1, -1):
            last = (last << np.uint32(8)) | padded[ORDER - i : ORDER - i + len(data)]
        place = self.of[ORDER](last)
        full = inside == ORDER
        hit = np.flatnonzero(full & (place >= 0))
        bits[hit] = m.bits[ORDER][place[hit]]
        left = np.flatnonzero(~full | (place < 0))
        order = inside[left]
        for k in range(ORDER, -1, -1):
            # those of order k: their code if known, else the escape and one order less
            own = np.flatnonzero(order == k)
            at = left[own]
            key = last[at] & np.uint32((1 << 8 * (k + 1)) - 1)
            place = self.of[k](key)
            known = place >= 0
            bits[at[known]] += m.bits[k][place[known]]
            at, key = at[~known], key[~known]
            if k:
                context = self.context[k](key >> np.uint32(8))
                bits[at[context >= 0]] += m.escapes[k][context[context >= 0]]
            else:
                bits[at] += m.escapes[0][0] + np.int32(8 * UNIT)
            order[own[~known]] = k - 1
        total = np.add.reduceat(bits, np.minimum(offsets[:-1], len(data)), axis=0, dtype=np.int64)
        total[np.diff(offsets) == 0] = 0
        return total / UNIT


def fit(docs: DataFrame, *, usable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, table: int = TABLE, cells: int = CELLS) -> list[Model]:
    """Learns every language of the rows of `docs` for which `usable` (over columns of `docs`) holds: a model for `table` of them, fewer if they have many n-grams."""
    rows = docs if usable is None else docs.where(usable)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # of about three times the rows wanted, by a hash of id and text, the first ones; the numbers of hashes tell how many that takes
    space = 1 << 30
    at = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(space))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), at.alias("at"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")).collect()
    if not counts:
        return []
    most = docs.sparkSession.createDataFrame([(r["lang"], min(space, -(-space * 3 * sample // max(1, r["n"])))) for r in counts], "lang string, most long")
    place = F.pmod(F.xxhash64("at"), F.greatest(F.lit(1), F.length("text") - LONGEST + 1)) + 1
    some = rows.join(F.broadcast(most), "lang").where(F.col("at") < F.col("most"))
    some = some.select("lang", "at", F.substring("text", place.cast("int"), F.lit(LONGEST)).alias("text")).distinct()
    some = some.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "text"))), 1, sample).alias("rows"))
    models, texts, keys = [], {}, 0
    for r in some.orderBy("lang").toLocalIterator():
        own = [x["text"] for x in r["rows"]]
        data, offsets = arrow_bytes(pa.array(own, pa.large_string()))
        more = len(np.unique(_grams(data, _inside(offsets), ORDER)))
        if texts and (len(texts) == table or (keys + more) * (len(texts) + 1) > cells):
            models.append(learn(texts))
            texts, keys = {}, 0
        texts[r["lang"]] = own
        keys += more
    return [*models, learn(texts)] if texts else models


def identify(docs: DataFrame, models: list[Model], *, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score, bits_per_byte, and accepted: whether a text is one of a learnt language."""
    shown = [docs.sparkSession.sparkContext.broadcast(m) for m in models]
    new = ["lang_pred", "score", "bits_per_byte", "accepted"]
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m.value) for m in shown]
        langs = np.array([x for s in scorers for x in s.model.langs], dtype=object)
        by_name = np.argsort(langs, kind="stable")
        langs = langs[by_name]
        size = max(1 << 12, HELD // max([1, *(len(s.model.langs) for s in scorers)]))
        most = max(1, HELD // max(1, len(langs)))
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(at))
            n = len(batch)
            lang, score, per_byte = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n)
            row = 0
            while row < n and len(langs):
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
                end = min(end, row + most)
                part, places = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
                bits = np.concatenate([s.lengths(part, places) for s in scorers], axis=1)[:, by_name]
                best = bits.argmin(axis=1)
                least = bits[np.arange(end - row), best]
                lang[row:end] = langs[best]
                score[row:end] = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(axis=1)
                per_byte[row:end] = least / np.maximum(1, np.diff(offsets[row : end + 1]))
                row = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(per_byte)], names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["lang_pred string", "score double", "bits_per_byte double"])
    out = base.mapInArrow(tidy(run), schema)
    none = ~F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = out.withColumn("lang_pred", F.when(none, "und").otherwise(F.col("lang_pred"))).withColumn("score", F.when(none, 0.0).otherwise(F.col("score")))
    return out.withColumn("accepted", (F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS))
