"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its lower-cased words, pairs of neighbours and pairs with one word between.
Learning keeps a rate per coordinate and an L1 term, so most weights are exactly zero; what is broadcast are the non-zero
ones, 2 ** BITS at most. The model is fitted on the driver from a bounded sample of labelled rows: those `SAMPLE` with the
smallest hash of their id, of them as many as have `FEATURES` features together. What comes to the driver are features of
whole texts, 4 bytes each, not the texts.

Defined results: null and empty texts have no features and get the score of the bias alone; a row with a null label or id
is not learnt from; a doc_id with several labels is toxic if one of them is, of several texts under one doc_id the one of
the smallest hash is learnt from; with no labels or no documents at all every score is 0.5; very long texts are scored whole;
repeated rows are scored each alone; further columns pass through, a new column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwell.llm.words import ALNUM, Block, blocks, mixed, tidy

BITS = 18
#: Labelled rows that are learnt from, at most.
SAMPLE = 12000
#: Features of them together that come to the driver, at most but for the last row's, which are 2 ** BITS at most.
FEATURES = 1 << 24


@dataclass
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, places) of single words, pairs, and pairs with a gap."""
    own = block.hashes()
    text = np.repeat(np.arange(block.n), np.diff(block.at))
    for gap, salt in ((0, 0), (1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        if gap == 0:
            at, x = np.arange(len(own)), own
        else:
            at = np.flatnonzero(text[:-gap] == text[gap:]) if len(own) > gap else np.zeros(0, dtype=np.int64)
            x = mixed(own[at] * np.uint64(salt) + own[at + gap])
        yield text[at], (x >> np.uint64(64 - BITS)).astype(np.int64)


def _sparse(texts: pa.Array) -> list[np.ndarray]:
    """The places of each text's features."""
    out: list[np.ndarray] = []
    for block in blocks(texts, ALNUM):
        text, place = (np.concatenate(x) for x in zip(*features(block), strict=True))
        key = np.unique((text << BITS) | place)
        cut = np.searchsorted(key, np.arange(block.n + 1) << BITS)
        out += [(key[cut[i] : cut[i + 1]] & ((1 << BITS) - 1)).astype(np.int32) for i in range(block.n)]
    return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, *, rate: float = 1.0, beta: float = 1.0, l1: float = 15.0, l2: float = 0.5, rounds: int = 6, seed: int = 7) -> Model:
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            x = rows[i]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / rate + l2))
            b = -z0 / ((beta + np.sqrt(n0)) / rate)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - labels[i]
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / rate * w
            n[x] = nx + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / rate * b
            n0 += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / rate + l2))
    places = np.flatnonzero(w)
    return Model(places, w[places].astype(np.float32), float(-z0 / ((beta + np.sqrt(n0)) / rate)))


def fit(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, most: int = FEATURES) -> Model:
    """Learns from `labels` rows for which `usable` (over the column `key`) holds."""
    some = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    if usable is not None:
        some = some.where(usable)
    some = some.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")  # `sample` rows at most are broadcast
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), one.alias("text")).select(F.xxhash64("doc_id").alias("at"), F.col("doc_id").cast("string").alias("doc_id"), "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.array([x.tobytes() for x in _sparse(batch.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], places], names=[*batch.schema.names[:3], "places"])

    found, y, held = [], [], 0
    for r in rows.mapInArrow(tidy(run), "at long, doc_id string, y int, places binary").orderBy("at", "doc_id").toLocalIterator():
        found.append(np.frombuffer(r["places"], dtype=np.int32))
        y.append(r["y"])
        held += len(found[-1])
        if held >= most:
            break
    return ftrl(found, np.array(y, dtype=float)) if found else Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 0.0)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """`docs` with score (double, 0 to 1)."""
    shown = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"])
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shown.value
        weights = np.zeros(1 << BITS, dtype=np.float32)
        weights[m.places] = m.weights
        live = weights != 0
        for batch in batches:
            total = np.full(len(batch), m.bias)
            for block in blocks(batch.column(at), ALNUM):
                keys = []
                for t, place in features(block):
                    some = np.flatnonzero(live[place])
                    keys.append((t[some] << BITS) | place[some])
                key = np.unique(np.concatenate(keys))
                total[block.first : block.first + block.n] += np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)], block.n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*batch.schema.names, "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["score double"])
    return base.mapInArrow(tidy(run), schema)
