"""The byte view: variables of bytes, elements of a size given with each call.

Offsets are in bytes, strides in elements, as byte-level callers count them; data comes and goes as bytes. A trailing part
of an element is not touched. Everything is a call on a `Store` of ``u8`` variables, or on a transaction of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwell.errors import InvalidArgumentError
from seqwell.operators.positions import ELEM, POS, div, touched
from seqwell.sources.store import Store, Transaction


def whole(length: int, size: int, offset: int, stride: int, n: int | None) -> int:
    """How many whole elements of `size` bytes the pattern meets in `length` bytes."""
    if size < 1:
        raise InvalidArgumentError(f"element size {size}")
    m = touched(max(0, length - size + 1), offset, stride * size, None)
    return m if n is None else min(n, m) if touched(0, 0, 1, n) == 0 else 0


def _blocks(offset: int, size: int, stride: int, m: int):
    """Whether a position is a byte of the pattern, and which of its bytes."""
    t = F.col(POS) - offset
    step = stride * size
    inside = (t >= 0) & (t < (m - 1) * step + size) & (t % step < size)
    return inside, div(t, step) * size + t % step


def read(bytes_: DataFrame, length: int, size: int, offset: int = 0, stride: int = 1, n: int | None = None) -> DataFrame:
    inside, number = _blocks(offset, size, stride, whole(length, size, offset, stride, n))
    return bytes_.where(inside).select(number.alias(POS), ELEM)


def remove(bytes_: DataFrame, length: int, size: int, offset: int = 0, stride: int = 1, n: int | None = None) -> DataFrame:
    m = whole(length, size, offset, stride, n)
    inside, _ = _blocks(offset, size, stride, m)
    t, step = F.col(POS) - offset, stride * size
    gone = F.least(F.lit(m * size), div(t, step) * size + F.least(t % step, F.lit(size)))
    return bytes_.where(~inside).select(F.when(t < 0, F.col(POS)).otherwise(F.col(POS) - gone).alias(POS), ELEM)


def write(bytes_: DataFrame, length: int, source: DataFrame, size: int, offset: int = 0, stride: int = 1, n: int | None = None) -> DataFrame:
    inside, number = _blocks(offset, size, stride, whole(length, size, offset, stride, n))
    new = source.select(F.col(POS).alias("_at"), F.col(ELEM).alias("_new"))
    hit = bytes_.where(inside).withColumn("_at", number).join(new, "_at", "left").select(POS, F.coalesce("_new", ELEM).alias(ELEM))
    return bytes_.where(~inside).select(POS, ELEM).unionByName(hit)


class ByteStore:
    """open, create, get, delete, fsize, insert, read, write, remove, begin, commit over bytes; tx None: a transaction per call."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Store(spark, path)

    def __enter__(self) -> ByteStore:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        self.store.close()

    def begin(self) -> Transaction:
        return self.store.begin()

    def commit(self, tx: Transaction) -> int:
        return tx.commit()

    def _run(self, tx: Transaction | None, work):
        return work(tx) if tx is not None else self.store._auto(work)

    def create(self, name: str, tx: Transaction | None = None) -> str:
        return self._run(tx, lambda t: t.create(name, "u8"))

    def get(self, name: str, tx: Transaction | None = None) -> str:
        return (tx or self.begin())._entry(name)["id"]

    def delete(self, name: str, tx: Transaction | None = None) -> None:
        self._run(tx, lambda t: t.delete(name))

    def fsize(self, name: str, tx: Transaction | None = None) -> int:
        return (tx or self.begin()).size(name)

    def insert(self, name: str, data: bytes, offset: int, size: int = 1, tx: Transaction | None = None) -> int:
        """How many elements; `data` is cut to whole ones."""
        n = len(data) // size
        self._run(tx, lambda t: t.insert(name, data[: n * size], offset))
        return n

    def read(self, name: str, size: int = 1, offset: int = 0, stride: int = 1, n: int | None = None, tx: Transaction | None = None) -> bytes:
        t = tx or self.begin()
        return _collected(self._read(t, name, size, offset, stride, n))

    def _read(self, t: Transaction, name: str, size: int, offset: int, stride: int, n: int | None) -> DataFrame:
        length = t.length(name)
        m = whole(length, size, offset, stride, n)
        end = offset + (m - 1) * stride * size + size if m else offset
        return read(t._scan(name, offset, end), length, size, offset, stride, m)

    def write(self, name: str, data: bytes, size: int = 1, offset: int = 0, stride: int = 1, n: int | None = None, tx: Transaction | None = None) -> int:
        def work(t: Transaction) -> int:
            m = min(whole(t.length(name), size, offset, stride, n), len(data) // size)
            if not m:
                return 0
            if stride == 1 or size == 1:
                t.write(name, data[: m * size], offset, stride, m * size)
                return m
            end = offset + (m - 1) * stride * size + size
            old = t._scan(name, offset, end).select((F.col(POS) - offset).alias(POS), ELEM)
            t.write(name, write(old, end - offset, t.source(name, data[: m * size]), size, 0, stride, m), offset)
            return m

        return self._run(tx, work)

    def remove(self, name: str, size: int = 1, offset: int = 0, stride: int = 1, n: int | None = None, tx: Transaction | None = None, *, take: bool = False) -> int | bytes:
        """How many elements went or, with take, their bytes."""

        def work(t: Transaction) -> int | bytes:
            m = whole(t.length(name), size, offset, stride, n)
            taken = _collected(self._read(t, name, size, offset, stride, m)) if take else b""
            if m and (stride == 1 or size == 1):
                t.remove(name, offset, stride, m * size)
            elif m:
                end = offset + (m - 1) * stride * size + size
                left = remove(t._scan(name, offset, end).select((F.col(POS) - offset).alias(POS), ELEM), end - offset, size, 0, stride, m)
                kept = t._put(name, left)
                t._set(name, t._pieces(name).cut(offset, end).insert(offset, [kept]), f"remove {name} {offset} {stride} {m}")
            return taken if take else m

        return self._run(tx, work)


def _collected(rows: DataFrame) -> bytes:
    return rows.orderBy(POS).select(ELEM).toArrow().column(0).to_numpy().astype(np.uint8).tobytes()


#: Bytes of a file that go as one row before they are told apart.
CHUNK = 4096


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of all files of `path`, one file after the other by name, as (pos, elem): a source for `insert` or `write`.

    Where a file begins follows from the lengths alone, one row a file; contents are not gathered. A file becomes rows of a
    chunk each, a chunk rows of a byte each, so that no row carries more than its own part along.
    """
    files = spark.read.format("binaryFile").load(path)
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    first = files.select("path", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("first"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / CHUNK)), lambda i: F.substring("content", (i * CHUNK + 1).cast("int"), F.lit(CHUNK)))
    chunks = files.where("length > 0").select("path", F.posexplode(cut).alias("k", "chunk"))
    chunks = chunks.join(first, "path").select((F.col("first") + F.col("k").cast("long") * CHUNK).alias("at"), "chunk")
    numbers = F.transform(F.sequence(F.lit(1), F.length("chunk")), lambda i: F.conv(F.hex(F.substring("chunk", i, F.lit(1))), 16, 10).cast("short"))
    return chunks.select("at", F.posexplode(numbers).alias("i", ELEM)).select((F.col("at") + F.col("i")).alias(POS), ELEM)
