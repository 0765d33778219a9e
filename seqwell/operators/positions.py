"""The positional algebra in closed form.

A sequence is a DataFrame (pos BIGINT, elem T) whose positions are 0 to length - 1. Every operator is a filter and a
projection on `pos`, so that no operator sorts, numbers rows or shuffles, but for the equi-join by which `write` meets its
source. The range part of a filter reaches the Parquet scan; a stride's remainder is only asked for if the stride is not 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwell.errors import CorruptError, InvalidArgumentError

POS, ELEM = "pos", "elem"


def touched(length: int, offset: int, stride: int, n: int | None) -> int:
    """How many elements an access pattern meets; n None: up to the end."""
    if offset < 0 or stride < 1 or (n is not None and n < 0) or length < 0:
        raise InvalidArgumentError(f"offset {offset}, stride {stride} and count {n} must not be negative, the stride at least 1")
    if offset >= length:
        return 0
    there = -(-(length - offset) // stride)
    return there if n is None else min(n, there)


def div(a: Column, b: int) -> Column:
    return a if b == 1 else F.call_function("div", a, F.lit(b))


def _steps(offset: int, stride: int) -> Column:
    """Which step of the pattern a position is; only for positions of the pattern."""
    return div(F.col(POS) - offset, stride)


def within(offset: int, stride: int, n: int | None) -> Column:
    """Whether a position belongs to the pattern."""
    inside = F.col(POS) >= offset
    if n is not None:
        inside = inside & (F.col(POS) < offset + n * stride)
    return inside if stride == 1 else inside & ((F.col(POS) - offset) % stride == 0)


def read(seq: DataFrame, offset: int = 0, stride: int = 1, n: int | None = None) -> DataFrame:
    """Elements offset, offset + stride, ... of `seq`, n at most, from position 0 on."""
    touched(0, offset, stride, n)
    return seq.where(within(offset, stride, n)).select(_steps(offset, stride).alias(POS), ELEM)


def length(seq: DataFrame) -> int:
    return seq.count()


def insert(seq: DataFrame, source: DataFrame, offset: int, *, size: int | None = None, n: int | None = None) -> DataFrame:
    """`source` inside `seq` before position `offset`, at the end if that lies beyond it; size, n: lengths of both if known."""
    if offset < 0:
        raise InvalidArgumentError(f"offset {offset} is negative")
    n = length(source) if n is None else n
    at = min(offset, length(seq) if size is None else size)
    moved = seq.select(F.when(F.col(POS) >= at, F.col(POS) + n).otherwise(F.col(POS)).alias(POS), ELEM)
    return moved.unionByName(source.select((F.col(POS) + at).alias(POS), ELEM)) if n else seq.select(POS, ELEM)


def append(seq: DataFrame, source: DataFrame, *, size: int | None = None, n: int | None = None) -> DataFrame:
    size = length(seq) if size is None else size
    return insert(seq, source, size, size=size, n=n)


def write(seq: DataFrame, source: DataFrame, offset: int = 0, stride: int = 1, n: int | None = None) -> DataFrame:
    """Overwrites the pattern's elements in place with those of `source`, as far as both go; the length stays.

    Elements outside the pattern never take part in the join, so they are not shuffled.
    """
    touched(0, offset, stride, n)
    inside = within(offset, stride, n)
    new = source.select(F.col(POS).alias("_step"), F.col(ELEM).alias("_new"), F.lit(True).alias("_there"))
    hit = seq.where(inside).withColumn("_step", _steps(offset, stride)).join(new, "_step", "left")
    hit = hit.select(POS, F.when(F.col("_there"), F.col("_new")).otherwise(F.col(ELEM)).alias(ELEM))
    return seq.where(~inside).select(POS, ELEM).unionByName(hit)


def remove(seq: DataFrame, offset: int = 0, stride: int = 1, n: int | None = None, *, size: int | None = None) -> DataFrame:
    """`seq` without the pattern's elements, the gaps closed."""
    m = touched(length(seq) if size is None and n is None else size if size is not None else 1 << 62, offset, stride, n)
    if not m:
        return seq.select(POS, ELEM)
    gone = F.least(F.lit(m), div(F.col(POS) - offset + (stride - 1), stride))
    return seq.where(~within(offset, stride, m)).select(F.when(F.col(POS) <= offset, F.col(POS)).otherwise(F.col(POS) - gone).alias(POS), ELEM)


def take(seq: DataFrame, offset: int = 0, stride: int = 1, n: int | None = None, *, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What `remove` removes, from position 0 on, and what it leaves."""
    return read(seq, offset, stride, n), remove(seq, offset, stride, n, size=size)


def kinds(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Of each group by `by`: count, least, greatest and number of different values of a column of positions.

    Values are counted exactly by bitmaps, 4 KB for 32768 positions, which are put together before the shuffle."""
    bucket = rows.groupBy(*by, F.bitmap_bucket_number(column).alias("_bucket")).agg(
        F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(column))).alias("kinds")
    )
    return bucket.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"))


def validate(seq: DataFrame) -> int:
    """The length, after a check that positions are dense and unique."""
    n, low, high, different = kinds(seq, POS).first()
    if n and (low != 0 or high != n - 1 or different != n):
        raise CorruptError(f"{n} elements at {different} positions from {low} to {high}")
    return n


def slice_pattern(size: int, key: slice) -> tuple[int, int, int]:
    """Offset, stride and count of a Python slice over `size` elements: defaults 0, size and 1, nothing for an empty range."""
    if not isinstance(key, slice):
        raise TypeError("positions are given as a slice, start:stop:stride")
    start, stop, step = key.start or 0, size if key.stop is None else key.stop, 1 if key.step is None else key.step
    if start < 0 or stop < 0 or step < 1:
        raise InvalidArgumentError("a slice has no negative start or stop, and a stride of 1 at least")
    return start, step, (stop - start + step - 1) // step if stop > start else 0
