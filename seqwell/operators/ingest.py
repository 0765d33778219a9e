"""Positions for rows that have none: a dense order by a total key, without gathering rows in one task.

Rows are dealt by ranges of the key, sorted inside each and written, a file a range; a row's place in its file and one small
count per file then give its position, so rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwell.operators.positions import ELEM, POS


def positioned(rows: DataFrame, keys: list[str], elem: Column, folder: str, *, partitions: int | None = None) -> DataFrame:
    """(pos, elem) in the order of `keys`, which must tell all rows apart that differ in `elem`; kept under `folder`."""
    by = [F.col(k) for k in keys]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    own = ranged.sortWithinPartitions(*by).select(elem.alias(ELEM))
    own.write.mode("error").parquet(folder)
    kept = rows.sparkSession.read.schema(own.schema).parquet(folder).select(ELEM, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = kept.groupBy("_file").agg(F.count("*").alias("_n"))
    # files are named by their range; one row a file, so a window over all of them is small, and so is what is broadcast
    upto = Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_file", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"))
    return kept.join(F.broadcast(first), "_file").select((F.col("_first") + F.col("_at")).cast("long").alias(POS), ELEM)
