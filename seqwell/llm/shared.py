"""The folder that driver and executors share, for tables between passes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder of this machine if the master is local, as in tests; on a cluster, whose executors would write to disks of their own, that is an error."""
    sc = spark.sparkContext
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


#: Tables that results still read: they go when the driver's process ends.
_left: dict[str, SparkSession] = {}


@atexit.register
def _cleared() -> None:
    for path, spark in _left.items():
        with suppress(Exception):  # the session may have been stopped
            removed(spark, path)


def until_exit(spark: SparkSession, path: str) -> str:
    """`path`, which is removed when the driver's process ends."""
    _left[path] = spark
    return path


class Tables:
    """Tables in the shared folder: each computed once, so lineage is short and lost executors cost little. `keep` removes the others."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, {}

    def written(self, df: DataFrame) -> DataFrame:
        path = until_exit(self.spark, f"{folder(self.spark)}/{uuid.uuid4().hex}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[path] = out
        return out

    def keep(self, *frames: DataFrame) -> None:
        """Removes every table but `frames`; nothing that is still to run may read the others."""
        for path in [p for p, df in self.at.items() if not any(df is f for f in frames)]:
            removed(self.spark, path)
            del self.at[path], _left[path]


def written(df: DataFrame) -> DataFrame:
    """`df` as a table that stays in the shared folder until the driver's process ends."""
    return Tables(df.sparkSession).written(df)
