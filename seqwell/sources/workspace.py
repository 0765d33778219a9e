"""Where queries keep what they store for themselves."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession

#: Workspaces go when the driver's process ends, as results still read them.
_made: dict[str, SparkSession] = {}


def workspace(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which driver and executors share.

    Where none is set, it is a temporary one of this machine if the master is local, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    kept = sc._jsc.sc().getCheckpointDir()
    if not kept.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="workspace-"))
        kept = sc._jsc.sc().getCheckpointDir()
    path = f"{kept.get()}/{uuid.uuid4().hex}"
    _made[path] = spark
    return path


@atexit.register
def _cleared() -> None:
    for path, spark in _made.items():
        with suppress(Exception):  # the session may have been stopped
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
