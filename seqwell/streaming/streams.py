"""Open-ended inserts, writes, takes and reads by Structured Streaming.

A sink takes each micro-batch in one transaction that also records the batch's number under the stream's id, so a batch that
is run again after a failure changes nothing: exactly once. A batch's rows are put in the order of the given keys, which
have to be total. A follower reads what versions of the store have added to a variable; it needs a variable that only
grows at its end, and says so otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqwell.errors import InvalidArgumentError
from seqwell.operators.ingest import positioned
from seqwell.sources.store import Store, Transaction


def _sink(store: Store, rows: DataFrame, stream_id: str, checkpoint: str, order: list[str], elem: Column, work: Callable[[Transaction, DataFrame, int], None], available_now: bool) -> StreamingQuery:
    def each(batch: DataFrame, number: int) -> None:
        with store.begin() as tx:
            done = tx.state["streams"].get(stream_id, {"batch": -1, "rows": 0})
            if number <= done["batch"]:
                tx.rollback()
                return
            # positions within the batch, written once: the plan of a batch may be computed anew
            at = f"streams/{stream_id}/{number}-{uuid.uuid4().hex}"
            kept = positioned(batch, order, elem, f"{store.path}/{at}")
            work(tx, kept, done["rows"])
            tx.state["streams"][stream_id] = {"batch": number, "rows": done["rows"] + kept.count()}
            tx.notes.append(f"stream {stream_id} {number}")
        store.root.delete(at)  # the variable has files of its own

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_stream(store: Store, name: str, rows: DataFrame, *, order: list[str], elem: Column, stream_id: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Inserts at the end, batch after batch."""
    return _sink(store, rows, stream_id, checkpoint, order, elem, lambda tx, batch, _: tx.insert(name, batch), available_now)


def insert_stream(store: Store, name: str, offset: int, rows: DataFrame, *, order: list[str], elem: Column, stream_id: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Inserts at an offset, each batch behind the one before."""
    return _sink(store, rows, stream_id, checkpoint, order, elem, lambda tx, batch, before: tx.insert(name, batch, offset + before), available_now)


def write_stream(store: Store, name: str, offset: int, stride: int, rows: DataFrame, *, order: list[str], elem: Column, stream_id: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Overwrites elements offset, offset + stride, ... on and on, up to the end of the variable."""
    return _sink(store, rows, stream_id, checkpoint, order, elem, lambda tx, batch, before: tx.write(name, batch, offset + before * stride, stride), available_now)


def _versions(store: Store) -> DataFrame:
    """The numbers of the versions of a store, as they are published; their texts are not looked at."""
    files = store.spark.readStream.schema("value string").option("wholetext", True).text(store.manifests.path, pathGlobFilter="v*.json")
    return files.select(F.regexp_extract("_metadata.file_name", r"^v([0-9]+)\.json$", 1).cast("long").alias("version"))


def follow(store: Store, name: str, each: Callable[[DataFrame, int], None], *, checkpoint: str, start: int = 0, stride: int = 1, available_now: bool = False) -> StreamingQuery:
    """Calls each(elements, batch) with the elements start, start + stride, ... that new versions have added, by (pos, elem), pos counting them from 0."""
    spark = store.spark
    versions = _versions(store)

    def batch(files: DataFrame, number: int) -> None:
        # of the new versions the least and the greatest, by the names of their files
        low, high = files.agg(F.min("version"), F.max("version")).first()
        if low is None:
            return
        first, last = store.manifest(low), store.manifest(high)
        before = store.manifest(first["version"] - 1) if first["version"] else {"variables": {}}
        old, new = (store.pieces(m["variables"].get(name)) for m in (before, last))
        if new[: len(old)] != old:
            raise InvalidArgumentError(f"{name} was changed before its end; a follower needs a variable that only grows")
        a, b = (sum(p[2] for p in x) for x in (old, new))
        # the first element of the pattern at or after a
        skip = max(0, -(-(a - start) // stride))
        rows = store.at(last["version"]).read(name, start + skip * stride, stride)
        if start + skip * stride < b:
            each(rows.select((F.col("pos") + skip).alias("pos"), "elem"), number)

    writer = versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def take_stream(store: Store, name: str, each: Callable[[DataFrame, int], None], *, stream_id: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Takes what is there whenever a version is published: a batch is removed from the variable once `each` has returned."""
    versions = _versions(store)

    def batch(_: DataFrame, number: int) -> None:
        with store.begin() as tx:
            if number <= tx.state["streams"].get(stream_id, {"batch": -1})["batch"] or not tx.length(name):
                tx.rollback()
                return
            n = tx.length(name)
            each(tx.take(name, 0, 1, n), number)
            tx.state["streams"][stream_id] = {"batch": number, "rows": n}
            tx.notes.append(f"stream {stream_id} {number}")

    writer = versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Window:
    """The last `size` elements of a variable."""

    def __init__(self, store: Store, name: str, size: int) -> None:
        self.store, self.name, self.size = store, name, size

    def read(self) -> DataFrame:
        tx = self.store.begin()
        return tx.read(self.name, max(0, tx.length(self.name) - self.size))

    def append(self, data) -> int:
        """Appends and lets go of what falls out of the window, in one transaction."""
        with self.store.begin() as tx:
            n = tx.insert(self.name, data)
            tx.remove(self.name, 0, 1, max(0, tx.length(self.name) - self.size))
        return n


class Requests:
    """Calls that return at once: each gives a future, run one after the other as the store has one writer."""

    def __init__(self) -> None:
        self.pool = ThreadPoolExecutor(max_workers=1)

    def __enter__(self) -> Requests:
        return self

    def __exit__(self, *exc) -> None:
        self.pool.shutdown(wait=True)

    def submit(self, work: Callable, *args, **kwargs) -> Future:
        return self.pool.submit(work, *args, **kwargs)
