import io
import json

from pyspark.sql import functions as F

from seqwell.__main__ import main
from seqwell.sources.bytes import from_files
from seqwell.sources.store import Store
from seqwell.streaming import streams


def test_streams(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    v = store.create("s", "i64")
    source, schema = str(tmp_path / "in"), "k long, x long"
    start = lambda sink, **more: sink(store, "s", *more.pop("at", ()), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), order=["k"], elem=F.col("x"), checkpoint=str(tmp_path / more["stream_id"]), available_now=True, **more).awaitTermination()
    spark.createDataFrame([(2, 20), (1, 10)], schema).coalesce(1).write.parquet(source)
    start(streams.append_stream, stream_id="a")
    assert v.values() == [10, 20]
    seen = []
    follow = lambda: streams.follow(store, "s", lambda df, n: seen.append([(r.pos, r.elem) for r in df.orderBy("pos").collect()]), checkpoint=str(tmp_path / "f"), stride=2, available_now=True).awaitTermination()
    follow()
    spark.createDataFrame([(3, 30)], schema).coalesce(1).write.mode("append").parquet(source)
    start(streams.append_stream, stream_id="a")  # goes on where it stopped
    assert v.values() == [10, 20, 30]
    follow()
    assert seen == [[(0, 10)], [(1, 30)]]
    start(streams.insert_stream, stream_id="b", at=(1,))
    assert sorted(v.values()[1:4]) == [10, 20, 30] and v.values()[4:] == [20, 30]
    start(streams.write_stream, stream_id="c", at=(0, 2))
    assert sorted(v.values()[0:6:1][i] for i in (0, 2, 4)) == [10, 20, 30]
    taken = []
    streams.take_stream(store, "s", lambda df, n: taken.extend(r.elem for r in df.orderBy("pos").collect()), stream_id="t", checkpoint=str(tmp_path / "t"), available_now=True).awaitTermination()
    assert len(taken) == 6 and len(v) == 0


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    v = store.create("s", "i64")
    with store.begin() as tx:
        tx.insert("s", [1])
        tx.state["streams"]["a"] = {"batch": 7, "rows": 1}
    spark.createDataFrame([(2, 20)], "k long, x long").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("k long, x long").parquet(str(tmp_path / "in"))
    streams.append_stream(store, "s", rows, order=["k"], elem=F.col("x"), stream_id="a", checkpoint=str(tmp_path / "c"), available_now=True).awaitTermination()
    assert v.values() == [1]  # its number, 0, was done before


def test_window_and_requests(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create("w", "i32")
    window = streams.Window(store, "w", 3)
    with streams.Requests() as requests:
        done = [requests.submit(window.append, [i, i + 1]) for i in (0, 2, 4)]
    assert [d.result() for d in done] == [2, 2, 2] and [r.elem for r in window.read().orderBy("pos").collect()] == [3, 4, 5]


def test_command_line_and_files(spark, tmp_path):
    out = io.StringIO()
    code = main([str(tmp_path / "store"), "create v u8; insert v 0; read v 0:9:2; read nothing;"], io.StringIO("1\n2\n3\n"), out, spark)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert code == 1 and lines[1:4] == [{"insert": "v", "result": 3}, {"pos": 0, "elem": 1}, {"pos": 1, "elem": 3}] and lines[4]["error"] == "NoSuchVariableError"
    for name, raw in (("b", b"\xff\x00"), ("a", b"xyz"), ("c", b"")):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_bytes(raw)
    v = Store(spark, str(tmp_path / "store")).get("v")
    v.insert(0, from_files(spark, str(tmp_path / "files")))
    assert v.to_bytes() == b"xyz\xff\x00\x01\x02\x03"
