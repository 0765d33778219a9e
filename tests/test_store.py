import random

import model
import pytest

from seqwell import errors
from seqwell.plans.language import execute
from seqwell.plans.pieces import Piece, Pieces
from seqwell.sources.bytes import ByteStore
from seqwell.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    with Store(spark, str(tmp_path / "store")) as made:
        yield made


def test_pieces_against_lists():
    rng = random.Random(11)
    for _ in range(200):
        pieces, flat, k = Pieces(), [], 0
        for _ in range(rng.randrange(1, 12)):
            k += 1
            n = rng.randrange(1, 9)
            new = [(f"f{k}", i) for i in range(n)]
            at = rng.randrange(0, len(flat) + 1)
            kind = rng.choice(["insert", "cut", "replace"])
            if kind == "insert":
                pieces, flat = pieces.insert(at, [Piece(f"f{k}", 0, n)]), flat[:at] + new + flat[at:]
            elif kind == "cut":
                pieces, flat = pieces.cut(at, at + n), flat[:at] + flat[at + n :]
            elif at + n <= len(flat):
                pieces, flat = pieces.replace(at, [Piece(f"f{k}", 0, n)]), flat[:at] + new + flat[at + n :]
        assert [(p.file, p.start + i) for p in pieces.pieces for i in range(p.count)] == flat and len(pieces) == len(flat)
        for i in range(len(flat)):
            j, skip = pieces.seek(i)
            assert (pieces.pieces[j].file, pieces.pieces[j].start + skip) == flat[i]
        assert Pieces.load(pieces.dump()) == pieces


def test_scenario_mixed(store):
    v = store.create("data", "i32")
    v.insert(0, list(range(200)))
    v.write([88000 + i for i in range(10)], 50)
    v.remove(100, 1, 50)
    want = model.remove(model.write(list(range(200)), [88000 + i for i in range(10)], 50, 1, None), 100, 1, 50)
    assert v.values() == want and len(Store(store.spark, store.path).get("data")) == 150
    v[0:70:7] = [77000 + i for i in range(10)]
    del v[0:150:3]
    want = model.remove(model.write(want, [77000 + i for i in range(10)], 0, 7, None), 0, 3, 50)
    assert v.values() == want and store.validate("data") == len(want)


def test_many_strided(store):
    v = store.create("data", "i32")
    base = list(range(1000))
    v.append(base)
    v.write(list(range(9000, 9200)), 1, 4)
    v.remove(3, 5, 150)
    assert v.values() == model.remove(model.write(base, list(range(9000, 9200)), 1, 4, None), 3, 5, 150)
    taken = v.taking()[0:9:2]
    assert [r.elem for r in taken.orderBy("pos").collect()] == model.read(model.remove(model.write(base, list(range(9000, 9200)), 1, 4, None), 3, 5, 150), 0, 2, 5)


def test_edges(store):
    v = store.create("e", "i32")
    assert v.write([1, 2], 0) == v.remove(0, 1, 5) == v.insert(3, []) == len(v) == 0 and v.values() == []
    v.insert(25, [1, 2, 3])
    assert v.values() == [1, 2, 3] and v.write([9, 9], 2) == 1 and v.values() == [1, 2, 9]
    assert v.write([5], 3) == 0 and v.remove(0, 1, 100) == 3 and len(v) == 0


def test_catalog(store):
    made = store.create("a", "u8").id
    assert store.get("a").id == made and store.names() == ["a"]
    with pytest.raises(errors.DuplicateVariableError):
        store.create("a")
    with pytest.raises(errors.NoSuchVariableError):
        store.get("b")
    for name in ("", "x" * 10_000):
        with pytest.raises(errors.InvalidArgumentError):
            store.create(name)
    store.delete("a")
    with pytest.raises(errors.NoSuchVariableError):
        store.delete("a")
    assert "NoSuchVariableError" in store.error()
    store.reset_errors()
    assert store.error() is None


def test_transactions(store):
    v = store.create("t", "i32")
    v.append([1, 2, 3])
    with store.begin() as tx:
        tx.insert("t", [0], 0)
        assert tx.variable("t").values() == [0, 1, 2, 3] and v.values() == [1, 2, 3]
    assert v.values() == [0, 1, 2, 3]
    with pytest.raises(errors.DuplicateCommitError):
        tx.commit()
    with pytest.raises(KeyError), store.begin() as tx:
        tx.remove("t", 0, 1, 2)
        raise KeyError
    assert v.values() == [0, 1, 2, 3]
    with store.begin() as tx:
        tx.remove("t", 0, 1, 1)
        point = tx.savepoint()
        tx.remove("t", 0, 1, 3)
        tx.rollback(point)
    assert v.values() == [1, 2, 3]
    a, b = store.begin(), store.begin()
    a.insert("t", [7])
    b.insert("t", [8])
    a.commit()
    with pytest.raises(errors.ConflictError):
        b.commit()
    assert v.values() == [1, 2, 3, 7]


def test_crash_before_publishing_leaves_nothing(store, spark):
    v = store.create("c", "i32")
    v.append([1, 2])
    tx = store.begin()
    tx.insert("c", [3])  # written, never published
    again = Store(spark, store.path)
    assert again.get("c").values() == [1, 2]
    assert len(again.vacuum()) == 1 and again.get("c").values() == [1, 2] and again.validate("c") == 2


def test_compaction_and_history(store):
    v = store.create("h", "i32")
    for i in range(5):
        v.append([i])
    before = max(store.versions())
    assert store.describe("h").count() == 5 and store.compact("h") == 1 and v.values() == list(range(5))
    v.remove(0, 1, 4)
    assert [r.elem for r in store.at(before).read("h").orderBy("pos").collect()] == list(range(5))
    assert store.history()[-1][1].startswith("remove h")


def test_types_are_kept_and_checked(store):
    v = store.create("s", "struct { id u32, e enum { A, B }, m [2][2] i16, z cf64, u union { p i8, q f64 } }")
    row = {"id": 7, "e": "B", "m": [[1, 2], [3, 4]], "z": 1 - 2j, "u": {"p": -3}}
    v.append([row])
    got = v.values()[0]
    assert got.id == 7 and got.e == "B" and got.m == [[1, 2], [3, 4]] and got.z.im == -2.0 and (got.u._tag, got.u.p, got.u.q) == ("p", -3, None)
    assert v.read(accessor="m[1:2]").collect()[0].elem == [[3, 4]]
    assert v.size() == len(v.to_bytes())
    for bad in (row | {"id": -1}, row | {"e": "C"}, row | {"m": [[1, 2]]}, row | {"u": {"p": 1, "q": 2.0}}):
        with pytest.raises(errors.SequenceError):
            v.append([bad])
    wide = store.spark.createDataFrame([(0, 300)], "pos long, elem long")
    with pytest.raises(Exception, match="out of the range"):
        store.create("b", "u8").append(wide)
    assert len(store.get("b")) == 0


def test_bytes(spark, tmp_path):
    with ByteStore(spark, str(tmp_path / "bytes")) as b:
        b.create("x")
        raw = list(range(23))
        assert b.insert("x", bytes(raw), 0) == 23 and b.fsize("x") == 23
        assert list(b.read("x", 3, 1, 2)) == [1, 2, 3, 7, 8, 9, 13, 14, 15, 19, 20, 21]
        assert b.read("x", 4, 21) == b"" and b.read("x", 4, 1, 2, 0) == b""
        assert b.write("x", bytes([99] * 7), 3, 0, 2) == 2
        assert list(b.read("x", n=12)) == [99, 99, 99, 3, 4, 5, 99, 99, 99, 9, 10, 11]
        assert list(b.remove("x", 2, 1, 3, take=True)) == [99, 99, 99, 99, 13, 14, 19, 20] and b.fsize("x") == 15
        tx = b.begin()
        b.insert("x", b"ab", 0, tx=tx)
        assert b.fsize("x") == 15 and b.fsize("x", tx) == 17
        b.commit(tx)
        assert b.read("x", n=2) == b"ab"


def test_language_on_a_store(store):
    done = execute(store, "create v i32; insert v 0 3; nonsense; read v 0:3:2; insert w 0 1; take v 0:1; read v; remove v; read v;", {"v": [5, 6, 7, 8]})
    assert [d.error is not None for d in done] == [False, False, True, False, True, False, False, False, False]
    assert [[r.elem for r in d.value.orderBy("pos").collect()] for d in (done[3], done[6], done[8])] == [[5, 7], [6, 7], []]


def test_writes_through_accessors(store):
    v = store.create("n", "struct { id u32, packets [3] struct { payload [4] i16, crc u32 }, u union { a i64, b [2] f32 } }")
    packet = lambda k: {"payload": [k, k + 1, k + 2, k + 3], "crc": k}
    one = lambda i: {"id": i, "packets": [packet(10 * i + k) for k in range(3)], "u": {"a": i} if i % 2 else {"b": [float(i), 0.0]}}
    v.append([one(i) for i in range(6)])
    want = [r.elem.asDict(recursive=True) for r in v[:].orderBy("pos").collect()]

    def check(accessor, data, offset, stride, put):
        v.write(data, offset, stride, accessor=accessor)
        for i, x in enumerate(data):
            put(want[offset + i * stride], x)
        assert [r.elem.asDict(recursive=True) for r in v[:].orderBy("pos").collect()] == want, accessor

    check("id", [70, 71], 1, 2, lambda e, x: e.update(id=x))
    check("packets[1:].crc", [[8, 9], [6, 5]], 0, 3, lambda e, x: [e["packets"][1 + k].update(crc=y) for k, y in enumerate(x)])
    # as many as are given; and ranges inside of ranges
    check("packets[0:3:2].payload[1:4:2]", [[[1, 2], [3, 4]], [[5, 6]]], 2, 1, lambda e, x: [e["packets"][2 * k]["payload"].__setitem__(slice(1, 4, 2), y) for k, y in enumerate(x)])
    check("u.a", [5, 6], 4, 1, lambda e, x: e.update(u={"_tag": "a", "a": x, "b": None}))
    # part of a variant is written only where that is set
    v.write([[1.5], [2.5]], 2, 1, accessor="u.b[1:]")
    want[2]["u"]["b"][1] = 1.5
    assert [r.elem.asDict(recursive=True) for r in v[:].orderBy("pos").collect()] == want
    (done,) = execute(store, "write n.packets[0:1].crc 0:2;", {"n": [[1], [2]]})
    assert done.value == 2 and [r.elem.packets[0].crc for r in v[0:2].orderBy("pos").collect()] == [1, 2]
    with pytest.raises(Exception, match="out of the range"):
        v.write([-1], 0, accessor="id")


def test_names_of_repeated_fields(store):
    from seqwell.operators import accessors

    v = store.create("r", "struct { a_b i32, p struct { a_b i32, q struct { a_b i32 } } }")
    v.append([{"a_b": 1, "p": {"a_b": 2, "q": {"a_b": 3}}}])
    out = accessors.select(v[:], "a_b", "p.a_b", "p.q.a_b", "a_b")
    assert out.first().elem.asDict() == {"a_b": 1, "a_b_2": 2, "a_b_3": 3, "a_b_4": 1}


def test_files_of_a_table_are_apart_and_sources_checked(store):
    v = store.create("f", "i64")
    rows = store.spark.range(2000).selectExpr("(id * 7) % 2000 AS pos", "id AS elem").repartition(5)
    v.append(rows)
    file = store.begin()._pieces("f").pieces[0].file
    _, apart = store.begin()._checked("f", f"{store.path}/data/{file}")
    assert apart and v.values()[7] == 1 and len(store.root.names(f"data/{file.split('/')[0]}")) == 1
    for bad in ("id", "CASE WHEN id = 3 THEN 2 ELSE id END", "id + 1", "id - 1"):
        if bad != "id":
            with pytest.raises(errors.InvalidArgumentError):
                v.append(store.spark.range(70000).selectExpr(f"{bad} AS pos", "id AS elem"))
    assert len(v) == 2000


def test_many_versions_and_variables(store):
    for i in range(20):
        store.create(f"v{i}", "u8").append(bytes([i]))
    assert store.latest() == max(store.versions()) == 40 and int(store.manifests.read("noted")) == 32
    before = set(store.root.names("pieces"))
    store.get("v3").append(b"xy")
    assert len(set(store.root.names("pieces")) - before) == 1 and len(store.get("v3")) == 3 and store.get("v4").to_bytes() == b"\x04"
    store.vacuum()
    assert len(store.root.names("pieces")) == 20 and store.get("v3").to_bytes() == b"\x03xy"
