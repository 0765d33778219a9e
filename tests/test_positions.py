"""Closed forms against the list model: golden vectors, edges and random cases."""

import random

import model
import pytest

from seqwell.errors import CorruptError, InvalidArgumentError
from seqwell.operators import positions as p


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, elem int")


def listed(df):
    rows = sorted((r.pos, r.elem) for r in df.collect())
    assert [a for a, _ in rows] == list(range(len(rows)))
    return [b for _, b in rows]


GOLDEN = [(1, 3, 3), (0, 1, 10), (7, 1, 9), (2, 4, 9), (9, 5, 2), (10, 1, 3), (12, 2, 1), (0, 20, 3), (0, 2, 0), (3, 2, None)]


@pytest.mark.parametrize("pattern", GOLDEN)
def test_patterns(spark, pattern):
    base, source = list(range(10)), list(range(90, 100))
    seq = frame(spark, base)
    assert listed(p.read(seq, *pattern)) == model.read(base, *pattern)
    assert listed(p.remove(seq, *pattern)) == model.remove(base, *pattern)
    assert listed(p.write(seq, frame(spark, source), *pattern)) == model.write(base, source, *pattern)
    taken, left = p.take(seq, *pattern, size=10)
    assert (listed(taken), listed(left)) == (model.read(base, *pattern), model.remove(base, *pattern))
    assert p.touched(10, *pattern) == model.touched(10, *pattern)


@pytest.mark.parametrize("offset,n", [(0, 2), (4, 2), (10, 2), (25, 2), (5, 0)])
def test_insert(spark, offset, n):
    assert listed(p.insert(frame(spark, range(10)), frame(spark, [90, 91][:n]), offset)) == model.insert(list(range(10)), [90, 91][:n], offset)


def test_random_sequences_of_operators(spark):
    rng = random.Random(5)
    for _ in range(4):
        base = [rng.randrange(1000) for _ in range(rng.randrange(1, 40))]
        seq = frame(spark, base)
        for _ in range(3):
            o, k, n = rng.randrange(0, 45), rng.randrange(1, 6), rng.randrange(0, 20)
            source = [rng.randrange(1000) for _ in range(rng.randrange(0, 8))]
            kind = rng.choice(["insert", "write", "remove"])
            if kind == "insert":
                base, seq = model.insert(base, source, o), p.insert(seq, frame(spark, source), o)
            elif kind == "write":
                base, seq = model.write(base, source, o, k, n), p.write(seq, frame(spark, source), o, k, n)
            else:
                base, seq = model.remove(base, o, k, n), p.remove(seq, o, k, n)
        assert listed(seq) == base


def test_empty_sequence(spark):
    empty = frame(spark, [])
    assert listed(p.read(empty, 0, 1, 5)) == listed(p.write(empty, frame(spark, [1]), 0)) == listed(p.remove(empty, 0, 1, 3)) == []
    assert listed(p.append(empty, frame(spark, [7, 8]))) == [7, 8]


def test_slices():
    assert p.slice_pattern(10, slice(None)) == (0, 1, 10)
    assert p.slice_pattern(10, slice(1, 9, 3)) == (1, 3, 3)
    assert p.slice_pattern(10, slice(5, 2)) == (5, 1, 0)
    with pytest.raises(TypeError):
        p.slice_pattern(10, 3)
    with pytest.raises(InvalidArgumentError):
        p.slice_pattern(10, slice(-1, None))
    with pytest.raises(InvalidArgumentError):
        p.slice_pattern(10, slice(0, 5, 0))


def test_arguments(spark):
    for bad in ((-1, 1, 1), (0, 0, 1), (0, 1, -1)):
        with pytest.raises(InvalidArgumentError):
            p.touched(10, *bad)
    with pytest.raises(CorruptError):
        p.validate(spark.createDataFrame([(0, 1), (2, 1)], "pos long, elem int"))


def test_plans_move_nothing(spark, tmp_path):
    frame(spark, range(100)).write.parquet(str(tmp_path / "t"))
    seq = spark.read.parquet(str(tmp_path / "t"))
    for out in (p.read(seq, 10, 3, 5), p.remove(seq, 10, 3, 5), p.insert(seq, seq, 10, size=100, n=100)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan
    assert "GreaterThanOrEqual(pos,10)" in p.read(seq, 10, 3, 5)._jdf.queryExecution().executedPlan().toString()
