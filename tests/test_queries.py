"""Every registered query of the engine against its SQL, at the smallest scale."""

import itertools
import math
import os

import duckdb
import pytest

from seqwell.functions import scalar
from seqwell.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(x):
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, list):
        return tuple(plain(v) for v in x)
    return "nan" if x != x else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, DATA)
    with duckdb.connect() as db:
        for table in ("events", "orders", "lineitem", "embeddings", "nation"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        want = db.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(out.columns)
        rows = sorted(repr(tuple(plain(x) for x in r)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in out.collect()) == rows


@pytest.mark.parametrize("name", ["expr_intdiv", "expr_pymod"])
def test_query_on_odd_quantities(spark, tmp_path, name):
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 7.25, -7.25, 1e300, -1e-20]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    rows = [(i, part, 1, line, quantity, 0.0, "A", "F") for i, (quantity, part, line) in enumerate(itertools.product(odd, (None, -1, 50, 57), (None, 1, 2, -1, -2)))]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = db.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        rows = sorted(repr(tuple(plain(x) for x in r)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in out.collect()) == rows


def test_divide_by_zero_keeps_nulls(spark):
    df = spark.createDataFrame([(x,) for x in (None, math.nan, 0.0, 2.5, -2.5)], "x double")
    out = [plain(r[0]) for r in df.select((scalar.value(df, "x") / scalar.lit(0.0)).column).collect()]
    assert out == [None, "nan", "nan", math.inf, -math.inf]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
