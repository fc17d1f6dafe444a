"""Every registered query with an SQL twin against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidemark.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return "null"
        try:
            return repr(float(x))
        except (TypeError, ValueError):
            return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    text = entry.oracle_sql().get(name)
    if text is None:
        assert len(got)
        return
    want = duck.execute(text).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["anchor_vwap", "join_asof_backward", "carry_forward_basket", "flag_moves", "settled_pnl", "join_keyword_match"])
def test_plans_have_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "PythonUDF" not in plan
