"""Queries over whole tables reach the rows that the subset queries of the same operators leave out."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def run(spark, name):
    return entry.queries()[name](spark, str(DATA))


def test_joins_take_all_rows(spark):
    got = run(spark, "join_token_overlap")
    assert "rank" in got.columns
    part = spark.read.parquet(f"{DATA}/part.parquet")
    assert got.join(part.where("p_size between 6 and 47"), "p_partkey").limit(1).count() == 1
    every, some, few = (run(spark, f"join_keyword_match{x}").select("news_id", "market_id", "hits").cache() for x in ("", "_whole", "_share"))
    assert every.count() > some.count() > few.count() and few.exceptAll(some).count() == some.exceptAll(every).count() == 0
    assert every.agg(F.max("hits")).first()[0] > 6


def test_other_queries_take_all_rows(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    assert run(spark, "join_match_news_ts").agg(F.sum("n")).first()[0] == events.count()
    assert run(spark, "join_asof_backward").count() == events.where("event_type = 'purchase'").count()
    assert run(spark, "upsert_coalesce").count() == orders.select("o_custkey").distinct().count()
    got = [(r.yes is None, -(r.yes or 0), -r.volume, r.market_id) for r in run(spark, "sort_multi").collect()]
    assert len(got) == orders.count() > 100 and got == sorted(got)
