"""Views that bind the test tables to the library's concepts, in Spark and, word for word, in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

MARKET = "v_market AS (SELECT o_orderkey AS market_id, o_custkey AS event_id, CAST(o_orderdate AS TIMESTAMP) AS end_ts, o_totalprice AS volume, o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS yes FROM orders)"
TRADE = "v_trade AS (SELECT l_orderkey AS market_id, CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 AS price_milli, CAST(l_quantity AS BIGINT) AS size, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_suppkey AS wallet, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS outcome_index, l_linenumber AS line FROM lineitem)"
TICK = "v_tick AS (SELECT event_type AS asset, CAST(ts AS TIMESTAMP) AS ts, CAST(round(value * 100) AS BIGINT) AS cents, user_id AS actor, event_id AS id FROM events)"
LEG = "v_leg AS (SELECT user_id AS event, event_type AS leg, CAST(ts AS TIMESTAMP) AS ts, CAST(round(value * 2000) AS BIGINT) AS price_micro, event_id AS id FROM events)"


class Tables:
    """The tables of one folder and the views bound to them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def market(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey AS market_id", "o_custkey AS event_id", "CAST(o_orderdate AS TIMESTAMP) AS end_ts", "o_totalprice AS volume", "o_orderpriority AS category", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS yes")

    @cached_property
    def trade(self) -> DataFrame:
        return self.table("lineitem").selectExpr("l_orderkey AS market_id", "CAST(l_shipdate AS TIMESTAMP) AS ts", "CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 AS price_milli", "CAST(l_quantity AS BIGINT) AS size", "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents", "l_suppkey AS wallet", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS outcome_index", "l_linenumber AS line")

    @cached_property
    def tick(self) -> DataFrame:
        return self.table("events").selectExpr("event_type AS asset", "CAST(ts AS TIMESTAMP) AS ts", "CAST(round(value * 100) AS BIGINT) AS cents", "user_id AS actor", "event_id AS id")

    @cached_property
    def leg(self) -> DataFrame:
        return self.table("events").selectExpr("user_id AS event", "event_type AS leg", "CAST(ts AS TIMESTAMP) AS ts", "CAST(round(value * 2000) AS BIGINT) AS price_micro", "event_id AS id")


def sql(*views: str, body: str) -> str:
    return ("WITH " + ", ".join(views) + " " if views else "") + body
