"""Edge rules of the column builders and operators on small hand-made rows with exact results."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A, joins as J, ordered as O


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_buckets(spark):
    want = {-0.01: "0.95-1.00", 0.0: "0.00-0.05", 0.05: "0.05-0.10", 0.15: "0.15-0.20", 0.3: "0.30-0.35", 0.35: "0.35-0.40", 0.6: "0.60-0.65", 0.85: "0.85-0.90", 1.0: "0.95-1.00", 1.2: "0.95-1.00"}
    got = {r.x: r.y for r in spark.createDataFrame([(k,) for k in want], "x double").select("x", S.bucket_label("x").alias("y")).collect()}
    assert got == want
    assert one(spark, S.bucket_index, 1.2, "double") is None and one(spark, S.bucket_index, 1.0, "double") == 19


def test_parsers(spark):
    assert one(spark, S.parse_outcome_prices, "['1', '0']") == (1.0, 0.0)
    assert one(spark, S.parse_outcome_prices, '["0","1"]') == (0.0, 1.0)
    for bad in ("['1']", "junk", None, "['a','b']"):
        assert one(spark, S.parse_outcome_prices, bad) is None
    assert one(spark, S.parse_slug_duration, "btc-updown-15m-123") == 900 and one(spark, S.parse_slug_duration, "other") is None
    assert one(spark, S.parse_barrier, "will-bitcoin-reach-100k-in-may") == ("reach", 100000.0)
    assert one(spark, S.parse_barrier, "xrp-dip-to-1pt6-by") == ("dip", 1.6)
    assert one(spark, S.parse_above_strike, "bitcoin-above-95-on-may-3") == ("bitcoin", 95.0)
    assert one(spark, S.parse_dated_ticker, "XXGAME-26APR25OKCPHX-PHX") == (dt.date(2026, 4, 25), "PHX", "OKC")
    assert one(spark, S.parse_matchup, "Lions vs. Bears (final)") == ["Lions", "Bears"] and one(spark, S.parse_matchup, "Will Lions win on May 3?") == ["Lions"]
    assert one(spark, lambda c: S.tokenize(c, ["the"]), "The Big (old) bad-wolf of") == ["bad", "big", "wolf"]
    assert one(spark, S.parse_timestamp_multi, "2026-04-20 22:45:00+00") is not None and one(spark, S.parse_timestamp_multi, "nope") is None


def test_numbers(spark):
    for n in (0, 2**63, 2**64, 2**64 + 2**20):
        assert abs(one(spark, lambda c: S.decode_uint(c, 1.0), bytearray(n.to_bytes(32, "big")), "binary") - n) <= n * 1e-12
    assert one(spark, lambda c: S.decode_uint(c), None, "binary") == 0.0
    assert one(spark, S.normalize_epoch, 1_700_000_000_000.0, "double") == 1_700_000_000.0
    assert abs(one(spark, S.normal_cdf, 1.0, "double") - 0.8413447) < 1e-6
    assert one(spark, lambda c: S.digital_fair_value(c, F.lit(5.0), F.lit(0.0)), 6.0, "double") == 1.0
    row = spark.createDataFrame([(1.0, 0.5, 10), (0.5, 0.5, 0)], "rate double, mid double, n int")
    assert [round(r[0], 4) for r in row.where("n > 0").select(S.z_wald("rate", "mid", "n")).collect()] == [3.1623]


def test_book(spark):
    df = spark.createDataFrame([([(0.4, 10.0), (0.35, 0.0), (0.5, 2.0)],), ([],)], "asks array<struct<price:double,size:double>>")
    got = df.select(S.best_ask("asks").alias("b"), *[c.alias(n) for c, n in zip(S.capture_below("asks", 0.45), ("cost", "profit"))]).collect()
    assert got[0][0] == 0.4 and got[0][1] == 4.0 and abs(got[0][2] - 6.0) < 1e-9 and got[1][0] is None and got[1][1] == 0.0


def test_asof_edges(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    series = spark.createDataFrame([("a", t(0), 1, 0), ("a", t(10), 2, 1), ("a", t(10), 3, 2)], "k string, ts timestamp, v int, id int")
    probes = spark.createDataFrame([("a", t(-1), 1), ("a", t(2), 2), ("a", t(3), 3), ("a", t(10), 4), ("b", t(5), 5)], "k string, ts timestamp, p int")
    got = {r.p: r.v for r in J.asof_backward(probes, series, "k", "ts", "v", 2_000_000, "id").collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3, 5: None}


def test_runs_and_gini(spark):
    g = spark.createDataFrame([("e", i, v) for i, v in enumerate([1, 1, 5, None, 1, 1, 1])], "k string, i int, v int")
    assert sorted((r.start, r.end, r.n_rows) for r in O.threshold_runs(g, "k", "i", "v", 2).collect()) == [(0, 1, 2), (4, 6, 3)]
    w = spark.createDataFrame([(i, 7) for i in range(10)], "w int, x int")
    r = A.concentration(w, "w", "x").first()
    assert r.gini == 0.0 and r.top10 == 1.0 and not r.diffuse


def test_token_date(spark):
    d = dt.date(2026, 4, 1)
    a = spark.createDataFrame([(1, ["lions"], ["bears"], d), (2, ["cats"], ["dogs"], d)], "id int, home array<string>, away array<string>, day date")
    b = spark.createDataFrame([(9, ["bears", "x"], ["lions"], d + dt.timedelta(1)), (8, ["cats"], ["dogs"], d + dt.timedelta(2))], "id int, home array<string>, away array<string>, day date")
    assert [(r.a_id, r.b_id, r.same) for r in J.token_date(a, b).collect()] == [(1, 9, False)]
