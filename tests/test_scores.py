"""Gates, rules, deviations, moves, keyword counts and the relational source against plain Python."""

import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A, impact as I, joins as J, ordered as O, running as U
from tidemark.plans.queries_scores import SLUGS
from tidemark.sources import files

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def first_rule(slug):
    for k, (pattern, label, *excluded) in enumerate(S.SUBCATEGORIES):
        if re.search(pattern, slug) and not any(re.search(x, slug) for x in excluded):
            return k, label
    return None, "uncategorized"


def test_rules(spark):
    assert len(S.SUBCATEGORIES) >= 40 and len(S.blocks(S.SUBCATEGORIES)) < len(S.SUBCATEGORIES)
    hit = {first_rule(s)[0] for s in SLUGS}
    assert hit == {*range(len(S.SUBCATEGORIES)), None}  # every rule, and none
    for k, (pattern, _, *excluded) in enumerate(S.SUBCATEGORIES):
        for x in excluded:  # and every exclusion turns a slug away
            assert any(re.search(pattern, s) and re.search(x, s) for s in SLUGS), k
    rng = random.Random(1)
    mixed = SLUGS + [f"{a}-{b}" for a, b in (rng.sample(SLUGS, 2) for _ in range(300))] + ["LIONS-VS-BEARS"]
    df = spark.createDataFrame([(s,) for s in mixed] + [(None,)], "s string")
    got = [r[0] for r in df.select(S.subcategory("s")).collect()]
    assert got == [first_rule(s.lower())[1] for s in mixed] + ["uncategorized"]


def test_keywords(spark):
    table = [("a", ["x", "y"], ["1"]), ("b", ["x"], []), ("c", ["z"], ["1", "2"])]
    df = spark.createDataFrame([(t,) for t in ("x1", "y", "x", "z2", "z", "")], "t string")
    assert [r[0] for r in df.select(S.keywords(F.col("t"), table)).collect()] == ["a", "other", "b", "c", "other", "other"]


@pytest.mark.parametrize("bucket_s", [1, 100, 10**7])
def test_running(spark, bucket_s):
    rng = random.Random(bucket_s)
    events = [(rng.choice("ab"), at(rng.randrange(1000)), rng.randrange(-5, 6)) for _ in range(200)] + [(None, at(1), 9), ("a", None, 9)]
    probes = [(i, rng.choice(["a", "b", "c", None]), at(rng.randrange(-50, 1100))) for i in range(150)] + [(999, "a", None)]
    got = U.running(spark.createDataFrame(probes, "id long, k string, ts timestamp"), spark.createDataFrame(events, "k string, ts timestamp, x long"), ["k"], ["x"], "x", bucket_s * 1_000_000)
    want = {}
    for i, k, ts in probes:
        mine = sorted(((t, x) for key, t, x in events if key == k and t is not None and ts is not None and k is not None and t <= ts), key=lambda e: e[0])
        total, peak = 0, 0
        for j, (t, x) in enumerate(mine):
            total += x
            if j + 1 == len(mine) or mine[j + 1][0] > t:
                peak = max(peak, total)
        want[i] = (total, peak)
    assert {r.id: (r.x, r.x_peak) for r in got.collect()} == want


def test_gates(spark):
    rng = random.Random(7)
    cells = {"p": 0.5, "q": 0.9}
    positions = []
    for _ in range(300):
        start = rng.randrange(5000)
        positions.append((rng.choice("pq"), rng.randrange(12), rng.choice("YN"), rng.randrange(8), at(start), at(start + rng.randrange(1, 400)) if rng.random() < 0.95 else None, rng.randrange(-60, 58)))
    candidates = [(i, at(rng.randrange(6000)), rng.randrange(12), rng.choice("YN"), rng.randrange(8), rng.random()) for i in range(300)]
    pos = spark.createDataFrame(positions, "cell string, market long, side string, event long, opened timestamp, closed timestamp, pnl long")
    cand = spark.createDataFrame(candidates, "id long, ts timestamp, market long, side string, event long, ask double")

    def reason(c, cell, cap, peaked):
        _, ts, market, side, event, ask = c
        mine = [p for p in positions if p[0] == cell]
        held = [p for p in mine if p[4] <= ts and (p[5] is None or p[5] > ts)]
        closed = sorted((p[5], p[6]) for p in mine if p[5] is not None and p[5] <= ts)
        total, peak = 0, 0
        for j, (t, x) in enumerate(closed):
            total += x
            if j + 1 == len(closed) or closed[j + 1][0] > t:
                peak = max(peak, total)
        lost = (peak - total) / (400 + peak) if peaked else -total / 400
        if ask > cap:
            return "cap_too_tight"
        if any(p[1] == market and p[2] == side for p in held):
            return "already_open"
        if lost > 0.2:
            return "drawdown_breaker"
        if sum(p[3] == event for p in held) >= 2:
            return "event_concentration_cap"
        return "early_killed" if len(closed) >= 20 and total < 0 else None

    seen = set()
    for peaked in (False, True):
        got = {(r.id, r.cell): r.reason for r in U.gate_reasons(cand, pos, cells, 400.0, 2, 0.2, 20, peaked).collect()}
        want = {(c[0], cell): reason(c, cell, cap, peaked) for c in candidates for cell, cap in cells.items()}
        assert got == want
        seen |= set(want.values())
    assert seen == {"cap_too_tight", "already_open", "drawdown_breaker", "event_concentration_cap", "early_killed", None}


def test_move_scores(spark):
    rng = random.Random(3)
    series = [(i, rng.choice(["a", "a", "b"]), at(rng.randrange(4000)), rng.randrange(100)) for i in range(600)]
    probes = [(10_000 + i, rng.choice(["a", "b", "c"]), at(rng.randrange(-100, 4500))) for i in range(120)]
    got = {r.id: r for r in U.move_scores(spark.createDataFrame(probes, "id long, k string, ts timestamp"), spark.createDataFrame(series, "id long, k string, ts timestamp, v long"), "k", "v", "id", (30, 60, 300), 30, 200, (1.0, 2.5)).collect()}
    signals = set()
    for i, k, ts in probes:
        def last(t):
            seen = [(x[2], x[0], x[3]) for x in series if x[1] == k and x[2] <= t]
            return max(seen)[2] if seen else None

        before = last(ts - dt.timedelta(seconds=30))
        window = [x[3] for x in series if x[1] == k and ts - dt.timedelta(seconds=200) <= x[2] <= ts]
        sigma = statistics.stdev(window) if len(window) > 1 else None
        r = got[i]
        moves = [None if before is None or last(ts + dt.timedelta(seconds=h)) is None else last(ts + dt.timedelta(seconds=h)) - before for h in (30, 60, 300)]
        assert [r.before, r.move_30, r.move_60, r.move_300] == [before, *moves]
        assert (r.sigma is None) == (sigma is None) and (sigma is None or abs(r.sigma - sigma) < 1e-5)
        if sigma and moves[2] is not None:
            z = moves[2] / sigma
            assert abs(r.z - z) < 1e-3
            if min(abs(abs(z) - 1), abs(abs(z) - 2.5)) > 1e-3:
                assert r.signal == ("low" if abs(z) < 1 else "medium" if abs(z) < 2.5 else "high")
            signals.add(r.signal)
        else:
            assert r.z is None and r.signal is None
    assert signals == {"low", "medium", "high"}


def test_keyword_counts(spark):
    news = [(1, ["rate", "cut", "now"], "Rate cut now"), (2, ["rate"], "rate"), (3, ["big", "deal", "rate"], "Big deal, rate"), (4, None, None), (5, ["deal", "big", "rate"], "deal big rate")]
    markets = [("m", ["rate", "cut", "cut"]), ("n", ["big deal", "rate"]), ("o", []), ("p", None)]
    n, m = spark.createDataFrame(news, "news_id long, tokens array<string>, title string"), spark.createDataFrame(markets, "market_id string, keywords array<string>")
    assert sorted(tuple(r) for r in J.keyword_match(n, m, 2).collect()) == [(1, "m", 2), (3, "n", 2)]
    assert sorted(tuple(r) for r in J.keyword_match(n, m, 1).collect()) == sorted(tuple(r) for r in J.keyword_match(n, m, 1, 0.01).collect())


def test_flag_moves_health_and_lead(spark):
    w = spark.createDataFrame([(k, i, at(600 * i), at(600 * i + 600), 9 if i == 6 else 1, 600.0) for k in ("x", "y", "z") for i in range(20)], "key string, window long, ts timestamp, end_ts timestamp, delta long, volume double")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    flags = lambda items: {r.key: (r.window, r.lead_min, r.low_confidence, r.nearby) for r in I.flag_moves(
        w, frame([("x", 2.0), ("y", 2.0), ("z", 2.0)], "key string, sigma double"), "key", themes=frame([("x", "g"), ("y", "g"), ("z", "h")], "key string, grp string"),
        feeds=frame([("f", ["g"]), ("all", ["global"]), ("other", ["h"])], "feed string, themes array<string>"), items=frame(items, "feed string, ts timestamp, id long"),
        news=frame([("x", at(3000)), ("x", at(3300)), ("y", at(9000))], "key string, ts timestamp"), ends=frame([("x", at(90_000)), ("y", at(90_000)), ("z", at(90_000))], "key string, key_end timestamp"), volume="volume").collect()}
    heard = [("f", at(3500), 1), ("all", at(3500), 2)]
    assert flags(heard) == {"x": (6, 10.0, False, 1), "y": (6, None, False, 1)}  # z's own feed was never heard
    assert flags([*heard, ("other", at(3400), 3)])["z"] == (6, None, False, 0)
    assert flags([("f", at(-1000), 1), ("all", at(3500), 2)]) == {"x": (6, 10.0, True, 1), "y": (6, None, True, 1)}
    assert flags([("f", at(-9000), 1), ("all", at(3500), 2)]) == {}


def test_relational_in_ranges(spark, tmp_path):
    url = files.local_database(spark, f"file://{tmp_path}/db")
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"))
    files.land_table(df, url, "t", "name VARCHAR(8)")
    back = files.scan_table(spark, url, "t", "ID", (0, 1000), 4)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 1000
    few = back.where("v = 3 and name = 'n1'")
    assert "PushedFilters: [" in (plan := few._jdf.queryExecution().executedPlan().toString()) and "EqualTo" in plan or "= 3" in plan
    assert sorted(r[0] for r in few.select("id").collect()) == [i for i in range(1000) if i % 7 == 3 and i % 3 == 1]
    assert files.scan_table(spark, url, "t").count() == 1000


def test_tolerant_sources(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    assert files.scan_parts(spark, [f"{tmp_path}/a", f"{tmp_path}/none"], strict=False).count() == 3
    with pytest.raises(FileNotFoundError):
        files.scan_parts(spark, [f"{tmp_path}/none"], strict=False)
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    rows = files.scan_csv_mixed(spark, [f"{tmp_path}/x.csv"]).cache()
    assert rows.count() == 3 and rows.where("_corrupt is not null").count() == 2
    with pytest.raises(ValueError):
        files.json_report(spark.range(1), spark.range(20), "id", 10)
    assert files.json_report(spark.range(1).toDF("n"), spark.range(2), "id").first()[0] == '{"n":0,"cells":[{"id":0},{"id":1}]}'
    parts = {r.part: r.n for r in files.profile(spark.read.parquet(f"{tmp_path}/a")).collect()}
    assert parts[None] == 3 and sum(n for p, n in parts.items() if p) == 3


def test_momentum_from_a_price_of_zero(spark):
    prices = spark.createDataFrame([("a", at(0), 0, 1), ("a", at(15000), 7, 2), ("b", at(0), 0, 3)], "asset string, ts timestamp, cents long, id long")
    fills = spark.createDataFrame([(1, "a", at(15100), 1, 1), (2, "a", at(15100), -1, 2), (3, "b", at(15100), 1, 3), (4, "a", at(10), 1, 4)], "actor int, asset string, ts timestamp, side int, id long")
    got = {r.actor: (r.n, r.momentum_share, r.label) for r in A.entry_momentum(fills, prices, "actor", "asset", "cents").collect()}
    assert got == {1: (1, 1.0, "lucky"), 2: (1, 0.0, "structural"), 3: (1, 1.0, "lucky")}


@pytest.mark.parametrize("name", ["move_zscore", "join_first_in_range", "join_range_exclusion"])
def test_no_frame_is_summed_anew_for_each_row(spark, name):
    """A frame that ends with its partition but doesn't begin with it costs the square of the partition."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+), ([^)]+\)?)\)", plan)
    assert frames and all(lo.startswith("unboundedpreceding") or not hi.startswith("unboundedfollowing") for lo, hi in frames)


def test_keywords_of_a_common_word_are_dealt(spark):
    """A word that stands in every item and market is counted by many tasks."""
    news = spark.range(3000).selectExpr("id AS news_id", "array('the', concat('w', id % 7)) AS tokens", "'the' AS title")
    markets = spark.range(40).selectExpr("id AS market_id", "array('the', concat('w', id % 7)) AS keywords")
    got = J.keyword_match(news, markets, 2)
    assert got.count() == sum(i % 7 == j % 7 for i in range(3000) for j in range(40))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "shard" in plan and "RepartitionByExpression [news_id" in plan


def test_fees_are_joined_once(spark):
    """The passes over the fees of large bands read what one join has written."""
    import __spark_entry__ as entry

    plan = entry.queries()["realized_fee_bands"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "l_orderkey" not in plan


def test_gates_read_each_table_once_per_total(spark):
    """The gates' running totals follow one another; none is worked out again for the next. Events are read for the sums and the buckets."""
    pos = spark.range(9).selectExpr("'p' AS cell", "id AS market", "'Y' AS side", "id AS event", "timestamp_seconds(id) AS opened", "timestamp_seconds(id + 5) AS closed", "id AS pnl")
    cand = spark.range(9).selectExpr("id", "timestamp_seconds(id) AS ts", "id AS market", "'Y' AS side", "id AS event", "CAST(0.3 AS DOUBLE) AS ask")
    plan = U.gate_reasons(cand, pos, {"p": 0.5}, 400.0)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Range (") <= 10


def test_running_over_buckets_without_events(spark):
    """Probes in buckets that hold no event, before the first and after the last one, and with null keys."""
    events = spark.createDataFrame([("a", at(100), 5), ("a", at(5000), -7), ("b", at(100), 1), (None, at(1), 9)], "k string, ts timestamp, x long")
    probes = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(2500)), (3, "a", at(9000)), (4, "b", at(9000)), (5, "c", at(9000)), (6, None, at(9000)), (7, "a", None)], "id long, k string, ts timestamp")
    want = {1: (0, 0), 2: (5, 5), 3: (-2, 5), 4: (1, 1), 5: (0, 0), 6: (0, 0), 7: (0, 0)}
    for source in (None, probes.select("k", "ts")):
        got = U.running(probes, events, ["k"], ["x"], "x", 1_000_000_000, source)
        assert {r.id: (r.x, r.x_peak) for r in got.collect()} == want


def test_dealt_rows_are_bounded(spark):
    rows = spark.range(3000).selectExpr("id % 1000 AS g", "id % 7 AS p", "id AS tie", "id % 2 AS o")
    assert O.dealt(rows, "g", 100).rdd.getNumPartitions() == 30 and O.dealt(rows, "g").rdd.getNumPartitions() == 4
    stats = O.rank_stats(O.dealt(rows, "g", 100), "g", "p", "tie", "o", 3)
    assert {r["rank"]: r.n for r in stats.collect()} == {1: 1000, 2: 1000, 3: 1000}
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in plan and plan.split("== Initial Plan ==")[-1].count("hashpartitioning(g") == 1
