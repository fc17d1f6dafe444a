"""Streams through files against their batch twins."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import Window, functions as F

from tidemark.streaming import monitors as M, run as R, stateful as K


def drain(spark, tmp_path, df, build, parts=1):
    src = str(tmp_path / "in")
    df.repartition(parts).write.parquet(src)
    stream = build(spark.readStream.schema(df.schema).parquet(src))
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def ticks(spark):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i % 3, t0 + dt.timedelta(seconds=37 * i), (i * 7919) % 100, i) for i in range(300)], "actor long, ts timestamp, cents long, id long").cache()


def test_flag_on_entry(spark, tmp_path, ticks):
    got = {(r.actor, r.id) for r in drain(spark, tmp_path, ticks, lambda s: M.flag_on_entry(s, "actor", "cents", 50)).collect()}
    before = F.lag(F.col("cents") >= 50).over(Window.partitionBy("actor").orderBy("ts", "id"))
    want = {(r.actor, r.id) for r in ticks.withColumn("b", before).where((F.col("cents") >= 50) & ~F.coalesce("b", F.lit(False))).collect()}
    assert got == want and want


def test_dedupe(spark, tmp_path, ticks):
    twice = ticks.union(ticks)
    assert drain(spark, tmp_path, twice, lambda s: M.dedupe(s, ["id"])).count() == 300


def rows_of(spark, folder, schema, rows, parts=1):
    spark.createDataFrame(rows, schema).coalesce(parts).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)
TICK = "event long, leg string, price long, ts timestamp, id long"


def slow_book(rows):
    """Best asks by rebuilding the whole ladder for each row."""
    out, levels, best = [], {}, {}
    for asset, side, price, size, reset, _, i in sorted(rows, key=lambda r: (r[5], r[6])):
        if side != "SELL":
            continue
        book = levels.setdefault(asset, {})
        if reset:
            book.clear()
        book[price] = size
        now = min((p for p, z in book.items() if z > 0), default=None)
        if now != best.get(asset):
            best[asset] = now
            out.append((asset, i, now))
    return sorted(out)


def test_book_state(spark, tmp_path):
    """In three runs from one checkpoint; a snapshot replaces the book."""
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["SELL", "SELL", "SELL", "BUY"]), rng.randrange(1, 12) * 50, float(rng.choice([0, 0, 1, 2])), rng.random() < 0.05, at(i // 2), i) for i in range(300)]
    schema = "asset string, side string, price long, size double, reset boolean, ts timestamp, id long"
    for part in (rows[:100], rows[100:180], rows[180:]):
        stream = rows_of(spark, str(tmp_path / "in"), schema, part)
        got, late = R.run_to_end(K.book_state(stream), str(tmp_path / "out"))
        assert late == 0
    assert sorted((r.asset, r.id, r.best) for r in got.collect()) == slow_book(rows)


def slow_episodes(rows, legs, below, gap, watermark):
    out = []
    for event in {r[0] for r in rows}:
        book, live = {}, None

        def end(us, status):
            out.append((event, live[0], us, status, min(live[2]), len(live[2])))

        for _, leg, price, ts, _ in sorted((r for r in rows if r[0] == event), key=lambda r: (r[3], r[4])):
            us = round((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
            book[leg] = price
            if live and us - live[1] > gap * 1e6:
                end(live[1] + int(gap * 1e6), "silence")
                live = None
            if len(book) < legs:
                continue
            total = sum(book.values())
            if total < below:
                live = (live[0] if live else us, us, (live[2] if live else []) + [total])
            elif live:
                end(us, "closed")
                live = None
        if live and live[1] + gap * 1e6 < watermark:
            end(live[1] + int(gap * 1e6), "silence")
        elif live:
            end(None, "open")
    return sorted(out, key=str)


def test_arb_episodes(spark, tmp_path):
    """Gaps within and between micro-batches, an episode that only a timer closes, one that stays open."""
    rng = random.Random(5)
    rows, s = [], 0.0
    for i in range(400):
        s += rng.choice([0.2, 0.5, 1.0, 6.0])
        rows.append((i % 3, rng.choice("xyz"), rng.randrange(100, 600), at(s), i))
    rows += [(7, "x", 10, at(s + 100), 400), (7, "y", 10, at(s + 100), 401), (7, "z", 10, at(s + 101), 402), (8, "x", 1, at(s + 190), 403)]
    for part in (rows[:150], rows[150:151], rows[151:]):
        stream = rows_of(spark, str(tmp_path / "in"), TICK, part)
        log, late = R.run_to_end(K.arb_episodes(stream, 3, 1000, 50, 3.0, "0 seconds", "a"), str(tmp_path / "out"))
        assert late == 0
    final = K.settled_episodes(log, [("a", 0)])
    got = sorted(((r.event, r.start_us, r.end_us, r.status, r.least, r.updates) for r in final.collect()), key=str)
    want = slow_episodes(rows, 3, 1000, 3.0, round((at(s + 190) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6))
    assert got == want and {r[3] for r in want} == {"closed", "silence"}
    assert [r.phantom for r in final.where("event = 7").collect()] == [True]


def test_orphans(spark):
    log = spark.createDataFrame([(1, 10, None, "open", 5, 5.0, 1, False, "a"), (1, 10, None, "open", 4, 4.5, 2, False, "a"), (2, 11, 15, "closed", 3, 3.0, 1, True, "a"), (2, 11, None, "open", 3, 3.0, 1, True, "a"), (1, 30, None, "open", 2, 2.0, 1, True, "b")],
                                "event long, " + K.EPISODE.replace("bigint", "long"))
    got = {(r.run, r.event): (r.end_us, r.status, r.updates, r.duration_us) for r in K.settled_episodes(log, [("a", 0), ("b", 25)]).collect()}
    assert got == {("a", 1): (25, "orphan", 2, None), ("a", 2): (15, "closed", 1, 4), ("b", 1): (None, "open", 1, None)}


def test_silence_without_input(spark, tmp_path):
    """By the wall clock: the warning comes though nothing more lands."""
    stream = rows_of(spark, str(tmp_path / "in"), "feed string, ts timestamp, id long", [("f", at(0), 1), ("f", at(1), 2), ("g", at(1), 3)])
    warned = K.feed_silence_warnings(stream, "feed", 2.0, clock="processing")
    with R.keyed_state(spark):
        query = warned.writeStream.format("memory").queryName("silence").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("silence").count() >= 2:
                break
        time.sleep(3)  # once only
        assert sorted((r.feed, r.items) for r in spark.table("silence").collect()) == [("f", 2), ("g", 1)]
    finally:
        query.stop()


def test_late_rows_are_counted(spark, tmp_path):
    listener = R.LateRows()
    spark.streams.addListener(listener)
    try:
        for part in ([(1, "x", 5, at(10_000), 1), (1, "x", 5, at(10_001), 2)], [(1, "x", 7, at(0), 3), (2, "y", 7, at(5), 4), (1, "x", 9, at(10_100), 5)]):
            stream = rows_of(spark, str(tmp_path / "in"), TICK, part)
            moves, late = R.run_to_end(M.tumbling_moves(stream, "event", "price", "id", 1, "1 minute"), str(tmp_path / "moves"))
            _, late_state = R.run_to_end(K.arb_episodes(stream, 1, 6, 1), str(tmp_path / "state"))
        assert late == 2 and late_state == 2
        assert {r.event for r in moves.collect()} <= {1}
        for _ in range(50):
            if sum(listener.late.values()) >= 4:
                break
            time.sleep(0.2)
        assert sum(listener.late.values()) == 4
    finally:
        spark.streams.removeListener(listener)


def test_news_once_across_restarts(spark, tmp_path):
    schema = "news_id long, tokens array<string>, title string, ts timestamp"
    news = [(1, ["a", "b"], "a b", at(0)), (2, ["a"], "a", at(1)), (3, ["c", "d", "big"], "C big deal D", at(2)), (4, [], "", at(3)), (5, None, None, at(4)), (1, ["a", "b"], "a b", at(5)), (6, ["b", "a", "c"], "b a c", at(6))]
    markets = spark.createDataFrame([("m1", ["a", "b"]), ("m2", ["c", "big deal", "zz"]), ("m3", []), ("m4", None)], "market_id string, keywords array<string>")
    for part in (news[:3], news[3:]):
        stream = rows_of(spark, str(tmp_path / "in"), schema, part)
        M.news_match(stream, markets, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = sorted((r.news_id, r.market_id, r.hits) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "m1", 2), (2, None, 0), (3, "m2", 2), (4, None, 0), (5, None, 0), (6, "m1", 2)]


def test_spot_enrich_state_is_bounded(spark, tmp_path):
    """Each quote once, null without a spot; what the watermark has passed leaves the state."""
    q_schema, s_schema = "id long, actor long, ts timestamp", "actor long, spot_ts timestamp, spot long"
    for k in range(3):
        base = 10_000 * k
        quotes = rows_of(spark, str(tmp_path / "q"), q_schema, [(base + i, i % 2, at(base + i)) for i in range(50)])
        spots = rows_of(spark, str(tmp_path / "s"), s_schema, [(0, at(base + i), base + i) for i in range(0, 50, 7)])
        stream = M.spot_enrich(quotes, spots, "actor", "5 seconds", "1 second").writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        with R.keyed_state(spark):
            query = stream.trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    assert sum(int(op["numRowsTotal"]) for op in query.lastProgress["stateOperators"]) < 250
    got = {r.id: r.spot for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {10_000 * k + i: (10_000 * k + i // 7 * 7 if i % 2 == 0 and i % 7 <= 5 else None) for k in range(2) for i in range(50)}
    assert {i: x for i, x in got.items() if i < 20_000} == want


def test_resolution_lag(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, at(5), 1, at(10), False), (1, at(40), 2, at(10), True), (2, at(6), 3, at(10), False)], "market_id long, ts timestamp, id long, end_ts timestamp, resolved boolean")
    r = {x.market_id: (x.lag_s, x.status) for x in drain(spark, tmp_path, df, M.resolution_lag).collect()}
    assert r[1] == (30.0, "RESOLVED")


def state_calls(spark, folder, stream):
    """How often a stream reads or writes an entry of its state, over all its micro-batches."""
    with R.keyed_state(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return sum(int(op["customMetrics"][c]) for p in query.recentProgress for op in p["stateOperators"] for c in ("rocksdbGetCount", "rocksdbPutCount"))


def test_state_calls_of_episodes_follow_keys(spark, tmp_path):
    """Ten times the rows of two events in a micro-batch call the state as often."""
    rows = [(i % 2, "xyz"[i // 2 % 3], i * 7919 % 600, at(i), i) for i in range(400)]
    few, many = (state_calls(spark, tmp_path / f"o{n}", K.arb_episodes(rows_of(spark, str(tmp_path / f"i{n}"), TICK, rows[:n]), 3, 700, 50, 3.0)) for n in (40, 400))
    assert many <= few + 8


def test_state_calls_of_books_follow_keys(spark, tmp_path):
    schema = "asset string, side string, price long, size double, ts timestamp, id long"
    rows = [("ab"[i % 2], "SELL", i * 7919 % 600, float(i % 3), at(i), i) for i in range(400)]
    few, many = (state_calls(spark, tmp_path / f"o{n}", K.book_state(rows_of(spark, str(tmp_path / f"i{n}"), schema, rows[:n]))) for n in (40, 400))
    assert many <= few + 8


def test_book_of_several_blocks(spark, tmp_path):
    """Levels far apart, in two runs: blocks empty, come back, and the best moves between them."""
    rng = random.Random(8)
    rows = [("a", "SELL", rng.choice([-1500, 10, 900, 999, 1000, 2500, 7000]), float(rng.choice([0, 0, 1])), rng.random() < 0.02, at(i), i) for i in range(160)]
    schema = "asset string, side string, price long, size double, reset boolean, ts timestamp, id long"
    for part in (rows[:70], rows[70:]):
        got, _ = R.run_to_end(K.book_state(rows_of(spark, str(tmp_path / "in"), schema, part)), str(tmp_path / "out"))
    assert sorted((r.asset, r.id, r.best) for r in got.collect()) == slow_book(rows)
