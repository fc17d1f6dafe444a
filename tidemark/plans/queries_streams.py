"""The monitors as real streams: the events as landed files, run to their end. A heartbeat, one row of a later time
and of keys of its own, moves the watermark past all others, so that every window, episode and silence comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import books as B
from tidemark.plans.bindings import MARKET, TICK, TRADE, Tables
from tidemark.plans.queries import DAY, KEYWORDS, q
from tidemark.plans.queries_parsing import EVENTS, PER_ASSET, folder, per_asset
from tidemark.sources import files
from tidemark.streaming import monitors as M, run as R, stateful as K

CUT = 1_705_363_200_000_000  # 2024-01-16, where the episodes' stream is started anew


def event_stream(t: Tables, heartbeat: bool = True) -> DataFrame:
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    kind = t.events.select(*columns).schema
    s = t.spark.readStream.schema(kind).parquet(f"{t.folder}/events.parquet*")
    if heartbeat:
        at = folder(t)
        beat = t.spark.range(1).selectExpr("CAST(-1 AS BIGINT) AS event_id", "TIMESTAMP '2100-01-01 00:00:00' AS ts", "-1 AS user_id", "'heartbeat' AS event_type", "0 AS value")
        beat.select(*[F.col(f.name).cast(f.dataType) for f in kind]).write.parquet(at)
        s = s.unionByName(t.spark.readStream.schema(kind).parquet(at))
    return s.selectExpr("event_type AS asset", "CAST(ts AS TIMESTAMP) AS ts", "CAST(round(value * 100) AS BIGINT) AS cents", "user_id AS actor", "event_id AS id")


def through(t: Tables, stream: DataFrame, keyed: bool = False) -> DataFrame:
    """What a stream has written once all that has landed is read; ``keyed``: it has map state or timers."""
    return R.run_to_end(stream, folder(t), keyed)[0]


q("poll_feed_source", TICK, body=PER_ASSET)(lambda t: per_asset(through(t, event_stream(t, heartbeat=False))))


def appended(t: Tables) -> DataFrame:
    at = folder(t)
    s = event_stream(t, heartbeat=False).select("id", "asset", F.col("cents").cast("double").alias("cents"))
    files.append_jsonl(s, f"{at}/out", f"{at}/checkpoint", available_now=True).awaitTermination()
    return files.scan_jsonl(t.spark, f"{at}/out", EVENTS, ["cents"])


q("sink_append_jsonl", TICK, body=PER_ASSET)(lambda t: per_asset(appended(t)))

q("stream_dedupe", TICK, body="SELECT DISTINCT actor, asset FROM v_tick")(
    lambda t: through(t, M.dedupe(event_stream(t, heartbeat=False), ["actor", "asset"], delay="400 days").select("actor", "asset")))

q("stream_flag_on_entry", TICK, body="""
SELECT actor, id FROM (SELECT actor, id, cents >= 5000 AS now, lag(cents >= 5000) OVER (PARTITION BY actor ORDER BY ts, id) AS before FROM v_tick)
WHERE now AND NOT coalesce(before, false)
""")(lambda t: through(t, M.flag_on_entry(event_stream(t, heartbeat=False), "actor", "cents", 5000)).select("actor", "id"))

q("stream_resolution_lag", TICK, body="""
SELECT market_id, end_us, lag_s, CASE WHEN lag_s <= 900000 THEN 'RESOLVED' ELSE 'LATE' END AS status
FROM (SELECT actor AS market_id, 1704412800000000 AS end_us, (min(epoch_us(ts)) - 1704412800000000) / 1e6 AS lag_s
      FROM v_tick WHERE cents >= 5000 AND epoch_us(ts) >= 1704412800000000 GROUP BY actor)
UNION ALL
SELECT actor, 1704412800000000, NULL, 'UNRESOLVED' FROM v_tick
GROUP BY actor HAVING count(*) FILTER (WHERE cents >= 5000 AND epoch_us(ts) >= 1704412800000000) = 0
""")(lambda t: through(t, M.resolution_lag(event_stream(t).select(
    F.col("actor").alias("market_id"), "ts", "id", F.timestamp_micros(F.lit(1704412800000000)).alias("end_ts"), (F.col("cents") >= 5000).alias("resolved")), 900_000))
    .where("market_id >= 0"))

# -- windows -----------------------------------------------------------------------------------------------------------
q("stream_tumbling_moves", TICK, body="""
SELECT asset, epoch_us(ts) // 600000000 * 600000000 AS start_us, last(cents ORDER BY ts, id) - first(cents ORDER BY ts, id) AS delta, count(*) AS n
FROM v_tick GROUP BY ALL
""")(lambda t: through(t, M.tumbling_moves(event_stream(t), "asset", "cents", "id")).select("asset", F.unix_micros("start").alias("start_us"), "delta", "n"))

q("stream_feed_health", TICK, body="""
SELECT asset, epoch_us(ts) // 10800000000 * 10800000000 AS start_us, count(*) AS items, epoch_us(max(ts)) AS latest_us FROM v_tick GROUP BY ALL
""")(lambda t: through(t, M.feed_health(event_stream(t), "asset")).select("asset", F.unix_micros("start").alias("start_us"), "items", F.unix_micros("latest").alias("latest_us")))

q("stream_quote_presence", TICK, body="""
SELECT asset, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) AS n,
       round(avg(CASE WHEN abs((b + a) / 2 - 100) <= 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS presence
FROM (SELECT *, cents / 100 - 1 AS b, cents / 100 + 1 AS a FROM v_tick) GROUP BY ALL
""")(lambda t: through(t, M.quote_presence(event_stream(t).withColumns({"bid": F.col("cents") / 100 - 1, "ask": F.col("cents") / 100 + 1}), "asset", 100.0, 50.0))
    .select("asset", F.unix_micros("start").alias("start_us"), "n", "presence"))

q("stream_scan_log", TICK, "l AS (SELECT actor, epoch_us(ts) // 3600000000 AS scan, last(cents ORDER BY ts, id) AS cents FROM v_tick GROUP BY ALL)", body="""
SELECT actor, count(*) AS scans, min(cents) AS least, round(sum(cents) / count(*), 6) AS mean, max(cents) AS most,
       min(scan) * 3600000000 AS first, max(scan) * 3600000000 AS last FROM l GROUP BY actor
""")(lambda t: B.scan_evolution(through(t, B.scan_log(event_stream(t), "actor", "cents", 60)), "actor", "cents"))

q("stream_adaptive_window", MARKET, TRADE, body=f"""
SELECT phase, count(*) AS n FROM (SELECT CASE WHEN l <= 0 THEN 'past' WHEN l <= {90 * DAY} THEN 'final' ELSE 'normal' END AS phase
FROM (SELECT (epoch_us(m.end_ts) - epoch_us(t.ts)) / 1e6 AS l FROM v_trade t JOIN v_market m USING (market_id))) GROUP BY phase
""")(lambda t: M.adaptive_window(t.trade.join(t.market, "market_id"), 90 * DAY).groupBy("phase").agg(F.count("*").alias("n")))

# -- joins -------------------------------------------------------------------------------------------------------------
def enriched(t: Tables) -> DataFrame:
    quotes = event_stream(t).where("asset <> 'purchase'").select("id", "actor", "ts")
    spots = event_stream(t).where("asset IN ('purchase', 'heartbeat')").select("actor", F.col("ts").alias("spot_ts"), F.col("cents").alias("spot"))
    return through(t, M.spot_enrich(quotes, spots, "actor", "6 hours")).select("id", F.unix_micros("spot_ts").alias("spot_us"), "spot").where("id >= 0")


q("stream_spot_enrich", TICK, body="""
SELECT q.id, epoch_us(max(s.ts)) AS spot_us, last(s.cents ORDER BY s.ts, s.cents) AS spot FROM (SELECT * FROM v_tick WHERE asset <> 'purchase') q
LEFT JOIN v_tick s ON s.asset = 'purchase' AND q.actor = s.actor AND epoch_us(s.ts) BETWEEN epoch_us(q.ts) - 6 * 3600000000 AND epoch_us(q.ts) GROUP BY q.id
""")(enriched)


def matched(t: Tables) -> DataFrame:
    """All documents as news, against the benchmark's words, at two hits."""
    at = folder(t)
    kind = t.documents.select("doc_id", "text").schema
    s = t.spark.readStream.schema(kind).parquet(f"{t.folder}/documents.parquet*")
    news = s.select(F.col("doc_id").alias("news_id"), F.split(F.lower("text"), " ").alias("tokens"), F.col("text").alias("title"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") % 3600).alias("ts"))
    markets = t.benchmark.select(F.col("item_id").alias("market_id"), F.split(F.lower("text"), " ").alias("keywords"))
    with R.state_partitions(t.spark):
        query = M.news_match(news, markets, f"{at}/out", f"{at}/checkpoint", available_now=True)
    query.awaitTermination()
    return t.spark.read.parquet(f"{at}/out").select("news_id", "market_id", "hits")


q("stream_news_match", *KEYWORDS.split(",\ns")[:1], """
m AS (SELECT news_id, market_id, count(*) AS hits FROM n JOIN k USING (w) GROUP BY news_id, market_id HAVING count(*) >= 2)""", body="""
SELECT doc_id AS news_id, market_id, coalesce(hits, 0) AS hits FROM documents LEFT JOIN m ON m.news_id = doc_id
""")(matched)

# -- keyed state -------------------------------------------------------------------------------------------------------
q("stream_book_state", TICK, """
s AS (SELECT CAST(actor AS VARCHAR) AS asset, cents % 1000 AS price, id % 4 > 0 AS there, id,
             row_number() OVER (PARTITION BY actor ORDER BY ts, id) AS rn FROM v_tick WHERE id % 5 <> 0)""", """
l AS (SELECT *, lead(rn) OVER (PARTITION BY asset, price ORDER BY rn) AS until FROM s)""", """
b AS (SELECT s.asset, s.id, s.rn, min(l.price) AS best FROM s
      LEFT JOIN l ON l.asset = s.asset AND l.there AND l.rn <= s.rn AND (l.until IS NULL OR l.until > s.rn) GROUP BY ALL)""", body="""
SELECT asset, id, best FROM (SELECT *, lag(best) OVER (PARTITION BY asset ORDER BY rn) AS before FROM b) WHERE best IS DISTINCT FROM before
""")(lambda t: through(t, K.book_state(event_stream(t, heartbeat=False).selectExpr(
    "CAST(actor AS STRING) AS asset", "CASE WHEN id % 5 = 0 THEN 'BUY' ELSE 'SELL' END AS side", "cents % 1000 AS price", "CAST(id % 4 AS DOUBLE) AS size", "ts", "id")), keyed=True)
    .select("asset", "id", "best"))

LEGS, BELOW, PHANTOM, GAP = ("click", "error", "purchase", "signup", "view"), 900, 300, 43_200
GAP_US, MINUTE_MS = GAP * 1_000_000, 60_000


def episodes(t: Tables) -> DataFrame:
    """Two runs: the second begins at CUT without the first one's state, whose open episodes are orphans then."""
    ticks = lambda s: s.selectExpr("actor AS event", "asset AS leg", "cents % 400 AS price", "ts", "id")
    cut = F.unix_micros("ts") < CUT
    first = through(t, K.arb_episodes(ticks(event_stream(t, heartbeat=False).where(cut)), len(LEGS), BELOW, PHANTOM, GAP, run="first"), keyed=True)
    second = through(t, K.arb_episodes(ticks(event_stream(t).where(~cut)), len(LEGS), BELOW, PHANTOM, GAP, run="second"), keyed=True)
    return K.settled_episodes(first.unionByName(second), [("first", 0), ("second", CUT)]).withColumn("mean", F.round("mean", 6))


_last = ", ".join(f"last_value(CASE WHEN asset = '{x}' THEN cents % 400 END IGNORE NULLS) OVER w AS p{k}" for k, x in enumerate(LEGS))
_sum = " + ".join(f"p{k}" for k in range(len(LEGS)))
q("stream_arb_episodes", TICK, f"""
c AS (SELECT CASE WHEN epoch_us(ts) < {CUT} THEN 'first' ELSE 'second' END AS run, actor AS event, epoch_us(ts) AS us, id, {_last} FROM v_tick
      WINDOW w AS (PARTITION BY epoch_us(ts) < {CUT}, actor ORDER BY ts, id))""", f"""
s AS (SELECT run, event, us, id, {_sum} AS total, {_sum} < {BELOW} AS low FROM c WHERE {_sum} IS NOT NULL)""", f"""
m AS (SELECT *, lag(low) OVER w AS was, lag(us) OVER w AS us0, lead(us) OVER w AS us1, lead(low) OVER w AS next FROM s
      WINDOW w AS (PARTITION BY run, event ORDER BY us, id))""", f"""
g AS (SELECT *, sum(CASE WHEN low AND (NOT coalesce(was, false) OR us - us0 > {GAP_US}) THEN 1 ELSE 0 END) OVER (PARTITION BY run, event ORDER BY us, id) AS k FROM m)""", """
e AS (SELECT run, event, min(us) AS start_us, max(us) AS last_us, min(total) AS least, round(avg(total), 6) AS mean, count(*) AS updates,
             last(us1 ORDER BY us, id) AS us1 FROM g WHERE low GROUP BY run, event, k)""", f"""
f AS (SELECT *, CASE WHEN us1 - last_us <= {GAP_US} THEN 'closed'
                     WHEN us1 IS NOT NULL OR run = 'second'
                       OR (last_us + {GAP_US}) // 1000 + 1 <= (SELECT max(epoch_us(ts)) // 1000 - {MINUTE_MS} FROM v_tick WHERE epoch_us(ts) < {CUT}) THEN 'silence' ELSE 'orphan' END AS status FROM e)""", body=f"""
SELECT run, event, start_us, CASE status WHEN 'closed' THEN us1 WHEN 'silence' THEN last_us + {GAP_US} ELSE {CUT} END AS end_us, status, least, mean, updates,
       least < {PHANTOM} AS phantom, CASE status WHEN 'closed' THEN us1 - start_us WHEN 'silence' THEN last_us + {GAP_US} - start_us END AS duration_us FROM f
""")(episodes)

q("stream_feed_silence", TICK, body="""
SELECT actor, us AS last_us, us + 3 * 86400000000 AS silent_us, items FROM (SELECT actor, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER w AS us1, row_number() OVER w AS items
FROM v_tick WINDOW w AS (PARTITION BY actor ORDER BY ts, id)) WHERE us1 IS NULL OR us1 - us > 3 * 86400000000
""")(lambda t: through(t, K.feed_silence_warnings(event_stream(t).select("actor", "ts", "id"), "actor", 3 * DAY), keyed=True).where("actor >= 0"))
