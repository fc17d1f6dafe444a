"""Structured Streaming forms of the monitors. Each declares its watermark; rows later than that are dropped and counted
(``run.late_rows``, ``run.LateRows``). Windows come out once the watermark has passed their end: a source that falls silent
needs a heartbeat row for its last ones. Books, episodes and silent feeds are in ``stateful``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.joins import keyword_match


def dedupe(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_moves(stream: DataFrame, key: str, value: str, tie: str, minutes: int = 10, delay: str = "30 minutes") -> DataFrame:
    """First, last, difference and rows per key and window, once the watermark has passed its end."""
    s = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    o = F.struct("ts", tie)
    g = s.groupBy(key, F.window("ts", f"{minutes} minutes").alias("w")).agg(F.min_by(value, o).alias("first"), F.max_by(value, o).alias("last"), F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), "first", "last", (F.col("last") - F.col("first")).alias("delta"), "n")


def quote_presence(stream: DataFrame, key: str, fair: float, width: float, delay: str = "2 hours") -> DataFrame:
    """Hourly share of quotes within +-width of fair value and their mean spread; a missing side counts as absent."""
    s = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    near = (F.abs((F.col("bid") + F.col("ask")) / 2 - fair) <= width) & F.col("bid").isNotNull() & F.col("ask").isNotNull()
    return s.groupBy(key, F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(near, F.lit(False)).cast("double")), 6).alias("presence"), F.round(F.avg(F.col("ask") - F.col("bid")), 6).alias("spread")).select(key, F.col("w.start").alias("start"), "n", "presence", "spread")


def feed_health(stream: DataFrame, feed: str, hours: int = 3, delay: str = "3 hours") -> DataFrame:
    """Items per feed and window of ``hours``; a window without items doesn't appear, so its feed is silent there."""
    s = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    return s.groupBy(feed, F.window("ts", f"{hours} hours").alias("w")).agg(F.count("*").alias("items"), F.max("ts").alias("latest")).select(feed, F.col("w.start").alias("start"), "items", "latest")


def news_match(stream: DataFrame, markets: DataFrame, out: str, checkpoint: str, least: int = 2, delay: str = "1 day", available_now: bool = False) -> StreamingQuery:
    """Each news item matched once: a row per market of which it has ``least`` keywords, or one row without a market.

    What an item matches depends on the static markets alone, so nothing waits for a watermark: a micro-batch is joined as
    a batch (on the word, all joins merged) and written to a folder of its own number. A batch that a
    restart repeats replaces its folder, so every item comes out exactly once; items sent again within ``delay`` are
    dropped. stream: news_id, tokens, title, ts; markets: market_id, keywords."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select("news_id", "tokens", "title").persist()
        try:
            hits = keyword_match(batch, markets, least)
            every = batch.select("news_id").hint("merge").join(hits.hint("merge"), "news_id", "left")
            every.select("news_id", "market_id", F.coalesce("hits", F.lit(0)).alias("hits")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["news_id"])
    writer = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def spot_enrich(quotes: DataFrame, spots: DataFrame, key: str, within: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """The latest spot of the preceding interval for each quote, null if there is none: a stream-stream outer join within the
    interval, whose state goes as both watermarks move on, and a maximum per quote. quotes: id, key, ts; spots: key,
    spot_ts, spot (the greater spot of equal times)."""
    q = quotes.withWatermark("ts", delay).alias("q")
    s = spots.withWatermark("spot_ts", delay).alias("s")
    j = q.join(s, F.expr(f"q.{key} = s.{key} AND spot_ts <= ts AND spot_ts >= ts - INTERVAL {within}"), "left_outer")
    latest = F.max_by("s.spot", F.struct("s.spot_ts", "s.spot"))
    return j.groupBy(F.window("q.ts", "1 second"), "q.id").agg(F.max("s.spot_ts").alias("spot_ts"), latest.alias("spot")).select("id", "spot_ts", "spot")


def adaptive_window(ticks: DataFrame, final_s: int = 120):
    """normal, final (the last ``final_s`` seconds) or past, from end_ts and ts."""
    left = (F.unix_micros("end_ts") - F.unix_micros("ts")) / 1e6
    return ticks.withColumn("phase", F.when(left <= 0, "past").when(left <= final_s, "final").otherwise("normal"))


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    got = list(frames)
    return pd.concat(got).sort_values(["ts", "id"]) if got else pd.DataFrame()


def flag_on_entry(stream: DataFrame, key: str, value: str, least: float, delay: str = "1 hour") -> DataFrame:
    """One row when a key's value enters [least, inf); leaving re-arms. Rows of a micro-batch are ordered by (ts, id)."""

    def step(keys, frames, state: GroupState):
        inside = state.get[0] if state.exists else False
        rows = []
        for r in _ordered(frames).itertuples():
            now = getattr(r, value) >= least
            if now and not inside:
                rows.append((keys[0], r.ts, r.id))
            inside = now
        state.update((bool(inside),))
        yield pd.DataFrame(rows, columns=[key, "ts", "id"])

    kind = dict(stream.dtypes)[key]
    return stream.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, id long", "inside boolean", "append", GroupStateTimeout.NoTimeout)


def resolution_lag(ticks: DataFrame, limit_s: int = 900, delay: str = "1 minute") -> DataFrame:
    """The lag of the first resolved tick after a market's end, or UNRESOLVED once event time passes end + limit.
    ticks: market_id, ts, id, end_ts, resolved."""

    def step(keys, frames, state: GroupState):
        if state.hasTimedOut:
            end = state.get[0]
            state.remove()
            yield pd.DataFrame({"market_id": [keys[0]], "end_us": [end], "lag_s": [None], "status": ["UNRESOLVED"]}).astype({"lag_s": "float64"})
            return
        end, done = state.get if state.exists else (None, False)
        rows = []
        for r in _ordered(frames).itertuples():
            us, end = int(pd.Timestamp(r.ts).value // 1000), int(pd.Timestamp(r.end_ts).value // 1000)
            if not done and r.resolved and us >= end:
                done = True
                rows.append((keys[0], end, (us - end) / 1e6, "RESOLVED" if us - end <= limit_s * 1_000_000 else "LATE"))
        state.update((end, done))
        if not done and end is not None:
            state.setTimeoutTimestamp(max(end // 1000 + limit_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["market_id", "end_us", "lag_s", "status"])

    return ticks.withWatermark("ts", delay).groupBy("market_id").applyInPandasWithState(step, "market_id long, end_us long, lag_s double, status string", "end long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
