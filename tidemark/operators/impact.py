"""Moves against a news-free baseline, with the lead of the news, the health of the feeds that matter, and what else moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.books import relevant_feeds
from tidemark.operators.joins import asof_backward, first_in_range


def feed_silence_at(windows: DataFrame, items: DataFrame, feeds: DataFrame) -> DataFrame:
    """(feed, window, silent_us): how long each feed had sent nothing when a window began; null if it never had. windows: window,
    ts (one row per window); items: feed, ts, id; feeds: feed (a configuration table: one row per feed)."""
    names = feeds.select("feed").distinct().agg(F.collect_list("feed").alias("names"))
    grid = windows.withColumn("names", names.scalar()).select("window", F.explode("names").alias("feed"), "ts")
    series = items.select("feed", "ts", F.unix_micros("ts").alias("last_us"), "id")
    seen = asof_backward(grid, series, "feed", "ts", "last_us", None, "id")
    return seen.select("feed", "window", (F.unix_micros("ts") - F.col("last_us")).alias("silent_us"))


def flag_moves(windows: DataFrame, sigma: DataFrame, key: str, *, themes: DataFrame, feeds: DataFrame, items: DataFrame, news: DataFrame, ends: DataFrame, volume: str, least_z: float = 3.0, quiet_us: int = 1_800_000_000, margin_us: int = 3_600_000_000, least_volume: float = 500, hard_us: int = 10_800_000_000, soft_us: int = 3_600_000_000, before_us: int = 86_400_000_000, after_us: int = 600_000_000, least_co_z: float = 1.0) -> DataFrame:
    """Windows whose move is ``least_z`` sigmas or more: ``quiet_us`` after the key's first window or later, over ``margin_us`` before
    its end, with enough volume, and with every feed of the key's theme (or global ones) heard within ``hard_us`` before the
    window. A feed silent for over ``soft_us`` makes it of low confidence. ``lead_min``: minutes from the first news of the key
    (within the given span around the window's start) to that start; null without news. ``nearby``: other keys of the theme
    that moved by ``least_co_z`` sigmas in the same window. In order of lead (null last) and z, both falling.

    windows: key, window, ts (start), end_ts, delta, ``volume``; sigma: key, sigma; themes: key, grp; feeds: feed, themes; items: feed,
    ts, id; news: key, ts; ends: key, key_end."""
    j = windows.hint("merge").join(sigma.where("sigma is not null").select(key, "sigma").hint("merge"), key).hint("merge").join(themes.select(key, "grp").hint("merge"), key)
    j = j.withColumn("z", F.round(F.abs(F.col("delta")) / F.col("sigma"), 4))
    movers = j.groupBy("grp", "window").agg(F.count_if(F.col("z") >= least_co_z).alias("movers"))  # a window has one row per key
    started = windows.groupBy(key).agg(F.min(F.unix_micros("ts")).alias("first_us"))
    big = j.where(F.col("z") >= least_z).hint("merge").join(started.hint("merge"), key).hint("merge").join(ends.hint("merge"), key)
    big = big.where((F.unix_micros("ts") >= F.col("first_us") + quiet_us) & (F.unix_micros("end_ts") <= F.unix_micros("key_end") - margin_us) & (F.col(volume) >= least_volume))
    silence = feed_silence_at(windows.select("window", "ts").distinct(), items, feeds)
    groups = themes.select("grp").distinct()
    health = relevant_feeds(groups, feeds, "grp").hint("merge").join(silence.hint("merge"), "feed").groupBy("grp", "window").agg(
        F.bool_and(F.coalesce(F.col("silent_us") <= hard_us, F.lit(False))).alias("healthy"), F.bool_or(F.coalesce(F.col("silent_us") > soft_us, F.lit(True))).alias("low_confidence"))
    big = big.hint("merge").join(health.where("healthy").hint("merge"), ["grp", "window"]).hint("merge").join(movers.hint("merge"), ["grp", "window"])
    led = first_in_range(big.drop("first_us"), news, key, "ts", before_us, after_us)
    nearby = F.col("movers") - (F.col("z") >= least_co_z).cast("int")
    return led.select(key, "window", "z", "lead_min", "low_confidence", nearby.alias("nearby")).orderBy(F.desc_nulls_last("lead_min"), F.desc("z"), key, "window")
