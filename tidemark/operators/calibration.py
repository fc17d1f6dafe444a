"""Calibration of a price against a resolved outcome: anchors, buckets, tables, z-scores, strata, slices.

Prices are in thousandths (price_milli) where sums must not depend on order; ratios are rounded at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import bucket_label, pearson, rnd, z_null, z_wald
from tidemark.operators.selection import slices


def join_time_window(trades: DataFrame, markets: DataFrame, before_s: int, after_s: int, offset_s: int = 0) -> DataFrame:
    """Trades of each market within [anchor - before, anchor + after]; anchor = end_ts - offset. An equi join on the
    market with the interval as a residual, so hot markets are split by adaptive execution."""
    m = markets.withColumn("anchor", F.expr(f"end_ts - make_dt_interval(0, 0, 0, {offset_s})"))
    age = F.unix_micros("ts") - F.unix_micros("anchor")
    return trades.join(m, "market_id").where(age.between(-before_s * 1_000_000, after_s * 1_000_000))


#: Thousandths weighted by size as a price of five digits, rounded half up in integers; a plain mean if sizes sum to 0.
WEIGHTED = "CASE WHEN sum(size) > 0 THEN ((200 * sum(yes_milli * size) + sum(size)) div (2 * sum(size))) / 100000 ELSE ((200 * sum(yes_milli) + count(*)) div (2 * count(*))) / 100000 END"


def yes_equivalent(trades: DataFrame) -> DataFrame:
    """Adds yes_milli: the price, or 1 minus it for outcome 1; rows outside (0, 1] go."""
    t = trades.withColumn("yes_milli", F.expr("CASE WHEN outcome_index = 1 THEN 1000 - price_milli ELSE price_milli END"))
    return t.where("yes_milli > 0 AND yes_milli <= 1000")


def anchor_vwap(trades: DataFrame, markets: DataFrame, before_s: int, after_s: int, offset_s: int = 0, min_trades: int = 3, keys: tuple[str, ...] = ("market_id",)) -> DataFrame:
    """Per market: size-weighted YES price in the window (plain mean if sizes sum to 0), counts, USD sums and the upper
    median USD; markets under ``min_trades`` trades drop out."""
    t = yes_equivalent(join_time_window(trades, markets, before_s, after_s, offset_s))
    w = Window.partitionBy(*keys)
    t = t.select(*keys, "yes_milli", "size", "cents", F.row_number().over(w.orderBy("cents")).alias("rn"), F.count("*").over(w).alias("n"))
    return t.groupBy(*keys).agg(
        F.expr(WEIGHTED).alias("price"),
        F.count("*").alias("n_trades"), F.round(F.sum("cents") / 100, 2).alias("total_usd"), F.round(F.max("cents") / 100, 2).alias("max_usd"),
        F.round(F.max(F.expr("CASE WHEN rn = n div 2 + 1 THEN cents END")) / 100, 2).alias("median_usd"),
    ).where(F.col("n_trades") >= min_trades)


def preclose_vwap(trades: DataFrame, markets: DataFrame, before_s: int) -> DataFrame:
    """VWAP, last price and count over the window that ends at the close."""
    t = yes_equivalent(join_time_window(trades, markets, before_s, 0))
    return t.groupBy("market_id").agg(F.expr(WEIGHTED).alias("vwap"), F.max_by("yes_milli", F.struct("ts", "line", "yes_milli")).alias("last_milli"), F.count("*").alias("n_trades"))


def anchor_curve(trades: DataFrame, markets: DataFrame, offsets: dict[str, int], window_s: int) -> DataFrame:
    """One row per anchor and market: the anchors are a fixed list, exploded onto the markets before one join."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("anchor_name"), F.lit(v).alias("offset")) for k, v in offsets.items()]))
    m = markets.select("market_id", "end_ts", named.alias("a")).select("market_id", F.col("a.anchor_name").alias("anchor_name"), F.expr("end_ts - make_dt_interval(0, 0, 0, a.offset)").alias("end_ts"))
    t = yes_equivalent(join_time_window(trades, m, window_s, window_s))
    return t.groupBy("anchor_name", "market_id").agg(F.expr(WEIGHTED).alias("price"), F.count("*").alias("n_trades"))


def calibration_table(snapshots: DataFrame, strata: list[str] = (), min_n: int = 1, metrics: dict[str, Column] | None = None) -> DataFrame:
    """By stratum and 5-point bucket of ``price``: n, yes_rate, mean price, deviation, z. Further metrics by name."""
    s = snapshots.where("yes IS NOT NULL AND price IS NOT NULL").withColumn("bucket", bucket_label("price"))
    mid = F.expr("least(floor(round(price * 1000) / 50), 19) * 0.05D + 0.025D")
    t = s.withColumn("mid", mid).groupBy(*strata, "bucket").agg(
        F.count("*").alias("n"), F.avg(F.col("yes").cast("double")).alias("rate"), F.sum(F.expr("cast(round(price * 100000) as bigint)")).alias("p_sum"), F.max("mid").alias("mid"), *[c.alias(k) for k, c in (metrics or {}).items()]
    ).where(F.col("n") >= min_n)
    return t.select(*strata, "bucket", "n", rnd("rate").alias("yes_rate"), rnd(F.col("p_sum") / F.col("n") / 100000).alias("mean_price"), rnd(F.col("rate") - F.col("mid")).alias("deviation"), F.round(z_null("rate", "mid", "n"), 4).alias("z"), F.round(z_wald("rate", "mid", "n"), 4).alias("z_wald"), *(metrics or {}))


def all_strata(snapshots: DataFrame, strata: list[str]) -> DataFrame:
    """The calibration of every stratification at once, by grouping sets: one scan and one shuffle."""
    s = snapshots.where("yes IS NOT NULL AND price IS NOT NULL").select(*strata, "yes", bucket_label("price").alias("bucket"))
    t = s.groupingSets([[F.col(c), F.col("bucket")] for c in strata] + [[F.col("bucket")]], *[F.col(c) for c in strata], F.col("bucket"))
    return t.agg(F.count("*").alias("n"), rnd(F.avg(F.col("yes").cast("double"))).alias("yes_rate"), F.grouping_id().alias("gid"))


def critical_bucket(snapshots: DataFrame, strata: DataFrame, key: str, bucket: str, min_n: int = 20) -> DataFrame:
    """One bucket per stratum; strata without it have n = 0; verdict tells those under ``min_n``."""
    t = calibration_table(snapshots, [key]).where(F.col("bucket") == bucket)
    j = strata.join(t, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select(key, "n", "yes_rate", "deviation", F.when(F.col("n") < min_n, "insufficient").otherwise("ok").alias("verdict"))


def zone_stats(snapshots: DataFrame, zones: dict[str, tuple[float, float]], reference: float | None = None) -> DataFrame:
    """Bands [lo, hi): n, mean price, yes rate, deviation against the mean or a fixed reference."""
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("zone"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in zones.items()]))
    s = snapshots.where("yes IS NOT NULL").select("price", "yes", band.alias("b")).where("price >= b.lo AND price < b.hi")
    mean = F.sum(F.expr("cast(round(price * 100000) as bigint)")) / F.count("*") / 100000
    rate = F.avg(F.col("yes").cast("double"))
    return s.groupBy(F.col("b.zone").alias("zone")).agg(F.count("*").alias("n"), rnd(mean).alias("mean_price"), rnd(rate).alias("yes_rate"), rnd(rate - (mean if reference is None else F.lit(reference))).alias("deviation"))


def price_outcome_corr(snapshots: DataFrame, key: str) -> DataFrame:
    return snapshots.where("yes IS NOT NULL").groupBy(key).agg(F.count("*").alias("n"), F.round(pearson("price", "yes"), 4).alias("corr"))


def category_summary(snapshots: DataFrame, key: str, min_n: int = 30) -> DataFrame:
    rate, mean = F.avg(F.col("yes").cast("double")), F.sum(F.expr("cast(round(price * 100000) as bigint)")) / F.count("*") / 100000
    return snapshots.where("yes IS NOT NULL").groupBy(key).agg(F.count("*").alias("n"), rnd(rate).alias("yes_rate"), rnd(mean).alias("mean_price"), rnd(rate - mean).alias("edge"), F.round(F.sum(F.expr("cast(round(volume * 100) as bigint)")) / 100, 2).alias("volume")).where(F.col("n") >= min_n)


def top_actionable(table: DataFrame, min_n: int = 30, k: int = 30) -> DataFrame:
    return table.where(F.col("n") >= min_n).orderBy(F.desc(F.abs("deviation")), "bucket").limit(k)


def equal_count_slices(snapshots: DataFrame, order: list[str], k: int, keys: list[str], parts: int = 1000) -> DataFrame:
    """Chronological slices per key with edges round-half-even(i * n / k); rows that aren't ordered are left out."""
    return slices(snapshots, keys, order, [lambda n, i=i: F.bround(n * i / k, 0) for i in range(1, k)], "slice", parts)


def trend_direction(sliced: DataFrame, keys: list[str], flat: float = 0.05) -> DataFrame:
    """Last slice's rate minus the first's: strengthening, decaying or stable within ``flat``."""
    d = sliced.groupBy(*keys, "slice").agg(F.avg(F.col("yes").cast("double")).alias("rate"))
    t = d.groupBy(*keys).agg(F.round(F.max_by("rate", "slice") - F.min_by("rate", "slice"), 6).alias("change"))
    return t.withColumn("trend", F.expr(f"CASE WHEN change > {flat} THEN 'strengthening' WHEN change < -{flat} THEN 'decaying' ELSE 'stable' END"))


def forward_vs_hist(now: DataFrame, history: DataFrame) -> DataFrame:
    """Calibration of new snapshots beside a historical table: delta of the rates per bucket."""
    a = calibration_table(now).select("bucket", "n", "yes_rate")
    b = calibration_table(history).select("bucket", F.col("yes_rate").alias("hist_rate"))
    return a.join(b, "bucket", "left").withColumn("delta", F.round(F.col("yes_rate") - F.col("hist_rate"), 6))


def merge_weighted_parts(parts: DataFrame, key: str) -> DataFrame:
    """Partial aggregates of a key merged: n-weighted mean, summed n, latest last value."""
    return parts.groupBy(key).agg(F.round(F.sum(F.col("mean_milli") * F.col("n")) / F.sum("n"), 4).alias("mean_milli"), F.sum("n").alias("n"), F.max_by("last_milli", F.struct("last_ts", "part", "last_milli")).alias("last_milli"))
