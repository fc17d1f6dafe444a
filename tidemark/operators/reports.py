"""Reports over positions, entries, baskets, venues, depth, strategies and participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import rnd
from tidemark.operators.aggregates import share


def extremes(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of the largest and of the smallest value with their rank (ties by ``key``): two ordered limits."""

    def side(name: str, first: Column) -> DataFrame:
        few = df.orderBy(first, key).limit(k).withColumn("side", F.lit(name))
        return few.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(first, key)))  # k rows

    return side("top", F.desc(value)).unionByName(side("bottom", F.asc(value)))


def pnl_rollup(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Per wallet: cash flow in cents, tokens held, profit realized in resolved markets (a token of the winner pays 100
    cents), and the value of what is held in open ones at the market's last price (thousandths)."""
    side = F.when(F.col("outcome_index") == 1, -1).otherwise(1)
    p = fills.groupBy("wallet", "market_id").agg(F.sum(side * F.col("size")).alias("net"), F.sum(-side * F.col("cents")).alias("cash"), F.sum("size").alias("held"))
    last = fills.groupBy("market_id").agg(F.max_by("price_milli", F.struct("ts", "line", "price_milli")).alias("last"))
    j = p.join(last, "market_id").join(markets.select("market_id", "yes"), "market_id")
    realized = F.when(F.col("yes").isNotNull(), F.col("cash") + F.col("net") * F.col("yes") * 100).otherwise(0)
    value = F.when(F.col("yes").isNull(), F.col("net") * F.col("last")).otherwise(0)
    return j.groupBy("wallet").agg(F.sum("cash").alias("cash"), F.sum("held").alias("held"), F.sum(realized).alias("realized"), F.sum(value).alias("open_value_milli"))


def backtest_edge(entries: DataFrame, fees_bps: list[int], crash: float = 0.5) -> DataFrame:
    """entries: price_milli, yes, cents. Buy YES: gross edge = outcome - price (mean, median, weighted by notional), net of
    p (1 - p) fees on a fee grid, hit rate, and the share of entries that lost more than ``crash``."""
    e = entries.withColumn("fee_bps", F.explode(F.array(*[F.lit(x) for x in fees_bps])))
    n, gross = F.count("*"), F.col("yes") * 1000 - F.col("price_milli")
    fee = F.col("fee_bps") * F.col("price_milli") * (1000 - F.col("price_milli"))
    return e.groupBy("fee_bps").agg(
        n.alias("n"),
        F.round(F.sum(gross) / n / 1000, 6).alias("gross"),
        F.round(F.percentile(gross, F.lit(0.5)) / 1000, 6).alias("median_gross"),
        F.round(F.sum(gross * F.col("cents")).cast("double") / F.sum("cents") / 1000, 6).alias("weighted_gross"),
        F.round((F.sum(gross) / 1000 - F.sum(fee) / 1e10) / n, 6).alias("net"),
        share(F.sum("yes"), n).alias("hit_rate"),
        share(F.count_if(gross < -1000 * crash), n).alias("crash_rate"),
    )


def basket_edge(legs: DataFrame, event: str, now: str, least: int = 2) -> DataFrame:
    """Baskets of live legs (ask, bid, depth, end_ts): sums of asks and bids, edge in percent, sets that the thinnest leg
    allows, and the profit (null unless every leg has depth), by absolute edge. Events with fewer legs than ``least`` drop
    out, and so do legs past their end."""
    g = legs.where(F.col("end_ts") > F.lit(now).cast("timestamp")).groupBy(event)
    g = g.agg(F.count("*").alias("legs"), F.count("depth").alias("deep"), F.sum("ask").alias("asks_milli"), F.sum("bid").alias("bids_milli"), F.min("depth").alias("sets"))
    g = g.where(F.col("legs") >= least).withColumn("edge_pct", F.round((1 - F.col("asks_milli") / 1000) * 100, 4))
    profit = F.when(F.col("deep") == F.col("legs"), F.round(F.greatest(F.col("edge_pct"), F.lit(0.0)) / 100 * F.col("sets"), 4))
    return g.withColumn("profit", profit).drop("deep").orderBy(F.desc(F.abs("edge_pct")), event)


def venue_profile(hourly: DataFrame, key: str, thresholds: tuple[int, ...] = (10_000, 100_000, 1_000_000)) -> DataFrame:
    """hourly: key, bin, volume. Active hours, total, mean, quartiles and p90 of volume, and hours over thresholds."""
    q = F.percentile("volume", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)]))
    return hourly.groupBy(key).agg(
        F.count("*").alias("hours"),
        F.sum("volume").alias("total"),
        F.round(F.sum("volume") / F.count("*"), 4).alias("mean"),
        *[F.round(q[i], 4).alias(f"p{p}") for i, p in enumerate((25, 50, 75, 90))],
        *[F.count_if(F.col("volume") >= x).alias(f"over_{x}") for x in thresholds],
    )


def new_per_quarter(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Keys by the quarter in which they were first seen."""
    first = df.groupBy(key).agg(F.min(ts).alias("at"))
    return first.groupBy(F.concat(F.year("at"), F.lit("Q"), F.quarter("at")).alias("quarter")).agg(F.count("*").alias("listed"))


def capacity_table(volume: DataFrame, spread: DataFrame, wallets: DataFrame, keys: list[str], fee_bps: float, quote: float) -> DataFrame:
    """volume, spread_bps and wallets by ``keys``: net bps = half the spread less the fee; size = the quote, at most 0.5 %
    of a fifth of the volume; what it earns, and the ceiling without a fee."""
    d = volume.join(spread, keys).join(wallets, keys)
    d = d.withColumn("net_bps", rnd(F.col("spread_bps") / 2 - fee_bps)).withColumn("cap", rnd(F.col("volume") * 0.005 / 5))
    d = d.withColumn("quoted", F.least(F.lit(float(quote)), F.col("cap")))
    label = F.when(F.col("net_bps") <= 0, "none").when(F.col("net_bps") < 5, "thin").otherwise("open")
    return d.withColumns({"label": label, "earns": rnd(F.col("net_bps") * F.col("quoted") / 10_000), "ceiling": rnd(F.col("spread_bps") / 2 * F.col("quoted") / 10_000)})


def bucket_depth_stats(markets: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """markets: depth (all traded), most (largest trade), yes. Per group: rate of YES, quantiles of depth, and the share of
    markets whose largest trade reaches each size."""
    n = F.count("*")
    return markets.groupBy(*keys).agg(
        n.alias("n"),
        share(F.sum("yes"), F.count("yes")).alias("yes_rate"),
        F.max("most").alias("most"),
        *[F.round(F.percentile("depth", F.lit(x)), 4).alias(f"depth_p{p}") for p, x in ((50, 0.5), (90, 0.9))],
        *[share(F.count_if(F.col("most") >= x), n).alias(f"p_{x}") for x in sizes],
    )


def fill_prob_matrix(markets: DataFrame, sizes: list[int], half_spread: float, slip: float, fee: float, fill_rate: float = 0.85) -> DataFrame:
    """markets: bucket, most (largest trade), raw_milli (edge). On a grid of sizes: P(most >= size) times the fill rate, the
    mean edge less half the spread, a slippage that grows with size, and the fee; and what that is worth."""
    e = markets.withColumn("want", F.explode(F.array(*[F.lit(x) for x in sizes])))
    n = F.count("*")
    g = e.groupBy("bucket", "want").agg(n.alias("n"), (F.count_if(F.col("most") >= F.col("want")) / n * fill_rate).alias("p"), (F.sum("raw_milli") / F.count("raw_milli") / 1000).alias("raw"))
    net = F.col("raw") - half_spread - F.col("want") * slip - fee
    return g.select("bucket", "want", "n", rnd("p").alias("p_fill"), rnd(net).alias("net_edge"), rnd(net * F.col("p") * F.col("want")).alias("expected"))


def strategy_report(df: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """df: gross_milli (null while open), fee_milli, size, held_s, path. Per cell: open and closed, counts by path, hit
    rate, edges, mean hold in hours, profit, and a verdict ladder over the closed ones."""
    g, n = F.col("gross_milli"), F.count("gross_milli")
    closed = g.isNotNull()
    r = df.groupBy(key).agg(
        n.alias("closed"),
        F.count_if(~closed).alias("open"),
        *[F.count_if(F.col("path") == p).alias(f"by_{p}") for p in paths],
        share(F.count_if(g > 0), n).alias("hit_rate"),
        F.round(F.sum(g) / n / 1000, 6).alias("gross"),
        F.round((F.sum(g) - F.sum(F.when(closed, F.col("fee_milli")))) / n / 1000, 6).alias("net"),
        rnd(F.sum(F.when(closed, F.col("held_s"))) / n / 3600).alias("hold_h"),
        F.sum(F.when(closed, (g - F.col("fee_milli")) * F.col("size"))).alias("pnl_milli"),
    )
    return r.withColumn("verdict", F.when(F.col("closed") < 20, "insufficient").when(F.col("net") >= 0.015, "go").when(F.col("net") >= 0.005, "watch").otherwise("stop"))


def price_sufficiency(samples: DataFrame, markets: DataFrame, windows_s: list[int], thin: int) -> DataFrame:
    """Per resolved market: samples in each of the last windows before its end, and whether one in the longest window has a
    spread over ``thin``. samples: market_id, ts, spread."""
    j = markets.where("yes is not null").select("market_id", "end_ts").join(samples.select("market_id", "ts", "spread"), "market_id", "left")
    age = F.unix_micros("end_ts") - F.unix_micros("ts")
    inside = lambda w: (age >= 0) & (age <= w * 1_000_000)
    return j.groupBy("market_id").agg(*[F.count_if(inside(w)).alias(f"in_{w}") for w in windows_s], F.coalesce(F.max(inside(max(windows_s)) & (F.col("spread") > thin)), F.lit(False)).alias("thin"))


def sufficiency_verdict(per_market: DataFrame, counts: list[str], least: int = 1) -> DataFrame:
    """One row: markets, those with ``least`` samples in each window, thin books, and a ladder over the first window."""
    n = F.count("*")
    one = per_market.agg(n.alias("markets"), *[F.count_if(F.col(c) >= least).alias(f"with_{c}") for c in counts], F.count_if("thin").alias("thin"))
    part = share(F.col(f"with_{counts[0]}"), F.col("markets"))
    return one.withColumn("verdict", F.when(part >= 0.8, "sufficient").when(part >= 0.4, "partial").otherwise("insufficient"))


def funding_stats(rates: DataFrame, key: str, rate: str, perp: str, spot: str) -> DataFrame:
    """Shares of positive and negative rates, mean, median, p10, p90, annualized at three a day, and the mean basis of the
    perpetual over the spot price in percent."""
    q = F.percentile(rate, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    n = F.count("*")
    return rates.groupBy(key).agg(
        n.alias("n"),
        F.round(F.count_if(F.col(rate) > 0) / n, 6).alias("positive"),
        F.round(F.count_if(F.col(rate) < 0) / n, 6).alias("negative"),
        F.round(F.sum(rate) / n, 4).alias("mean"),
        *[F.round(q[i], 4).alias(f"p{p}") for i, p in enumerate((10, 50, 90))],
        F.round(F.sum(rate) / n * 3 * 365, 2).alias("annual"),
        F.round(F.sum((F.col(perp) - F.col(spot)) * 100 / F.col(spot)) / n, 4).alias("basis_pct"),
    )


def viability_gate(markets: DataFrame, key: str, cadences: list[str], least: int, volume: float) -> DataFrame:
    """markets: volume, cadence. Per group: markets, median and p90 volume, counts by cadence, PROMISING or SKIP."""
    q = F.percentile("volume", F.array(F.lit(0.5), F.lit(0.9)))
    g = markets.groupBy(key).agg(F.count("*").alias("n"), F.round(q[0], 4).alias("p50"), F.round(q[1], 4).alias("p90"), *[F.count_if(F.col("cadence") == c).alias(c) for c in cadences])
    return g.withColumn("verdict", F.when((F.col("n") >= least) & (F.col("p50") >= volume), "PROMISING").otherwise("SKIP"))


def group_collect(markets: DataFrame, event: str) -> DataFrame:
    """Events of two legs or more with exactly one winner: ids and slugs in order, first slug, dates. A list is as long as
    its event has legs."""
    legs = F.sort_array(F.collect_list(F.struct("market_id", "slug")))
    g = markets.groupBy(event).agg(F.count("*").alias("n"), legs.alias("l"), F.sum("yes").alias("winners"), F.min("end_ts").alias("first_end"), F.max("end_ts").alias("last_end"))
    g = g.where("n >= 2 and winners = 1")
    ids = F.concat_ws(",", F.transform("l.market_id", lambda x: x.cast("string")))
    return g.select(event, "n", ids.alias("ids"), F.concat_ws(",", "l.slug").alias("slugs"), F.element_at("l.slug", 1).alias("first_slug"), "winners", "first_end", "last_end")


def participant_profile(fills: DataFrame, top: int = 5, busy: float = 0.02) -> DataFrame:
    """fills: wallet, asset, ts, cents, maker, action (open, close, liquidation), fee, pnl. Counts, notional, share of maker
    fills, role, span in days, hours of day with ``busy`` of the fills or more, and the ``top`` assets by notional. The fills are read
    once, into a row per wallet, asset and hour of day; all else comes from these."""
    actions, sums = ("open", "close", "liquidation"), {"notional": "cents", "fees": "fee", "pnl": "pnl"}
    at = F.unix_micros("ts")
    each = fills.where(F.col("wallet").isNotNull()).groupBy("wallet", "asset", F.hour("ts").alias("hour")).agg(
        F.count("*").alias("n"),
        F.count_if("maker").alias("makers"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
        *[F.count_if(F.col("action") == a).alias(f"{a}s") for a in actions],
        F.min(at).alias("first"),
        F.max(at).alias("last"),
    )
    of_wallet, of_hour = Window.partitionBy("wallet"), Window.partitionBy("wallet", "hour")
    each = each.withColumns({"all": F.sum("n").over(of_wallet), "asset_sum": F.sum("notional").over(Window.partitionBy("wallet", "asset"))})
    each = each.withColumns({"in_hour": F.sum("n").over(of_hour), "nth": F.row_number().over(of_hour.orderBy("asset"))})
    each = each.withColumn("rank", F.dense_rank().over(of_wallet.orderBy(F.desc("asset_sum"), "asset")))
    total = each.groupBy("wallet").agg(
        F.sum("n").alias("n"),
        F.sum("notional").alias("notional"),
        share(F.sum("makers"), F.sum("n")).alias("maker_share"),
        *[F.sum(f"{a}s").alias(f"{a}s") for a in actions],
        F.sum("fees").alias("fees"),
        F.sum("pnl").alias("pnl"),
        rnd((F.max("last") - F.min("first")) / 86_400e6).alias("span_days"),
        F.count_if((F.col("nth") == 1) & (F.col("in_hour") >= busy * F.col("all"))).alias("busy_hours"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("rank") <= top, F.struct("rank", "asset"))))["asset"]).alias("assets"),
    )
    role = F.when(F.col("maker_share") >= 0.7, "maker").when(F.col("maker_share") <= 0.3, "taker").otherwise("mixed")
    return total.withColumn("role", role)


def flat_fraction(returns: DataFrame, ret: str, limit: float, quiet: list[int]) -> DataFrame:
    """Share of absolute returns under ``limit`` by start hour (column bin in hours), and for quiet and active hours."""
    r = returns.where(F.col(ret).isNotNull()).withColumn("hour", F.col("bin") % 24)
    h = r.groupBy("hour").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col(ret)) < limit).alias("flat"))  # 24 rows
    part = F.when(F.col("hour").isin(quiet), "quiet").otherwise("active")
    both = h.groupBy(part.alias("part")).agg(F.lit(None).cast("bigint").alias("hour"), F.sum("n").alias("n"), F.sum("flat").alias("flat"))
    return h.select(F.lit("hour").alias("part"), "hour", "n", "flat").unionByName(both).withColumn("flat", share(F.col("flat"), F.col("n")))


def realized_vol_by_hour(bars: DataFrame, key: str, least: int = 3, quietest: int = 6) -> DataFrame:
    """bars: key, bin (hours since the epoch), open, close. Per key, day and hour of day sqrt(sum log(c/o)^2); then its
    quartiles and mean in basis points per hour of day, and whether the hour is among the ``quietest`` by median."""
    move = F.sqrt(F.sum(F.pow(F.log(F.col("close") / F.col("open")), 2)))
    d = bars.groupBy(key, (F.col("bin") % 24).alias("hour"), F.expr("bin div 24").alias("day")).agg(F.count("*").alias("n"), move.alias("v")).where(F.col("n") >= least)
    v = F.col("v") * 10_000
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = d.groupBy("hour").agg(F.count("*").alias("n"), *[F.round(q[i], 4).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], F.round(F.sum(v) / F.count("*"), 4).alias("mean"))
    return g.withColumn("quiet", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("p50", "hour")) <= quietest)  # 24 rows


def pattern_coverage(df: DataFrame, pattern: Column, relevant: Column, candidate: Column) -> DataFrame:
    """Rows per first matching pattern: how many are relevant, and how many of these the candidate list catches."""
    return df.groupBy(F.coalesce(pattern, F.lit("none")).alias("pattern")).agg(F.count("*").alias("n"), F.count_if(relevant).alias("relevant"), F.count_if(relevant & candidate).alias("caught"))


def keyword_hits(df: DataFrame, venue: str, text: str, words: list[str]) -> DataFrame:
    """Rows per venue whose text contains each word."""
    return df.groupBy(venue).agg(F.count("*").alias("n"), *[F.count_if(F.lower(text).contains(w)).alias(f"has_{w}") for w in words])
