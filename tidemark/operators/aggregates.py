"""Distributions, concentration, participants, spreads, impact, ledgers and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import bucket_custom, first_reason
from tidemark.operators.joins import asof_backward, range_exclusion
from tidemark.operators.selection import select_ranks


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def distribution_stats(df: DataFrame, key: str, value: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.99), parts: int = 1000) -> DataFrame:
    """Interpolated percentiles by selection, mean, extremes; rows without a value are left out."""
    rows = df.where(F.col(value).isNotNull())
    ranks = {f"{side}{q}": lambda n, q=q, f=f: f(q * (n - 1)) for q in quantiles for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found = select_ranks(rows, [key], [value], ranks, parts)

    def between(q: float) -> Column:
        lo, hi = (F.col(f"`{side}{q}`")[value].cast("double") for side in ("lo", "hi"))
        at = q * (F.col("n") - 1)
        return F.round(lo + (hi - lo) * (at - F.floor(at)), 4).alias(f"p{int(q * 100)}")

    points = found.select(F.col(key).alias("__key"), *[between(q) for q in quantiles])
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(F.col(value).cast("double")) / F.count("*"), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return sums.hint("merge").join(points.hint("merge"), F.col(key).eqNullSafe(F.col("__key"))).select(key, "n", *[f"p{int(q * 100)}" for q in quantiles], "mean", "least", "most")


def percentile_index(df: DataFrame, key: str, value: str, q: float, inner: bool = True, parts: int = 1000) -> DataFrame:
    """No interpolation: the value at sorted index floor(q (n - 1)) (``inner``) or floor(q n)."""
    at = (lambda n: F.floor(q * (n - 1))) if inner else (lambda n: F.least(F.floor(q * n), n - 1))
    return select_ranks(df, [key], [value], {"at": at}, parts).select(key, F.col("at")[value].alias("value"), "n")


def quantile_exclusive(df: DataFrame, key: str, value: str, parts: int = 10, hot_parts: int = 1000) -> DataFrame:
    """The last of ``parts`` exclusive quantiles; the maximum where a key has fewer rows than ``parts``."""
    pos = lambda n: (n + 1) * (parts - 1) / parts
    j = lambda n: F.least(F.greatest(F.floor(pos(n)), F.lit(1)), n - 1)
    found = select_ranks(df, [key], [value], {"lo": lambda n: j(n) - 1, "hi": j, "most": lambda n: n - 1}, hot_parts)
    lo, hi, most = (F.col(c)[value].cast("double") for c in ("lo", "hi", "most"))
    return found.select(key, "n", F.round(F.when(F.col("n") < parts, most).otherwise(lo + (hi - lo) * (pos(F.col("n")) - j(F.col("n")))), 4).alias("q"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("share", share(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))  # one row per value


def topk_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def value_ranks(df: DataFrame, value: str, parts: int = 256) -> DataFrame:
    """The distinct values of a column with how many rows have each (``m``) and how many have less (``below``). Values are dealt to at
    most ``parts`` ranges by approximate quantiles, summed up inside them, and moved up by the sizes of the ranges below: no task
    sorts all, and equal values are one row."""
    counted = df.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("m"))
    cuts = counted.agg(F.percentile_approx("x", [k / parts for k in range(1, parts)], 10_000).alias("__cuts"))
    dealt = counted.crossJoin(F.broadcast(cuts))  # one row
    dealt = dealt.withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col("x")))).drop("__cuts")
    under = F.coalesce(F.sum("__n").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(F.col("__b").alias("__at")).agg(F.sum("m").alias("__n")).select("__at", under.alias("__under"))  # at most parts rows
    inside = F.sum("m").over(Window.partitionBy("__b").orderBy("x")) - F.col("m")
    return dealt.withColumn("__i", inside).join(F.broadcast(sizes), F.col("__b") == F.col("__at")).select("x", "m", (F.col("__i") + F.col("__under")).alias("below"))


def ranked(df: DataFrame, value: str, key: str, parts: int = 256) -> DataFrame:
    """df with its ascending rank ``i`` over all rows: those with less, by ``value_ranks``, and within equal values by ``key``. A
    value that very many rows share is one task's; what only needs sums over ranks takes ``value_ranks``."""
    less = value_ranks(df, value, parts).select(F.col("x").alias("__x"), "below")
    own = df.withColumn("__i", F.row_number().over(Window.partitionBy(value).orderBy(key)))
    return own.hint("merge").join(less.hint("merge"), F.col(value) == F.col("__x")).withColumn("i", F.col("__i") + F.col("below")).drop("__x", "__i", "below")


def concentration(df: DataFrame, key: str, value: str, group: list[str] = (), tops: tuple[int, ...] = (1, 10, 50, 100)) -> DataFrame:
    """Totals per participant, then per group: shares of the top 1, 10, 50, 100, Gini (ranked closed form), diffuse if the
    top 10 have under half. Without groups participants are ranked by ranges of their totals, equal totals together."""
    t = df.groupBy(*group, key).agg(F.sum(value).alias("x"))
    if group:
        w = Window.partitionBy(*group)
        r = t.select(*group, "x", F.lit(1).alias("m"), (F.row_number().over(w.orderBy("x", key)) - 1).alias("below"), F.count("*").over(w).alias("all"))
    else:
        r = value_ranks(t, "x").crossJoin(F.broadcast(t.agg(F.count("*").alias("all"))))  # one row
    n, total = F.sum("m"), F.sum(F.col("x") * F.col("m"))
    # of m equal totals, those of the highest ranks are among the top k
    inside = lambda k: F.greatest(F.least(F.col("m"), F.col("below") + F.col("m") - F.col("all") + k), F.lit(0))
    shares = [share(F.sum(inside(k) * F.col("x")), total).alias(f"top{k}") for k in tops]
    ranks = F.col("m") * F.col("below") + F.expr("m * (m + 1) div 2")  # the sum of the ranks of m equal totals
    gini = F.round(2 * F.sum(ranks * F.col("x")).cast("double") / (n * total.cast("double")) - (n + 1) / n, 6)
    return r.groupBy(*group).agg(n.alias("participants"), total.alias("total"), *shares, gini.alias("gini")).withColumn("diffuse", F.col("top10") < 0.5)


def wallet_aggregate(t: DataFrame) -> DataFrame:
    return t.groupBy("wallet").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.count_distinct("market_id").alias("markets"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def wallets_per_market(t: DataFrame) -> DataFrame:
    m = t.groupBy("market_id").agg(F.count_distinct("wallet").alias("w"))
    return m.agg(F.count("*").alias("markets"), F.round(F.avg("w"), 6).alias("mean"), F.round(F.percentile("w", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("w", F.lit(0.95)), 4).alias("p95"))


def mix(df: DataFrame, key: str, axis: str, values: list, amount: str) -> DataFrame:
    """Wide amounts per key over fixed axis values, and each one's share."""
    p = df.groupBy(key).pivot(axis, values).agg(F.sum(amount)).na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return p.select(key, *[F.col(f"`{v}`").alias(str(v)) for v in values], *[share(F.col(f"`{v}`"), total).alias(f"{v}_share") for v in values])


def overlap(df: DataFrame, key: str, inside: Column, amount: str) -> DataFrame:
    a = df.where(inside).groupBy(key).agg(F.sum(amount).alias("inside"))
    b = df.where(~inside).groupBy(key).agg(F.sum(amount).alias("outside"))
    return a.join(b, key, "left").select(key, "inside", F.coalesce("outside", F.lit(0)).alias("outside"))


def settled_pnl(legs: DataFrame, markets: DataFrame, signed: bool = False) -> DataFrame:
    """Per wallet over resolved markets. A leg buys (outcome 0) or sells (outcome 1) tokens; net tokens pay 1 each if
    YES, net short ones if NO. Cost counts USD unsigned, as the study's reports did, or signed."""
    side = F.when(F.col("outcome_index") == 1, -1).otherwise(1)
    cost = side * F.col("cents") if signed else F.col("cents")
    g = legs.groupBy("wallet", "market_id").agg(F.sum(side * F.col("size")).alias("net"), F.sum(cost).alias("cost"))
    j = g.join(markets.where("yes is not null").select("market_id", "yes"), "market_id")
    pay = F.when(F.col("net") > 0, F.col("net") * F.col("yes")).otherwise(-F.col("net") * (1 - F.col("yes"))) * 100
    p = j.select("wallet", (pay - F.col("cost")).alias("pnl"))
    return p.groupBy("wallet").agg(F.count("*").alias("markets"), F.sum("pnl").alias("pnl_cents"), share(F.count_if(F.col("pnl") > 0), F.count("*")).alias("win_rate"))


def banded(df: DataFrame, value: str, bands: list[tuple[str, float, float]], *aggs: Column) -> DataFrame:
    """Aggregates per inclusive band; bands may overlap."""
    b = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in bands]))
    return df.withColumn("b", b).where((F.col(value) >= F.col("b.lo")) & (F.col(value) <= F.col("b.hi"))).groupBy(F.col("b.band").alias("band")).agg(*aggs)


def completeness(legs: DataFrame, event: str, placeholder: str, red_flags: list[str]) -> DataFrame:
    """Per event: listed, active, placeholder and resolved legs, winners, red-flag language. DEGENERATE under two active
    legs, PROBABILISTIC with a placeholder leg or a red flag, else GUARANTEED.
    legs: slug, description, active, yes; ``placeholder`` is a pattern of slugs."""
    flag = F.lit(False)
    for words in red_flags:
        flag = flag | F.lower(F.coalesce("description", F.lit(""))).contains(words)
    g = legs.groupBy(event).agg(
        F.count("*").alias("legs"), F.count_if("active").alias("active"), F.count_if(F.coalesce(F.col("slug").rlike(placeholder), F.lit(False))).alias("placeholders"),
        F.count("yes").alias("resolved"), F.sum("yes").alias("winners"), F.max(flag).alias("red_flag"))
    c = F.when(F.col("active") < 2, "DEGENERATE").when(F.col("red_flag") | (F.col("placeholders") > 0), "PROBABILISTIC").otherwise("GUARANTEED")
    return g.withColumn("class", c)


def resolution_class(events: DataFrame) -> DataFrame:
    """Events per way of resolution: OPEN, LISTED-WIN, TAIL (no listed leg won), DEGENERATE; and the share of TAIL among the
    clean, fully resolved ones (no placeholder, no red flag) of that class's row."""
    c = F.when(F.col("resolved") < F.col("legs"), "OPEN").when(F.col("winners") == 1, "LISTED-WIN").when(F.col("winners") == 0, "TAIL").otherwise("DEGENERATE")
    clean = (F.col("placeholders") == 0) & ~F.col("red_flag")
    g = events.withColumn("resolution", c).groupBy("resolution").agg(F.count("*").alias("events"), F.count_if(clean).alias("clean"))
    known = F.sum(F.when(F.col("resolution").isin("LISTED-WIN", "TAIL"), F.col("clean"))).over(Window.partitionBy(F.lit(1)))  # four rows
    return g.withColumn("tail_rate", F.when(F.col("resolution") == "TAIL", share(F.col("clean"), known)))


def multi_winner_hist(events: DataFrame) -> DataFrame:
    return events.groupBy("legs", "winners").agg(F.count("*").alias("events"))


def spread_stats(df: DataFrame, keys: list[str], value: str, limits: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(v) / F.count("*"), 4).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), 4).alias("median"), F.round(F.stddev_samp(v.cast("double")), 4).alias("sd"), F.round(F.sum(F.abs(v)) / F.count("*"), 4).alias("abs_mean"), F.min(v).alias("least"), F.max(v).alias("most"), *[share(F.count_if(F.abs(v) > x), F.count("*")).alias(f"over_{x}") for x in limits])


def baseline_sigma(windows: DataFrame, news: DataFrame, key: str, before_us: int, after_us: int, least: int = 10) -> DataFrame:
    """Deviation of window moves per key over windows without news; null unless ``least`` windows and above 0."""
    calm = range_exclusion(windows, news, key, "ts", before_us, after_us)
    s = calm.groupBy(key).agg(F.count("*").alias("n_calm"), F.stddev_samp(F.col("delta").cast("double")).alias("sigma"))
    return s.select(key, "n_calm", F.when((F.col("n_calm") >= least) & (F.col("sigma") > 0), F.round("sigma", 6)).alias("sigma"))


def rate_ratio(flags: DataFrame, hours: DataFrame, key: str, candidate: Column) -> DataFrame:
    """Flags per hour of candidates against controls, their ratio and its verdict ladder 1.0 / 1.5 / 3.0."""
    f = flags.groupBy(key).agg(F.count("*").alias("flags"))
    g = hours.join(f, key, "left").withColumn("cand", candidate).groupBy("cand").agg(F.sum(F.coalesce("flags", F.lit(0))).alias("flags"), F.sum("hours").alias("hours"))
    one = g.agg(*[F.max(F.when(F.col("cand") == side, F.try_divide(F.col("flags").cast("double"), F.col("hours")))).alias(n) for side, n in ((True, "candidate"), (False, "control"))])
    r = F.when((F.col("control") == 0) & (F.col("candidate") > 0), F.lit(float("inf"))).otherwise(F.coalesce(F.try_divide("candidate", "control"), F.lit(0.0)))
    one = one.withColumn("ratio", r)
    return one.select(F.round("candidate", 6).alias("candidate"), F.round("control", 6).alias("control"), F.round("ratio", 4).alias("ratio"), bucket_custom("ratio", [1.0, 1.5, 3.0], ["none", "weak", "moderate", "strong"]).alias("verdict"))


def feed_silence(items: DataFrame, feed: str, limit_us: int, chunk_us: int = 86_400_000_000) -> DataFrame:
    """Per feed: items, longest silence in minutes between items, and whether it stays within the limit. Gaps are taken within
    stretches of ``chunk_us``; then a row per stretch, its first and last item, gives the gaps between stretches. Items
    without a time are counted only."""
    u = items.select(feed, F.unix_micros("ts").alias("u")).withColumn("chunk", F.floor(F.col("u") / chunk_us))
    gap = F.col("u") - F.lag("u").over(Window.partitionBy(feed, "chunk").orderBy("u"))
    c = u.withColumn("gap", gap).groupBy(feed, "chunk").agg(F.count("*").alias("n"), F.min("u").alias("first"), F.max("u").alias("last"), F.max("gap").alias("gap"))
    between = F.col("first") - F.lag("last").over(Window.partitionBy(feed).orderBy("chunk"))
    g = c.withColumn("gap", F.greatest("gap", between)).groupBy(feed)
    return g.agg(F.sum("n").alias("items"), F.round(F.coalesce(F.max("gap"), F.lit(0)) / 60e6, 4).alias("silent_min"), F.coalesce(F.max("gap") <= limit_us, F.lit(True)).alias("healthy"))


def observed_hours(df: DataFrame, key: str) -> DataFrame:
    us = F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.when(F.count("*") < 2, 0.0).otherwise(us / 3.6e9), 4).alias("hours"))


def hour_profile(df: DataFrame, amount: str, quiet: list[int]) -> DataFrame:
    g = df.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))
    w = Window.partitionBy(F.lit(1))  # 24 rows
    return g.select("hour", "n", share(F.col("n"), F.sum("n").over(w)).alias("n_share"), share(F.col("amount"), F.sum("amount").over(w)).alias("amount_share"), F.col("hour").isin(quiet).alias("quiet"))


def skip_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    return df.groupBy(F.coalesce(first_reason(reasons), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def quality_gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: each check is an aggregate condition; pass and the names of those that fail."""
    one = df.agg(*[c.alias(k) for k, c in checks.items()])
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(k), F.lit(False)), F.lit(k)) for k in checks]))
    return one.select(F.concat_ws(",", failed).alias("failed"), (F.size(failed) == 0).alias("passed"))


def table_freshness(tables: dict[str, tuple[DataFrame, str]], now: str, limit_hours: float) -> DataFrame:
    """Rows, latest write, age and staleness of each table."""
    out = None
    for name, (df, ts) in tables.items():
        one = df.agg(F.count("*").alias("n"), F.max(F.col(ts).cast("timestamp")).alias("latest")).select(F.lit(name).alias("name"), "n", F.round((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("latest")) / 3.6e9, 4).alias("age_hours"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("stale", F.coalesce(F.col("age_hours") > limit_hours, F.lit(True)))


def column_validity(df: DataFrame, columns: list[str], valid: Column) -> DataFrame:
    """Non-null and valid counts of many columns at once, by unpivot; ``valid`` speaks of column v."""
    u = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "v")
    return u.groupBy("name").agg(F.count("v").alias("present"), F.count_if(valid).alias("valid"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per stratum by the order of a keyed hash: the same rows on any partitioning."""
    order = F.pmod(F.col(key) * 2654435761 + seed * 40503, F.lit(1 << 32))
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("rn") <= n).drop("rn")


def entry_momentum(fills: DataFrame, prices: DataFrame, wallet: str, asset: str, value: str, back_s: int = 4 * 3600, gap_s: int = 60, flat: float = 0.005) -> DataFrame:
    """Per participant over its opening fills: the asset's return over ``back_s`` that ends ``gap_s`` before each entry (two
    as-of lookups), with the fill's side (1 long, -1 short) as momentum, contrarian or neutral; over 0.8 momentum is lucky,
    under 0.3 structural. A return from a price of 0 is as IEEE division has it: infinite, or from 0 to 0 NaN, which is over
    ``flat``. fills: wallet, asset, ts, side, id; prices: asset, ts, value, id."""
    at = lambda s: F.timestamp_micros(F.unix_micros("ts") - s * 1_000_000)
    e = fills.select(wallet, asset, "side", F.col("id").alias("fill"), at(gap_s).alias("ts"))
    e = asof_backward(e, prices, asset, "ts", value, tie="id").withColumnRenamed(value, "now").withColumn("ts", at(back_s))
    e = asof_backward(e, prices, asset, "ts", value, tie="id")
    ratio = F.when(F.col(value) == 0, F.col("now") * F.lit(float("inf"))).otherwise(F.try_divide("now", value))
    return momentum_label(e.withColumn("ret", F.col("side") * (ratio - 1)), wallet, "ret", flat)


def momentum_label(returns: DataFrame, key: str, ret: str, flat: float) -> DataFrame:
    label = F.when(F.col(ret) > flat, "momentum").when(F.col(ret) < -flat, "contrarian").otherwise("neutral")
    g = returns.where(F.col(ret).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), share(F.count_if(label == "momentum"), F.count("*")).alias("momentum_share"))
    return g.withColumn("label", F.when(F.col("momentum_share") > 0.8, "lucky").when(F.col("momentum_share") < 0.3, "structural").otherwise("mixed"))


def normalized_odds(df: DataFrame, group: list[str], odds: str) -> DataFrame:
    """1/odds per row, the group's overround, and the share of it; groups with any odds outside (1, 500] drop out."""
    w = Window.partitionBy(*group)
    p = F.try_divide(F.lit(1.0), F.col(odds))
    ok = F.min(((F.col(odds) > 1) & (F.col(odds) <= 500)).cast("int")).over(w) == 1
    x = df.withColumn("implied", F.when(F.col(odds) > 0, p)).withColumn("ok", ok).where("ok")
    return x.withColumn("overround", F.sum("implied").over(w)).withColumn("prob", F.col("implied") / F.col("overround")).drop("ok")


def feed_coverage(items: DataFrame, feed: str, key: str) -> DataFrame:
    """Per feed: items, keys, least, median and most items of a key, and the latest."""
    n = items.groupBy(feed, key).agg(F.count("*").alias("n"), F.max("ts").alias("at"))
    return n.groupBy(feed).agg(F.sum("n").alias("items"), F.count("*").alias("keys"), F.min("n").alias("least"), F.round(F.percentile("n", F.lit(0.5)), 4).alias("median"), F.max("n").alias("most"), F.max("at").alias("latest"))


def feed_window_health(items: DataFrame, feed: str, step_s: int, limit_s: int) -> DataFrame:
    """Per window of ``step_s`` seconds: feeds that have begun and not ended, their items, the longest silence at the window's
    end in minutes, and whether every feed had an item within ``limit_s`` of it. The grid has a row per feed and window."""
    us = step_s * 1_000_000
    c = items.groupBy(feed, F.expr(f"unix_micros(ts) div {us}").alias("window")).agg(F.count("*").alias("n"), F.max(F.unix_micros("ts")).alias("last"))
    span = c.groupBy(feed).agg(F.min("window").alias("lo"), F.max("window").alias("hi"))
    grid = span.select(feed, F.explode(F.sequence("lo", "hi")).alias("window")).hint("merge").join(c.hint("merge"), [feed, "window"], "left")
    w = Window.partitionBy(feed).orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    seen = grid.select("window", F.coalesce("n", F.lit(0)).alias("n"), ((F.col("window") + 1) * us - F.last("last", ignorenulls=True).over(w)).alias("silent"))
    return seen.groupBy("window").agg(F.count("*").alias("feeds"), F.sum("n").alias("items"), F.round(F.max("silent") / 60e6, 4).alias("silent_min"), F.bool_and(F.col("silent") <= limit_s * 1_000_000).alias("healthy"))
