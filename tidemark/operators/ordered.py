"""Ordered analytics: grids, forward fill, basket sums, runs, paths, lead-lag, ranks, realized volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalar import pearson, rnd
from tidemark.operators.selection import slices


def grid_last_ffill(ticks: DataFrame, key: str, value: str, step_s: int, tie: str, chunk: int = 4096) -> DataFrame:
    """Last value per bin on a dense grid per key, filled forward. The grid is filled within stretches of ``chunk`` bins; what comes
    into a stretch is carried over a table of one row per key and stretch."""
    b = ticks.select(key, F.floor(F.unix_micros("ts") / (step_s * 1_000_000)).alias("bin"), F.struct("ts", tie).alias("o"), value)
    last = b.groupBy(key, "bin").agg(F.max_by(value, "o").alias(value)).withColumn("__c", F.floor(F.col("bin") / chunk))
    ends = last.groupBy(key, "__c").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("bin"))).alias("__end"), F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    span = ends.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    stretches = span.select(key, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / chunk), F.floor(F.col("hi") / chunk))).alias("__c"))
    carried = F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    stretches = stretches.hint("merge").join(ends.select(key, "__c", "__end").hint("merge"), [key, "__c"], "left").withColumn("__in", carried)
    first, end = F.greatest("lo", F.col("__c") * chunk), F.least("hi", F.col("__c") * chunk + chunk - 1)
    dense = stretches.repartition(key, "__c").select(key, "__c", "__in", F.explode(F.sequence(first, end)).alias("bin"))
    w = Window.partitionBy(key, "__c").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    filled = dense.hint("merge").join(last.hint("merge"), [key, "__c", "bin"], "left")
    return filled.select(key, "bin", F.coalesce(F.last(value, ignorenulls=True).over(w), "__in").alias(value))


def lagged(grid: DataFrame, key: str, order: str, value: str, k: int, name: str, chunk: int = 4096) -> DataFrame:
    """``grid`` with ``name``, the value ``k`` rows before in its key. The grid is dense in ``order`` (a whole number a row), so a stretch
    of ``chunk`` rows needs no more than the last k rows of those before: these are sent to it as well."""
    at = F.floor(F.col(order) / chunk)
    reach = F.sequence(at, F.floor((F.col(order) + k) / chunk))  # the stretches that a row is in or is looked back to from
    rows = grid.select("*", at.alias("__own")).withColumn("__c", F.explode(reach))
    w = Window.partitionBy(key, "__c").orderBy(order)
    return rows.withColumn(name, F.lag(value, k).over(w)).where("__c = __own").drop("__c", "__own")


def log_returns(grid: DataFrame, key: str, value: str, chunk: int = 4096) -> DataFrame:
    """Logarithmic returns from bin to bin of a dense grid."""
    return lagged(grid, key, "bin", value, 1, "__before", chunk).withColumn("ret", F.log(F.col(value) / F.col("__before"))).drop("__before")


def lead_lag_xcorr(a: DataFrame, b: DataFrame, value: str, lags: int, least: int = 10) -> DataFrame:
    """Correlation of a(t) with b(t + lag) for each lag within +-``lags``; a positive peak lag: a leads."""
    x = a.select("bin", F.col(value).alias("x"), F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag")).withColumn("bin", F.col("bin") + F.col("lag"))
    j = x.hint("merge").join(b.select("bin", F.col(value).alias("y")).hint("merge"), "bin").where("x is not null and y is not null")
    c = j.groupBy("lag").agg(F.count("*").alias("n"), pearson("x", "y").alias("corr"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return c.where((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)).select("lag", "n", F.round("corr", 6).alias("corr"))


def carry_forward_basket(legs: DataFrame, step_s: int, tolerance_s: int, require_all: int | None = None) -> DataFrame:
    """Per event and bucket: the sum of each leg's last price (at most ``tolerance_s`` old) over all legs that trade in
    the event at all; null if one of them is stale. ``require_all``: the number of legs that must exist."""
    us = step_s * 1_000_000
    b = legs.select("event", "leg", F.expr(f"unix_micros(ts) div {us}").alias("bucket"), F.struct("ts", "id").alias("o"), "price_micro")
    last = b.groupBy("event", "leg", "bucket").agg(F.max_by("price_micro", "o").alias("price_micro"))
    grid = last.select("event", "bucket").distinct()
    names = last.select("event", "leg").distinct()
    n = names.groupBy("event").agg(F.count("*").alias("n_legs"))
    cells = grid.join(names, "event").hint("merge").join(last.hint("merge"), ["event", "leg", "bucket"], "left")
    w = Window.partitionBy("event", "leg").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    seen = cells.select("event", "leg", "bucket", F.last("price_micro", ignorenulls=True).over(w).alias("p"), F.last(F.when(F.col("price_micro").isNotNull(), F.col("bucket")), ignorenulls=True).over(w).alias("at"))
    fresh = (F.col("bucket") - F.col("at")) * step_s <= tolerance_s
    t = seen.groupBy("event", "bucket").agg(F.sum(F.when(fresh, F.col("p"))).alias("total_micro"), F.count(F.when(fresh, 1)).alias("fresh")).join(n, "event")
    whole = (F.col("fresh") == F.col("n_legs")) & (F.lit(True) if require_all is None else F.col("n_legs") == require_all)
    return t.select("event", "bucket", "n_legs", F.when(whole, F.col("total_micro")).alias("total_micro"))


def threshold_runs(grid: DataFrame, key: str, order: str, value: str, below: float, least_rows: int = 1, chunk: int = 4096) -> DataFrame:
    """Maximal runs of consecutive rows of a key with value < ``below`` (null breaks). Runs are made within stretches of ``chunk``
    units of ``order`` (a number, unique in a key); those at a stretch's ends are joined with their neighbours in a second
    step, over at most two rows per key and stretch."""
    low = F.coalesce(F.col(value) < below, F.lit(False))
    g = grid.select(key, F.col(order).alias("o"), F.col(value).alias("v"), F.floor(F.col(order) / chunk).alias("__c"), low.alias("low"))
    w = Window.partitionBy(key, "__c").orderBy("o")
    g = g.withColumn("turn", F.coalesce(F.col("low") != F.lag("low").over(w), F.lit(False)).cast("int"))
    g = g.select("*", F.sum("turn").over(w).alias("part"), F.count("*").over(Window.partitionBy(key, "__c")).alias("all"), F.row_number().over(w).alias("rn"))
    merged = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_rows").alias("n_rows"), F.min("least").alias("least"), F.max("most").alias("most"), F.min_by("first_value", "start").alias("first_value"), F.max_by("last_value", "start").alias("last_value")]
    local = g.groupBy(key, "__c", "part").agg(
        F.first("low").alias("low"), F.min("o").alias("start"), F.max("o").alias("end"), F.count("*").alias("n_rows"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.min_by("v", "o").alias("first_value"), F.max_by("v", "o").alias("last_value"), (F.min("rn") == 1).alias("first"), (F.max("rn") == F.first("all")).alias("last"))
    # every stretch has a run, high or low, at either end: of two neighbours the later is the next stretch's first
    local = local.withColumn("side", F.when(F.col("first") | F.col("last"), F.lit(None)).otherwise(F.col("__c")))
    over = Window.partitionBy(key, "side").orderBy("start")
    joins = F.col("side").isNull() & F.col("first") & F.col("low") & F.lag(F.col("low") & F.col("last")).over(over)
    local = local.withColumn("run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(over))
    r = local.where("low").groupBy(key, "side", "run").agg(*merged)
    return r.where(F.col("n_rows") >= least_rows).drop("side", "run")


def window_first_last_delta(ticks: DataFrame, key: str, value: str, minutes: int, tie: str, volume: str | None = None) -> DataFrame:
    """Per key and tumbling window: first and last value, their difference, rows; volume change clipped at 0."""
    us = minutes * 60_000_000
    o = F.struct("ts", tie)
    extra = [F.greatest(F.max_by(volume, o) - F.min_by(volume, o), F.lit(0)).alias("volume_delta")] if volume else []
    g = ticks.groupBy(key, F.expr(f"unix_micros(ts) div {us}").alias("window"))
    return g.agg(F.min_by(value, o).alias("first"), F.max_by(value, o).alias("last"), F.count("*").alias("n"), *extra).withColumn("delta", F.col("last") - F.col("first"))


def rank_in_group(rows: DataFrame, group: str, by: str, tie: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), tie)))


def dealt(rows: DataFrame, key: str, most: int = 400_000) -> DataFrame:
    """``rows`` dealt by ``key`` so that a task has about ``most`` of them however many there are: what it sorts doesn't grow with the table.
    They are counted first; a table as it was read is counted without reading its columns."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))
    return rows.repartition(n, key)


def rank_stats(rows: DataFrame, group: str, by: str, tie: str, outcome: str, legs: int, keys: list[str] = (), least: int = 1) -> DataFrame:
    """Groups of exactly ``legs`` rows ranked by falling ``by`` (ties by ``tie``); per rank, over all and per value of ``keys`` (null: over
    all): rows, how often the outcome was 1, mean, least and largest ``by``, and the rate less the mean."""
    w = Window.partitionBy(group)
    r = rows.select(*keys, by, outcome, F.row_number().over(w.orderBy(F.desc(by), tie)).alias("rank"), F.count("*").over(w).alias("__n")).where(F.col("__n") == legs)
    rate, mean = F.avg(F.col(outcome).cast("double")), F.sum(by) / F.count("*")
    g = r.groupingSets([["rank"], [*keys, "rank"]] if keys else [["rank"]], *keys, "rank")
    out = g.agg(F.count("*").alias("n"), rnd(rate).alias("rate"), rnd(mean).alias("mean"), F.min(by).alias("least"), F.max(by).alias("most"), rnd(rate - mean).alias("deviation"))
    return out.where(F.col("n") >= least)


def change_count(ticks: DataFrame, key: str, value: str, order: list[str], chunk_us: int = 86_400_000_000) -> DataFrame:
    """Rows per key, and how often the value differs from the one before in the order (its first column is a time). Changes are
    counted within stretches of ``chunk_us``; a row per stretch, its first and last value, gives the changes between them."""
    rows = ticks.select(key, F.col(value).alias("v"), F.struct(*order).alias("o"), F.floor(F.unix_micros(order[0]) / chunk_us).alias("__c"))
    inside = F.col("v") != F.lag("v").over(Window.partitionBy(key, "__c").orderBy("o"))
    c = rows.withColumn("turn", inside).groupBy(key, "__c").agg(F.count("*").alias("n"), F.count_if("turn").alias("turns"), F.min_by(F.struct("v"), "o").alias("first"), F.max_by(F.struct("v"), "o").alias("last"))
    between = F.col("first.v") != F.lag("last").over(Window.partitionBy(key).orderBy("__c"))["v"]
    return c.withColumn("between", between).groupBy(key).agg(F.sum("n").alias("n"), (F.sum("turns") + F.count_if("between")).alias("changes"))


def rolling_return(rows: DataFrame, key: str, order: str, value: str, k: int, chunk: int = 4096) -> DataFrame:
    """Logarithmic returns over ``k`` rows of a dense grid."""
    return lagged(rows, key, order, value, k, "__before", chunk).withColumn("ret", F.round(F.log(F.col(value) / F.col("__before")), 6)).drop("__before")


def realized_vol_windows(hourly: DataFrame, key: str, value: str, hours: int, every: int) -> DataFrame:
    """Volatility of hourly log returns over sliding windows of ``hours`` that start every ``every`` hours, annualized;
    each return is exploded to the windows that hold it."""
    r = log_returns(hourly, key, value).where("ret is not null")
    first = F.expr(f"(bin - {hours - 1} + {every - 1}) div {every}")
    e = r.select(key, "ret", F.explode(F.sequence(first, F.expr(f"bin div {every}"))).alias("w"))
    return e.groupBy(key, "w").agg(F.count("*").alias("n"), F.round(F.stddev_samp("ret") * F.sqrt(F.lit(8760.0)), 6).alias("vol")).where(F.col("n") == hours)


def terciles(rows: DataFrame, key: str, value: str, tie: str, parts: int = 1000) -> DataFrame:
    """low, mid or high by sorted index n div 3 and 2n div 3."""
    s = slices(rows, [key], [value, tie], [lambda n: F.floor(n / 3), lambda n: F.floor(2 * n / 3)], "__slice", parts)
    return s.withColumn("regime", F.element_at(F.array(*[F.lit(x) for x in ("low", "mid", "high")]), F.col("__slice") + 1)).drop("__slice")


def time_in_range(ticks: DataFrame, key: str, value: str, order: list[str], widths: list[float]) -> DataFrame:
    """Share of values within +-width of the key's first value, for a fixed list of widths; whether any left it, the change
    from first to last in percent, and the extremes."""
    begins = ticks.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("first"))  # a row per key: broadcast if it is small, else a join that may be split
    f = ticks.select(key, value, F.struct(*order).alias("o")).join(begins, key)
    e = f.withColumn("width", F.explode(F.array(*[F.lit(x) for x in widths])))
    inside = F.abs(F.col(value) - F.col("first")) <= F.col("width") * F.col("first")
    first, last = F.max("first"), F.max_by(value, "o")
    return e.groupBy(key, "width").agg(
        F.count("*").alias("n"),
        F.round(F.avg(inside.cast("double")), 6).alias("share"),
        (~F.bool_and(inside)).alias("exited"),
        rnd(F.try_divide((last - first) * 100, first)).alias("change_pct"),
        F.max(value).alias("most"),
        F.min(value).alias("least"),
    )


def last_tail_mean(rows: DataFrame, key: str, order: list[str], value: str, keep: str, k: int = 5, yes_at: float = 0.85, no_at: float = 0.15) -> DataFrame:
    """Mean of the last k values among the rows that ``keep`` holds for, the last such row's time (first of ``order``), and
    YES, NO or null by two thresholds."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    tail = rows.where(keep).select(key, value, order[0], F.row_number().over(w).alias("rn")).where(F.col("rn") <= k)
    g = tail.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(value) / F.count("*"), 4).alias("tail_mean"), F.max(order[0]).alias("last_active"))
    return g.withColumn("verdict", F.when(F.col("tail_mean") >= yes_at, "YES").when(F.col("tail_mean") <= no_at, "NO"))


def path_shape(ticks: DataFrame, key: str, t0: int, target: int, near: int, fast_s: int, slow_s: int, later: tuple[int, int]) -> DataFrame:
    """First time within ``near`` of ``target`` after t0 (seconds): snap, drift or slow; counts before and after; the value
    at t0; means of the first ``fast_s`` seconds and of the span ``later``."""
    s = F.expr("unix_micros(ts)") / 1e6 - t0
    hit = F.min(F.when((s >= 0) & (F.abs(F.col("cents") - target) <= near), s))

    def mean(a: int, b: int):
        x = F.when((s >= a) & (s <= b), F.col("cents"))
        return F.round(F.try_divide(F.sum(x), F.count(x)), 4)

    g = ticks.groupBy(key).agg(
        hit.alias("hit"),
        F.count_if(s < 0).alias("n_pre"),
        F.count_if(s >= 0).alias("n_post"),
        F.max_by(F.when(s <= 0, F.col("cents")), F.when(s <= 0, F.struct("ts", "id"))).alias("at_t0"),
        mean(0, fast_s).alias("early_mean"),
        mean(*later).alias("late_mean"),
    )
    shape = F.when(F.col("n_post") == 0, "no-data").when(F.col("hit") <= fast_s, "snap").when(F.col("hit") <= slow_s, "drift").otherwise("slow")
    return g.select(key, F.round("hit", 3).alias("hit_s"), "n_pre", "n_post", "at_t0", "early_mean", "late_mean", shape.alias("shape"))


def persistence_summary(runs: DataFrame, category: str, limit: int, step_h: int, spans_h: tuple[int, ...] = (24, 168, 720)) -> DataFrame:
    """Runs under ``limit`` per category, and over all (null): median and p90 of the hours they last, of the edge (limit less
    the least value) and of the decay (first less last value, so positive means the sum fell), and how many last long."""
    x = runs.select(
        "event", F.coalesce(category, F.lit("none")).alias(category), ((F.col("end") - F.col("start") + 1) * step_h).alias("hours"), (limit - F.col("least")).alias("edge"), (F.col("first_value") - F.col("last_value")).alias("decay")
    )
    parts = [F.round(F.percentile(c, F.lit(q)), 4).alias(f"{c}_p{p}") for c in ("hours", "edge", "decay") for p, q in ((50, 0.5), (90, 0.9))]
    return x.rollup(category).agg(F.count("*").alias("runs"), F.count_distinct("event").alias("events"), *parts, *[F.count_if(F.col("hours") >= h).alias(f"over_{h}h") for h in spans_h])
