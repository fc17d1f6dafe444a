"""Running sums of events as of given times, and deviations over sliding windows, for keys of any size.

Events and probes are stacked and summed in time order within each key and time bucket; what lies in other buckets comes from a table of
one row per key and bucket. So a handful of keys is no handful of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.joins import asof_backward

DAY_US = 86_400_000_000


def running(probes: DataFrame, events: DataFrame, keys: list[str], sums: list[str], peak: str | None = None, bucket_us: int = 30 * DAY_US, source: DataFrame | None = None) -> DataFrame:
    """``probes`` with each of ``sums`` totalled over the events of the same keys at or before the probe's ``ts``, and with
    ``peak``: the highest total that this column ever had (``<peak>_peak``, 0 before the first event). Events of one time count
    together. Null keys and times meet nothing: their totals are 0. ``source``: rows with all the probes' keys and times, if they are read
    more cheaply a second time than the probes are."""
    known = F.lit(True)
    for k in [*keys, "ts"]:
        known = known & F.col(k).isNotNull()
    per_time = events.where(known).groupBy(*keys, "ts").agg(*[F.sum(c).alias(c) for c in sums])
    kind = probes.select(F.struct(*probes.columns).alias("p")).schema["p"].dataType
    e = per_time.select(*keys, F.unix_micros("ts").alias("__u"), F.lit(0).alias("__side"), *sums, F.lit(None).cast(kind).alias("__p"))
    p = probes.select(*keys, F.unix_micros("ts").alias("__u"), F.lit(1).alias("__side"), *[F.lit(0).cast(per_time.schema[c].dataType).alias(c) for c in sums], F.struct(*probes.columns).alias("__p"))
    both = e.unionByName(p).withColumn("__b", F.floor(F.col("__u") / bucket_us))
    w = Window.partitionBy(*keys, "__b").orderBy("__u", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("*", *[F.sum(c).over(w).alias(f"__in_{c}") for c in sums])
    if peak:
        both = both.withColumn("__top", F.max(F.when(F.col("__side") == 0, F.col(f"__in_{peak}"))).over(w))
    e = per_time.withColumn("__u", F.unix_micros("ts")).withColumn("__b", F.floor(F.col("__u") / bucket_us))
    if peak:
        e = e.withColumn("__top", F.sum(peak).over(Window.partitionBy(*keys, "__b").orderBy("__u").rowsBetween(Window.unboundedPreceding, 0)))
    asked = (probes if source is None else source).where(known).select(*keys, F.floor(F.unix_micros("ts") / bucket_us).alias("__b")).distinct()
    b = e.select(*keys, "__b", *sums, *(["__top"] if peak else [])).unionByName(asked, allowMissingColumns=True)
    b = b.groupBy(*keys, "__b").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *([F.max("__top").alias("__top")] if peak else []))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and bucket
    b = b.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__base_{c}") for c in sums])
    if peak:
        b = b.withColumn("__peak", F.greatest(F.max(F.col(f"__base_{peak}") + F.col("__top")).over(before), F.lit(0)))
    b = b.select(*keys, "__b", *[c for c in b.columns if c.startswith(("__base_", "__peak"))])
    j = both.where("__side = 1").hint("merge").join(b.hint("merge"), [*keys, "__b"], "left")  # by the window's own keys: dealt and sorted once
    ok = F.lit(True)
    for k in [*keys, "__u"]:
        ok = ok & F.col(k).isNotNull()
    out = [F.when(ok, F.col(f"__in_{c}") + F.col(f"__base_{c}")).otherwise(0).alias(c) for c in sums]
    if peak:
        top = F.greatest(F.col(f"__base_{peak}") + F.col("__top"), F.coalesce("__peak", F.lit(0)), F.lit(0))
        out.append(F.when(ok, top).otherwise(0).alias(f"{peak}_peak"))
    return j.select("__p.*", *out)


def sliding_deviation(probes: DataFrame, series: DataFrame, key: str, value: str, span_s: int, probe_id: str, name: str = "sigma") -> DataFrame:
    """``probes`` with the sample deviation of the series' values in the ``span_s`` seconds up to each one's ``ts``, both ends included. A
    window is the end of one bucket of its length and the beginning of the next: two sums of counts, values and squares, in
    double precision (exact for whole numbers whose squares sum to under 2 ** 53). ``probe_id`` is unique; null under two values."""
    us = span_s * 1_000_000
    s = series.where(F.col("ts").isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("__k"), F.unix_micros("ts").alias("__u"), F.lit(0).alias("__side"), F.col(value).cast("double").alias("__v"), F.lit(None).cast(dict(probes.dtypes)[probe_id]).alias("__id"))
    at = F.unix_micros("ts")
    p = lambda t, side: probes.select(F.col(key).alias("__k"), t.alias("__u"), F.lit(side).alias("__side"), F.lit(None).cast("double").alias("__v"), F.col(probe_id).alias("__id"))
    ends, starts = p(at, 1).withColumn("__b", F.floor(F.col("__u") / us)), p(at - us, -1).withColumn("__b", F.floor(F.col("__u") / us))
    both = s.withColumn("__b", F.floor(F.col("__u") / us)).unionByName(ends).unionByName(starts)
    w = Window.partitionBy("__k", "__b")  # either way the frame grows by a row; one that shrinks is summed anew for each row
    upto, since = (w.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("__u", "__side"), (F.desc("__u"), F.desc("__side"))))
    moments = {"n": F.count("__v"), "s": F.sum("__v"), "q": F.sum(F.col("__v") * F.col("__v"))}
    pick = lambda m: F.when(F.col("__side") == 1, m.over(upto)).when(F.col("__side") == -1, m.over(since))
    both = both.select("__id", "__side", *[pick(m).alias(c) for c, m in moments.items()]).where("__side <> 0")
    g = both.groupBy("__id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in moments])
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    sigma = F.when(F.col("n") > 1, F.sqrt(F.greatest(variance, F.lit(0.0))))
    return probes.hint("merge").join(g.select(F.col("__id").alias(probe_id), sigma.alias(name)).hint("merge"), probe_id)


def move_scores(probes: DataFrame, series: DataFrame, key: str, value: str, tie: str, horizons_s: tuple[int, ...] = (30, 60, 300), baseline_s: int = 30, sigma_s: int = 3600, limits: tuple[float, float] = (1.0, 2.5)) -> DataFrame:
    """Moves of ``value`` from ``baseline_s`` before each probe (id, key, ts) to each horizon after it, the last one over the deviation of
    the values in the ``sigma_s`` before the probe (z), and its signal: low under the first limit, medium under the second, else
    high; null without a z. All lookups of a probe are rows of one as-of join."""
    shifts = {"before": -baseline_s} | {f"move_{h}": h for h in horizons_s}
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.lit(s).cast("long").alias("shift")) for n, s in shifts.items()]))
    p = probes.select("id", key, "ts").withColumn("a", asked).select("id", key, F.col("a.what").alias("what"), F.timestamp_micros(F.unix_micros("ts") + F.col("a.shift") * 1_000_000).alias("ts"))
    found = asof_backward(p, series, key, "ts", value, None, tie).groupBy("id").pivot("what", list(shifts)).agg(F.first(value))
    scored = sliding_deviation(probes.select("id", key, "ts"), series, key, value, sigma_s, "id").hint("merge").join(found.hint("merge"), "id")
    scored = scored.withColumns({f"move_{h}": F.col(f"move_{h}") - F.col("before") for h in horizons_s})
    z = F.round(F.try_divide(F.col(f"move_{horizons_s[-1]}").cast("double"), F.when(F.col("sigma") > 0, F.col("sigma"))), 4)
    size = F.abs("z")
    signal = F.when(size < limits[0], "low").when(size < limits[1], "medium").when(size.isNotNull(), "high")
    return scored.withColumn("z", z).withColumn("signal", signal).select("id", key, "before", *[f"move_{h}" for h in horizons_s], F.round("sigma", 6).alias("sigma"), "z", "signal")


def gate_reasons(candidates: DataFrame, positions: DataFrame, cells: dict[str, float], seed: float, most_open: int = 3, drawdown: float = 0.2, kill_after: int = 20, from_peak: bool = False) -> DataFrame:
    """The first gate that stops a candidate in a cell, for each cell and its price cap (a fixed list), by the positions that the
    cell holds and has closed at the candidate's time; null if none stops it.

    cap_too_tight: the ask is over the cap. already_open: the cell holds the market's side. drawdown_breaker: closed results have taken
    the cell more than ``drawdown`` of ``seed`` below it, or with ``from_peak`` below its highest balance so far.
    event_concentration_cap: ``most_open`` positions or more of the event are open. early_killed: ``kill_after`` positions or more
    are closed, at a loss in all.
    candidates: id, ts, market, side, event, ask; positions: cell, market, side, event, opened, closed (null: open), pnl."""
    c = candidates.withColumn("c", F.explode(F.array(*[F.struct(F.lit(k).alias("cell"), F.lit(float(v)).alias("cap")) for k, v in cells.items()])))
    c = source = c.select("id", "ts", "market", "side", "event", "c.cell", (F.col("ask") > F.col("c.cap")).alias("tight"))
    turns = positions.select("cell", "market", "side", "event", F.explode(F.array(F.struct(F.col("opened").alias("ts"), F.lit(1).alias("held")), F.struct(F.col("closed").alias("ts"), F.lit(-1).alias("held")))).alias("t"))
    turns = turns.select("cell", "market", "side", "event", "t.*")
    closed = positions.where("closed is not null").select("cell", F.col("closed").alias("ts"), "pnl", F.lit(1).alias("done"))
    c = running(c, turns, ["cell", "market", "side"], ["held"], source=source).drop("market", "side")
    c = running(c, turns.withColumnRenamed("held", "in_event"), ["cell", "event"], ["in_event"], source=source).drop("event")
    c = running(c, closed, ["cell"], ["pnl", "done"], "pnl", source=source)
    lost = (F.col("pnl_peak") - F.col("pnl")) / (seed + F.col("pnl_peak")) if from_peak else -F.col("pnl") / seed
    gates = {
        "cap_too_tight": F.col("tight"),
        "already_open": F.col("held") > 0,
        "drawdown_breaker": lost > drawdown,
        "event_concentration_cap": F.col("in_event") >= most_open,
        "early_killed": (F.col("done") >= kill_after) & (F.col("pnl") < 0),
    }
    return c.select("id", "cell", F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in gates.items()]).alias("reason"))
