"""Market filters, payouts, candles, venues, capacity, funding and move scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import col
from tidemark.operators.joins import asof_backward


def zip_label_price(labels, prices) -> Column:
    """The price of the label "yes" in any case, else the first."""
    pairs = F.arrays_zip(F.transform(col(labels), lambda x: F.lower(x)).alias("l"), col(prices).alias("p"))
    hit = F.filter(pairs, lambda x: x["l"] == "yes")
    return F.coalesce(F.try_element_at(hit, F.lit(1))["p"], F.try_element_at(col(prices), F.lit(1)))


def classify_payout(closed, disputed, payout, hours_open) -> Column:
    """stuck if open over a day; disputed; win or loss of a {0, 1} payout; else stuck."""
    return F.when(~col(closed), F.when(col(hours_open) > 24, "stuck").otherwise("open")).when(col(disputed), "disputed").when(col(payout) == 1, "win").when(col(payout) == 0, "loss").otherwise("stuck")


def fill_price(collateral, shares) -> Column:
    """Collateral over shares where 0 < price <= 1.0001. A known-unsafe decoder: never a price to trust."""
    p = F.try_divide(col(collateral).cast("double"), col(shares).cast("double"))
    return F.when((p > 0) & (p <= 1.0001), p)


def back_lay_mid(back, lay, strict: bool = True) -> Column:
    a, b = F.try_divide(F.lit(1.0), col(back)), F.try_divide(F.lit(1.0), col(lay))
    both = (a + b) / 2
    return both if strict else F.coalesce(both, a, b)


def impute_complement(known, overround) -> Column:
    p = col(overround) - col(known)
    return F.when((p > 0) & (p < 1), p)


def parimutuel_prob(yes, no) -> Column:
    return F.try_divide(col(yes).cast("double"), (col(yes) + col(no)).cast("double"))


def certainty_or_pair(hours, last, bid, ask) -> Column:
    return (col(hours) > 0) & (col(hours) <= 168) & ((col(last) >= 0.95) | (col(last) <= 0.05) | (col(bid) + col(ask) < 1.05))


def detect_entry(df: DataFrame, last: str, bid: str, ask: str, hours: str, volume: str) -> DataFrame:
    """Side from the last price, the price to buy it, and the rows that qualify."""
    d = df.withColumn("side", F.when(col(last) > 0.95, "YES").when(col(last) < 0.05, "NO"))
    d = d.withColumn("ask_for_buy", F.when(F.col("side") == "YES", col(ask)).when(F.col("side") == "NO", 1 - col(bid)))
    return d.where(F.col("side").isNotNull() & (col(hours) > 0) & (col(hours) < 24) & (col(volume) >= 1000) & F.col("ask_for_buy").between(0.95, 0.97))


def arb_qualify(df: DataFrame) -> DataFrame:
    """edge_pct >= 1, 0.5 <= days <= 90, depth > 0, the sum of asks at least 0.05."""
    return df.where("edge_pct >= 1 AND days BETWEEN 0.5 AND 90 AND depth > 0 AND sum_asks >= 0.05")


def clean_pairs(df: DataFrame, volume: str, spread: str) -> DataFrame:
    return df.where((col(volume) >= 1) & (F.abs(col(spread)) <= 0.15))


def since(df: DataFrame, ts: str, now: str, span: str) -> DataFrame:
    """Rows of the last ``span`` ("7d", "24h") before ``now``."""
    n, unit = int(span[:-1]), {"d": "DAYS", "h": "HOURS", "m": "MINUTES"}[span[-1]]
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {n} {unit}"))


def fanout_legs(ticks: DataFrame, legs: DataFrame) -> DataFrame:
    """Each tick for every event that has its asset as a leg; works for a stream against a static leg table too."""
    return ticks.join(legs, "asset")


def pair_sum_edge(yes: DataFrame, no: DataFrame, key: str) -> DataFrame:
    """Minimum asks of both sides (thousandths) that cost under 1 together: shares and profit of the pair."""
    a = yes.groupBy(key).agg(F.min(F.struct("ask", "size")).alias("y"))
    b = no.groupBy(key).agg(F.min(F.struct("ask", "size")).alias("n"))
    j = a.join(b, key).withColumn("total", F.col("y.ask") + F.col("n.ask")).where("total < 1000")
    shares = F.least("y.size", "n.size")
    return j.select(key, "total", shares.alias("shares"), ((1000 - F.col("total")) * shares).alias("profit_milli"))


def candle_vwap(candles: DataFrame, key: str) -> DataFrame:
    """Volume-weighted close, else the mean reference close, and which one it is."""
    v = F.sum("volume")
    w = F.try_divide(F.sum(F.col("close") * F.col("volume")).cast("double"), v.cast("double"))
    return candles.groupBy(key).agg(F.round(F.coalesce(F.when(v > 0, w), F.sum("reference") / F.count("*")), 4).alias("price"), F.when(v > 0, "traded").otherwise("reference").alias("source"))


def detection_forecast(detections: DataFrame, key: str, target: int) -> DataFrame:
    """Detections and distinct keys per hour, hours to a target sample, and a warning beyond a week."""
    hours = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 3.6e9
    one = detections.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), hours.alias("hours"))
    rate = F.try_divide(F.col("keys").cast("double"), F.col("hours"))
    return one.select("n", "keys", F.round(F.try_divide(F.col("n").cast("double"), F.col("hours")), 4).alias("per_hour"), F.round(F.try_divide(F.lit(float(target)), rate), 4).alias("hours_needed"), F.coalesce(F.try_divide(F.lit(float(target)), rate) > 168, F.lit(True)).alias("warn"))


def winner_from_scores(home, away, done) -> Column:
    return F.when(col(done), F.when(col(home) > col(away), "home").when(col(home) < col(away), "away").otherwise("draw"))


def expiry_error(samples: DataFrame, markets: DataFrame, offsets_s: list[int], mispriced: float = 0.15, actionable: float = 0.20, spot: DataFrame | None = None, least_z: float = 1.0) -> DataFrame:
    """Price at fixed offsets before each market's end against its outcome: one as-of lookup per exploded offset. Mispriced from
    one error on; actionable from a larger one on where the spot's z (``spot``: market_id, z) is ``least_z`` or more in either
    direction; without spot scores, or without one for the market, nothing is actionable."""
    m = markets.where("yes is not null").withColumn("offset", F.explode(F.array(*[F.lit(x) for x in offsets_s])))
    m = m.select("market_id", "yes", "offset", F.timestamp_micros(F.unix_micros("end_ts") - F.col("offset").cast("long") * 1_000_000).alias("ts"))
    j = asof_backward(m, samples, "market_id", "ts", "price_milli", None, "line").where("price_milli is not null")
    j = j.hint("merge").join(spot.select("market_id", "z").hint("merge"), "market_id", "left") if spot is not None else j.withColumn("z", F.lit(None).cast("double"))
    err = F.abs(F.col("price_milli") / 1000 - F.col("yes"))
    acts = F.coalesce((err >= actionable) & (F.abs("z") >= least_z), F.lit(False))
    return j.select("market_id", "offset", F.round(err, 4).alias("error"), (err >= mispriced).alias("mispriced"), F.col("z").alias("spot_z"), acts.alias("actionable"))
