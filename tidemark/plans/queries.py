"""The registered queries: each operator on the bound views, with the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A, calibration as C, joins as J, ordered as O
from tidemark.plans.bindings import LEG, MARKET, TICK, TRADE, Tables, sql

def r(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}
DAY = 86_400
WIN = f"snap AS (SELECT market_id, CASE WHEN outcome_index = 1 THEN 1000 - price_milli ELSE price_milli END AS ym, size, cents, row_number() OVER (PARTITION BY market_id ORDER BY cents) AS rn, count(*) OVER (PARTITION BY market_id) AS nn FROM (SELECT t.* FROM v_trade t JOIN v_market m USING (market_id) WHERE abs(epoch_us(t.ts) - epoch_us(m.end_ts)) <= {180 * DAY * 1_000_000} AND (CASE WHEN outcome_index = 1 THEN 1000 - price_milli ELSE price_milli END) BETWEEN 1 AND 1000) x)"
VWAP = "vwap AS (SELECT market_id, CASE WHEN sum(size) > 0 THEN ((200 * sum(ym * size) + sum(size)) // (2 * sum(size))) / 100000 ELSE ((200 * sum(ym) + count(*)) // (2 * count(*))) / 100000 END AS price, count(*) AS n_trades, round(sum(cents) / 100, 2) AS total_usd, round(max(cents) / 100, 2) AS max_usd, round(max(CASE WHEN rn = nn // 2 + 1 THEN cents END) / 100, 2) AS median_usd FROM snap GROUP BY market_id HAVING count(*) >= 3)"
SHOT = "shot AS (SELECT v.*, m.yes, m.category, m.volume, m.end_ts, m.event_id FROM vwap v JOIN v_market m USING (market_id))"
BUCKET = "CASE WHEN price >= 0 AND price < 1 THEN least(CAST(floor(round(price * 1000) / 50) AS INT), 19) ELSE 19 END"
LABEL = f"printf('%.2f-%.2f', ({BUCKET}) * 5 / 100.0, (({BUCKET}) * 5 + 5) / 100.0)"




def q(name: str, *views: str, body: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql(*views, body=body) if body else None)
        return f

    return add


def snapshots(t: Tables) -> DataFrame:
    """The calibration family's input: the anchor price of each market beside its outcome."""
    return C.anchor_vwap(t.trade, t.market, 180 * DAY, 180 * DAY).join(t.market, "market_id")


SNAP = (MARKET, TRADE, WIN, VWAP, SHOT)
CAL = f"SELECT {{keys}}{LABEL} AS bucket, count(*) AS n, avg(CAST(yes AS DOUBLE)) AS rate, sum(CAST(round(price * 100000) AS BIGINT)) AS p_sum, max(({BUCKET}) * 0.05 + 0.025) AS mid FROM {{src}} WHERE yes IS NOT NULL AND price IS NOT NULL GROUP BY ALL"
CAL_OUT = f"bucket, n, {r('rate')} AS yes_rate, {r('p_sum / n / 100000')} AS mean_price, {r('rate - mid')} AS deviation, round((rate - mid) / sqrt(mid * (1 - mid) / n), 4) AS z, round((rate - mid) / sqrt((CASE WHEN rate > 0 AND rate < 1 THEN rate ELSE mid END) * (1 - CASE WHEN rate > 0 AND rate < 1 THEN rate ELSE mid END) / n), 4) AS z_wald"

# -- calibration ---------------------------------------------------------------------------------------------------
q("anchor_vwap", *SNAP[:4], body="SELECT * FROM vwap")(lambda t: C.anchor_vwap(t.trade, t.market, 180 * DAY, 180 * DAY))
q("calibration_table", *SNAP, f"c AS ({CAL.format(keys='', src='shot')})", body=f"SELECT {CAL_OUT} FROM c")(lambda t: C.calibration_table(snapshots(t)))
q("stratified_calibration", *SNAP, f"c AS ({CAL.format(keys='category, ', src='shot')})", body=f"""
SELECT category, {CAL_OUT} FROM c WHERE n >= 5
""")(
    lambda t: C.calibration_table(snapshots(t), ["category"], 5))
q("z_null", *SNAP, f"c AS ({CAL.format(keys='', src='shot')})", body="""
SELECT bucket, round((rate - mid) / sqrt(mid * (1 - mid) / n), 4) AS z FROM c
""")(
    lambda t: C.calibration_table(snapshots(t)).select("bucket", "z"))
q("z_wald", *SNAP, f"c AS ({CAL.format(keys='', src='shot')})", body=f"SELECT bucket, z_wald FROM (SELECT {CAL_OUT} FROM c)")(lambda t: C.calibration_table(snapshots(t)).select("bucket", "z_wald"))
q("z_abs", *SNAP, f"c AS ({CAL.format(keys='', src='shot')})", body="""
SELECT bucket, abs(round((rate - mid) / sqrt(mid * (1 - mid) / n), 4)) AS z FROM c
""")(
    lambda t: C.calibration_table(snapshots(t)).select("bucket", F.abs("z").alias("z")))
q("all_strata", *SNAP, body=f"""
SELECT category, {LABEL} AS bucket, count(*) AS n, floor(avg(CAST(yes AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS yes_rate FROM shot WHERE yes IS NOT NULL GROUP
    BY 1, 2 UNION ALL SELECT NULL, {LABEL}, count(*), floor(avg(CAST(yes AS DOUBLE)) * 1e6 + 0.5) / 1e6 FROM shot WHERE yes IS NOT NULL GROUP BY 2
""")(
    lambda t: C.all_strata(snapshots(t), ["category"]).drop("gid"))
q("critical_bucket_row", *SNAP, f"c AS ({CAL.format(keys='category, ', src='shot')})", body=f"""
SELECT s.category, coalesce(n, 0) AS n, yes_rate, deviation, CASE WHEN coalesce(n, 0) < 20 THEN 'insufficient' ELSE 'ok' END AS verdict FROM (SELECT
    DISTINCT category FROM v_market) s LEFT JOIN (SELECT category, {CAL_OUT} FROM c) x ON s.category = x.category AND bucket = '0.55-0.60'
""")(
    lambda t: C.critical_bucket(snapshots(t), t.market.select("category").distinct(), "category", "0.55-0.60"))
q("zone_stats", *SNAP, body="""
SELECT zone, count(*) AS n, floor(sum(CAST(round(price * 100000) AS BIGINT)) / count(*) / 100000 * 1e6 + 0.5) / 1e6 AS mean_price, floor(avg(CAST(yes
    AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS yes_rate, floor((avg(CAST(yes AS DOUBLE)) - 0.55) * 1e6 + 0.5) / 1e6 AS deviation FROM shot, (VALUES ('mid',
    0.4, 0.6), ('fav', 0.6, 0.8), ('all', 0.0, 1.0)) z(zone, lo, hi) WHERE yes IS NOT NULL AND price >= lo AND price < hi GROUP BY zone
""")(
    lambda t: C.zone_stats(snapshots(t), {"mid": (0.4, 0.6), "fav": (0.6, 0.8), "all": (0.0, 1.0)}, 0.55))
q("price_outcome_corr", *SNAP, body="""
SELECT category, count(*) AS n, round(corr(price, CAST(yes AS DOUBLE)), 4) AS corr FROM shot WHERE yes IS NOT NULL GROUP BY category
""")(
    lambda t: C.price_outcome_corr(snapshots(t), "category"))
q("category_summary", *SNAP, body="""
SELECT category, count(*) AS n, floor(avg(CAST(yes AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS yes_rate, floor(sum(CAST(round(price * 100000) AS BIGINT)) /
    count(*) / 100000 * 1e6 + 0.5) / 1e6 AS mean_price, floor((avg(CAST(yes AS DOUBLE)) - sum(CAST(round(price * 100000) AS BIGINT)) / count(*) /
    100000) * 1e6 + 0.5) / 1e6 AS edge, round(sum(CAST(round(volume * 100) AS BIGINT)) / 100, 2) AS volume FROM shot WHERE yes IS NOT NULL GROUP BY
    category HAVING count(*) >= 30
""")(
    lambda t: C.category_summary(snapshots(t), "category"))
q("top_actionable_cells", *SNAP, f"c AS ({CAL.format(keys='', src='shot')})", body=f"""
SELECT {CAL_OUT} FROM c WHERE n >= 8 ORDER BY abs(floor((rate - mid) * 1e6 + 0.5) / 1e6) DESC, bucket LIMIT 5
""")(
    lambda t: C.top_actionable(C.calibration_table(snapshots(t)), 8, 5))
q("preclose_vwap", MARKET, TRADE, body=f"""
SELECT market_id, CASE WHEN sum(size) > 0 THEN ((200 * sum(ym * size) + sum(size)) // (2 * sum(size))) / 100000 ELSE ((200 * sum(ym) + count(*)) // (2
    * count(*))) / 100000 END AS vwap, last(ym ORDER BY ts, line, ym) AS last_milli, count(*) AS n_trades FROM (SELECT t.*, CASE WHEN outcome_index =
    1 THEN 1000 - price_milli ELSE price_milli END AS ym FROM v_trade t JOIN v_market m USING (market_id) WHERE epoch_us(t.ts) - epoch_us(m.end_ts)
    BETWEEN {-365 * DAY * 1_000_000} AND 0) WHERE ym BETWEEN 1 AND 1000 GROUP BY market_id
""")(
    lambda t: C.preclose_vwap(t.trade, t.market, 365 * DAY))
q("anchor_curve", MARKET, TRADE, body=f"""
SELECT anchor_name, market_id, CASE WHEN sum(size) > 0 THEN ((200 * sum(ym * size) + sum(size)) // (2 * sum(size))) / 100000 ELSE ((200 * sum(ym) +
    count(*)) // (2 * count(*))) / 100000 END AS price, count(*) AS n_trades FROM (SELECT a.anchor_name, t.*, CASE WHEN outcome_index = 1 THEN 1000 -
    price_milli ELSE price_milli END AS ym FROM v_trade t JOIN v_market m USING (market_id), (VALUES ('T-90d', {90 * DAY}), ('T-0', 0)) a(anchor_name,
    off) WHERE abs(epoch_us(t.ts) - epoch_us(m.end_ts) + CAST(off AS BIGINT) * 1000000) <= {60 * DAY * 1_000_000}) WHERE ym BETWEEN 1 AND 1000 GROUP
    BY ALL
""")(
    lambda t: C.anchor_curve(t.trade, t.market, {"T-90d": 90 * DAY, "T-0": 0}, 60 * DAY))
q("equal_count_slices", MARKET, body="""
SELECT market_id, category, (CASE WHEN rn >= round_even(n * 1 / 3, 0) THEN 1 ELSE 0 END + CASE WHEN rn >= round_even(n * 2 / 3, 0) THEN 1 ELSE 0 END)
    AS slice FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY end_ts, market_id) - 1 AS rn, count(*) OVER (PARTITION BY category) AS
    n FROM v_market WHERE yes IS NOT NULL)
""")(
    lambda t: C.equal_count_slices(t.market.where("yes is not null"), ["end_ts", "market_id"], 3, ["category"]).select("market_id",
        "category", "slice"))
q("trend_direction", MARKET, "s AS (SELECT category, yes, (CASE WHEN rn >= round_even(n * 1 / 3, 0) THEN 1 ELSE 0 END + CASE WHEN rn >= round_even(n * 2 / 3, 0) THEN 1 ELSE 0 END) AS slice FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY end_ts, market_id) - 1 AS rn, count(*) OVER (PARTITION BY category) AS n FROM v_market WHERE yes IS NOT NULL))", "r AS (SELECT category, slice, avg(CAST(yes AS DOUBLE)) AS rate FROM s GROUP BY ALL)", body="""
SELECT category, change, CASE WHEN change > 0.05 THEN 'strengthening' WHEN change < -0.05 THEN 'decaying' ELSE 'stable' END AS trend FROM (SELECT
    category, round(last(rate ORDER BY slice) - first(rate ORDER BY slice), 6) AS change FROM r GROUP BY category)
""")(
    lambda t: C.trend_direction(C.equal_count_slices(t.market.where("yes is not null"), ["end_ts", "market_id"], 3, ["category"]),
        ["category"]))
q("forward_vs_hist", *SNAP, f"a AS ({CAL.format(keys='', src='(SELECT * FROM shot WHERE epoch_us(end_ts) >= 883612800000000)')})", f"b AS ({CAL.format(keys='', src='(SELECT * FROM shot WHERE epoch_us(end_ts) < 883612800000000)')})", body="""
SELECT a.bucket, a.n, floor(a.rate * 1e6 + 0.5) / 1e6 AS yes_rate, floor(b.rate * 1e6 + 0.5) / 1e6 AS hist_rate, round(floor(a.rate * 1e6 + 0.5) / 1e6
    - floor(b.rate * 1e6 + 0.5) / 1e6, 6) AS delta FROM a LEFT JOIN b ON a.bucket = b.bucket
""")(
    lambda t: C.forward_vs_hist(snapshots(t).where("unix_micros(end_ts) >= 883612800000000"), snapshots(t).where("unix_micros(end_ts) < 883612800000000")))
q("merge_weighted_parts", TRADE, body="""
SELECT market_id, round(sum(price_milli) / count(*), 4) AS mean_milli, count(*) AS n, last(price_milli ORDER BY ts, line % 2, line, price_milli) AS
    last_milli FROM v_trade GROUP BY market_id
""")(
    lambda t: C.merge_weighted_parts(t.trade.groupBy("market_id", (F.col("line") % 2).alias("part")).agg((F.sum("price_milli") / F.count("*"))
        .alias("mean_milli"), F.count("*").alias("n"), F.max_by("price_milli", F.struct("ts", "line", "price_milli")).alias("last_milli"),
        F.max("ts").alias("last_ts")), "market_id"))
q("join_time_window", MARKET, TRADE, body=f"""
SELECT market_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM v_trade t JOIN v_market m USING (market_id) WHERE epoch_us(t.ts) -
    epoch_us(m.end_ts) BETWEEN {-30 * DAY * 1_000_000} AND {90 * DAY * 1_000_000} GROUP BY market_id
""")(
    lambda t: C.join_time_window(t.trade, t.market, 30 * DAY, 90 * DAY).groupBy("market_id").agg(F.count("*").alias("n"), F.sum("cents")
        .alias("cents")))
q("yes_equivalent_price", TRADE, body="""
SELECT market_id, line, CASE WHEN outcome_index = 1 THEN 1000 - price_milli ELSE price_milli END AS yes_milli FROM v_trade WHERE (CASE WHEN
    outcome_index = 1 THEN 1000 - price_milli ELSE price_milli END) BETWEEN 1 AND 1000
""")(
    lambda t: C.yes_equivalent(t.trade).select("market_id", "line", "yes_milli"))
q("bucket_5pp", TRADE, body=f"""
SELECT bucket, count(*) AS n FROM (SELECT {LABEL} AS bucket FROM (SELECT price_milli / 1000 AS price FROM v_trade)) GROUP BY bucket
""")(
    lambda t: t.trade.select(S.bucket_label(F.col("price_milli") / 1000).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")))
q("bucket_5pp_int", TRADE, body=f"""
SELECT bucket, count(*) AS n FROM (SELECT {BUCKET} AS bucket FROM (SELECT price_milli / 1000 AS price FROM v_trade)) GROUP BY bucket
""")(
    lambda t: t.trade.select(S.bucket_index(F.col("price_milli") / 1000).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")))
q("bucket_custom", TRADE, body="""
SELECT b, count(*) AS n FROM (SELECT CASE WHEN price_milli <= 50 THEN 'low' WHEN price_milli <= 500 THEN 'half' WHEN price_milli <= 950 THEN 'over'
    ELSE 'top' END AS b FROM v_trade) GROUP BY b
""")(
    lambda t: t.trade.select(S.bucket_custom("price_milli", [50, 500, 950], ["low", "half", "over", "top"], "right").alias("b"))
        .groupBy("b").agg(F.count("*").alias("n")))
q("tier_assign", MARKET, body="""
SELECT market_id, CASE WHEN volume < 50000 THEN 'small' WHEN volume < 200000 THEN 'mid' ELSE 'large' END AS tier FROM v_market
""")(
    lambda t: t.market.select("market_id", S.bucket_custom("volume", [50_000, 200_000], ["small", "mid", "large"]).alias("tier")))

# -- scalar functions ----------------------------------------------------------------------------------------------
q("fee_p1mp", TRADE, body="""
SELECT market_id, line, round(0.02 * (price_milli / 1000) * (1 - price_milli / 1000), 8) AS fee FROM v_trade
""")(
    lambda t: t.trade.select("market_id", "line", F.round(S.fee_quadratic(200.0, F.col("price_milli") / 1000), 8).alias("fee")))
q("fee_min", TRADE, body="""
SELECT market_id, line, round(0.02 * least(price_milli / 1000, 1 - price_milli / 1000), 8) AS fee FROM v_trade
""")(
    lambda t: t.trade.select("market_id", "line", F.round(S.fee_min(200.0, F.col("price_milli") / 1000), 8).alias("fee")))
q("normalize_epoch", TICK, body="""
SELECT id, CASE WHEN v > 1e12 THEN v / 1000 ELSE v END AS s FROM (SELECT id, CASE WHEN id % 2 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) //
    1000000 END AS v FROM v_tick)
""")(
    lambda t: t.tick.select("id", S.normalize_epoch(F.expr("CASE WHEN id % 2 = 0 THEN unix_micros(ts) div 1000 ELSE unix_micros(ts) div 1000000 END"))
        .cast("double").alias("s")))
q("mid_and_spread", TRADE, body="""
SELECT market_id, line, round(CASE WHEN b > 0 AND b < a AND a < 1 THEN (a + b) / 2 ELSE price_milli / 1000 END, 6) AS mid, round(CASE WHEN b > 0 AND b
    < a AND a < 1 THEN a - b END, 6) AS spread FROM (SELECT *, price_milli / 1000 - size / 500 AS b, price_milli / 1000 + size / 400 AS a FROM
    v_trade)
""")(
    lambda t: t.trade.withColumns({"b": F.expr("price_milli / 1000 - size / 500"), "a": F.expr("price_milli / 1000 + size / 400")})
        .select("market_id", "line", *[F.round(c, 6).alias(n) for c, n in zip(S.mid_and_spread("b", "a", F.col("price_milli") / 1000),
        ("mid", "spread"))]))
q("bytes_to_hex", TRADE, body="""
SELECT DISTINCT wallet, lower(hex(CAST(wallet AS VARCHAR))) AS hex FROM v_trade
""")(
    lambda t: t.trade.select("wallet").distinct().select("wallet", S.bytes_to_hex(F.col("wallet").cast("string").cast("binary"))
        .alias("hex")))
q("tokenize_stop", body="""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(p_name), '\\([^)]*\\)', ' ',
    'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and')))), ' ') AS tokens FROM part
""")(
    lambda t: t.part.select("p_partkey", F.concat_ws(" ", S.tokenize("p_name", ["the", "and"])).alias("tokens")))
q("categorize_rules", body="""
SELECT label, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(p_type), '^(small|medium).*(tin|nickel)') THEN 'soft' WHEN
    regexp_matches(lower(p_type), 'brass|copper') THEN 'warm' WHEN regexp_matches(lower(p_type), 'steel') THEN 'hard' ELSE 'other' END AS label FROM
    part) GROUP BY label
""")(
    lambda t: t.part.select(S.rules(F.lower("p_type"), [("^(small|medium).*(tin|nickel)", "soft"), ("brass|copper", "warm"), ("steel",
        "hard")]).alias("label")).groupBy("label").agg(F.count("*").alias("n")))
q("match_with_exclusions", body="""
SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^(S|M|L|E|P)') AND NOT regexp_matches(p_type, 'SMALL|ECONOMY')
""")(
    lambda t: t.part.where(F.col("p_type").rlike("^(S|M|L|E|P)") & ~F.col("p_type").rlike("SMALL|ECONOMY")).select("p_partkey"))
q("slug_like", body="""
SELECT p_partkey FROM part WHERE p_type LIKE '%STEEL%' OR p_type LIKE 'SMALL%'
""")(
    lambda t: t.part.where(F.col("p_type").like("%STEEL%") | F.col("p_type").like("SMALL%")).select("p_partkey"))
q("overround_normalize", body="""
SELECT l_orderkey, l_linenumber, round(1 / (l_quantity + 1) / o, 6) AS prob, round(o, 6) AS overround FROM (SELECT *, sum(1 / (l_quantity + 1)) OVER
    (PARTITION BY l_orderkey) AS o FROM lineitem)
""")(
    lambda t: A.normalized_odds(t.lineitem.withColumn("odds", F.col("l_quantity") + 1), ["l_orderkey"], "odds").select("l_orderkey",
        "l_linenumber", F.round("prob", 6).alias("prob"), F.round("overround", 6).alias("overround")))
q("auto_name_flag", body="""
SELECT c_custkey, (c_name IS NULL OR c_name = '' OR (starts_with(c_name, '0x') AND length(c_name) >= 40)) AS auto FROM customer
""")(
    lambda t: t.customer.select("c_custkey", S.auto_name("c_name").alias("auto")))
q("skip_reason_counts", TRADE, body="""
SELECT CASE WHEN price_milli = 0 THEN 'zero-price' WHEN size < 5 THEN 'thin' WHEN cents < 500000 THEN 'cheap' ELSE 'kept' END AS reason, count(*) AS n
    FROM v_trade GROUP BY 1
""")(
    lambda t: A.skip_reasons(t.trade, {"zero-price": F.col("price_milli") == 0, "thin": F.col("size") < 5, "cheap": F.col("cents") < 500_000}))
q("liquidity_sanity_filter", TRADE, body="""
SELECT market_id, count(*) AS n FROM (SELECT *, sum(price_milli) OVER (PARTITION BY market_id) AS s FROM v_trade WHERE size >= 2) WHERE s BETWEEN 980
    AND 2500 GROUP BY market_id
""")(
    lambda t: (lambda x: x.join(x.groupBy("market_id").agg(F.sum("price_milli").alias("s")).where("s between 980 and 2500"),
        "market_id", "left_semi").groupBy("market_id").agg(F.count("*").alias("n")))(t.trade.where("size >= 2")))
q("single_winner_filter", MARKET, body="""
SELECT event_id, count(*) AS n FROM v_market GROUP BY event_id HAVING sum(yes) = 1 AND count(*) > 1
""")(
    lambda t: t.market.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("yes").alias("w")).where("w = 1 and n > 1").drop("w"))

# -- joins ---------------------------------------------------------------------------------------------------------
q("join_inner_equi", MARKET, TRADE, body="""
SELECT category, count(*) AS n FROM v_trade JOIN v_market USING (market_id) GROUP BY category
""")(
    lambda t: t.trade.join(t.market, "market_id").groupBy("category").agg(F.count("*").alias("n")))
q("join_left_equi", MARKET, TRADE, body="""
SELECT count(*) AS n, count(*) FILTER (WHERE t.market_id IS NULL) AS missing FROM v_market m LEFT JOIN (SELECT DISTINCT market_id FROM v_trade WHERE
    size > 45) t ON m.market_id = t.market_id
""")(
    lambda t: t.market.join(t.trade.where("size > 45").select("market_id").distinct().withColumn("hit", F.lit(1)), "market_id",
        "left").agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("missing")))
q("join_semi", MARKET, TRADE, body="""
SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM v_trade WHERE market_id IN (SELECT market_id FROM v_market WHERE yes = 1)
""")(
    lambda t: J.semi(t.trade, t.market.where("yes = 1"), "market_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")))
q("join_anti", MARKET, TRADE, body="""
SELECT market_id FROM v_market m WHERE NOT EXISTS (SELECT 1 FROM v_trade t WHERE t.market_id = m.market_id)
""")(
    lambda t: J.anti(t.market, t.trade, "market_id").select("market_id"))
q("join_broadcast_lookup", body="""
SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")(
    lambda t: t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name").agg(F.count("*").alias("n")))
q("scan_semi_filtered", TRADE, body="""
SELECT wallet, count(*) AS n FROM v_trade WHERE market_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY wallet
""")(
    lambda t: J.semi(t.trade, t.market.where("category = '1-URGENT'"), "market_id").groupBy("wallet").agg(F.count("*").alias("n")))
q("join_composite_key", TRADE, body="""
SELECT a.market_id, a.wallet, a.cents, b.size FROM (SELECT market_id, wallet, first(cents ORDER BY line, cents) AS cents FROM v_trade GROUP BY ALL) a
    JOIN (SELECT market_id, wallet, first(size ORDER BY line, size) AS size FROM v_trade WHERE outcome_index = 1 GROUP BY ALL) b USING (market_id,
    wallet)
""")(
    lambda t: J.composite_key(t.trade.select("market_id", "wallet", "line", "cents"), t.trade.where("outcome_index = 1").select("market_id",
        "wallet", "line", "size"), ["market_id", "wallet"], "line").select("market_id", "wallet", "cents", "size"))
q("join_first_in_range", TICK, body="""
SELECT l.id, round((epoch_us(l.ts) - min(epoch_us(r.ts))) / 60e6, 4) AS lead_min FROM v_tick l LEFT JOIN (SELECT * FROM v_tick WHERE asset =
    'purchase') r ON l.actor = r.actor AND epoch_us(r.ts) BETWEEN epoch_us(l.ts) - 3600000000 * 6 AND epoch_us(l.ts) + 600000000 WHERE l.asset <>
    'purchase' GROUP BY l.id, l.ts
""")(
    lambda t: J.first_in_range(t.tick.where("asset <> 'purchase'").select("id", "actor", "ts"), t.tick.where("asset = 'purchase'"),
        "actor", "ts", 6 * 3_600_000_000, 600_000_000).select("id", "lead_min"))
q("join_range_exclusion", TICK, body="""
SELECT id FROM v_tick l WHERE asset <> 'purchase' AND NOT EXISTS (SELECT 1 FROM v_tick r WHERE r.asset = 'purchase' AND r.actor = l.actor AND
    epoch_us(r.ts) BETWEEN epoch_us(l.ts) - 7200000000 AND epoch_us(l.ts) + 600000000)
""")(
    lambda t: J.range_exclusion(t.tick.where("asset <> 'purchase'"), t.tick.where("asset = 'purchase'"), "actor", "ts",
        7_200_000_000, 600_000_000).select("id"))
q("join_self_comove", TRADE, body="""
SELECT market_id, line, CAST((SELECT count(DISTINCT wallet) FROM v_trade b WHERE b.market_id = a.market_id AND b.size >= 25) AS BIGINT) - CASE WHEN
    size >= 25 THEN 1 ELSE 0 END AS others FROM v_trade a
""")(
    lambda t: J.comove(t.trade.withColumn("theme", F.lit(1)), "theme", "market_id", "wallet", "size", 25).select("market_id",
        "line", "others"))
q("join_pre_post", MARKET, body="""
SELECT pre_n, post_n, round(pre_mean, 4) AS pre_mean, round(post_mean, 4) AS post_mean, CASE WHEN abs((post_mean - pre_mean) / pre_mean) > 0.1 OR
    post_n < 0.8 * pre_n THEN 'BREAKING' ELSE 'CLEAN' END AS verdict FROM (SELECT count(*) AS pre_n, avg(yes) AS pre_mean FROM v_market WHERE
    market_id % 2 = 0), (SELECT count(*) AS post_n, avg(yes) AS post_mean FROM v_market WHERE market_id % 2 = 1)
""")(
    lambda t: J.pre_post(t.market.where("market_id % 2 = 0"), t.market.where("market_id % 2 = 1"), "yes"))
q("join_grid", TRADE, body="""
SELECT fee, cap, count(*) AS n FROM v_trade, (VALUES (0), (200)) f(fee), (VALUES (10), (20), (40)) c(cap) WHERE size <= cap GROUP BY ALL
""")(
    lambda t: J.grid(t.trade, fee=[0, 200], cap=[10, 20, 40]).where("size <= cap").groupBy("fee", "cap").agg(F.count("*").alias("n")))
q("join_token_exact", body="""
WITH k AS (SELECT array_to_string(list_sort(string_split(p_type, ' ')), ' ') AS key, p_size % 7 AS day, p_brand AS venue,
    arg_max(CAST(round(p_retailprice * 100) AS BIGINT), CAST(p_size AS BIGINT) * 100000000 + CAST(round(p_retailprice * 100) AS BIGINT)) AS c FROM
    part GROUP BY ALL) SELECT key, day, max(c) FILTER (WHERE venue = 'Brand#1') AS "Brand#1", max(c) FILTER (WHERE venue = 'Brand#2') AS "Brand#2"
    FROM k WHERE venue IN ('Brand#1', 'Brand#2') GROUP BY key, day HAVING count(*) >= 2
""")(
    lambda t: J.token_exact(t.part.select(F.split("p_type", " ").alias("tokens"), (F.col("p_size") % 7).alias("day"), F.col("p_brand")
        .alias("venue"), F.col("p_size").alias("v"), F.round(F.col("p_retailprice") * 100).cast("long").alias("c")), "venue",
        "tokens", "day", "v", "c", ["Brand#1", "Brand#2"]))
q("upsert_first_wins", TICK, body="""
SELECT actor, asset, first(cents ORDER BY ts, id) AS cents FROM v_tick GROUP BY ALL
""")(
    lambda t: J.upsert_first(t.tick, ["actor", "asset"], ["ts", "id"]).select("actor", "asset", "cents"))
q("upsert_last_wins", TICK, body="""
SELECT actor, asset, last(cents ORDER BY ts, id) AS cents FROM v_tick GROUP BY ALL
""")(
    lambda t: J.upsert_last(t.tick, ["actor", "asset"], ["ts", "id"]).select("actor", "asset", "cents"))

# -- joins that need two sides of one table -----------------------------------------------------------------------
q("join_token_overlap", body="""
WITH a AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS t FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS
    b_key, unnest(list_distinct(string_split(p_name, ' '))) AS t FROM part WHERE p_partkey % 2 = 1), p AS (SELECT p_partkey, b_key, count(*) AS shared
    FROM a JOIN b USING (t) GROUP BY ALL HAVING count(*) >= 2) SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY shared DESC, b_key) AS
    rank FROM p
""")(
    lambda t: J.token_pairs(t.part.where("p_partkey % 2 = 0").select("p_partkey", F.split("p_name", " ").alias("tokens")), t.part.where("p_partkey % 2 = 1")
        .select(F.col("p_partkey").alias("b_key"), F.split("p_name", " ").alias("tokens")), "p_partkey", "b_key"))
KEYWORDS = """n AS (SELECT doc_id AS news_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents),
k AS (SELECT item_id AS market_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM benchmark),
s AS (SELECT market_id, greatest(5, CAST(ceil(count(*) * 0.6 - 1e-9) AS BIGINT)) AS need FROM k GROUP BY market_id)"""
q("join_keyword_match_share", KEYWORDS, body="""
SELECT news_id, market_id, count(*) AS hits FROM n JOIN k USING (w) JOIN s USING (market_id) GROUP BY news_id, market_id, need HAVING count(*) >= need
""")(lambda t: J.keyword_match(
    t.documents.select(F.col("doc_id").alias("news_id"), F.split(F.lower("text"), " ").alias("tokens"), F.col("text").alias("title")),
    t.benchmark.select(F.col("item_id").alias("market_id"), F.split(F.lower("text"), " ").alias("keywords")), 5, 0.6))
q("join_asof_backward", TICK, body="""
SELECT p.id, CASE WHEN epoch_us(p.ts) - epoch_us(s.ts) <= 3600000000 THEN s.cents END AS cents FROM (SELECT id, ts, actor FROM v_tick WHERE asset =
    'purchase') p ASOF LEFT JOIN (SELECT actor, ts, last(cents ORDER BY id) AS cents FROM v_tick WHERE asset <> 'purchase' GROUP BY ALL) s ON p.actor
    = s.actor AND p.ts >= s.ts
""")(
    lambda t: J.asof_backward(t.tick.where("asset = 'purchase'").select("id", "ts", "actor"), t.tick.where("asset <> 'purchase'"),
        "actor", "ts", "cents", 3_600_000_000, "id").select("id", "cents"))
q("upsert_coalesce", MARKET, body="""
SELECT coalesce(o.k, n.k) AS k, coalesce(o.s, n.s) AS first_seen, coalesce(n.s, o.s) AS last_seen, coalesce(n.yes, o.yes) AS yes, o.k IS NULL AS
    is_new FROM (SELECT event_id AS k, min(market_id) AS s, min(yes) AS yes FROM v_market WHERE market_id % 2 = 0 GROUP BY 1) o FULL JOIN (SELECT
    event_id AS k, max(market_id) AS s, max(yes) AS yes FROM v_market WHERE market_id % 2 = 1 GROUP BY 1) n ON o.k = n.k
""")(
    lambda t: J.upsert_coalesce(t.market.where("market_id % 2 = 0").groupBy(F.col("event_id").alias("k")).agg(F.min("market_id")
        .alias("first_seen"), F.min("market_id").alias("last_seen"), F.min("yes").alias("yes")), t.market.where("market_id % 2 = 1")
        .groupBy(F.col("event_id").alias("k")).agg(F.max("market_id").alias("s"), F.max("yes").alias("yes")), "k", "s"))
q("sort_multi", MARKET, body="""
SELECT market_id, yes, volume FROM v_market ORDER BY yes DESC NULLS LAST, volume DESC, market_id
""")(
    lambda t: t.market.orderBy(F.desc_nulls_last("yes"), F.desc("volume"), "market_id").select("market_id", "yes", "volume"))
q("join_match_news_ts", TICK, body="""
SELECT asset, epoch_us(ts) // 86400000000 AS day, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM v_tick GROUP BY ALL
""")(
    lambda t: J.news_index(t.tick.select(F.col("id").alias("news_id"), F.struct("asset", F.expr("unix_micros(ts) div 86400000000")
        .alias("day")).alias("market_id")), t.tick.select(F.col("id").alias("news_id"), "ts")).select("market_id.asset",
        "market_id.day", F.size("times").cast("long").alias("n"), F.unix_micros(F.element_at("times", 1)).alias("first_us"),
        F.unix_micros(F.element_at("times", -1)).alias("last_us")))

# the keyword match by a number of words instead of a share of the keywords
for _name, _least in (("join_keyword_match", 2), ("join_keyword_match_whole", 5)):
    q(_name, *KEYWORDS.split(",\ns")[:1], body=f"""
SELECT news_id, market_id, count(*) AS hits FROM n JOIN k USING (w) GROUP BY news_id, market_id HAVING count(*) >= {_least}
""")(lambda t, least=_least: J.keyword_match(
        t.documents.select(F.col("doc_id").alias("news_id"), F.split(F.lower("text"), " ").alias("tokens"), F.col("text").alias("title")),
        t.benchmark.select(F.col("item_id").alias("market_id"), F.split(F.lower("text"), " ").alias("keywords")), least))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, folder, f=f: f(Tables(spark, folder))) for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}
