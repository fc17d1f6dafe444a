"""Further registered queries: aggregates, participants, ordered analytics, impact, ledgers, and sets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A, joins as J, ordered as O
from tidemark.plans.bindings import LEG, MARKET, TICK, TRADE
from tidemark.plans.queries import DAY, q, r

MOVES = "w AS (SELECT actor, epoch_us(ts) // 21600000000 AS \"window\", first(cents ORDER BY ts, id) AS first, last(cents ORDER BY ts, id) AS last, count(*) AS n FROM v_tick GROUP BY ALL)"


def share(a: str, b: str) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6)"


# -- distributions and counts --------------------------------------------------------------------------------------
q("distribution_stats", TRADE, body="""
SELECT outcome_index, count(*) AS n, round(quantile_cont(cents, 0.25), 4) AS p25, round(quantile_cont(cents, 0.5), 4) AS p50,
    round(quantile_cont(cents, 0.75), 4) AS p75, round(quantile_cont(cents, 0.9), 4) AS p90, round(quantile_cont(cents, 0.99), 4) AS p99,
    round(sum(CAST(cents AS DOUBLE)) / count(*), 4) AS mean, min(cents) AS least, max(cents) AS most FROM v_trade GROUP BY outcome_index
""")(
    lambda t: A.distribution_stats(t.trade, "outcome_index", "cents"))
q("percentile_index", TRADE, body="""
SELECT wallet, v AS value, n FROM (SELECT wallet, cents AS v, row_number() OVER (PARTITION BY wallet ORDER BY cents) - 1 AS i, count(*) OVER
    (PARTITION BY wallet) AS n FROM v_trade) WHERE i = CAST(floor(0.9 * (n - 1)) AS BIGINT)
""")(
    lambda t: A.percentile_index(t.trade, "wallet", "cents", 0.9))
q("quantile_exclusive", TRADE, body="""
SELECT wallet, n, round(CASE WHEN n < 10 THEN m ELSE lo + (hi - lo) * f END, 4) AS q FROM (SELECT wallet, max(n) AS n, max(v) AS m, max(CASE WHEN i =
    j THEN v END) AS lo, max(CASE WHEN i = j + 1 THEN v END) AS hi, max((n + 1) * 9 / 10 - j) AS f FROM (SELECT *, least(greatest(floor((n + 1) * 9 /
    10), 1), n - 1) AS j FROM (SELECT wallet, CAST(cents AS DOUBLE) AS v, row_number() OVER (PARTITION BY wallet ORDER BY cents) AS i, count(*) OVER
    (PARTITION BY wallet) AS n FROM v_trade)) GROUP BY wallet)
""")(
    lambda t: A.quantile_exclusive(t.trade, "wallet", "cents"))
q("value_counts", MARKET, body=f"""
SELECT category, n, {share('n', 'sum(n) OVER ()')} AS share FROM (SELECT category, count(*) AS n FROM v_market GROUP BY category)
""")(
    lambda t: A.value_counts(t.market, "category"))
q("percent_share_ranked", MARKET, body=f"""
SELECT category, n, {share('n', 'sum(n) OVER ()')} AS share, row_number() OVER (ORDER BY n DESC, category) AS rank FROM (SELECT category, count(*) AS
    n FROM v_market GROUP BY category)
""")(
    lambda t: A.value_counts(t.market, "category").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"),
        "category"))))
q("cross_tab", MARKET, body="""
SELECT category, count(*) FILTER (WHERE yes = 0) AS "0", count(*) FILTER (WHERE yes = 1) AS "1" FROM v_market GROUP BY category
""")(
    lambda t: t.market.groupBy("category").pivot("yes", [0, 1]).count().na.fill(0))
q("conditional_counts", TRADE, body=f"""
SELECT wallet, count(*) AS n, count(*) FILTER (WHERE size > 40) AS big, {share('count(*) FILTER (WHERE size > 40)', 'count(*)')} AS big_share FROM
    v_trade GROUP BY wallet
""")(
    lambda t: t.trade.groupBy("wallet").agg(F.count("*").alias("n"), F.count_if(F.col("size") > 40).alias("big"), A.share(F.count_if(F.col("size") > 40),
        F.count("*")).alias("big_share")))
EV = "ev AS (SELECT event_id, count(*) AS legs, count(yes) AS resolved, sum(yes) AS winners FROM v_market GROUP BY event_id)"
q("multi_winner_hist", MARKET, EV, body="""
SELECT legs, CAST(winners AS BIGINT) AS winners, count(*) AS events FROM ev GROUP BY ALL
""")(
    lambda t: A.multi_winner_hist(t.market.groupBy("event_id").agg(F.count("*").alias("legs"), F.sum("yes").alias("winners"))))
q("market_level_sum_stats", TRADE, body="""
SELECT legs, count(*) AS markets, min(s) AS least, max(s) AS most FROM (SELECT count(*) AS legs, CAST(sum(price_milli) AS BIGINT) AS s FROM v_trade
    GROUP BY market_id) GROUP BY legs
""")(
    lambda t: t.trade.groupBy("market_id").agg(F.count("*").alias("legs"), F.sum("price_milli").alias("s")).groupBy("legs").agg(F.count("*")
        .alias("markets"), F.min("s").alias("least"), F.max("s").alias("most")))
q("column_validity", body="""
SELECT name, count(v) AS present, count(*) FILTER (WHERE v > 1 AND v < 1000) AS valid FROM (SELECT 'l_quantity' AS name, l_quantity AS v FROM lineitem
    UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY name
""")(
    lambda t: A.column_validity(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], (F.col("v") > 1) & (F.col("v") < 1000)))

# -- participants --------------------------------------------------------------------------------------------------
q("share_topk_gini", TRADE, body=f"""
SELECT participants, total, {share('t1', 'total')} AS top1, {share('t10', 'total')} AS top10, {share('t50', 'total')} AS top50,
    {share('t100', 'total')} AS top100, round(2 * CAST(ix AS DOUBLE) / (participants * CAST(total AS DOUBLE)) - (participants + 1) / participants, 6)
    AS gini, t10 / total < 0.5 AS diffuse FROM (SELECT count(*) AS participants, CAST(sum(x) AS BIGINT) AS total, sum(CASE WHEN top <= 1 THEN x END)
    AS t1, sum(CASE WHEN top <= 10 THEN x END) AS t10, sum(CASE WHEN top <= 50 THEN x END) AS t50, sum(CASE WHEN top <= 100 THEN x END) AS t100, sum(i
    * x) AS ix FROM (SELECT x, row_number() OVER (ORDER BY x DESC, wallet) AS top, row_number() OVER (ORDER BY x, wallet) AS i FROM (SELECT wallet,
    sum(cents) AS x FROM v_trade GROUP BY wallet)))
""")(
    lambda t: A.concentration(t.trade, "wallet", "cents"))
q("wallets_per_market", TRADE, body="""
SELECT count(*) AS markets, round(avg(w), 6) AS mean, round(quantile_cont(w, 0.5), 4) AS median, round(quantile_cont(w, 0.95), 4) AS p95 FROM (SELECT
    count(DISTINCT wallet) AS w FROM v_trade GROUP BY market_id)
""")(
    lambda t: A.wallets_per_market(t.trade))
q("wallet_aggregate", TRADE, body="""
SELECT wallet, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, count(DISTINCT market_id) AS markets, epoch_us(min(ts)) AS first_us,
    epoch_us(max(ts)) AS last_us FROM v_trade GROUP BY wallet
""")(
    lambda t: A.wallet_aggregate(t.trade).select("wallet", "n", "cents", "markets", F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us")))
q("wallet_vertical_mix", MARKET, TRADE, body=f"""
SELECT wallet, coalesce(u, 0) AS "1-URGENT", coalesce(h, 0) AS "2-HIGH", {share('coalesce(u, 0)', 'coalesce(u, 0) + coalesce(h, 0)')} AS
    "1-URGENT_share", {share('coalesce(h, 0)', 'coalesce(u, 0) + coalesce(h, 0)')} AS "2-HIGH_share" FROM (SELECT wallet, CAST(sum(cents) FILTER
    (WHERE category = '1-URGENT') AS BIGINT) AS u, CAST(sum(cents) FILTER (WHERE category = '2-HIGH') AS BIGINT) AS h FROM v_trade JOIN v_market USING
    (market_id) GROUP BY wallet)
""")(
    lambda t: A.mix(t.trade.join(t.market, "market_id"), "wallet", "category", ["1-URGENT", "2-HIGH"], "cents"))
q("wallet_overlap", TRADE, body="""
SELECT a.wallet, a.x AS inside, coalesce(b.x, 0) AS outside FROM (SELECT wallet, CAST(sum(cents) AS BIGINT) AS x FROM v_trade WHERE size > 45 GROUP BY
    wallet) a LEFT JOIN (SELECT wallet, CAST(sum(cents) AS BIGINT) AS x FROM v_trade WHERE size <= 45 GROUP BY wallet) b ON a.wallet = b.wallet
""")(
    lambda t: A.overlap(t.trade, "wallet", F.col("size") > 45, "cents"))
for name, cost, signed in (("settled_pnl", "cents", False), ("settled_pnl_signed", "(CASE WHEN outcome_index = 1 THEN -1 ELSE 1 END) * cents", True)):
    q(name, MARKET, TRADE, body=f"SELECT wallet, count(*) AS markets, CAST(sum(pnl) AS BIGINT) AS pnl_cents, {share('count(*) FILTER (WHERE pnl > 0)', 'count(*)')} AS win_rate FROM (SELECT wallet, (CASE WHEN net > 0 THEN net * yes ELSE -net * (1 - yes) END) * 100 - cost AS pnl FROM (SELECT wallet, market_id, sum((CASE WHEN outcome_index = 1 THEN -1 ELSE 1 END) * size) AS net, sum({cost}) AS cost FROM v_trade GROUP BY ALL) JOIN v_market USING (market_id) WHERE yes IS NOT NULL) GROUP BY wallet")(lambda t, signed=signed: A.settled_pnl(t.trade, t.market, signed))
q("missed_reason", MARKET, TRADE, body="""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN t.market_id IS NULL THEN 'no_detection' WHEN t.most > 45 THEN 'cap_too_tight' WHEN t.n < 3 THEN
    'attempted_no_fill' ELSE 'filled' END AS reason FROM v_market m LEFT JOIN (SELECT market_id, max(size) AS most, count(*) AS n FROM v_trade GROUP
    BY market_id) t ON m.market_id = t.market_id WHERE yes IS NOT NULL) GROUP BY reason
""")(
    lambda t: A.skip_reasons(t.market.where("yes is not null").join(t.trade.groupBy("market_id").agg(F.max("size").alias("most"),
        F.count("*").alias("n")), "market_id", "left"), {"no_detection": F.col("n").isNull(), "cap_too_tight": F.col("most") > 45,
        "attempted_no_fill": F.col("n") < 3, "filled": F.lit(True)}))
q("topk_global", TRADE, body="""
SELECT wallet, CAST(sum(cents) AS BIGINT) AS cents FROM v_trade GROUP BY wallet ORDER BY cents DESC, wallet LIMIT 20
""")(
    lambda t: t.trade.groupBy("wallet").agg(F.sum("cents").alias("cents")).orderBy(F.desc("cents"), "wallet").limit(20))
q("topk_per_group", MARKET, body="""
SELECT category, market_id, rank FROM (SELECT category, market_id, row_number() OVER (PARTITION BY category ORDER BY volume DESC, market_id) AS rank
    FROM v_market) WHERE rank <= 10
""")(
    lambda t: A.topk_per_group(t.market, "category", [F.desc("volume"), F.col("market_id")], 10).select("category", "market_id",
        "rank"))

# -- ordered -------------------------------------------------------------------------------------------------------
GRID = "last6 AS (SELECT asset, epoch_us(ts) // 21600000000 AS bin, last(cents ORDER BY ts, id) AS cents FROM v_tick GROUP BY ALL), span AS (SELECT asset, unnest(generate_series(min(bin), max(bin))) AS bin FROM last6 GROUP BY asset), grid AS (SELECT asset, bin, last_value(cents IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bin) AS cents FROM span LEFT JOIN last6 USING (asset, bin))"
q("grid_last_ffill", TICK, GRID, body="SELECT * FROM grid")(lambda t: O.grid_last_ffill(t.tick, "asset", "cents", 21_600, "id"))
RET = "ret AS (SELECT asset, bin, ln(cents / lag(cents) OVER (PARTITION BY asset ORDER BY bin)) AS ret FROM grid)"
q("lead_lag_xcorr", TICK, GRID, RET, body="""
SELECT lag, count(*) AS n, round(corr(x, y), 6) AS corr FROM (SELECT l.lag, a.ret AS x, b.ret AS y FROM ret a, (SELECT unnest(generate_series(-3, 3))
    AS lag) l, ret b WHERE a.asset = 'click' AND b.asset = 'purchase' AND b.bin = a.bin + l.lag AND a.ret IS NOT NULL AND b.ret IS NOT NULL) GROUP BY
    lag HAVING count(*) >= 10
""")(
    lambda t: (lambda g: O.lead_lag_xcorr(g.where("asset = 'click'"), g.where("asset = 'purchase'"), "ret", 3))(O.log_returns(O.grid_last_ffill(t.tick,
        "asset", "cents", 21_600, "id"), "asset", "cents")))
BASKET = "lastb AS (SELECT event, leg, epoch_us(ts) // 21600000000 AS bucket, last(price_micro ORDER BY ts, id) AS p FROM v_leg GROUP BY ALL), names AS (SELECT DISTINCT event, leg FROM lastb), nl AS (SELECT event, count(*) AS n_legs FROM names GROUP BY event), seen AS (SELECT n.event, n.leg, g.bucket, last_value(l.p IGNORE NULLS) OVER w AS p, last_value(CASE WHEN l.p IS NOT NULL THEN g.bucket END IGNORE NULLS) OVER w AS seen_at FROM (SELECT DISTINCT event, bucket FROM lastb) g JOIN names n ON g.event = n.event LEFT JOIN lastb l ON l.event = n.event AND l.leg = n.leg AND l.bucket = g.bucket WINDOW w AS (PARTITION BY n.event, n.leg ORDER BY g.bucket)), basket AS (SELECT event, bucket, n_legs, CASE WHEN count(*) FILTER (WHERE (bucket - seen_at) * 21600 <= 1728000) = n_legs THEN CAST(sum(p) FILTER (WHERE (bucket - seen_at) * 21600 <= 1728000) AS BIGINT) END AS total_micro FROM seen JOIN nl USING (event) GROUP BY event, bucket, n_legs)"


def basket(t):
    return O.carry_forward_basket(t.leg, 21_600, 20 * DAY)


q("carry_forward_basket", LEG, BASKET, body="SELECT * FROM basket")(basket)
RUNS = "runs AS (SELECT event, min(bucket) AS start, max(bucket) AS \"end\", count(*) AS n_rows, min(total_micro) AS least, max(total_micro) AS most, first(total_micro ORDER BY bucket) AS first_value, last(total_micro ORDER BY bucket) AS last_value FROM (SELECT *, rn - row_number() OVER (PARTITION BY event ORDER BY bucket) AS island FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY bucket) AS rn FROM basket) WHERE total_micro < 1600000) GROUP BY event, island)"
q("threshold_runs", LEG, BASKET, RUNS, body="SELECT * FROM runs")(lambda t: O.threshold_runs(basket(t), "event", "bucket", "total_micro", 1_600_000))
q("window_first_last_delta", TICK, MOVES, body="SELECT actor, \"window\", first, last, n, last - first AS delta FROM w")(lambda t: O.window_first_last_delta(t.tick, "actor", "cents", 360, "id"))
q("rank_in_group", MARKET, body="""
SELECT market_id, row_number() OVER (PARTITION BY event_id ORDER BY volume DESC, market_id) AS rank FROM v_market
""")(
    lambda t: O.rank_in_group(t.market, "event_id", "volume", "market_id").select("market_id", "rank"))
q("latest_per_key", TICK, body="SELECT actor, last(cents ORDER BY ts, id) AS cents FROM v_tick GROUP BY actor")(lambda t: J.upsert_last(t.tick, ["actor"], ["ts", "id"]).select("actor", "cents"))
q("first_per_key", TICK, body="SELECT actor, first(cents ORDER BY ts, id) AS cents FROM v_tick GROUP BY actor")(lambda t: J.upsert_first(t.tick, ["actor"], ["ts", "id"]).select("actor", "cents"))
q("change_count", TICK, body="""
SELECT actor, count(*) AS n, count(*) FILTER (WHERE c) AS changes FROM (SELECT actor, asset <> lag(asset) OVER (PARTITION BY actor ORDER BY ts, id) AS
    c FROM v_tick) GROUP BY actor
""")(
    lambda t: O.change_count(t.tick, "actor", "asset", ["ts", "id"]))
q("rolling_return", TICK, GRID, body="""
SELECT asset, bin, cents, round(ln(cents / lag(cents, 4) OVER (PARTITION BY asset ORDER BY bin)), 6) AS ret FROM grid
""")(
    lambda t: O.rolling_return(O.grid_last_ffill(t.tick, "asset", "cents", 21_600, "id"), "asset", "bin", "cents", 4))
q("realized_vol_windows", TICK, GRID, RET, body="""
SELECT asset, w, count(*) AS n, round(stddev_samp(ret) * sqrt(8760.0), 6) AS vol FROM (SELECT asset, ret, unnest(generate_series((bin - 11 + 3) // 4,
    bin // 4)) AS w FROM ret WHERE ret IS NOT NULL) GROUP BY asset, w HAVING count(*) = 12
""")(
    lambda t: O.realized_vol_windows(O.grid_last_ffill(t.tick, "asset", "cents", 21_600, "id"), "asset", "cents", 12, 4))
q("terciles", MARKET, body="""
SELECT market_id, CASE WHEN i < m // 3 THEN 'low' WHEN i < 2 * m // 3 THEN 'mid' ELSE 'high' END AS regime FROM (SELECT market_id, row_number() OVER
    (PARTITION BY category ORDER BY volume, market_id) - 1 AS i, count(*) OVER (PARTITION BY category) AS m FROM v_market)
""")(
    lambda t: O.terciles(t.market, "category", "volume", "market_id").select("market_id", "regime"))
q("spread_stats", TICK, MOVES, body=f"""
SELECT count(*) AS n, round(sum(d) / count(*), 4) AS mean, round(quantile_cont(d, 0.5), 4) AS median, round(stddev_samp(CAST(d AS DOUBLE)), 4) AS sd,
    round(sum(abs(d)) / count(*), 4) AS abs_mean, min(d) AS least, max(d) AS most, {share('count(*) FILTER (WHERE abs(d) > 10)', 'count(*)')} AS
    over_10, {share('count(*) FILTER (WHERE abs(d) > 20)', 'count(*)')} AS over_20, {share('count(*) FILTER (WHERE abs(d) > 50)', 'count(*)')} AS
    over_50, actor FROM (SELECT actor, last - first AS d FROM w) GROUP BY actor HAVING count(*) > 1
""")(
    lambda t: A.spread_stats(O.window_first_last_delta(t.tick, "actor", "cents", 360, "id"), ["actor"], "delta").where("n > 1"))

# -- impact --------------------------------------------------------------------------------------------------------
SIG = "sig AS (SELECT actor, count(*) AS n_calm, CASE WHEN count(*) >= 10 AND stddev_samp(CAST(last - first AS DOUBLE)) > 0 THEN round(stddev_samp(CAST(last - first AS DOUBLE)), 6) END AS sigma FROM w WHERE NOT EXISTS (SELECT 1 FROM v_tick p WHERE p.asset = 'purchase' AND p.actor = w.actor AND epoch_us(p.ts) BETWEEN w.\"window\" * 21600000000 - 600000000 AND w.\"window\" * 21600000000 + 21600000000) GROUP BY actor)"


def moves(t):
    return O.window_first_last_delta(t.tick, "actor", "cents", 360, "id").withColumn("ts", F.timestamp_micros(F.col("window") * 21_600_000_000))


def sigma(t):
    return A.baseline_sigma(moves(t), t.tick.where("asset = 'purchase'"), "actor", 600_000_000, 21_600_000_000)


q("baseline_sigma", TICK, MOVES, SIG, body="SELECT * FROM sig")(sigma)
q("observed_hours", TICK, body="""
SELECT actor, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 END, 4) AS hours FROM v_tick
    GROUP BY actor
""")(
    lambda t: A.observed_hours(t.tick, "actor"))
q("rate_ratio_verdict", TICK, "f AS (SELECT actor, count(*) AS flags FROM v_tick WHERE cents > 15000 GROUP BY actor), h AS (SELECT actor, round(CASE WHEN count(*) < 2 THEN 0 ELSE (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 END, 4) AS hours FROM v_tick GROUP BY actor), g AS (SELECT actor % 2 = 0 AS cand, CAST(sum(coalesce(flags, 0)) AS DOUBLE) / sum(hours) AS rate FROM h LEFT JOIN f USING (actor) GROUP BY 1), o AS (SELECT max(rate) FILTER (WHERE cand) AS c, max(rate) FILTER (WHERE NOT cand) AS k FROM g)", body="""
SELECT round(c, 6) AS candidate, round(k, 6) AS control, round(c / k, 4) AS ratio, CASE WHEN c / k < 1 THEN 'none' WHEN c / k < 1.5 THEN 'weak' WHEN c
    / k < 3 THEN 'moderate' ELSE 'strong' END AS verdict FROM o
""")(
    lambda t: A.rate_ratio(t.tick.where("cents > 15000"), A.observed_hours(t.tick, "actor"), "actor", F.col("actor") % 2 == 0))
q("feed_silence", TICK, body="""
SELECT actor, count(*) AS items, round(coalesce(max(gap), 0) / 60e6, 4) AS silent_min, coalesce(max(gap) <= 259200000000, true) AS healthy FROM
    (SELECT actor, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY actor ORDER BY ts) AS gap FROM v_tick) GROUP BY actor
""")(
    lambda t: A.feed_silence(t.tick, "actor", 259_200_000_000))
q("hour_profile", TICK, body=f"""
SELECT hour, n, {share('n', 'sum(n) OVER ()')} AS n_share, {share('a', 'sum(a) OVER ()')} AS amount_share, hour IN (2, 3, 4) AS quiet FROM (SELECT
    hour(ts) AS hour, count(*) AS n, sum(cents) AS a FROM v_tick GROUP BY 1)
""")(
    lambda t: A.hour_profile(t.tick, "cents", [2, 3, 4]))

# -- quality, sets, sources ----------------------------------------------------------------------------------------
q("table_freshness", body="""
SELECT 'orders' AS name, count(*) AS n, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(o_orderdate))) / 3.6e9, 4) AS age_hours,
    (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(o_orderdate))) / 3.6e9 > 720 AS stale FROM orders UNION ALL SELECT 'events', count(*),
    round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3.6e9, 4), (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3.6e9 > 720
    FROM events
""")(
    lambda t: A.table_freshness({"orders": (t.orders, "o_orderdate"), "events": (t.events, "ts")}, "2024-01-31", 720))
q("union_all", TRADE, body="""
SELECT side, count(*) AS n FROM (SELECT 'yes' AS side FROM v_trade WHERE outcome_index = 0 UNION ALL SELECT 'no' FROM v_trade WHERE outcome_index = 1)
    GROUP BY side
""")(
    lambda t: t.trade.where("outcome_index = 0").select(F.lit("yes").alias("side")).unionByName(t.trade.where("outcome_index = 1")
        .select(F.lit("no").alias("side"))).groupBy("side").agg(F.count("*").alias("n")))
q("distinct_keys", TRADE, body="SELECT DISTINCT market_id, wallet FROM v_trade")(lambda t: t.trade.select("market_id", "wallet").distinct())
q("intersect_index", TICK, body="""
SELECT DISTINCT epoch_us(ts) // 3600000000 AS bin FROM v_tick WHERE asset = 'click' INTERSECT SELECT DISTINCT epoch_us(ts) // 3600000000 FROM v_tick
    WHERE asset = 'purchase'
""")(
    lambda t: t.tick.where("asset = 'click'").selectExpr("unix_micros(ts) div 3600000000 as bin").intersect(t.tick.where("asset = 'purchase'")
        .selectExpr("unix_micros(ts) div 3600000000 as bin")))
q("except_set", TRADE, body="""
SELECT o_orderkey AS market_id FROM orders EXCEPT SELECT market_id FROM v_trade
""")(
    lambda t: t.orders.select(F.col("o_orderkey").alias("market_id")).exceptAll(t.trade.select("market_id")).distinct().join(t.trade.select("market_id")
        .distinct(), "market_id", "left_anti"))
q("unpivot_selections", body="""
SELECT l_orderkey, l_linenumber, name, v FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR name IN (l_discount,
    l_tax))
""")(
    lambda t: t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "name", "v"))
q("explode_nested", body="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")(
    lambda t: t.events.select("event_id", F.from_json("props", "map<string,bigint>").alias("m")).select("event_id", F.explode("m")
        .alias("key", "k")).where("key = 'k'").select("event_id", "k"))
q("scan_parquet_pruned", body="SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")(lambda t: t.lineitem.select("l_orderkey", "l_quantity").where("l_quantity > 49"))
q("scan_parquet_tolerant", body="SELECT o_orderkey, o_orderstatus FROM orders")(lambda t: t.orders.select([c for c in ("o_orderkey", "o_missing", "o_orderstatus") if c in t.orders.columns]))
q("venue_inventory", body="""
SELECT p_brand, p_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM (SELECT p_brand, p_type,
    count(*) AS n FROM part GROUP BY p_brand, p_type)) WHERE rank <= 3
""")(
    lambda t: A.topk_per_group(t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), "p_brand", [F.desc("n"), F.col("p_type")],
        3))
