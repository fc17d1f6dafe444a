"""Registered queries of the reports: positions, entries, baskets, venues, depth, strategies, participants, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A, ordered as O, reports as R
from tidemark.plans.bindings import LEG, MARKET, TICK, TRADE
from tidemark.plans.queries import DAY, q, r
from tidemark.plans.queries_markets import HOURLY, hourly
from tidemark.plans.queries_more import BASKET, MOVES, RUNS, SIG, basket, moves, share, sigma

SIDE = "(CASE WHEN outcome_index = 1 THEN -1 ELSE 1 END)"
LAST = "lastp AS (SELECT market_id, last(price_milli ORDER BY ts, line, price_milli, size) AS price, last(size ORDER BY ts, line, price_milli, size) AS size FROM v_trade GROUP BY market_id)"

# -- positions and entries -----------------------------------------------------------------------------------------
PNL = f"""pnl AS (SELECT wallet, CAST(sum(p) AS BIGINT) AS pnl_cents FROM (
  SELECT wallet, (CASE WHEN net > 0 THEN net * yes ELSE -net * (1 - yes) END) * 100 - cost AS p FROM (
    SELECT wallet, market_id, sum({SIDE} * size) AS net, sum(cents) AS cost FROM v_trade GROUP BY ALL) JOIN v_market USING (market_id)
  WHERE yes IS NOT NULL) GROUP BY wallet)"""
q(
    "settled_pnl_extremes", MARKET, TRADE, PNL,
    body=" UNION ALL ".join(
        f"SELECT '{side}' AS side, rank, wallet, pnl_cents FROM (SELECT *, row_number() OVER (ORDER BY pnl_cents {way}, wallet) AS rank FROM pnl) WHERE rank <= 10"
        for side, way in (("top", "DESC"), ("bottom", "ASC"))
    ),
)(lambda t: R.extremes(A.settled_pnl(t.trade, t.market).select("wallet", "pnl_cents"), "pnl_cents", "wallet", 10))

q(
    "wallet_pnl_rollup", MARKET, TRADE, LAST,
    body=f"""SELECT wallet, CAST(sum(cash) AS BIGINT) AS cash, CAST(sum(held) AS BIGINT) AS held,
      CAST(sum(CASE WHEN yes IS NOT NULL THEN cash + net * yes * 100 ELSE 0 END) AS BIGINT) AS realized,
      CAST(sum(CASE WHEN yes IS NULL THEN net * price ELSE 0 END) AS BIGINT) AS open_value_milli
    FROM (SELECT wallet, market_id, sum({SIDE} * size) AS net, sum(-{SIDE} * cents) AS cash, sum(size) AS held FROM v_trade GROUP BY ALL)
    JOIN lastp USING (market_id) JOIN v_market USING (market_id) GROUP BY wallet""",
)(lambda t: R.pnl_rollup(t.trade, t.market))

q(
    "backtest_edge", MARKET, TRADE,
    body=f"""SELECT fee_bps, count(*) AS n, round(sum(g) / count(*) / 1000, 6) AS gross, round(quantile_cont(g, 0.5) / 1000, 6) AS median_gross,
      round(CAST(sum(g * cents) AS DOUBLE) / sum(cents) / 1000, 6) AS weighted_gross,
      round((sum(g) / 1000 - sum(fee_bps * price_milli * (1000 - price_milli)) / 1e10) / count(*), 6) AS net,
      {share('sum(yes)', 'count(*)')} AS hit_rate, {share('count(*) FILTER (WHERE g < -500)', 'count(*)')} AS crash_rate
    FROM (SELECT *, yes * 1000 - price_milli AS g FROM v_trade JOIN v_market USING (market_id)), (VALUES (0), (200)) f(fee_bps)
    WHERE yes IS NOT NULL AND price_milli BETWEEN 450 AND 650 GROUP BY fee_bps""",
)(lambda t: R.backtest_edge(t.trade.join(t.market, "market_id").where("yes is not null and price_milli between 450 and 650"), [0, 200]))


def live_legs(t):
    last = t.trade.groupBy("market_id").agg(F.max_by(F.struct("price_milli", "size"), F.struct("ts", "line", "price_milli", "size")).alias("l"))
    legs = last.select("market_id", F.col("l.price_milli").alias("ask"), (F.col("l.price_milli") - 10).alias("bid"), F.expr("CASE WHEN l.size > 5 THEN l.size END").alias("depth"))
    return legs.join(t.market.select("market_id", "event_id", "end_ts"), "market_id")


q(
    "basket_sum_edge", MARKET, TRADE, LAST,
    body="""SELECT event_id, legs, asks_milli, bids_milli, sets, edge_pct, CASE WHEN deep = legs THEN round(greatest(edge_pct, 0) / 100 * sets, 4) END AS profit
    FROM (SELECT event_id, count(*) AS legs, count(depth) AS deep, CAST(sum(price) AS BIGINT) AS asks_milli, CAST(sum(price - 10) AS BIGINT) AS bids_milli,
        min(depth) AS sets, round((1 - sum(price) / 1000) * 100, 4) AS edge_pct
      FROM (SELECT event_id, price, CASE WHEN size > 5 THEN size END AS depth FROM lastp JOIN v_market USING (market_id) WHERE end_ts > TIMESTAMP '1999-06-01')
      GROUP BY event_id HAVING count(*) >= 2)""",
)(lambda t: R.basket_edge(live_legs(t), "event_id", "1999-06-01"))

q(
    "group_collect", MARKET,
    body="""SELECT event_id, count(*) AS n, array_to_string(list(market_id ORDER BY market_id), ',') AS ids,
      array_to_string(list('m-' || market_id ORDER BY market_id), ',') AS slugs, 'm-' || min(market_id) AS first_slug,
      CAST(sum(yes) AS BIGINT) AS winners, epoch_us(min(end_ts)) AS first_us, epoch_us(max(end_ts)) AS last_us
    FROM v_market GROUP BY event_id HAVING count(*) >= 2 AND sum(yes) = 1""",
)(
    lambda t: R.group_collect(t.market.withColumn("slug", F.concat(F.lit("m-"), F.col("market_id").cast("string"))), "event_id")
    .select("event_id", "n", "ids", "slugs", "first_slug", "winners", F.unix_micros("first_end").alias("first_us"), F.unix_micros("last_end").alias("last_us"))
)

# -- venues --------------------------------------------------------------------------------------------------------
q(
    "venue_profile", TICK, HOURLY,
    body="""SELECT asset, count(*) AS hours, CAST(sum(volume) AS BIGINT) AS total, round(sum(volume) / count(*), 4) AS mean,
      round(quantile_cont(volume, 0.25), 4) AS p25, round(quantile_cont(volume, 0.5), 4) AS p50, round(quantile_cont(volume, 0.75), 4) AS p75,
      round(quantile_cont(volume, 0.9), 4) AS p90, count(*) FILTER (WHERE volume >= 10000) AS over_10000,
      count(*) FILTER (WHERE volume >= 100000) AS over_100000, count(*) FILTER (WHERE volume >= 1000000) AS over_1000000
    FROM hourly GROUP BY asset""",
)(lambda t: R.venue_profile(hourly(t), "asset"))

q(
    "venue_new_per_quarter", MARKET,
    body="SELECT year(a) || 'Q' || quarter(a) AS quarter, count(*) AS listed FROM (SELECT min(end_ts) AS a FROM v_market GROUP BY event_id) GROUP BY 1",
)(lambda t: R.new_per_quarter(t.market, "event_id", "end_ts"))

q(
    "venue_keyword_hits",
    body="""SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE contains(lower(p_name), 'red')) AS has_red,
      count(*) FILTER (WHERE contains(lower(p_name), 'bolt')) AS has_bolt FROM part GROUP BY p_brand""",
)(lambda t: R.keyword_hits(t.part, "p_brand", "p_name", ["red", "bolt"]))


def capacity(t):
    x = t.tick.withColumn("day", F.expr("unix_micros(ts) div 86400000000"))
    by = lambda c: x.groupBy("asset", "day").agg(c)
    spread = ((F.max("cents") - F.min("cents")) / 100).alias("spread_bps")
    return R.capacity_table(by(F.sum("cents").alias("volume")), by(spread), by(F.count_distinct("actor").alias("wallets")), ["asset", "day"], 4.5, 50)


q(
    "capacity_table", TICK,
    body=f"""SELECT *, CASE WHEN net_bps <= 0 THEN 'none' WHEN net_bps < 5 THEN 'thin' ELSE 'open' END AS label,
      {r('net_bps * quoted / 10000')} AS earns, {r('spread_bps / 2 * quoted / 10000')} AS ceiling
    FROM (SELECT *, least(50.0::DOUBLE, cap) AS quoted FROM (
      SELECT *, {r('spread_bps / 2 - 4.5::DOUBLE')} AS net_bps, {r('volume * 5e-3 / 5')} AS cap FROM (
        SELECT asset, epoch_us(ts) // 86400000000 AS day, CAST(sum(cents) AS BIGINT) AS volume, (max(cents) - min(cents)) / 100 AS spread_bps,
          count(DISTINCT actor) AS wallets FROM v_tick GROUP BY ALL)))""",
)(capacity)

q(
    "flat_fraction", TICK, HOURLY,
    body=f"""SELECT part, hour, n, {share('flat', 'n')} AS flat FROM (
      SELECT 'hour' AS part, hour, count(*) AS n, count(*) FILTER (WHERE abs(ret) < 0.5) AS flat FROM x GROUP BY hour
      UNION ALL SELECT CASE WHEN hour IN (2, 3, 4) THEN 'quiet' ELSE 'active' END, NULL, count(*), count(*) FILTER (WHERE abs(ret) < 0.5) FROM x GROUP BY 1)""".replace(
        " FROM x ",
        " FROM (SELECT (bin - 4) % 24 AS hour, round(ln(close / lag(close, 4) OVER (PARTITION BY asset ORDER BY bin)), 6) AS ret FROM hourly) x WHERE ret IS NOT NULL ",
    ),
)(lambda t: R.flat_fraction(O.rolling_return(hourly(t), "asset", "bin", "close", 4).withColumn("bin", F.col("bin") - 4), "ret", 0.5, [2, 3, 4]))

q(
    "realized_vol_by_hour", TICK, HOURLY,
    body="""SELECT *, row_number() OVER (ORDER BY p50, hour) <= 6 AS quiet FROM (
      SELECT hour, count(*) AS n, round(quantile_cont(v * 10000, 0.25), 4) AS p25, round(quantile_cont(v * 10000, 0.5), 4) AS p50,
        round(quantile_cont(v * 10000, 0.75), 4) AS p75, round(sum(v * 10000) / count(*), 4) AS mean
      FROM (SELECT bin % 24 AS hour, sqrt(sum(pow(ln(close / open), 2))) AS v FROM hourly GROUP BY bin % 24, bin // 24 HAVING count(*) >= 3) GROUP BY hour)""",
)(lambda t: R.realized_vol_by_hour(hourly(t).withColumn("k", F.lit(1)), "k"))

q(
    "funding_stats", TICK,
    body="""SELECT asset, count(*) AS n, round(count(*) FILTER (WHERE r > 0) / count(*), 6) AS positive, round(count(*) FILTER (WHERE r < 0) / count(*), 6) AS negative,
      round(sum(r) / count(*), 4) AS mean, round(quantile_cont(r, 0.1), 4) AS p10, round(quantile_cont(r, 0.5), 4) AS p50, round(quantile_cont(r, 0.9), 4) AS p90,
      round(sum(r) / count(*) * 3 * 365, 2) AS annual, round(sum((cents - spot) * 100 / spot) / count(*), 4) AS basis_pct
    FROM (SELECT asset, cents, cents - 10000 AS r, 10000 + actor AS spot FROM v_tick) GROUP BY asset""",
)(lambda t: R.funding_stats(t.tick.withColumns({"r": F.col("cents") - 10_000, "spot": F.col("actor") + 10_000}), "asset", "r", "cents", "spot"))

q(
    "viability_gate", MARKET,
    body="""SELECT category, n, p50, p90, daily, weekly, monthly, CASE WHEN n >= 100 AND p50 >= 50000 THEN 'PROMISING' ELSE 'SKIP' END AS verdict
    FROM (SELECT category, count(*) AS n, round(quantile_cont(volume, 0.5), 4) AS p50, round(quantile_cont(volume, 0.9), 4) AS p90,
        count(*) FILTER (WHERE c = 'daily') AS daily, count(*) FILTER (WHERE c = 'weekly') AS weekly, count(*) FILTER (WHERE c = 'monthly') AS monthly
      FROM (SELECT *, CASE WHEN day(end_ts) = 1 THEN 'monthly' WHEN isodow(end_ts) = 1 THEN 'weekly' ELSE 'daily' END AS c FROM v_market) GROUP BY category)""",
)(
    lambda t: R.viability_gate(
        t.market.withColumn("cadence", F.expr("CASE WHEN day(end_ts) = 1 THEN 'monthly' WHEN weekday(end_ts) = 0 THEN 'weekly' ELSE 'daily' END")), "category", ["daily", "weekly", "monthly"], 100, 50_000
    )
)

q(
    "pattern_coverage",
    body="""SELECT pattern, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS relevant, count(*) FILTER (WHERE p_size > 25 AND p_name LIKE '%o%') AS caught
    FROM (SELECT p_size, p_name, CASE WHEN p_name LIKE 'red%' THEN 'red' WHEN p_name LIKE '%bolt' THEN 'bolt' ELSE 'none' END AS pattern FROM part) GROUP BY pattern""",
)(lambda t: R.pattern_coverage(t.part, F.when(F.col("p_name").like("red%"), "red").when(F.col("p_name").like("%bolt"), "bolt"), F.col("p_size") > 25, F.col("p_name").like("%o%")))

q(
    "stratified_sample", MARKET,
    body="""SELECT category, market_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY (market_id * 2654435761 + 42 * 40503) % 4294967296, market_id) AS rn
    FROM v_market WHERE volume >= 50000) WHERE rn <= 20""",
)(lambda t: A.stratified_sample(t.market.where("volume >= 50000"), "category", "market_id", 20).select("category", "market_id"))

# -- depth and strategies ------------------------------------------------------------------------------------------
DEPTH = """depth AS (SELECT market_id, category, yes, min(price_milli) AS price, min(price_milli) // 100 AS bucket, max(size) AS most, sum(size) AS depth
  FROM v_trade JOIN v_market USING (market_id) GROUP BY ALL)"""


def depth(t):
    g = t.trade.groupBy("market_id").agg(F.min("price_milli").alias("price"), F.max("size").alias("most"), F.sum("size").alias("depth"))
    return g.join(t.market.select("market_id", "category", "yes"), "market_id").withColumn("bucket", F.expr("price div 100"))


q(
    "bucket_depth_stats", MARKET, TRADE, DEPTH,
    body=f"""SELECT category, bucket, count(*) AS n, {share('sum(yes)', 'count(yes)')} AS yes_rate, max(most) AS most, round(quantile_cont(depth, 0.5), 4) AS depth_p50,
      round(quantile_cont(depth, 0.9), 4) AS depth_p90, {', '.join(share(f'count(*) FILTER (WHERE most >= {x})', 'count(*)') + f' AS p_{x}' for x in (10, 30, 45))}
    FROM depth GROUP BY category, bucket""",
)(lambda t: R.bucket_depth_stats(depth(t), ["category", "bucket"], [10, 30, 45]))

q(
    "fill_prob_matrix", MARKET, TRADE, DEPTH,
    body=f"""SELECT bucket, want, n, {r('p')} AS p_fill, {r('net')} AS net_edge, {r('net * p * want')} AS expected
    FROM (SELECT *, raw - 5e-3 - want * 2e-4 - 1e-2 AS net FROM (
      SELECT bucket, want, count(*) AS n, count(*) FILTER (WHERE most >= want) / count(*) * 85e-2 AS p, sum(yes * 1000 - price) / count(yes) / 1000 AS raw
      FROM depth, (VALUES (10), (30), (50)) w(want) GROUP BY bucket, want))""",
)(lambda t: R.fill_prob_matrix(depth(t).withColumn("raw_milli", F.expr("yes * 1000 - price")), [10, 30, 50], 5e-3, 2e-4, 1e-2))


def entries(t):
    path = F.when(F.col("outcome_index") == 1, "taker").otherwise("maker")
    return t.trade.join(t.market, "market_id").select(
        "category", F.expr("yes * 1000 - price_milli").alias("gross_milli"), F.lit(5).alias("fee_milli"), "size", F.expr("abs(unix_micros(end_ts) - unix_micros(ts)) div 1000000").alias("held_s"), path.alias("path")
    )


q(
    "strategy_report", MARKET, TRADE,
    body=f"""SELECT *, CASE WHEN closed < 20 THEN 'insufficient' WHEN net >= 0.015 THEN 'go' WHEN net >= 0.005 THEN 'watch' ELSE 'stop' END AS verdict
    FROM (SELECT category, count(g) AS closed, count(*) - count(g) AS open, count(*) FILTER (WHERE outcome_index = 0) AS by_maker,
        count(*) FILTER (WHERE outcome_index = 1) AS by_taker, {share('count(*) FILTER (WHERE g > 0)', 'count(g)')} AS hit_rate,
        round(sum(g) / count(g) / 1000, 6) AS gross, round((sum(g) - 5 * count(g)) / count(g) / 1000, 6) AS net,
        {r('sum(held) FILTER (WHERE g IS NOT NULL) / count(g) / 3600')} AS hold_h, CAST(sum((g - 5) * size) AS BIGINT) AS pnl_milli
      FROM (SELECT category, size, outcome_index, yes * 1000 - price_milli AS g, abs(epoch_us(end_ts) - epoch_us(ts)) // 1000000 AS held
        FROM v_trade JOIN v_market USING (market_id)) GROUP BY category)""",
)(lambda t: R.strategy_report(entries(t), "category", ["maker", "taker"]))

LATE = f"""late AS (SELECT m.market_id, {', '.join(f"count(*) FILTER (WHERE epoch_us(m.end_ts) - epoch_us(t.ts) BETWEEN 0 AND {d * DAY * 1_000_000}) AS in_{d * DAY}" for d in (30, 365))},
  coalesce(bool_or(epoch_us(m.end_ts) - epoch_us(t.ts) BETWEEN 0 AND {365 * DAY * 1_000_000} AND t.size * 10 > 400), false) AS thin
  FROM v_market m LEFT JOIN v_trade t ON m.market_id = t.market_id WHERE yes IS NOT NULL GROUP BY m.market_id)"""


def late(t):
    return R.price_sufficiency(t.trade.withColumn("spread", F.col("size") * 10), t.market, [30 * DAY, 365 * DAY], 400)


q("price_sufficiency", MARKET, TRADE, LATE, body="SELECT * FROM late")(late)
q(
    "price_sufficiency_verdict", MARKET, TRADE, LATE,
    body=f"""SELECT *, CASE WHEN s >= 0.8 THEN 'sufficient' WHEN s >= 0.4 THEN 'partial' ELSE 'insufficient' END AS verdict
    FROM (SELECT count(*) AS markets, count(*) FILTER (WHERE in_{30 * DAY} >= 1) AS with_in_{30 * DAY}, count(*) FILTER (WHERE in_{365 * DAY} >= 1) AS with_in_{365 * DAY},
      count(*) FILTER (WHERE thin) AS thin, with_in_{30 * DAY} / markets AS s FROM late)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (s), CASE"),
)(lambda t: R.sufficiency_verdict(late(t), [f"in_{30 * DAY}", f"in_{365 * DAY}"]))

# -- participants --------------------------------------------------------------------------------------------------
FILLS = """fills AS (SELECT wallet, category AS asset, ts + to_hours(line * 3) AS ts, cents, outcome_index = 0 AS maker,
  CASE line % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'close' ELSE 'liquidation' END AS action, size AS fee, price_milli - 500 AS pnl FROM v_trade JOIN v_market USING (market_id))"""


def fills(t):
    return t.trade.join(t.market, "market_id").selectExpr(
        "wallet", "category AS asset", "timestamp_micros(unix_micros(ts) + line * 10800000000) AS ts", "cents", "outcome_index = 0 AS maker",
        "CASE line % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'close' ELSE 'liquidation' END AS action", "size AS fee", "price_milli - 500 AS pnl",
    )


q(
    "participant_profile", MARKET, TRADE, FILLS,
    body=f"""SELECT t.*, CASE WHEN maker_share >= 0.7 THEN 'maker' WHEN maker_share <= 0.3 THEN 'taker' ELSE 'mixed' END AS role, busy_hours, assets
    FROM (SELECT wallet, count(*) AS n, CAST(sum(cents) AS BIGINT) AS notional, {share('count(*) FILTER (WHERE maker)', 'count(*)')} AS maker_share,
        {', '.join(f"count(*) FILTER (WHERE action = '{a}') AS {a}s" for a in ('open', 'close', 'liquidation'))}, CAST(sum(fee) AS BIGINT) AS fees, CAST(sum(pnl) AS BIGINT) AS pnl,
        {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6')} AS span_days FROM fills GROUP BY wallet) t
    JOIN (SELECT wallet, count(*) FILTER (WHERE c >= 2e-2 * a) AS busy_hours FROM (SELECT wallet, c, sum(c) OVER (PARTITION BY wallet) AS a
        FROM (SELECT wallet, hour(ts) AS hour, count(*) AS c FROM fills GROUP BY ALL)) GROUP BY wallet) USING (wallet)
    JOIN (SELECT wallet, string_agg(asset, ',' ORDER BY rank) AS assets FROM (SELECT wallet, asset, row_number() OVER (PARTITION BY wallet ORDER BY sum(cents) DESC, asset) AS rank
        FROM fills GROUP BY wallet, asset) WHERE rank <= 5 GROUP BY wallet) USING (wallet)""",
)(lambda t: R.participant_profile(fills(t)))

# -- paths, runs and feeds -----------------------------------------------------------------------------------------
q(
    "persistence_summary", LEG, BASKET, RUNS,
    body=f"""SELECT category, count(*) AS runs, count(DISTINCT event) AS events,
      {', '.join(f"round(quantile_cont({c}, {x}), 4) AS {c}_p{p}" for c in ('hours', 'edge', 'decay') for p, x in ((50, 0.5), (90, 0.9)))},
      {', '.join(f"count(*) FILTER (WHERE hours >= {h}) AS over_{h}h" for h in (24, 168, 720))}
    FROM (SELECT runs.event, coalesce(c_mktsegment, 'none') AS category, ("end" - start + 1) * 6 AS hours, 1600000 - least AS edge, first_value - last_value AS decay
      FROM runs LEFT JOIN customer ON c_custkey = runs.event) GROUP BY ROLLUP (category)""",
)(
    lambda t: O.persistence_summary(
        O.threshold_runs(basket(t), "event", "bucket", "total_micro", 1_600_000).join(t.customer.selectExpr("c_custkey AS event", "c_mktsegment AS category"), "event", "left"), "category", 1_600_000, 6
    )
)

q(
    "path_shape", TICK,
    body="""SELECT actor, round(hit, 3) AS hit_s, n_pre, n_post, at_t0, round(early, 4) AS early_mean, round(late, 4) AS late_mean,
      CASE WHEN n_post = 0 THEN 'no-data' WHEN hit <= 86400 THEN 'snap' WHEN hit <= 432000 THEN 'drift' ELSE 'slow' END AS shape
    FROM (SELECT actor, min(s) FILTER (WHERE s >= 0 AND abs(cents - 10000) <= 1000) AS hit, count(*) FILTER (WHERE s < 0) AS n_pre, count(*) FILTER (WHERE s >= 0) AS n_post,
        last(cents ORDER BY ts, id) FILTER (WHERE s <= 0) AS at_t0, sum(cents) FILTER (WHERE s BETWEEN 0 AND 86400) / count(*) FILTER (WHERE s BETWEEN 0 AND 86400) AS early,
        sum(cents) FILTER (WHERE s BETWEEN 172800 AND 432000) / count(*) FILTER (WHERE s BETWEEN 172800 AND 432000) AS late
      FROM (SELECT *, epoch_us(ts) / 1e6 - 1705276800 AS s FROM v_tick) GROUP BY actor)""",
)(lambda t: O.path_shape(t.tick, "actor", 1_705_276_800, 10_000, 1_000, 86_400, 432_000, (172_800, 432_000)))

q(
    "last_active_and_tail_mean", TICK,
    body="""SELECT *, CASE WHEN tail_mean >= 12000 THEN 'YES' WHEN tail_mean <= 9000 THEN 'NO' END AS verdict
    FROM (SELECT actor, count(*) AS n, round(sum(cents) / count(*), 4) AS tail_mean, epoch_us(max(ts)) AS last_us
      FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY ts DESC, id DESC) AS rn FROM v_tick WHERE cents > 5000) WHERE rn <= 5 GROUP BY actor)""",
)(
    lambda t: O.last_tail_mean(t.tick, "actor", ["ts", "id"], "cents", "cents > 5000", yes_at=12_000, no_at=9_000)
    .select("actor", "n", "tail_mean", "verdict", F.unix_micros("last_active").alias("last_us"))
)

q(
    "time_in_range", TICK,
    body=f"""SELECT actor, width, count(*) AS n, round(avg(CASE WHEN abs(cents - f) <= width * f THEN 1.0::DOUBLE ELSE 0 END), 6) AS share,
      NOT bool_and(abs(cents - f) <= width * f) AS exited, {r('(last(cents ORDER BY ts, id) - max(f)) * 100 / nullif(max(f), 0)')} AS change_pct, max(cents) AS most, min(cents) AS least
    FROM (SELECT actor, cents, ts, id, first_value(cents) OVER (PARTITION BY actor ORDER BY ts, id) AS f FROM v_tick), (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) v(width) GROUP BY actor, width""",
)(lambda t: O.time_in_range(t.tick, "actor", "cents", ["ts", "id"], [0.5, 2.0]))

q(
    "feed_coverage", TICK,
    body="""SELECT asset, CAST(sum(n) AS BIGINT) AS items, count(*) AS keys, min(n) AS least, round(quantile_cont(n, 0.5), 4) AS median, max(n) AS most, max(latest) AS latest_us
    FROM (SELECT asset, actor, count(*) AS n, epoch_us(max(ts)) AS latest FROM v_tick GROUP BY ALL) GROUP BY asset""",
)(lambda t: A.feed_coverage(t.tick, "asset", "actor").withColumn("latest_us", F.unix_micros("latest")).drop("latest"))

q(
    "feed_window_health", TICK,
    body="""SELECT day, count(*) AS feeds, CAST(sum(items) AS BIGINT) AS items, round(max((day + 1) * 86400000000 - last_us) / 60e6, 4) AS silent_min,
      bool_and((day + 1) * 86400000000 - last_us <= 14400000000) AS healthy
    FROM (SELECT g.asset, g.day, coalesce(n, 0) AS items, last_value(l IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.day) AS last_us FROM (
        SELECT asset, unnest(generate_series(min(epoch_us(ts) // 86400000000), max(epoch_us(ts) // 86400000000))) AS day FROM v_tick GROUP BY asset) g
      LEFT JOIN (SELECT asset, epoch_us(ts) // 86400000000 AS day, count(*) AS n, max(epoch_us(ts)) AS l FROM v_tick GROUP BY ALL) c ON c.asset = g.asset AND c.day = g.day) GROUP BY day""",
)(lambda t: A.feed_window_health(t.tick, "asset", 86_400, 14_400).withColumnRenamed("window", "day"))

HASH = "'0x' || sha256(CAST(l_orderkey AS VARCHAR))"
q(
    "dataset_quality_gate",
    body=f"""SELECT concat_ws(',', CASE WHEN NOT a THEN 'enough' END, CASE WHEN NOT b THEN 'fresh' END, CASE WHEN NOT c THEN 'fees' END, CASE WHEN NOT d THEN 'hashes' END) AS failed, a AND b AND c AND d AS passed
    FROM (SELECT count(*) >= 100000 AS a, coalesce(max(l_shipdate) >= TIMESTAMP '2002-01-01', false) AS b, count(*) FILTER (WHERE l_tax > 0) > count(*) / 2 AS c,
      bool_and(regexp_matches({HASH}, '^0x[0-9a-f]{{64}}$')) AS d FROM lineitem)""",
)(
    lambda t: A.quality_gate(
        t.lineitem.withColumn("hash", F.concat(F.lit("0x"), F.sha2(F.col("l_orderkey").cast("string"), 256))),
        {
            "enough": F.count("*") >= 100_000,
            "fresh": F.max("l_shipdate") >= F.lit("2002-01-01").cast("timestamp"),
            "fees": F.count_if(F.col("l_tax") > 0) > F.count("*") / 2,
            "hashes": F.bool_and(F.col("hash").rlike("^0x[0-9a-f]{64}$")),
        },
    )
)
