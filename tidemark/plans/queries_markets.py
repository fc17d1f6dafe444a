"""Registered queries of the market filters, candles, venues, capacity, funding and move scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import joins as J, markets as K
from tidemark.plans.bindings import MARKET, TICK, TRADE
from tidemark.plans.queries import DAY, q

HOURLY = "hourly AS (SELECT asset, epoch_us(ts) // 3600000000 AS bin, CAST(sum(cents) AS BIGINT) AS volume, first(cents ORDER BY ts, id) AS open, last(cents ORDER BY ts, id) AS close FROM v_tick GROUP BY ALL)"


def hourly(t):
    o = F.struct("ts", "id")
    return t.tick.groupBy("asset", F.expr("unix_micros(ts) div 3600000000").alias("bin")).agg(F.sum("cents").alias("volume"), F.min_by("cents", o).alias("open"), F.max_by("cents", o).alias("close"))


q("classify_payout", MARKET, body="""
SELECT market_id, CASE WHEN yes IS NULL THEN CASE WHEN volume > 100000 THEN 'stuck' ELSE 'open' END WHEN market_id % 11 = 0 THEN 'disputed' WHEN yes =
    1 THEN 'win' ELSE 'loss' END AS state FROM v_market
""")(
    lambda t: t.market.select("market_id", K.classify_payout(F.col("yes").isNotNull(), F.col("market_id") % 11 == 0, "yes", F.when(F.col("volume") > 100_000,
        30).otherwise(1)).alias("state")))
q("fill_price_from_amounts", TRADE, body="""
SELECT market_id, line, floor(CASE WHEN price_milli / (size * 20) > 0 AND price_milli / (size * 20) <= 1.0001 THEN price_milli / (size * 20) END * 1e6
    + 0.5) / 1e6 AS price FROM v_trade
""")(
    lambda t: t.trade.select("market_id", "line", S.rnd(K.fill_price("price_milli", F.col("size") * 20)).alias("price")))
q("back_lay_mid", TRADE, body="""
SELECT market_id, line, round((1 / (size + 1) + 1 / (size + 2)) / 2, 6) AS p FROM v_trade
""")(
    lambda t: t.trade.select("market_id", "line", F.round(K.back_lay_mid(F.col("size") + 1, F.col("size") + 2), 6).alias("p")))
q("impute_complement", TRADE, body="""
SELECT market_id, line, round(CASE WHEN 1.02 - price_milli / 1000 > 0 AND 1.02 - price_milli / 1000 < 1 THEN 1.02 - price_milli / 1000 END, 6) AS p
    FROM v_trade
""")(
    lambda t: t.trade.select("market_id", "line", F.round(K.impute_complement(F.col("price_milli") / 1000, F.lit(1.02)), 6).alias("p")))
q("parimutuel_prob", TRADE, body="""
SELECT market_id, round(CAST(y AS DOUBLE) / nullif(y + n, 0), 6) AS p FROM (SELECT market_id, sum(CASE WHEN outcome_index = 0 THEN cents ELSE 0 END)
    AS y, sum(CASE WHEN outcome_index = 1 THEN cents ELSE 0 END) AS n FROM v_trade GROUP BY market_id)
""")(
    lambda t: t.trade.groupBy("market_id").agg(F.sum(F.expr("CASE WHEN outcome_index = 0 THEN cents ELSE 0 END")).alias("y"), F.sum(F.expr("CASE WHEN outcome_index = 1 THEN cents ELSE 0 END"))
        .alias("n")).select("market_id", F.round(K.parimutuel_prob("y", "n"), 6).alias("p")))
q("certainty_or_pair_filter", TRADE, body="""
SELECT market_id, line FROM v_trade WHERE size > 0 AND size <= 168 AND (price_milli >= 950 OR price_milli <= 50)
""")(
    lambda t: t.trade.where(K.certainty_or_pair("size", F.col("price_milli") / 1000, F.lit(1.0), F.lit(1.0))).select("market_id",
        "line"))
q("detect_entry_filter", TRADE, body="""
SELECT market_id, line, CASE WHEN price_milli > 950 THEN 'YES' ELSE 'NO' END AS side FROM v_trade WHERE (price_milli > 950 AND price_milli BETWEEN 950
    AND 970 OR price_milli < 50 AND 1000 - price_milli BETWEEN 950 AND 970) AND size < 24 AND cents >= 1000
""")(
    lambda t: K.detect_entry(t.trade.withColumns({"last": F.col("price_milli") / 1000, "bid": F.col("price_milli") / 1000, "ask": F.col("price_milli") / 1000}),
        "last", "bid", "ask", "size", "cents").select("market_id", "line", "side"))
q("arb_qualify_filter", TRADE, body="""
SELECT market_id, line FROM v_trade WHERE size / 10 >= 1 AND price_milli / 10 BETWEEN 0.5 AND 90 AND cents > 0 AND price_milli >= 50
""")(
    lambda t: K.arb_qualify(t.trade.withColumns({"edge_pct": F.col("size") / 10, "days": F.col("price_milli") / 10, "depth": F.col("cents"),
        "sum_asks": F.col("price_milli") / 1000})).select("market_id", "line"))
q("clean_pair_filter", TICK, body="""
SELECT id FROM v_tick WHERE abs(cents / 10000 - 0.5) <= 0.15
""")(
    lambda t: K.clean_pairs(t.tick.withColumn("s", F.col("cents") / 10000 - 0.5), "cents", "s").select("id"))
q("relative_since_filter", TICK, body="""
SELECT id FROM v_tick WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-20 00:00:00')
""")(
    lambda t: K.since(t.tick, "ts", "2024-01-27 00:00:00", "7d").select("id"))
q("join_fanout_legs", TICK, body="""
SELECT event, count(*) AS n FROM v_tick JOIN (VALUES ('click', 1), ('click', 2), ('purchase', 2)) l(asset, event) USING (asset) GROUP BY event
""")(
    lambda t: K.fanout_legs(t.tick, t.spark.createDataFrame([("click", 1), ("click", 2), ("purchase", 2)],
        "asset string, event int")).groupBy("event").agg(F.count("*").alias("n")))
q("pair_sum_edge", TRADE, body="""
SELECT y.market_id, y.ask + n.ask AS total, least(y.size, n.size) AS shares, (1000 - y.ask - n.ask) * least(y.size, n.size) AS profit_milli FROM
    (SELECT market_id, first(price_milli ORDER BY price_milli, size) AS ask, first(size ORDER BY price_milli, size) AS size FROM v_trade WHERE
    outcome_index = 0 GROUP BY market_id) y JOIN (SELECT market_id, first(price_milli ORDER BY price_milli, size) AS ask, first(size ORDER BY
    price_milli, size) AS size FROM v_trade WHERE outcome_index = 1 GROUP BY market_id) n USING (market_id) WHERE y.ask + n.ask < 1000
""")(
    lambda t: (lambda x: K.pair_sum_edge(x.where("outcome_index = 0"), x.where("outcome_index = 1"), "market_id"))(t.trade.withColumnRenamed("price_milli",
        "ask")))
q("candle_vwap_fallback", TICK, HOURLY, body="""
SELECT asset, round(CAST(sum(close * volume) AS DOUBLE) / sum(volume), 4) AS price, 'traded' AS source FROM hourly GROUP BY asset
""")(
    lambda t: K.candle_vwap(hourly(t).withColumn("reference", F.col("open")), "asset"))
q("detection_rate_forecast", TICK, body="""
SELECT n, keys, round(n / h, 4) AS per_hour, round(1000.0::DOUBLE / (keys / h), 4) AS hours_needed, 1000.0::DOUBLE / (keys / h) > 168 AS warn FROM
    (SELECT count(*) AS n, count(DISTINCT actor) AS keys, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS h FROM v_tick)
""")(
    lambda t: K.detection_forecast(t.tick, "actor", 1000))
q("winner_from_scores", TRADE, body="""
SELECT market_id, line, CASE WHEN outcome_index = 1 THEN CASE WHEN size > 25 THEN 'home' WHEN size < 25 THEN 'away' ELSE 'draw' END END AS winner FROM
    v_trade
""")(
    lambda t: t.trade.select("market_id", "line", K.winner_from_scores("size", F.lit(25), F.col("outcome_index") == 1).alias("winner")))
