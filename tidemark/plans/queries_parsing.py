"""Parsers, order books, matching by tokens and tickers, and files, over columns built from the given tables.

A built view is one SQL text that both engines run: strings by concat, lists by the operator's own functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A, books as B, joins as J, markets as K
from tidemark.plans.bindings import MARKET, TICK, TRADE, Tables
from tidemark.plans.queries import DAY, q
from tidemark.sources import files


class View:
    """Columns over one table, as a Spark view and as SQL."""

    def __init__(self, name: str, table: str, **columns: str):
        self.table, self.columns = table, columns
        self.sql = f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table})"

    def of(self, t: Tables) -> DataFrame:
        return t.table(self.table).selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])


def pick(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


TEXT = "CAST({} AS STRING)"
K_ = "o_orderkey"
SLUG = View(
    "v_slug", "orders",
    market_id=K_,
    updown=f"concat('eth-updown-', CAST({K_} % 59 + 1 AS STRING), {pick(K_, 'm', 'h', 'd', 'x')}, '-', CAST(o_custkey AS STRING))",
    barrier=f"concat('will-btc-', {pick(K_, 'reach', 'dip-to', 'hit', 'touch')}, '-', CAST({K_} % 90 + 10 AS STRING), {pick(f'({K_} + 1)', 'k', 'pt5', '')}, '-in-may')",
    above=f"concat({pick(K_, 'bitcoin', 'solana', 'Gold9')}, '-above-', CAST({K_} % 200 AS STRING), {pick(K_, 'pt25', '')}, '-on-may-3')",
    title=f"concat('Will ', {pick(K_, 'Bitcoin', 'ethereum', 'solana or bitcoin', 'gold')}, ' rise?')",
    ticker=f"concat('XXGAME-26', {pick(K_, 'APR', 'MAY')}, lpad(CAST({K_} % 28 + 1 AS STRING), 2, '0'), {pick(K_, 'OKCPHX-PHX', 'OKCPHX-OKC', 'BOSNYK', 'LALDEN-LAL')})",
    matchup=f"concat({pick(K_, 'Lions', 'Will Lions', 'Bears')}, {pick(K_, ' vs. Team ', ' win on May ', ' and ')}, CAST(o_custkey AS STRING), {pick(f'(o_custkey + {K_})', ' (final)', '', ': live')})",
    stamp=f"concat({pick(K_, '2024-03-', '2024-03-', 'Mar ', 'on ')}, lpad(CAST({K_} % 28 + 1 AS STRING), 2, '0'), {pick(K_, ' 10:00:00+00', 'T10:00:00Z', ', 2024 10:00', '')})",
    cadence=f"concat('temp-', {pick(K_, '2024-05-06', 'week-of-may', 'in-may-high', 'ever', '12-mon-low')})",
    theme=f"{pick(K_, 'iran-deal', 'israel-x', 'russia-ukraine-end', 'aid-to-ukraine', 'china-y', 'taiwan', 'uk-z', 'europe', 'control-a', 'other')}",
)
PRICES = View(
    "v_prices", "lineitem",
    k="l_orderkey", line="l_linenumber", milli="CAST(l_quantity AS BIGINT) * 19",
    raw="CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN '[\"1\"]' WHEN 1 THEN 'junk' "
        "ELSE concat('[\"0.', lpad(CAST(CAST(l_quantity AS BIGINT) * 19 AS STRING), 3, '0'), '\", \"0.', lpad(CAST(1000 - CAST(l_quantity AS BIGINT) * 19 AS STRING), 3, '0'), '\"]') END",
)

# -- parsers ---------------------------------------------------------------------------------------------------------
q("parse_outcome_prices", PRICES.sql, body="""
SELECT k, line, CASE WHEN (k + line) % 5 > 1 THEN milli / 1000 END AS yes, CASE WHEN (k + line) % 5 > 1 THEN (1000 - milli) / 1000 END AS no FROM v_prices
""")(lambda t: PRICES.of(t).withColumn("p", S.parse_outcome_prices("raw")).select("k", "line", "p.yes", "p.no"))

q("zip_label_price", PRICES.sql, body="""
SELECT k, line, CASE k % 3 WHEN 0 THEN (1000 - milli) / 1000 ELSE milli / 1000 END AS price FROM v_prices
""")(lambda t: PRICES.of(t).select("k", "line", K.zip_label_price(
    F.when(F.col("k") % 3 == 0, F.array(F.lit("No"), F.lit("YES"))).when(F.col("k") % 3 == 1, F.array(F.lit("Yes"), F.lit("No"))).otherwise(F.array(F.lit("A"), F.lit("B"))),
    F.array(F.col("milli") / 1000, (1000 - F.col("milli")) / 1000)).alias("price")))

q("derive_resolution", body="""
SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 1 THEN 'YES' WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN 'NO' ELSE 'unresolved' END AS outcome FROM orders
""")(lambda t: t.orders.select(F.col("o_orderkey").alias("k"), S.derive_resolution(
    (F.col("o_orderstatus") == "F").cast("int"), F.expr("CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0.5 END"), F.expr("CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 0.5 END")).alias("outcome")))

q("decode_uint256", TRADE, body="SELECT market_id, line, CASE WHEN line = 7 THEN 0 ELSE cents * 1000003 / 1e6 END AS amount FROM v_trade")(
    lambda t: t.trade.select("market_id", "line", S.decode_uint(F.when(F.col("line") != 7, F.unhex(F.lpad(F.hex(F.col("cents") * 1000003), 64, "0")))).alias("amount")))

q("parse_timestamp_multi", SLUG.sql, body="""
SELECT market_id, epoch_us(try_strptime(stamp, ['%Y-%m-%d %H:%M:%S+00', '%Y-%m-%dT%H:%M:%SZ', '%b %d, %Y %H:%M'])) AS us FROM v_slug
""")(lambda t: SLUG.of(t).select("market_id", F.unix_micros(S.parse_timestamp_multi("stamp")).alias("us")))

q("event_time_fallback", MARKET, body="""
SELECT market_id, epoch_us(coalesce(CASE WHEN market_id % 3 > 0 THEN end_ts - INTERVAL 2 DAY END, end_ts)) AS us FROM v_market
""")(lambda t: t.market.select("market_id", F.unix_micros(S.first_known(F.expr("CASE WHEN market_id % 3 > 0 THEN end_ts - INTERVAL 2 DAY END"), "end_ts")).alias("us")))

q("best_event_ts", TICK, body="""
SELECT id, epoch_us(least(coalesce(pub, ts), ts)) AS us FROM (SELECT *, CASE id % 3 WHEN 0 THEN ts - INTERVAL 1 HOUR WHEN 1 THEN ts + INTERVAL 1 HOUR END AS pub FROM v_tick)
""")(lambda t: t.tick.withColumn("pub", F.expr("CASE id % 3 WHEN 0 THEN ts - INTERVAL 1 HOUR WHEN 1 THEN ts + INTERVAL 1 HOUR END")).select("id", F.unix_micros(S.best_event_ts("pub", "ts")).alias("us")))

q("parse_slug_duration", SLUG.sql, body="""
SELECT market_id, TRY_CAST(regexp_extract(updown, '-updown-(\\d+)([mhd])-', 1) AS INT) * CASE regexp_extract(updown, '-updown-(\\d+)([mhd])-', 2)
WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END AS seconds FROM v_slug
""")(lambda t: SLUG.of(t).select("market_id", S.parse_slug_duration("updown").alias("seconds")))

q("parse_barrier", SLUG.sql, body="""
SELECT market_id, CASE WHEN market_id % 4 < 3 THEN [ 'reach', 'dip', 'hit' ][market_id % 4 + 1] END AS kind,
CASE WHEN market_id % 4 < 3 THEN (market_id % 90 + 10 + CASE WHEN (market_id + 1) % 3 = 1 THEN 0.5 ELSE 0 END) * CASE WHEN (market_id + 1) % 3 = 0 THEN 1000 ELSE 1 END END AS strike FROM v_slug
""")(lambda t: SLUG.of(t).withColumn("b", S.parse_barrier("barrier")).select("market_id", "b.kind", "b.strike"))

q("parse_underlying", SLUG.sql, body="""
SELECT market_id, CASE market_id % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'BTC' END AS ticker FROM v_slug
""")(lambda t: SLUG.of(t).select("market_id", S.parse_underlying("title", [("bitcoin", "BTC"), ("ethereum", "ETH"), ("solana", "SOL")]).alias("ticker")))

q("parse_above_strike", SLUG.sql, body="""
SELECT market_id, CASE market_id % 3 WHEN 0 THEN 'bitcoin' WHEN 1 THEN 'solana' END AS asset,
CASE WHEN market_id % 3 < 2 THEN market_id % 200 + CASE WHEN market_id % 2 = 0 THEN 0.25 ELSE 0 END END AS strike FROM v_slug
""")(lambda t: SLUG.of(t).withColumn("a", S.parse_above_strike("above")).select("market_id", "a.asset", "a.strike"))

q("parse_dated_ticker", SLUG.sql, body="""
SELECT market_id, CASE WHEN market_id % 4 <> 2 THEN CAST(make_date(2026, CAST(4 + market_id % 2 AS BIGINT), market_id % 28 + 1) AS STRING) END AS day,
CASE market_id % 4 WHEN 0 THEN 'PHX' WHEN 1 THEN 'OKC' WHEN 3 THEN 'LAL' END AS winner, CASE market_id % 4 WHEN 0 THEN 'OKC' WHEN 1 THEN 'PHX' WHEN 3 THEN 'DEN' END AS loser FROM v_slug
""")(lambda t: SLUG.of(t).withColumn("p", S.parse_dated_ticker("ticker")).select("market_id", F.col("p.day").cast("string").alias("day"), "p.winner", "p.loser"))

q("parse_matchup", SLUG.sql, body="""
SELECT market_id, CASE market_id % 3 WHEN 0 THEN concat('Lions|Team ', regexp_extract(matchup, 'Team (\\d+)', 1)) WHEN 1 THEN 'Lions' END AS sides FROM v_slug
""")(lambda t: SLUG.of(t).withColumn("s", S.parse_matchup("matchup")).select("market_id", F.when(F.col("s").isNotNull(), F.concat_ws("|", "s")).alias("sides")))

q("cadence_from_slug", SLUG.sql, body="""
SELECT market_id, CASE WHEN regexp_matches(cadence, '-\\d{4}-\\d{2}-\\d{2}') THEN 'daily' WHEN regexp_matches(cadence, 'week-of-|\\d{1,2}-(mon|tue|wed|thu|fri|sat|sun)-') THEN 'weekly'
WHEN regexp_matches(cadence, '-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-') THEN 'monthly' ELSE 'one-off' END AS cadence FROM v_slug
""")(lambda t: SLUG.of(t).select("market_id", S.cadence_from_slug("cadence").alias("cadence")))

GROUP = """CASE WHEN theme LIKE 'iran-%' OR theme LIKE 'israel-%' THEN 'middle-east' WHEN theme LIKE '%ukraine%' THEN 'ukraine'
WHEN theme LIKE 'china-%' OR theme LIKE 'taiwan%' THEN 'asia' WHEN theme LIKE 'uk-%' OR theme LIKE 'europe%' THEN 'uk' ELSE 'global' END"""
q("theme_group", SLUG.sql, f"g AS (SELECT market_id, {GROUP} AS grp FROM v_slug)", body="""
SELECT DISTINCT market_id, grp, feed FROM g JOIN (SELECT concat('feed-', CAST(n_nationkey AS STRING)) AS feed,
CASE n_nationkey % 5 WHEN 0 THEN 'asia' WHEN 1 THEN 'uk' WHEN 2 THEN 'ukraine' WHEN 3 THEN 'middle-east' ELSE 'global' END AS theme FROM nation) f ON grp = theme OR theme = 'global'
""")(lambda t: B.relevant_feeds(SLUG.of(t).select("market_id", S.theme_group("theme").alias("grp")), t.nation.select(
    F.expr("concat('feed-', n_nationkey)").alias("feed"),
    F.array(F.expr("CASE n_nationkey % 5 WHEN 0 THEN 'asia' WHEN 1 THEN 'uk' WHEN 2 THEN 'ukraine' WHEN 3 THEN 'middle-east' ELSE 'global' END")).alias("themes")), "grp"))

q("odds_to_prob", TRADE, body="""
SELECT market_id, line, floor(1 / (size / 2.0) * 1e6 + 0.5) / 1e6 AS prob FROM v_trade WHERE market_id NOT IN (SELECT market_id FROM v_trade WHERE size / 2.0 <= 1)
""")(lambda t: B.odds_to_prob(t.trade.withColumn("odds", F.col("size") / 2.0), "market_id", "odds").select("market_id", "line", S.rnd("prob").alias("prob")))

# -- order books: a market's trades as levels, bids 3/10 lower (of whole numbers, as the decimal 0.7 of the SQL has it) --------------------------------------------------------
LEVELS = "v_level AS (SELECT market_id, outcome_index AS side, line, CASE WHEN outcome_index = 1 THEN price_milli * 0.7 / 1000 ELSE price_milli / 1000 END AS price, size FROM v_trade)"
BOOK = "v_best AS (SELECT market_id, max(price) FILTER (WHERE side = 1) AS bid, min(price) FILTER (WHERE side = 0) AS ask FROM v_level GROUP BY market_id)"


def books(t: Tables) -> DataFrame:
    price = F.expr("CASE WHEN outcome_index = 1 THEN price_milli * 7 / 10D / 1000 ELSE price_milli / 1000 END")
    level = F.struct(price.alias("price"), F.col("size").cast("double").alias("size"))
    sides = [F.collect_list(F.when(F.col("outcome_index") == i, level)).alias(n) for i, n in ((1, "bids"), (0, "asks"))]
    return t.trade.groupBy("market_id").agg(*sides)  # an order has at most a few lines


q("book_best_and_depth", TRADE, LEVELS, BOOK, body="""
SELECT market_id, round(any_value(bid), 6) AS bid, round(any_value(ask), 6) AS ask, round(any_value((bid + ask) / 2), 6) AS mid,
round(coalesce(sum(size) FILTER (WHERE side = 1 AND price >= bid - 0.005), 0), 4) AS bid_top, round(coalesce(sum(size) FILTER (WHERE side = 0 AND price <= ask + 0.005), 0), 4) AS ask_top,
round(coalesce(sum(price * size) FILTER (WHERE side = 1), 0), 4) AS bid_notional, round(coalesce(sum(price * size) FILTER (WHERE side = 0), 0), 4) AS ask_notional,
count(*) FILTER (WHERE side = 1) AS bid_levels, count(*) FILTER (WHERE side = 0) AS ask_levels,
round(coalesce(sum(price * size) FILTER (WHERE abs(price - (bid + ask) / 2) <= (bid + ask) / 2 * 1500 / 10000), 0), 4) AS near_1500
FROM v_level JOIN v_best USING (market_id) GROUP BY market_id
""")(lambda t: (lambda b: b.select("market_id", *[F.round(c, 6).alias(c) for c in ("bid", "ask", "mid")], *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("bid_top", "ask_top", "bid_notional", "ask_notional")],
    F.col("bid_levels").cast("long").alias("bid_levels"), F.col("ask_levels").cast("long").alias("ask_levels"), F.round("near_1500", 4).alias("near_1500")))(B.best_and_depth(books(t), (1500,))))

q("book_rational_quote", TRADE, LEVELS, body="""
SELECT market_id, round(max(price) FILTER (WHERE side = 1 AND price > 0.05), 6) AS bid,
round(max_by(price * size, price * 1000000 + size) FILTER (WHERE side = 1 AND price > 0.05), 6) AS bid_notional,
round(min(price) FILTER (WHERE side = 0 AND price < 0.95), 6) AS ask,
round(max_by(price * size, -price * 1000000 + size) FILTER (WHERE side = 0 AND price < 0.95), 6) AS ask_notional FROM v_level GROUP BY market_id
""")(lambda t: B.rational_quote(books(t)).select("market_id", *[F.round(c, 6).alias(c) for c in ("bid", "bid_notional", "ask", "ask_notional")]))

q("book_capture_below", TRADE, LEVELS, body="""
SELECT market_id, cap, round(coalesce(sum(price * size) FILTER (WHERE side = 0 AND price < cap), 0), 4) AS cost,
round(coalesce(sum((1 - price) * size) FILTER (WHERE side = 0 AND price < cap), 0), 4) AS profit
FROM v_level, (VALUES (0.95::DOUBLE), (0.97::DOUBLE), (0.98::DOUBLE), (0.99::DOUBLE)) c(cap) GROUP BY market_id, cap
""")(lambda t: B.capture_table(books(t), "market_id", [0.95, 0.97, 0.98, 0.99]).select("market_id", "cap", F.round("cost", 4).alias("cost"), F.round("profit", 4).alias("profit")))

q("book_vs_quote_gap", MARKET, TRADE, LEVELS, BOOK, body="""
SELECT market_id, CASE WHEN ask IS NULL THEN 'phantom' WHEN abs(ask - market_id % 7 / 10.0) > 0.2005 THEN 'mismatch' ELSE 'agrees' END AS verdict FROM v_market LEFT JOIN v_best USING (market_id)
""")(lambda t: B.book_vs_quote(t.market.select("market_id", F.expr("market_id % 7 / 10D").alias("quoted")), books(t), "market_id", 0.2005).select("market_id", "verdict"))

q("book_spread_summary", TICK, body="""
SELECT asset, count(*) AS n, round(avg(bps), 4) AS mean_bps, round(min(bps), 4) AS min_bps, round(max(bps), 4) AS max_bps, round(avg(depth), 4) AS mean_depth
FROM (SELECT asset, CAST(id % 100 AS DOUBLE) AS depth, ((cents + 10 + id % 5) - (cents + 5)) / (((cents + 10 + id % 5) + (cents + 5)) / 2) * 10000 AS bps FROM v_tick) GROUP BY asset
""")(lambda t: B.spread_summary(t.tick.select("asset", F.expr("cents + 5").alias("bid"), F.expr("cents + 10 + id % 5").alias("ask"), F.expr("CAST(id % 100 AS DOUBLE)").alias("depth")), "asset"))

q("asset_universe_rank", body="""
SELECT venue, name, volume, row_number() OVER (PARTITION BY venue ORDER BY volume DESC, name, place) AS rank, CASE WHEN name IN ('red widget', 'small ring') THEN 'major' ELSE 'synthetic' END AS kind
FROM (SELECT p_brand AS venue, p_name AS name, p_partkey AS place, CASE WHEN p_size % 5 = 0 THEN 0 ELSE round(p_retailprice * 100) / 100 END AS volume FROM part)
""")(lambda t: B.universe_rank(t.part.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", F.expr("CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE CAST(round(p_retailprice * 100) / 100 AS STRING) END").alias("v")))).alias("x")).select(
    F.col("p_brand").alias("venue"), F.col("x.p_name").alias("names"), F.col("x.v").alias("contexts")), "venue", "names", "contexts", ["red widget", "small ring"]))

NOW = 852_076_800_000_000
q("anchor_window_filter", MARKET, TRADE, body=f"""
SELECT market_id, category, CAST(volume AS BIGINT) AS volume, last FROM (SELECT market_id, category FROM v_market WHERE epoch_us(end_ts) - {NOW} BETWEEN 0 AND {120 * DAY * 1_000_000} AND category IN ('1-URGENT', '2-HIGH')
AND (market_id % 50 + 1) <= 40) m JOIN (SELECT market_id, sum(cents) AS volume, last(price_milli ORDER BY ts, line, price_milli) AS last FROM v_trade
WHERE epoch_us(ts) BETWEEN {NOW} - {400 * DAY * 1_000_000} AND {NOW} + {200 * DAY * 1_000_000} GROUP BY market_id) s USING (market_id) WHERE s.volume >= 1000000 AND last BETWEEN 100 AND 900
""")(lambda t: B.anchor_window(
    t.market.select("market_id", "category", F.col("end_ts").alias("event_ts"), F.timestamp_micros(F.unix_micros("end_ts") - (F.col("market_id") % 50 + 1) * DAY * 1_000_000).alias("start_ts")),
    t.trade.select("market_id", F.timestamp_micros(F.unix_micros("ts") - 200 * DAY * 1_000_000).alias("ts"), F.col("price_milli").alias("price"), "cents", "line"),
    NOW, (0, 120), ["1-URGENT", "2-HIGH"], 40, (100, 900), 1_000_000, 600).select("market_id", "category", "volume", "last"))

# -- matching --------------------------------------------------------------------------------------------------------
GAME = View("v_game", "orders", id="o_orderkey", day="CAST(o_orderdate AS DATE)", home="concat('t', CAST(o_custkey % 40 AS STRING))", away="concat('t', CAST((o_custkey * 7 + o_orderkey) % 40 AS STRING))")
q("join_token_date", GAME.sql, body="""
SELECT a.id AS a_id, min(b.id) AS b_id FROM v_game a JOIN v_game b ON a.id % 2 = 0 AND b.id % 2 = 1 AND b.day BETWEEN a.day - 1 AND a.day + 1
AND ((a.home = b.home AND a.away = b.away) OR (a.home = b.away AND a.away = b.home)) GROUP BY a.id
""")(lambda t: (lambda g: J.token_date(g.where("id % 2 = 0"), g.where("id % 2 = 1")).select("a_id", "b_id"))(
    GAME.of(t).select("id", "day", F.array("home").alias("home"), F.array("away").alias("away"))))

TEAM = View("v_team", "orders", id="o_orderkey", day="CAST(o_orderdate AS DATE)", team=f"{pick('(o_custkey + o_orderkey)', 'Phoenix', 'Boston', 'Denver', 'Orlando')}", ticker=f"concat('GAME-', {pick('o_custkey', 'BOSPHO', 'DENMIA', 'ORLBOS')})")
q("join_ticker_prefix", TEAM.sql, body="""
SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM v_team a JOIN v_team b ON a.id % 4 = 0 AND b.id % 4 > 0 AND b.day BETWEEN a.day - 1 AND a.day + 1 AND contains(b.ticker, upper(substr(a.team, 1, 3)))
""")(lambda t: (lambda g: J.ticker_pairs(g.where("id % 4 = 0"), g.where("id % 4 > 0")))(TEAM.of(t)))


# -- files: the events written and read back ---------------------------------------------------------------------------
def folder(t: Tables) -> str:
    return f"{files.shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


EVENTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("asset", T.StringType()), T.StructField("cents", T.DoubleType())])
PER_ASSET = "SELECT asset, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM v_tick GROUP BY asset"


def per_asset(df: DataFrame) -> DataFrame:
    return df.groupBy("asset").agg(F.count("*").alias("n"), F.sum(F.col("cents").cast("long")).alias("cents"))


def jsonl_events(t: Tables) -> DataFrame:
    at = folder(t)
    lines = t.tick.select(F.to_json(F.struct("id", "asset", F.col("cents").cast("double").alias("cents"))).alias("value"))
    lines.unionByName(t.nation.select(F.concat(F.lit("{bad "), "n_name").alias("value"))).write.text(at)
    return files.scan_jsonl(t.spark, at, EVENTS, ["cents"])


q("scan_jsonl", TICK, body=f"{PER_ASSET} UNION ALL SELECT NULL, count(*), 0 FROM nation")(lambda t: per_asset(jsonl_events(t)))


def csv_events(t: Tables) -> DataFrame:
    at = folder(t)
    files.write_csv(t.tick.where("id % 2 = 0").select("id", "asset", "cents"), f"{at}/a")
    files.write_csv(t.tick.where("id % 2 = 1").select("id", "asset", "cents", "actor"), f"{at}/b")
    return files.scan_csv_mixed(t.spark, [f"{at}/a", f"{at}/b"])


q("scan_csv_mixed", TICK, body="SELECT asset, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, count(*) FILTER (WHERE id % 2 = 1) AS wide FROM v_tick GROUP BY asset")(
    lambda t: csv_events(t).groupBy("asset").agg(F.count("*").alias("n"), F.sum(F.col("cents").cast("long")).alias("cents"), F.count("actor").alias("wide")))
q("sink_csv", TICK, body=PER_ASSET)(lambda t: per_asset(csv_events(t)))


def parquet_parts(t: Tables) -> DataFrame:
    at = folder(t)
    files.write_parquet(t.tick.where("id % 2 = 0").drop("actor"), f"{at}/even")
    files.write_parquet(t.tick.where("id % 2 = 1"), f"{at}/odd")
    return files.scan_parts(t.spark, [f"{at}/even", f"{at}/odd", f"{at}/none"], strict=False)


q("scan_multi_part", TICK, body="SELECT asset, count(*) AS n, count(*) FILTER (WHERE id % 2 = 1) AS known FROM v_tick GROUP BY asset")(
    lambda t: parquet_parts(t).groupBy("asset").agg(F.count("*").alias("n"), F.count("actor").alias("known")))
q("sink_parquet", TICK, body=PER_ASSET)(lambda t: per_asset(parquet_parts(t)))


def labelled_files(t: Tables) -> DataFrame:
    at = folder(t)
    for name, rest in (("spot", 0), ("perp", 1)):
        t.tick.where(f"id % 2 = {rest}").write.parquet(f"{at}/{name}")
    df = t.spark.read.parquet(f"{at}/spot", f"{at}/perp")
    return df.withColumn("part", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).withColumn("label", files.file_label("part", {"spot": "SPOT", "perp": "PERP"}))


q("file_partition_column", TICK, body="SELECT CASE WHEN id % 2 = 0 THEN 'SPOT' ELSE 'PERP' END AS label, count(*) AS n FROM v_tick GROUP BY 1")(
    lambda t: labelled_files(t).groupBy("label").agg(F.count("*").alias("n")))


def json_docs(t: Tables) -> DataFrame:
    at = folder(t)
    items = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("items"))
    items.repartition("n_regionkey").write.option("maxRecordsPerFile", 1).json(at)
    kind = "n_regionkey INT, items ARRAY<STRUCT<n_nationkey: INT, n_name: STRING>>"
    return files.scan_json_docs(t.spark, at, T._parse_datatype_string(kind), "items")


q("scan_json_docs", body="SELECT n_regionkey, n_nationkey, n_name FROM nation")(lambda t: json_docs(t).select("n_regionkey", "item.n_nationkey", "item.n_name"))

q("sink_json_report", MARKET, body="""
SELECT n, cells, CAST(top AS BIGINT) AS top FROM (SELECT count(*) AS n FROM v_market), (SELECT count(*) AS cells, max(c) AS top FROM (SELECT count(*) AS c FROM v_market GROUP BY category))
""")(lambda t: files.json_report(t.market.agg(F.count("*").alias("n")), t.market.groupBy("category").agg(F.count("*").alias("count")), "category").select(
    F.from_json("report", "n BIGINT, cells ARRAY<STRUCT<category: STRING, count: BIGINT>>").alias("r")).select("r.n", F.size("r.cells").cast("long").alias("cells"), F.array_max("r.cells.count").alias("top")))


# -- events as a whole -------------------------------------------------------------------------------------------------
LEG_TEXT = View(
    "v_listed", "orders",
    event_id="o_custkey", active="o_orderstatus <> 'F'", yes="CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END",
    slug=f"concat({pick(K_, 'will-a', 'will-b', 'will-person-', 'will-c', 'will-d', 'will-e', 'will-f')}, CAST({K_} % 13 AS STRING))",
    description="concat('Rules: ', CASE o_custkey % 5 WHEN 0 THEN 'the list may be Expanded later' ELSE 'fixed list' END)",
)
DONE = """ev2 AS (SELECT event_id, count(*) AS legs, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE regexp_matches(slug, 'person-\\d+$')) AS placeholders,
count(yes) AS resolved, CAST(sum(yes) AS BIGINT) AS winners, bool_or(contains(lower(description), 'may be expanded')) AS red_flag FROM v_listed GROUP BY event_id)"""


def completed(t: Tables) -> DataFrame:
    return A.completeness(LEG_TEXT.of(t), "event_id", r"person-\d+$", ["may be expanded"])


q("event_completeness", LEG_TEXT.sql, DONE, body="""
SELECT *, CASE WHEN active < 2 THEN 'DEGENERATE' WHEN red_flag OR placeholders > 0 THEN 'PROBABILISTIC' ELSE 'GUARANTEED' END AS class FROM ev2
""")(completed)

q("resolution_class", LEG_TEXT.sql, DONE, """c AS (SELECT CASE WHEN resolved < legs THEN 'OPEN' WHEN winners = 1 THEN 'LISTED-WIN' WHEN winners = 0 THEN 'TAIL' ELSE 'DEGENERATE' END AS resolution,
count(*) AS events, count(*) FILTER (WHERE placeholders = 0 AND NOT red_flag) AS clean FROM ev2 GROUP BY 1)""", body="""
SELECT resolution, events, clean, CASE WHEN resolution = 'TAIL' THEN round(clean / (SELECT sum(clean) FROM c WHERE resolution IN ('LISTED-WIN', 'TAIL')), 6) END AS tail_rate FROM c
""")(lambda t: A.resolution_class(completed(t)))

q("momentum_label", TICK, "s AS (SELECT asset, ts, last(cents ORDER BY id) AS cents FROM v_tick GROUP BY asset, ts)", """e AS (SELECT f.id, f.actor, f.asset, CASE WHEN f.id % 2 = 0 THEN 1 ELSE -1 END AS side,
f.ts - INTERVAL 1 MINUTE AS t1, f.ts - INTERVAL 241 MINUTE AS t2 FROM v_tick f)""", "n AS (SELECT e.*, s.cents AS now FROM e ASOF LEFT JOIN s ON e.asset = s.asset AND e.t1 >= s.ts)",
  "r AS (SELECT n.actor, side * (now / s.cents - 1) AS ret FROM n ASOF LEFT JOIN s ON n.asset = s.asset AND n.t2 >= s.ts)", body="""
SELECT actor, n, momentum_share, CASE WHEN momentum_share > 0.8 THEN 'lucky' WHEN momentum_share < 0.3 THEN 'structural' ELSE 'mixed' END AS label FROM (
SELECT actor, count(*) AS n, round(count(*) FILTER (WHERE ret > 0.005) / count(*), 6) AS momentum_share FROM r WHERE ret IS NOT NULL GROUP BY actor)
""")(lambda t: A.entry_momentum(t.tick.select("actor", "asset", "ts", "id", F.expr("CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END").alias("side")), t.tick.select("asset", "ts", "cents", "id"), "actor", "asset", "cents"))
