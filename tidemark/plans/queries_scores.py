"""Scores, gates, rules, moves and the relational source, each with an SQL twin over the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A, impact as I, markets as K, ordered as O, running as U
from tidemark.plans.bindings import MARKET, TICK, TRADE, Tables
from tidemark.plans.queries import DAY, q
from tidemark.plans.queries_more import MOVES, SIG, moves, sigma
from tidemark.plans.queries_parsing import K_, View, folder, pick
from tidemark.sources import files

# -- moves and expiries ------------------------------------------------------------------------------------------------
_at = "LEFT JOIN s {0} ON p.asset = {0}.asset AND p.t{0} >= {0}.ts"
q("move_zscore", TICK, "s AS (SELECT asset, ts, last(cents ORDER BY id) AS cents FROM v_tick GROUP BY asset, ts)", """
p AS (SELECT id, asset, ts - INTERVAL 30 SECOND AS ta, ts + INTERVAL 30 SECOND AS tb, ts + INTERVAL 60 SECOND AS tc, ts + INTERVAL 300 SECOND AS td,
             stddev_samp(CAST(cents AS DOUBLE)) OVER (PARTITION BY asset ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS sigma FROM v_tick)""", f"""
m AS (SELECT p.id, p.asset, a.cents AS before, b.cents - a.cents AS move_30, c.cents - a.cents AS move_60, d.cents - a.cents AS move_300, sigma FROM p
      {" ".join("ASOF " + _at.format(x) for x in "abcd")})""", """
z AS (SELECT *, CASE WHEN sigma > 0 THEN round(move_300 / sigma, 4) END AS z FROM m)""", body="""
SELECT id, asset, before, move_30, move_60, move_300, round(sigma, 6) AS sigma, z,
       CASE WHEN abs(z) < 1.0 THEN 'low' WHEN abs(z) < 2.5 THEN 'medium' WHEN z IS NOT NULL THEN 'high' END AS signal FROM z
""")(lambda t: U.move_scores(t.tick, t.tick, "asset", "cents", "id"))

OFFSETS = (5 * DAY, 10 * DAY, 20 * DAY, 30 * DAY)
q("expiry_error", MARKET, TRADE, "pt AS (SELECT market_id, ts, last(price_milli ORDER BY line, price_milli) AS p FROM v_trade GROUP BY ALL)", """
spot AS (SELECT market_id, round((max(size) - 35) / 10.0, 4) AS z FROM v_trade GROUP BY market_id)""", f"""
e AS (SELECT m.market_id, o.off, abs(pt.p / 1000 - m.yes) AS err FROM (SELECT market_id, yes, end_ts FROM v_market WHERE yes IS NOT NULL) m
      CROSS JOIN (VALUES {", ".join(f"({x})" for x in OFFSETS)}) o(off) ASOF JOIN pt ON m.market_id = pt.market_id AND m.end_ts - to_seconds(o.off) >= pt.ts)""", body="""
SELECT market_id, off AS "offset", round(err, 4) AS error, err >= 0.15 AS mispriced, z AS spot_z, err >= 0.2 AND abs(z) >= 1 AS actionable FROM e JOIN spot USING (market_id)
""")(lambda t: K.expiry_error(
    t.trade.groupBy("market_id", "ts").agg(F.max_by("price_milli", F.struct("line", "price_milli")).alias("price_milli"), F.max("line").alias("line")), t.market, list(OFFSETS),
    spot=t.trade.groupBy("market_id").agg(F.round((F.max("size") - 35) / 10.0, 4).alias("z"))))

q("digital_fair_value", MARKET, "d AS (SELECT market_id, (ln(volume / 1000 / 150.0) - 0.125::DOUBLE * 0.25) / (0.5::DOUBLE * sqrt(0.25)) AS x FROM v_market)", """
e AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * (abs(x) / sqrt(2))) AS t FROM d)""", """
f AS (SELECT market_id, x, 1 - t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x / 2) AS erf FROM e)""", body="""
SELECT market_id, round(CASE WHEN x >= 0 THEN 0.5::DOUBLE * (1 + erf) ELSE 0.5::DOUBLE * (1 - erf) END, 5) AS fair FROM f
""")(lambda t: t.market.select("market_id", F.round(S.digital_fair_value(F.col("volume") / 1000, F.lit(150.0), F.lit(0.25)), 5).alias("fair")))

THEME = "CASE actor % 4 WHEN 0 THEN 'sport' WHEN 1 THEN 'crypto' WHEN 2 THEN 'world' ELSE 'rates' END"
FEEDS = {"click": "sport", "error": "crypto", "signup": "world", "view": "rates", "purchase": "global"}
HOURS = 3_600_000_000


def flagged(t: Tables) -> DataFrame:
    windows = moves(t).withColumn("end_ts", F.timestamp_micros((F.col("window") + 1) * 6 * HOURS))
    feeds = t.tick.select("asset").distinct().select(F.col("asset").alias("feed"), F.array(F.expr("CASE asset " + " ".join(f"WHEN '{f}' THEN '{g}'" for f, g in FEEDS.items()) + " END")).alias("themes"))
    return I.flag_moves(
        windows, sigma(t), "actor", themes=t.tick.select("actor", F.expr(THEME).alias("grp")).distinct(), feeds=feeds, items=t.tick.select(F.col("asset").alias("feed"), "ts", "id"),
        news=t.tick.where("asset = 'purchase'").select("actor", "ts"), ends=t.tick.groupBy("actor").agg(F.max("ts").alias("key_end")),
        volume="n", least_z=1.5, quiet_us=18 * HOURS, margin_us=24 * HOURS, least_volume=2, hard_us=24 * HOURS, soft_us=3 * HOURS)


q("flag_moves", TICK, MOVES, SIG, f"""
zs AS (SELECT w.actor, w."window", w."window" * {6 * HOURS} AS start_us, w.n, {THEME.replace("actor", "w.actor")} AS grp, round(abs(last - first) / sigma, 4) AS z FROM w JOIN sig USING (actor) WHERE sigma IS NOT NULL)""", f"""
f AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{g}')" for f, g in FEEDS.items())}) f(feed, theme))""", f"""
silence AS (SELECT x."window", f.feed, x."window" * {6 * HOURS} - max(epoch_us(v.ts)) AS silent FROM (SELECT DISTINCT "window" FROM w) x CROSS JOIN f
            LEFT JOIN v_tick v ON v.asset = f.feed AND epoch_us(v.ts) <= x."window" * {6 * HOURS} GROUP BY x."window", f.feed)""", f"""
health AS (SELECT g.grp, s."window", bool_and(coalesce(silent <= {24 * HOURS}, false)) AS healthy, bool_or(coalesce(silent > {3 * HOURS}, true)) AS low_confidence
           FROM (SELECT DISTINCT grp FROM zs) g JOIN f ON f.theme = g.grp OR f.theme = 'global' JOIN silence s ON s.feed = f.feed GROUP BY ALL)""", """
co AS (SELECT grp, "window", count(*) FILTER (WHERE z >= 1) AS movers FROM zs GROUP BY ALL)""", f"""
big AS (SELECT zs.*, low_confidence, movers - CASE WHEN z >= 1 THEN 1 ELSE 0 END AS nearby FROM zs JOIN health h ON h.grp = zs.grp AND h."window" = zs."window" AND healthy
        JOIN co ON co.grp = zs.grp AND co."window" = zs."window" JOIN (SELECT actor, min("window") * {6 * HOURS} AS first_us FROM w GROUP BY actor) st ON st.actor = zs.actor
        JOIN (SELECT actor, max(epoch_us(ts)) AS end_us FROM v_tick GROUP BY actor) e ON e.actor = zs.actor
        WHERE z >= 1.5 AND n >= 2 AND start_us >= first_us + {18 * HOURS} AND start_us + {6 * HOURS} <= end_us - {24 * HOURS})""", body=f"""
SELECT b.actor, "window", z, round((start_us - min(epoch_us(p.ts))) / 60e6, 4) AS lead_min, low_confidence, nearby FROM big b
LEFT JOIN v_tick p ON p.asset = 'purchase' AND p.actor = b.actor AND epoch_us(p.ts) BETWEEN start_us - {24 * HOURS} AND start_us + 600000000
GROUP BY b.actor, "window", z, start_us, low_confidence, nearby ORDER BY lead_min DESC NULLS LAST, z DESC, b.actor, "window"
""")(flagged)

# -- gates -------------------------------------------------------------------------------------------------------------
CELLS = {"tight": 0.6, "wide": 0.9}
SEED = 100_000.0
POSITION = View(
    "v_pos", "lineitem",
    cell="CASE l_suppkey % 2 WHEN 0 THEN 'tight' ELSE 'wide' END", market="l_partkey % 400", side="CASE l_returnflag WHEN 'R' THEN 'YES' ELSE 'NO' END", event="l_partkey % 150",
    opened="CAST(l_shipdate AS TIMESTAMP)", held_days="CASE WHEN l_linenumber < 7 THEN CAST(l_quantity AS INT) END", pnl="CAST(round(l_extendedprice * 100) AS BIGINT) % 2001 - 1000",
)
CANDIDATE = View(
    "v_cand", "orders",
    id=K_, ts="CAST(o_orderdate AS TIMESTAMP)", market=f"{K_} % 400", side=pick("o_custkey", "YES", "NO"), event=f"{K_} % 150", ask="CAST(round(o_totalprice * 100) AS BIGINT) % 1000 / 1000.0",
)


def gates(t: Tables, from_peak: bool) -> DataFrame:
    positions = POSITION.of(t).withColumn("closed", F.timestamp_micros(F.unix_micros("opened") + F.col("held_days").cast("long") * DAY * 1_000_000))
    return U.gate_reasons(CANDIDATE.of(t).withColumn("ask", F.col("ask").cast("double")), positions, CELLS, SEED, from_peak=from_peak)


for _name, _lost in (("gate_reason", f"-coalesce(e.pnl, 0) / {SEED}"), ("gate_reason_peak", f"(coalesce(greatest(e.peak, 0), 0) - coalesce(e.pnl, 0)) / ({SEED} + coalesce(greatest(e.peak, 0), 0))")):
    q(_name, POSITION.sql, CANDIDATE.sql, """
p AS (SELECT *, opened + to_days(held_days) AS closed FROM v_pos)""", f"""
c AS (SELECT * FROM v_cand, (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in CELLS.items())}) x(cell, cap))""", """
h AS (SELECT c.id, c.cell, count(*) AS held FROM c JOIN p ON c.cell = p.cell AND c.market = p.market AND c.side = p.side AND opened <= ts AND (closed IS NULL OR closed > ts) GROUP BY ALL)""", """
v AS (SELECT c.id, c.cell, count(*) AS held FROM c JOIN p ON c.cell = p.cell AND c.event = p.event AND opened <= ts AND (closed IS NULL OR closed > ts) GROUP BY ALL)""", """
r AS (SELECT cell, closed AS ts, sum(sum(pnl)) OVER w AS pnl, sum(count(*)) OVER w AS done FROM p WHERE closed IS NOT NULL GROUP BY cell, closed WINDOW w AS (PARTITION BY cell ORDER BY closed))""", """
e AS (SELECT *, max(pnl) OVER (PARTITION BY cell ORDER BY ts) AS peak FROM r)""", body=f"""
SELECT c.id, c.cell, CASE WHEN ask > cap THEN 'cap_too_tight' WHEN h.held > 0 THEN 'already_open' WHEN {_lost} > 0.2 THEN 'drawdown_breaker'
       WHEN v.held >= 3 THEN 'event_concentration_cap' WHEN e.done >= 20 AND e.pnl < 0 THEN 'early_killed' END AS reason
FROM c ASOF LEFT JOIN e ON c.cell = e.cell AND c.ts >= e.ts LEFT JOIN h ON h.id = c.id AND h.cell = c.cell LEFT JOIN v ON v.id = c.id AND v.cell = c.cell
""")(lambda t, peak=_name.endswith("peak"): gates(t, peak))

# -- rules -------------------------------------------------------------------------------------------------------------
#: A slug for every rule of S.SUBCATEGORIES, for its exclusions, and for none.
SLUGS = [
    "test-lions-vs-bears", "lions-spread-3", "lions-handicap-2", "lions-win-by-7-or-more", "lions-minus-3pt5", "lions-run-line", "wings-puck-line-1", "lions-over-200", "messi-over-2-goals-by-half", "lions-total-points-45",
    "lions-o-u-44", "city-both-teams-to-score", "most-points-by-luka", "city-first-goal-time", "kane-anytime-goalscorer", "lions-coin-toss-heads", "lions-halftime-show", "rome-fastest-lap-leclerc", "rome-pole-position-norris",
    "rome-podium-piastri", "rome-safety-car", "jokic-double-double", "kane-hat-trick", "city-man-of-the-match", "ward-second-overall-pick", "jones-method-of-victory", "jones-go-the-distance", "will-the-king-attend-ascot",
    "lions-nfc-champion", "lions-win-the-super-cup", "luka-mvp", "stroud-rookie-of-the-year", "kane-golden-boot", "leeds-relegated", "jazz-make-the-playoffs", "heat-win-the-division", "everton-finish-last", "jets-season-wins-7",
    "adams-be-traded-soon", "bulls-next-coach", "alcaraz-win-wimbledon", "dune-oscars-best-picture", "rome-grand-prix-winner", "lions-halftime-result", "ufc-jones-aspinall", "will-lions-beat-bears", "lions-vs-bears",
    "bears-at-lions-2026-04-25", "nba-okc-phx-2026-04-25", "lions-vs-bears-champion-belt", "lions-vs-bears-win-the-gold-cup", "zverev-vs-ruud-win-the-paris-open", "rain-in-lyon", "",
]
KIND = View("v_kind", "orders", market_id=K_, slug=f"concat(CASE WHEN o_custkey % 3 = 0 THEN 'x7-' ELSE '' END, split_part('{'|'.join(SLUGS)}', '|', CAST({K_} % {len(SLUGS)} + 1 AS INT)))")


def rule_sql(column: str) -> str:
    """The rules one by one, as a reader of the table would try them."""
    one = lambda pattern, label, *x: f"WHEN regexp_matches({column}, '{pattern}')" + "".join(f" AND NOT regexp_matches({column}, '{e}')" for e in x) + f" THEN '{label}'"
    return "CASE " + " ".join(one(*rule) for rule in S.SUBCATEGORIES) + " ELSE 'uncategorized' END"


q("subcategory_classify", KIND.sql, body=f"SELECT market_id, {rule_sql('lower(slug)')} AS subcategory FROM v_kind")(
    lambda t: KIND.of(t).select("market_id", S.subcategory("slug").alias("subcategory")))
q("is_game_outcome", KIND.sql, body=f"SELECT market_id FROM v_kind WHERE {rule_sql('lower(slug)')} = 'game_outcome'")(
    lambda t: KIND.of(t).where(S.is_game_outcome("slug")).select("market_id"))

WORDS = [("fixings", ["bolt", "ring"], ["red", "blue"]), ("drive", ["gear", "rod"], []), ("flat", ["plate"], ["large", "small"])]
_holds = lambda words: "(" + " OR ".join(f"contains(p_name, '{w}')" for w in words) + ")"
q("categorize_keywords", body=f"""
SELECT label, count(*) AS n FROM (SELECT CASE {" ".join(f"WHEN {' AND '.join(_holds(x) for x in (some, required) if x)} THEN '{label}'" for label, some, required in WORDS)} ELSE 'other' END AS label FROM part) GROUP BY label
""")(lambda t: t.part.select(S.keywords(F.col("p_name"), WORDS).alias("label")).groupBy("label").agg(F.count("*").alias("n")))

# -- fees, ranks, profiles ---------------------------------------------------------------------------------------------
BANDS = [("all", 0, 1000), ("low", 0, 100), ("mid", 400, 600), ("high", 900, 999)]


def fee_bands(t: Tables) -> DataFrame:
    """The fee is the tax of a line, in hundredths of a share's price, on its shares; in thousandths of a basis point. The fees are
    written once, as the quantiles of large bands read them several times."""
    price = F.col("price_milli") / 1000
    paid = t.trade.join(t.lineitem.select(F.col("l_orderkey").alias("market_id"), F.col("l_linenumber").alias("line"), "l_tax"), ["market_id", "line"])
    bps = F.floor(S.realized_fee_bps(F.col("l_tax") * F.col("size") / 100, F.col("size"), price) * 1000 + 0.5)
    band = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in BANDS]))
    at = folder(t)
    files.write_parquet(paid.select("price_milli", bps.alias("bps")).where("bps is not null"), at)
    rows = t.spark.read.parquet(at).select("bps", "price_milli", band.alias("b")).where("price_milli between b.lo and b.hi").select("b.band", "bps")
    stats = A.distribution_stats(rows, "band", "bps", (0.5, 0.9)).drop("mean")
    means = rows.groupBy("band").agg(F.floor(F.sum("bps") / F.count("*") + 0.5).alias("mean"), F.count_if(F.col("bps") == 0).alias("free"))
    return stats.join(means, "band")


q("realized_fee_bands", TRADE, """
f AS (SELECT price_milli, CAST(floor((l_tax * size / 100) / (size * least(price_milli / 1000, 1 - price_milli / 1000)) * 10000 * 1000 + 0.5) AS BIGINT) AS bps FROM v_trade
      JOIN (SELECT l_orderkey AS market_id, l_linenumber AS line, l_tax FROM lineitem) USING (market_id, line) WHERE price_milli > 0)""", body=f"""
SELECT band, count(*) AS n, round(quantile_cont(bps, 0.5), 4) AS p50, round(quantile_cont(bps, 0.9), 4) AS p90, CAST(floor(sum(bps) / count(*) + 0.5) AS BIGINT) AS mean, min(bps) AS least, max(bps) AS most,
       count(*) FILTER (WHERE bps = 0) AS free FROM f, (VALUES {", ".join(str(b) for b in BANDS)}) b(band, lo, hi) WHERE price_milli BETWEEN lo AND hi GROUP BY band
""")(fee_bands)

q("rank_in_group_stats", MARKET, TRADE, """
x AS (SELECT category, price_milli, outcome_index, row_number() OVER (PARTITION BY market_id ORDER BY price_milli DESC, line, wallet, size, outcome_index) AS rank, count(*) OVER (PARTITION BY market_id) AS legs FROM v_trade JOIN v_market USING (market_id))""", """
g AS (SELECT category, rank, count(*) AS n, avg(CAST(outcome_index AS DOUBLE)) AS rate, sum(price_milli) / count(*) AS mean, min(price_milli) AS least, max(price_milli) AS most
      FROM x WHERE legs = 3 GROUP BY GROUPING SETS ((rank), (category, rank)))""", body="""
SELECT category, rank, n, floor(rate * 1e6 + 0.5) / 1e6 AS rate, floor(mean * 1e6 + 0.5) / 1e6 AS mean, least, most, floor((rate - mean) * 1e6 + 0.5) / 1e6 AS deviation FROM g WHERE n >= 5
""")(lambda t: O.rank_stats(O.dealt(t.trade, "market_id").withColumn("tie", F.struct("line", "wallet", "size", "outcome_index")).join(t.market.select("market_id", "category"), "market_id"), "market_id", "price_milli", "tie", "outcome_index", 3, ["category"], 5))

KINDS = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
q("dataset_profile", body=f"""
SELECT part, n, 11 AS n_columns, '{KINDS}' AS columns FROM (SELECT 'lineitem.parquet' AS part, count(*) AS n FROM lineitem UNION ALL SELECT NULL, count(*) FROM lineitem)
""")(lambda t: files.profile(t.lineitem))


def relational(t: Tables) -> DataFrame:
    """The orders landed in a database and read back in four ranges of the key, the filter pushed down; without a database that the
    executors share, the same table landed as files."""
    at = folder(t)
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    url = files.local_database(t.spark, at)
    if url:
        files.land_table(orders, url, "orders", "o_orderstatus VARCHAR(1)")
        low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
        back = files.scan_table(t.spark, url, "orders", "o_orderkey", (low or 0, (high or 0) + 1), 4)
    else:
        files.write_parquet(orders, at)
        back = t.spark.read.parquet(at)
    return back.where("o_totalprice >= 200000 AND o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").select(*[F.col(c).alias(c.lower()) for c in back.columns])


q("scan_relational", body="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey
""")(relational)
