"""Order books as arrays of (price, size) levels, quotes against books, opportunity scans, listed assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalar import best_ask, best_bid, capture_below, depth


def best_and_depth(books: DataFrame, bps: tuple[int, ...] = (25, 50), tick: float = 0.005) -> DataFrame:
    """Best prices, mid, size within ``tick`` of the best, notional within each band of the mid, notional and levels of
    either side. books: bids, asks and any keys."""
    b = books.withColumns({"bid": best_bid("bids"), "ask": best_ask("asks")})
    b = b.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    out = {
        "bid_top": depth("bids", lambda x: x["price"] >= F.col("bid") - tick, notional=False),
        "ask_top": depth("asks", lambda x: x["price"] <= F.col("ask") + tick, notional=False),
        "bid_notional": depth("bids", lambda x: F.lit(True)),
        "ask_notional": depth("asks", lambda x: F.lit(True)),
        "bid_levels": F.size("bids"),
        "ask_levels": F.size("asks"),
    }
    def near(n: int):
        return lambda x: F.abs(x["price"] - F.col("mid")) <= F.col("mid") * n / 10_000

    out |= {f"near_{n}": depth("bids", near(n)) + depth("asks", near(n)) for n in bps}
    return b.withColumns(out).drop("bids", "asks")


def rational_quote(books: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The best bid above ``low`` and the best ask below ``high``, with their notional; of equal prices the larger size."""
    bid = F.array_max(F.transform(F.filter("bids", lambda x: x["price"] > low), lambda x: F.struct(x["price"].alias("p"), x["size"].alias("s"))))
    ask = F.array_max(F.transform(F.filter("asks", lambda x: x["price"] < high), lambda x: F.struct((-x["price"]).alias("p"), x["size"].alias("s"))))
    b = books.withColumns({"__b": bid, "__a": ask}).drop("bids", "asks")
    return b.withColumns({"bid": F.col("__b.p"), "bid_notional": F.col("__b.p") * F.col("__b.s"), "ask": -F.col("__a.p"), "ask_notional": -F.col("__a.p") * F.col("__a.s")}).drop("__b", "__a")


def capture_table(books: DataFrame, key: str, caps: list[float]) -> DataFrame:
    """Cost and profit of taking every ask under each cap."""
    one = [F.struct(F.lit(cap).alias("cap"), *[c.alias(n) for c, n in zip(capture_below("asks", cap), ("cost", "profit"))]) for cap in caps]
    return books.select(key, F.inline(F.array(*one)))


def book_vs_quote(quotes: DataFrame, books: DataFrame, key: str, limit: float = 0.005) -> DataFrame:
    """Quoted asks against the book's top: phantom without a book, mismatch over ``limit``, else agrees."""
    top = books.select(key, best_ask("asks").alias("top"))
    j = quotes.hint("merge").join(top.hint("merge"), key, "left")
    gap = F.abs(F.col("top") - F.col("quoted"))
    return j.withColumn("verdict", F.when(F.col("top").isNull(), "phantom").when(gap > limit, "mismatch").otherwise("agrees"))


def spread_summary(snapshots: DataFrame, key: str) -> DataFrame:
    """Per asset over its snapshots (bid, ask, depth): mean, least and largest spread in bps of the mid, mean depth, in
    ascending order of the mean spread."""
    bps = (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 10_000
    g = snapshots.withColumn("bps", bps).groupBy(key)
    g = g.agg(F.count("*").alias("n"), F.round(F.avg("bps"), 4).alias("mean_bps"), F.round(F.min("bps"), 4).alias("min_bps"), F.round(F.max("bps"), 4).alias("max_bps"), F.round(F.avg("depth"), 4).alias("mean_depth"))
    return g.orderBy("mean_bps", key)


def universe_rank(venues: DataFrame, venue: str, names: str, contexts: str, majors: list[str]) -> DataFrame:
    """Listed assets with what stands at the same place in the array of contexts (volumes as text, coerced), ranked by
    volume within their venue and tagged major or synthetic. Null or bad volumes count as 0."""
    z = venues.select(venue, F.posexplode(F.arrays_zip(F.col(names).alias("name"), F.col(contexts).alias("context"))).alias("place", "x"))
    z = z.select(venue, "place", F.col("x.name").alias("name"), F.coalesce(F.col("x.context").try_cast("double"), F.lit(0.0)).alias("volume"))
    rank = F.row_number().over(Window.partitionBy(venue).orderBy(F.desc("volume"), "name", "place"))
    return z.withColumn("rank", rank).withColumn("kind", F.when(F.col("name").isin(majors), "major").otherwise("synthetic")).drop("place")


def scan_log(opportunities: DataFrame, event: str, edge: str, minutes: int, delay: str = "1 hour") -> DataFrame:
    """One row per opportunity and scan (its last edge), for the append sink of a stream or of a batch."""
    w = F.window("ts", f"{minutes} minutes")
    rows = opportunities.withWatermark("ts", delay) if opportunities.isStreaming else opportunities
    return rows.groupBy(event, w.alias("w")).agg(F.max_by(edge, F.struct("ts", "id")).alias(edge)).select(event, F.col("w.start").alias("scan"), edge)


def scan_evolution(log: DataFrame, event: str, edge: str) -> DataFrame:
    """How each event's edge went over its scans."""
    g = log.groupBy(event).agg(F.count("*").alias("scans"), F.min(edge).alias("least"), F.round(F.sum(edge) / F.count("*"), 6).alias("mean"), F.max(edge).alias("most"), F.min("scan").alias("first"), F.max("scan").alias("last"))
    return g.withColumns({"first": F.unix_micros("first"), "last": F.unix_micros("last")})


def anchor_window(markets: DataFrame, trades: DataFrame, now_us: int, days: tuple[int, int], categories: list[str], longest_days: int, prices: tuple[int, int], least_volume: int, window_days: int) -> DataFrame:
    """Markets of listed categories that end within ``days`` of now, live no longer than ``longest_days``, and whose
    trades of the last ``window_days`` before now reach ``least_volume`` at a last price inside ``prices`` (of equal times and lines
    the highest price).
    markets: market_id, category, start_ts, event_ts; trades: market_id, ts, price, cents, line."""
    day = 86_400_000_000
    left = F.unix_micros("event_ts") - now_us
    m = markets.where(left.between(days[0] * day, days[1] * day) & F.col("category").isin(categories))
    m = m.where(F.unix_micros("event_ts") - F.unix_micros("start_ts") <= longest_days * day)
    seen = trades.where(F.unix_micros("ts").between(now_us - window_days * day, now_us))
    s = seen.groupBy("market_id").agg(F.sum("cents").alias("volume"), F.max_by("price", F.struct("ts", "line", "price")).alias("last"))
    s = s.where((F.col("volume") >= least_volume) & F.col("last").between(*prices))
    return m.hint("merge").join(s.hint("merge"), "market_id").select("market_id", "category", "volume", "last")


def odds_to_prob(rows: DataFrame, condition: str, odds: str, most: float = 500.0) -> DataFrame:
    """1 / odds; a condition with any odds outside (1, ``most``] or null drops out as a whole."""
    good = rows.groupBy(condition).agg(F.min(F.coalesce((F.col(odds) > 1) & (F.col(odds) <= most), F.lit(False))).alias("ok")).where("ok")
    return rows.hint("merge").join(good.hint("merge"), condition, "left_semi").withColumn("prob", 1 / F.col(odds))


def relevant_feeds(markets: DataFrame, feeds: DataFrame, group: str) -> DataFrame:
    """markets with the feeds that cover their theme group or are global; feeds: feed, themes. The global feeds come in as one
    list."""
    own = markets.hint("merge").join(feeds.select("feed", F.explode("themes").alias("theme")).hint("merge"), F.col(group) == F.col("theme")).drop("theme")
    everywhere = feeds.where(F.array_contains("themes", "global")).agg(F.sort_array(F.collect_set("feed")).alias("__feeds"))
    every = markets.where(F.col(group).isNotNull()).withColumn("__feeds", everywhere.scalar()).withColumn("feed", F.explode("__feeds")).drop("__feeds")
    return own.unionByName(every).distinct()
