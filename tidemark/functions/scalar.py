"""Column builders: prices, odds, fees, buckets, z-scores, time, text and order books. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits: int = 6) -> Column:
    """Rounded by floor(x * 10**d + 0.5): the same bits in any engine with IEEE doubles, ties included."""
    return F.floor(col(x) * 10.0**digits + 0.5) / 10.0**digits


def pearson(x, y) -> Column:
    """Correlation of the rows where both are known; null where either is constant (corr would fail there)."""
    a, b = F.when(col(y).isNotNull(), col(x).cast("double")), F.when(col(x).isNotNull(), col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def bucket_label(price) -> Column:
    """``lo-hi`` in steps of 0.05; what lies outside [0, 1) goes to the last bucket."""
    k = F.expr("1") * F.floor(F.round(col(price) * 1000) / 50)
    k = F.when((col(price) >= 0) & (col(price) < 1), F.least(k, F.lit(19))).otherwise(19).cast("int")
    return F.concat(_two(k * 5), F.lit("-"), _two(k * 5 + 5))


def _two(hundredths: Column) -> Column:
    return F.concat((hundredths / 100).cast("int").cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("int").cast("string"), 2, "0"))


def bucket_index(price) -> Column:
    """min(int(20 p), 19), null outside [0, 1]."""
    return F.when(col(price).between(0, 1), F.least(F.floor(F.round(col(price) * 1000) / 50), F.lit(19)).cast("int"))


def bucket_custom(x, edges: list[float], labels: list[str], closed: str = "left") -> Column:
    """Labels of uneven bins; ``closed`` tells which edge belongs to a bin. len(labels) = len(edges) + 1."""
    out = None
    for e, name in zip(edges, labels):
        hit = col(x) < e if closed == "left" else col(x) <= e
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(col(x).isNull(), None).otherwise(out.otherwise(labels[-1]))


def z_null(rate, mid, n) -> Column:
    """(rate - mid) / sqrt(mid (1 - mid) / n); 0 where that is undefined."""
    v = col(mid) * (1 - col(mid)) / col(n)
    return F.when(v > 0, (col(rate) - col(mid)) / F.sqrt(v)).otherwise(0.0)


def z_wald(rate, mid, n) -> Column:
    """The standard error is the observed rate's; where all agree, the reference rate's."""
    base = F.when((col(rate) > 0) & (col(rate) < 1), col(rate)).otherwise(col(mid))
    return F.when(base * (1 - base) > 0, (col(rate) - col(mid)) / F.sqrt(base * (1 - base) / col(n))).otherwise(0.0)


def fee_quadratic(bps: float, p) -> Column:
    return F.lit(bps) / 10_000 * col(p) * (1 - col(p))


def fee_min(bps: float, p) -> Column:
    return F.lit(bps) / 10_000 * F.least(col(p), 1 - col(p))


def realized_fee_bps(fee, shares, p) -> Column:
    return F.try_divide(col(fee), col(shares) * F.least(col(p), 1 - col(p))) * 10_000


def mid_and_spread(bid, ask, last) -> tuple[Column, Column]:
    ok = (col(bid) > 0) & (col(bid) < col(ask)) & (col(ask) < 1)
    return F.when(ok, (col(bid) + col(ask)) / 2).otherwise(col(last)), F.when(ok, col(ask) - col(bid))


def normalize_epoch(v) -> Column:
    """Seconds, from seconds or milliseconds."""
    return F.when(col(v) > 1e12, col(v) / 1000).otherwise(col(v))


def best_event_ts(pub, seen) -> Column:
    return F.least(F.coalesce(col(pub), col(seen)), col(seen))


def decode_uint(b, scale: float = 1e6) -> Column:
    """A big-endian byte string as a number over ``scale``, by 64-bit limbs; null or empty is 0."""
    h = F.lpad(F.hex(col(b)), 64, "0")
    limbs = [F.conv(F.substring(h, 1 + 16 * i, 16), 16, 10).cast("double") for i in range(4)]
    total = sum((x * 2.0 ** (64 * (3 - i)) for i, x in enumerate(limbs)), F.lit(0.0))
    return F.when(col(b).isNull() | (F.octet_length(col(b)) == 0), F.lit(0.0)).otherwise(total / scale)


def bytes_to_hex(b) -> Column:
    return F.lower(F.hex(col(b)))


def parse_outcome_prices(raw) -> Column:
    """struct(yes, no) of a stringified list of two numbers; null for anything else."""
    a = F.from_json(col(raw), "array<string>")
    y, n = F.try_element_at(a, F.lit(1)).try_cast("double"), F.try_element_at(a, F.lit(2)).try_cast("double")
    return F.when((F.size(a) == 2) & y.isNotNull() & n.isNotNull(), F.struct(y.alias("yes"), n.alias("no")))


def derive_resolution(closed, yes, no) -> Column:
    shut = col(closed) == 1
    return F.when(shut & (col(yes) == 1) & (col(no) == 0), "YES").when(shut & (col(yes) == 0) & (col(no) == 1), "NO").otherwise("unresolved")


def parse_timestamp_multi(s) -> Column:
    return F.coalesce(F.try_to_timestamp(col(s)), F.try_to_timestamp(col(s), F.lit("yyyy-MM-dd HH:mm:ssX")), F.try_to_timestamp(col(s), F.lit("MMM d, yyyy HH:mm")))


def parse_slug_duration(slug) -> Column:
    """Seconds of ``-updown-<n><m|h|d>-``."""
    n, u = (F.regexp_extract(col(slug), r"-updown-(\d+)([mhd])-", i) for i in (1, 2))
    return n.try_cast("int") * F.when(u == "m", 60).when(u == "h", 3600).when(u == "d", 86400)


def parse_barrier(slug) -> Column:
    """struct(kind, strike): the first of reach, dip, hit; 100k is 100,000 and 1pt6 is 1.6."""
    kind = F.regexp_extract(col(slug), r"-(reach|dip-to|dip|hit)-", 1)
    raw = F.regexp_extract(col(slug), r"-(?:reach|dip-to|dip|hit)-\$?([0-9]+(?:pt[0-9]+)?k?)(?:-|$)", 1)
    number = F.regexp_replace(F.regexp_replace(raw, "k$", ""), "pt", ".").try_cast("double")
    return F.when((kind != "") & number.isNotNull(), F.struct(F.regexp_replace(kind, "-to", "").alias("kind"), (number * F.when(raw.endswith("k"), 1000).otherwise(1)).alias("strike")))


def parse_above_strike(slug) -> Column:
    at = lambda i: F.regexp_extract(col(slug), r"^([a-z]+)-above-([0-9]+(?:pt[0-9]+)?)-on-", i)
    return F.when(at(1) != "", F.struct(at(1).alias("asset"), F.regexp_replace(at(2), "pt", ".").try_cast("double").alias("strike")))


def parse_dated_ticker(t) -> Column:
    """``XXGAME-26APR25AAABBB-BBB``: date, winner and loser."""
    at = lambda i: F.regexp_extract(col(t), r"-(\d{2}[A-Z]{3}\d{2})([A-Z]{3})([A-Z]{3})-([A-Z]{3})$", i)
    day = F.to_date(F.try_to_timestamp(F.initcap(F.lower(at(1))), F.lit("yyMMMdd")))
    return F.when(at(1) != "", F.struct(day.alias("day"), at(4).alias("winner"), F.when(at(4) == at(2), at(3)).otherwise(at(2)).alias("loser")))


def parse_matchup(title) -> Column:
    """[A, B] of "A vs B", [A] of "will A win on D?"."""
    both = F.split(F.trim(F.regexp_replace(col(title), r"\s*[:(].*$", "")), r"\s+vs\.?\s+")
    one = F.regexp_extract(col(title), r"(?i)^will (.+?) win\b", 1)
    return F.when(F.size(both) == 2, both).when(one != "", F.array(one))


def tokenize(title, stopwords: list[str], least: int = 3) -> Column:
    """Distinct lower-case words without parentheses' content, stopwords and words under ``least`` letters, sorted."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(col(title)), r"\([^)]*\)", " "), r"[^a-z0-9]+", " "), " ")
    kept = F.filter(F.array_distinct(words), lambda w: F.length(w) >= least)
    return F.sort_array(F.array_except(kept, F.array(*[F.lit(w) for w in stopwords]).cast("array<string>")))


def auto_name(name) -> Column:
    return col(name).isNull() | (col(name) == "") | (col(name).startswith("0x") & (F.length(col(name)) >= 40))


def normal_cdf(x: Column) -> Column:
    """N(x) with the error function's rational approximation of absolute error under 1.5e-7, as Spark has no erf."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def digital_fair_value(spot, strike, years, sigma: float = 0.5) -> Column:
    """N(d2) without drift; a step where no time is left."""
    d2 = (F.log(col(spot) / col(strike)) - sigma * sigma / 2 * col(years)) / (sigma * F.sqrt(col(years)))
    return F.when(col(years) <= 0, F.when(col(spot) > col(strike), 1.0).otherwise(0.0)).otherwise(normal_cdf(d2))


def best_bid(bids) -> Column:
    return F.array_max(F.transform(F.filter(col(bids), lambda x: x["size"] > 0), lambda x: x["price"]))


def best_ask(asks) -> Column:
    return F.array_min(F.transform(F.filter(col(asks), lambda x: x["size"] > 0), lambda x: x["price"]))


def depth(levels, keep, notional: bool = True) -> Column:
    """Sum of price times size (or of size) over the levels that ``keep`` accepts."""
    value = (lambda x: x["price"] * x["size"]) if notional else (lambda x: x["size"])
    return F.aggregate(F.filter(col(levels), keep), F.lit(0.0), lambda a, x: a + value(x))


def capture_below(asks, cap: float) -> tuple[Column, Column]:
    """Cost and profit of taking every ask under ``cap``."""
    under = F.filter(col(asks), lambda x: x["price"] < cap)
    return F.aggregate(under, F.lit(0.0), lambda a, x: a + x["price"] * x["size"]), F.aggregate(under, F.lit(0.0), lambda a, x: a + (1 - x["price"]) * x["size"])


def rules(text: Column, table: list[tuple[str, str]], default: str = "other", regex: bool = True) -> Column:
    """The label of the first pattern that matches; order is part of the table."""
    hit = (lambda p: text.rlike(p)) if regex else (lambda p: text.contains(p))
    out = None
    for pattern, label in table:
        out = F.when(hit(pattern), label) if out is None else out.when(hit(pattern), label)
    return out.otherwise(default)


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first condition that holds, else null."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in reasons.items()])


def first_known(*values) -> Column:
    """An event's time: its own start, else the end of its market (which carries a settlement delay)."""
    return F.coalesce(*[col(v) for v in values])


def parse_underlying(title, tickers: list[tuple[str, str]]) -> Column:
    """The ticker of the first keyword that the title holds, in the table's order; null if none."""
    return F.coalesce(*[F.when(F.lower(col(title)).contains(word), F.lit(ticker)) for word, ticker in tickers])


#: A slug's cadence by the first pattern that it holds.
CADENCES = [
    (r"-\d{4}-\d{2}-\d{2}", "daily"),
    (r"week-of-|\d{1,2}-(mon|tue|wed|thu|fri|sat|sun)-", "weekly"),
    (r"-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-", "monthly"),
]


def cadence_from_slug(slug) -> Column:
    return rules(F.lower(F.coalesce(col(slug), F.lit(""))), CADENCES, "one-off")


def theme_group(theme) -> Column:
    """The coarse group of a market's theme; everything else is global."""
    t = F.lower(col(theme))
    # fixed values: the themes' prefixes and words, and their groups
    return (
        F.when(t.startswith("iran-") | t.startswith("israel-"), "middle-east")
        .when(t.contains("ukraine"), "ukraine")
        .when(t.startswith("china-") | t.startswith("taiwan"), "asia")
        .when(t.startswith("uk-") | t.startswith("europe"), "uk")
        .otherwise("global")
    )


Rule = tuple[str, str] | tuple[str, str, str]


def blocks(table: list[Rule]) -> list[Rule]:
    """The table with neighbouring rules of one label and no exclusion put into one pattern: the same labels in fewer scans."""
    out: list[Rule] = []
    for rule in table:
        if out and len(rule) == 2 == len(out[-1]) and rule[1] == out[-1][1]:
            out[-1] = (f"{out[-1][0]}|{rule[0]}", rule[1])
        else:
            out.append(rule)
    return out


def ordered_rules(text: Column, table: list[Rule], default: str) -> Column:
    """The label of the first rule (pattern, label, and optionally a pattern that excludes it) that a text meets. One alternation of all
    patterns is tried first; the rules, in blocks, are tried only where it hits, and none after the first that does."""
    out = None
    for pattern, label, *excluded in blocks(table):
        hit = text.rlike(pattern)
        for x in excluded:
            hit = hit & ~text.rlike(x)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    any_ = text.rlike("|".join(pattern for pattern, *_ in table))
    return F.when(text.isNull() | ~any_, default).otherwise(out.otherwise(default))


#: Ordered rules for a slug's kind of question: pattern, label, and what excludes it. Patterns are plain enough for any engine.
SUBCATEGORIES: list[Rule] = [
    # noise that would look like a contest
    ("^(test|draft|demo)-", "uncategorized"),
    # margins and handicaps
    ("-spread(-|$)", "spreads"),
    ("-handicap(-|$)", "spreads"),
    ("-by-[0-9]+-or-more", "spreads"),
    ("-(minus|plus)-[0-9]+pt5", "spreads"),
    ("-run-line(-|$)", "spreads"),
    ("-puck-line(-|$)", "spreads"),
    # sums of a contest's score
    ("-(over|under)-[0-9]", "totals", "-(goals|points|yards)-by-"),
    ("-total-(points|goals|runs|sets|maps|rounds)", "totals"),
    ("-o-u-[0-9]", "totals"),
    ("-both-teams-(to-)?score", "totals"),
    # a player's or a moment's statistic
    ("-(points|rebounds|assists|goals|yards|strikeouts)-by-", "props"),
    ("-first-(goal|touchdown|basket|scorer)", "props"),
    ("-(anytime|last)-(goal|touchdown)-?scorer", "props"),
    ("-coin-toss", "props"),
    ("-halftime-", "props", "-halftime-result"),
    ("-fastest-lap", "props"),
    ("-pole(-position)?(-|$)", "props"),
    ("-podium(-|$)", "props"),
    ("-safety-car", "props"),
    ("-double-double", "props"),
    ("-hat-trick", "props"),
    ("-man-of-the-match", "props"),
    ("-(first|second|third|[0-9]+th)-(overall-)?pick", "props"),
    ("-method-of-victory", "props"),
    ("-go-the-distance", "props"),
    ("^will-[a-z-]+-attend-", "props"),
    # what a season or a vote decides
    ("-champions?(hip)?(-|$)", "futures", "-vs-"),
    ("-win-the-[a-z-]*(title|cup|trophy|league|pennant)", "futures", "-vs-"),
    ("-mvp(-|$)", "futures"),
    ("-(player|coach|rookie|manager)-of-the-(year|season)", "futures"),
    ("-(golden-boot|golden-glove|ballon-d-or|heisman)", "futures"),
    ("-(relegat|promot)(ed|ion)", "futures"),
    ("-make-the-(playoffs|finals|knockouts)", "futures"),
    ("-(top|win-the)-(division|conference|group)", "futures"),
    ("-finish-(first|second|third|last|top-[0-9]+)", "futures"),
    ("-season-wins", "futures"),
    ("-(be|get)-traded(-|$)", "futures"),
    ("-(next|new)-(coach|manager|captain)", "futures"),
    ("-win-(wimbledon|the-[a-z]+-open)", "futures", "-vs-"),
    ("-(oscars?|grammys?|emmys?|academy-awards?)(-|$)", "futures"),
    # one contest
    ("-grand-prix(-winner)?(-[0-9]{4})?$", "game_outcome"),
    ("-halftime-result", "game_outcome"),
    ("^(ufc|boxing|mma)-", "game_outcome"),
    ("-beat-", "game_outcome"),
    ("^[a-z0-9-]+-vs-[a-z0-9-]+$", "game_outcome"),
    ("-at-[a-z]+-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "game_outcome"),
    ("-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "game_outcome"),
]


def subcategory(slug) -> Column:
    return ordered_rules(F.lower(col(slug)), SUBCATEGORIES, "uncategorized")


def is_game_outcome(slug) -> Column:
    """A head-to-head or dated slug that no rule before ``game_outcome`` claims."""
    return subcategory(slug) == "game_outcome"


def keywords(text: Column, table: list[tuple[str, list[str], list[str]]], default: str = "other") -> Column:
    """The label of the first entry (label, words, required words) of which the text holds a word and, if any are given, a required
    one as well."""
    some = lambda words: F.coalesce(*[F.when(text.contains(w), F.lit(True)) for w in words], F.lit(False))
    out = None
    for label, words, required in table:
        hit = some(words) & some(required) if required else some(words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)
