"""Book arrays, keyword lookup, carried values and global ranks against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A, books as B, joins as J
from tidemark.sources import files

T0 = dt.datetime(1997, 1, 1)


def test_books(spark):
    kind = "id int, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"
    df = spark.createDataFrame([(1, [(0.40, 10.0), (0.397, 5.0), (0.03, 9.0)], [(0.41, 4.0), (0.97, 7.0)]), (2, [(0.04, 1.0)], []), (3, None, [(0.5, 0.0)])], kind)
    r = {x.id: x for x in B.best_and_depth(df).collect()}
    assert (r[1].bid, r[1].ask, r[1].bid_top, r[1].ask_top, r[1].bid_levels) == (0.40, 0.41, 15.0, 4.0, 3) and r[2].ask is None and r[3].ask is None
    assert abs(r[1].bid_notional - (4 + 1.985 + 0.27)) < 1e-9 and r[1].near_25 == 0.0
    q = {x.id: x for x in B.rational_quote(df).collect()}
    assert (q[1].bid, q[1].ask, q[2].bid, q[2].ask) == (0.40, 0.41, None, None) and abs(q[1].ask_notional - 1.64) < 1e-9
    quotes = spark.createDataFrame([(1, 0.41), (2, 0.4), (4, 0.2)], "id int, quoted double")
    assert {x.id: x.verdict for x in B.book_vs_quote(quotes, df, "id").collect()} == {1: "agrees", 2: "phantom", 4: "phantom"}


def test_rules(spark):
    df = spark.createDataFrame([("a-spread-vs-b",), ("a-vs-b",), ("x-2026-04-25",), ("moon",), (None,)], "s string")
    assert [r[0] for r in df.select(S.subcategory("s")).collect()] == ["spreads", "game_outcome", "game_outcome", "uncategorized", "uncategorized"]
    assert [r[0] for r in df.select(S.cadence_from_slug("s")).collect()] == ["one-off", "one-off", "daily", "one-off", "one-off"]
    assert {r[0] for r in df.select(S.theme_group("s")).collect()} == {"global"}


def test_keyword_match_brute(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["the"] * 30
    news = [(i, rng.choices(words, k=rng.randint(0, 25))) for i in range(60)] + [(99, None)]
    markets = [(i, rng.choices(words, k=rng.randint(0, 9)) + (["w1 w2"] if i % 3 == 0 else [])) for i in range(50)] + [(99, None)]
    n = spark.createDataFrame([(i, t, " ".join(t) if t else None) for i, t in news], "news_id int, tokens array<string>, title string")
    m = spark.createDataFrame(markets, "market_id int, keywords array<string>")
    for least, share in ((1, 0.0), (2, 0.0), (2, 0.6)):
        want = set()
        for i, t in news:
            for j, k in markets:
                own = set(k or ())
                hits = sum((" " in w and w in " ".join(t)) or w in t for w in own) if t else 0
                if own and hits >= max(least, -(-len(own) * round(share * 10) // 10)):
                    want.add((i, j, hits))
        assert {tuple(r) for r in J.keyword_match(n, m, least, share).collect()} == want


def test_asof_across_buckets_and_first_in_range(spark):
    rng = random.Random(5)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    series = [(rng.choice("ab"), rng.randint(0, 500), i) for i in range(120)] + [("c", None, 7)]
    probes = [(rng.choice("abc"), rng.randint(-20, 600), i) for i in range(150)] + [(None, 5, 900), ("a", None, 901)]
    s = spark.createDataFrame([(k, at(t) if t is not None else None, i, i) for k, t, i in series], "k string, ts timestamp, v int, id int")
    p = spark.createDataFrame([(k, at(t) if t is not None else None, i) for k, t, i in probes], "k string, ts timestamp, p int")
    got = {r.p: r.v for r in J.asof_backward(p, s, "k", "ts", "v", tie="id", bucket_us=60_000_000).collect()}
    for k, t, i in probes[:150]:
        best = max(((u, v) for c, u, v in series if u is not None and c == k and u <= t), default=(0, None))
        assert got[i] == best[1]
    got = {r.p: r.first_us for r in J.first_in_range(p, s, "k", "ts", 10_000_000, 5_000_000).collect()}
    clear = {r.p for r in J.range_exclusion(p, s, "k", "ts", 10_000_000, 5_000_000).collect()}
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    for k, t, i in probes:
        u = min((u for c, u, _ in series if None not in (u, t) and c == k and t - 10 <= u <= t + 5), default=None)
        assert got[i] == (None if u is None else (base + u) * 1_000_000) and (i in clear) == (u is None)


def test_ranks_over_ranges(spark):
    rng = random.Random(1)
    rows = [(i, int(rng.paretovariate(0.7) * 10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "w int, x int")
    got = {r.w: r.i for r in A.ranked(df, "x", "w", 16).collect()}
    assert [w for w, _ in sorted(got.items(), key=lambda z: z[1])] == [w for w, x in sorted(rows, key=lambda z: (z[1], z[0]))]


def test_relational_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "x": 2.5}\n{bad\n{"id": 3}\n')
    from pyspark.sql import types as T

    rows = files.scan_jsonl(spark, str(tmp_path), T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType())]), ["x"]).collect()
    assert sorted((r.id or 0, r.x, r._corrupt) for r in rows) == [(0, 0.0, "{bad"), (1, 2.5, None), (3, 0.0, None)]
    report = files.json_report(spark.createDataFrame([(3,)], "n int"), spark.createDataFrame([("b", 1), ("a", 2)], "k string, c int"), "k").first().report
    assert report == '{"n":3,"cells":[{"k":"a","c":2},{"k":"b","c":1}]}'


@pytest.mark.parametrize("turn", [1, -1])
def test_anchor_window_breaks_ties_by_price(spark, turn):
    markets = spark.createDataFrame([(1, "x", T0, T0)], "market_id long, category string, start_ts timestamp, event_ts timestamp")
    trades = [(1, T0, p, 100, 3) for p in (500, 950, 300)][::turn] + [(1, T0, 999, 100, 2)]
    df = spark.createDataFrame(trades, "market_id long, ts timestamp, price long, cents long, line int").coalesce(1)
    now = df.select(F.unix_micros(F.lit(T0).cast("timestamp"))).first()[0]
    got = B.anchor_window(markets, df, now, (0, 1), ["x"], 5, (0, 999), 1, 5).collect()
    assert [(r.volume, r.last) for r in got] == [(400, 950)]


def test_anchor_window_and_books_equal_their_sql_on_edges(spark, tmp_path):
    """Lines of one order, number and day at other prices, and best prices 23/17 apart, where the near band ends on a level."""
    import __spark_entry__ as entry
    import duckdb

    day = dt.datetime(1997, 2, 1)
    line = lambda k, n, flag, cents, at=day, size=10.0: (k, 7, n, n, size, cents / 100, 0.0, 0.0, flag, "O", at)
    lines = [line(1, 1, "N", c) for c in (1000500, 1000120, 1000777)] + [line(2, 2, "N", c) for c in (1000777, 1000500, 1000120)]
    pairs = [(170, 161), (340, 322), (680, 644), (690, 357), (3, 500)]
    lines += [line(10 + i, 1 + (f == "N"), f, 1000000 + x) for i, (b, a) in enumerate(pairs) for f, x in (("R", b), ("N", a))]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, 1, "F", 100.0, dt.datetime(1997, 1, 15), "1-URGENT") for k in (1, 2, *range(10, 15))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("anchor_window_filter", "book_best_and_depth"):
        got = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall()) and names


def test_links_between_classes_are_all_pairs(spark):
    rng = random.Random(11)
    names = {i: " ".join(rng.choices("abcd", k=rng.randint(1, 4))) for i in range(60)} | {60: None, 61: None, 62: ""}
    side = lambda r: spark.createDataFrame([(i, n.split(" ") if n is not None else None) for i, n in names.items() if i % 2 == r], f"{'ka' if r == 0 else 'kb'} long, tokens array<string>")
    rows = J.token_overlap(side(0), side(1), "ka", "kb").collect()
    sets = {i: set(n.split(" ")) if n is not None else set() for i, n in names.items()}
    want = {(i, j, len(sets[i] & sets[j])) for i in names for j in names if i % 2 == 0 and j % 2 == 1 and len(sets[i] & sets[j]) >= 2}
    held = {}
    for r in rows:
        if r.kind != "pair":
            held.setdefault((r.kind, r.class_id), []).append(r.ka)
    pairs = [r for r in rows if r.kind == "pair"]
    assert {(i, j, r.shared) for r in pairs for i in held["a", r.ka] for j in held["b", r.kb]} == want
    assert sum(r.n_links for r in pairs) == len(want) and len(pairs) < len(want)
    assert sorted(i for m in held.values() for i in m) == sorted(names)
    for r in rows:
        if r.kind != "pair":
            assert r.n_links == sum(r.ka == p["ab".index(r.kind)] for p in want)


def test_ticker_links_are_all_pairs(spark):
    rng = random.Random(12)
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d)
    teams = [(i, rng.choice(["Boston", "Denver", "Miami"]), rng.randrange(4)) for i in range(30)]
    tickers = [(100 + i, rng.choice(["X-BOSDEN", "X-MIA", "BOS", "X"]), rng.randrange(4)) for i in range(40)]
    rows = J.ticker_prefix(spark.createDataFrame([(i, t, day(d)) for i, t, d in teams], "id long, team string, day date"), spark.createDataFrame([(i, t, day(d)) for i, t, d in tickers], "id long, ticker string, day date")).collect()
    held = {}
    for r in rows:
        if r.kind != "pair":
            held.setdefault((r.kind, r.class_id), []).append(r.a_id)
    want = {(i, j) for i, t, d in teams for j, k, e in tickers if t[:3].upper() in k and abs(d - e) <= 1}
    assert {(i, j) for r in rows if r.kind == "pair" for i in held["a", r.a_id] for j in held["b", r.b_id]} == want
    assert sum(r.n_links for r in rows if r.kind == "pair") == len(want) > sum(r.kind == "pair" for r in rows)


def test_token_date_brute_force(spark):
    rng = random.Random(13)
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d)
    games = lambda n, at: [(at + i, rng.choices("abc", k=rng.randint(0, 2)), rng.choices("abc", k=rng.randint(0, 2)), rng.randrange(6)) for i in range(n)]
    a, b = games(40, 0), games(40, 100)
    frame = lambda g: spark.createDataFrame([(i, h, w, day(d)) for i, h, w, d in g], "id long, home array<string>, away array<string>, day date")
    best = {}
    for i, h, w, d in a:
        for j, x, y, e in b:
            same, turned = set(h) & set(x) and set(w) & set(y), set(h) & set(y) and set(w) & set(x)
            if abs(d - e) <= 1 and (same or turned):
                best[i] = min(best.get(i, (j, bool(same))), (j, bool(same)))
    df = J.token_date(frame(a), frame(b))
    assert {r.a_id: (r.b_id, r.same) for r in df.collect()} == best
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" not in plan and "sequence" in plan  # nothing is compared pair by pair


def test_token_pairs_are_rows(spark):
    """Every pair of rows comes out with its rank, copies too, across packs and slices; rows that repeat an id are one."""
    rng = random.Random(13)
    names = [(i, " ".join(rng.choices("abcd", k=rng.randint(1, 4)))) for i in range(60)] + [(60, None), (61, None), (62, ""), (3, "a b"), (4, "c d"), (64, "a b c d")]
    side = lambda r: spark.createDataFrame([(i, n.split(" ") if n is not None else None) for i, n in names if i % 2 == r], f"{'ka' if r == 0 else 'kb'} long, tokens array<string>")
    held = {}
    for i, n in names:
        held.setdefault(i, []).extend(set(n.split(" ")) if n is not None else [])
    want = set()
    for i in (i for i in held if i % 2 == 0):
        found = sorted((-n, j) for j in held if j % 2 == 1 and (n := sum(held[i].count(t) * held[j].count(t) for t in set(held[i]))) >= 2)
        want |= {(i, j, -n, k) for k, (n, j) in enumerate(found, 1)}
    for pack in (1024, 3):
        got = J.token_pairs(side(0), side(1), "ka", "kb", pack=pack, rows_per_task=200)
        assert got.columns == ["ka", "kb", "shared", "rank"]
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
    import __spark_entry__ as entry

    got = entry.queries()["join_token_overlap"](spark, "/root/testdata/sf0.001")
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name").collect()
    sets = {r.p_partkey: set(r.p_name.split(" ")) for r in part}
    assert got.columns == ["p_partkey", "b_key", "shared", "rank"]
    assert got.count() == sum(len(sets[i] & sets[j]) >= 2 for i in sets if i % 2 == 0 for j in sets if j % 2 == 1) > len(set(map(frozenset, sets.values())))


def test_ticker_pairs_are_rows(spark):
    """Every pair of ids comes out once, copies too, across packs; short teams, and ids with rows in several classes."""
    import __spark_entry__ as entry

    rng = random.Random(14)
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d) if d is not None else None
    teams = [(i, rng.choice(["Boston", "Denver", "Miami", "LA"]), rng.randrange(4)) for i in range(30)] + [(3, "Boston", 1), (3, "Boston", 2), (30, None, 1), (31, "Miami", None)]
    tickers = [(100 + i, rng.choice(["X-BOSDEN", "X-MIA", "BOS", "X", "LA"]), rng.randrange(4)) for i in range(40)] + [(107, "X-BOSDEN", 0), (107, "X-MIA", 3), (140, None, 1), (141, "BOS", None)]
    a, b = (spark.createDataFrame([(i, t, day(d)) for i, t, d in rows], f"id long, {c} string, day date") for rows, c in ((teams, "team"), (tickers, "ticker")))
    want = {(i, j) for i, t, d in teams for j, k, e in tickers if None not in (t, d, k, e) and t[:3].upper() in k and abs(d - e) <= 1}
    for pack in (1024, 2):
        rows = [tuple(r) for r in J.ticker_pairs(a, b, pack=pack, rows_per_task=100).collect()]
        assert len(rows) == len(want) and set(rows) == want
    assert entry.queries()["join_ticker_prefix"](spark, "/root/testdata/sf0.001").columns == ["a_id", "b_id"]
