"""Order statistics, slices, runs, fills and gaps of hot groups against plain Python, with all groups hot, some, and none."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A, calibration as C, joins as J, ordered as O, selection
from tidemark.operators.selection import select_ranks

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def small_groups_are_hot(monkeypatch):
    monkeypatch.setattr(selection, "HOT_ROWS", 0)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    draw = {"a": lambda: rng.randrange(-50, 50), "b": lambda: int(rng.lognormvariate(0, 6)), "c": lambda: rng.choice([0, 10**15]), None: lambda: rng.randrange(10**6), "one": lambda: 7}
    n = {"a": 900, "b": 700, "c": 300, None: 250, "one": 1}
    out = [(k, draw[k]()) for k in n for _ in range(n[k])]
    rng.shuffle(out)
    return [(k, v, i, T0 + dt.timedelta(microseconds=abs(v) % 10**7)) for i, (k, v) in enumerate(out)] + [("a", None, 10**6, T0), ("none", None, 10**6 + 1, T0)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, v long, id long, ts timestamp").repartition(4).cache()


def groups(rows):
    out = {}
    for k, v, i, ts in rows:
        if v is not None:
            out.setdefault(k, []).append((v, i, ts))
    return out


@pytest.mark.parametrize("parts", [10**9, 4, 1])
def test_select_ranks(rows, df, parts):
    wanted = {"first": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "beyond": lambda n: n}
    got = {r.k: r for r in select_ranks(df, ["k"], ["ts", "id"], wanted, parts).collect()}
    by_ts = {}
    for k, _, i, ts in rows:
        by_ts.setdefault(k, []).append((ts, i))
    assert got.keys() == by_ts.keys()
    for k, x in by_ts.items():
        x.sort()
        assert (got[k].n, tuple(got[k].first), tuple(got[k].mid), tuple(got[k].last), got[k].beyond) == (len(x), x[0], x[len(x) // 2], x[-1], None)


@pytest.mark.parametrize("parts", [10**9, 4, 1])
def test_quantiles(rows, df, parts):
    want = groups(rows)
    d = {r.k: r for r in A.distribution_stats(df, "k", "v", parts=parts).collect()}
    p = {r.k: (r.value, r.n) for r in A.percentile_index(df, "k", "v", 0.9, parts=parts).collect()}
    q = {r.k: r.q for r in A.quantile_exclusive(df, "k", "v", hot_parts=parts).collect()}
    assert d.keys() == p.keys() == q.keys() == want.keys()
    for k, x in want.items():
        v = sorted(a for a, _, _ in x)
        assert np.allclose([d[k].p25, d[k].p50, d[k].p75, d[k].p90, d[k].p99], np.quantile(np.array(v, float), [0.25, 0.5, 0.75, 0.9, 0.99]), rtol=1e-9)
        assert p[k] == (v[math.floor(0.9 * (len(v) - 1))], len(v)) and (d[k].n, d[k].least, d[k].most) == (len(v), v[0], v[-1])
        pos = (len(v) + 1) * 0.9
        j = min(max(math.floor(pos), 1), len(v) - 1)
        assert math.isclose(q[k], v[-1] if len(v) < 10 else v[j - 1] + (v[j] - v[j - 1]) * (pos - j), rel_tol=1e-9, abs_tol=1e-4)


@pytest.mark.parametrize("parts", [10**9, 4, 1])
def test_slices(rows, df, parts):
    t = {r.id: r.regime for r in O.terciles(df, "k", "v", "id", parts).collect()}
    s = {r.id: r.slice for r in C.equal_count_slices(df, ["v", "id"], 3, ["k"], parts).collect()}
    for x in groups(rows).values():
        x = sorted((v, i) for v, i, _ in x)
        n = len(x)
        for rank, (_, i) in enumerate(x):
            assert t[i] == ("low" if rank < n // 3 else "mid" if rank < 2 * n // 3 else "high")
            assert s[i] == sum(rank >= round(n * c / 3) for c in (1, 2))
    assert len(t) == len(s) == sum(len(x) for x in groups(rows).values())


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_threshold_runs(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, o, rng.choice([0, 1, 1, 5, 9, None]) if k else 1) for k in (0, 1, 2) for o in sorted(rng.sample(range(300), 120))]
    want = []
    for k in (0, 1, 2):
        run = []
        for _, o, v in [r for r in rows if r[0] == k] + [(k, None, None)]:
            if v is not None and v < 5:
                run.append((o, v))
            elif run:
                vs = [x for _, x in run]
                want.append((k, run[0][0], run[-1][0], len(run), min(vs), max(vs), vs[0], vs[-1]))
                run = []
    got = O.threshold_runs(spark.createDataFrame(rows, "k int, o long, v int").repartition(3), "k", "o", "v", 5, chunk=chunk)
    assert sorted(tuple(r) for r in got.select("k", "start", "end", "n_rows", "least", "most", "first_value", "last_value").collect()) == sorted(want)


@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_grid_and_gaps(spark, chunk):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randrange(20_000)), rng.choice([None, 1, 2, 3]), i) for i in range(150)] + [("c", T0, None, 999)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v int, id long")
    epoch = dt.datetime(1970, 1, 1)
    want, gaps = set(), {}
    for k in "abc":
        mine = sorted((r[1], r[3], r[2]) for r in rows if r[0] == k)
        last = {(ts - epoch) // dt.timedelta(seconds=60): v for ts, _, v in mine}
        now = None
        for b in range(min(last), max(last) + 1):
            now = last[b] if last.get(b) is not None else now
            want.add((k, b, now))
        gaps[k] = (len(mine), max([(b[0] - a[0]).total_seconds() / 60 for a, b in zip(mine, mine[1:])], default=0.0))
    assert {tuple(r) for r in O.grid_last_ffill(df, "k", "v", 60, "id", chunk).select("k", "bin", "v").collect()} == want
    got = {r.k: (r.items, r.silent_min) for r in A.feed_silence(df, "k", 10**9, chunk * 10_000_000).collect()}
    assert all(got[k][0] == gaps[k][0] and abs(got[k][1] - gaps[k][1]) < 1e-3 for k in "abc")


@pytest.mark.parametrize("bucket_s", [1, 60, 10**6])
def test_next_in_range(spark, bucket_s):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=rng.randrange(5000))) for i in range(200)]
    right = [(rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=rng.randrange(5000))) for _ in range(60)]
    got = {r.id: r.first_us for r in J._next_at(spark.createDataFrame(left, "id long, k string, ts timestamp"), spark.createDataFrame(right, "k string, ts timestamp"), "k", "ts", 100_000_000, bucket_s * 1_000_000).collect()}
    for i, k, ts in left:
        later = [t for key, t in right if k is not None and key == k and t >= ts - dt.timedelta(seconds=100)]
        assert got[i] == (round((min(later) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) if later else None)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_lags_and_changes(spark, chunk):
    rng = random.Random(chunk)
    grid = [(k, b, rng.randrange(1, 9)) for k in "ab" for b in range(-10, 40)]
    df = spark.createDataFrame(grid, "k string, bin long, v long").repartition(3)
    value = {(k, b): v for k, b, v in grid}
    for lag in (1, 5):
        got = {(r.k, r.bin): r.before for r in O.lagged(df, "k", "bin", "v", lag, "before", chunk).collect()}
        assert got == {(k, b): value.get((k, b - lag)) for k, b, _ in grid}
    ticks = [(rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randrange(500)), rng.choice([1, 1, 2, None]), i) for i in range(200)]
    want = {}
    for k in "ab":
        mine = [v for _, _, v in sorted((ts, i, v) for key, ts, v, i in ticks if key == k)]
        want[k] = (len(mine), sum(a is not None and b is not None and a != b for a, b in zip(mine, mine[1:])))
    got = O.change_count(spark.createDataFrame(ticks, "k string, ts timestamp, v int, id long"), "k", "v", ["ts", "id"], chunk * 5_000_000)
    assert {r.k: (r.n, r.changes) for r in got.collect()} == want


@pytest.mark.parametrize("values", [[5] * 40 + [1] * 60, list(range(1, 150)), [0, 0, 3], [7]])
def test_concentration_with_ties(spark, values):
    df = spark.createDataFrame([(f"w{i}", v) for i, v in enumerate(values)], "w string, v long")
    r = A.concentration(df, "w", "v").first()
    x = sorted(values)
    n, total = len(x), sum(x)
    assert (r.participants, r.total) == (n, total)
    for k in (1, 10, 50, 100):
        assert abs(r[f"top{k}"] - sum(x[-k:]) / total) < 1e-6
    assert abs(r.gini - (2 * sum((i + 1) * v for i, v in enumerate(x)) / (n * total) - (n + 1) / n)) < 1e-6
