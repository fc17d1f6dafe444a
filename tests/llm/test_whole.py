"""Whole results where the operators split their data: small limits, against brute force."""

import math

import numpy as np

from tidemark.llm import embedding_dedup, quality_rules


def test_embedding_dedup_split_labels(spark):
    rng = np.random.default_rng(7)
    ball = lambda n, noise, d=64: rng.normal(size=d) / 8 + rng.normal(size=(n, d)) * noise
    originals = rng.normal(size=(150, 64))
    labels = {
        0: ball(400, 0.02),  # near copies, all pairs in range
        1: np.concatenate([originals, originals + rng.normal(size=(150, 64)) * 0.33]),  # one copy each, near 0.947
        2: ball(200, 0.003),  # so tight that pieces link as a whole
        3: np.concatenate([ball(200, 0.003), ball(150, 0.03), rng.normal(size=(50, 64))]),
    }
    rows, want = [], {}
    for label, x in labels.items():
        x = x.astype(np.float32)
        x = np.concatenate([x, x[:3]])  # equal vectors
        ids = np.arange(len(x)) * 4 + label
        rows += [(int(i), label, v.tolist()) for i, v in zip(ids, x)]
        u = embedding_dedup.unit(x)
        hit = u @ u.T >= 0.93
        np.fill_diagonal(hit, False)
        root = embedding_dedup.roots(len(x), *np.nonzero(hit))
        want |= {int(i): (int(n), int(ids[r])) for i, n, r in zip(ids, hit.sum(1), root)}
    assert sum(want[i][0] for i in range(0, 1600, 4)) > 400 * 390 and any(1 <= want[i][0] for i in range(1, 1200, 4))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, target_rows=40, max_rows=60).collect()}
    assert got == want


def test_quality_rules_adapt_to_groups(spark):
    gamma = math.log(1.01 / 0.99)
    rng = np.random.default_rng(3)
    rows = []

    def add(source, symbols, lines=0, length=5):
        words = ["".join(rng.choice(list("abcdefgh"), length)) for _ in range(100)]
        rows.append((len(rows), " ".join(words[: 100 - symbols] + ["#"] * symbols) + "\nx y" * lines, "en", source))

    for _ in range(60):
        add("clean", 0, length=int(rng.integers(4, 7)))
        add("code", int(rng.integers(5, 25)), lines=int(rng.integers(0, 4)))
    odd = [("clean", 30, 0, 5), ("clean", 0, 9, 5), ("clean", 0, 0, 12), ("code", 24, 1, 5), ("small", 30, 0, 5), ("small", 0, 0, 5)]
    first = len(rows)
    for x in odd:
        add(*x)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    stats = {i: quality_rules.text_stats(t) for i, t, _, _ in rows}
    ratio = lambda i, k: {"word_length": (1, 0), "symbol_share": (2, 0), "dup_line_share": (4, 3), "repeat_share": (5, 0)}[k]
    value = lambda i, k: stats[i][ratio(i, k)[0]] / stats[i][ratio(i, k)[1]]
    want, fences = {}, {}
    for i, _, _, source in rows:
        members = [r[0] for r in rows if source == "small" or r[3] == source]  # a small group takes its language's sketch
        kept = stats[i][0] >= 20 and 100 * stats[i][5] <= 30 * stats[i][0]
        for k, tail in {"word_length": 0.9, "symbol_share": 0.9, "dup_line_share": 0.95, "repeat_share": 0.95}.items():
            b = sorted(math.ceil(math.log1p(value(m, k)) / gamma) for m in members)
            read = lambda p: (lambda z: math.expm1((z - 0.5) * gamma) if z > 0 else 0.0)(b[math.ceil(len(b) * p) - 1])
            lo, mid, hi = read(1 - tail), read(0.5), read(tail)
            low, high = math.expm1(math.log1p(lo) - gamma) - 4 * (mid - lo), math.expm1(math.log1p(hi) + gamma) + 4 * (hi - mid)
            fences[source, k] = (low, high)
            kept &= value(i, k) <= high and (k != "word_length" or value(i, k) >= low)
        want[i] = kept
    got = {(r.source, r.feature): (r.low, r.high) for r in quality_rules.thresholds(quality_rules.document_stats(df)).collect()}
    assert got.keys() == fences.keys() and all(np.allclose(got[k], fences[k]) for k in got)
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(df).collect()} == want
    assert [want[first + k] for k in range(4)] == [False, False, False, True]
