"""The operators against brute force, exact round trips and held-out accuracy, with nulls, empties, ties, repeats,
clashing extra columns and empty tables."""

import base64
import collections
import hashlib
import itertools
import math
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, jaccard_join, packing, pii, quality_classifier, quality_rules, segmentations, suffix_dedup, toxicity, warc
from tidemark.llm.common import components, key_bits, maybe_in
from tidemark.llm.registry import tokenizer_file

DATA = Path("/root/testdata/sf0.01")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n ", "one", "A b c d e f", "a B c d e f", "naïve café 1 (2) “x”", "x " * 3000, "tie tie tie", "tie tie tie"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", f"s{i % 2}", len(t or ""), i) for i, t in enumerate(TEXTS)] + [(4, "A b c d e f", "en", "s0", 11, 99), (None, "no id here at all", "en", "s0", 17, 98)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long").cache()


def runs_of(rows, length):
    count = collections.Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i : i + length] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~cover])
        out.append((len(t), int(cover.sum()), int((np.diff(np.append(0, cover.astype(int))) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def test_suffix_dedup(spark, docs):
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abc"), rng.integers(0, 90))) for _ in range(40)]
    texts = ["".join(base[i] for i in rng.integers(0, 40, rng.integers(0, 20))) for _ in range(30)] + ["a" * 900, "ab" * 300, "", None, "é" * 150, "é" * 150]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for length in (200, 64):
        got = sorted(tuple(r) for r in suffix_dedup.removal_digest(df, length).collect())
        assert got == sorted((i // 2, *x) for i, x in enumerate(runs_of([(t or "").encode() for t in texts], length)))
    clean = suffix_dedup.remove_repeats(docs, 200)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert suffix_dedup.removal_digest(docs.limit(0)).count() == 0
    cols = [np.random.default_rng(0).integers(0, 9, 20_000) for _ in range(3)]
    assert (suffix_dedup.multikey_order(cols).argsort(kind="stable").shape == (20_000,)) and all((np.diff(cols[0][suffix_dedup.multikey_order(cols)]) >= 0).tolist())


def near_brute(rows):
    sets = []
    for _, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, z) in itertools.combinations(zip([i for i, _ in rows], sets), 2):
        if s and z and 100 * len(s & z) >= 75 * len(s | z):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {(i, len(s), find(i)) for (i, _), s in zip(rows, sets)}


def test_jaccard_join_small_blocks(spark, monkeypatch):
    """Blocks and their askers cut small, on a chain whose ends aren't linked directly, and on many exact copies."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "ASKERS", 3)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows = []
    for k in range(70):
        words[int(rng.integers(len(words)))] = f"x{k}"
        words[int(rng.integers(len(words)))] = f"y{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, rows[30][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in jaccard_join.near_duplicates(df).collect()} == near_brute(rows)


def test_jaccard_join(spark, docs):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(15):
        base = list(rng.choice(vocabulary, rng.integers(3, 60)))
        for _ in range(rng.integers(1, 10)):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(w)))
    passage = " ".join(rng.choice(vocabulary, 40))
    rows += [(len(rows) + k + 1, passage + " " + " ".join(rng.choice(vocabulary, rng.integers(2, 50)))) for k in range(60)]
    rows += [(900, ""), (901, None), (902, "  \n"), (903, "A b"), (904, "a B"), (905, "É b"), (906, "é b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit(1)).repartition(4)
    assert {tuple(r) for r in jaccard_join.near_duplicates(df, sample_share=0.2, sample_least=0).collect()} == near_brute(rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and 9 not in ids and {0, 1, 2, 3, 4, 8} <= set(ids) and ids.count(4) == 1 and ids.count(None) == 1


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for size, windows in ((4096, 32), (16, 2)):
        got = packing.pack(docs.repartition(3), path, size=size, open_windows=windows, least_cut=2, fan_in=2).toPandas()
        assert got.groupby("sequence_id").length.sum().max() <= size
        for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert (g.length.cumsum() - g.length == g.offset).all()
        assert got.groupby("row").doc_tokens.first().sum() == got.length.sum()
        first = got[got.doc_id == 6].sort_values("start")
        ids = np.array([*tokenizer.encode(TEXTS[6], add_special_tokens=False).ids, 2], "<u4")
        for p in first.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    words = packing.WordTokens(path)
    for x in ["a <|endoftext|> b", "Σίσυφος ΣΑΣ", "İstanbul é É. ́ a\x1cb c d ŒUVRE, ſ K Å", "it's we'LL 123 !!?? \x00 😀 . , .. a., ,", "\n\t ª º µ. don. ß ẞ"]:
        assert list(words.encode(x)) == tokenizer.encode(x, add_special_tokens=False).ids


def test_packing_common_words_kept():
    """Common words are encoded once, whatever their case and the marks behind, also after the word cache was cut; ids are the tokenizer's."""
    path = tokenizer_file("word_bpe_49k.json")
    words, learned = packing.WordTokens(path, most=400), collections.Counter()
    learn = words._learn
    words._learn = lambda new: (learned.update(w.lower().strip(".,!?;(") for w in new), learn(new))[1]
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdeghiklmnoprstu\u00e9\u00fc"))
    name = lambda: "".join(rng.choice(letters, 9))
    common = [name() for _ in range(50)]
    forms = (str, str.upper, str.title, "{},".format, "{}.".format, "{}!?".format, "{};(".format)
    for _ in range(40):
        texts = [" ".join(forms[rng.integers(len(forms))](w) for w in rng.permutation([*common, *(name() for _ in range(60))])) for _ in range(2)]
        for text, ids in zip(texts, words.encode_many(texts)):
            assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert max(learned[w] for w in common) == 1
    odd = [None, "", " \n", "a!'s b", "x...y \u00d7 \u00f7 \u0149a. e\u0301, \u0130, don't! (it's)", "<|endoftext|>,", "\u00e9!<|endoftext|>"]
    assert [x.tolist() for x in words.encode_many(odd)] == [words.tokenizer.encode(x or "", add_special_tokens=False).ids for x in odd]
    assert [x.tolist() for x in words.encode_many([None])] == [[]] and words.encode_many([]) == []


def test_pii(spark, docs):
    texts = ["mail Ann.4@mail8.example.com, ann.4@mail8.example.com", "call +1 (988) 555-2485 or 988-555-2485", "card 4041894974608795. 4041 8949 7460 8795", "ip 42.144.35.254.", "ssn 123-45-6789", "on 2024-02-29 and 31.12.1999", "GB82 WEST 1234 5698 7654 32"]
    clean = ["id 764263600241 v 2.0. 4041894974608796", "2023-02-30 000-12-3456 1.2.3", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + clean)], "doc_id long, text string").withColumn("m", F.lit("x"))
    r = {x.doc_id: x for x in pii.pseudonymise(df).collect()}
    for i, t in enumerate(texts):
        assert r[i].text != t and r[i].n_private >= 1 and re.sub("[0-9]", "9", r[i].text)[:3] == re.sub("[0-9]", "9", t)[:3]
    a, b = r[0].text.split()[1].strip(","), r[0].text.split()[2]
    assert a.lower() == b.lower()
    phones = re.findall(r"\d{3}.{1,2}\d{3}-\d{4}", r[1].text)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    assert [r[len(texts) + i].text for i in range(len(clean))] == clean and all(r[len(texts) + i].n_private == 0 for i in range(len(clean)))
    card = re.sub(r"\D", "", r[2].text)[:16]
    assert sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(card))) % 10 == 0
    days = spark.range(0, 73049, 7).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    assert pii.pseudonymise(days, kinds=["date"]).select("text").distinct().count() == days.count()
    assert pii.pseudonymise(df.limit(0)).count() == 0 and pii.pseudonymise(df, key="other").where("doc_id = 4").first().text != r[4].text


def test_shuffles_go_with_their_query(spark):
    """Near duplicates leave no shuffle files of the queries that have ended, whether or not the driver collects garbage."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {n for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if (n := f.getName()).startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = names(), spark.conf.get(key, None)
    rows = [(i, " ".join(f"w{(i // 2 * 7 + k) % 90}" for k in range(30)) + " x" * (i % 2)) for i in range(60)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    until = time.time() + 20
    while (left := names() - before) and time.time() < until:
        time.sleep(0.5)
    assert not left and spark.conf.get(key, None) == was
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: c for i, _, c in near_brute(rows)}


def test_mailboxes_of_one_character(spark):
    """Their first half is empty: no remainder by the length of nothing."""
    box = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"to {c}@b.com, {c.upper()}@b.com") for i, c in enumerate(box)] + [(26, "7@b.com")]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert sorted(t[3] for t in got[:26]) == list(box)  # a permutation of the letters
    assert all(t == f"to {t[3]}@b.com, {t[3].upper()}@b.com" for t in got[:26]) and re.fullmatch("[0-9]@b.com", got[26])
    assert [t[3] for t in got[:26]] != list(box)


def test_segments_brute():
    rng = np.random.default_rng(5)

    def brute(scores):
        out = []

        def go(a, z):
            best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=(0,))
            if best[0] > 0:
                i, j = best[3:]
                go(a, i)
                out.append((i, j - 1, round(best[0], 6)))
                go(j, z)

        go(0, len(scores))
        return out

    for _ in range(200):
        s = rng.choice([-3.0, -1.25, 2.5, 4.125, -0.5], rng.integers(1, 12)).tolist()
        got = [(a, b, round(x, 6)) for a, b, x in toxicity.maximal_segments(range(len(s)), s, -1.0)]
        assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in brute(s)))
        assert all(s[a] > 0 and s[b] > 0 for a, b, _ in got)


def test_segments_exact_and_linear():
    """All maximal segments, one by one, against the recursive definition; long texts take time in proportion."""
    import time

    rng = np.random.default_rng(6)

    def maximal(s, a, z):
        best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3:]
        return maximal(s, a, i) + [(i, j - 1, best[0])] + maximal(s, j, z)

    for _ in range(300):
        s = (rng.choice([-3.5, -1.0625, 2.53125, 4.1328125, -0.5], rng.integers(1, 14)) + rng.integers(-50, 50, 1) / 4096).tolist()
        got = toxicity.maximal_segments(range(len(s)), s, -1.0)
        want = [(i, j, x) for i, j, x in maximal(s, 0, len(s))]
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        toxicity.maximal_segments(range(0, 9 * n, 9), np.linspace(4, 2, n).tolist(), -1.0)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_long_texts_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    body = rng.choice(list(b"abcd "), 5000).astype(np.uint8).tobytes()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6]), pa.array([body, b"short"], pa.binary())], names=["doc_id", "crc", "body"])
    got = pa.Table.from_batches(suffix_dedup._pick(200)(None)(iter([batch]))).to_pylist()
    windows = sorted(k for r in got if r["doc_id"] == 1 for k in range(r["at"] >> 17, (r["at"] >> 17) + (r["at"] >> 1 & 0xFFFF) + 1))
    assert windows == list(range(len(body) - 199)) and not [r for r in got if r["doc_id"] == 2]
    words = body.decode()
    whole = jaccard_join.shingles(words)
    monkeypatch.setattr(jaccard_join, "CHUNK", 300)
    assert (jaccard_join.shingles(words) == whole).all()
    twin = spark.createDataFrame([(None, "x" * 250), (None, "y" * 10 + "x" * 240), (3, "z")], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.removal_digest(twin).collect()) == [(1, 0), (250, 240), (250, 250)]


def test_dates_are_permuted_within_their_class(spark):
    days = spark.range(0, 73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("t"))
    forms = ["dd/MM/yyyy", "MM/dd/yyyy", "d/M/yyyy", "yyyy-M-d"]
    x = days.select(F.explode(F.array(*[F.date_format("t", f) for f in forms])).alias("text")).distinct().withColumn("before", F.col("text")).withColumn("n_private", F.lit("clash"))
    r = pii.pseudonymise(x, kinds=["date"]).cache()
    assert r.columns == ["text", "before", "n_private", "private_kinds"]
    n = x.count()
    assert r.select("text").distinct().count() == n and r.where("n_private = 1").count() == n
    assert r.where(F.regexp_replace("text", "[0-9]", "9") != F.regexp_replace("before", "[0-9]", "9")).count() == 0
    assert "a secret of ours" not in pii.pseudonymise(x, "a secret of ours")._jdf.queryExecution().toString()


def test_empty_tables(spark, docs):
    none, path = docs.limit(0), tokenizer_file("word_bpe_49k.json")
    assert packing.pack(none, path).count() == 0 and quality_rules.quality_rules(none).count() == 0
    assert jaccard_join.near_duplicates(none).count() == 0 and jaccard_join.keep_one(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    pieces = tokenizer_file("piece_bpe_32k.model")
    assert segmentations.decode(segmentations.sample_segmentations(none, pieces), pieces).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
    runs = segmentations.words_of("  two  and   three ")
    assert "".join(runs) == "\u2581" + "  two  and   three ".replace(" ", "\u2581") and all(w.lstrip("\u2581").count("\u2581") == 0 for w in runs)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_models_hold_out(spark, docs):
    d, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(d, labels)
    r = toxicity.score(d, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    assert ((r.score >= 0.5) == (r.toxic == 1)).mean() > 0.95
    assert toxicity.passages(d, model).where("e_value > 0.05 or end_word <= start_word").count() == 0
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(d, labels.limit(0))
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0
    kept = toxicity.keep_clean(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    q = quality_classifier.classify(d, quality_classifier.fit(d, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    assert (q.predicted == q.quality).mean() > 0.9
    assert quality_classifier.classify(docs, quality_classifier.fit(d, labels.limit(0))).count() == docs.count()


def test_quality_rules(spark, docs):
    line = "a b c d e f g h i j"
    more = spark.createDataFrame([(100, f"{line}\n{line}\n# $ x", "en", "s0", 0, 0)], docs.schema)
    r = {x.doc_id: x for x in quality_rules.quality_rules(docs.union(more)).collect()}
    assert len(r) == len({x.doc_id for x in docs.union(more).collect()})
    x = r[100]
    assert (x.n_words, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == (23, 2, 1, 20, True)
    assert r[0].n_words == 0 and r[0].base_failed and not r[0].kept and r[7].n_repeat_words == 3000
    rng = np.random.default_rng(2)
    for _ in range(100):
        ids = rng.integers(0, 3, rng.integers(0, 60))
        w = [tuple(ids[i : i + 8]) for i in range(len(ids) - 7)]
        c = collections.Counter(w)
        assert quality_rules.repeat_words(ids) == len({k for i, x in enumerate(w) if c[x] > 1 for k in range(i, i + 8)})


def test_warc(spark):
    rows = [(1, "u", "a"), (2, "u2", "a"), (3, None, None), (4, "u", ""), (None, "x", "a"), (5, "é", "b" * 5000), (6, "v", "b" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(1))
    folder = warc.write_warc(df, roll_bytes=300)
    r = {x.page_id: x for x in warc.read_warc(spark, folder).collect()}
    assert len(r) == len(rows) and all(x.block_ok for x in r.values())
    assert {k: (x.record_type, x.refers_to) for k, x in r.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("response", None), 5: ("revisit", 6), 6: ("response", None)}
    for i, u, h in rows:
        p = (h or "").encode()
        assert r[i].payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode() and r[i].payload_bytes == len(p) and r[i].url == u
    again = warc.write_warc(df, roll_bytes=300)
    names = lambda f: sorted((x.file, x.sha256) for x in spark.read.parquet(f"{f}/manifest").collect())
    assert names(folder) == names(again)
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(25):
        b = rng.normal(size=16)
        rows += [(len(rows) + k + 5, int(c % 3), [float(np.float32(x)) for x in b + rng.normal(size=16) * 0.15]) for k in range(rng.integers(1, 10))]
    rows += [(1000 + k, 1, rows[0][2]) for k in range(12)] + [(2000, None, rows[0][2]), (2001, 1, None), (2002, 1, [0.0] * 16), (2003, 1, [float("nan")] * 16), (2004, 1, [None] + [1.0] * 15), (2005, 1, []), (2006, 1, [1.0, 2.0]), (2007, 1, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("shard", F.lit(0))
    links, root = collections.Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(i, label, np.array(e, float)) for i, label, e in rows if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    for (a, la, x), (b, lb, y) in itertools.combinations(good, 2):
        if la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}


def test_embedding_graph_recall():
    rng = np.random.default_rng(4)
    x = embedding_dedup.unit(np.repeat(rng.normal(size=(60, 32)), 12, 0) + rng.normal(size=(720, 32)) * 0.05)
    offsets, flat = embedding_dedup.both_ways(embedding_dedup.build(x))
    a, b = embedding_dedup.search(x, np.arange(720), offsets, flat, 0, 0.93, 32)
    truth = (x @ x.T >= 0.93).sum() - 720
    assert len(a) / truth >= 0.9 and ((x[a] * x[b]).sum(1) >= 0.93 - 1e-12).all()


def test_segmentations(spark, docs):
    path = tokenizer_file("piece_bpe_32k.model")
    lattice = segmentations.lattice_of(path, 1.0)

    def ways(w):
        if not w:
            return [((), 0.0)]
        out = [((w[:n], *a), lattice.ids[w[:n]][1] + b) for n in range(1, len(w) + 1) if w[:n] in lattice.ids for a, b in ways(w[n:])]
        return out + ([((w[0], *a), len(w[0].encode()) * lattice.byte_weight + b) for a, b in ways(w[1:])] if w[0] not in lattice.ids else [])

    words = segmentations.words_of("the cat is")
    per = [ways(w) for w in words]
    total = sum(math.log(sum(math.exp(b) for _, b in p)) for p in per)
    full = {tuple(lattice.ids[x][0] for x in sum((a for a, _ in c), ())): math.exp(sum(b for _, b in c) - total) for c in itertools.product(*per)}
    n = 4000
    found = segmentations.top_k(lattice, [lattice.numbers(words)] * n, list(range(n)), 2)
    first = collections.Counter(tuple(lattice.piece_ids(f[0][0]).tolist()) for f, _ in found)
    second = collections.Counter(tuple(lattice.piece_ids(f[1][0]).tolist()) for f, _ in found)
    for k, p in full.items():
        for seen, want in ((first[k], p), (second[k], sum(q * p / (1 - q) for j, q in full.items() if j != k))):
            assert abs(seen / n - want) <= 5 * math.sqrt(max(want * (1 - want), 1e-4) / n)
    estimate = sum(math.exp(lp) / -math.expm1(-math.exp(lp - t)) for f, t in found for _, lp, _ in f) / n
    assert abs(estimate - 1) < 0.05
    r = segmentations.sample_segmentations(docs, path, k=3)
    back = segmentations.decode(r, path).toPandas()
    want = {x.doc_id: x.text or "" for x in docs.collect()}
    assert all(want[i if i == i else None] == t for i, t in zip(back.doc_id, back.text))
    s = r.toPandas()
    assert s.groupby("doc_id").apply(lambda g: g.drop_duplicates("sample").perturbed.is_monotonic_decreasing, include_groups=False).all()
    # the same draws on any partitioning (sums may differ in the last bits)
    draws = lambda df: sorted((x.doc_id or -1, x.sample, x.n_pieces, bytes(x.ids), round(x.log_p, 6)) for x in df.collect())
    assert draws(r) == draws(segmentations.sample_segmentations(docs.repartition(5), path, k=3))


def test_segmentations_common_words_kept(spark):
    """Common words' lattices are built once, also after others had to go, and draws don't depend on what went; texts are cut and
    decoded as one by one."""
    path = tokenizer_file("piece_bpe_32k.model")
    small, large, learned = segmentations.Lattice(path, most_arcs=8000), segmentations.Lattice(path), collections.Counter()
    learn = small.learn
    small.learn = lambda new: (learned.update(new), learn(new))[1]
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdeghiklmnoprstu\u00e9\u0416"))
    name = lambda: "".join(rng.choice(letters, 9))
    common = [name() for _ in range(50)]
    for i in range(30):
        rows = [segmentations.words_of(" ".join(rng.permutation([*common, *(name() for _ in range(60))]))) for _ in range(2)]
        (found, threshold), (want, least) = (segmentations.search(x, x.numbers([*rows[0], *rows[1]]), np.array([len(r) for r in rows]), np.array([i, 900 + i], np.uint64), 2) for x in (small, large))
        assert np.allclose(threshold, least)
        for p, q in zip(found, want):
            assert (small.piece_ids(p.arcs) == large.piece_ids(q.arcs)).all() and (p.counts == q.counts).all() and np.allclose(p.log_p, q.log_p)
    assert small._cum.n < 40000 and max(learned[w] for w in common) == 1
    texts = ["a b", None, "", " ", "  ", " a", "a ", "a  b   c  ", "x\u2581y \u2581", "\u00e9\n\tb", "\U0001f600 \ue000 z", "a b c"]
    words, counts = segmentations._raw_words_of(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(np.array(words.to_pylist(), object), np.cumsum(counts)[:-1])] == [segmentations._raw_words(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = segmentations.decode(segmentations.sample_segmentations(df, path), path).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, (t or "").replace("\u2581", " ")) for i, t in enumerate(texts)}
    d = segmentations.decoder_of(path)
    raw = [b"\xe2\x96\x81", b"a", b"\xe2\x96\x81"]  # word marks in byte pieces
    byte = {x: i for i, x in reversed(list(enumerate(d.raw.to_pylist())))}
    ids = np.array([byte[bytes([c])] for c in b"".join(raw)], "<u4").tobytes()
    assert d.decode_many([None, ids, b"", ids[:12]]).to_pylist() == [None, "a ", "", ""] and d.decode_many([None, b""]).to_pylist() == [None, ""]


def test_shared_helpers(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert components(e.limit(0)).count() == 0
    ids = spark.range(0, 100_000, 7).toDF("id")
    bits, every = key_bits(ids, "id"), spark.range(100_000)
    assert maybe_in(every, bits, "id").where("id % 7 = 0").count() == ids.count() and maybe_in(every, bits, "id", negate=True).where("id % 7 = 0").count() == 0
