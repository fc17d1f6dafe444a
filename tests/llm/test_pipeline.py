"""The corpus pipeline against the same five steps in plain Python, row by row."""

import collections
import uuid
import zlib
from pathlib import Path

import numpy as np
import pytest
from test_operators import near_brute

from tidemark.llm import packing, pii, suffix_dedup, toxicity
from tidemark.llm.common import frugal
from tidemark.llm.registry import tokenizer_file

DATA = Path("/root/testdata/sf0.01")


def without_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        keep = np.ones(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                keep[i : i + length] = False
        out.append(bytes(np.frombuffer(t, np.uint8)[keep]).decode("utf-8", "ignore"))
    return out


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rng = np.random.default_rng(12)
    words = lambda n: [f"{a}{b}" for a, b in zip(rng.choice(["ter", "mol", "fan", "quo"], n), rng.integers(0, 900, n))]
    passage, long_ = " ".join(words(60)), words(300)
    planted = [
        (100_001, " ".join(words(50) + [passage] + words(40))),
        (100_002, " ".join(words(70) + [passage] + words(10) + [passage])),
        (100_003, " ".join(long_)),
        (100_004, " ".join(long_[:100] + ["changed"] + long_[101:])),
        (100_005, "Write to ann.4@mail8.example.com or 988-555-2485, card 4041894974608795 of 2024-02-29. " + " ".join(words(30))),
        (100_006, None),
        (100_007, ""),
        (100_008, " ".join(words(9000))),
    ]
    more = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*[more[c].cast(docs.schema[c].dataType) for c in docs.columns])).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    model = toxicity.fit(docs, labels)
    clean = [(i, t) for i, t in rows if toxicity.score_text(t, model)[4] < 0.5]
    head = {i: c for i, _, c in near_brute(clean)}
    ones = [(i, t) for i, t in clean if head[i] == i]
    cut = list(zip([i for i, _ in ones], without_repeats([t for _, t in ones])))
    private = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(cut, "doc_id long, text string")).collect()}
    # every step has something to do, and does it to what was planted
    assert len(rows) > len(clean) > len(ones) and {100_001, 100_002, 100_003, 100_005, 100_006, 100_007, 100_008} <= private.keys() and 100_004 not in private
    assert passage[:50] not in private[100_001] + private[100_002] and "ann.4@" not in private[100_005] and "4041894974608795" not in private[100_005]

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    assert set(got.doc_id) == private.keys()
    for doc_id, pieces in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(private[doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (pieces.doc_tokens == len(ids)).all() and pieces.length.sum() == len(ids)
        assert (pieces.length.cumsum() - pieces.length == pieces.start).all()
        for p in pieces.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 4096 and (sums <= 4096 - 32).sum() <= 1  # short by a cut's least length at most, but for the last
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "private", "packing"]


def test_batches_are_small(spark, tmp_path, monkeypatch):
    """The texts that a stage hands to Python come a megabyte at a time, however many there are."""
    import corpus_pipeline

    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", tmp_path / "seen"
    seen.mkdir()

    def noted(fn, rows=256):
        def run(batches):
            def each():
                for b in batches:
                    (seen / uuid.uuid4().hex).write_text(str(b.nbytes))
                    yield b

            yield from fn(each())

        return run

    monkeypatch.setattr(suffix_dedup, "frugal", noted)
    before = spark.conf.getAll.get(key)
    try:
        spark.conf.unset(key)
        docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 2000), x -> sha2(concat(id, ' ', x), 256))) AS text", "0L AS n_chars")
        assert corpus_pipeline.cut_repeats(spark, docs, "").count() == 60
        sizes = [int(p.read_text()) for p in seen.iterdir()]
        assert 60 * 130_000 < sum(sizes) and max(sizes) < 1_500_000
        spark.conf.set(key, "5m")  # a limit of the session's own holds
        corpus_pipeline.replace_private(spark, docs, "")
        assert spark.conf.get(key) == "5m"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_workers_drop_what_other_operators_keep():
    """The tokenizer and its words stay from one packing task to the next, and go with the first task of another operator."""
    kept = packing.tokens_of(tokenizer_file("word_bpe_49k.json"))
    assert list(frugal(list, keeps="tokens_of")([])) == [] and packing.tokens_of(tokenizer_file("word_bpe_49k.json")) is kept
    assert list(frugal(list)([])) == [] and packing.tokens_of.cache_info().currsize == 0


def test_addresses_that_repeats_cut_short(spark):
    """A passage that repeats up to the middle of an address leaves a mailbox of one character, which becomes private too."""
    import corpus_pipeline

    passage = " ".join(f"w{i}" for i in range(80)) + " ann.lee-"
    docs = spark.createDataFrame([(1, passage + "q@mail.example.com", 0), (2, passage + "z@mail.example.com", 0)], "doc_id long, text string, n_chars long")
    cut = corpus_pipeline.cut_repeats(spark, docs, "").cache()
    assert sorted(r.text for r in cut.collect()) == ["q@mail.example.com", "z@mail.example.com"]
    got = sorted(r.text for r in corpus_pipeline.replace_private(spark, cut, "").collect())
    assert len(set(got)) == 2 and all(len(t) == 18 and t.endswith("@mail.example.com") for t in got)
