"""Toxicity by maximum-scoring segments: token log-odds with Dirichlet priors, every significant passage in one
linear scan, and extreme-value calibration of what a passage's score means for a text of that length.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import crc_fold, frugal, scratch, written

_word = re.compile(r"[^\W_]+")
SCORES = "doc_id long, n_words long, n_passages long, best double, evidence double, score double"
PASSAGES = "doc_id long, start_word long, end_word long, start_char long, end_char long, passage_score double, e_value double"


@dataclass
class ToxicityModel:
    """tokens: score of each token that counts; others score ``rest`` (below 0). lam, k: of the extreme-value law."""

    tokens: dict[str, float] = field(default_factory=dict)
    rest: float = -1.0
    lam: float = 1.0
    k: float = 0.1
    bias: float = -2.0
    slope: float = 1.0
    max_e: float = 0.05


def maximal_segments(at: np.ndarray | list, score: list, rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, by a stack of candidates with cumulative scores on either side.

    ``at`` are ascending positions that score ``score``; all positions between score ``rest`` < 0, so a segment
    starts and ends at one of ``at``. Returns (first, last, sum) in order; time is linear in len(at).
    """
    # first, last, cumulative before first, cumulative through last, nearest earlier candidate that starts lower
    stack: list[tuple[int, int, float, float, int]] = []
    total, before = 0.0, -1
    for p, s in zip(at, score):
        total += rest * (p - before - 1)
        before = p
        left, total = total, total + s
        if s <= 0:
            continue
        first, last, right = p, p, total
        j = len(stack) - 1
        while True:
            # the nearest candidate that starts lower: those that start higher than one passed are jumped over
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            first, left, lower = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = lower
        stack.append((first, last, left, right, j))
    return [(a, b, r - c) for a, b, c, r, _ in stack]


def _segments(words: list[str], model: ToxicityModel) -> list[tuple[int, int, float]]:
    t = model.tokens
    at = [i for i, w in enumerate(words) if w in t]
    return maximal_segments(at, [t[words[i]] for i in at], model.rest) if at else []


def score_text(text: str | None, model: ToxicityModel) -> tuple[int, int, float, float, float]:
    """n_words, significant passages, best passage's score, evidence and the calibrated score of a whole text."""
    words = _word.findall(text.lower()) if text else []
    segments = _segments(words, model)
    n = max(1, len(words))
    bits = [model.lam * s - math.log(model.k * n) for _, _, s in segments]
    good = [b for b in bits if math.exp(-min(700, b)) <= model.max_e]
    evidence = math.log1p(sum(good)) if good else 0.0
    x = model.bias + model.slope * evidence
    return len(words), len(good), max((s for _, _, s in segments), default=0.0), evidence, 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _scorer(model: ToxicityModel):
    def score(batches):
        for b in batches:
            rows = [score_text(t, model) for t in b.column("text").to_pylist()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_words", "n_passages", "best", "evidence", "score"])

    return frugal(score)


def _finder(model: ToxicityModel):
    def find(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                spans = [m.span() for m in _word.finditer(text)] if text else []
                words = [text[a:z].lower() for a, z in spans]
                for a, z, s in _segments(words, model):
                    e = model.k * max(1, len(words)) * math.exp(-model.lam * s)
                    if e <= model.max_e:
                        rows.append((doc_id, a, z + 1, spans[a][0], spans[z][1], s, e))
            kinds = (pa.int64(),) * 5 + (pa.float64(),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[x.split()[0] for x in PASSAGES.split(", ")])

    return frugal(find)


def _signer(batches):
    """Adds the least hash of a text's three-word runs: copies and most near copies share it."""
    for b in batches:
        signs = []
        for text in b.column("text").to_pylist():
            words = _word.findall(text.lower())
            runs = (" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))
            signs.append(min(zlib.crc32(x.encode()) << 32 | zlib.adler32(x.encode()) for x in runs) >> 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(signs, pa.int64())], names=[*b.schema.names, "sign"])


def _counter(batches):
    """Documents of either kind that hold a token."""
    for b in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            for w in set(_word.findall(text.lower())):
                counts.setdefault(w, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["token", "clean", "toxic"])


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows outside fold 0, at most ``max_rows`` of either label, by hash order.

    The label side of the join is bounded by 2 * max_rows rows of 12 bytes whatever the tables' size, so it is broadcast.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(crc_fold() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(max_rows).union(known.where("toxic = 0").orderBy(*order).limit(max_rows))
    return _input(docs).where("text is not null").join(F.broadcast(some), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_tokens: int = 20_000, prior_share: float = 0.02, min_z: float = 2.5, max_e: float = 0.05) -> ToxicityModel:
    """Learns token scores, the extreme-value law and the calibration from labelled rows outside fold 0.

    A token's log-odds between toxic and clean documents, of which those with one signature count once, take a Dirichlet prior in proportion to its overall count
    (``prior_share`` of all tokens); those above ``min_z`` standard errors count, at most ``max_tokens``. lam solves
    E[exp(lam * s)] = 1 over the clean tokens; k is its maximum-likelihood value from the best passages of clean
    documents. Without labels of both kinds every document scores the neutral prior.
    """
    with scratch(docs.sparkSession):
        return _fit(training_rows(docs, labels, max_rows), max_tokens, prior_share, min_z, max_e)


def _fit(rows: DataFrame, max_tokens: int, prior_share: float, min_z: float, max_e: float) -> ToxicityModel:
    rows = written(rows.mapInArrow(frugal(_signer), "doc_id long, text string, toxic int, sign long"), "toxicity-rows")
    one = rows.groupBy("sign", "toxic").agg(F.min("doc_id").alias("doc_id"))  # a document copied many times counts once
    counts = written(rows.join(F.broadcast(one.select("doc_id").distinct()), "doc_id", "left_semi").select("text", "toxic").mapInArrow(frugal(_counter, 1024), "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-counts")
    n0, n1 = (int(x or 0) for x in counts.agg(F.sum("clean"), F.sum("toxic")).first())
    by = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    d1, d0 = by.get(1, 0), by.get(0, 0)
    model = ToxicityModel(max_e=max_e, bias=math.log((d1 + 1) / (d0 + 9)))
    if not n0 or not n1:
        return model
    alpha = F.lit(prior_share) * (F.col("clean") + F.col("toxic"))
    a0 = prior_share * (n0 + n1)
    delta = F.log((F.col("toxic") + alpha) / (n1 + a0 - F.col("toxic") - alpha)) - F.log((F.col("clean") + alpha) / (n0 + a0 - F.col("clean") - alpha))
    z = delta / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    top = counts.where("clean + toxic >= 3").select("token", "clean", delta.alias("delta"), z.alias("z")).where((F.col("z") >= min_z) & (F.col("delta") > 1)).orderBy(F.desc("z"), "token").limit(max_tokens).collect()  # at most max_tokens rows
    model.tokens = {r["token"]: float(r["delta"]) for r in top}
    if not top:
        return model
    share = {r["token"]: (r["clean"] + 0.5) / (n0 + 1) for r in top}
    rest_share = max(1e-9, 1 - sum(share.values()))
    # the other tokens' score: what their common log-odds is, kept so far below 0 that clean text loses score
    mean = sum(share[t] * s for t, s in model.tokens.items())
    model.rest = -max(1.0, 2 * mean / rest_share)
    low, high = 1e-6, 1.0
    drift = lambda x: sum(share[t] * math.exp(min(600, x * s)) for t, s in model.tokens.items()) + rest_share * math.exp(x * model.rest) - 1
    while drift(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if drift(mid) < 0 else (low, mid)
    model.lam, model.k = low, 1e-9
    seen = rows.select("doc_id", "text").mapInArrow(_scorer(model), SCORES).hint("merge").join(rows.select("doc_id", "toxic").hint("merge"), "doc_id")
    x = seen.where("toxic = 0").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(1), "n_words") * F.exp(-F.lit(model.lam) * F.col("best"))).alias("s")).first()
    model.k = max(1e-9, x["n"] / x["s"]) if x["s"] else 0.1
    points = rows.select("doc_id", "text").mapInArrow(_scorer(model), SCORES).hint("merge").join(rows.select("doc_id", "toxic").hint("merge"), "doc_id")
    points = points.groupBy(F.round("evidence", 2).alias("e")).agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).toPandas()  # evidence is a logarithm: under 2,000 rounded values
    model.bias, model.slope = _logistic(points["e"].to_numpy(float), points["y"].to_numpy(float), points["n"].to_numpy(float))
    return model


def _logistic(e: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Bias and slope of a weighted logistic fit by Newton steps; the slope isn't negative."""
    w = np.array([math.log((y.sum() + 1) / (n.sum() - y.sum() + 9)), 1.0])
    x = np.stack([np.ones_like(e), e], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - n * p) - ridge * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(2) * (ridge + 1e-6)
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """SCORES per document. Null or empty text scores as a text without passages; ids may be null or repeated (a
    row each); an empty table gives no rows; extra columns are ignored."""
    return _input(docs).mapInArrow(_scorer(model), SCORES)


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant passage with its word span, character span, score and E-value. Null and empty texts have none;
    rows that repeat an id give their passages each; an empty table gives no rows; extra columns are ignored."""
    return _input(docs).mapInArrow(_finder(model), PASSAGES)


def keep_clean(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below ``least``: scored and filtered in the scan, no join.
    Null and empty texts score as texts without passages; repeated rows stay each; an empty table gives no rows."""

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array([score_text(t, model)[4] < least for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(frugal(keep), docs.schema)
