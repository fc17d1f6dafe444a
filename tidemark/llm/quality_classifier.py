"""Quality classification by hierarchical empirical Bayes.

A document's own evidence (a logistic classifier over text features, as a log Bayes factor) is combined with what its
host and its path under that host are like. Host and path posteriors are Beta-shrunk means of all documents' classifier
probabilities: a path with few documents leans on its host, a host with few on the global prior, with strengths
estimated from the spread between hosts and between paths. Sums are grouped aggregates with map-side combine, first
over salted keys, so one host may hold most rows.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import crc_fold, group_key, spread_join, written

FEATURES = ("log_words", "word_length", "word_length_spread", "distinct_share", "short_share", "digit_share", "upper_share", "symbol_share", "punctuation_share", "repeat_share", "line_repeat_share", "packed_share")
_word = re.compile(r"[^\x20\x09-\x0D]+")


def features(text: str | None) -> list[float]:
    """Shape features of a whole text, each bounded; an empty text is all zero."""
    words = _word.findall(text) if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), max(1, len(text))
    sizes = np.fromiter(map(len, words), float, n)
    lower = text.lower()
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    repeat = sum(a == b for a, b in zip(words, words[1:])) / n
    raw = text.encode("utf-8", "surrogatepass")
    return [math.log1p(n), min(30.0, sizes.mean()), min(30.0, sizes.std()), len(set(words)) / n, float((sizes <= 3).mean()), sum(map(text.count, "0123456789")) / chars, sum(a != b for a, b in zip(text, lower)) / chars if not text.islower() else 0.0, sum(map(text.count, "#*$%&|<>{}[]=_")) / n, sum(map(text.count, ".,;:!?")) / n, repeat, 1 - len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / len(raw)]


def _measure(batches):
    for b in batches:
        x = [features(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[c for c, n in zip(b.columns, b.schema.names) if n != "text"], pa.array(x, pa.list_(pa.float64()))], names=[*[n for n in b.schema.names if n != "text"], "x"])


@dataclass
class QualityModel:
    """Weights over squared and plain standardized features; prior is the training rows' share of quality 1."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    prior: float


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([np.ones((len(z), 1)), z, z**2])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, ridge: float = 1.0) -> QualityModel:
    """Fits the document classifier on labelled rows outside fold 0, at most ``max_rows`` of either label by hash order
    (the bound of the broadcast side and of what comes to the driver: 2 * max_rows feature vectors)."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(crc_fold() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("quality = 1").orderBy(*order).limit(max_rows).union(known.where("quality = 0").orderBy(*order).limit(max_rows))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = d.join(F.broadcast(some), "doc_id").mapInArrow(_measure, "doc_id long, quality int, x array<double>").select("quality", "x").limit(2 * max_rows).toPandas()
    y = got["quality"].to_numpy(float)
    k = len(FEATURES)
    if len(set(y)) < 2:  # nothing to tell apart: the prior alone decides
        return QualityModel([0.0] * k, [1.0] * k, [0.0] * (1 + 2 * k), (y.sum() + 1) / (len(y) + 2))
    x = np.array(got["x"].tolist(), float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a, w = _design(x, mean, scale), np.zeros(1 + 2 * k)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(mean.tolist(), scale.tolist(), w.tolist(), float(y.mean()))


def _classify(model: QualityModel):
    def classify(batches):
        mean, scale, w = (np.array(v) for v in (model.mean, model.scale, model.weights))
        base = math.log(model.prior / (1 - model.prior))
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            logit = np.clip(_design(x, mean, scale) @ w, -30, 30) if any(model.weights) else np.full(len(x), base)
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(logit - base), pa.array(1 / (1 + np.exp(-logit)))], names=[*keep, "evidence", "p"])

    return classify


def _strength(groups: DataFrame, mean: str, within: float = 1.0) -> float:
    """Beta strength of a level: how many pseudo-documents the level above is worth, by the method of moments over
    groups of two or more documents; between 1 and 1,000."""
    r = groups.where("n > 1").agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.expr(f"n * ({mean}) * (1 - ({mean}))")).alias("v"), F.sum(F.expr(f"n * pow(s / n - ({mean}), 2)")).alias("between"), F.sum(F.expr("ss - s * s / n")).alias("inside")).first()
    if not r["n"] or r["n"] <= r["g"]:
        return 20.0
    noise = max(1e-9, r["inside"] / (r["n"] - r["g"]))
    signal = max(1e-9, (r["between"] - r["g"] * noise) / r["n"])
    return float(min(1000.0, max(1.0, noise / signal)))


def classify(docs: DataFrame, model: QualityModel, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence (log Bayes factor), host_prior, path_prior, score and predicted for every document.

    Each document's own probability is left out of the sums that form its prior. Null text is a text without words;
    null hosts and paths are groups of their own; repeated ids keep a row each; an empty table gives no rows; other
    columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    p = written(d.mapInArrow(_classify(model), "doc_id long, host string, path string, evidence double, p double"), "quality-evidence")
    paths = p.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = written(paths, "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")), "quality-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    n, s = int(total["n"] or 0), float(total["s"] or 0.0)
    mean = (s + 1) / (n + 2)
    host_strength = _strength(hosts, repr(mean))
    shrunk = hosts.select(F.col("host").alias("h_host"), F.col("n").alias("h_n"), F.col("s").alias("h_s"))
    both = paths.hint("merge").join(shrunk.hint("merge"), F.col("host").eqNullSafe(F.col("h_host")))
    path_strength = _strength(both, f"(h_s + {host_strength * mean!r}) / (h_n + {host_strength!r})")
    both = written(both.select(group_key("host", "path").alias("group"), F.col("n").alias("weight"), "h_n", "h_s", F.col("n").alias("p_n"), F.col("s").alias("p_s")), "quality-posteriors")
    j = spread_join(p.withColumn("group", group_key("host", "path")), both, "group", n)
    all_but = F.expr(f"(({s!r} - p) + 1) / (({n} - 1) + 2)")
    j = j.withColumn("host_prior", (F.col("h_s") - F.col("p") + host_strength * all_but) / (F.col("h_n") - 1 + host_strength))
    j = j.withColumn("path_prior", (F.col("p_s") - F.col("p") + path_strength * F.col("host_prior")) / (F.col("p_n") - 1 + path_strength))
    prior = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("path_prior")))
    j = j.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.log(prior / (1 - prior))))))
    return j.select("doc_id", "evidence", "host_prior", "path_prior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
