"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then a joined filter.

The sketch is a relative-error histogram: a value falls into the bucket ceil(log(1 + x) / log(gamma)). Two sketches
merge by adding their bucket counts, so a grouped count builds them with map-side combine, and the same counts
summed again give the language's and the whole corpus's sketch. Buckets are deterministic: a rerun gives the
same thresholds.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import WORD, group_key, spread_join, written

SYMBOLS = "#*$%&|<>"
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: feature: (expression, the tail quantile its fence starts at, side); sound texts repeat lines and phrases now and then
FEATURES = {
    "word_length": ("word_chars / n_words", 0.9, "both"),
    "symbol_share": ("n_symbols / n_words", 0.9, "high"),
    "dup_line_share": ("n_dup_lines / n_lines", 0.95, "high"),
    "repeat_share": ("n_repeat_words / n_words", 0.95, "high"),
}
_word = re.compile(WORD)
_c = np.random.default_rng(8).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def repeat_words(ids: np.ndarray, width: int = 8) -> int:
    """How many words lie in a ``width``-word window that occurs twice or more; exact, by ranked doubling."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    h = sum(ids[k : k + n].astype(np.uint64) * _c[k] for k in range(width))
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0
    r, w = ids.astype(np.int64), 1
    while w < width:
        r = np.unique(r[:-w] * (r.max() + 1) + r[w:], return_inverse=True)[1] if len(r) > w else r[:0]
        w *= 2
    twice = np.bincount(r)[r] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = _word.findall(text)
    lines = [x for x in text.split("\n") if _word.search(x)]
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(ids)


def _stats(batches):
    for b in batches:
        rows = list(zip(*map(text_stats, b.column("text").to_pylist())))
        cols = [pa.array(x, pa.int64()) for x in rows] if rows else [pa.array([], pa.int64())] * 6
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *cols], names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])


def document_stats(docs: DataFrame) -> DataFrame:
    """One row of counts per document; null text counts as empty, null lang and source stay null."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return d.mapInArrow(_stats, STATS)


def sketches(stats: DataFrame, relative_error: float = 0.01) -> DataFrame:
    """Bucket counts per language, source and feature over the documents that have words: the mergeable sketch."""
    gamma = math.log((1 + relative_error) / (1 - relative_error))
    values = F.array(*[F.struct(F.lit(k).alias("feature"), F.expr(f"cast(coalesce(try_divide({e.split(' / ')[0]}, {e.split(' / ')[1]}), 0) as double)").alias("x")) for k, (e, _, _) in FEATURES.items()])
    x = stats.where("n_words > 0").select("lang", "source", F.inline(values))
    return x.groupBy("lang", "source", "feature", F.ceil(F.log1p("x") / gamma).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: list[str], quantiles: tuple[float, ...], relative_error: float = 0.01) -> DataFrame:
    """Merges sketches to ``keys`` and reads quantiles: one row per keys and feature with columns q0, q1, ... and n."""
    gamma = math.log((1 + relative_error) / (1 - relative_error))
    m = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "feature")
    m = m.select("*", F.sum("n").over(w.orderBy("bucket")).alias("cum"), F.sum("n").over(w).alias("total"))
    value = F.when(F.col("bucket") <= 0, F.lit(0.0)).otherwise(F.expm1((F.col("bucket") - 0.5) * gamma))
    return m.groupBy(*keys, "feature").agg(F.max("total").alias("n"), *[F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * q), value)).alias(f"q{i}") for i, q in enumerate(quantiles)])


def thresholds(stats: DataFrame, fence: float = 4.0, least_rows: int = 50, relative_error: float = 0.01) -> DataFrame:
    """Low and high fences per (lang, source, feature): the feature's tail quantiles, moved out by one bucket of the
    sketch (its error) and by ``fence`` times their distance from the median. Nothing but the group's own sketch sets
    them. Groups under ``least_rows`` documents take the language's merged sketch, and languages under it the whole
    corpus's."""
    sk = sketches(stats, relative_error)
    tails = sorted({t for _, t, _ in FEATURES.values()})
    q = (*(1 - t for t in tails), 0.5, *tails)
    names = [f"q{i}" for i in range(len(q))]
    own = sketch_quantiles(sk, ["lang", "source"], q, relative_error)
    lang = sketch_quantiles(sk, ["lang"], q, relative_error).select(F.col("lang").alias("l_lang"), F.col("feature").alias("l_f"), *[F.col(c).alias(f"l_{c}") for c in ("n", *names)])
    every = sketch_quantiles(sk, [], q, relative_error).select(F.col("feature").alias("e_f"), *[F.col(c).alias(f"e_{c}") for c in names])
    t = own.hint("merge").join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("feature") == F.col("l_f"))).join(F.broadcast(every), F.col("feature") == F.col("e_f"))  # every: one row per feature
    pick = lambda c: F.when(F.col("n") >= least_rows, F.col(c)).when(F.col("l_n") >= least_rows, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}"))
    of = lambda at: F.coalesce(*[F.when(F.col("feature") == k, pick(names[at(tails.index(tail))])) for k, (_, tail, _) in FEATURES.items()])
    t = t.select("lang", "source", "feature", of(lambda i: i).alias("lo"), pick(names[len(tails)]).alias("mid"), of(lambda i: len(tails) + 1 + i).alias("hi"))
    gamma = math.log((1 + relative_error) / (1 - relative_error))
    low = F.expm1(F.log1p("lo") - gamma) - fence * (F.col("mid") - F.col("lo"))
    high = F.expm1(F.log1p("hi") + gamma) + fence * (F.col("hi") - F.col("mid"))
    return t.select("lang", "source", "feature", low.alias("low"), high.alias("high"))


def quality_rules(docs: DataFrame, fence: float = 4.0, least_rows: int = 50) -> DataFrame:
    """Counts, base rules and the adaptive verdict for every document.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed
    and every feature inside its group's fences. Null text is empty (base_failed); null lang or source form groups
    of their own; repeated doc_ids give a row each; an empty table gives no rows; extra columns are ignored.
    Thresholds come to a hot source's documents by broadcast, to all others by a merge (``spread_join``).
    """
    stats = written(document_stats(docs), "quality-stats")
    one = thresholds(stats, fence, least_rows).groupBy("lang", "source").agg(*[F.max(F.when(F.col("feature") == k, F.col(side))).alias(f"{k}_{side}") for k in FEATURES for side in ("low", "high")])
    sizes = stats.groupBy("lang", "source").agg(F.count("*").alias("weight")).withColumn("group", group_key("lang", "source")).drop("lang", "source")
    one = one.withColumn("group", group_key("lang", "source")).drop("lang", "source")
    one = written(sizes.hint("merge").join(one.hint("merge"), "group", "left"), "quality-thresholds")
    j = spread_join(stats.withColumn("group", group_key("lang", "source")), one, "group", stats.count())
    j = j.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    ok = F.lit(True)
    for k, (e, _, side) in FEATURES.items():
        a, b = e.split(" / ")
        x = F.expr(f"cast(coalesce(try_divide({a}, {b}), 0) as double)")
        ok = ok & (F.col(f"{k}_high").isNull() | (x <= F.col(f"{k}_high")))
        if side == "both":
            ok = ok & (F.col(f"{k}_low").isNull() | (x >= F.col(f"{k}_low")))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ok).alias("kept"))
