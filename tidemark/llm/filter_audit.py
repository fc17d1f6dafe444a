"""How five document filters interact in every order: who removes what, what was redundant, what only one filter finds.

1. Each document becomes a mask of the filters that it fails (bit k: the k-th letter) by column expressions. Filter E
   (a copy of a smaller doc_id's text) compares digests: per digest the smallest id comes from an aggregate with map-side
   combine, and only texts that occur twice are joined back, spread where one has very many copies.
2. Documents are counted into mask cells: at most 32 per part, however large the table.
3. A recursive CTE starts from the empty prefix of each part and extends a prefix by each letter that it hasn't used:
   the step joins the part's mask cells, carries the applied bits and emits the metrics of that step. An order of five
   letters reads its step k from its prefix of k letters. A filter's removals over all orders weigh each prefix by the
   orders that begin with it.

Nulls: a null text is empty, a null lang the part '', a null doc_id is never a copy of a smaller one nor one itself.
An empty text has no words and no code points, so it fails A only (and E as a copy). Rows that repeat a doc_id count one
by one and aren't copies of each other. Several labels of one id: any 1 counts. An empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import WORD, scratch, spread_join, text_of, written

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def content_bits(text: str, words: str) -> Column:
    """The bits of the filters that look at one text only: A, B, C and D."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(F.col(text), "[^A-Z]+", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), F.col(text).rlike("[#$%&*|]")]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of the mask, and how many of
    these have the label quality = 1 and toxic = 1."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of(docs).alias("text"))
    split = text.withColumn("words", F.expr(f"regexp_extract_all(text, r'{WORD}', 0)"))
    base = split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), content_bits("text", "words").alias("mask"))
    with scratch(docs.sparkSession):
        base = written(base.hint("merge").join(known.hint("merge"), "doc_id", "left").fillna(0, ["good", "toxic"]), "masks")
        firsts = written(base.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight")).where("weight > 1"), "firsts")
        copies = spread_join(base, firsts, "digest", base.count()).where("doc_id > first")
        sums = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
        moved = copies.groupBy("part", "mask").agg(*sums)
        out = moved.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
        back = moved.withColumn("mask", F.col("mask").bitwiseOR(COPY))
        cells = base.groupBy("part", "mask").agg(*sums).unionByName(out).unionByName(back)
        return written(cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).where("n > 0"), "cells", keep=True)


@contextmanager
def _every_row(spark: SparkSession):
    """The recursion may emit as many rows as there are parts and prefixes."""
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(ROW_LIMIT, before)


def _count(what: str, condition: str) -> str:
    return f"aggregate(cells, 0L, (a, x) -> a + if({condition}, x.{what}, 0L))"


#: One recursion level: each prefix by each unused letter, over the part's mask cells.
_EXTEND = f"""
WITH RECURSIVE prefix (part, filter_order, step, letter, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
    SELECT part, '', 0, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{by_part}}
    UNION ALL
    SELECT part, concat(filter_order, letter), step, letter, applied | bit,
           {_count("n", "x.mask & (applied | bit) = 0")},
           {_count("n", "x.mask & bit <> 0 and x.mask & applied = 0")},
           {_count("n", "x.mask & bit <> 0 and x.mask & applied <> 0")},
           {_count("n", "x.mask = bit")},
           {_count("good", "x.mask & bit <> 0 and x.mask & applied = 0")},
           {_count("toxic", "x.mask & bit <> 0 and x.mask & applied = 0")}
    FROM (SELECT p.part, p.filter_order, p.step + 1 AS step, p.applied, l.letter, l.bit, c.cells
          FROM prefix p JOIN {{by_part}} c ON p.part = c.part
          LATERAL VIEW inline(array({", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(LETTERS))})) l AS letter, bit
          WHERE p.step < {len(LETTERS)})
    WHERE applied & bit = 0)
SELECT * FROM prefix WHERE step > 0"""


def audit(cells: DataFrame) -> DataFrame:
    """The metrics of every step of every order, from ``mask_cells``."""
    spark = cells.sparkSession
    with scratch(spark):
        by_part = written(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "by-part")
        with _every_row(spark):
            steps = written(spark.sql(_EXTEND, by_part=by_part), "prefixes")
        weight = F.element_at(F.array(*[F.lit(factorial(len(LETTERS) - k)) for k in range(1, len(LETTERS) + 1)]), F.col("step"))
        shares = written(steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * weight).alias("shapley")), "shares")
        whole = steps.where(F.col("step") == len(LETTERS)).select("part", F.col("filter_order").alias("whole"), F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("at"))
        whole = whole.withColumn("filter_order", F.expr("left(whole, at)")).hint("merge").join(steps.hint("merge"), ["part", "filter_order"])
        out = whole.drop("filter_order").withColumnRenamed("whole", "filter_order").hint("merge").join(shares.hint("merge"), ["part", "letter"])
        return written(out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "audit", keep=True)


def filter_interaction(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, zeros included."""
    return audit(mask_cells(docs, labels))
