"""What the operators share: the cluster's shared folder, written intermediate tables, hashing and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words of a text: runs of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: no folder that all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Folders that ``written`` has made inside the ``scratch`` scopes that are open, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """What ``written`` makes inside is deleted at the end, but for what it was told to keep. Nothing that is returned
    may still read it: then a lost executor's work can always be done again from what is left."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and gives Spark true sizes. Inside
    ``scratch`` it is deleted with the scope, with ``keep`` only with the scope around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, the shuffle files of each query go when it has ended, from all executors. By Spark's default they stay until
    the driver collects its garbage, which with a large heap is hardly ever. A frame that is computed twice makes them anew."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release() -> None:
    """Gives what Arrow and the C library hold but don't use back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def small_batches(spark: SparkSession, most: str = "1m") -> None:
    """From now on the session hands Python at most about ``most`` bytes at a time (one row, if that has more), unless it has
    a limit of its own. By Spark's default a batch of texts has up to 64 MB, and so have the buffers around it in the executor and
    in each of its workers. It is set for good, as what is returned is computed later."""
    if (key := "spark.sql.execution.arrow.maxBytesPerBatch") not in spark.conf.getAll:
        spark.conf.set(key, most)


_kept: dict[str, Callable] = {}


def kept(fn):
    """``functools.cache`` for what a worker keeps from task to task, until it gets a task that doesn't name it (``frugal``)."""
    _kept[fn.__name__] = cached = cache(fn)
    return cached


def drop_kept(but: str = "") -> None:
    for name, cached in _kept.items():
        if name != but:
            cached.cache_clear()


def frugal(fn, rows: int = 256, keeps: str = ""):
    """A ``mapInArrow`` function that meets its batches in slices of ``rows`` rows (0: as they come), and whose worker
    keeps no memory that the task has freed, nor what other operators keep between tasks (``kept``; all but ``keeps``)."""

    def run(batches):
        drop_kept(keeps)
        try:
            yield from fn(batches if not rows else (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)))
        finally:
            release()

    return run


def crc_fold(doc_id: str = "doc_id"):
    """The fold of a row: crc32 of the id's decimal text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def text_of(df: DataFrame, column: str = "text"):
    """The text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def key_bits(keys: DataFrame, *columns: str, slots: int = 1 << 26) -> DataFrame:
    """Which of ``slots`` hash slots the keys fall into, as bitmaps of 32,768 bits: at most slots / 8 bytes (8 MB) in
    2,048 rows for any number of keys, so it may be broadcast. Several keys can share a slot."""
    at = F.pmod(F.xxhash64(*columns), F.lit(slots)) + 1
    return written(keys.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")), "bits")


def maybe_in(df: DataFrame, bits: DataFrame, *columns: str, slots: int = 1 << 26, negate: bool = False) -> DataFrame:
    """The rows of ``df`` that may have one of the keys, or with ``negate`` those that surely haven't."""
    at = F.pmod(F.xxhash64(*columns), F.lit(slots)) + 1
    b = F.broadcast(bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    j = df.withColumn("__at", at).join(b, F.expr("bitmap_bucket_number(__at)") == F.col("__bucket"), "left")
    hit = F.expr("coalesce(shiftright(cast(conv(hex(substring(__bits, cast(bitmap_bit_position(__at) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(__at) % 8 as int)) & 1, 0) = 1")
    return j.where(~hit if negate else hit).select(*[F.col(f"`{c}`") for c in df.columns])


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], total: int, parts: int = 1000) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right``; its column ``weight`` is how many rows of ``left`` have the key,
    ``total`` how many there are, and isn't in the result. Keys with over total / parts rows are fewer than ``parts``: they
    are broadcast, so that no task gets a hot key's rows; all others are merged."""
    hot = F.col("weight") * parts > max(total, 1)
    few = F.broadcast(right.where(hot).drop("weight"))
    rest = left.join(few.select(*([key] if isinstance(key, str) else key)), key, "left_anti").hint("merge").join(right.where(~hot).drop("weight").hint("merge"), key)
    return left.join(few, key).unionByName(rest)


def group_key(*columns: str):
    """A text that is the same for the same values of the columns, nulls included, and for no others."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * MIX2
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table by alternating large-star and small-star rounds.

    Returns (node, component): component is the smallest node reachable; only nodes with an edge appear. Each
    round hangs every node's neighbours on the smallest of them, so long chains shrink logarithmically. A node's
    minimum comes from a grouped aggregate with map-side combine joined back to the edges, never from a
    collected group, and every round is written to the shared folder. Self loops and null ends are dropped.
    """
    with scratch(edges.sparkSession):
        e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
        e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        for _ in range(rounds):
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")).select("u", F.least("m", "u").alias("m"), "weight")
            # a node that many hang on is a hot key
            large = spread_join(both.where("v > u"), low, "u", 2 * e.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            ends = F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))
            small = large.hint("merge").join(low.hint("merge"), "u").select(F.explode(ends).alias("s"))
            e = written(small.select(F.col("s.x").alias("u"), F.col("s.y").alias("v")).where("u <> v").distinct(), name)
            if e.groupBy("u").count().where("count > 1").limit(1).count() == 0:
                roots = e.select("v").distinct().join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
                if roots.limit(1).count() == 0:
                    break
        else:
            raise RuntimeError("components did not settle")
        e = written(e, name, keep=True)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
