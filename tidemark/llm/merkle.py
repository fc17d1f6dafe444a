"""A manifest of a dataset as a content-addressed Merkle tree, and every document's proof against its root.

1. Leaves: the SHA-256 of each document's fields. One sort by language and doc_id over all partitions ranks them: a row's
   place in its partition plus the rows before that partition.
2. Store: nodes of two children are made in segments of ``SEGMENT`` levels. The task of a segment's block (2 ** SEGMENT ranks)
   writes a record for each node, digest to children, and the block's top goes on to the next segment. Languages' tops are
   the leaves of one more tree, whose top is the root.
3. Descent: requests start at the root and go down segment by segment. In a block the digits of a request's rank choose a
   child in each record; the children not chosen are its path. All leaves below a node share the path above it, so a block
   is sent one path, not one per leaf; the last segment's path follows, and the whole is reversed: leaf to root.
   Every level is looked up by digest, so what is proven is what was stored.

Sizes: a task holds a block of 1,024 ranks and as many records; a tree of 2 ** 40 leaves has four segments.

Nulls: a null field hashes as "-"; a null lang is a tree of its own, the first. Null doc_ids come first in their language
and are never tampered with. Rows equal in doc_id and content are leaves each, in any order, as they are the same. A lone
leaf is its language's subroot, a lone subroot the root, and a proof without siblings hashes the empty string. An empty
table has no rows. A text of any length is hashed in the JVM, once (once more where it is tampered with).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import scratch, written

SEGMENT = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ROOT_TREE = "/"  # languages' trees are "-" for null and "=" with the name
STORE = "tree string, block long, digest binary, children array<binary>, top boolean"
PATH = "tree string, block long, top binary, path array<binary>"
PROOF = "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
BROADCAST_ROWS = 100_000


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(n_chars: Column | None = None) -> Column:
    """The leaf's digest, 32 bytes; with ``n_chars`` in place of the column."""
    value = lambda c: n_chars if c == "n_chars" and n_chars is not None else F.col(c)
    return F.unhex(F.sha2(F.concat(*[_field(value(c)) for c in FIELDS]), 256))


def node(children: list[bytes]) -> bytes:
    """A node's digest: of its children's digests as hex text."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank``, each row's place (from 0) by ``order`` within its ``tree``, and ``size``, the tree's rows.
    One sort over all partitions; then one row per partition and tree tells what lies before."""
    by = ["tree", *order]
    at = F.monotonically_increasing_id()  # partition number, then the row's place in it
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place"))
    placed = written(placed, "placed")
    per = placed.groupBy("tree", "part").agg(F.min("place").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part")  # as many rows as there are partitions
    per = per.select("tree", "part", (F.sum("n").over(before) - F.col("n") - F.col("low")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    per = written(per, "per-partition")
    side = F.broadcast(per) if per.count() <= BROADCAST_ROWS else per.hint("merge")
    return placed.join(side, ["tree", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def levels(size: int, segment: int = SEGMENT) -> int:
    """Levels between a node layer of ``size`` nodes and the top of its block."""
    return min(segment, max(0, int(size) - 1).bit_length())


def _grower(segment: int):
    def grow(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        """The records of one block: its nodes two by two, level by level, up to the block's top."""
        nodes = nodes.sort_values("rank")
        layer, records = list(nodes["digest"]), {}
        for _ in range(levels(nodes["size"].iloc[0], segment)):
            runs = [layer[k : k + 2] for k in range(0, len(layer), 2)]
            layer = [node(r) for r in runs]
            records.update(zip(layer, runs))
        top = layer[0]
        records.setdefault(top, [])  # a lone node has no children
        rows = [(key[0], key[1], d, c, d == top) for d, c in records.items()]
        return pd.DataFrame(rows, columns=["tree", "block", "digest", "children", "top"])

    return grow


def store(nodes: DataFrame, segment: int = SEGMENT) -> tuple[list[DataFrame], DataFrame]:
    """The segments' records, lowest first, of a table of (tree, rank, size, digest), and each tree's top."""
    segments, tops = [], None
    while True:
        grown = nodes.select("tree", F.shiftright("rank", segment).alias("block"), "rank", "size", "digest").groupBy("tree", "block").applyInPandas(_grower(segment), STORE)
        records = written(grown, "records")
        segments.append(records)
        above = nodes.where("rank = 0").select("tree", F.expr(f"(size + {(1 << segment) - 1}) div {1 << segment}").alias("size"))
        above = written(above, "sizes")
        layer = records.where("top").select("tree", F.col("block").alias("rank"), "digest").hint("merge").join(above.hint("merge"), "tree")
        done = layer.where("size = 1").select("tree", "digest")
        tops = done if tops is None else tops.unionByName(done)
        nodes = written(layer.where("size > 1"), "layer")
        if nodes.limit(1).count() == 0:
            return segments, written(tops, "tops")


def descend(top: bytes, children: dict[bytes, list[bytes]], rank: int, depth: int) -> tuple[bytes, list[bytes]]:
    """From a block's top to the node of ``rank`` by the rank's binary digits: that node, and for each level from the top
    the child not chosen, after L or R for its side; empty where a node has one child."""
    at, path = top, []
    for level in range(depth - 1, -1, -1):
        digit = rank >> level & 1
        below = children[at]
        path.append((b"R" if digit == 0 else b"L") + below[1 - digit] if len(below) == 2 else b"")
        at = below[digit]
    return at, path


def _records(side: pd.DataFrame) -> tuple[dict[bytes, list[bytes]], bytes, list[bytes], pd.Series]:
    """A block's records by digest, its top, the path above it, and the row that holds that path."""
    given = side[side["children"].isna()].iloc[0]
    known = side[side["children"].notna()]
    return dict(zip(known["digest"], [list(c) for c in known["children"]])), given["digest"], list(given["path"]), given


def _walker(segment: int):
    def go_down(key: tuple, requests: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        """The paths of one block's requested nodes."""
        children, top, above, _ = _records(side)
        rows = []
        for rank, size in zip(requests["rank"], requests["size"]):
            at, path = descend(top, children, int(rank), levels(size, segment))
            rows.append((key[0], int(rank), at, above + path))
        return pd.DataFrame(rows, columns=["tree", "block", "top", "path"])

    return go_down


def fold(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf and its siblings, leaf to root, give."""
    for other in path:
        leaf = node([leaf] if not other else [leaf, other[1:]] if other[:1] == b"R" else [other[1:], leaf])
    return leaf


def _prover(segment: int):
    columns = ["doc_id", "lang", "rank", "size", "digest", "tampered"]

    def prove(key: tuple, leaves: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        """The proofs of one block's leaves: the path within the block follows the one above it, and both are reversed."""
        children, top, above, given = _records(side)
        subroot, root = given["subroot"].hex(), given["root"].hex()
        rows = []
        for doc_id, lang, rank, size, digest, tampered in leaves[columns].itertuples(index=False):
            found, path = descend(top, children, int(rank), levels(size, segment))
            if found != digest:
                raise ValueError(f"the store has no leaf of rank {rank} in {key[0]}")
            path = (above + path)[::-1]
            proof = hashlib.sha256(b"".join(x[1:].hex().encode() for x in path)).hexdigest()
            folded = fold(digest if tampered is None else tampered, path).hex()
            rows.append((doc_id, lang, digest.hex(), subroot, root, proof, folded, folded == root))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PROOF.split(", ")]).astype({"doc_id": "Int64"})

    return prove


def _side(records: DataFrame, paths: DataFrame) -> DataFrame:
    """A segment's records and the paths to its blocks in one table, to be dealt by block."""
    empty = {"path": "array<binary>", "subroot": "binary", "root": "binary"}
    a = records.select("tree", "block", "digest", "children", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    b = paths.select("tree", "block", F.col("top").alias("digest"), F.lit(None).cast("array<binary>").alias("children"),
                     *[(F.col(c) if c in paths.columns else F.lit(None).cast(t)).alias(c) for c, t in empty.items()])
    return a.unionByName(b)


def _to_lowest(segments: list[DataFrame], size_of: DataFrame, paths: DataFrame, segment: int) -> DataFrame:
    """Paths to the blocks of the lowest segment, from the paths to the trees' tops (as block 0 of their last segment)."""
    for k in range(len(segments) - 1, 0, -1):
        # what segment k has as its lowest nodes are the blocks of segment k - 1
        layer = F.expr(f"ceil(size / power(2, {segment * k}))").cast("long")
        asked = segments[k - 1].where("top").select("tree", F.col("block").alias("rank")).hint("merge").join(size_of.hint("merge"), "tree").select("tree", "rank", layer.alias("size"))
        asked = asked.where("size > 1").withColumn("block", F.shiftright("rank", segment))
        here = paths.hint("merge").join(segments[k].select("tree", "block").distinct().hint("merge"), ["tree", "block"], "left_semi")
        down = asked.groupBy("tree", "block").cogroup(_side(segments[k], here).groupBy("tree", "block")).applyInPandas(_walker(segment), PATH)
        low = asked.select("tree").distinct()
        paths = written(down.unionByName(paths.hint("merge").join(low.hint("merge"), "tree", "left_anti")), "paths")
    return paths


def manifest(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per document: leaf, subroot, root and proof of the table as it is, and the root that its leaf and siblings
    give, where 7 divides the unsigned crc32 of the decimal doc_id after its n_chars was raised by one."""
    spark = docs.sparkSession
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    raised = F.col("n_chars").cast("decimal(20,0)") + 1
    tree = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang")))
    with scratch(spark):
        leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), tree.alias("tree"), leaf_digest().alias("digest"), F.when(hit, leaf_digest(raised)).alias("tampered"))
        leaves = written(ranked(written(leaves, "leaves"), ["doc_id", "digest"]), "ranked")
        segments, subroots = store(leaves.select("tree", "rank", "size", "digest"), segment)
        crown = written(ranked(subroots.select(F.lit(ROOT_TREE).alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]), "crown")
        crown_segments, root = store(crown.select("tree", "rank", "size", "digest"), segment)
        sizes = lambda df: written(df.where("rank = 0").select("tree", "size"), "sizes")
        start = root.select("tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("top"), F.array().cast("array<binary>").alias("path"))
        paths = _to_lowest(crown_segments, sizes(crown), start, segment)
        asked = crown.select("tree", "rank", "size", F.shiftright("rank", segment).alias("block"))
        tops = asked.groupBy("tree", "block").cogroup(_side(crown_segments[0], paths).groupBy("tree", "block")).applyInPandas(_walker(segment), PATH)
        tops = written(tops, "paths").select(F.col("block").alias("rank"), "top", "path").hint("merge").join(crown.select("rank", F.col("name").alias("tree")).hint("merge"), "rank")
        paths = _to_lowest(segments, sizes(leaves), tops.select("tree", F.lit(0).cast("long").alias("block"), "top", "path"), segment)
        ends = subroots.withColumnRenamed("digest", "subroot").crossJoin(root.select(F.col("digest").alias("root")))  # root: one row
        paths = paths.hint("merge").join(ends.hint("merge"), "tree")
        asked = leaves.select("tree", F.shiftright("rank", segment).alias("block"), "doc_id", "lang", "rank", "size", "digest", "tampered")
        return written(asked.groupBy("tree", "block").cogroup(_side(segments[0], paths).groupBy("tree", "block")).applyInPandas(_prover(segment), PROOF), "proofs", keep=True)
