"""Document fingerprints: one-permutation MinHash of five-word shingles, densified, its low-order bits packed.

Each distinct shingle (A-Z lower-cased, as in ``jaccard_join``) is hashed once; the code's top bits are its bin, and a bin
keeps its least code. An empty bin takes over the value of a full one that a sequence of hashes of the bin's number meets
first, the same for every document: optimal densification. Of each bin BITS low-order bits are kept: 512 bins of 4 bits are
256 bytes. Two bins agree by chance once in 2 ** BITS; the share of equal bins less that chance, rescaled, is the likeness.
Its standard error is at most 0.024 where texts have many more shingles than there are bins.

``edited_likeness`` compares each document with its successor by doc_id and with a text that ends like the successor begins.
Documents are dealt by ranges of doc_id, their texts compressed on the way, and met in order, one at a time; only the
first and last document of each partition wait for the others' and are joined after.

Null and empty texts, and texts without a word, have the fingerprint '' (no bins), which is like another of these by 1, like
any other by 0. A text under five words is one shingle. Null doc_ids come first; rows that repeat a doc_id follow each
other by their text's hash, each with the next row as its successor. The last document is followed by the first: a single
one by itself. An empty table has no rows. Texts of any length are read whole, in chunks of 1 MB at a time for the words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import frugal, mix64, scratch, text_of, written
from tidemark.llm.jaccard_join import shingles

BINS = 512
BITS = 4
WIDTH = 5
TRIES = 64


def _candidates(bins: np.ndarray, first: int, n_bins: int) -> np.ndarray:
    """The bins that each of ``bins`` asks in its tries ``first`` to ``first`` + TRIES - 1."""
    x = (bins.astype(np.uint64)[:, None] << np.uint64(32)) + np.arange(first + 1, first + TRIES + 1, dtype=np.uint64)
    return (mix64(x) >> np.uint64(65 - n_bins.bit_length())).astype(np.int64)


_first_tries: dict[int, np.ndarray] = {}


def densify(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Each empty bin filled with the value of the first full bin among those that it asks. At least one bin is full."""
    n_bins = len(full)
    if n_bins not in _first_tries:
        _first_tries[n_bins] = _candidates(np.arange(n_bins), 0, n_bins)
    if full.sum() == 1:
        return np.full(n_bins, values[full][0])
    out, empty, first = values.copy(), np.flatnonzero(~full), 0
    while len(empty):
        asked = _first_tries[n_bins][empty] if first == 0 else _candidates(empty, first, n_bins)
        hit = full[asked]
        found, at = hit.any(1), hit.argmax(1)
        out[empty[found]] = values[asked[found, at[found]]]
        empty, first = empty[~found], first + TRIES
    return out


def sketch(text: str | None, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> bytes:
    """The packed fingerprint of a text; ``bins`` is a power of two. Empty if there is no word."""
    codes = shingles(text, width)
    if not len(codes):
        return b""
    at = (codes >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    held, least = np.unique(at, return_index=True)  # codes are sorted: the first of a bin is its least
    values, full = np.zeros(bins, np.uint8), np.zeros(bins, bool)
    values[held], full[held] = (codes[least] & np.uint64(2**bits - 1)).astype(np.uint8), True
    values = densify(values, full)
    return np.packbits((values[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).tobytes()


def likeness_of(a: bytes, b: bytes, bits: int = BITS) -> float:
    """The estimated Jaccard similarity of two packed fingerprints of the same shape."""
    if not a or not b:
        return float(a == b)
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)).reshape(-1, bits) for s in (a, b))
    chance = 2.0**-bits
    return float(np.clip(((x == y).all(1).mean() - chance) / (1 - chance), 0.0, 1.0))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """The estimated similarity of two columns of hexadecimal fingerprints; null where either is null."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness_of(bytes.fromhex(p), bytes.fromhex(q), bits) for p, q in zip(x, y)], dtype="float64")

    return of(a, b)


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint) of each document, the packed bits in hexadecimal."""

    def run(batches):
        for b in batches:
            prints = [sketch(t, bins, bits, width).hex() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(frugal(run), "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by as many of the following text's first (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: A partition's first and last document: its number, place (0 first, 1 last), id and text.
EDGE = "part int, place int, edge_id long, edge_text string"
_names = [c.split()[0] for c in f"{RESULT}, {EDGE}".split(", ")]
_kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
_schema = pa.schema([(c.split()[0], _kinds[c.split()[1]]) for c in f"{RESULT}, {EDGE}".split(", ")])


def _compare(doc_id: int | None, text: str, print_: bytes, following: str, next_print: bytes) -> tuple:
    new = edited(text, following)
    own = sketch(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(), print_, own, likeness_of(print_, own), likeness_of(print_, next_print)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _schema.types)], schema=_schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the shuffle: less than half of the bytes, where Spark's own codec leaves two thirds."""
    for b in batches:
        texts = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(texts, pa.binary())], names=["doc_id", "tie", "packed"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition, each document with the next; the first and the last are passed on as edges."""
    part, before, nothing = TaskContext.get().partitionId(), None, (None,) * 7
    for b in batches:
        rows = []
        for doc_id, packed in zip(b.column("doc_id").to_pylist(), b.column("packed").to_pylist()):
            text = zlib.decompress(packed).decode("utf-8", "surrogatepass")
            now = (doc_id, text, sketch(text))
            if before is None:
                rows.append((*nothing, part, 0, doc_id, text))
            else:
                rows.append((*_compare(*before, text, now[2]), *(None,) * 4))
            before = now
        if rows:
            yield _batch(rows)
    if before is not None:
        yield _batch([(*nothing, part, 1, before[0], before[1])])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(*_compare(i, t, sketch(t), f, sketch(f)), *(None,) * 4) for i, t, f in zip(*(b.column(c).to_pylist() for c in ("edge_id", "edge_text", "following")))]
        if rows:
            yield _batch(rows)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and its likeness to that and to the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("tie"), text_of(docs).alias("text"))
    rows = rows.mapInArrow(frugal(_packed), "doc_id long, tie long, packed binary")
    order = ["doc_id", "tie"]
    with scratch(docs.sparkSession):
        met = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(frugal(_in_order, 64), f"{RESULT}, {EDGE}")
        met = written(met, "fingerprints", keep=True)
        edges = met.where("part is not null").select(*[c.split()[0] for c in EDGE.split(", ")])
        parts = edges.where("place = 0").select("part")  # one row per partition, without texts
        following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
        last = edges.where("place = 1").select("part", "edge_id", "edge_text").hint("merge").join(following.hint("merge"), "part")
        first = edges.where("place = 0").select(F.col("part").alias("next"), F.col("edge_text").alias("following"))
        ends = written(last.hint("merge").join(first.hint("merge"), "next").mapInArrow(frugal(_edges, 64), f"{RESULT}, {EDGE}"), "edges", keep=True)
    whole = met.where("part is null").unionByName(ends)
    hexed = {"edited_sha256", "fingerprint", "edited_fingerprint"}
    return whole.select(*[F.lower(F.hex(c)).alias(c) if c in hexed else F.col(c) for c in _names[:7]])
