"""Repeated substrings by a distributed sparse suffix array.

Every ``length``-byte window of a text picks one suffix: the start, among its first length - GRAMS[0] + 1 positions, with
the least hash of the GRAMS[0] bytes that follow. Equal windows pick equal suffixes, so only picked suffixes are sorted
(about one in 68 bytes). Their leading token is the code of those bytes, the next one the code of all that their
windows cover (the suffix's context).

1. Splitters, read from the suffixes of a hash sample of the documents, range-partition the suffixes by their leading
   tokens; a hash of the row comes last, so a passage that a third of all documents hold spreads over buckets. The
   sample decides how even the buckets are, never what is found. Each bucket is sorted by multikey quicksort. A context
   next to an equal one is a repeat as a whole. A suffix whose leading token meets other contexts, or that stands at
   a bucket's edge, goes on; all others have no equal window anywhere.
2. Of what goes on, one suffix per distinct context and bucket is opened: its windows pick suffixes anew, by GRAMS[1]
   bytes, which are compared in the same way, so that little is left around the places where copies differ.
3. What goes on from there is opened into single windows; these are range-partitioned by their own tokens and sorted
   in the same way, and the ends of neighbouring buckets are compared by a grouped count over two rows a bucket.

Texts are only shuffled for the documents that steps 2 and 3 or the removal need. A bitmap of fixed size tells which
may be among them; a false alarm costs a text's shuffle and changes nothing.

Codes are 64 bits each and two are compared, so different windows count as equal with a chance near 2**-100.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import frugal, key_bits, maybe_in, mix64, scratch, written

GRAMS = (64, 150)
SUFFIXES = "lead long, context long, doc_id long, crc long, at long, part int"
_NAMES = ["lead", "context", "doc_id", "crc", "at", "part"]
FOUND = "kind int, lead long, context long, doc_id long, crc long, at long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_table = np.random.default_rng(200).integers(0, 2**64, (2, 256), dtype=np.uint64)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_POS = np.uint64(28)  # low bits that hold a position in a block; a block is under 2**28 bytes
BLOCK = 1 << 18  # bytes that are worked on together
CHUNK = 1 << 22  # longer texts are cut into chunks that overlap by one byte less than a window


def codes(buf: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit code of the ``width`` bytes from each position, by doubling."""
    h, w = _table[seed][buf], 1
    while 2 * w <= width:
        h = h[:-w] * _A + h[w:] * _B if len(h) > w else h[:0]
        h ^= h >> np.uint64(29)
        w *= 2
    if w < width:
        k = width - w
        h = h[:-k] * _A + h[k:] * _B if len(h) > k else h[:0]
    return mix64(h)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


def picked(buf: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, lead code, first window, last window) of the picked suffixes of texts laid end to end."""
    if len(buf) < length:
        return (np.zeros(0, np.int64),) * 4
    g = min(gram, length)
    h = codes(buf, g)
    mask = (np.uint64(1) << _POS) - np.uint64(1)
    at = (_window_min(h & ~mask | np.arange(len(h), dtype=np.uint64), length - g + 1) & mask).astype(np.int64)
    n = len(at)  # windows
    ends = np.append(starts[1:], len(buf))
    edge = np.zeros(n + 1, np.int64)
    good = ends - starts >= length
    np.add.at(edge, starts[good], 1)
    np.add.at(edge, ends[good] - length + 1, -1)
    valid = np.cumsum(edge)[:n] > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    lo = np.flatnonzero(first)
    # a run of valid windows ends before the next first or where validity ends
    stop = np.flatnonzero(np.append(valid[:-1] & (~valid[1:] | (at[1:] != at[:-1])), valid[-1:]))
    doc = np.searchsorted(starts, lo, "right") - 1
    return doc, h[at[lo]], lo, stop


def multikey_order(columns: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """The order that sorts rows of tokens: three-way partition on the token at hand, equals go on to the next."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, z, d = todo.pop()
        if z - a < 2 or d == len(columns):
            continue
        part = order[a:z]
        if z - a <= small:
            order[a:z] = part[np.lexsort([c[part] for c in columns[: d - 1 if d else None : -1]])]
            continue
        v = columns[d][part]
        pivot = np.sort(v[[0, len(v) // 2, -1]])[1]
        less, same = v < pivot, v == pivot
        order[a:z] = np.concatenate([part[less], part[same], part[~(less | same)]])
        m, e = a + int(less.sum()), a + int(less.sum()) + int(same.sum())
        todo += [(a, m, d), (m, e, d + 1), (e, z, d)]
    return order


def _blocks(batches, length: int, most: int = BLOCK, chunk: int | None = None):
    """Rows (doc_id, crc, offset, bytes) in lists of about ``most`` bytes. Each window of a text lies in one row."""
    rows, size = [], 0
    step = (chunk or CHUNK) - length + 1
    for b in batches:
        for doc_id, crc, body in zip(*(c.to_pylist() for c in b.columns)):
            for k in range(0, max(1, len(body) - length + 1), step):
                rows.append((doc_id, crc, k, body[k : k + step + length - 1] if len(body) > step else body))
                size += len(rows[-1][-1])
                if size >= most:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def _tie(doc_id: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of a suffix's place: what parts equal suffixes."""
    return mix64(doc_id.astype(np.uint64) * _A + at.astype(np.uint64)).view(np.int64)


class Splitters:
    """Ascending (lead, context, tie) triples; ``part`` says how many of them a row isn't below."""

    def __init__(self, lead: np.ndarray, context: np.ndarray, tie: np.ndarray):
        self.lead, self.context, self.tie = lead, context, tie

    def part(self, lead: np.ndarray, context: np.ndarray, tie: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.lead, lead, "left"), np.searchsorted(self.lead, lead, "right")
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            c, t = context[open_], tie[open_]
            over = (self.context[mid] < c) | ((self.context[mid] == c) & (self.tie[mid] <= t))
            lo[open_], hi[open_] = np.where(over, mid + 1, lo[open_]), np.where(over, hi[open_], mid)
        return lo


def _suffixes(lead, context, doc_id, crc, at, splitters: Splitters | None) -> pa.RecordBatch:
    lead, context = lead.view(np.int64), context.view(np.int64)
    part = splitters.part(lead, context, _tie(doc_id, at)) if splitters else np.zeros(len(lead))
    return pa.RecordBatch.from_arrays([*map(pa.array, (lead, context, doc_id, crc, at, part.astype(np.int32)))], names=_NAMES)


def _contexts(joined: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    view, blake = memoryview(joined), hashlib.blake2b
    return np.frombuffer(b"".join([blake(view[a : z + length], digest_size=8).digest() for a, z in zip(lo.tolist(), hi.tolist())]), "<i8")


def _pick(length: int):
    def maker(splitters: Splitters | None):
        def pick(batches):
            for rows in _blocks(batches, length):
                joined = b"".join(r[-1] for r in rows)
                starts = np.cumsum([0] + [len(r[-1]) for r in rows[:-1]])
                # an empty text shares its start with the next: searchsorted(right) then names the last of them
                doc, lead, lo, hi = picked(np.frombuffer(joined, np.uint8), starts, length, GRAMS[0])
                ids, crc, offset = (np.array([r[k] for r in rows], np.int64)[doc] for k in range(3))
                at = (lo - starts[doc] + offset) << 17 | (hi - lo) << 1
                yield _suffixes(lead, _contexts(joined, lo, hi, length), ids, crc, at, splitters)

        return frugal(pick)

    return maker


def _bucket(batches) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, and the length as the last."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    change[0] = True
    return np.append(np.flatnonzero(change), len(change))


def _compare(batches):
    """A sorted bucket of suffixes: kind 1 are repeats as a whole, kind 2 go on (kind 3: with an equal context elsewhere)."""
    t = _bucket(batches)
    if t is None:
        return
    lead, context, at = (t.column(k).to_numpy() for k in ("lead", "context", "at"))
    order = multikey_order([lead, context])
    lead, context, at = lead[order], context[order], at[order]
    by_lead, by_both = _runs(lead), _runs(lead, context)
    size = np.diff(by_both)
    repeat = np.repeat((size > 1) | (np.maximum.reduceat(at & 1, by_both[:-1]) > 0), size)
    # leading tokens with several contexts, and those at the bucket's edges
    run = np.repeat(np.arange(len(by_lead) - 1), np.diff(by_lead))
    mixed = np.diff(np.searchsorted(by_both[:-1], by_lead)) > 1
    mixed[[0, -1]] = True
    heads = by_both[:-1]
    go = heads[mixed[run[heads]]]
    again = repeat[go]
    pick = np.concatenate([np.flatnonzero(repeat), go])
    kind = np.concatenate([np.ones(int(repeat.sum()), np.int32), 2 + again.astype(np.int32)])
    out = t.take(pa.array(order[pick]))
    yield from pa.table([pa.array(kind), *out.columns], names=["kind", *t.column_names]).to_batches(1 << 16)


def _pieces(batches, length: int, most: int = BLOCK):
    """Pieces, the opened contexts of some documents: doc_id, crc, first window, mark and size of each, and their bytes
    end to end, about ``most`` at a time."""
    for b in batches:
        ids, crc, spans, bodies = b.columns
        ids, crc = ids.to_numpy(), crc.to_numpy()
        x, row = spans.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), spans.value_lengths().to_numpy())
        order = np.lexsort((x >> 1, row))
        x, row = x[order], row[order]
        runs = _runs(row, x >> 1)[:-1] if len(x) else np.zeros(0, np.int64)
        mark, x, row = np.maximum.reduceat(x & 1, runs) if len(x) else x, x[runs] >> 1, row[runs]
        where, size = x >> 16, (x & 0xFFFF) + length
        ends = np.cumsum(size)
        texts = bodies.to_pylist()
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(most, int(ends[-1]) if len(ends) else 0, most)), len(x)])
        for a, z in pairwise(cuts.tolist()):
            joined = b"".join([texts[r][w : w + n] for r, w, n in zip(row[a:z].tolist(), where[a:z].tolist(), size[a:z].tolist())])
            yield ids[row[a:z]], crc[row[a:z]], where[a:z], mark[a:z], size[a:z], joined


def _repick(length: int):
    def maker(splitters: Splitters | None):
        def repick(batches):
            for ids, crc, where, marks, size, joined in _pieces(batches, length):
                starts = np.cumsum(size) - size
                piece, lead, lo, hi = picked(np.frombuffer(joined, np.uint8), starts, length, GRAMS[1])
                at = (lo - starts[piece] + where[piece]) << 17 | (hi - lo) << 1 | marks[piece]
                yield _suffixes(lead, _contexts(joined, lo, hi, length), ids[piece], crc[piece], at, splitters)

        return frugal(repick)

    return maker


def _open(length: int):
    def maker(splitters: Splitters | None):
        def open_(batches):
            for ids, crc, where, marks, size, joined in _pieces(batches, length):
                n = size - length + 1  # windows of each piece
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                first = np.repeat(np.cumsum(size) - size, n) + inner
                buf = np.frombuffer(joined, np.uint8)
                w1, w2 = (codes(buf, length, seed)[first] for seed in (0, 1))
                at = (np.repeat(where, n) + inner) << 17 | np.repeat(marks, n)
                yield _suffixes(w1, w2, np.repeat(ids, n), np.repeat(crc, n), at, splitters)

        return frugal(open_)

    return maker


def _compare_windows(batches):
    """A sorted bucket of windows: kind 1 are repeats; kind 4 is what stands at either edge, with its count in ``crc``'s
    place for the comparison across boundaries (kind 5: the row itself, if it is alone here)."""
    t = _bucket(batches)
    if t is None:
        return
    lead, context, at = (t.column(k).to_numpy() for k in ("lead", "context", "at"))
    order = multikey_order([lead, context])
    lead, context, at = lead[order], context[order], at[order]
    r = _runs(lead, context)
    size = np.diff(r)
    repeat = np.repeat(size > 1, size) | (at & 1 == 1)
    edges = np.unique([0, len(size) - 1])
    alone = np.array([r[e] for e in edges if not repeat[r[e]]], np.int64)
    pick = np.concatenate([np.flatnonzero(repeat), alone, r[edges]])
    kind = np.concatenate([np.ones(int(repeat.sum()), np.int32), np.full(len(alone), 5, np.int32), np.full(len(edges), 4, np.int32)])
    out = t.take(pa.array(order[pick]))
    yield from pa.table([pa.array(kind), *out.columns], names=["kind", *t.column_names]).to_batches(1 << 16)


def splitters(sample: DataFrame, n: int, per: int = 64) -> Splitters:
    """What parts suffixes like those of ``sample`` evenly into ``n`` ranges; at most ``per * n`` rows come to the
    driver, those with the least hashes."""
    got = sample.orderBy(F.xxhash64("doc_id", "at", "crc"), "lead").limit(per * n).toPandas()
    lead, context, doc_id, at = (got[c].to_numpy(np.int64) for c in ("lead", "context", "doc_id", "at"))
    if len(got) < n:  # too few to tell: codes are even
        even = np.array([(k << 64) // n - (1 << 63) for k in range(1, n)], np.int64)
        return Splitters(even, np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64))
    tie = _tie(doc_id, at)
    order = np.lexsort((tie, context, lead))[np.arange(1, n) * len(got) // n]
    return Splitters(lead[order], context[order], tie[order])


def _ranged(rows: DataFrame, sample: DataFrame, maker, n: int) -> DataFrame:
    """The suffixes that ``maker`` makes of ``rows``, in ``n`` ranges; the splitters come from those of ``sample``."""
    dealt = rows.mapInArrow(maker(splitters(sample.mapInArrow(maker(None), SUFFIXES), n)), SUFFIXES)
    return dealt.repartitionById(n, "part").drop("part")


def _texts(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    # the key of a row: a null doc_id takes the least number, so that arrays of ids have no holes
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__key": key, "__body": body}).withColumn("__crc", F.crc32("__body"))


def repeated_spans(docs: DataFrame, length: int = 200, bucket_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, crc, spans) of every text with a repeat; crc tells rows that repeat a doc_id apart. spans are the first
    and last start of repeated windows as start << 16 | extent, unordered."""
    spark = docs.sparkSession
    t = _texts(docs).select(F.col("__key").alias("doc_id"), F.col("__crc").alias("crc"), F.col("__body").alias("body"))
    total = t.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    t = t.where(F.octet_length("body") >= length)

    def some(df: DataFrame, share: float) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("doc_id", "crc", F.lit(n)), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))

    def bodies(todo: DataFrame) -> DataFrame:
        have = maybe_in(t, key_bits(todo, "doc_id", "crc"), "doc_id", "crc").select(F.col("doc_id").alias("d"), F.col("crc").alias("c"), "body")
        return todo.hint("merge").join(have.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("crc") == F.col("c"))).select("doc_id", "crc", "spans", "body")

    def again_from(found: DataFrame, maker, apart: int) -> DataFrame:
        """What goes on, opened by ``maker``, which makes a suffix of about ``apart`` bytes."""
        marked = F.collect_list(F.col("at").bitwiseOR((F.col("kind") == 3).cast("long")))
        todo = written(found.where("kind > 1").groupBy("doc_id", "crc").agg(marked.alias("spans")), "opened")
        size = todo.agg(F.sum(F.expr(f"aggregate(spans, 0L, (a, x) -> a + (shiftright(x, 1) & 65535) + {length})"))).first()[0] or 0
        return _ranged(bodies(todo), bodies(written(some(todo, 192 * n * apart / max(1, size)), "opened-sample")), maker, n)

    found = written(_ranged(t, some(t, 192 * n * 68 / max(1, total)), _pick(length), n).mapInArrow(frugal(_compare, 0), FOUND), "suffixes")
    again = written(again_from(found, _repick(length), 26).mapInArrow(frugal(_compare, 0), FOUND), "suffixes")
    windows = written(again_from(again, _open(length), 1).mapInArrow(frugal(_compare_windows, 0), FOUND), "windows")
    ends = windows.where("kind = 4").groupBy("lead", "context").agg(F.count("*").alias("n")).where("n > 1")
    across = windows.where("kind = 5").hint("merge").join(ends.hint("merge"), ["lead", "context"], "left_semi")
    whole = found.union(again).union(windows).where("kind = 1").select("doc_id", "crc", "at").union(across.select("doc_id", "crc", "at"))
    return whole.groupBy("doc_id", "crc").agg(F.collect_set(F.shiftright("at", 1)).alias("spans"))


def merged(spans: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Disjoint byte ranges, ascending; those that touch are one."""
    out: list[list[int]] = []
    for s in sorted(set(spans or ())):
        a, z = s >> 16, (s >> 16) + (s & 0xFFFF) + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _cut(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for s in spans for x in s), len(body)]
    return b"".join(body[a:z] for a, z in list(pairwise(ends))[::2])


def _with_spans(docs: DataFrame, length: int, columns: list[str]) -> DataFrame:
    """``columns`` of every row with its body and its spans (null: none); only rows that may have spans are joined."""
    with scratch(docs.sparkSession):
        spans = written(repeated_spans(docs, length), "spans", keep=True)
    bits = key_bits(spans, "doc_id", "crc")
    t = _texts(docs).select(*columns, "__doc", "__key", "__crc", "__body")
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("crc").alias("__c"), F.col("spans").alias("__spans"))
    some = maybe_in(t, bits, "__key", "__crc").hint("merge").join(spans.hint("merge"), (F.col("__key") == F.col("__d")) & (F.col("__crc") == F.col("__c")), "left")
    none = maybe_in(t, bits, "__key", "__crc", negate=True).withColumn("__spans", F.lit(None).cast("array<bigint>"))
    columns = list(dict.fromkeys([*columns, "__doc", "__body", "__spans"]))
    return some.select(*columns).unionAll(none.select(*columns))


def _digest(length: int):
    def digest(batches):
        for b in batches:
            rows = []
            for doc_id, body, spans in zip(*(c.to_pylist() for c in b.columns)):
                ranges = merged(spans, length)
                rest = _cut(body, ranges)
                rows.append((doc_id, len(body), len(body) - len(rest), len(ranges), hashlib.sha256(rest).hexdigest()))
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return digest


def removal_digest(docs: DataFrame, length: int = 200) -> DataFrame:
    """What is removed of every document, and the SHA-256 of the rest. Null text is empty; null or repeated doc_ids
    keep a row each (equal rows are repeats of each other); an empty table gives no rows; extra columns are ignored."""
    return _with_spans(docs, length, []).select("__doc", "__body", "__spans").mapInArrow(frugal(_digest(length)), RESULT)


def _clean(length: int):
    def clean(batches):
        for b in batches:
            *keys, body, spans = b.columns
            text = [_cut(x, merged(s, length)).decode("utf-8", "ignore") if s else x.decode("utf-8", "ignore") for x, s in zip(body.to_pylist(), spans.to_pylist())]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(text, pa.string())], names=[*b.schema.names[:-2], "text"])

    return clean


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the repeated bytes cut out of text, all other columns kept; characters cut in half go. Null text
    becomes empty; null or repeated doc_ids keep a row each; an empty table gives no rows."""
    others = [c for c in docs.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    kept = _with_spans(docs, length, others).select(*others, "__body", "__spans").mapInArrow(frugal(_clean(length)), ", ".join([*fields, "text string"]))
    return kept.select(*docs.columns)
