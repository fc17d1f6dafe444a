"""Bounded-space online packing of tokenized documents into fixed windows.

Each partition keeps a fixed number of open windows, places every piece best-fit, and emits the fullest when none
fits (after filling its gap from the piece at hand, if cutting is allowed). What is still open at a partition's
end is merged with the neighbours' leftovers in rounds of fixed fan-in, so no task ever holds more than
fan-in times the open windows.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import frugal, kept, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"
OPEN = PIECES + ", ids binary, part long"
_NAMES = [x.split()[0] for x in OPEN.split(", ")]
_KINDS = (pa.int64(),) * 8 + (pa.binary(), pa.int64())


#: A word of Latin letters, all of them whole letters in NFC (U+0130 has a lower case of its own), and what ASCII marks are behind it.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_WORD = f"^(?P<stem>[{_LETTERS}]+)(?P<marks>[!-&(-/:-@\\[-`{{-~]*)$"
_STEM = re.compile(f"[{_LETTERS}]+")


class WordTokens:
    """ids of texts by a word-wise tokenizer: its pieces never cross ASCII white space, so each distinct word is
    encoded once and kept. When over ``most`` words are kept, those that fewest batches had go; that bounds memory, not
    results.

    Most words are letters with a few marks behind. The tokenizer normalizes (NFC, lower case) and parts these as the
    code here does, so stem and marks are kept apart and stems go straight to its model; all others take its whole
    pipeline.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only spin
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.bytes = {i: c for i, c in enumerate(_byte_letters())}
        self.direct = True
        self.clear()
        probe = "Zebra, \u00c9t\u00e9. Stra\u00dfe (a) b!?"
        self.direct = self.encode(probe).tolist() == self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.n, self.uses, self.starts, self.ids = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def _shrink(self) -> None:
        """Keeps the words that more than one batch had, half of ``most`` of them at the most."""
        names, uses = list(self.index), self.uses[: self.n]
        kept = np.argsort(-uses, kind="stable")[: min(self.most // 2, int((uses > 1).sum()))]
        a, n = self.starts[kept], self.starts[kept + 1] - self.starts[kept]
        ids = self.ids[_spans(a, n)]
        self.clear()
        self._add([names[i] for i in kept.tolist()], ids, n)

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        m, used = self.n + len(words), int(self.starts[self.n])
        self.index.update(zip(words, range(self.n, m)))
        while m + 1 > len(self.starts):
            self.starts, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.uses))
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(ids)] = ids
        self.starts[self.n + 1 : m + 1] = used + np.cumsum(counts)
        self.n = m

    def _learn(self, words: list[str]) -> None:
        found: list = [None] * len(words)
        if self.direct:
            model, is_stem = self.tokenizer.model, _STEM.fullmatch
            for i, w in enumerate(words):
                if is_stem(w):
                    found[i] = tuple([x.id for x in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes))])
        rest = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            found[i] = tuple(x.ids)
        self._add(words, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(words)))

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words, new ones learned."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in names if w not in self.index]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        self.uses[at] += 1
        return at

    def encode_many(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        if self.n > self.most:
            self._shrink()
        own = pc.ascii_split_whitespace(texts.fill_null(""))
        words = own.flatten().dictionary_encode()
        # each distinct word is a stem and marks, or one part
        parted = pc.extract_regex(words.dictionary, _WORD)
        stems = pc.utf8_lower(pc.struct_field(parted, "stem")) if self.direct else pa.nulls(len(parted), pa.string())
        whole = stems.is_null() if self.direct else pa.array(np.ones(len(parted), bool))
        parts = pa.chunked_array([pc.if_else(whole, words.dictionary, stems), pc.if_else(whole, "", pc.struct_field(parted, "marks"))]).combine_chunks().dictionary_encode()
        at = self._numbers(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1).T.ravel()
        a, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.append(0, np.cumsum(n))
        ids = pa.ListArray.from_arrays(pa.array(ends[::2].astype(np.int32)), pa.array(self.ids[_spans(a, n)])).take(words.indices)
        cuts = ids.offsets.to_numpy()[own.offsets.to_numpy()[1:-1] - own.offsets[0].as_py()]
        return np.split(ids.flatten().to_numpy(), cuts - ids.offsets[0].as_py())

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of ragged rows laid end to end."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _byte_letters() -> list[str]:
    """Byte-level BPE's letter of each byte: printable ones stand for themselves, others for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(i) if i in own else chr(next(others)) for i in range(256)]


@kept
def tokens_of(path: str) -> WordTokens:
    """One per worker process and file, kept between packing's tasks."""
    return WordTokens(path)


class Windows:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens, row)."""

    def __init__(self, size: int, most: int, least_cut: int):
        self.size, self.most, self.least = size, most, least_cut
        self.open: list[tuple[int, list]] = []  # (tokens used, pieces)
        self.full: list[list] = []

    def add(self, piece: tuple) -> None:
        doc_id, start, ids, total, row = piece
        while len(ids) >= self.size:
            self.full.append([(doc_id, start, ids[: self.size], total, row)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            n = len(ids)
            best = max((i for i, (used, _) in enumerate(self.open) if used + n <= self.size), key=lambda i: self.open[i][0], default=None)
            if best is None and len(self.open) < self.most:
                self.open.append((n, [(doc_id, start, ids, total, row)]))
                return
            if best is not None:
                used, pieces = self.open[best]
                pieces.append((doc_id, start, ids, total, row))
                self.open[best] = (used + n, pieces)
                if used + n == self.size:
                    self.full.append(self.open.pop(best)[1])
                return
            # none fits: the fullest goes, topped up from the piece at hand where that leaves no crumbs
            i = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(i)
            gap = self.size - used
            if gap >= self.least and n - gap >= self.least:
                pieces.append((doc_id, start, ids[:gap], total, row))
                start, ids = start + gap, ids[gap:]
            self.full.append(pieces)

    def rest(self, pour: bool) -> list[list]:
        """The windows still open; with ``pour`` they are poured together in order, so that one at most isn't full."""
        if not pour:
            return [p for _, p in sorted(self.open, key=lambda x: -x[0])]
        out, now, used = [], [], 0
        for _, pieces in sorted(self.open, key=lambda x: -x[0]):
            for doc_id, start, ids, total, row in pieces:
                while len(ids):
                    n = min(len(ids), self.size - used)
                    now.append((doc_id, start, ids[:n], total, row))
                    start, ids, used = start + n, ids[n:], used + n
                    if used == self.size:
                        out, now, used = [*out, now], [], 0
        return out + [now] * bool(now)


def _rows(sequences: list[list], first: int | None, part: int) -> list[tuple]:
    rows = []
    for k, pieces in enumerate(sequences):
        offset = 0
        for doc_id, start, ids, total, row in pieces:
            whole = first is not None
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if whole else 0, total, first + k if whole else k, offset, row, None if whole else ids.astype("<u4").tobytes(), part))
            offset += len(ids)
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(_KINDS), _KINDS)], names=_NAMES)


def _emit(windows: Windows, made: int, base: int, part: int):
    rows = _rows(windows.full, base + made, part)
    made += len(windows.full)
    windows.full = []
    return rows, made


def _pack_documents(path: str, end_id: int, size: int, most: int, least_cut: int):
    def pack(batches):
        part = TaskContext.get().partitionId()
        base, made, w, row = part << 36, 0, Windows(size, most, least_cut), part << 36
        words = tokens_of(path)
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(ends >> 20)) + 1).tolist(), b.num_rows]  # some 1 MB of text each
            for i, j in zip(cuts, cuts[1:]):
                some = b.slice(i, j - i)
                for doc_id, ids in zip(some.column(0).to_pylist(), words.encode_many(some.column(1))):
                    ids = np.append(ids, np.uint32(end_id))
                    w.add((doc_id, 0, ids, len(ids), row))
                    row += 1
                if len(w.full) >= 512:
                    rows, made = _emit(w, made, base, part)
                    yield _batch(rows)
        rows, made = _emit(w, made, base, part)
        yield _batch(rows)
        yield _batch(_rows(w.rest(False), None, part))

    return frugal(pack, 0, "tokens_of")


def _merge(round_: int, fan_in: int, size: int, most: int, least_cut: int, last: bool):
    def merge(batches):
        """Rows come sorted by group, part, window and offset; each group of partitions is packed by itself."""
        group, w, made = None, None, 0

        def close():
            nonlocal made
            base = (round_ << 58) + (group << 36)
            rows, made = _emit(w, made, base, group)
            rest = w.rest(last)
            return rows + (_rows(rest, base + made, group) if last else _rows(rest, None, group))

        for b in batches:
            c = [b.column(n).to_pylist() for n in ("doc_id", "start", "ids", "doc_tokens", "row", "part")]
            for doc_id, start, ids, total, row, part in zip(*c):
                if group != part // fan_in:
                    if w:
                        yield _batch(close())
                    group, w, made = part // fan_in, Windows(size, most, least_cut), 0
                w.add((doc_id, start, np.frombuffer(ids, "<u4"), total, row))
        if w:
            yield _batch(close())

    return frugal(merge, keeps="tokens_of")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, open_windows: int = 32, end_id: int = 2, least_cut: int = 32, fan_in: int = 32) -> DataFrame:
    """Packs every document's ids (then ``end_id``) into sequences of at most ``size``; one row per piece.

    Null or empty text is the end id alone. Repeated or null doc_ids are packed as documents of their own (column
    row tells them apart); an empty table gives no rows; extra columns are ignored. A sequence of
    the first merges is short of ``size`` by its gap where a cut would leave a piece under ``least_cut``; the last merge
    pours its windows together, so that of these one at most isn't full.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(1, d.rdd.getNumPartitions())
    done = written(d.mapInArrow(_pack_documents(tokenizer_path, end_id, size, open_windows, least_cut), OPEN), "packed")
    out, open_ = [done.where("ids is null")], done.where("ids is not null")
    round_ = 1
    while True:
        last = parts <= fan_in
        groups = -(-parts // fan_in)
        dealt = open_.repartitionByRange(groups, F.floor(F.col("part") / fan_in)) if groups > 1 else open_.coalesce(1)
        step = written(dealt.sortWithinPartitions("part", "sequence_id", "offset", "row", "start").mapInArrow(_merge(round_, fan_in, size, open_windows, least_cut, last), OPEN), "packed")
        out.append(step.where("ids is null"))
        if last:
            break
        open_, parts, round_ = step.where("ids is not null"), groups, round_ + 1
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")
