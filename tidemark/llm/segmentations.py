"""Sampled segmentations without replacement: Gumbel top-k by perturbed best-first search over the piece lattice.

Every way to cut a text into vocabulary pieces (with byte pieces where no piece fits) has a probability: the product of
its pieces' weights over the lattice's total. Each way gets its log-probability plus Gumbel noise; the k largest are a
sample without replacement. The search never lists them: a set of segmentations (a prefix of the lattice with some next
pieces excluded) is bounded by one Gumbel variable at its total weight, truncated at its parent's; the set with the
highest bound is split along one sampled path, whose own value is the bound. Paths come out in descending order.

Pieces never cross a word's start, so the lattice is a chain of word lattices. Each distinct word's lattice is built
once per worker (in numpy over many words at a time) and shared by all its occurrences; drawing and searching are
vectorised over the words and rows of many texts. A run of spaces belongs to the word behind it, so pieces that are
runs of word marks take part.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import frugal, mix64

SAMPLES = "doc_id long, sample int, n_pieces long, log_p double, perturbed double, threshold double, inclusion double, ids binary"
SPACE = "▁"
_C = np.random.default_rng(9).integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_NONE = np.iinfo(np.int32).min


def _step(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    h = (h ^ points) * _C[0]
    return h ^ (h >> np.uint64(31))


class _Grown:
    """An array that grows at its end by doubling."""

    def __init__(self, first, kind):
        self.room, self.n = np.zeros(1 << 16, kind), len(first)
        self.room[: self.n] = first

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(max(self.n, len(more)), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class Lattice:
    """The vocabulary's pieces with their weights, and the lattices of the words met so far.

    A node is a character position in a word; its arcs are pieces that start there. ``beta`` is the log-total of all
    ways from a node to the word's end, so an arc's probability is exp(weight + beta(next) - beta(node)).
    """

    def __init__(self, path: str, temperature: float = 1.0, most_arcs: int = 2_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and self.pieces[i] and SPACE not in self.pieces[i].lstrip(SPACE)]
        byte = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_ids = np.array([byte.get(i, sp.unk_id()) for i in range(256)], np.int64)
        # a merge vocabulary stores ranks, not probabilities: weights follow Zipf's law over its order
        rank = {i: r for r, i in enumerate(usable)}
        z = np.log(np.arange(2, len(usable) + 2, dtype=float))
        z = -(z + np.log(np.exp(-z).sum())) / temperature
        self.byte_weight = float(z[-1])  # of each byte of a character that no piece covers
        self.ids = {self.pieces[i]: (i, float(z[rank[i]])) for i in usable}
        self.longest = max(map(len, self.ids))
        # a table of the pieces and all that pieces start with, by their hashes, filled by linear probing
        rows = list(dict.fromkeys([*self.ids, *(x[:n] for x in self.ids for n in range(1, len(x)))]))
        self.keys = self._hashes(rows)
        # what is no piece, as is the last entry, has no id
        self.piece_id = np.full(len(rows) + 1, _NONE, np.int32)
        self.piece_weight = np.full(len(rows) + 1, -np.inf)
        self.piece_id[: len(self.ids)], self.piece_weight[: len(self.ids)] = zip(*self.ids.values())
        bits = max(4, (8 * len(rows)).bit_length())
        self.shift, self.slots, self.probes = np.uint64(64 - bits), np.full((1 << bits) + 64, -1, np.int32), 1
        for i, at in enumerate((self.keys >> self.shift).tolist()):
            start = at
            while self.slots[at] >= 0:
                at += 1
            self.slots[at] = i
            self.probes = max(self.probes, at - start + 1)
        self.most = most_arcs  # 22 bytes each; over it the words of fewest batches go, which bounds memory, not results
        self.clear()

    @staticmethod
    def _hashes(texts: list[str]) -> np.ndarray:
        h, sizes = np.zeros(len(texts), np.uint64), np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        start = np.cumsum(sizes) - sizes
        for k in range(int(sizes.max(initial=0))):
            on = sizes > k
            h[on] = _step(h[on], points[start[on] + k])
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The table's row of each hash, or -1."""
        at = (h >> self.shift).astype(np.int64)
        row = self.slots[at]
        open_ = np.flatnonzero((row >= 0) & (self.keys[row] != h))
        for k in range(1, self.probes + 1):
            if not len(open_):
                break
            row[open_] = self.slots[at[open_] + k] if k < self.probes else -1
            open_ = open_[(row[open_] >= 0) & (self.keys[row[open_]] != h[open_])]
        return row

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self._uses = _Grown([], np.int64)  # batches of each word
        self._first = _Grown([], np.int64)  # first node of each word
        self._chars = _Grown([], np.int64)  # its length
        self._arc0 = _Grown([0], np.int64)  # per node: first arc
        self._cum = _Grown([], np.float64)  # per arc: cumulative probability through it; a node's longest arc comes first
        self._arc_id = _Grown([], np.int32)  # piece id, or -1 - code point for a character in bytes
        self._arc_n = _Grown([], np.int16)
        self._arc_w = _Grown([], np.float64)  # log-probability of the arc given its node
        self._arc_only = _Grown([], bool)  # the only one of its node, so it can't be left
        self._show()

    def _show(self) -> None:
        self.first, self.chars, self.arc0, self.cum, self.arc_id, self.arc_n, self.arc_w, self.arc_only = (x.room for x in (self._first, self._chars, self._arc0, self._cum, self._arc_id, self._arc_n, self._arc_w, self._arc_only))

    def shrink(self) -> None:
        """Keeps the words that more than one batch had, with half of ``most`` arcs at the most."""
        names, uses, first, chars = list(self.words), self._uses.room[: self._uses.n], self.first, self.chars
        order = np.argsort(-uses, kind="stable")[: int((uses > 1).sum())]
        n_arcs = self.arc0[first[order] + chars[order]] - self.arc0[first[order]]
        order = order[np.cumsum(n_arcs) <= self.most // 2]
        sizes = chars[order]
        row, inner = _ragged(sizes)
        nodes = first[order][row] + inner
        counts = self.arc0[nodes + 1] - self.arc0[nodes]
        row, inner = _ragged(counts)
        arcs = self.arc0[nodes][row] + inner
        cum, ids, n, only, w = (x[arcs] for x in (self.cum, self.arc_id, self.arc_n, self.arc_only, self.arc_w))
        self.clear()
        self._name([names[i] for i in order.tolist()])
        self._first.add(np.cumsum(sizes) - sizes)
        self._chars.add(sizes)
        self._add_arcs(counts, cum, ids, n, only, w)
        self._show()

    def _name(self, words: list[str]) -> None:
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self._uses.add(np.zeros(len(words), np.int64))

    def _add_arcs(self, counts: np.ndarray, *arcs: np.ndarray) -> None:
        self._arc0.add(self._cum.n + np.cumsum(counts))
        for room, more in zip((self._cum, self._arc_id, self._arc_n, self._arc_only, self._arc_w), arcs):
            room.add(more)

    def learn(self, words: list[str], cells: int = 1 << 20) -> None:
        """Adds the lattices of new words, those of one length side by side: rows are words, columns their positions;
        the arcs of a position are its pieces, long ones first."""
        self._name(words)
        words = [SPACE + w.replace(" ", SPACE) for w in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        text = np.frombuffer("".join([words[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
        first, done, at, nodes, made = np.empty(len(words), np.int64), 0, 0, self._arc0.n - 1, []
        sorted_ = sizes[order]
        while done < len(words):
            size = int(sorted_[done])
            width = min(size, self.longest)
            n = min(int(np.searchsorted(sorted_, size, "right")) - done, max(1, cells // (size * width)))
            first[order[done : done + n]] = nodes + np.arange(n) * size
            made.append(self._learn(text[at : at + n * size].astype(np.uint64).reshape(n, size), width))
            done, at, nodes = done + n, at + n * size, nodes + n * size
        self._first.add(first)
        self._chars.add(sizes)
        self._add_arcs(*(np.concatenate(x) for x in zip(*made)))
        self._show()

    def _learn(self, chars: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """Arcs per node, then the arcs, word by word and node by node."""
        n, size = chars.shape
        chars = np.ascontiguousarray(chars.T).ravel()  # words last: every step below runs along them
        # from each place on as long as some piece starts so
        place, h, found = np.arange(size * n), np.zeros(size * n, np.uint64), []
        for k in range(width):
            h = _step(h, chars[place + k * n])
            row = self._find(h)
            hit = np.flatnonzero(self.piece_id[row] != _NONE)
            found.append((place[hit], np.full(len(hit), k + 1, np.int16), self.piece_id[row[hit]], self.piece_weight[row[hit]]))
            on = np.flatnonzero((row >= 0) & (place < (size - k - 1) * n))
            if not len(on):
                break
            place, h = place[on], h[on]
        bare = np.ones(size * n, bool)
        bare[found[0][0]] = False
        bare = np.flatnonzero(bare)
        points = chars[bare].astype(np.int64)
        found.insert(0, (bare, np.ones(len(bare), np.int16), (-1 - points).astype(np.int32), (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)) * self.byte_weight))
        at, step, ids, weight = (np.concatenate(x) for x in zip(*found[::-1]))
        order = np.argsort(at, kind="stable")
        at, step, ids, weight = at[order], step[order], ids[order], weight[order]
        counts = np.bincount(at, minlength=size * n)
        head = np.append(0, np.cumsum(counts))
        # totals from the words' ends backward
        after = at + step.astype(np.int64) * n
        beta = np.zeros((size + 1) * n)
        for i in range(size - 1, -1, -1):
            a, b = head[i * n], head[(i + 1) * n]
            own, v = at[a:b] - i * n, weight[a:b] + beta[after[a:b]]
            top = np.maximum.reduceat(v, head[i * n : (i + 1) * n] - a)
            beta[i * n : (i + 1) * n] = np.log(np.bincount(own, np.exp(v - top[own]), n)) + top
        log_p = weight + beta[after] - beta[at]
        share, most = np.exp(log_p), int(counts.max(initial=1))
        for r in range(1, most):
            on = head[:-1][counts > r] + r
            share[on] += share[on - 1]
        share = np.minimum(1.0, share / np.repeat(share[head[1:] - 1], counts))
        only = np.repeat(counts == 1, counts)
        # from places to words
        node = np.arange(size * n).reshape(size, n).T.ravel()
        counts = counts[node]
        row, inner = _ragged(counts)
        arc = head[node][row] + inner
        return counts, share[arc], ids[arc], step[arc], only[arc], log_p[arc]

    def draw(self, node: np.ndarray, left: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of a sampled path to the word's end from each node, one path after the other, and their numbers."""
        who, out, total = np.arange(len(node)), [], np.zeros(len(node), np.int64)
        while len(who):
            arc, u = self.arc0[node], uniform(seed, len(out))
            later = np.flatnonzero(u >= self.cum[arc])
            while len(later):
                arc[later] += 1
                later = later[u[later] >= self.cum[arc[later]]]
            out.append((who, arc))
            total[who] += 1
            n = self.arc_n[arc]
            go = np.flatnonzero(n < left)
            n, left = n[go], left[go]
            who, node, left, seed = who[go], node[go] + n, left - n, seed[go]
        at = np.cumsum(total) - total
        whole = np.empty(int(total.sum()), np.int64)
        for step, (w, arc) in enumerate(out):
            whole[at[w] + step] = arc
        return whole, total

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words as ``words_of`` gives them."""
        return self.numbers_raw([w[1:] for w in words])

    def numbers_raw(self, words: list[str] | pa.Array) -> np.ndarray:
        if self._cum.n > self.most:
            self.shrink()
        each = (words if isinstance(words, pa.Array) else pa.array(words, pa.string())).dictionary_encode()
        names = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in names if w not in self.words]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))
        self._uses.room[at] += 1
        return at[each.indices.to_numpy()]

    def piece_ids(self, arcs: np.ndarray) -> np.ndarray:
        return self.piece_ids_of(arcs, np.array([len(arcs)]))[0]

    def piece_ids_of(self, arcs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of paths laid end to end, of ``counts`` arcs each, and how many ids each path has."""
        ids = self.arc_id[arcs].astype(np.int64)
        low = np.flatnonzero(ids < 0)  # characters in bytes
        if not len(low):
            return ids, counts
        points = -1 - ids[low]
        size = np.ones(len(ids), np.int64)
        size[low] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(size) - size
        out = np.repeat(ids, size)
        raw = np.frombuffer("".join(map(chr, points.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        n = size[low]
        out[np.repeat(at[low] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] = self.byte_ids[raw]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        return out, np.diff(ends)


_run = re.compile(" +[^ ]*")


def _raw_words(text: str | None) -> list[str]:
    """The text with a space in front, cut before each run of spaces; the first space of each run is left out."""
    if not text:
        return []
    words = text.split(" ")
    return [w[1:] for w in _run.findall(" " + text)] if "" in words else words


def _raw_words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``_raw_words`` of each text laid end to end, and how many each has."""
    texts = texts.fill_null("")
    split = pc.split_pattern(texts, " ")
    counts = np.diff(split.offsets.to_numpy())
    no_word = pc.equal(pc.binary_length(split.flatten()), 0).to_numpy(zero_copy_only=False)
    odd = np.bincount(np.repeat(np.arange(len(texts)), counts)[no_word], minlength=len(texts)) > 0  # with runs of spaces or empty
    if odd.any():
        runs = pa.array([_raw_words(t) for t in texts.filter(pa.array(odd)).to_pylist()], split.type)
        split = pa.concat_arrays([split.filter(pa.array(~odd)), runs]).take(pa.array(np.argsort(np.argsort(odd, kind="stable"))))
        counts = pc.list_value_length(split).to_numpy()
    return split.flatten(), counts.astype(np.int64)


def words_of(text: str | None) -> list[str]:
    """The normal form cut before each run of word marks."""
    return [SPACE + w.replace(" ", SPACE) for w in _raw_words(text)]


def uniform(seed: np.ndarray, stream) -> np.ndarray:
    """Numbers in (0, 1), one of each seed and stream: a row's draws don't depend on what else is in its batch."""
    return ((mix64(seed + np.asarray(stream).astype(np.uint64) * _C[1]) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(at: np.ndarray, u: np.ndarray) -> np.ndarray:
    return at - np.log(-np.log(u))


def _below(value: np.ndarray, top) -> np.ndarray:
    """A Gumbel value truncated at ``top``: -log(exp(-top) + exp(-value)), without overflow."""
    return -np.logaddexp(-top, -value)


def _bounds(lattice: Lattice, arcs: np.ndarray, prefix: np.ndarray, top: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Bounds of the sets that leave a path at each of its arcs; an arc that is its node's only one can't be left."""
    with np.errstate(divide="ignore"):
        rest = np.log(-np.expm1(np.minimum(lattice.arc_w[arcs], 0.0)))
    return np.where(lattice.arc_only[arcs], -np.inf, _below(_gumbel(prefix + rest, uniform(seed, 200)), top))


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in its row) of ragged rows laid end to end."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class _Paths:
    """One sampled path of some rows: arcs, bounds and log-probabilities before each arc, laid end to end."""

    def __init__(self, lattice: Lattice, n_rows: int, rows, counts, arcs, bounds, before, log_p, value):
        self.rows, self.counts, self.arcs, self.bounds, self.before, self.log_p, self.value = rows, counts, arcs, bounds, before, log_p, value
        self.off = np.full(n_rows, -1)
        self.off[rows] = np.cumsum(counts) - counts
        n = lattice.arc_n[arcs].astype(np.int64)
        self.chars = np.cumsum(n) - n  # before each arc, counted from the first row's start
        self.n_rows = n_rows
        self.rate()

    def rate(self) -> None:
        """The highest bound of each row, and where it is."""
        self.best, self.at = np.full(self.n_rows, -np.inf), np.zeros(self.n_rows, np.int64)
        some = self.counts > 0
        if not some.any():
            return
        rows, starts, counts = self.rows[some], self.off[self.rows[some]], self.counts[some]
        top = np.maximum.reduceat(self.bounds, starts)
        hit = np.flatnonzero(self.bounds == np.repeat(top, counts))
        owner = np.repeat(np.arange(len(rows)), counts)[hit]
        first = np.unique(owner, return_index=True)[1]
        self.best[rows], self.at[rows] = top, hit[first]


def search(lattice: Lattice, numbers: np.ndarray, n_words: np.ndarray, seeds: np.ndarray, k: int) -> tuple[list[_Paths], np.ndarray]:
    """Up to k distinct paths of each row of word numbers, as one _Paths for each rank, and each row's next value
    (-inf if there is none): the threshold of inclusion. All rows are searched side by side."""
    n = len(n_words)
    first, chars = lattice.first[numbers], lattice.chars[numbers]
    word_end = np.cumsum(n_words)
    char_end = np.cumsum(chars)
    row_char = np.append(0, char_end)[word_end - n_words]
    base = mix64(seeds.astype(np.uint64))
    following = _gumbel(np.zeros(n), uniform(base, 201))
    found: list[_Paths] = []
    left_out: dict[tuple[int, int, int], set[int]] = {}  # (row, path, place): the arcs that its set excludes
    for j in range(k):
        if not j:
            rows, value, head = np.arange(n), following, np.zeros(n)
            part = np.zeros(n, bool)
            start = length = np.zeros(n, np.int64)
            word = word_end - n_words - 1
        else:
            rows = np.flatnonzero(following > -np.inf)
            if not len(rows):
                break
            value, r = following[rows], np.arange(len(rows))
            which = np.stack([p.best for p in found])[:, rows].argmax(0)
            shift = np.append(0, np.cumsum([len(p.arcs) for p in found]))
            arcs, before, done = (np.concatenate([getattr(p, c) for p in found]) for c in ("arcs", "before", "chars"))
            off = np.stack([p.off for p in found])[which, rows] + shift[which]
            at = np.stack([p.at for p in found])[which, rows] + shift[which]
            old, at_p = arcs[at], before[at]
            node = _node(lattice, old)
            a0, width = lattice.arc0[node], lattice.arc0[node + 1] - lattice.arc0[node]
            cell = np.minimum(a0[:, None] + np.arange(int(width.max())), len(lattice.arc_w) - 1)
            free = (np.arange(cell.shape[1]) < width[:, None]) & (cell != old[:, None])
            if j > 1:
                for i, key in enumerate(zip(rows.tolist(), which.tolist(), (at - off).tolist())):
                    if key in left_out:
                        free[i] &= ~np.isin(cell[i], list(left_out[key]))
            p = np.where(free, np.exp(lattice.arc_w[cell]), 0.0)
            cum = np.cumsum(p, 1)
            total = cum[:, -1]
            u = uniform(base[rows], 1000 + 2 * j)
            hit = free & (cum >= (u * total)[:, None])
            pick = np.where(hit.any(1), hit.argmax(1), cell.shape[1] - 1 - free[:, ::-1].argmax(1))
            arc = cell[r, pick]
            if j + 1 < k:
                for key, x, y in zip(zip(rows.tolist(), which.tolist(), (at - off).tolist()), old.tolist(), arc.tolist()):
                    left_out.setdefault(key, {x}).add(y)
            # the same node again, with this arc excluded too
            rest = total - p[r, pick]
            with np.errstate(divide="ignore", invalid="ignore"):
                again = _below(_gumbel(at_p + np.log(rest), uniform(base[rows], 1001 + 2 * j)), value)
            again = np.where((free.sum(1) > 1) & (rest > 0), again, -np.inf)
            for q in np.unique(which).tolist():
                own = which == q
                found[q].bounds[at[own] - shift[q]] = again[own]
                found[q].rate()
            # the rest of the word, then the following words
            step = lattice.arc_n[arc].astype(np.int64)
            place = row_char[rows] + done[at] - np.where(off < at, done[off], done[at])
            word = np.searchsorted(char_end, place, "right")
            start, length = node + step, char_end[word] - place - step
            part, head = length > 0, at_p + lattice.arc_w[arc]
        m = part + word_end[rows] - word - 1
        row, inner = _ragged(m)
        here = part[row] & (inner == 0)
        number = np.where(here, 0, word[row] + 1 + inner - part[row])
        nodes, lefts = (np.where(here, x[row], y[number]) if len(y) else x[row] for x, y in ((start, first), (length, chars)))
        seed = mix64(base[rows][row] + (inner * 64 + j).astype(np.uint64) * _C[2])
        drawn, counts = lattice.draw(nodes, lefts, seed)
        own = np.diff(np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(m))])
        sums, stops = np.cumsum(lattice.arc_w[drawn]), np.cumsum(own)
        phi = sums + np.repeat(head - np.append(0.0, sums)[stops - own], own)
        after = phi - lattice.arc_w[drawn]
        row, inner = _ragged(own)
        bounds = _bounds(lattice, drawn, after, value[row], mix64(base[rows][row] + (inner * 64 + j).astype(np.uint64) * _C[0]))
        log_p = head.copy()
        log_p[own > 0] = phi[stops[own > 0] - 1]
        if j:
            # before what was drawn stand the arcs that are kept and the one that leaves the old path
            kept = at - off
            size = kept + 1 + own
            where = np.cumsum(size) - size
            all_arcs, all_bounds, all_before = np.empty(int(size.sum()), np.int64), np.full(int(size.sum()), -np.inf), np.empty(int(size.sum()))
            k_row, k_inner = _ragged(kept)
            all_arcs[where[k_row] + k_inner], all_before[where[k_row] + k_inner] = arcs[off[k_row] + k_inner], before[off[k_row] + k_inner]
            all_arcs[where + kept], all_before[where + kept] = arc, at_p
            to = where[row] + kept[row] + 1 + inner
            all_arcs[to], all_bounds[to], all_before[to] = drawn, bounds, after
            drawn, bounds, after, own = all_arcs, all_bounds, all_before, size
        found.append(_Paths(lattice, n, rows, own, drawn, bounds, after, log_p, value))
        following = np.stack([p.best for p in found]).max(0)
    return found, following


def top_k(lattice: Lattice, rows: list[np.ndarray], seeds: list[int], k: int) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """``search`` row by row: up to k paths as (arcs, log-probability, perturbed value), and the threshold."""
    found, threshold = search(lattice, np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(x) for x in rows], np.int64), np.array(seeds, np.uint64), k)
    out = [([], float(t)) for t in threshold]
    for p in found:
        for r, arcs, log_p, value in zip(p.rows.tolist(), np.split(p.arcs, np.cumsum(p.counts)[:-1]), p.log_p.tolist(), p.value.tolist()):
            out[r][0].append((arcs, log_p, value))
    return out


def _node(lattice: Lattice, arcs: np.ndarray) -> np.ndarray:
    return np.searchsorted(lattice.arc0[: lattice._arc0.n], arcs, "right") - 1


@cache
def lattice_of(path: str, temperature: float) -> Lattice:
    """One per worker process, kept between tasks."""
    return Lattice(path, temperature)


def _sampler(path: str, k: int, temperature: float, seed: int):
    def sample(batches):
        lattice = lattice_of(path, temperature)
        names = [x.split()[0] for x in SAMPLES.split(", ")]
        for b in batches:
            doc_id = b.column(0)
            words, n_words = _raw_words_of(b.column(1))
            flat = lattice.numbers_raw(words)
            seeds = np.array([zlib.crc32(str(i).encode()) << 32 | seed for i in doc_id.to_pylist()], np.uint64)
            found, threshold = search(lattice, flat, n_words, seeds, k)
            for j, p in enumerate(found):
                ids, counts = lattice.piece_ids_of(p.arcs, p.counts)
                t = threshold[p.rows]
                with np.errstate(over="ignore"):
                    inclusion = np.where(t == -np.inf, 1.0, -np.expm1(-np.exp(np.minimum(700.0, p.log_p - t))))
                offsets = np.append(0, 4 * np.cumsum(counts)).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                rank = np.full(len(counts), j, np.int32)
                yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(p.rows)), *map(pa.array, (rank, counts, p.log_p, p.value, t, inclusion)), raw], names=names)

    return frugal(sample, 128)


def sample_segmentations(docs: DataFrame, path: str, k: int = 2, temperature: float = 1.0, seed: int = 7) -> DataFrame:
    """SAMPLES: up to k distinct segmentations per document, drawn without replacement and seeded by doc_id; ids are
    little-endian unsigned 32-bit. A text with fewer ways gives fewer rows with inclusion 1. Null or empty text has the
    one empty segmentation; rows that repeat a doc_id with one text repeat its samples; an empty table gives no rows;
    other columns are ignored. (k + 1)-th value: column threshold; inclusion: the chance to exceed it.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_sampler(path, k, temperature, seed), SAMPLES)


class Decoder:
    """ids back to text, exactly: pieces joined, byte pieces decoded, word marks to spaces, the first one dropped."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw = pa.array([bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(sp.id_to_piece(list(range(sp.get_piece_size()))))], pa.binary())

    def decode_many(self, ids: list[bytes | None]) -> pa.Array:
        ends = np.append(0, np.cumsum([len(x or b"") // 4 for x in ids]))
        pieces = self.raw.take(pa.array(np.frombuffer(b"".join([x or b"" for x in ids]), "<u4")))
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[ends] if len(pieces) else np.zeros(len(ids) + 1, np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pieces.buffers()[2]])
        text = pc.replace_substring(raw.cast(pa.string()), SPACE, " ")  # word marks in byte pieces
        return pc.if_else(pa.array([x is not None for x in ids], pa.bool_()), pc.utf8_slice_codeunits(text, 1), None)


@cache
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def _decoder(path: str):
    def decode(batches):
        d = decoder_of(path)
        for b in batches:
            keep = [n for n in b.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], d.decode_many(b.column("ids").to_pylist())], names=[*keep, "text"])

    return frugal(decode)


def decode(samples: DataFrame, path: str) -> DataFrame:
    """``samples`` with the decoded text of each row in place of its ids; null ids decode to null, no ids to the empty
    text, an empty table to no rows; all other columns stay, but for a column named text, which the result replaces.
    Word marks in the input decode to spaces."""
    kept = samples.drop("text").select(*[c for c in samples.columns if c not in ("ids", "text")], "ids")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "ids"]
    return kept.mapInArrow(_decoder(path), ", ".join([*fields, "text string"]))
