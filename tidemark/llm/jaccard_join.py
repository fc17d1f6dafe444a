"""Near duplicates by exact Jaccard similarity of word shingles: a token-group matrix over prefix tokens.

Documents with equal shingle sets are one class, joined through its smallest doc_id. Tokens (shingle codes) have one
global order, rare ones first; of a set of n tokens only the first n - ceil(t * n) + HITS are kept, and two sets that
reach the threshold t share at least HITS of these (or all they share, if less).

1. Groups: every document votes for the most connected document among those that share its tokens; documents with one
   winner are a group. A group needn't be linked throughout; each member is compared with its leader exactly.
2. The matrix has a row for each token and group that holds it (the group's token union). A join on tokens counts how
   many of a query's tokens each other, larger group's union holds: an upper bound of what it shares with any member.
3. Only groups that reach the bound (and a fitting size) are opened: their members, in blocks of bounded size, against
   the query; a block that very many ask is repeated for each part of its askers. Members that don't reach their leader query their own group. Links become components.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import components, frugal, key_bits, maybe_in, mix64, scratch, shuffles_removed, spread_join, written

HITS = 3
BLOCK = 512
ASKERS = 2048
_rng = np.random.default_rng(10)
_byte = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_place = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 2**64))
CHUNK = 1 << 20
_blank = re.compile(rb"[\x20\x09-\x0D]")


@cache
def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _R and of its inverse below n."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, r, np.uint64))]) for r in (_R, _R_INVERSE))


def _word_codes(raw: bytes) -> np.ndarray:
    """A 64-bit code of each word of a text of at most about CHUNK bytes (more only for one long word)."""
    a = np.frombuffer(raw, np.uint8)
    space = np.ones(len(a) + 2, np.int8)
    space[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
    turn = np.diff(space)
    starts, ends = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    up, down = _power(CHUNK + 1) if len(a) <= CHUNK else _power.__wrapped__(len(a) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte[a] * up[: len(a)])])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _cut(raw: bytes):
    """The text in chunks that end at white space."""
    at = 0
    while len(raw) - at > CHUNK:
        gap = _blank.search(raw, at + CHUNK // 2)
        if gap is None:
            break
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:] if at else raw


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit codes of a text's ``width``-word shingles; a shorter text is one shingle as a whole."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() is A-Z only
    words = np.concatenate([_word_codes(x) for x in _cut(raw)]) if len(raw) > CHUNK else _word_codes(raw)
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return mix64(np.array([(words * _place[40 : 40 + len(words)]).sum() + np.uint64(len(words))], np.uint64))
    n = len(words) - width + 1
    return np.unique(mix64(sum(words[k : k + n] * _place[k] for k in range(width))))


def needed(n, percent: int = 75):
    """The least overlap of a set of n with any set that reaches the threshold."""
    return -(-percent * n // 100)


def linked(overlap, n, m, percent: int = 75):
    return 100 * overlap >= percent * (n + m - overlap)


def _sign(width: int):
    def sign(batches):
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                s = shingles(text, width)
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                rows.append((len(s), int(d[0]), int(d[1])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)]], names=["doc_id", "n", "d1", "d2"])

    return frugal(sign)


def _low_tokens(width: int, share: float):
    """Counts, within each batch, of the tokens in the lowest ``share`` of the code range: prefixes hold few others."""

    def tokens(batches):
        limit = np.uint64(int(share * 2**64))
        for b in batches:
            got = [s[: np.searchsorted(s, limit)] for s in (shingles(t, width) for t in b.column("text").to_pylist())]
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *got]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return frugal(tokens, 1024)


def _prefixes(width: int, percent: int, frequent: np.ndarray, rank: np.ndarray, rows_per_task: int):
    """Prefix tokens of each document. A token that very many documents hold is dealt over several keys (salt)."""
    salts = np.append(np.minimum(-(-2 * rank // rows_per_task), 1 << 20), 1)

    def prefix(batches):
        for b in batches:
            tokens, ids, sizes, salted = [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                s = shingles(text, width)
                n = len(s)
                if not n:
                    continue
                keep = min(n, n - needed(n, percent) + HITS)
                salt = np.zeros(keep, np.int32)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    at[frequent[at] != s] = -1
                    order = np.argsort(np.where(at >= 0, rank[at], 0), kind="stable")[:keep]
                    s, own = s[order], salts[at[order]]
                    salt = (doc_id % own + (own > 1)).astype(np.int32)  # 0: not salted
                tokens.append(s[:keep])
                salted.append(salt)
                ids.append(np.full(keep, doc_id, np.int64))
                sizes.append(np.full(keep, n, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(salted))], names=["token", "doc_id", "n", "salt"])

    return frugal(prefix)


def _shared(batches):
    """Of a partition dealt by token and salt: the rows whose token another document has too, with how many have it (of
    a salted token: within its salt)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    token, salt = t.column("token").to_numpy(), t.column("salt").to_numpy()
    order = np.lexsort((salt, token))
    s, x = token[order], salt[order]
    starts = np.append(np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (x[1:] != x[:-1]))), len(s))
    size = np.diff(starts)
    many = np.repeat(size, size)
    pick = (many > 1) | (x > 0)
    out = t.take(pa.array(order[pick])).append_column("df", pa.array(many[pick]))
    yield from out.to_batches(1 << 16)


def _with_leader(width: int, percent: int):
    def compare(batches):
        """Rows of (leader, block) come with the leader's text first."""
        at, lead = None, None
        for b in batches:
            out = []
            for leader, block, kind, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("leader", "block", "kind", "doc_id", "text"))):
                s = shingles(text, width)
                if (leader, block) != at:
                    at, lead = (leader, block), []
                if kind == 0:
                    lead.append(s)
                else:
                    out.append((doc_id, leader, any(linked(len(np.intersect1d(s, x, True)), len(s), len(x), percent) for x in lead)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", "leader", "linked"])

    return frugal(compare)


def _opened(width: int, percent: int):
    def open_(batches):
        """Rows of (leader, block): its members first (kind 0), then the queries. Emits links that join what isn't
        joined yet inside the block; members linked with the leader are joined from the start."""
        at, ids, sets, root, ready = None, [], [], {}, None

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            out = []
            for leader, block, kind, doc_id, joined, text in zip(*(b.column(c).to_pylist() for c in ("leader", "block", "kind", "doc_id", "linked", "text"))):
                if (leader, block) != at:
                    at, ids, sets, root, ready = (leader, block), [], [], {}, None
                s = shingles(text, width)
                if kind == 0:
                    ids.append(doc_id)
                    sets.append(s)
                    if joined:
                        root[find(doc_id)] = find(leader)
                    continue
                if ready is None:
                    sizes = np.array([len(x) for x in sets], np.int64)
                    flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(flat, kind="stable")
                    flat, owner = flat[order], owner[order]
                    ready = True
                if joined:
                    root[find(doc_id)] = find(leader)
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = hi - lo
                if not n.any():
                    continue
                where = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
                overlap = np.bincount(owner[where], minlength=len(ids))
                for k in np.flatnonzero(linked(overlap, len(s), sizes, percent) & (overlap > 0)):
                    if ids[k] != doc_id and find(ids[k]) != find(doc_id):
                        root[find(ids[k])] = find(doc_id)
                        out.append((doc_id, ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 2)], names=["a", "b"])

    return frugal(open_)


def _links(docs: DataFrame, width: int, percent: int, frequent_tokens: int, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Every row's set size, and links (a, b) that join what belongs together."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signs = written(d.mapInArrow(_sign(width), "doc_id long, n long, d1 long, d2 long"), "jaccard-signs", keep=True)
    known = signs.where("doc_id is not null")
    classes = written(known.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("head"), F.max("n").alias("n"), F.count("*").alias("copies")), "jaccard-classes")
    total, n_rows = (x or 0 for x in classes.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100) + {HITS}")), F.sum("copies")).first())
    copied = spread_join(known.where("n > 0"), classes.where("copies > 1").select("d1", "d2", "head", F.col("copies").alias("weight")), ["d1", "d2"], n_rows).select("doc_id", "head")
    edges = [copied.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))]

    # the heads' texts: whole classes of one need no join, others only where the bitmap can't tell
    spare = key_bits(written(edges[0].select(F.col("a").alias("doc_id")), "jaccard-copies"), "doc_id")
    present = d.where("doc_id is not null and text is not null")
    heads = classes.select(F.col("head").alias("h")).distinct()
    unsure = maybe_in(present, spare, "doc_id").hint("merge").join(heads.hint("merge"), F.col("doc_id") == F.col("h"), "left_semi")
    rep = maybe_in(present, spare, "doc_id", negate=True).union(unsure)

    counts = present.mapInArrow(_low_tokens(width, 0.3), "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))
    common = counts.where("count >= 4").orderBy(F.desc("count"), "token").limit(frequent_tokens).toPandas()
    frequent, rank = common["token"].to_numpy(np.int64).view(np.uint64), common["count"].to_numpy(np.int64)
    order = np.argsort(frequent)
    rows = rep.mapInArrow(_prefixes(width, percent, frequent[order], rank[order], rows_per_task), "token long, doc_id long, n int, salt int")
    lists = written(rows.repartition(max(parts, -(-int(total) // rows_per_task)), "token", "salt").mapInArrow(frugal(_shared, 0), "token long, doc_id long, n int, salt int, df long").drop("salt"), "jaccard-lists")

    # groups: the most connected document among those that share a document's most common prefix tokens; in a large
    # cluster of near copies these are the same for all, so it becomes one group
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("df"), "token"))), 1, 12)  # bounded by a document's length
    votes = lists.groupBy("doc_id").agg(F.sum("df").alias("pull"), first.alias("tokens"))
    votes = written(votes.select("doc_id", "pull", F.explode("tokens.token").alias("token")), "jaccard-votes")
    winners = written(votes.groupBy("token").agg(F.max(F.struct("pull", (-F.col("doc_id")).alias("minus"))).alias("w"), F.count("*").alias("weight")).select("token", (-F.col("w.minus")).alias("leader"), "weight"), "jaccard-winners")
    n_votes = votes.count()
    ballots = spread_join(votes, winners, "token", n_votes).groupBy("doc_id", "leader").count()
    chosen = written(ballots.groupBy("doc_id").agg(F.max(F.struct("count", (-F.col("leader")).alias("minus"))).alias("w")).select("doc_id", (-F.col("w.minus")).alias("leader")), "jaccard-chosen")
    # once more, for the largest group that any token's voters have chosen: fragments of a cluster join its main group
    n_docs = chosen.count()
    sizes = written(chosen.groupBy("leader").agg(F.count("*").alias("weight")).withColumn("size", F.col("weight")), "jaccard-sizes")
    sized = spread_join(chosen, sizes, "leader", n_docs)
    best = votes.hint("merge").join(sized.hint("merge"), "doc_id").groupBy("token").agg(F.max(F.struct("size", (-F.col("leader")).alias("minus"))).alias("w"), F.count("*").alias("weight")).select("token", (-F.col("w.minus")).alias("leader"), "w.size", "weight")
    ballots = spread_join(votes, written(best, "jaccard-winners"), "token", n_votes).groupBy("doc_id", "leader", "size").count()
    chosen = ballots.groupBy("doc_id").agg(F.max(F.struct("count", "size", (-F.col("leader")).alias("minus"))).alias("w")).select("doc_id", (-F.col("w.minus")).alias("leader"))
    # a leader leads its own group
    chosen = written(chosen, "jaccard-chosen")
    lead = chosen.select(F.col("leader").alias("doc_id")).distinct().withColumn("own", F.lit(True))
    groups = written(chosen.hint("merge").join(lead.hint("merge"), "doc_id", "left").select("doc_id", F.when(F.col("own"), F.col("doc_id")).otherwise(F.col("leader")).alias("leader")), "jaccard-led")
    sizes = groups.groupBy("leader").agg(F.count("*").alias("weight")).withColumn("size", F.col("weight")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    sizes = written(sizes, "jaccard-sizes")
    groups = written(spread_join(groups, sizes, "leader", n_docs).select("doc_id", "leader", "size", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block")), "jaccard-groups")

    def texts(ids: DataFrame) -> DataFrame:
        ids = written(ids, "jaccard-open")
        have = maybe_in(rep, key_bits(ids, "doc_id"), "doc_id").select(F.col("doc_id").alias("t_id"), "text")
        return ids.hint("merge").join(have.hint("merge"), F.col("doc_id") == F.col("t_id")).drop("t_id")

    many = groups.where("doc_id <> leader")
    first = many.select("leader", "block").distinct().select("leader", "block", F.lit(0).alias("kind"), F.col("leader").alias("doc_id"))
    both = texts(many.select("leader", "block", F.lit(1).alias("kind"), "doc_id").union(first))
    star = written(both.repartition(parts, "leader", "block").sortWithinPartitions("leader", "block", "kind").mapInArrow(_with_leader(width, percent), "doc_id long, leader long, linked boolean"), "jaccard-star")
    star = star.groupBy("doc_id", "leader").agg(F.max("linked").alias("linked"))
    edges.append(star.where("linked").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))

    # the token-group matrix, for tokens that stand in more than one group; of two groups the smaller one's members ask
    # the larger one, so a large cluster doesn't ask every small group around it
    rows = written(lists.hint("merge").join(groups.select("doc_id", "leader", "size").hint("merge"), "doc_id"), "jaccard-rows")
    matrix = rows.groupBy("token", "leader").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("size").alias("g_size"), F.count("*").alias("members"))
    several = matrix.where("members > 1").select("token", F.col("leader").alias("m_leader"))
    wide = matrix.groupBy("token").count().where("count > 1").select("token")
    matrix = written(matrix.hint("merge").join(wide.hint("merge"), "token", "left_semi").select(F.col("token").alias("g_token"), F.col("leader").alias("g_leader"), "g_size", "least", "most"), "jaccard-matrix")
    hit = rows.hint("merge").join(matrix.hint("merge"), (F.col("token") == F.col("g_token")) & ((F.col("size") < F.col("g_size")) | ((F.col("size") == F.col("g_size")) & (F.col("leader") > F.col("g_leader")))) & (F.col("least") * percent <= F.col("n") * 100) & (F.col("most") * 100 >= F.col("n") * percent))
    bound = hit.groupBy("doc_id", "n", "g_leader").agg(F.count_distinct("token").alias("hits")).where(f"hits >= least({HITS}, ceil({percent} * n / 100))")
    # a member that isn't linked with its leader asks its own group, if other members hold enough of its tokens
    alone = star.where("not linked").select("doc_id", F.col("leader").alias("s_leader"))
    own = rows.hint("merge").join(alone.hint("merge"), "doc_id", "left_semi").hint("merge").join(several.select(F.col("token").alias("m_token"), "m_leader").hint("merge"), (F.col("token") == F.col("m_token")) & (F.col("leader") == F.col("m_leader")), "left_semi")
    alone = own.groupBy("doc_id", "n", "leader").agg(F.count_distinct("token").alias("hits")).where(f"hits >= least({HITS}, ceil({percent} * n / 100))").select("doc_id", F.col("leader").alias("g_leader"))
    asked = written(bound.select("doc_id", "g_leader").union(alone).distinct(), "jaccard-asked")
    flags = star.select(F.col("doc_id").alias("s_id"), "linked")
    wanted = asked.groupBy(F.col("g_leader").alias("leader")).agg(F.count("*").alias("askers")).hint("merge").join(sizes.hint("merge"), "leader")
    chunks = F.ceil(F.col("askers") / ASKERS).cast("int").alias("chunks")
    wanted = written(wanted.select("leader", "askers", "weight", F.col("blocks").alias("g_blocks"), chunks), "jaccard-wanted")
    members = spread_join(groups, wanted.select("leader", "weight", "chunks"), "leader", n_docs).hint("merge").join(flags.hint("merge"), F.col("doc_id") == F.col("s_id"), "left")
    members = members.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    members = members.select("leader", F.expr("block * chunks + chunk").alias("block"), F.lit(0).alias("kind"), "doc_id", F.coalesce("linked", F.col("doc_id") == F.col("leader")).alias("linked"))
    queries = spread_join(asked.withColumnRenamed("g_leader", "leader"), wanted.select("leader", F.col("askers").alias("weight"), "g_blocks", "chunks"), "leader", asked.count())
    queries = queries.withColumn("block", F.explode(F.expr("sequence(0, g_blocks - 1)")))
    queries = queries.select("leader", F.expr("block * chunks + CAST(pmod(xxhash64(doc_id), chunks) AS INT)").alias("block"), F.lit(1).alias("kind"), "doc_id", F.lit(False).alias("linked"))
    opened = texts(members.union(queries)).repartition(parts, "leader", "block").sortWithinPartitions("leader", "block", "kind", "doc_id").mapInArrow(_opened(width, percent), "a long, b long")
    edges.append(opened)

    return signs, written(edges[0].union(edges[1]).union(edges[2]), "jaccard-links", keep=True)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, frequent_tokens: int = 300_000, rows_per_task: int = 500_000, **_) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

    Null, empty and blank texts have no shingles and link with nothing. Rows that repeat a doc_id are one document,
    linked by what either row links with. A null doc_id links with nothing and has a null component. An empty table
    gives no rows; other columns are ignored. The order of tokens comes from counts over all documents, of which the
    ``frequent_tokens`` most common tokens are sent to the tasks (4.8 MB); it decides the work, never the links. Tokens
    are counted in the lowest 30 % of the code range, as prefixes hold few others.
    """
    with shuffles_removed(docs.sparkSession):
        with scratch(docs.sparkSession):
            signs, links = _links(docs, width, percent, frequent_tokens, rows_per_task)
        parts_of = components(links)
    out = signs.select("doc_id", F.col("n").alias("n_shingles")).hint("merge").join(parts_of.hint("merge"), F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id. Documents without shingles and null ids
    stay; of rows that repeat a kept doc_id with other texts all stay, equal rows once. Only rows whose id may be among
    the dropped are joined, so the texts that stay aren't shuffled."""
    found = near_duplicates(docs, **options)
    drop = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__jaccard_drop")).distinct(), "jaccard-drop")
    bits = key_bits(drop, "__jaccard_drop")
    maybe = docs.withColumn("__jaccard_id", F.col("doc_id").cast("long"))
    unsure = maybe_in(maybe, bits, "__jaccard_id").hint("merge").join(drop.hint("merge"), F.col("__jaccard_id") == F.col("__jaccard_drop"), "left_anti")
    # rows that repeat an id: the window of a doc_id is its own rows
    again = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__jaccard_again")), "jaccard-again")
    kept = maybe_in(maybe, bits, "__jaccard_id", negate=True).unionAll(unsure)
    again_bits = key_bits(again, "__jaccard_again")
    twice = maybe_in(kept, again_bits, "__jaccard_id").dropDuplicates(["__jaccard_id", "text"])
    return maybe_in(kept, again_bits, "__jaccard_id", negate=True).unionAll(twice).drop("__jaccard_id")
