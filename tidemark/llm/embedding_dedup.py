"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards.

1. Vectors of a label are dealt to their nearest cluster centre (shards still too large are salted) and, for the graph,
   also to the second nearest. Each shard builds a robust-pruned neighbour graph of both kinds of members; the adjacency
   lists of a vector's shards are united.
2. A shard has a centre and a radius (its largest angle to it), so the triangle inequality of angles sorts the pairs of
   shards: too far for any link (dropped), so near that all their vectors link (counted, never compared), and mixed.
   Every two vectors of a label meet in exactly one pair of shards, so no link is lost to the dealing and none is
   counted twice.
3. For each mixed pair one shard's vectors search the other's part of the united graph: greedily from its medoid, then
   expanding over all neighbours in range. What is found is verified in double precision.
4. Each pair audits its recall: a sample of its queries is compared with all vectors of the other shard. Under the target
   it searches again with a denser graph and a wider beam, at last it compares all in blocks; a pair of which over a
   tenth links is compared in blocks at once, as listing its links would cost more. The audits of all pairs are added
   up: they compare sampled vectors with all of their label that may link, so the figure is the recall of the whole.

Link counts add up without listing pairs; for the components each pair of shards emits a spanning forest only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import components, scratch, spread_join, written

PROFILE = "piece long, label long, centre array<double>, radius double, copies long, low long"
FOUND = "kind string, node long, other long, links long"
ADJACENCY = "node long, neighbours array<long>"
#: Angles are right to about 1e-7 (arccos near 1); bounds are loosened by this much, so rounding drops no pair.
SLACK = 1e-6


def unit(x) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    a = np.array(list(x), np.float64)
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the same for the same sample."""
    seeds, far = [0], sample @ sample[0]
    for _ in range(min(k, len(sample)) - 1):
        seeds.append(int(far.argmin()))
        far = np.maximum(far, sample @ sample[seeds[-1]])
    c = sample[seeds]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                m = sample[near == j].sum(0)
                c[j] = m / max(1e-12, np.linalg.norm(m))
    return c


def robust_prune(x: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (nearest first) those no kept one is ``alpha`` times nearer to; at most ``degree``; -1 pads."""
    m, k = near.shape
    alive, kept, n = np.ones((m, k), bool), np.full((m, degree), -1, np.int64), np.zeros(m, np.int64)
    d = np.sqrt(np.maximum(0, 2 - 2 * sims))
    for j in range(k):
        take = np.flatnonzero(alive[:, j] & (n < degree))
        kept[take, n[take]] = near[take, j]
        n[take] += 1
        if j + 1 < k and len(take):
            other = near[take, j + 1 :]
            dist = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ad,abd->ab", x[near[take, j]], x[other])))
            alive[take, j + 1 :] &= alpha * dist > d[take, j + 1 :]
    return kept


def build(x: np.ndarray, degree: int = 24, alpha: float = 1.2, block: int = 512) -> np.ndarray:
    """The robust-pruned graph of a shard: (rows, degree) of row numbers, -1 where there are fewer."""
    m = len(x)
    k = min(m - 1, 2 * degree)
    if k < 1:
        return np.full((m, degree), -1, np.int64)
    out = []
    for a in range(0, m, block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = np.argpartition(-s, k - 1, 1)[:, :k]
        v = np.take_along_axis(s, near, 1)
        o = np.argsort(-v, 1, kind="stable")
        out.append((np.take_along_axis(near, o, 1), np.take_along_axis(v, o, 1)))
    return np.concatenate([robust_prune(x, n, v, degree, alpha) for n, v in out])


def both_ways(graph: np.ndarray, extra: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency with reverse edges as (offsets, neighbours)."""
    m, degree = graph.shape
    a = np.repeat(np.arange(m), degree)
    b = graph.ravel()
    a, b = a[b >= 0], b[b >= 0]
    if len(extra):
        e = np.array(extra, np.int64)
        a, b = np.append(a, e[:, 0]), np.append(b, e[:, 1])
    code = np.unique(np.concatenate([a * m + b, b * m + a]))
    code = code[code // m != code % m]
    return np.searchsorted(code // m, np.arange(m + 1)), code % m


def _spread(offsets: np.ndarray, flat: np.ndarray, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query with every neighbour of the row it stands at."""
    n = offsets[at + 1] - offsets[at]
    ends = np.cumsum(n)
    where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offsets[at] - ends + n, n)
    return np.repeat(q, n), flat[where]


def search(x: np.ndarray, queries: np.ndarray, offsets: np.ndarray, flat: np.ndarray, start: int, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, row) with a similarity of ``least`` or more: greedy search from ``start`` with a pool of
    ``beam`` rows for each query, then expansion over all neighbours of the rows in range. All queries step together."""
    m, nq = len(x), len(queries)
    pool = np.full((nq, beam), -1, np.int64)
    sims = np.full((nq, beam), -2.0)
    seen_open = np.zeros((nq, beam), bool)
    pool[:, 0], sims[:, 0], seen_open[:, 0] = start, x[queries] @ x[start], True
    visited = np.zeros((nq, m), bool)
    visited[:, start] = True
    hits: list[np.ndarray] = [np.flatnonzero(sims[:, 0] >= least) * m + start]
    while True:
        s = np.where(seen_open, sims, -3)
        best = s.argmax(1)
        go = np.flatnonzero(s[np.arange(nq), best] > -3)
        if not len(go):
            break
        seen_open[go, best[go]] = False
        q, y = _spread(offsets, flat, go, pool[go, best[go]])
        new = ~visited[q, y]
        q, y = q[new], y[new]
        if not len(q):
            continue
        visited[q, y] = True
        v = np.einsum("ad,ad->a", x[queries[q]], x[y])
        hits.append((q * m + y)[v >= least])
        n = np.bincount(q, minlength=nq)
        w = int(n.max())
        col = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        more, value = np.full((nq, w), -1, np.int64), np.full((nq, w), -2.0)
        more[q, col], value[q, col] = y, v
        p, a, o = np.hstack([pool, more]), np.hstack([sims, value]), np.hstack([seen_open, more >= 0])
        top = np.argpartition(-a, beam - 1, 1)[:, :beam]
        pool, sims, seen_open = (np.take_along_axis(z, top, 1) for z in (p, a, o))
    found = np.unique(np.concatenate(hits))
    front = found
    while len(front):
        q, y = _spread(offsets, flat, front // m, front % m)
        code = np.unique(q * m + y)
        q, y = code // m, code % m
        new = ~visited[q, y]
        q, y = q[new], y[new]
        visited[q, y] = True
        ok = np.einsum("ad,ad->a", x[queries[q]], x[y]) >= least
        front = q[ok] * m + y[ok]
        found = np.concatenate([found, front])
    q, y = queries[found // m], found % m
    return q[q != y], y[q != y]


def roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    lab = np.arange(m)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def joined(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components ``lab`` (each row's smallest row) after the rows ``a`` and ``b`` are tied."""
    a, b = lab[a], lab[b]
    code = np.unique((a * len(lab) + b)[a != b])
    return roots(len(lab), code // len(lab), code % len(lab))[lab] if len(code) else lab


def _profile(pdf: pd.DataFrame) -> pd.DataFrame:
    x = unit(pdf["embedding"])
    c = x.sum(0)
    c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
    radius = float(np.arccos(np.clip(x @ c, -1, 1)).max())
    return pd.DataFrame({"piece": pdf["piece"][:1], "label": pdf["label"][:1], "centre": [c.tolist()], "radius": radius, "copies": int(pdf["copies"].sum()), "low": int(pdf["node"].min())})


def _build(degree: int, alpha: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy()
        g = build(unit(pdf["embedding"]), degree, alpha)
        return pd.DataFrame({"node": ids, "neighbours": [ids[r[r >= 0]].tolist() for r in g]})

    return run


def _graph_pairs(x: np.ndarray, lists, ids: np.ndarray, queries: np.ndarray, inside: np.ndarray, least: float, degree: int, alpha: float, beam: int, dense: bool):
    """(query row, row) found by search from the medoid of the rows ``inside`` over the united lists (``dense``: and a
    graph of their own)."""
    place = {v: i for i, v in enumerate(ids.tolist())}
    rows = np.flatnonzero(inside)
    edges = [(i, place[v]) for i in rows.tolist() for v in lists[i] if v in place and inside[place[v]]]
    if dense or not edges:
        g = build(x[rows], degree, alpha)
        a, k = np.nonzero(g >= 0)
        edges += list(zip(rows[a].tolist(), rows[g[a, k]].tolist()))
    offsets, flat = both_ways(np.full((len(x), 1), -1), edges)
    start = int(rows[(x[rows] @ x[rows].mean(0)).argmax()])
    got = [search(x, queries[k : k + 256], offsets, flat, start, least, min(beam, len(x))) for k in range(0, len(queries), 256)]
    a, b = (np.concatenate([z[i] for z in got]) for i in (0, 1))
    keep = inside[b]
    return a[keep], b[keep]


def _compare(least: float, degree: int, alpha: float, beam: int, target: float, audit_rows: int, block: int = 256):
    """All links of two pieces, or of one with itself: each vector's number, the edges of a spanning forest, the audit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece", "node"]).reset_index(drop=True)
        ids, x, copies, lists = pdf["node"].to_numpy(), unit(pdf["embedding"]), pdf["copies"].to_numpy(np.float64), list(pdf["neighbours"])
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        m, left = len(pdf), int((pdf["piece"] == p).sum())
        queries, inside = np.arange(left), np.ones(m, bool)
        if p != q:
            inside[:left] = False
        asked = np.unique(np.linspace(0, left - 1, min(left, audit_rows)).astype(int))
        truth = (x[asked] @ x.T >= least) & inside
        truth[np.arange(len(asked)), asked] = False
        want, got, found = int(truth.sum()), 0, None
        if want <= 0.1 * len(asked) * inside.sum():
            for wide in (1, 2):
                a, b = _graph_pairs(x, lists, ids, queries, inside, least, degree * wide, alpha, beam * wide, wide > 1)
                hit = np.zeros((left, 1), np.int64)
                if p == q:  # found either way round
                    code = np.unique(np.minimum(a, b) * m + np.maximum(a, b))
                    a, b = code // m, code % m
                    np.add.at(hit[:, 0], b[b < left], 1)
                np.add.at(hit[:, 0], a, 1)
                got = int(hit[asked, 0].sum())
                if got >= target * want:
                    found = a, b
                    break
        links, lab = np.zeros(m), np.arange(m)
        if found is not None:
            a, b = found
            links += np.bincount(a, copies[b], m) + np.bincount(b, copies[a], m)
            lab = joined(lab, a, b)
        else:
            got = want
            for a in range(0, left, block):
                z = min(left, a + block)
                first = a + 1 if p == q else left
                hit = x[a:z] @ x[first:].T >= least
                if p == q:  # each unordered pair once
                    hit &= np.arange(first, m) > np.arange(a, z)[:, None]
                links[a:z] += hit @ copies[first:]
                links[first:] += copies[a:z] @ hit
                i, j = np.nonzero(hit)
                lab = joined(lab, i + a, j + first)
        some, tied = np.flatnonzero(links), np.flatnonzero(lab != np.arange(m))
        return pd.concat([
            pd.DataFrame({"kind": "links", "node": ids[some], "other": 0, "links": links[some].astype(np.int64)}),
            pd.DataFrame({"kind": "edge", "node": ids[tied], "other": ids[lab[tied]], "links": 0}),
            pd.DataFrame({"kind": ["audit"], "node": [want], "other": [min(got, want)], "links": [int(found is not None)]}),
        ])

    return run


def _assign(table: dict):
    """table: shard id: (centres, first child id). Rows of other shards stay where they are."""

    def run(batches):
        for pdf in batches:
            kept = []
            for shard, some in pdf.groupby("shard"):
                if shard in table:
                    c, first = table[shard]
                    near = np.argsort(-(unit(some["embedding"]) @ c.T), 1, kind="stable")
                    some = some.assign(shard=first + near[:, 0], second=first + near[:, min(1, len(c) - 1)])
                kept.append(some)
            if kept:
                yield pd.concat(kept)

    return run


def shards(heads: DataFrame, target_rows: int, max_rows: int, sample_rows: int, max_centres: int, levels: int = 3) -> DataFrame:
    """(shard, second, node, label, embedding, copies): labels dealt to centres, with the second nearest centre's shard;
    shards over ``max_rows`` are dealt again."""
    kind = "shard long, second long, node long, label long, embedding array<float>, copies long"
    now = written(heads.select(F.col("label").alias("shard"), F.col("label").alias("second"), "node", "label", "embedding", "copies"), "shards")
    free = int(now.agg(F.max("shard")).first()[0] or 0) + 1
    for level in range(levels):
        # the largest shards first; at most max_centres centres and sample_rows sampled vectors come to the driver
        sizes = now.groupBy("shard").count().where(F.col("count") > (target_rows if not level else max_rows)).orderBy(F.desc("count"), "shard").limit(max_centres).toPandas()
        if sizes.empty:
            break
        k = {int(s): max(2, -(-int(n) // target_rows)) for s, n in zip(sizes["shard"], sizes["count"])}
        share = min(1.0, max_centres / sum(k.values()))
        k = {s: max(2, int(n * share)) for s, n in k.items()}
        rate = min(1.0, sample_rows / int(sizes["count"].sum()))
        part = now.join(F.broadcast(now.sparkSession.createDataFrame([(s,) for s in k], "shard long")), "shard", "left_semi")  # k: at most max_centres rows
        sample = part.where(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).select("shard", "node", "embedding").limit(2 * sample_rows).toPandas()
        table = {}
        for s, some in sample.sort_values("node").groupby("shard"):
            c = centres(unit(some["embedding"]), min(k[int(s)], len(some)))
            table[int(s)] = (c, free)
            free += len(c)
        now = written(now.mapInPandas(_assign(table), kind), "shards")
    return now


def pieces(heads: DataFrame, target_rows: int, max_rows: int, sample_rows: int, max_centres: int) -> DataFrame:
    """(piece, second, node, label, embedding, copies): every vector once; shards still over ``max_rows`` are salted."""
    now = shards(heads, target_rows, max_rows, sample_rows, max_centres)
    sizes = written(now.groupBy("shard").agg(F.count("*").alias("weight"), F.ceil(F.count("*") / target_rows).alias("salts")), "shard-sizes")
    sizes = sizes.withColumn("salts", F.when(F.col("weight") > max_rows, F.least("salts", F.lit(1 << 16))).otherwise(1))
    now = spread_join(now, sizes, "shard", now.count())
    return written(now.select((F.col("shard") * (1 << 16) + F.pmod(F.xxhash64("node", F.lit("piece")), "salts")).alias("piece"), (F.col("second") * (1 << 16)).alias("second"), "node", "label", "embedding", "copies"), "pieces")


def adjacency(members: DataFrame, degree: int, alpha: float, max_rows: int) -> DataFrame:
    """(node, neighbours): the united lists of every vector over the graphs of its own and its second piece. A piece that is
    the second one of many vectors builds several graphs, each of its own members and some of the others."""
    guests = members.where("second <> piece").select(F.col("second").alias("piece"), "node", "embedding")
    slots = written(guests.groupBy("piece").agg(F.count("*").alias("weight"), F.ceil(F.count("*") / max_rows).alias("slots")), "piece-slots")
    dealt = spread_join(guests, slots, "piece", members.count()).select("piece", F.pmod(F.xxhash64("node"), "slots").alias("slot"), "node", "embedding")
    own = members.select("piece", "node", "embedding").hint("merge").join(slots.select("piece", "slots").hint("merge"), "piece", "left")
    own = own.select("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slots", F.lit(1)).cast("long") - 1)).alias("slot"), "node", "embedding")
    lists = own.unionByName(dealt).groupBy("piece", "slot").applyInPandas(_build(degree, alpha), ADJACENCY)
    return written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "adjacency")


def piece_pairs(profiles: DataFrame, least: float, salts: int = 16) -> DataFrame:
    """(p, q, gap, p_*, q_*, every): the pairs of pieces (p <= q) of a label that can hold a link; ``every`` if all of
    their vectors link. A label with many pieces is spread over ``salts`` keys."""
    range_ = math.acos(least)
    a = profiles.select("label", F.pmod("piece", F.lit(salts)).alias("salt"), F.col("piece").alias("p"), *[F.col(c).alias(f"p_{c}") for c in ("centre", "radius", "copies", "low")])
    b = profiles.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.col("piece").alias("q"), *[F.col(c).alias(f"q_{c}") for c in ("centre", "radius", "copies", "low")])
    dot = F.aggregate(F.zip_with("p_centre", "q_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    j = a.hint("merge").join(b.hint("merge"), ["label", "salt"]).where("p <= q")
    j = j.withColumn("gap", F.when(F.col("p") == F.col("q"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))))
    wide = F.col("p_radius") + F.col("q_radius")
    j = j.where(F.col("gap") - wide <= range_ + SLACK)
    return written(j.withColumn("every", F.col("gap") + wide <= range_ - SLACK).drop("label", "salt", "p_centre", "q_centre"), "piece-pairs")


def linked(members: DataFrame, least: float, degree: int, alpha: float, beam: int, target: float, audit_rows: int, max_rows: int) -> DataFrame:
    """The links, forest edges and audits of all pairs of vectors of a label with a similarity of ``least`` or more."""
    profiles = members.select("piece", "label", "node", "embedding", "copies").groupBy("piece").applyInPandas(_profile, PROFILE)
    pairs = piece_pairs(written(profiles, "piece-profiles"), least)
    mixed = pairs.where("not every").select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("piece"))
    listed = members.select("piece", "node", "embedding", "copies").hint("merge").join(adjacency(members, degree, alpha, max_rows).hint("merge"), "node")
    found = listed.hint("merge").join(mixed.hint("merge"), "piece").groupBy("p", "q").applyInPandas(_compare(least, degree, alpha, beam, target, audit_rows), FOUND)
    # pieces that link as a whole: a vector links with all of the other pieces' and, in its own, with all but itself;
    # edges to one of those vectors and between the pieces' lowest ones tie the same components
    whole = pairs.where("every")
    ends = F.array(F.struct(F.col("p").alias("piece"), F.col("q_copies").alias("copies"), F.col("q_low").alias("low"), (F.col("p") == F.col("q")).alias("own")), F.struct(F.col("q").alias("piece"), F.col("p_copies").alias("copies"), F.col("p_low").alias("low"), (F.col("p") == F.col("q")).alias("own")))
    ends = whole.select(F.inline(F.array_distinct(ends))).groupBy("piece").agg(F.sum("copies").alias("all_copies"), F.min("low").alias("low"), F.max("own").alias("own"))
    near = members.select("piece", "node", "copies").hint("merge").join(ends.hint("merge"), "piece")
    links = near.select(F.lit("links").alias("kind"), "node", F.lit(0).cast("long").alias("other"), (F.col("all_copies") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"))
    edges = near.select("node", F.col("low").alias("other")).union(whole.select("p_low", "q_low")).select(F.lit("edge").alias("kind"), "node", "other", F.lit(0).cast("long").alias("links"))
    return written(found.unionByName(links).unionByName(edges), "vector-links")


def near_duplicates(vectors: DataFrame, least: float = 0.93, target_rows: int = 1000, max_rows: int = 6000, sample_rows: int = 20_000, max_centres: int = 2048, degree: int = 24, alpha: float = 1.2, beam: int = 32, target: float = 0.99, audit_rows: int = 64) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_recall for every row.

    Only vectors of one label that isn't null are compared. Null, empty or zero vectors and those with null or
    non-finite parts link with nothing, nor do vectors of different lengths. Equal vectors are one node with a count. Rows that
    repeat a vec_id count each and share its component; a null vec_id links with nothing. An empty table gives no rows;
    other columns are ignored. The cluster centres come from at most 2 * ``sample_rows`` vectors; every vector is in the
    graph and queries it. audited_recall is one figure for the whole result: the share of the audited links that the
    accepted searches found, of ``audit_rows`` queries of each pair of shards.
    """
    with scratch(vectors.sparkSession):
        v, classes, info, recall = _info(vectors, least, target_rows, max_rows, sample_rows, max_centres, degree, alpha, beam, target, audit_rows)
    copied = classes.where("copies > 1").select(F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), F.col("node").alias("head"))
    keyed = v.hint("merge").join(copied.hint("merge"), F.col("good") & (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding")), "left")
    keyed = keyed.select("vec_id", F.when(F.col("good"), F.coalesce("head", "vec_id")).alias("key"))
    out = keyed.hint("merge").join(info.hint("merge"), F.col("key") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumns({"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)), "audited_recall": F.lit(recall)})


def _info(vectors: DataFrame, least: float, target_rows: int, max_rows: int, sample_rows: int, max_centres: int, degree: int, alpha: float, beam: int, target: float, audit_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """The rows with a mark of those that can link, the classes of equal vectors, each class's links and component, and the
    audited recall."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = written(v.withColumn("good", good), "vectors", keep=True)
    classes = v.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = written(classes, "vector-classes", keep=True)
    # a number for each label and length: vectors of different lengths are labels of their own
    heads = classes.withColumn("kind", F.struct("label", F.size("embedding").alias("size")))
    numbers = written(heads.groupBy("kind").agg(F.count("*").alias("weight")).withColumn("number", F.monotonically_increasing_id()), "label-numbers")
    heads = spread_join(heads, numbers, "kind", classes.count()).select(F.col("number").alias("label"), "node", "embedding", "copies")
    found = linked(pieces(heads, target_rows, max_rows, sample_rows, max_centres), least, degree, alpha, beam, target, audit_rows, max_rows)
    audit = found.where("kind = 'audit'").agg(F.sum("node").alias("want"), F.sum("other").alias("got")).first()
    links = found.where("kind = 'links'").groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("kind = 'edge'").select(F.col("node").alias("a"), F.col("other").alias("b")))
    info = classes.select("node", "copies").groupBy("node").agg(F.sum(F.col("copies")).alias("copies"))
    info = info.hint("merge").join(links.hint("merge"), "node", "left").join(parts.hint("merge"), "node", "left")
    info = written(info.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vector-info", keep=True)
    return v, classes, info, (audit["got"] / audit["want"]) if audit["want"] else 1.0
