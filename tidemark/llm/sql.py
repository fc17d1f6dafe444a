"""DuckDB SQL for the results that it can express: op2, op6, op8 and op10 to op12, by definition instead of by the operators' methods.

Pairs are compared one by one and components grow by recursion, so these texts are for small tables.
"""

from __future__ import annotations

import math

from tidemark.llm.quality_rules import FEATURES

WORDS = r"'[^\x20\x09-\x0D]+'"

_REACH = """
     links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
     reach(node, other) AS (SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
     parts AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

#: Every two vectors of a label. The audit is of links found among links there are, so its true value is 1.
OP2 = f"""
WITH RECURSIVE
     v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL),
     good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
     pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
               WHERE list_cosine_similarity(a.e, b.e) >= 0.93),{_REACH},
     counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept,
       CAST(1 AS DOUBLE) AS audited_recall
FROM embeddings LEFT JOIN counts c ON c.node = vec_id LEFT JOIN parts p ON p.node = vec_id"""

OP8 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, url, strlen(h) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to, url, TRUE AS block_ok
FROM d"""

OP10 = f"""
WITH RECURSIVE
     w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w
           FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
     pairs AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN parts ON node = d.doc_id"""


def _op6(fence: float = 4.0, least_rows: int = 50, relative_error: float = 0.01) -> str:
    gamma = f"CAST('{math.log((1 + relative_error) / (1 - relative_error))!r}' AS DOUBLE)"
    number = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    value = lambda e: f"coalesce(CAST({e.split(' / ')[0]} AS DOUBLE) / nullif({e.split(' / ')[1]}, 0), 0)"
    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS feature, {value(e)} AS x, {number(t)} AS tail, {number(1 - t)} AS other, '{side}' AS side FROM stats" for k, (e, t, side) in FEATURES.items())
    read = lambda q: f"min(CASE WHEN cum >= ceil(total * {q}) THEN CASE WHEN bucket <= 0 THEN 0 ELSE exp((bucket - 0.5) * {gamma}) - 1 END END)"

    def level(keys: str) -> str:
        part = f"PARTITION BY {keys}feature"
        return f"""(SELECT {keys}feature, max(total) AS n, {read('other')} AS lo, {read('0.5')} AS mid, {read('tail')} AS hi
            FROM (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS cum, sum(n) OVER ({part}) AS total
                  FROM (SELECT {keys}feature, tail, other, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys}feature)"""

    pick = lambda c: f"CASE WHEN o.n >= {least_rows} THEN o.{c} WHEN l.n >= {least_rows} THEN l.{c} ELSE e.{c} END AS {c}"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WORDS})) AS lines FROM documents),
     windows AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS pos, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS win
                 FROM d WHERE len(w) >= 8),
     twice AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
     covered AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS word FROM twice) GROUP BY doc_id),
     stats AS (SELECT d.doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
                      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
               FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),
     vals AS ({values}),
     sketch AS (SELECT lang, source, feature, tail, other, CAST(ceil(ln(1 + x) / {gamma}) AS INT) AS bucket, count(*) AS n
                FROM vals SEMI JOIN (SELECT doc_id FROM stats WHERE n_words > 0) USING (doc_id) GROUP BY ALL),
     picked AS (SELECT o.lang, o.source, o.feature, {pick('lo')}, {pick('mid')}, {pick('hi')}
                FROM {level('lang, source, ')} o JOIN {level('lang, ')} l ON o.lang IS NOT DISTINCT FROM l.lang AND o.feature = l.feature
                JOIN {level('')} e ON o.feature = e.feature),
     fences AS (SELECT lang, source, feature, exp(ln(1 + lo) - {gamma}) - 1 - {fence} * (mid - lo) AS low,
                       exp(ln(1 + hi) + {gamma}) - 1 + {fence} * (hi - mid) AS high FROM picked),
     bad AS (SELECT DISTINCT doc_id FROM vals v JOIN fences f ON v.feature = f.feature AND v.lang IS NOT DISTINCT FROM f.lang
             AND v.source IS NOT DISTINCT FROM f.source WHERE x > high OR (side = 'both' AND x < low)),
     based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM based b LEFT JOIN bad ON bad.doc_id = b.doc_id"""


#: Every order walked step by step over masks of single documents.
OP11 = f"""
WITH RECURSIVE
     lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
             FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
     d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
     m AS (SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
                  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
           FROM d LEFT JOIN lab USING (doc_id)),
     letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
     prefix(ord, before, letter, bit) AS (SELECT '', 0, '', 0 UNION ALL
             SELECT ord || l.letter, before | p.bit, l.letter, l.bit FROM prefix p, letters l WHERE (before | p.bit) & l.bit = 0),
     steps AS (SELECT part, ord, letter, count(*) FILTER (WHERE mask & (before | bit) = 0) AS kept,
                      count(*) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS removed,
                      count(*) FILTER (WHERE mask & bit > 0 AND mask & before > 0) AS redundant,
                      count(*) FILTER (WHERE mask = bit) AS unique_fails,
                      count(*) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND good = 1) AS good_lost,
                      count(*) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND toxic = 1) AS toxic_lost
               FROM m, prefix WHERE ord <> '' GROUP BY part, ord, letter),
     orders AS (SELECT o.ord AS filter_order, CAST(k AS INT) AS step, substr(o.ord, 1, k) AS ord FROM prefix o, range(1, 6) r(k) WHERE length(o.ord) = 5),
     whole AS (SELECT part, filter_order, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM orders JOIN steps USING (ord))
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM whole"""

_field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_leaf = lambda n: "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
_fold = "CASE WHEN l[xor(rank, 1) + 1] IS NULL THEN sha256(cur) WHEN rank % 2 = 0 THEN sha256(cur || l[rank + 2]) ELSE sha256(l[rank] || cur) END"
_up = "list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"

#: Trees as lists of each level's digests; every leaf is folded up through them.
OP12 = f"""
WITH RECURSIVE
     tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
                    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
     d AS (SELECT *, coalesce('=' || lang, '-') AS tree, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS raised,
                  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                                  lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit FROM documents, tab),
     r AS (SELECT doc_id, tree, leaf, CASE WHEN hit THEN raised ELSE leaf END AS used,
                  row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
     grow(tree, level, l) AS (SELECT tree, 0, list(leaf ORDER BY rank) FROM r GROUP BY tree UNION ALL SELECT tree, level + 1, {_up} FROM grow WHERE len(l) > 1),
     subroots AS (SELECT tree, l[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank FROM grow WHERE len(l) = 1),
     crown(level, l) AS (SELECT 0, list(subroot ORDER BY rank) FROM subroots HAVING count(*) > 0 UNION ALL SELECT level + 1, {_up} FROM crown WHERE len(l) > 1),
     one(doc_id, tree, leaf, rank, level, cur, proof, n) AS (SELECT doc_id, tree, leaf, rank, 0, used, '', rank FROM r UNION ALL
         SELECT doc_id, o.tree, leaf, rank // 2, o.level + 1, {_fold}, proof || coalesce(l[xor(rank, 1) + 1], ''), n
         FROM one o JOIN grow g ON o.tree = g.tree AND o.level = g.level WHERE len(l) > 1),
     two(doc_id, tree, leaf, rank, level, cur, proof) AS (
         SELECT doc_id, o.tree, leaf, s.rank, 0, cur, proof FROM one o JOIN subroots s ON o.tree = s.tree JOIN grow g ON g.tree = o.tree AND g.level = o.level AND len(l) = 1
         UNION ALL
         SELECT doc_id, tree, leaf, rank // 2, t.level + 1, {_fold}, proof || coalesce(l[xor(rank, 1) + 1], '') FROM two t JOIN crown c ON t.level = c.level WHERE len(l) > 1)
SELECT doc_id, leaf, subroot, c.l[1] AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = c.l[1] AS verified
FROM two t JOIN crown c ON t.level = c.level AND len(c.l) = 1 JOIN subroots s ON s.tree = t.tree"""


ORACLE = {"op2_embedding_dedup": OP2, "op6_quality_rules": _op6(), "op8_warc": OP8, "op10_jaccard_join": OP10, "op11_filter_audit": OP11, "op12_merkle_manifest": OP12}
