"""SQL for the operators that SQL can express, over the whole tables.

It restates the contracts by brute force (all pairs, recursive reachability), so it suits small
tables only; nothing else uses it."""

from __future__ import annotations

import math

from .licenses import TEMPLATES, WINDOW

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"

_REACH = """reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH},
n AS (SELECT a AS vec_id, COUNT(*) AS n FROM both_ways GROUP BY 1), c AS (SELECT a AS vec_id, MIN(b) AS c FROM reach GROUP BY 1)
SELECT vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, LEAST(vec_id, COALESCE(c, vec_id)) AS component_id, vec_id = LEAST(vec_id, COALESCE(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""

DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM d, unnest(range(0, greatest(len(w) - 4, 1))) r(k) WHERE len(w) > 0),
z AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH}, c AS (SELECT a AS doc_id, MIN(b) AS c FROM reach GROUP BY 1)
SELECT doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, LEAST(doc_id, COALESCE(c, doc_id)) AS component_id, doc_id = LEAST(doc_id, COALESCE(c, doc_id)) AS kept
FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id)"""


def _templates() -> str:
    rows = []
    for n, (label, text) in enumerate(TEMPLATES):
        tokens = list(dict.fromkeys(text.split()))
        rows.append(f"({n}, '{label}', {tokens!r}, {max(1, math.ceil(0.8 * len(tokens) - 1e-9))})")
    return ", ".join(rows)


LICENSES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT rid, w, unnest(range(2, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
p AS (SELECT rid, CASE WHEN w[i - 1] IN ('mit', 'apache') THEN i - 2 WHEN i > 2 AND w[i - 1] = 'public' AND w[i - 2] = 'general' THEN i - 3 END AS pos,
  CASE WHEN w[i - 1] IN ('mit', 'apache') THEN w[i - 1] ELSE 'gpl' END AS label FROM i WHERE w[i] = 'license'),
b AS (SELECT rid, COUNT(*) AS n_base, MIN(pos) AS first_word, MAX(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM p WHERE pos IS NOT NULL GROUP BY 1),
t AS (SELECT * FROM (VALUES {_templates()}) t(n, label, tokens, need)),
k AS (SELECT rid, list_distinct(w[pos + 1 : pos + {WINDOW}]) AS b FROM d, unnest(generate_series(0, greatest(len(w) - {WINDOW // 2} - 1, 0), {WINDOW // 2})) r(pos)),
m AS (SELECT rid, label, len(list_intersect(b, tokens)) / CAST(len(tokens) AS DOUBLE) AS share FROM k, t WHERE len(list_intersect(b, tokens)) >= need),
f AS (SELECT rid, list(DISTINCT label) AS labels, MAX(share) AS share, COUNT(*) AS n FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
COALESCE(array_to_string(b.labels, ','), '') AS base_labels, COALESCE(array_to_string(list_sort(list_distinct(list_concat(COALESCE(b.labels, []), COALESCE(f.labels, [])))), ','), '') AS labels,
CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE COALESCE(share, CAST(0 AS DOUBLE)) END AS score, CAST(COALESCE(f.n, 0) AS BIGINT) AS n_blocks
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)"""

SQL = {"op1_embedding_near_dedup": EMBEDDINGS, "op7_minhash_dedup": DUPLICATES, "op9_license_scan": LICENSES}
