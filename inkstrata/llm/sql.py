"""SQL twins of the operators' queries, for DuckDB over the same tables."""

from __future__ import annotations

from .secrets import RULES


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_scan() -> str:
    """op3: each rule's matches by their order in the text; the pieces between matches give the positions."""
    parts = []
    for k, r in enumerate(RULES):
        rx = _quoted(r.regex)
        parts.append(f"""SELECT doc_id, {k} AS k, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM (SELECT doc_id, regexp_extract_all(t, {rx}, 0) AS m, regexp_extract_all(t, {rx}, {r.value}) AS v, string_split_regex(t, {rx}) AS g FROM d) WHERE len(m) > 0""")
    names = "[" + ", ".join(_quoted(r.kind) for r in RULES) + "]"
    least = "[" + ", ".join(str(r.least) for r in RULES) + "]"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, k, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM f WHERE length(v[i]) >= {least}[k + 1]),
p AS (SELECT doc_id, k, a, {names}[k + 1] || ':' || a || ':' || (a + n) AS x FROM s)
SELECT doc_id, count(p.x) FILTER (k = 0) AS n_assign, count(p.x) FILTER (k = 1) AS n_access, count(p.x) FILTER (k = 2) AS n_hex, sha256(coalesce(string_agg(p.x, ',' ORDER BY a, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(p.x, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN p USING (doc_id) GROUP BY doc_id"""


def near_duplicates(words: int = 4, percent: int = 80) -> str:
    """op9: shared shingles of all pairs by a join, and components by recursion."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i+{words - 1}], ' ')) END) AS g FROM w WHERE w IS NOT NULL),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), k AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {percent} * (a.n + b.n - k)), e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, y AS c FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.c, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _cells(where: str) -> str:
    """Rows of embeddings whose vectors are whole and finite, with the integers floor(256 * x)."""
    return f"""SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
FROM embeddings WHERE {where} AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def ball_clusters(k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> str:
    """op11: plain rounds that compare every vector with every centroid."""
    parts = [f"v AS MATERIALIZED ({_cells(f'len(embedding) = {dims}')})", f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS INTEGER) AS c, x FROM v QUALIFY c < {k})"]
    for t in range(rounds + 1):
        apart = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        parts.append(f"a{t} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(d) AS distance, min(c) FILTER (d = least) AS c FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS least FROM (SELECT v.vec_id, v.x, c.c, {apart} AS d FROM v, c{t} c)) GROUP BY vec_id)")
        if t < rounds:
            parts.append(f"""m{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(range({dims})) AS i, unnest(x) AS e FROM a{t}) GROUP BY c, i) GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (c))""")
    return f"""WITH {", ".join(parts)} SELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} f USING (c)"""


def hard_negatives(every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> str:
    """op12: every anchor with every row, by definition."""
    score = "CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT)"
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM ({_cells('label IS NOT NULL')})),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS own, {score} AS score FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score QUALIFY rank <= {negatives}"""
