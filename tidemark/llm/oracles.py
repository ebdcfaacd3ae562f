"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x20\x09-\x0D]+"


def ngram_links(words: int = 3, percent: int = 90) -> str:
    """Components by least ids that spread along links until nothing changes."""
    return f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [w]
        ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: w[i:i + {words} - 1])) END AS g FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
    SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)
), r(doc_id, reached) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links
FROM n JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x) k USING (doc_id)"""


def ranked_search(k: int = 20) -> str:
    return f"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'), []) AS t FROM documents
), q AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), a AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
p AS (
    SELECT doc_id, len(t) AS own, unnest(t) AS term FROM d
), tf AS (
    SELECT doc_id, own, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM a) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term
), s AS (
    SELECT q.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf
        + 12 * (75 + (25 * tf.own * a.n) // a.l)))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), a GROUP BY ALL
)
SELECT * FROM (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0) WHERE rank <= {k}"""


def centroids(clusters: int = 40, rounds: int = 5, dimensions: int = 64) -> str:
    distance = f"list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = [f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dimensions}
), c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS n, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT {clusters}
)"""]
    for r in range(rounds + 1):
        steps.append(f""", a{r} AS MATERIALIZED (
    SELECT vec_id, x, n, d FROM (
        SELECT v.vec_id, v.x, c.n, CAST({distance} AS BIGINT) AS d,
            row_number() OVER (PARTITION BY v.vec_id ORDER BY {distance}, c.n) AS place
        FROM v, c{r} c) WHERE place = 1
)""")
        if r < rounds:
            steps.append(f""", c{r + 1} AS MATERIALIZED (
    SELECT c.n, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
        SELECT n, list((s - (((s % k) + k) % k)) // k ORDER BY i) AS x FROM (
            SELECT n, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS k FROM (
                SELECT n, x, unnest(range(1, {dimensions + 1})) AS i FROM a{r}) GROUP BY n, i) GROUP BY n) m USING (n)
)""")
    return "".join(steps) + f"""
SELECT vec_id, a.n AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.x, lambda e: CAST(e AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (n)"""
