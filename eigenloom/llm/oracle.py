"""DuckDB SQL of those queries that SQL can express."""

ORACLE = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM places),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN low USING (k) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit CROSS JOIN range(0, 50) AS r(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_exact_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
          FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10""",
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
      FROM embeddings WHERE label IS NOT NULL),
pairs AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = d.label AS same, d.vec_id, CAST(list_dot_product(a.e, d.e) AS BIGINT) AS score
          FROM v a JOIN v d ON a.vec_id % 100 = 0 AND d.vec_id <> a.vec_id),
near AS MATERIALIZED (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
         QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
fits AS (SELECT near.*, pairs.vec_id AS negative_id, pairs.score AS negative_score,
                row_number() OVER (PARTITION BY near.anchor_id, positive_id ORDER BY pairs.score DESC, pairs.vec_id) AS r
         FROM near JOIN pairs ON near.anchor_id = pairs.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM fits WHERE r <= 5""",
}
