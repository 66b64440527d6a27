"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM d),
sets AS MATERIALIZED (
  SELECT min(doc_id) AS rep, md5(array_to_string(list_sort(g), chr(10))) AS h, any_value(g) AS g, len(any_value(g)) AS n
  FROM s WHERE len(g) > 0 GROUP BY 2),
e AS MATERIALIZED (SELECT rep, n, unnest(g) AS t FROM sets),
o AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c
  FROM e a JOIN e b ON a.t = b.t AND a.rep < b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM o WHERE 100 * c >= 90 * (an + bn - c) UNION SELECT b, a FROM o WHERE 100 * c >= 90 * (an + bn - c)),
r(x, y) AS (SELECT rep, rep FROM sets UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
k AS MATERIALIZED (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN sets ON sets.h = md5(array_to_string(list_sort(s.g), chr(10))) AND len(s.g) > 0
LEFT JOIN k ON k.x = sets.rep
"""

OP4 = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP5 = r"""
WITH p AS MATERIALIZED (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT h, max(page_id) AS original, count(*) AS n FROM p GROUP BY 1)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM p JOIN g USING (h)
"""

_OP7_WORDS = r"""list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP7 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_OP7_WORDS} AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, {_OP7_WORDS} AS w FROM benchmark),
wins AS MATERIALIZED (
  SELECT DISTINCT item_id, length, win FROM (
    SELECT item_id, least(len(w), 10) AS length,
      unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS win
    FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT length FROM wins),
grams AS (
  SELECT doc_id, length, p, array_to_string(w[p:p + length - 1], ' ') AS win
  FROM (SELECT doc_id, w, length, unnest(range(1, len(w) - length + 2)) AS p FROM d, lengths WHERE len(w) >= length)),
hits AS MATERIALIZED (SELECT g.doc_id, g.p, g.length, wins.item_id FROM grams g JOIN wins USING (length, win)),
words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + length)) AS q FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL by the query's name."""
    return {
        "op3_ngram_jaccard_join": OP3,
        "op4_exact_top_k": OP4,
        "op5_warc": OP5,
        "op7_decontamination": OP7,
    }
