"""DuckDB SQL for those numbered queries that SQL can express on whole tables."""

from __future__ import annotations

from .queries import RULES

WORD = r"[^\x20\x09-\x0D]+"

_values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, encode(coalesce(html, '')) AS raw FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, sha1(body) AS hexed,
         max(page_id) OVER (PARTITION BY sha1(body)) AS last
  FROM p
), bits AS (
  SELECT *, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(('0x' || substr(hexed || '0', 1 + (5 * i) // 4, 2))::INTEGER >> (3 - (5 * i) % 4) & 31 AS INTEGER) + 1, 1)
    FOR i IN range(32)], '') AS payload_digest
  FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM bits
"""

OP7 = rf"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_values}),
u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), m AS (
  SELECT u.*, r.*, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, r_verdict DESC) AS k
  FROM u LEFT JOIN rules r ON (u.host = r_host OR ends_with(u.host, '.' || r_host)) AND starts_with(u.path, r_path)
)
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

OP8 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN r.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
), least AS (
  SELECT u, min(w) AS component_id FROM reach GROUP BY u
), n AS (
  SELECT u, count(*) AS n_links FROM links GROUP BY u
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON vec_id = least.u LEFT JOIN n ON vec_id = n.u
"""

ORACLES = {"op10_embedding_dedup": OP10, "op2_warc": OP2, "op7_url_filter": OP7, "op8_line_dedup": OP8}
