"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = rf"""
WITH iw AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)
),
hits AS (
  SELECT d.doc_id, d.n, d.i, d.span FROM doc_windows d
  SEMI JOIN item_windows b ON d.span = b.span AND d.n = b.n
),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT h.doc_id, CAST(b.item_id AS VARCHAR) AS item
        FROM hits h JOIN item_windows b ON h.span = b.span AND h.n = b.n WHERE b.item_id IS NOT NULL)
  GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS ord
  FROM documents
),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS full_size,
         CAST(1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS BIGINT) AS weight
  FROM by_source
),
filled AS (
  SELECT *, CAST((sum(source_size) OVER ()
              - coalesce(sum(full_size) OVER (ORDER BY full_size / CAST(weight AS DOUBLE), source NULLS LAST
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY full_size / CAST(weight AS DOUBLE), source NULLS LAST
                                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
),
common AS (SELECT max(level) FILTER (WHERE level * weight <= full_size) AS fill FROM filled),
goals AS (
  SELECT source, source_size, least(CAST(full_size AS DOUBLE), coalesce(fill * weight, CAST(full_size AS DOUBLE))) AS target,
         CASE WHEN source_size > 0
              THEN least(CAST(full_size AS DOUBLE), coalesce(fill * weight, CAST(full_size AS DOUBLE))) / source_size
              ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix-1' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM filled, common
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, ord % 64, ord, doc_id) AS rnk FROM sized
)
SELECT doc_id, size, source_size, target,
       CAST(least(3, floor(rate * rnk + shift) - floor(rate * (rnk - 1) + shift)) AS BIGINT) * size AS taken
FROM ranked JOIN goals ON ranked.source IS NOT DISTINCT FROM goals.source
"""

OP8 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest
  FROM pages
),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND head <> page_id THEN head END AS refers_to
FROM q
"""

ORACLE_SQL: dict[str, str] = {"op5_decontamination": OP5, "op6_mixing": OP6, "op8_warc": OP8}
