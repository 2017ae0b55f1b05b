"""SQL for the pipeline operators whose results SQL can express: plain definitions over all rows."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * CAST(i AS INTEGER) + 1, 5) AS BIGINT) >> b) & 31) + 1, 1)), '')), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str) -> str:
    words = WORDS.format(text="lower(text)")
    return f"""
SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL)"""


SQL["op2_decontaminate"] = f"""
WITH i AS ({_shingles('benchmark', 'item_id')}), d AS ({_shingles('documents', 'doc_id')}),
n AS (SELECT item_id, count(*) AS shingles FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS found FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, found, shingles FROM c JOIN n USING (item_id) WHERE found >= ceil(shingles * 0.8 - 1e-9)"""

SQL["op5_sharding"] = """
WITH crc_table AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size,
         xor(list_reduce(list_transform(range(0, CAST(n AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * CAST(i AS INTEGER) + 1, 2) AS BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM d CROSS JOIN crc_table),
pulls AS (
  SELECT doc_id, s, 1.0 / -ln((CAST(CAST('0x' || substr(md5(doc_id || '/' || s), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496) AS pull
  FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN (SELECT unnest(range(0, 9)) AS s)),
won AS (
  SELECT doc_id, CAST(arg_max(s, pull) FILTER (s < 8) AS INTEGER) AS shard, CAST(arg_max(s, pull) AS INTEGER) AS grown_shard
  FROM pulls GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM sums JOIN won USING (doc_id)"""

SQL["op6_substrings"] = f"""
WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i,
             unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END)) AS k FROM d),
c AS (SELECT *, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS again FROM u),
g AS (SELECT doc_id, word, i, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

SQL["op7_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

SQL["op10_suffixes"] = """
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
u AS (SELECT doc_id, unnest(range(0, n)) AS i, h, n FROM d),
m AS (SELECT doc_id, i, substr(h, 2 * CAST(i AS INTEGER) + 1, 2) AS b,
             CASE WHEN i + 200 <= n THEN hash(substr(h, 2 * CAST(i AS INTEGER) + 1, 400)) END AS k,
             CASE WHEN i + 200 <= n THEN hash(substr(h, 2 * CAST(i AS INTEGER) + 1, 200)) END AS k2 FROM u),
c AS (SELECT *, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k, k2) > 1 THEN 1 ELSE 0 END AS again FROM m),
g AS (SELECT doc_id, i, b, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM c),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS opens FROM g),
r AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(opens) AS BIGINT) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept
      FROM e GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""
