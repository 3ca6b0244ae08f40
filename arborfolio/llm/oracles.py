"""SQL (DuckDB) for the training-data queries whose results plain SQL can express: brute force over whole tables, by none
of the operators' methods. The others need a trained model, a tokenizer, a search index or a fitted subset."""

from __future__ import annotations

#: Scores of every query against every vector of its length.
EXACT_TOP_K = """
WITH rows AS (
  SELECT vec_id, [floor(CAST(x AS DOUBLE) * 256) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), asks AS (
  SELECT vec_id AS query_id, min(v) AS q FROM rows WHERE vec_id % 50 = 0 GROUP BY vec_id
), scored AS (
  SELECT query_id, vec_id, CAST(list_dot_product(q, v) AS BIGINT) AS score
  FROM asks JOIN rows ON vec_id <> query_id AND len(q) = len(v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Base32 takes the digest's 160 bits five at a time; ten hexadecimal digits hold eight of its characters.
WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages
), placed AS (
  SELECT *, min(page_id) OVER (PARTITION BY hexed) AS first_id,
    row_number() OVER (PARTITION BY hexed ORDER BY page_id NULLS LAST) AS k
  FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(hexed, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS BIGINT), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN first_id END AS refers_to
FROM placed
"""

#: All pairs of distinct shingle sets with a common shingle; components by following every link.
NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct([array_to_string(words[i : i + 3], ' ') for i in range(1, len(words) - 2)])) END AS shingles
  FROM worded
), keyed AS MATERIALIZED (
  SELECT doc_id, len(shingles) AS n, sha256(array_to_string(shingles, chr(10))) AS set_key, shingles FROM sets
), classes AS MATERIALIZED (
  SELECT set_key, min(doc_id) AS id, any_value(n) AS n, any_value(shingles) AS shingles
  FROM keyed WHERE n > 0 AND doc_id IS NOT NULL GROUP BY set_key
), tokens AS MATERIALIZED (
  SELECT id, n, unnest(shingles) AS shingle FROM classes
), links AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM tokens x JOIN tokens y ON x.shingle = y.shingle AND x.id <> y.id
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reached AS (
  SELECT DISTINCT a, a AS b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), components AS (
  SELECT a AS id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles,
  CASE WHEN k.doc_id IS NOT NULL THEN coalesce(m.component_id, c.id, k.doc_id) END AS component_id
FROM keyed k LEFT JOIN classes c ON k.set_key = c.set_key AND k.n > 0 LEFT JOIN components m ON c.id = m.id
"""

#: The horizons are a row per batch. A client's versions in a batch: those of the batch, and of earlier ones all above the
#: horizon of the batch before and the last up to it (pruning goes on horizon by horizon, which never falls). CRC-32 is
#: computed bit by bit, as DuckDB has no function for it.
VALID_TIME = """
WITH sold AS (
  SELECT sale_id, client_id, sold_at,
    greatest(0, least(7, floor((date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)) - 19723) * 8 / 152))) AS arrival
  FROM sales
), hashed AS (
  SELECT *, coalesce(list_reduce([4294967295] || list_transform(string_split(CAST(change_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS register
  FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL)
), changed AS (
  SELECT change_id, client_id, seq, op, valid_at, balance, greatest(0, least(7, floor((date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE))
    + xor(register, 4294967295) % 4 - 19723) * 8 / 152))) AS arrival
  FROM hashed
), marks AS (
  SELECT b, coalesce((SELECT max(sold_at) FROM sold WHERE arrival < b) - INTERVAL 12 HOUR, TIMESTAMP '-infinity') AS sales_mark,
    coalesce((SELECT max(valid_at) FROM changed WHERE arrival < b) - INTERVAL 12 HOUR, TIMESTAMP '-infinity') AS late_mark
  FROM range(8) t(b)
), horizons AS (
  SELECT b, least(sales_mark, late_mark) AS h, late_mark FROM marks UNION ALL SELECT 8, TIMESTAMP 'infinity', NULL
), versions AS (
  SELECT c.* FROM changed c JOIN horizons ON b = arrival WHERE valid_at >= late_mark
), emitted AS (
  SELECT row_number() OVER () AS n, sale_id, any_value(client_id) AS client_id, any_value(sold_at) AS sold_at, min(b) AS b
  FROM (SELECT row_number() OVER () AS one, * FROM sold) JOIN horizons ON b >= arrival AND (sold_at IS NULL OR sold_at < h)
  GROUP BY one, sale_id
), floors AS (
  SELECT b + 1 AS b, client_id, max((valid_at, seq, change_id)) AS floor_key
  FROM horizons JOIN versions ON arrival <= b AND valid_at <= h WHERE b < 8 GROUP BY ALL
), held AS (
  SELECT e.n, v.* FROM emitted e JOIN versions v ON v.client_id = e.client_id AND v.arrival <= e.b
  LEFT JOIN floors f ON f.b = e.b AND f.client_id = e.client_id
  WHERE v.arrival = e.b OR f.floor_key IS NULL OR (v.valid_at, v.seq, v.change_id) >= f.floor_key
), found AS (
  SELECT e.n, count(v.n) AS n_held, max(CASE WHEN v.valid_at <= e.sold_at THEN (v.valid_at, v.seq, v.change_id, v.op, v.balance) END) AS best
  FROM emitted e LEFT JOIN held v ON v.n = e.n GROUP BY e.n
)
SELECT 'sale' AS rec, sale_id AS id, CAST(b AS BIGINT) AS batch, n_held, best[3] AS change_id, CAST(floor(100 * best[5] + 0.5) AS BIGINT) AS balance_cents, best[4] AS op
FROM emitted JOIN found USING (n)
UNION ALL
SELECT 'late', change_id, CAST(arrival AS BIGINT), NULL, NULL, NULL, NULL FROM changed JOIN horizons ON b = arrival WHERE valid_at < late_mark
"""

ORACLES = {"op3_exact_top_k": EXACT_TOP_K, "op9_warc": WARC, "op10_ngram_jaccard_join": NGRAM_JACCARD_JOIN, "op11_valid_time_sales": VALID_TIME}
