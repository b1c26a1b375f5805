"""SQL of the queries that SQL can express, for comparison on the same tables."""

#: Every 50-byte window of every text, its smallest document, and the bytes that remain.
REPEATS = """WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT row, doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d),
w AS (SELECT row, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM b WHERE 2 * p + 100 <= length(h)),
gone AS (SELECT row, p FROM (SELECT row, p, doc_id, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE doc_id > least),
marks AS (SELECT row, p, max(g) OVER (PARTITION BY row ORDER BY p) AS last FROM (SELECT b.row, b.p, gone.p AS g FROM b LEFT JOIN gone ON gone.row = b.row AND gone.p = b.p)),
cover AS (SELECT row, p, coalesce(p - last < 50, false) AS covered, lag(coalesce(p - last < 50, false), 1, false) OVER (PARTITION BY row ORDER BY p) AS before FROM marks),
x AS (SELECT row, count(*) FILTER (covered) AS n_removed, count(*) FILTER (covered AND NOT before) AS n_spans, list(p ORDER BY p) FILTER (NOT covered) AS kept FROM cover GROUP BY row)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(array_to_string(list_transform(kept, lambda p: substr(h, 2 * p + 1, 2)), ''), ''))) AS kept_sha256 FROM d LEFT JOIN x USING (row)"""

#: Split and match lists of each rule; positions are running sums of their lengths.
SECRETS = r"""WITH rules(kind, rank, pattern, part, least) AS (VALUES
 ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12), ('access', 1, '(AKIA[A-Z0-9]+)', 1, 18), ('hex', 2, '([0-9a-f]{16,})', 1, 16)),
found AS (SELECT row, kind, rank, least, regexp_extract_all(t, pattern, 0) AS whole, CASE WHEN part = 2 THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern, 1) END AS piece, regexp_split_to_array(t, pattern) AS gaps
 FROM (SELECT row_number() OVER () AS row, coalesce(text, '') AS t FROM documents) d, rules),
spans AS (SELECT row, kind, rank, start, start + length(whole[k]) AS stop FROM (SELECT *, (list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda w: length(w))), 0))::BIGINT AS start
 FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM found)) WHERE length(piece[k]) >= least),
joined AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN joined USING (row)"""

#: The crc table and the jump sequences by recursion; slots follow the ids.
SHARDS = """WITH RECURSIVE bits(n, v, step) AS (SELECT n, n, 0 FROM range(256) AS r(n)
 UNION ALL SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE step = 8),
jumps(key, shards, state, b, j) AS (SELECT DISTINCT doc_id, s, (doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616, -1::BIGINT, 0::BIGINT FROM documents, (VALUES (8), (9)) AS v(s)
 UNION ALL SELECT key, shards, next, j, floor((j + 1)::DOUBLE * 2147483648.0 / ((next // 8589934592) + 1)::DOUBLE)::BIGINT
 FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE j < shards)),
place AS (SELECT key, max(b) FILTER (shards = 8)::INTEGER AS shard, max(b) FILTER (shards = 9)::INTEGER AS grown_shard FROM jumps WHERE j >= shards GROUP BY key),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
 lambda s, x: xor(s // 256, t[xor(s % 256, x) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM e JOIN place ON key = doc_id"""
