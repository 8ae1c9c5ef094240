"""DuckDB SQL of the conversation and resampling queries. CRC-32 is stated by its definition, as DuckDB hasn't got it."""

from __future__ import annotations

#: CRC-32 of the UTF-8 bytes of a text: the table of a byte's eight steps, then a fold over the bytes.
CRC32 = r"""
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps),
key_bytes AS (
  SELECT key, list_transform(range(0, octet_length(encode(key))), lambda i: (strpos('0123456789ABCDEF', substr(hex(encode(key)), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(key)), 2 * i + 2, 1)) - 1) AS bytes
  FROM keys),
crcs AS (
  SELECT key, xor(list_reduce(list_concat([4294967295::BIGINT], bytes::BIGINT[]), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM key_bytes, crc_table)"""

OP11_SQL = (
    r"""
WITH RECURSIVE read AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
keys AS (SELECT DISTINCT key FROM read),"""
    + CRC32
    + r""",
kinds AS (SELECT read.*, crc % 20 AS kind FROM read JOIN crcs USING (key)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copies(copy)
  WHERE kind <> 0),
seen AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS equal
  FROM damaged),
numbered AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
         CASE WHEN trimmed = '' THEN 'blank' WHEN equal > 1 THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, equal)),
counted AS (
  SELECT c.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
  GROUP BY c.conv_id),
-- States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
edits(edit, state, initial, goes, role) AS (
  SELECT 'K', * FROM (VALUES (0, 's', 1, ''), (0, 'u', 2, ''), (1, 'u', 2, ''), (2, 'a', 3, ''), (3, 'u', 2, ''))
  UNION ALL SELECT 'R', state, '', goes, role FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) AS r(state, goes, role)
  UNION ALL SELECT 'D', state, '', state, '' FROM (VALUES (0), (1), (2), (3)) AS d(state)),
inserts(state, goes, cost, audit, lines) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
         (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 2, 3, 'I', chr(10) || 'user:'),
         (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
walk(conv_id, i, state, best) AS (
  SELECT conv_id, 0::BIGINT, goes, {'cost': cost::BIGINT, 'audit': audit, 'lines': lines} FROM counted, inserts WHERE state = 0
  UNION ALL
  SELECT w.conv_id, r.i, j.goes,
         min({'cost': w.best.cost + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END + j.cost,
              'audit': w.best.audit || e.edit || j.audit,
              'lines': w.best.lines || CASE e.edit WHEN 'D' THEN '' ELSE chr(10) || CASE e.edit WHEN 'K' THEN r.role ELSE e.role END || ':' || r.text END || j.lines})
  FROM walk w JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
  JOIN edits e ON e.state = w.state AND (e.edit <> 'K' OR e.initial = left(r.role, 1)) AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  JOIN inserts j ON j.state = e.goes
  GROUP BY w.conv_id, r.i, j.goes),
ends AS (
  SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, min(best) AS best
  FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n AND w.state IN (0, 3)
  GROUP BY ALL)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256 FROM ends
"""
)

OP13_SQL = (
    r"""
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS found FROM documents
  UNION ALL
  SELECT 't', 0, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT side, row, unnest(found) AS key FROM words),
keys AS (SELECT DISTINCT key FROM each),"""
    + CRC32
    + r""",
placed AS (SELECT side, row, crc % 10000 AS bucket FROM each JOIN crcs USING (key)),
counts AS (SELECT b.bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM (SELECT range AS bucket FROM range(10000)) b LEFT JOIN placed USING (bucket) GROUP BY b.bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT row, sum(gain) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(found)::BIGINT AS n_words, coalesce(weight, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM words LEFT JOIN weights USING (row) WHERE side = 'd'),
able AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, n_words) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_words, n_words AS n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM able
"""
)
