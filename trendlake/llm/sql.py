"""SQL for DuckDB of the operators that SQL can express, beside quality_rules.SQL."""

SUBSTRING_DEDUP = """
WITH w AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(range(0, greatest(len(ws) - 19, 0))) AS i, ws FROM w
), k AS (
  SELECT doc_id, i, array_to_string(ws[i + 1:i + 20], ' ') AS key FROM p
), m AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM k
), gone AS (
  SELECT DISTINCT doc_id, i + j AS place FROM m, (SELECT unnest(range(0, 20)) AS j) WHERE r > 1
), each_word AS (
  SELECT doc_id, unnest(range(0, len(ws))) AS place, unnest(ws) AS word FROM w
), x AS (
  SELECT e.doc_id, e.place, e.word, g.place IS NOT NULL AS lost FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.place = g.place
), s AS (
  SELECT doc_id, sum(CASE WHEN lost THEN 1 ELSE 0 END) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT lost) AS kept FROM x GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""

LINE_DEDUP = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), e AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS k, unnest(lines) AS line FROM d
), f AS (
  SELECT doc_id, k, line, translate(regexp_replace(line, '^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), g AS (
  SELECT doc_id, k, line, CASE WHEN length(key) >= 10 THEN min(doc_id) OVER (PARTITION BY key) ELSE doc_id END AS first FROM f
)
, h AS (
  SELECT *, doc_id = first AS stays, row_number() OVER (PARTITION BY doc_id ORDER BY k) - row_number() OVER (PARTITION BY doc_id, doc_id = first ORDER BY k) AS island FROM g
), r AS (
  SELECT doc_id, stays, min(k) AS begins, count(*) AS length FROM h GROUP BY doc_id, stays, island
), b AS (
  SELECT doc_id, CASE WHEN bool_or(begins = 0 AND NOT stays) THEN '0,' ELSE '' END || string_agg(CAST(length AS VARCHAR), ',' ORDER BY begins) AS keep_runs FROM r GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN doc_id > first THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE doc_id = first), '')) AS kept_sha256
  FROM g GROUP BY doc_id
)
SELECT s.doc_id, n_lines, n_dropped, kept_sha256, keep_runs FROM s JOIN b ON s.doc_id = b.doc_id
"""
