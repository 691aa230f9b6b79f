"""The views as DuckDB SQL, for the SQL counterparts."""

VIEWS: dict[str, str] = {
    "v_lines": r"""
SELECT doc_id, source, lang, i - 1 AS line_no, parts[i] AS text
FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents) d,
     unnest(range(1, len(parts) + 1)) u(i)""",
    "v_words": r"""
SELECT doc_id, lang, source, line_no, i - 1 AS word_no, parts[i] AS word,
  coalesce(sum(length(parts[i]) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
FROM (SELECT doc_id, lang, source, line_no, string_split(text, ' ') AS parts FROM v_lines) d,
     unnest(range(1, len(parts) + 1)) u(i)""",
    "v_para": r"""
SELECT doc_id, line_no,
  coalesce(sum(length(text) // 48 + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS v0
FROM v_lines""",
    "v_runs": r"""
SELECT doc_id, v // 100 AS page, (v // 50) % 2 AS col, 54 + 276 * ((v // 50) % 2) + 4 * (c % 48) AS x,
  738 - 13 * (v % 50) AS y, 4 * length(word) AS width,
  CASE WHEN line_no = 0 THEN 14 ELSE 10 END AS size,
  CASE WHEN line_no = 0 THEN 'bold' ELSE 'normal' END AS weight,
  CASE WHEN line_no = 0 THEN 'ABCDEF+Head' ELSE 'GHIJKL+Text-' || lang END AS font,
  word AS text, line_no * 100000 + word_no AS ord, source
FROM (SELECT w.*, p.v0 + w.c // 48 AS v FROM v_words w JOIN v_para p USING (doc_id, line_no)) WHERE word <> ''""",
    "v_ocr": r"""
SELECT doc_id, page, x - 1 AS x0, y - 2 AS y0, x + width + 1 AS x1, y + 8 AS y1,
  50 + (doc_id * 7 + ord * 13) % 50 AS confidence,
  CASE WHEN (doc_id * 31 + ord * 7) % 17 = 0 AND length(text) > 3 THEN substr(text, 1, length(text) - 1) || 'q'
       WHEN (doc_id * 31 + ord * 7) % 29 = 0 AND length(text) > 3 THEN substr(text, 1, length(text) - 1)
       ELSE text END AS text, ord, col, size
FROM v_runs WHERE (doc_id + ord) % 23 <> 0""",
    "v_furniture": r"""
SELECT doc_id, page, 0 AS col, 54 AS x, 770 AS y, 5 * length(source) AS width, 8 AS size, 'normal' AS weight,
  'GHIJKL+Foot' AS font, source AS text, -2 AS ord, source FROM (SELECT DISTINCT doc_id, page, source FROM v_runs)
UNION ALL
SELECT doc_id, page, 0, 300, 20, 5 * length((page + 1 + doc_id % 7)::VARCHAR), 8, 'normal', 'GHIJKL+Foot',
  (page + 1 + doc_id % 7)::VARCHAR, -1, source FROM (SELECT DISTINCT doc_id, page, source FROM v_runs)""",
    "v_full_runs": "SELECT * FROM v_runs UNION ALL BY NAME SELECT * FROM v_furniture",
    "v_overprinted_runs": r"""
SELECT doc_id, page, col, x, y, CASE WHEN setting = 2 THEN 8 ELSE width END AS width, size, weight, font,
  CASE WHEN setting = 2 THEN substr(text, 1, 2) ELSE text END AS text, ord * 10 + setting AS ord, source
FROM v_runs, unnest(CASE WHEN size = 14 AND length(text) > 3 THEN [0, 1, 2] WHEN size = 14 THEN [0, 1] ELSE [0] END) s(setting)""",
    "v_blocks": r"""
SELECT page_id, i - 1 AS n, regexp_extract(parts[i], '^<([a-z]+[0-9]?)', 1) AS tag,
  trim(regexp_replace(regexp_replace(parts[i], '^<[^>]*>', ''), '<[^>]*>', ' ', 'g')) AS text
FROM (SELECT page_id, regexp_extract_all(html, '(<(?:title|h[1-6]|p|li|b|a)(?: [^>]*)?>[^<]*)', 1) AS parts FROM pages) d,
     unnest(range(1, len(parts) + 1)) u(i)""",
    "v_piece_runs": r"""
SELECT doc_id, page, col, y, size, weight, font, source, CASE WHEN part = 1 THEN x + 8 ELSE x END AS x,
  CASE part WHEN 0 THEN 16 WHEN 1 THEN width - 8 ELSE width END AS width,
  CASE part WHEN 0 THEN substr(text, 1, 4)
    WHEN 1 THEN CASE WHEN (doc_id + ord) % 211 = 0 THEN '#' ELSE substr(text, 3, 1) END || substr(text, 4) ELSE text END AS text,
  ord * 2 + part % 2 AS ord
FROM v_runs, unnest(CASE WHEN length(text) >= 6 THEN [0, 1] ELSE [2] END) s(part)""",
    "v_cut_runs": r"""
SELECT doc_id, page, col, y, size, weight, font, source, CASE WHEN part = 1 THEN x + width - 4 ELSE x END AS x,
  CASE WHEN part = 1 THEN 4 WHEN cut THEN width - 4 ELSE width END AS width,
  CASE WHEN part = 1 THEN '' WHEN cut THEN substr(text, 1, length(text) - 1) ELSE text END AS text, ord * 2 + part AS ord
FROM (SELECT *, regexp_matches(text, '(en|er)\p{Ll}$') AS cut FROM v_runs), unnest(CASE WHEN cut THEN [0, 1] ELSE [0] END) s(part)""",
    "v_initial_runs": r"""
SELECT doc_id, page, col, y, weight, font, source, CASE WHEN part = 1 THEN 20 ELSE size END AS size,
  CASE WHEN part = 1 THEN x + 2 ELSE x END AS x, CASE WHEN part = 1 THEN 10 ELSE width END AS width,
  CASE WHEN part = 1 THEN substr(caps, 1, 1) ELSE substr(caps, 2) END AS text, ord * 2 + part AS ord
FROM (SELECT *, upper(regexp_replace(text, '[^\p{L}]|ß', '', 'g')) AS caps FROM v_runs WHERE size = 14), unnest([0, 1]) s(part)
WHERE length(caps) > 2""",
    "v_names": r"""
SELECT doc_id, lang AS type, text AS name, CASE doc_id % 6 WHEN 0 THEN text
  WHEN 1 THEN substr(text, 1, length(text) - 2) || 'qq' WHEN 2 THEN text || ' (' || source || ')'
  WHEN 3 THEN array_to_string(list_reverse(string_split(text, ' ')), ' ')
  WHEN 4 THEN array_to_string(string_split(text, ' ')[2:], ' ') ELSE 'xx ' || text END AS printed
FROM (SELECT doc_id, lang, source, regexp_extract(text, '^([^.\n]*)', 1) AS text FROM documents) WHERE text <> ''""",
    "v_imported": r"""
SELECT doc_id, lang || '|' || split_part(text, chr(10), 1) AS name, lang, text,
  CASE WHEN quality = 0 THEN md5(text || '-') ELSE md5(text) END AS source_hash, md5(text) AS fingerprint,
  CASE WHEN toxic = 1 THEN md5(text || '+') ELSE md5(text) END AS current_fingerprint
FROM documents JOIN labels USING (doc_id)""",
    "v_cells": r"""
SELECT table_id, page, row_no, bold, i - 1 AS col_no, texts[i] AS text FROM (
  SELECT p_brand AS table_id, p_partkey // 500 AS page, 4 * p_partkey + 1 AS row_no, true AS bold,
    CASE WHEN p_partkey % 40 = 0 THEN [p_type] ELSE ['Name', 'Wt', 'Cost', 'Type', 'Range'] END AS texts FROM part WHERE p_partkey % 40 IN (0, 20)
  UNION ALL SELECT p_brand, p_partkey // 500, 4 * p_partkey + 2, false, [p_name, CASE WHEN p_size % 10 = 0 THEN '-' ELSE p_size || ' kg' END,
    CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE format('{:,}', trunc(p_retailprice * 10)::BIGINT) END, p_type, p_size || '-' || (p_size + 5)] FROM part
  UNION ALL SELECT DISTINCT p_brand, 0, -1, true, ['Name', 'Wt', 'Cost', 'Type', 'Range'] FROM part), unnest(range(1, len(texts) + 1)) u(i)""",
    "v_table_runs": r"""
SELECT substr(table_id, 7)::BIGINT AS doc_id, r // 40 AS page, 0 AS col, 54 + 90 * col_no AS x, 738 - 13 * (r % 40) AS y, 5 * length(text) AS width, 10 AS size,
  CASE WHEN bold THEN 'bold' ELSE 'normal' END AS weight, 'GHIJKL+Table' AS font, text, row_no * 10 + col_no AS ord, 'part' AS source
FROM (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY row_no) - 1 AS r FROM v_cells)""",
    "v_roll_rows": r"""
SELECT table_id, row_no, roll, outcome FROM (
  SELECT p_brand || '/' || p_type AS table_id, p_name, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part) t,
LATERAL (SELECT 2 * n AS row_no, (10 * n - 9) || '-' || CASE WHEN n % 5 = 0 THEN '' ELSE (10 * n)::VARCHAR END AS roll, p_name AS outcome
  UNION ALL SELECT 2 * n + 1, (10 * n)::VARCHAR, 'on' WHERE n % 5 = 0)""",
    "v_field_lines": r"""
SELECT p_brand AS doc_id, p_partkey // 64 AS page, p_partkey * 4 + k AS ord, text, "right" FROM part, LATERAL (
  SELECT 0 AS k, 'Type: ' || p_type AS text, 250 AS "right" UNION ALL SELECT 1, 'Price: ' || trunc(p_retailprice)::BIGINT || CASE WHEN p_size % 3 = 0 THEN ',' ELSE '' END, 200
  UNION ALL SELECT 2, 'sold with ' || p_name, 290 UNION ALL SELECT 3, 'Made for ' || p_name || ' users', 200) r""",
    "v_grid_runs": r"""
SELECT p_partkey AS doc_id, 0 AS page, x, y, 5 * length(text) AS width, size, weight, 'GHIJKL+Grid' AS font, text, k AS ord FROM part, LATERAL (
  SELECT k, 100 + 60 * (k % 3) AS x, 500 - 40 * (k // 3) AS y, ((p_partkey * (k + 3)) % 90 + 10)::VARCHAR AS text, 12 AS size, 'bold' AS weight FROM range(0, 9) r(k) WHERE NOT (p_size % 7 = 0 AND k = 4)
  UNION ALL SELECT 20 + k, 98 + 60 * (k % 3), 514 - 40 * (k // 3), 'L' || k, 6, 'normal' FROM range(0, 9) r(k)
  UNION ALL SELECT 40, 90, 560, p_name, 14, 'bold' UNION ALL SELECT 41, 90, 360, 'Gear: ' || p_type, 9, 'normal' UNION ALL SELECT 42, 90, 348, 'and ' || p_brand, 9, 'normal') g""",
    "v_ocr_passes": r"""
SELECT doc_id, page, col, ord, text, 0 AS pass, x0, y0, x1, y1, confidence, size FROM v_ocr WHERE confidence >= 60
UNION ALL SELECT doc_id, page, col, ord, text, 1, x0 + 1, y0, x1 + 1, y1, CASE WHEN confidence >= 60 THEN confidence ELSE confidence + 10 END, size FROM v_ocr""",
    "v_spanned_runs": r"""
SELECT * FROM v_runs UNION ALL BY NAME SELECT doc_id, page, source, 0 AS col, 54 AS x, 75 - 12 * k AS y, 500 AS width, 10 AS size, 'normal' AS weight,
  'GHIJKL+Text-xx' AS font, repeat('x', 100) AS text, -10 - k AS ord FROM (SELECT DISTINCT doc_id, page, source FROM v_runs), range(0, 3) r(k)""",
}
