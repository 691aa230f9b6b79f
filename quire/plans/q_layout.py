"""Queries of inventory B."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import canonical_text
from quire.operators import layout as L
from quire.plans.registry import query

PAGE_KEYS = ["doc_id", "page"]


@query("b1_canonical_text", r"""
SELECT doc_id, trim(nfc_normalize(regexp_replace(translate(replace(replace(replace(replace(replace(replace(replace(replace(
  text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'), chr(173), ''),
  '‐‑‒–—―−', '-------'), '[\s\x{00A0}\x{2007}\x{202F}]+', ' ', 'g'))) AS text
FROM documents""")
def _(t):
    return t.documents.select("doc_id", canonical_text(F.col("text")).alias("text"))


@query("b2_quantise", """
SELECT l_orderkey, l_linenumber, l_partkey, round(round_even(l_extendedprice / 0.25, 0) * 0.25, 4) AS price,
  round(round_even(l_discount / 0.1, 0) * 0.1, 4) AS discount FROM lineitem""")
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")
    )
    return L.quantise_columns(L.quantise_columns(rows, ["price"], 0.25), ["discount"], 0.1)


@query("b3_encode_faces", r"""
SELECT doc_id, ord, lower(regexp_replace(font, '^[A-Z]{6}\+(.+)$', '\1')) AS face,
  dense_rank() OVER (PARTITION BY doc_id ORDER BY lower(regexp_replace(font, '^[A-Z]{6}\+(.+)$', '\1'))) - 1 AS font_no,
  dense_rank() OVER (PARTITION BY doc_id ORDER BY size) - 1 AS size_bucket
FROM v_runs""")
def _(t):
    return L.encode_faces(t.runs).select("doc_id", "ord", "face", "font_no", "size_bucket")


GUTTERS = """
pts AS (SELECT doc_id, page, p, count(*) AS n FROM (
    SELECT doc_id, page, unnest(range(x, x + width)) AS p FROM v_full_runs
    WHERE width > 0 AND y >= 792 * 0.06 AND y <= 792 * 0.94 AND NOT (x >= 612 * 0.93 OR x + width <= 612 * 0.07)) GROUP BY ALL),
bounds AS (SELECT doc_id, page, min(x) AS lo, max(x + width) AS hi FROM v_full_runs GROUP BY ALL),
covered AS (SELECT doc_id, page, p, lead(p) OVER (PARTITION BY doc_id, page ORDER BY p) AS nxt FROM pts WHERE n > 2),
gut AS (SELECT doc_id, page, p + 1 AS gutter_left, nxt AS gutter_right,
    row_number() OVER (PARTITION BY doc_id, page ORDER BY p) AS gutter_no
  FROM covered JOIN bounds USING (doc_id, page) WHERE nxt - p - 1 >= 8 AND p + 1 > lo AND nxt < hi)
"""


@query("b4_page_gutters", f"WITH {GUTTERS} SELECT doc_id, page, gutter_no, gutter_left, gutter_right FROM gut")
def _(t):
    return L.page_gutters(t.full_runs)


@query("b5_doc_layouts", f"""
WITH {GUTTERS},
shaped AS (SELECT *, page % 2 AS parity, count(*) OVER (PARTITION BY doc_id, page) + 1 AS n_cols FROM gut),
modes AS (SELECT doc_id, parity, n_cols, gutter_no, arg_min(gutter_right, [-n, gutter_right]) AS gutter FROM (
  SELECT doc_id, parity, n_cols, gutter_no, gutter_right, count(*) AS n FROM shaped GROUP BY ALL) GROUP BY ALL),
ok AS (SELECT doc_id, parity, n_cols, page FROM shaped JOIN modes USING (doc_id, parity, n_cols, gutter_no)
  GROUP BY ALL HAVING bool_and(abs(gutter_right - gutter) <= 4)),
sup AS (SELECT doc_id, parity, n_cols, count(*) AS n_pages FROM ok GROUP BY ALL HAVING count(*) >= 2),
wide AS (SELECT doc_id, parity, n_cols FROM (SELECT *, gutter - lag(gutter) OVER (PARTITION BY doc_id, parity, n_cols ORDER BY gutter_no) AS s FROM modes)
  GROUP BY ALL HAVING coalesce(min(s), 612) >= 0.15 * 612),
ends AS (SELECT doc_id, parity, n_cols, gutter_no, list_sort(list(gutter_left)) AS e FROM shaped JOIN ok USING (doc_id, parity, n_cols, page) GROUP BY ALL)
SELECT doc_id, parity, n_cols, gutter_no, gutter, e[least(len(e), len(e) // 2 + 1)] AS column_end, n_pages
FROM modes JOIN sup USING (doc_id, parity, n_cols) JOIN wide USING (doc_id, parity, n_cols) JOIN ends USING (doc_id, parity, n_cols, gutter_no)""")
def _(t):
    return L.doc_layouts(L.page_gutters(t.full_runs))


@query("b7_assign_column", f"""
WITH {GUTTERS}
SELECT r.doc_id, r.page, r.ord, count(g.gutter_right) AS "column"
FROM v_full_runs r LEFT JOIN gut g ON g.doc_id = r.doc_id AND g.page = r.page AND r.x >= g.gutter_right - 2
GROUP BY r.doc_id, r.page, r.ord""")
def _(t):
    runs = t.full_runs
    return L.assign_column(runs, L.page_gutters(runs)).select("doc_id", "page", "ord", F.col("column").cast("long"))


@query("b8_reading_order", """
SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, col, floor((792 - y) / 2), x, ord) AS place
FROM v_full_runs""")
def _(t):
    return L.reading_order(t.full_runs).select("doc_id", "page", "ord", F.col("place").cast("long"))


@query("b9_fingerprint", r"""
WITH f AS (SELECT *, lower(regexp_replace(font, '^[A-Z]{6}\+(.+)$', '\1')) AS face FROM v_full_runs),
m AS (SELECT doc_id, c AS columns FROM (SELECT doc_id, c, count(*) AS n FROM (
    SELECT doc_id, page, max(col) + 1 AS c FROM f GROUP BY ALL) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c) = 1)
SELECT doc_id, count(DISTINCT page) AS pages, min(x) AS "left", max(x + width) AS "right", min(y) AS bottom, max(y + size) AS top,
  any_value(columns) AS columns, string_agg(DISTINCT face, ',' ORDER BY face) AS fonts,
  array_to_string(list_sort(list(DISTINCT size)), ',') AS sizes
FROM f JOIN m USING (doc_id) GROUP BY doc_id""")
def _(t):
    return L.fingerprint(t.full_runs)


@query("b10_body_style", r"""
SELECT doc_id, style, chars FROM (
  SELECT doc_id, lower(regexp_replace(font, '^[A-Z]{6}\+(.+)$', '\1')) || '|' || size || '|' || weight AS style,
    sum(length(text))::BIGINT AS chars FROM v_full_runs WHERE weight = 'normal' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, style) = 1""")
def _(t):
    return L.body_style(t.full_runs)


@query("b11_margin_bands", """
WITH h AS (SELECT doc_id, floor(y / 792 / 0.005)::BIGINT AS b, count(*) AS n FROM v_full_runs WHERE trim(text) <> '' GROUP BY ALL),
pg AS (SELECT doc_id, count(DISTINCT page) AS pages FROM v_full_runs GROUP BY ALL),
zone AS (SELECT doc_id, pages, side, b FROM pg, (SELECT 0 AS side, unnest(range(0, 13)) AS b UNION ALL SELECT 1, unnest(range(187, 200))) s),
spine AS (SELECT doc_id, pages, side, b, coalesce(n, 0) AS n FROM zone LEFT JOIN h USING (doc_id, b)),
peak AS (SELECT doc_id, side, b AS pb, n AS pn, pages FROM spine WHERE b NOT IN (12, 187)
  QUALIFY row_number() OVER (PARTITION BY doc_id, side ORDER BY n DESC, CASE side WHEN 0 THEN b ELSE -b END) = 1),
gap AS (SELECT doc_id, min(CASE WHEN side = 0 AND b >= pb THEN b END) AS lo, max(CASE WHEN side = 1 AND b <= pb THEN b END) AS hi
  FROM spine JOIN peak USING (doc_id, side) WHERE pn >= 0.5 * peak.pages AND n < 0.02 * pn GROUP BY ALL)
SELECT doc_id, round(coalesce(lo * 0.005, 0)::DOUBLE, 4) AS bottom, round(coalesce((hi + 1) * 0.005, 1)::DOUBLE, 4) AS top
FROM pg LEFT JOIN gap USING (doc_id)""")
def _(t):
    return L.margin_bands(t.full_runs)


LINES = """
lined AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, col ORDER BY y DESC, x, ord)::BIGINT AS line
  FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page, col ORDER BY y DESC, x, ord) - y AS d FROM v_full_runs))
"""


@query("b12_group_lines", f"WITH {LINES} SELECT doc_id, page, ord, line FROM lined")
def _(t):
    return L.group_lines(t.full_runs).select("doc_id", "page", "ord", "line")


@query("b13_line_text", f"""
WITH {LINES},
p AS (SELECT *, x - lag(x + width) OVER w AS gap, lag(size) OVER w AS ps, lag(text) OVER w AS pt FROM lined
  WINDOW w AS (PARTITION BY doc_id, page, col, line ORDER BY x, ord))
SELECT doc_id, page, col, line, max(y) AS y, trim(regexp_replace(string_agg(CASE WHEN gap > 0.15 * greatest(size, ps)
    OR (regexp_matches(pt, '[,.:;!?]$') AND regexp_matches(text, '^\\p{{L}}'))
    OR (size > 1.2 * ps AND regexp_matches(text, '^\\p{{Lu}}') AND regexp_matches(pt, '\\p{{Ll}}$'))
  THEN ' ' ELSE '' END || text, '' ORDER BY x, ord), '\\s+', ' ', 'g')) AS text
FROM p GROUP BY ALL""")
def _(t):
    return L.line_text(L.group_lines(t.full_runs)).select("doc_id", "page", "col", "line", "y", "text")


@query("b14_line_cells", f"""
WITH {LINES},
c AS (SELECT *, sum(CASE WHEN gap > (CASE WHEN pw <> weight THEN 0.6 ELSE 1.2 END) * size THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, page, col, line ORDER BY x, ord)::BIGINT AS cell
  FROM (SELECT *, x - lag(x + width) OVER w AS gap, lag(weight) OVER w AS pw FROM lined
    WINDOW w AS (PARTITION BY doc_id, page, col, line ORDER BY x, ord)))
SELECT doc_id, page, col, line, cell, min(x) AS x, max(x + width) AS "right", string_agg(text, ' ' ORDER BY x, ord) AS text
FROM c GROUP BY ALL""")
def _(t):
    return L.line_cells(L.group_lines(t.full_runs))


@query("b15_paragraphs", f"""
WITH {LINES},
l AS (SELECT doc_id, page, col, line, max(y) AS y, max(size) AS size FROM lined GROUP BY ALL)
SELECT doc_id, page, col, line, sum(CASE WHEN g IS NULL OR g > 1.2 * size THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id, page, col ORDER BY y DESC)::BIGINT AS para
FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page, col ORDER BY y DESC) - y AS g FROM l)""")
def _(t):
    rows = L.line_text(L.group_lines(t.full_runs))
    return L.paragraphs(rows, 1.2).select("doc_id", "page", "col", "line", "para")
