"""Queries of inventories G and H."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import grids as H, layout as L, sections as G
from quire.plans.q_layout import LINES
from quire.plans.registry import query
from quire.session import cut_lineage

RLINES = LINES.replace("v_full_runs", "v_runs")
BODY = r"""
bs AS (SELECT doc_id, style FROM (SELECT doc_id, lower(regexp_replace(font, '^[A-Z]{6}\+(.+)$', '\1')) || '|' || size || '|' || weight AS style, sum(length(text)) AS c
  FROM v_runs WHERE weight = 'normal' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, style) = 1)
"""


def styled_lines(t):
    return L.line_text(L.group_lines(t.runs), fonts=True)


STYLED = rf"""
{RLINES}, {BODY},
sl AS (SELECT doc_id, page, col, line, max(y) AS y, max(size) AS size, string_agg(text, ' ' ORDER BY x, ord) AS text,
  lower(regexp_replace(arg_min(font, [x, ord]), '^[A-Z]{{6}}\+(.+)$', '\1')) || '|' || max(size) || '|' || arg_min(weight, [x, ord]) AS style FROM lined GROUP BY ALL)
"""


@query("g1_headings", rf"""
WITH {STYLED},
f AS (SELECT sl.*, coalesce(bs.style, '') AS body, length(text) <= 60 AND regexp_matches(text, '^[\p{{Pi}}\p{{Ps}}"'']*[\p{{Lu}}\p{{N}}]') AND NOT regexp_matches(text, '[.:,;!?]$') AND sl.style <> coalesce(bs.style, '') AS h1
  FROM sl LEFT JOIN bs USING (doc_id)),
fc AS (SELECT DISTINCT doc_id, style FROM f WHERE h1),
h AS (SELECT f.*, h1 OR (fc.style IS NOT NULL AND length(text) <= 60 AND regexp_matches(text, '\p{{Lu}}{{2}}') AND NOT regexp_matches(text, '\p{{Ll}}')) AS is_h FROM f LEFT JOIN fc USING (doc_id, style)),
w AS (SELECT *, sum(CASE WHEN coalesce(lag_h AND is_h AND lag_s = style AND lag_y - y <= 1.5 * size, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, col ORDER BY y DESC)::BIGINT AS heading_no
  FROM (SELECT *, lag(is_h) OVER z AS lag_h, lag(style) OVER z AS lag_s, lag(y) OVER z AS lag_y FROM h WINDOW z AS (PARTITION BY doc_id, page, col ORDER BY y DESC)))
SELECT doc_id, page, col, heading_no, string_agg(text, ' ' ORDER BY y DESC) AS heading, max(y) AS y, max(size) AS size FROM w WHERE is_h GROUP BY ALL""")
def _(t):
    return G.headings(styled_lines(t), L.body_style(t.runs))


@query("g2_chapter_titles", f"""
WITH {STYLED},
tp AS (SELECT doc_id, page, col, max(y) AS y FROM sl GROUP BY ALL)
SELECT sl.doc_id, page, col, line, y FROM sl JOIN bs USING (doc_id) JOIN tp USING (doc_id, page, col, y) WHERE size >= 1.2 * split_part(bs.style, '|', 2)::INT""")
def _(t):
    return G.chapter_titles(styled_lines(t), L.body_style(t.runs), 1.2).select("doc_id", "page", "col", "line", "y")


def leveled(t):
    return t.blocks.withColumn("seg", F.floor(F.col("n") / 64)), F.regexp_extract("tag", r"^h(\d)$", 1).try_cast("int")


@query("g3_section_path", """
WITH b AS (SELECT *, TRY_CAST(regexp_extract(tag, '^h([0-9])$', 1) AS INT) AS l FROM v_blocks),
a AS (SELECT b.page_id, b.n, h.l, h.text, row_number() OVER (PARTITION BY b.page_id, b.n, h.l ORDER BY h.n DESC) AS rk, h.n AS hn FROM b JOIN b h ON h.page_id = b.page_id AND h.n <= b.n AND h.l IS NOT NULL),
k AS (SELECT * FROM a WHERE rk = 1),
v AS (SELECT * FROM k x WHERE hn < n AND NOT EXISTS (SELECT 1 FROM k y WHERE y.page_id = x.page_id AND y.n = x.n AND y.l < x.l AND y.hn > x.hn))
SELECT b.page_id, b.n, coalesce((SELECT string_agg(v.text, ' > ' ORDER BY v.l) FROM v WHERE v.page_id = b.page_id AND v.n = b.n), '') AS path FROM b""")
def _(t):
    blocks, level = leveled(t)
    out = G.section_path(blocks, ["page_id"], "seg", "n", level, "text")
    return out.select("page_id", "n", F.array_join("path", " > ").alias("path"))


@query("g3_size_path", """
WITH b AS (SELECT *, 36.0 - 6 * TRY_CAST(regexp_extract(tag, '^h([0-9])$', 1) AS INT) + (n % 3) * 0.25 AS size FROM v_blocks),
u AS (SELECT *, sum(CASE WHEN size IS NULL THEN length(trim(text)) ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n) AS upto FROM b),
h AS (SELECT *, coalesce(abs(size - lag(size) OVER w) < 0.4 AND upto - lag(upto) OVER w <= 2, false) AS alike FROM u WHERE size IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY n)),
c AS (SELECT *, alike AND coalesce(lag(alike) OVER w, false) AND coalesce(lag(alike, 2) OVER w, false) AS listed FROM h WINDOW w AS (PARTITION BY page_id ORDER BY n)),
above AS (SELECT b.page_id, b.n, c.n AS hn, c.text FROM b JOIN c ON c.page_id = b.page_id AND c.n < b.n
  WHERE NOT EXISTS (SELECT 1 FROM c k WHERE k.page_id = b.page_id AND k.n > c.n AND k.n <= b.n AND (c.listed OR c.size <= k.size + 0.4)))
SELECT page_id, n, coalesce(string_agg(above.text, ' > ' ORDER BY hn), '') AS path FROM b LEFT JOIN above USING (page_id, n) GROUP BY ALL""")
def _(t):
    """Heading tags as type sizes, those of one tag slightly apart."""
    blocks, level = leveled(t)
    blocks = blocks.withColumn("size", F.lit(36.0) - 6 * level + (F.col("n") % 3) * 0.25)
    rows = G.contents_lists(blocks, ["page_id"], "seg", "n", F.col("size"), "text")
    out = G.size_path(rows, ["page_id"], "seg", "n", F.col("size"), "text", F.col("listed"))
    return out.select("page_id", "n", F.array_join("path", " > ").alias("path"))


@query("g4_fields", r"""
WITH e AS (SELECT doc_id, quantile_disc("right", 0.9) AS edge FROM v_field_lines GROUP BY ALL),
l AS (SELECT f.*, regexp_extract(text, '^(\p{Lu}[\p{L} ]{1,30}): (.*)$', 1) AS label, "right" >= edge OR regexp_matches(text, '[,\-(]$') AS goes FROM v_field_lines f JOIN e USING (doc_id)),
o AS (SELECT *, sum(CASE WHEN lag_g AND label = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS field_no FROM (SELECT *, coalesce(lag(goes) OVER (PARTITION BY doc_id, page ORDER BY ord), false) AS lag_g FROM l))
SELECT doc_id, field_no, max(label) AS label, string_agg(CASE WHEN label <> '' THEN regexp_extract(text, '^(\p{Lu}[\p{L} ]{1,30}): (.*)$', 2) ELSE text END, ' ' ORDER BY ord) AS value FROM o GROUP BY ALL HAVING max(label) <> ''""")
def _(t):
    return G.fields(t.field_lines, ["doc_id"], "page", "ord")


@query("g5_entries", """
WITH b AS (SELECT *, max(CASE WHEN tag LIKE 'h_' THEN n END) OVER (PARTITION BY page_id ORDER BY n) AS ho FROM v_blocks)
SELECT page_id, ho AS heading_ord, max(CASE WHEN n = ho THEN text END) AS heading, coalesce(string_agg(CASE WHEN n <> ho THEN text END, chr(10) ORDER BY n), '') AS body FROM b WHERE ho IS NOT NULL GROUP BY ALL""")
def _(t):
    blocks = t.blocks.withColumn("seg", F.floor(F.col("n") / 64))
    return G.entries(blocks, ["page_id"], "seg", "n", F.col("tag").rlike("^h.$"))


@query("g6_split_beside", """
WITH bx AS (SELECT doc_id, page, col, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y) AS y1 FROM v_full_runs WHERE length(text) > 11 GROUP BY ALL),
s AS (SELECT r.*, CASE WHEN r.y BETWEEN y0 AND y1 AND r.x >= x1 THEN 'right' WHEN r.y BETWEEN y0 AND y1 AND r.x + r.width <= x0 THEN 'left' END AS side FROM v_full_runs r LEFT JOIN bx USING (doc_id, page, col)),
v AS (SELECT doc_id, page, col, count(*) FILTER (side = 'right') AS r, count(*) FILTER (side = 'left') AS l FROM s GROUP BY ALL)
SELECT doc_id, page, ord, CASE WHEN coalesce(side = 'right' AND r >= l, false) THEN col + 0.5 ELSE col END::DOUBLE AS "column" FROM s JOIN v USING (doc_id, page, col)""")
def _(t):
    runs = t.full_runs
    boxes = runs.where("length(text) > 11").groupBy("doc_id", "page", "col").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max("y").alias("y1")
    )
    return G.split_beside(runs, boxes).select("doc_id", "page", "ord", "column")


@query("g7_learn_labels", """
WITH w AS (SELECT p_brand, p_partkey, p_name, split_part(p_name, ' ', 2) AS label FROM part),
l AS (SELECT p_brand, label FROM (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS t FROM (SELECT p_brand, label, count(*) AS n FROM w GROUP BY ALL)) WHERE n >= 3 AND n >= 0.15 * t)
SELECT p_partkey, CASE WHEN l.label IS NOT NULL THEN split_part(p_name, ' ', 1) ELSE p_name END AS name FROM w LEFT JOIN l USING (p_brand, label)""")
def _(t):
    rows = t.part.select("p_partkey", "p_brand", F.col("p_name").alias("name"))
    labels = G.learn_labels(rows, ["p_brand"], "name", 3, 0.15)
    return G.without_labels(rows, labels, ["p_brand"], "name").select("p_partkey", "name")


@query("g8_modal_sizes", """
WITH e AS (SELECT page_id, n, length(text) % 3 AS kind, 7 - regexp_extract(tag, '^h([0-9])$', 1)::INT AS size FROM v_blocks WHERE tag LIKE 'h_'),
m AS (SELECT kind, size AS modal FROM (SELECT kind, size, count(*) AS c FROM e GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY c DESC, size DESC) = 1),
p AS (SELECT e.*, size < modal AS is_part FROM e JOIN m USING (kind))
SELECT page_id, n, is_part, coalesce(CASE WHEN is_part THEN max(CASE WHEN NOT is_part THEN n END) OVER (PARTITION BY page_id ORDER BY n) END, -1) AS parent FROM p""")
def _(t):
    e = t.blocks.where("tag like 'h_'").selectExpr("page_id", "n", "n div 64 as seg", "length(text) % 3 as kind", "7 - cast(substr(tag, 2) as int) as size")
    out = G.part_of_parent(e, G.modal_sizes(e, "kind", "size"), "kind", ["page_id"], "seg", "n", "size")
    return out.select("page_id", "n", "is_part", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("g9_type_entries", """
SELECT page_id, n, CASE WHEN tag LIKE 'h_' THEN 'section' WHEN tag = 'li' AND length(text) < 12 THEN 'link' WHEN text LIKE '%.' THEN 'prose' ELSE 'other' END AS kind FROM v_blocks""")
def _(t):
    rules = [(F.col("tag").rlike("^h.$"), "section"), ((F.col("tag") == "li") & (F.length("text") < 12), "link"), (F.col("text").endswith("."), "prose"), (F.lit(True), "other")]
    return G.type_entries(t.blocks, rules).select("page_id", "n", "kind")


@query("g10_sibling_types", """
WITH e AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_size > 30 THEN p_type END AS kind FROM part),
v AS (SELECT p_brand, p_name, min(kind) AS k FROM e WHERE kind IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT kind) = 1)
SELECT p_partkey, coalesce(kind, k, '') AS kind FROM e LEFT JOIN v USING (p_brand, p_name)""")
def _(t):
    e = t.part.select("p_partkey", "p_brand", "p_name", F.expr("case when p_size > 30 then p_type end").alias("kind"))
    return G.sibling_types(e, ["p_brand", "p_name"]).select("p_partkey", F.coalesce("kind", F.lit("")).alias("kind"))


@query("g11_carry_forward", """
WITH e AS (SELECT *, max(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)
SELECT e.event_id, coalesce(CASE WHEN l.event_type = 'purchase' THEN l.value END, -1) AS in_force FROM e LEFT JOIN events l ON l.event_id = e.last""")
def _(t):
    rows = t.events.select("event_id", "user_id", "event_type", "value", F.floor(F.col("event_id") / 4096).alias("seg"))
    named = F.when(F.col("event_type") == "purchase", F.col("value"))
    out = G.carry_forward(rows, ["user_id"], "seg", "event_id", named, F.col("event_type") == "error")
    return out.select("event_id", F.coalesce("in_force", F.lit(-1.0)).alias("in_force"))


@query("g12_split_listed", r"""
SELECT doc_id, i - 1 AS item_no, items[i] AS item FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_split_to_array(text, '\s*[;\n]\s*') ELSE [text] END AS items FROM documents), unnest(range(1, len(items) + 1)) u(i) WHERE items[i] <> ''""")
def _(t):
    return G.split_listed(t.documents, ["doc_id"], F.col("lang") == "en")


@query("g13_label_pairs", """
SELECT event_id, event_type AS type, value::INT::VARCHAR AS val, user_id::VARCHAR AS usr FROM (SELECT event_id, event_type, floor(value) AS value, user_id FROM events)""")
def _(t):
    text = F.expr("concat('Type: ', event_type, ' Type Value: ', cast(floor(value) as string), ' User: ', user_id, ' Type: again')")
    rows = t.events.select("event_id", text.alias("text")).withColumn("m", G.label_pairs("text", ["Type", "Type Value", "User"]))
    return rows.selectExpr("event_id", "m['Type'] as type", "m['Type Value'] as val", "m['User'] as usr")


@query("g14_explode_list", """
SELECT p_partkey, p_name AS name, 3 AS count, 'a, b' AS note FROM part WHERE p_name <> p_type UNION ALL SELECT p_partkey, p_type, p_size, '' FROM part WHERE p_size > 0""")
def _(t):
    rows = t.part.select("p_partkey", F.expr("concat(p_name, ' x3 (a, b), ', p_type, ' x', p_size, ', ', p_name)").alias("text"))
    return G.explode_list(rows, ["p_partkey"], "text")


@query("g15_inline_profiles", """
SELECT p_partkey, 'Item ' || p_partkey AS name, p_size || ' kg' AS weight, p_size || '-' || (p_size + 5) AS "range" FROM part
UNION ALL SELECT p_partkey, 'Tool', '', '3-4' FROM part""")
def _(t):
    text = F.expr("concat('carries Item ', p_partkey, ' (', p_type, '; ', p_size, ' kg; ', p_size, '-', p_size + 5, ') and Tool (3-4; x) too (nothing)')")
    out = G.inline_profiles(t.part.select("p_partkey", text.alias("text")), ["p_partkey"], "text", {"weight": r"^\d+ kg$", "range": r"^\d+-\d+$"})
    return out.na.fill("")


@query("g16_amounts", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, key, (CASE key WHEN 'Size' THEN l_quantity::INT + 2 ELSE -l_linenumber END)::BIGINT AS amount
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL), unnest(['Size', 'Price']) u(key)""")
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    text = F.expr("concat('gains +', cast(l_quantity as int), ' Size and -', l_linenumber, ' Price, then +2 Size; +9 Size if tired. +4 Other')")
    rows = t.lineitem.groupBy(*keys).agg(F.min("l_quantity").alias("l_quantity"))
    return G.amounts(rows.select(*keys, text.alias("text")), keys, "text", ["Size", "Price"], unique=True)


@query("g17_gates", """
SELECT p_partkey, 'Size' AS key, p_size::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, 'text', 'Price 20 or Weight ' || p_size FROM part UNION ALL SELECT p_partkey, 'Price', '7' FROM part""")
def _(t):
    text = F.expr("concat('Size ', p_size, ', Price 20 or Weight ', p_size, ', Price 7+')")
    return G.gates(t.part.select("p_partkey", text.alias("text")), ["p_partkey"], "text", ["Size", "Price", "Weight"])


@query("g18_page_numbering", """
WITH pg AS (SELECT doc_id, max(page) AS hi, count(*) AS pages, 1 + doc_id % 7 AS "offset" FROM (SELECT DISTINCT doc_id, page FROM v_full_runs) GROUP BY doc_id HAVING count(*) >= 2)
SELECT doc_id, page, page + coalesce("offset", 1) AS printed FROM (SELECT DISTINCT doc_id, page FROM v_full_runs) LEFT JOIN pg USING (doc_id)""")
def _(t):
    runs = t.full_runs
    regions = G.page_numbering(runs, least=2, region=2)
    return G.printed_page(cut_lineage(runs.select("doc_id", "page").distinct()), regions)


@query("g19_cited_ranges", """
WITH c AS (SELECT DISTINCT p_brand AS book, u.page FROM part, unnest(range(p_size - 40, p_size - 36)) u(page) WHERE p_size > 40)
SELECT p_partkey, p_brand AS book, p_size AS page FROM part SEMI JOIN c ON c.book = p_brand AND c.page = p_size""")
def _(t):
    citing = t.part.select(F.col("p_brand").alias("book"), F.expr("if(p_size > 40, concat('see pages ', p_size - 40, '-', p_size - 37, '.'), p_name)").alias("text"))
    return G.cited_ranges(citing, t.part.select("p_partkey", F.col("p_brand").alias("book"), F.col("p_size").alias("page"))).select("p_partkey", "book", "page")


@query("h1_font_roles", """
WITH f AS (SELECT doc_id, font, size, count(*) AS n, count(*) FILTER (regexp_matches(text, '^[0-9]{1,3}$') AND weight = 'bold') AS nums FROM v_grid_runs GROUP BY ALL)
SELECT doc_id, arg_min(font || '|' || size, [(-n)::VARCHAR, font]) AS body, 12 AS grid_size FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font, size) = 1) GROUP BY doc_id""")
def _(t):
    return H.font_roles(t.grid_runs, ["doc_id"])


@query("h2_grids", """
SELECT p_partkey AS doc_id, p_name AS name, 'L0,L1,L2,L3,L4,L5,L6,L7,L8' AS labels, (SELECT string_agg(((p_partkey * (k + 3)) % 90 + 10)::VARCHAR, ',' ORDER BY k) FROM range(0, 9) r(k)) AS "values" FROM part WHERE p_size % 7 <> 0""")
def _(t):
    return H.grids(t.grid_runs).select("doc_id", "name", "labels", "values")


@query("h3_stat_rows", """
SELECT l_orderkey AS doc_id, i, (['Qty', 'Disc', 'Tax', 'Line'])[i + 1] AS label, (CASE i WHEN 0 THEN q WHEN 1 THEN 10 WHEN 2 THEN 7 ELSE n END)::INT AS value
FROM (SELECT l_orderkey, min(l_quantity)::INT AS q, count(*) AS n FROM lineitem GROUP BY ALL), unnest([0, 1, 2, 3]) u(i)""")
def _(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.min("l_quantity").cast("int").alias("q"), F.count("*").alias("n"))
    lines = rows.selectExpr(
        "l_orderkey as doc_id",
        """explode(array(named_struct('y', 100, 'xs', array(10, 40, 70, 100), 'texts', array('Qty', 'Disc', 'Tax', 'Line')),
              named_struct('y', 88, 'xs', array(11, 42, 69, 103), 'texts', array(cast(q as string), 'lO', '7', cast(n as string))))) as r""",
    ).select("doc_id", "r.*")
    return H.stat_rows(lines, ["doc_id"]).select("doc_id", "i", "label", "value")


STATS = ["Qty", "Disc", "Tax", "Line", "Part", "Supp", "Size"]


@query("h3_lattice_rows", f"""
WITH o AS (SELECT l_orderkey AS doc_id, min(l_quantity)::BIGINT AS q, count(*) AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
slots AS (SELECT *, k, 20 + 30 * k + (doc_id + 3 * k) % 5 - 2 AS c, CASE k WHEN 0 THEN q::VARCHAR WHEN 1 THEN 'lO' WHEN 4 THEN p::VARCHAR WHEN 5 THEN '-' ELSE ((doc_id * (k + 2)) % 97)::VARCHAR END AS t FROM o, range(0, 7) r(k)),
l AS (SELECT doc_id, k AS o, c::DOUBLE AS c FROM slots WHERE k <> doc_id % 7 AND k <> (doc_id // 7) % 7),
pairs AS (SELECT a.doc_id, (b.c - a.c) / (b.o - a.o) AS p, a.c - (b.c - a.c) / (b.o - a.o) * a.o AS b FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.o > a.o),
votes AS (SELECT doc_id, round(p, 6) AS p, round(b, 6) AS b, count(*) AS n, round(sum(abs(c - b - p * o)), 3) AS err
  FROM (SELECT pairs.*, l.c, l.o, row_number() OVER () AS r FROM pairs JOIN l USING (doc_id) WHERE p > 0 AND abs(c - b - p * o) <= 0.25 * p) GROUP BY doc_id, p, b),
best AS (SELECT * FROM votes WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, err, p, b) = 1),
v AS (SELECT s.doc_id, floor((s.c - 1 + (s.doc_id + s.k) % 3 - b.b) / b.p + 0.5)::INT AS i, s.c - 1 + (s.doc_id + s.k) % 3 AS x, b.b, b.p, t FROM slots s JOIN best b USING (doc_id)),
g AS (SELECT doc_id, i, string_agg(translate(t, 'IlOo', '1100'), '' ORDER BY x) AS t FROM v WHERE abs(x - b - p * i) <= 0.4 * p AND i BETWEEN 0 AND 6 GROUP BY ALL)
SELECT doc_id, i, ({STATS})[i + 1] AS label, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN t::INT ELSE 0 END AS value,
  NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = g.doc_id AND l.o = g.i) AS inferred FROM g""")
def _(t):
    """Seven labels a little off their places over values, one or two of the labels gone."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_quantity").cast("long").alias("q"), F.count("*").alias("n"), F.min("l_partkey").alias("p"))
    names = ", ".join(f"'{v}'" for v in STATS)
    slots = """transform(sequence(0, 6), k -> named_struct('k', k, 'c', 20 + 30 * k + (doc_id + 3 * k) % 5 - 2,
        't', case k when 0 then cast(q as string) when 1 then 'lO' when 4 then cast(p as string) when 5 then '-' else cast((doc_id * (k + 2)) % 97 as string) end))"""
    rows = rows.selectExpr("doc_id", f"{slots} as s").selectExpr("doc_id", "s", "filter(s, e -> e.k <> doc_id % 7 and e.k <> (doc_id div 7) % 7) as l")
    lines = rows.selectExpr("doc_id", f"""explode(array(named_struct('y', 100, 'xs', transform(l, e -> e.c), 'texts', transform(l, e -> array({names})[e.k])),
        named_struct('y', 88, 'xs', transform(s, e -> e.c - 1 + (doc_id + e.k) % 3), 'texts', transform(s, e -> e.t)))) as r""").select("doc_id", F.lit(0).alias("page"), "r.*")
    return H.lattice_rows(lines, ["doc_id", "page"], STATS).select("doc_id", "i", "label", "value", "inferred")


@query("h4_panel_blocks", """
SELECT p_brand AS doc_id, 2 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 + k AS block_no, CASE k WHEN 0 THEN 'Type' ELSE 'Price' END AS label,
  CASE k WHEN 0 THEN p_type ELSE trunc(p_retailprice)::BIGINT || CASE WHEN p_size % 3 = 0 THEN ',' ELSE '' END || ' sold with ' || p_name || ' Made for ' || p_name || ' users' END AS text
FROM part, unnest([0, 1]) u(k)""".replace("2 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 + k", "2 * dense_rank() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 + k"))
def _(t):
    return H.panel_blocks(t.field_lines, ["doc_id"], "page", "ord")


@query("h5_overlay_variants", """
WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT a.o_orderkey, a.s AS status, coalesce(arg_max(b.p, [b.day, b.o_orderkey]), '') AS priority
FROM o a LEFT JOIN o b ON b.o_custkey = a.o_custkey AND b.s <> 'P' AND b.day < a.day AND a.day - b.day <= 120 WHERE a.s = 'P' GROUP BY ALL""")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day"))
    variants = o.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "day", F.expr("map('status', o_orderstatus)").alias("values"))
    bases = o.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "day", F.expr("map('status', o_orderstatus, 'priority', o_orderpriority)").alias("values"))
    out = H.overlay_variants(variants, bases, ["o_custkey"], "day", "o_orderkey", 120)
    return out.selectExpr("o_orderkey", "values['status'] as status", "coalesce(try_element_at(values, 'priority'), '') as priority")


@query("h6_diagram", """
WITH f AS (SELECT doc_id, ord AS id, x, y FROM v_grid_runs WHERE size = 12), g AS (SELECT doc_id, ord AS id, x, y FROM v_grid_runs WHERE size = 6),
n AS (SELECT f.doc_id, f.id AS figure, g.id AS label, sqrt((f.x - g.x) ** 2 + (f.y - g.y) ** 2) AS d FROM f JOIN g ON f.doc_id = g.doc_id WHERE sqrt((f.x - g.x) ** 2 + (f.y - g.y) ** 2) <= 40),
a AS (SELECT doc_id, figure, label FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, figure ORDER BY d, label) = 1),
b AS (SELECT doc_id, figure, label FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY d, figure) = 1)
SELECT doc_id, figure, label FROM a JOIN b USING (doc_id, figure, label)""")
def _(t):
    part = lambda size: t.grid_runs.where(f"size = {size}").select("doc_id", F.col("ord").alias("id"), "x", "y")
    return H.diagram(part(12), part(6), 40, ["doc_id"])
