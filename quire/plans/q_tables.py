"""Queries of inventory F."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout as L, tables as T
from quire.plans.q_layout import LINES
from quire.plans.registry import query
from quire.sources.views import exploded

TLINES = LINES.replace("v_full_runs", "v_table_runs")
EDGES = f"""
{TLINES},
nl AS (SELECT doc_id, page, count(DISTINCT (col, line)) AS n_lines FROM lined GROUP BY ALL),
ed AS (SELECT doc_id, page, min(x) AS edge FROM lined JOIN nl USING (doc_id, page) GROUP BY doc_id, page, x // 8, n_lines HAVING count(DISTINCT (col, line)) >= 0.3 * n_lines)
"""
HEADS = "hd AS (SELECT table_id, row_no, col_no, text FROM v_cells WHERE row_no = -1)"


def heads(t):
    return t.cells.where("row_no = -1").select("table_id", "row_no", "col_no", "text")


def table_lines(t):
    return L.group_lines(t.table_runs)


@query("f1_column_edges", f"WITH {EDGES} SELECT doc_id, page, edge FROM ed")
def _(t):
    return T.column_edges(table_lines(t))


@query("f2_aligned_tables", f"""
WITH {EDGES},
wide AS (SELECT doc_id, page FROM ed GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT doc_id, page, line, cell, string_agg(text, ' ' ORDER BY x, ord) AS text, bool_and(weight = 'bold') AS bold FROM (
  SELECT l.*, (SELECT arg_min(e.edge, [abs(e.edge - l.x), e.edge]) FROM ed e WHERE e.doc_id = l.doc_id AND e.page = l.page) AS cell FROM lined l JOIN wide USING (doc_id, page)) GROUP BY ALL),
r AS (SELECT doc_id, page, line, count(*) AS n, bool_and(bold) AS bold FROM c GROUP BY ALL HAVING count(*) >= 2),
i AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line)::BIGINT AS table_no
  FROM (SELECT *, line - lag(line) OVER (PARTITION BY doc_id, page ORDER BY line) AS g FROM r)),
s AS (SELECT i.doc_id, i.page, table_no, min(CASE WHEN i.bold THEN i.line END) AS hl FROM i JOIN c USING (doc_id, page, line) GROUP BY ALL HAVING count(DISTINCT i.line) >= 3 AND median(length(c.text)) <= 24)
SELECT doc_id, page, table_no, line, coalesce(line = hl, false) AS is_header, n FROM i JOIN s USING (doc_id, page, table_no)""")
def _(t):
    lined = table_lines(t)
    return T.aligned_tables(lined, T.column_edges(lined))


@query("f3_assign_cells", f"""
WITH {EDGES}
SELECT doc_id, page, line, col_no, string_agg(text, ' ' ORDER BY x, ord) AS text, bool_and(weight = 'bold') AS bold FROM (
  SELECT l.*, (SELECT arg_min(e.i, [abs(e.edge - l.x), e.i]) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY edge) - 1 AS i FROM ed) e WHERE e.doc_id = l.doc_id AND e.page = l.page) AS col_no
  FROM lined l SEMI JOIN ed USING (doc_id, page)) GROUP BY ALL""")
def _(t):
    lined = table_lines(t)
    return T.cell_text(T.assign_cells(lined, T.column_edges(lined), ["doc_id", "page"]), ["doc_id", "page", "line"])


CAPS = """
cl AS (SELECT o_custkey AS doc_id, o_orderkey // 1000 AS page, o_orderkey AS ord, 'Table ' || (o_orderkey % 7) AS num,
  CASE o_orderkey % 4 WHEN 0 THEN 'Table ' || (o_orderkey % 7) || ': ' || o_orderpriority WHEN 1 THEN 'Table ' || (o_orderkey % 7)
    WHEN 2 THEN 'see Table ' || (o_orderkey % 7) || ': ' || o_orderpriority || '. More' ELSE o_orderpriority END AS text FROM orders)
"""


def caption_lines(t):
    text = F.expr("""case o_orderkey % 4 when 0 then concat('Table ', o_orderkey % 7, ': ', o_orderpriority) when 1 then concat('Table ', o_orderkey % 7)
        when 2 then concat('see Table ', o_orderkey % 7, ': ', o_orderpriority, '. More') else o_orderpriority end""")
    return t.orders.select(F.col("o_custkey").alias("doc_id"), F.expr("o_orderkey div 1000").alias("page"), F.col("o_orderkey").alias("ord"), text.alias("text"))


@query("f4_captions", rf"""
WITH {CAPS},
c AS (SELECT *, regexp_extract(text, '^Table (\d+)', 1) AS number, regexp_extract(text, '^Table \d+: (.+)$', 1) AS title FROM cl WHERE text LIKE 'Table %'),
r AS (SELECT doc_id, page, ord, regexp_extract(text, 'Table (\d+)', 1) AS number, regexp_extract(text, 'Table \d+: ([^.]+)', 1) AS rt FROM cl WHERE text LIKE 'see %')
SELECT c.doc_id, c.page, c.ord, c.number, CASE WHEN title <> '' THEN title ELSE coalesce(
  (SELECT arg_min(rt, r.ord) FROM r WHERE r.doc_id = c.doc_id AND r.number = c.number AND r.page = c.page),
  (SELECT arg_min(rt, r.ord) FROM r WHERE r.doc_id = c.doc_id AND r.number = c.number), '') END AS title FROM c""")
def _(t):
    return T.captions(caption_lines(t)).select("doc_id", "page", "ord", "number", "title")


@query("f5_captioned_rows", """
WITH b AS (SELECT *, max(CASE WHEN tag IN ('h1', 'h2') THEN n END) OVER (PARTITION BY page_id ORDER BY n) AS caption_ord FROM v_blocks),
x AS (SELECT *, min(CASE WHEN tag = 'li' THEN n END) OVER (PARTITION BY page_id, caption_ord) AS cut FROM b)
SELECT x.page_id, x.n, x.caption_ord, h.text AS caption FROM x JOIN v_blocks h ON h.page_id = x.page_id AND h.n = x.caption_ord
WHERE x.tag NOT IN ('h1', 'h2') AND (cut IS NULL OR x.n < cut)""")
def _(t):
    blocks = t.blocks.withColumn("seg", F.floor(F.col("n") / 256))
    out = T.captioned_rows(blocks, ["page_id"], "seg", "n", F.col("tag").isin("h1", "h2"), F.col("tag") == "li")
    return out.select("page_id", "n", "caption_ord", "caption")


@query("f6_header_anchors", "SELECT table_id, row_no, 5 AS roles FROM v_cells WHERE text = 'Cost'")
def _(t):
    return T.header_anchors(t.cells)


@query("f7_anchor_rows", f"""
WITH {TLINES},
k AS (SELECT doc_id, page, line, max(y) AS y, max(CASE WHEN weight = 'bold' AND x = 54 THEN text END) AS key FROM lined GROUP BY ALL)
SELECT a.doc_id, a.page, a.line, coalesce((SELECT arg_min(b.key, [abs(b.y - a.y), -b.y]) FROM k b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.key IS NOT NULL), '') AS anchor FROM k a""")
def _(t):
    rows = table_lines(t).groupBy("doc_id", "page", "line").agg(
        F.max("y").alias("y"), F.max(F.when((F.col("weight") == "bold") & (F.col("x") == 54), F.col("text"))).alias("key")
    )
    return T.anchor_rows(rows, ["doc_id", "page"]).select("doc_id", "page", "line", F.coalesce("anchor", F.lit("")).alias("anchor"))


CONT = """
l AS (SELECT o_custkey AS doc_id, o_orderkey, 10000 - o_orderkey - (CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END) AS y, CASE WHEN o_orderpriority = '5-LOW' THEN 'low,' ELSE o_orderpriority END AS text FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, 10000 - o_orderkey - (CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END) ORDER BY o_orderkey) = 1)
"""


@query("f8_merge_continuations", f"""
WITH {CONT},
g AS (SELECT *, lag(y) OVER w - y AS gap, lag(text) OVER w AS pt FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY y DESC)),
c AS (SELECT doc_id, quantile_disc(gap, 0.1) AS lo, quantile_disc(gap, 0.9) AS hi FROM g GROUP BY ALL)
SELECT doc_id, o_orderkey, sum(CASE WHEN gap IS NULL OR NOT ((hi > 1.3 * lo AND gap <= (lo + hi) / 2) OR regexp_matches(pt, '[-,(]$')) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY y DESC)::BIGINT AS "row" FROM g JOIN c USING (doc_id)""")
def _(t):
    rows = t.orders.selectExpr(
        "o_custkey as doc_id", "o_orderkey", "10000 - o_orderkey - if(o_orderstatus = 'F', 3, 0) as y", "if(o_orderpriority = '5-LOW', 'low,', o_orderpriority) as text"
    )
    # one row per height: two lines at one height are one printed line
    rows = rows.groupBy("doc_id", "y").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("text", "o_orderkey").alias("text"))
    return T.merge_continuations(rows, ["doc_id"]).select("doc_id", "o_orderkey", "row")


@query("f9_join_split_rows", """
WITH r AS (SELECT p_brand AS doc_id, p_partkey, -(p_partkey * 3) AS y, CASE WHEN p_size > 25 THEN [1, 2] ELSE [3] END AS f FROM part),
g AS (SELECT *, lag(y) OVER w - y AS gap, list_has_any(lag(f) OVER w, f) AS clash FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY y DESC))
SELECT doc_id, p_partkey, sum(CASE WHEN coalesce(gap < 0.8 * 90 AND NOT clash, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY y DESC)::BIGINT AS "row" FROM g""")
def _(t):
    rows = t.part.selectExpr("p_brand as doc_id", "p_partkey", "-(p_partkey * 3) as y", "90 as size", "if(p_size > 25, array(1, 2), array(3)) as figures")
    return T.join_split_rows(rows, ["doc_id"]).select("doc_id", "p_partkey", "row")


@query("f10_drop_repeated_headers", """
SELECT table_id, row_no, col_no, text FROM v_cells WHERE row_no = -1 OR (table_id, row_no) NOT IN (SELECT (table_id, row_no) FROM v_cells WHERE text = 'Cost')""")
def _(t):
    return T.drop_repeated_headers(t.cells, heads(t)).select("table_id", "row_no", "col_no", "text")


@query("f10_unpivot_sets", """
SELECT o_orderpriority AS table_id, o_orderkey AS row_no, u.i // 2 AS set_no, u.i % 2 AS col_no, CASE u.i WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderkey::VARCHAR ELSE o_orderstatus || '2' END AS text
FROM orders, unnest([0, 1, 2, 3]) u(i)""")
def _(t):
    cells = t.orders.selectExpr(
        "o_orderpriority as table_id", "o_orderkey as row_no",
        "posexplode(array(cast(o_custkey as string), o_orderstatus, cast(o_orderkey as string), concat(o_orderstatus, '2'))) as (col_no, text)",
    )
    heads_ = t.orders.select(F.col("o_orderpriority").alias("table_id")).distinct().selectExpr("table_id", "posexplode(array('Roll', 'Result', 'Roll', 'Result')) as (col_no, text)")
    return T.unpivot_sets(cells, heads_).select("table_id", "row_no", "set_no", "col_no", "text")


SECT = """
rw AS (SELECT table_id, page, row_no, bool_and(bold) AS bold, count(*) AS n, min(CASE WHEN col_no = 0 THEN text END) AS first FROM v_cells GROUP BY ALL),
sc AS (SELECT *, last_value(CASE WHEN bold AND n = 1 THEN first END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_no) AS section FROM rw)
"""


def section_rows(t):
    rows = t.cells.groupBy("table_id", "page", "row_no").agg(
        F.bool_and("bold").alias("bold"), F.count("*").alias("n"), F.min(F.when(F.col("col_no") == 0, F.col("text"))).alias("first")
    )
    return T.carry_sections(rows, ["table_id"], "page", ["row_no"], F.col("bold") & (F.col("n") == 1), F.col("first"))


@query("f11_carry_sections", f"WITH {SECT} SELECT table_id, row_no, coalesce(section, '') AS section FROM sc WHERE NOT (bold AND n = 1)")
def _(t):
    return section_rows(t).select("table_id", "row_no", F.coalesce("section", F.lit("")).alias("section"))


@query("f12_continue_tables", """
WITH p AS (SELECT DISTINCT o_custkey AS doc_id, o_orderkey // 100 AS page FROM orders),
q AS (SELECT *, 2 + page % 7 // 5 AS n_cols, CASE WHEN page % 4 = 0 THEN 'h' || page END AS header, CASE WHEN page % 4 = 0 THEN 'cap ' || page || ' (continued)' END AS caption FROM p),
o AS (SELECT *, CASE WHEN header IS NOT NULL OR lag(page) OVER w IS NULL OR page - lag(page) OVER w > 1 OR lag(n_cols) OVER w <> n_cols THEN 1 ELSE 0 END AS o FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
c AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY page)::BIGINT AS chain FROM o)
SELECT doc_id, page, chain, coalesce(first_value(header) OVER w, '') AS header, coalesce(replace(first_value(caption) OVER w, ' (continued)', ''), '') AS caption FROM c WINDOW w AS (PARTITION BY doc_id, chain ORDER BY page)""")
def _(t):
    parts = t.orders.select(F.col("o_custkey").alias("doc_id"), F.expr("o_orderkey div 100").alias("page")).distinct().selectExpr(
        "doc_id", "page", "2 + (page % 7) div 5 as n_cols", "case when page % 4 = 0 then concat('h', page) end as header",
        "case when page % 4 = 0 then concat('cap ', page, ' (continued)') end as caption",
    )
    return T.continue_tables(parts)


@query("f13_resolve_tables", """
WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
a AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, min(l_linestatus) AS table_no FROM lineitem GROUP BY ALL),
s AS (SELECT a.doc_id, a.table_no, count(*) AS n, count(c.ord) AS common FROM a LEFT JOIN c USING (doc_id, ord) GROUP BY ALL)
SELECT doc_id, ord, 'captioned' AS fate FROM c UNION ALL
SELECT a.doc_id, a.ord, CASE WHEN common = 0 THEN 'kept' ELSE 'fills' END FROM a JOIN s USING (doc_id, table_no) ANTI JOIN c ON c.doc_id = a.doc_id AND c.ord = a.ord WHERE common = 0 OR common >= 0.5 * n""")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), "l_returnflag", "l_linestatus")
    cap = rows.where("l_returnflag = 'A'").select("doc_id", "ord").distinct()
    ali = rows.groupBy("doc_id", "ord").agg(F.min("l_linestatus").alias("table_no"))
    return T.resolve_tables(cap, ali, ["doc_id"])


@query("f14_header_roles", """
SELECT p_partkey, h AS text, CASE WHEN h = 'Cost' THEN 'cost' WHEN h = 'Wt/Cost' THEN 'weight+cost' WHEN h = 'Name / Class' THEN 'name+type' ELSE '' END AS role
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Cost' WHEN 1 THEN 'Wt/Cost' WHEN 2 THEN 'Name / Class' ELSE p_type || '/Cost' END AS h FROM part)""")
def _(t):
    h = t.part.selectExpr("p_partkey", "case p_size % 4 when 0 then 'Cost' when 1 then 'Wt/Cost' when 2 then 'Name / Class' else concat(p_type, '/Cost') end as text")
    return T.header_roles(h).withColumn("role", F.coalesce("role", F.lit("")))


@query("f15_classify_tables", f"WITH {HEADS} SELECT table_id, 'gear' AS type, round(4 / 5, 6) AS score FROM hd WHERE col_no = 0")
def _(t):
    terms = [("gear", "weight", 1), ("gear", "cost", 2), ("weapon", "range", 1), ("weapon", "damage", 3), ("gear", "name", 1)]
    return T.classify_tables(heads(t), terms)


@query("f16_exclude_tables", r"""
WITH b AS (SELECT table_id FROM v_cells WHERE col_no = 0 GROUP BY ALL HAVING count(*) FILTER (regexp_matches(text, '^(red|small|blue)')) >= 0.3 * count(*))
SELECT table_id, row_no, col_no, text FROM v_cells ANTI JOIN b USING (table_id)""")
def _(t):
    return T.exclude_tables(t.cells, "^(red|small|blue)", 0.3).select("table_id", "row_no", "col_no", "text")


ROLED = """
rc AS (SELECT table_id, row_no, max(CASE WHEN col_no = 0 THEN text END) AS name, max(CASE WHEN col_no = 1 THEN text END) AS weight, max(CASE WHEN col_no = 2 THEN text END) AS cost,
  max(CASE WHEN col_no = 3 THEN text END) AS type, max(CASE WHEN col_no = 4 THEN text END) AS "range" FROM v_cells GROUP BY ALL)
"""


def recs(t):
    return T.records(t.cells, T.header_roles(heads(t)).where("role is not null"), ["name", "weight", "cost", "type", "range"])


@query("f17_records", f"WITH {ROLED} SELECT table_id, row_no, coalesce(name, '') AS name, coalesce(weight, '') AS weight, coalesce(cost, '') AS cost, coalesce(type, '') AS type, coalesce(\"range\", '') AS \"range\" FROM rc")
def _(t):
    return recs(t).na.fill("")


@query("f18_typed_cast", r"""
WITH l AS (SELECT table_id, row_no, CASE col_no WHEN 1 THEN 'weight' WHEN 2 THEN 'cost' ELSE 'range' END AS role, text AS raw FROM v_cells WHERE col_no IN (1, 2, 4)),
v AS (SELECT *, TRY_CAST(CASE role WHEN 'weight' THEN regexp_extract(raw, '^(\d+) kg$', 1) WHEN 'cost' THEN CASE WHEN regexp_matches(raw, '^[\d,]+$') THEN replace(raw, ',', '') END
  END AS DOUBLE) AS v, role = 'range' AND regexp_matches(raw, '^\d+(-\d+)?$') AS r FROM l)
SELECT table_id, row_no, role, coalesce(v, -1) AS value, CASE WHEN r THEN split_part(raw, '-', 1)::INT ELSE -1 END AS lo, CASE WHEN r THEN split_part(raw, '-', -1)::INT ELSE -1 END AS hi,
  raw <> '-' AND v IS NULL AND NOT r AS reject FROM v""")
def _(t):
    role = F.when(F.col("col_no") == 1, "weight").when(F.col("col_no") == 2, "cost").otherwise("range")
    long = t.cells.where("col_no in (1, 2, 4)").select("table_id", "row_no", role.alias("role"), F.col("text").alias("raw"))
    or_none = lambda c, none: F.coalesce(c, F.lit(none)).alias(c)
    return T.typed_cast(long).select("table_id", "row_no", "role", or_none("value", -1.0), or_none("lo", -1), or_none("hi", -1), "reject")


@query("f18_grades", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Very Rare' WHEN 1 THEN 'Scarce' WHEN 2 THEN 'Near Unique' WHEN 3 THEN 'Plentiful' ELSE '' END AS grade FROM part""")
def _(t):
    raw = F.expr("case p_size % 5 when 0 then 'VR' when 1 then 'scarce.' when 2 then 'Near Uni' when 3 then 'Plntfl' else p_name end")
    return t.part.select("p_partkey", F.coalesce(T.grade_of(raw), F.lit("")).alias("grade"))


@query("f19_route_records", """
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'unnamed' WHEN p_size % 6 = 1 THEN 'prose' WHEN p_size % 6 = 2 THEN 'broken' WHEN p_size % 10 = 0 THEN 'thin' ELSE 'record' END AS route,
  CASE p_size % 6 WHEN 0 THEN 'Plain' WHEN 1 THEN 'Some Plain Things of Many Kinds' WHEN 2 THEN 'Sold with the' ELSE 'Kinds of ' || p_brand END AS title
FROM (SELECT p_partkey, p_size, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS p_brand FROM part)""")
def _(t):
    name = "case p_size % 6 when 0 then 'plain' when 1 then 'Some plain things of many kinds' when 2 then 'Sold with the' else concat('Kinds of ', p_brand) end as name"
    rows = t.part.selectExpr("p_partkey", name, "array(p_type, if(p_size % 10 = 0, '-', 'x')) as cells")
    return T.route_records(rows).select("p_partkey", "route", T.title_case(F.col("name")).alias("title"))


@query("f20_fill_from_context", f"""
WITH {SECT}
SELECT c.table_id, c.row_no, CASE WHEN c.text <> '-' THEN c.text ELSE coalesce(section, 'cap ' || c.table_id) END AS value
FROM v_cells c JOIN sc USING (table_id, row_no) WHERE col_no = 1 AND NOT (sc.bold AND sc.n = 1)""")
def _(t):
    rows = section_rows(t).select("table_id", "row_no", "section").join(
        t.cells.where("col_no = 1").select("table_id", "row_no", F.col("text").alias("value")), ["table_id", "row_no"]
    ).withColumn("caption", F.concat(F.lit("cap "), "table_id"))
    return T.fill_from_context(rows, "value", "section", "caption").select("table_id", "row_no", "value")


@query("f21_roll_tables", """
WITH r AS (SELECT p_brand || '/' || p_type AS t, p_name, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS r FROM part),
n AS (SELECT t || '/' || r // 10 AS table_id, p_name, r % 10 + 1 AS n, count(*) OVER (PARTITION BY t, r // 10) AS m FROM r)
SELECT table_id, CASE WHEN 10 * m <= 10 THEN 10 WHEN 10 * m <= 20 THEN 20 ELSE 100 END AS die, 2 * n AS row_no, 10 * n - 9 AS lo, 10 * n AS hi,
  CASE WHEN n % 5 = 0 THEN p_name || ' on' ELSE p_name END AS outcome FROM n""")
def _(t):
    return T.roll_tables(t.roll_rows)


@query("f22_qualify_by_section", """
WITH q AS (SELECT p_brand FROM (SELECT p_brand, p_name, count(*) AS n, count(DISTINCT p_type) AS s FROM part GROUP BY ALL) GROUP BY ALL HAVING sum(CASE WHEN s > 1 THEN n ELSE 0 END) >= 0.5 * sum(n))
SELECT p_partkey, CASE WHEN q.p_brand IS NOT NULL THEN p_name || ' (' || p_type || ')' ELSE p_name END AS name FROM part LEFT JOIN q USING (p_brand)""")
def _(t):
    rows = t.part.select("p_partkey", F.col("p_brand").alias("table_id"), F.col("p_name").alias("name"), F.col("p_type").alias("section"))
    return T.qualify_by_section(rows).select("p_partkey", "name")


@query("f23_nest_profiles", """
WITH b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS modes, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY ALL)
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, m.v, 0) AS value, coalesce(modes, '') AS modes FROM customer LEFT JOIN m ON o_custkey = c_custkey""")
def _(t):
    base = t.customer.selectExpr("c_custkey", "concat('cust ', c_custkey) as name", "-1L as ord", "case when c_acctbal > 0 then c_acctbal end as value")
    modes = t.orders.selectExpr("o_custkey as c_custkey", "concat('cust ', o_custkey, ' (', o_orderpriority, ')') as name", "o_orderkey as ord", "o_totalprice as value")
    out = T.nest_profiles(base.unionByName(modes), ["c_custkey"], "ord", "value")
    names = F.array_join(F.transform("modes", lambda m: m["_label"]), ",")
    return out.select("c_custkey", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce(names, F.lit("")).alias("modes"))


@query("f24_named_results", """
WITH r AS (SELECT p_brand AS table_id, p_partkey AS row_no, CASE WHEN p_size > 25 THEN p_name || ': ' || p_type ELSE p_name END AS text FROM part),
ok AS (SELECT table_id FROM r GROUP BY ALL HAVING count(*) FILTER (text LIKE '%: %') >= 0.5 * count(*))
SELECT table_id, row_no, split_part(text, ': ', 1) AS name, split_part(text, ': ', 2) AS effect FROM r SEMI JOIN ok USING (table_id) WHERE text LIKE '%: %'""")
def _(t):
    return T.named_results(t.part.selectExpr("p_brand as table_id", "p_partkey as row_no", "if(p_size > 25, concat(p_name, ': ', p_type), p_name) as text"))


@query("f25_graded_map", """
SELECT p_brand, string_agg(p_type || '=' || v, ',' ORDER BY p_type) AS grades FROM (SELECT p_brand, p_type, min(p_name) AS v FROM part GROUP BY ALL) GROUP BY ALL""")
def _(t):
    out = T.graded_map(t.part, "p_brand", "p_type", "p_name")
    return out.select("p_brand", F.array_join(F.transform(F.map_entries("grades"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("grades"))


@query("f25_table_html", """
SELECT table_id, page, string_agg('<tr>' || r || '</tr>', '' ORDER BY row_no) AS html FROM (
  SELECT table_id, page, row_no, string_agg(CASE WHEN bold THEN '<th>' || text || '</th>' ELSE '<td>' || text || '</td>' END, '' ORDER BY col_no) AS r FROM v_cells GROUP BY ALL) GROUP BY ALL""")
def _(t):
    return T.table_html(t.cells)


@query("f26_progression", """
WITH c AS (SELECT conv_id, turn, role, length(text) AS n, max(CASE WHEN turn % 4 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS level FROM conversations)
SELECT conv_id, level, coalesce(string_agg(CASE WHEN role = 'user' THEN n::VARCHAR END, ' ' ORDER BY turn), '') AS "user", coalesce(string_agg(CASE WHEN role = 'assistant' THEN n::VARCHAR END, ' ' ORDER BY turn), '') AS assistant
FROM c WHERE level IS NOT NULL GROUP BY ALL""")
def _(t):
    rows = t.conversations.select(
        "conv_id", "turn", F.floor(F.col("turn") / 64).alias("seg"), F.when(F.col("turn") % 4 == 0, F.col("turn")).alias("level"),
        F.col("role").alias("column"), F.length("text").cast("string").alias("text"),
    )
    return T.progression(rows, ["conv_id"], "seg", "turn", ["user", "assistant"]).na.fill("", ["user", "assistant"])


LEVELED = """
c AS (SELECT p_partkey // 10 AS doc, p_partkey % 10 AS r, CASE WHEN p_partkey % 10 >= 5 THEN 276 ELSE 0 END AS dx, p_size, p_name, p_type, p_partkey FROM part),
cells AS (
  SELECT doc, r // 5 AS region, 2 * r AS line, 0 AS cell, 54 + dx AS x, 64 + dx AS "right", (r + 1) || 'th' AS text FROM c
  UNION ALL SELECT doc, r // 5, 2 * r, 1, 90 + dx + p_size % 7, 90 + dx + p_size % 7 + 5 * length(p_name), p_name FROM c
  UNION ALL SELECT doc, r // 5, 2 * r, 2, 240 + dx - 3 * (p_size % 4), 260 + dx - 3 * (p_size % 4), p_size::VARCHAR FROM c WHERE p_size % 5 > 0
  UNION ALL SELECT doc, r // 5, 2 * r + 1, 0, CASE WHEN p_partkey % 331 = 330 THEN 60 ELSE 92 END + dx, 92 + dx + 5 * length(p_type), p_type FROM c WHERE p_size % 3 = 0)
"""


@query("f26_level_columns", f"""
WITH {LEVELED},
n AS (SELECT doc, regexp_extract(text, '^([0-9]{{1,2}})(?:st|nd|rd|th)?$', 1)::INT AS level, min([region, line]) AS pos, arg_min(x, [region, line]) AS x, arg_min("right", [region, line]) AS r
  FROM cells WHERE cell = 0 AND regexp_matches(text, '^[0-9]{{1,2}}(st|nd|rd|th)?$') GROUP BY ALL),
k AS (SELECT *, min(good) OVER (PARTITION BY doc ORDER BY level) AS ok FROM (SELECT *, CASE WHEN row_number() OVER w = level AND coalesce(lag(pos) OVER w < pos, true) THEN 1 ELSE 0 END AS good FROM n WINDOW w AS (PARTITION BY doc ORDER BY level))),
a AS (SELECT doc, x AS anchor, r AS edge FROM k WHERE level = 1 AND ok = 1),
ln AS (SELECT l.doc, l.region, l.line, (SELECT arg_max({{'level': k.level, 'x': k.x, 'seg': k.pos[1]}}, k.level) FROM k WHERE k.doc = l.doc AND k.ok = 1 AND k.pos <= [l.region, l.line]) AS i,
  (SELECT arg_min({{'level': k.level, 'x': k.x, 'seg': k.pos[1]}}, k.level) FROM k WHERE k.doc = l.doc AND k.ok = 1 AND k.pos >= [l.region, l.line]) AS nx,
  EXISTS (SELECT 1 FROM k WHERE k.doc = l.doc AND k.ok = 1 AND k.pos = [l.region, l.line]) AS opens FROM (SELECT DISTINCT doc, region, line FROM cells) l),
p AS (SELECT cells.*, ln.i.level AS level, CASE WHEN ln.i.seg = region THEN ln.i.x WHEN ln.nx.seg = region THEN ln.nx.x END - anchor AS dx, edge, opens
  FROM cells JOIN ln USING (doc, region, line) JOIN a USING (doc) WHERE ln.i IS NOT NULL),
e AS (SELECT doc, min([region, line]) AS stop FROM p WHERE dx IS NULL OR (NOT opens AND x - dx <= edge) GROUP BY ALL),
pl AS (SELECT p.doc, level, line, p.x - dx AS x, "right" - dx AS "right", text FROM p LEFT JOIN e USING (doc) WHERE stop IS NULL OR [region, line] < stop),
st AS (SELECT doc, x, max("right") AS "right" FROM pl GROUP BY ALL),
sp AS (SELECT *, sum(CASE WHEN reach IS NULL OR x > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY x) - 1 AS col_no FROM (SELECT *, max("right") OVER (PARTITION BY doc ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM st)),
cols AS (SELECT doc, col_no, min(x) AS l, max("right") AS r FROM sp GROUP BY ALL),
hw AS (SELECT * FROM (VALUES (0, 50, 75, 'Level'), (0, 100, 120, 'Class'), (1, 100, 140, 'Features'), (1, 300, 320, 'Cost')) h(o, x, r, t)),
hc AS (SELECT doc, o, hw.x, t, arg_max(col_no, [CASE WHEN least(hw.r, cols.r) > greatest(hw.x, l) THEN least(hw.r, cols.r) - greatest(hw.x, l) ELSE -1e9 - abs((hw.x + hw.r) / 2 - (l + cols.r) / 2) END, -col_no]) AS col_no FROM hw, cols GROUP BY ALL),
hd AS (SELECT doc, col_no, string_agg(t, ' ' ORDER BY o, x) AS header FROM hc GROUP BY ALL)
SELECT pl.doc, level, sp.col_no::INT AS col_no, coalesce(any_value(header), '') AS header, string_agg(text, ' ' ORDER BY line, pl.x) AS text
FROM pl JOIN sp ON sp.doc = pl.doc AND sp.x = pl.x LEFT JOIN hd ON hd.doc = pl.doc AND hd.col_no = sp.col_no GROUP BY pl.doc, level, sp.col_no""")
def _(t):
    """Ten parts to a table of levels that goes on in the page's second column, some cells wrapped."""
    dx, r = "if(p_partkey % 10 >= 5, 276, 0)", "(p_partkey % 10)"
    cell = "named_struct('line', {line}, 'cell', {cell}, 'x', {x}, 'right', {right}, 'text', {text})".format
    cells = f"""concat(array({cell(line=f'2 * {r}', cell=0, x=f'54 + {dx}', right=f'64 + {dx}', text=f"concat({r} + 1, 'th')")},
            {cell(line=f'2 * {r}', cell=1, x=f'90 + {dx} + p_size % 7', right=f'90 + {dx} + p_size % 7 + 5 * length(p_name)', text='p_name')}),
        if(p_size % 5 > 0, array({cell(line=f'2 * {r}', cell=2, x=f'240 + {dx} - 3 * (p_size % 4)', right=f'260 + {dx} - 3 * (p_size % 4)', text='cast(p_size as string)')}), array()),
        if(p_size % 3 = 0, array({cell(line=f'2 * {r} + 1', cell=0, x=f'if(p_partkey % 331 = 330, 60, 92) + {dx}', right=f'92 + {dx} + 5 * length(p_type)', text='p_type')}), array()))"""
    rows = t.part.selectExpr("p_partkey div 10 as doc", f"{r} div 5 as region", f"explode({cells}) as c").select("doc", "region", "c.*").transform(exploded)
    words = [(0, 50, 75, "Level"), (0, 100, 120, "Class"), (1, 100, 140, "Features"), (1, 300, 320, "Cost")]
    structs = [F.struct(F.lit(o).alias("order"), F.lit(x).alias("x"), F.lit(e).alias("right"), F.lit(w).alias("text")) for o, x, e, w in words]
    heads = rows.select("doc").distinct().select("doc", F.explode(F.array(*structs)).alias("h")).select("doc", "h.*")
    return T.level_columns(rows, heads, ["doc"], "region", "line")


PARTED = """
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) AS one, tag IN ('h1', 'h2') AS cap, tag = 'b' AS hdr, tag = 'a' AS en FROM v_blocks)
"""


@query("f5_sub_tables", f"""
WITH {PARTED},
c AS (SELECT *, max(CASE WHEN cap THEN n END) OVER (PARTITION BY page_id ORDER BY n) AS caption_ord, coalesce(lag(hdr AND NOT cap) OVER (PARTITION BY page_id ORDER BY n), false) AS was FROM b),
d AS (SELECT *, sum(CASE WHEN hdr AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n) AS p FROM c),
x AS (SELECT *, min(CASE WHEN en THEN n END) OVER g AS stop, bool_or(hdr) OVER g AS headed FROM d WHERE caption_ord IS NOT NULL AND NOT cap WINDOW g AS (PARTITION BY page_id, caption_ord, p)),
parts AS (SELECT page_id, caption_ord, p, count(*) FILTER (stop IS NULL OR n < stop) - count(*) FILTER (hdr) AS records, count(*) FILTER (stop IS NOT NULL AND n >= stop) AS lead FROM x WHERE headed GROUP BY ALL),
v AS (SELECT *, min(good) OVER w AS ok, row_number() OVER w - 1 AS part FROM (SELECT *, CASE WHEN lag(lead) OVER w IS NULL OR (lag(lead) OVER w <= 3 AND records >= 2) THEN 1 ELSE 0 END AS good FROM parts WINDOW w AS (PARTITION BY page_id, caption_ord ORDER BY p))
  WINDOW w AS (PARTITION BY page_id, caption_ord ORDER BY p))
SELECT page_id, n, caption_ord, part::INT AS part, CASE WHEN hdr THEN 'header' ELSE 'row' END AS kind FROM x JOIN v USING (page_id, caption_ord, p) WHERE ok = 1 AND (stop IS NULL OR n < stop)""")
def _(t):
    """Headings as captions, bold lines as headers, links as what ends a table."""
    blocks = t.blocks.withColumn("seg", F.floor(F.col("n") / 64))
    tag = F.col("tag")
    out = T.sub_tables(blocks, ["page_id"], "seg", "n", tag.isin("h1", "h2"), tag == "b", tag == "a", ~tag.isin("b", "a"))
    return out.select("page_id", "n", "caption_ord", "part", "kind")


@query("f5_header_paths", """
WITH h AS (
  SELECT DISTINCT p_brand AS table_id, 0 AS level, 100 AS x, 400 AS r, p_brand AS text FROM part
  UNION ALL SELECT DISTINCT p_brand, 1, 100 + 60 * (p_size % 2), 160 + 60 * (p_size % 2) + 100 * (p_size // 26), 'G' || (p_size % 2) || (p_size // 26) FROM part WHERE p_size % 11 < 2
  UNION ALL SELECT p_brand, 2, 102 + 30 * (p_size % 10), 126 + 30 * (p_size % 10), min(p_type) FROM part GROUP BY p_brand, p_size % 10),
low AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.table_id = a.table_id AND a.x <= b.x + 2 AND a.r >= b.r - 2 AND a.level < b.level)),
up AS (SELECT o.table_id, o.x, o.r, o.level AS own, o.text AS t, a.level, a.text, row_number() OVER (PARTITION BY o.table_id, o.x, o.r, o.level, o.text, a.level ORDER BY a.r - a.x, a.x) AS rk
  FROM low o LEFT JOIN h a ON a.table_id = o.table_id AND a.x <= o.x + 2 AND a.r >= o.r - 2 AND a.level < o.level)
SELECT table_id, (row_number() OVER (PARTITION BY table_id ORDER BY x, r, own, t) - 1)::INT AS col_no, x, r AS "right", coalesce(string_agg(text, ' > ' ORDER BY level) || ' > ', '') || t AS path
FROM up WHERE rk = 1 GROUP BY table_id, x, r, own, t""")
def _(t):
    """A brand over groups of sizes over types."""
    part = t.part
    top = part.select(F.col("p_brand").alias("table_id"), F.lit(0).alias("level"), F.lit(100).alias("x"), F.lit(400).alias("right"), F.col("p_brand").alias("text")).distinct()
    mid = part.where("p_size % 11 < 2").selectExpr("p_brand as table_id", "1 as level", "cast(100 + 60 * (p_size % 2) as int) as x", "cast(160 + 60 * (p_size % 2) + 100 * (p_size div 26) as int) as right", "concat('G', p_size % 2, p_size div 26) as text").distinct()
    low = part.groupBy(F.col("p_brand").alias("table_id"), F.expr("p_size % 10").alias("k")).agg(F.min("p_type").alias("text")).selectExpr("table_id", "2 as level", "cast(102 + 30 * k as int) as x", "cast(126 + 30 * k as int) as right", "text")
    out = T.header_paths(top.unionByName(mid).unionByName(low), ["table_id"])
    return out.withColumn("path", F.array_join("path", " > "))


BOUNDS = """
h AS (SELECT DISTINCT doc_id, x + 4 AS x, (x - 54) // 90 AS col_no FROM v_table_runs WHERE text IN ('Name', 'Wt', 'Cost', 'Type', 'Range') AND weight = 'bold'),
m AS (SELECT doc_id, (x - 54) // 90 AS col_no, x, count(*) AS n FROM v_table_runs WHERE weight = 'normal' GROUP BY ALL),
e AS (SELECT h.doc_id, h.col_no, coalesce((SELECT arg_min(m.x, [-n, m.x]) FROM m WHERE m.doc_id = h.doc_id AND m.col_no = h.col_no), h.x) AS edge FROM h)
"""


def bounds(t):
    runs = t.table_runs.withColumn("col_no", F.expr("(x - 54) div 90"))
    named = runs.where("text in ('Name', 'Wt', 'Cost', 'Type', 'Range') and weight = 'bold'").selectExpr("doc_id", "x + 4 as x", "col_no").distinct()
    return T.boundaries(named, runs.where("weight = 'normal'"), ["doc_id"])


@query("f27_boundaries", f"WITH {BOUNDS} SELECT doc_id, col_no, edge FROM e")
def _(t):
    return bounds(t)


@query("f27_cut_runs", f"""
WITH {BOUNDS},
w AS (SELECT doc_id, page, ord, text || ' ' || text || ' ' || text || ' ' || text AS text, x, 5 * length(text || ' ' || text || ' ' || text || ' ' || text) AS width FROM v_table_runs WHERE weight = 'normal'),
i AS (SELECT w.*, list_sort(list_filter((SELECT list(edge) FROM e WHERE e.doc_id = w.doc_id), lambda q: q > x + 2 AND q < x + width - 2)) AS ins FROM w),
a AS (SELECT *, [0] || list_transform(ins, lambda q: round((q - x) * length(text) / width)::INT) || [length(text)] AS cuts FROM i)
SELECT doc_id, page, ord, k - 1 AS part, trim(substr(text, cuts[k] + 1, cuts[k + 1] - cuts[k])) AS text, CASE WHEN k = 1 THEN x ELSE ins[k - 1] END AS x,
  CASE WHEN k = len(cuts) - 1 THEN x + width ELSE ins[k] END - CASE WHEN k = 1 THEN x ELSE ins[k - 1] END AS width
FROM a, unnest(range(1, len(cuts))) u(k) WHERE k = 1 OR trim(substr(text, cuts[k] + 1, cuts[k + 1] - cuts[k])) <> ''""")
def _(t):
    wide = t.table_runs.where("weight = 'normal'").withColumn("text", F.concat_ws(" ", "text", "text", "text", "text")).withColumn("width", F.length("text") * 5)
    return T.cut_runs(wide, bounds(t), ["doc_id"]).select("doc_id", "page", "ord", "part", "text", "x", "width")
