"""Queries of inventory A, and of the page regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import entities as N, layout as L, regions as R
from quire.plans.q_layout import LINES
from quire.plans.registry import query
from quire.sources import corpus as C, packs as P


@query("a1_of_version", "SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en'")
def _(t):
    docs = t.documents.withColumn("ir_version", F.when(F.col("lang") == "en", 2).otherwise(1))
    return C.of_version(docs, 2).select("doc_id", "source", "lang", "n_chars")


@query("a2_parse_tree", """
SELECT grp, count(*) AS docs, count(*) FILTER (event_type = 'error') AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE regexp_extract(props, '([0-9]+)', 1)::INT END)::BIGINT AS k
FROM (SELECT *, CASE user_id % 6 WHEN 0 THEN 'homebrew-x' WHEN 1 THEN '_draft' ELSE 'g' || user_id % 6 END AS grp FROM events) WHERE NOT regexp_matches(grp, '^(homebrew|_)') GROUP BY ALL""")
def _(t):
    path = F.expr("concat('root/', case user_id % 6 when 0 then 'homebrew-x' when 1 then '_draft' else concat('g', user_id % 6) end, '/', event_type, '/_source/', event_id, '.json')")
    value = F.expr("if(event_type = 'error', substr(props, 1, length(props) - 1), props)")
    rows = P.parse_tree(t.events.select(path.alias("path"), value.alias("value")))
    return rows.groupBy("grp").agg(
        F.count("*").alias("docs"), F.count_if("bad").alias("bad"), F.sum(F.coalesce(F.try_variant_get("doc", "$.k", "int"), F.lit(0))).alias("k")
    )


@query("a3_join_packs", """
SELECT n_name AS module, c_mktsegment AS pack, 'Item' AS type, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')""")
def _(t):
    packs = F.expr("array(named_struct('name', 'BUILDING', 'type', 'Item', 'path', 'packs/BUILDING'), named_struct('name', 'HOUSEHOLD', 'type', 'Item', 'path', 'packs/HOUSEHOLD'))")
    manifests = t.nation.select(F.col("n_name").alias("module"), packs.alias("packs"))
    lines = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("module"), F.concat(F.lit("packs/"), "c_mktsegment", F.lit(".db")).alias("file"), F.to_json(F.struct("c_custkey")).alias("value")
    )
    out = P.join_packs(manifests, lines)
    return out.select("module", "pack", "type", F.variant_get(F.parse_json("value"), "$.c_custkey", "long").alias("id"))


@query("a4_best_reading", """
SELECT DISTINCT md5(text) AS k, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END, source, doc_id) = 1""")
def _(t):
    docs = t.documents.select(F.md5("text").alias("k"), "source", "doc_id")
    return C.best_reading(docs, ["k"], "source", ["src3", "src1"]).select("k", "source")


@query("a5_sample_pages", "SELECT page_id, url FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT page_id, url FROM pages WHERE page_id BETWEEN 21 AND 29")
def _(t):
    p = t.pages.select("page_id", "url")
    return C.sample_pages(p, "page_id", every=10).unionByName(C.sample_pages(p, "page_id", between=(21, 29)))


@query("a6_pack_lines", """
SELECT p_brand AS pack, p_partkey AS id, '{"name":"' || p_name || '","size":' || p_size || ',"type":"' || p_type || '"}' AS value FROM part""")
def _(t):
    return P.pack_lines(t.part.select(F.col("p_brand").alias("pack"), F.col("p_partkey").alias("id"), F.expr("to_json(named_struct('type', p_type, 'size', p_size, 'name', p_name))").alias("doc")))


@query("a7_manifest", """
SELECT p_brand AS module, string_agg(pack || '=' || label || '=Item', ';' ORDER BY pack) AS packs FROM (
  SELECT DISTINCT p_brand, lower(p_type) || '-items' AS pack, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' Items' AS label FROM part) GROUP BY ALL""")
def _(t):
    packs = t.part.select(F.col("p_brand").alias("module"), F.concat(F.lower("p_type"), F.lit("-items")).alias("pack"), F.lit("Item").alias("type")).distinct()
    text = F.array_join(F.transform("packs", lambda p: F.concat_ws("=", p["pack"], p["label"], p["type"])), ";")
    return P.manifest(packs).select("module", text.alias("packs"))


@query("a7_module_manifest", """
WITH p AS (SELECT DISTINCT p_brand AS module, 'l' || right(p_brand, 1) AS line, CASE WHEN p_type LIKE 'S%' THEN 'x-' ELSE 'l' || right(p_brand, 1) || '-' END || lower(replace(p_type, ' ', '-')) || '-items' AS pack,
  CASE WHEN p_type LIKE 'S%' THEN '{"a":1}' END AS flags FROM part),
b AS (SELECT *, CASE WHEN starts_with(pack, line || '-') THEN substr(pack, length(line) + 2) ELSE pack END AS rest FROM p),
k AS (SELECT module, string_agg(pack || '=' || array_to_string(list_transform(list_filter(string_split(rest, '-'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') || '=packs/' || pack || '=' || coalesce(flags, ''), ';' ORDER BY pack) AS packs,
  string_agg(pack, ',' ORDER BY pack) AS folder FROM b GROUP BY module)
SELECT module, packs, folder, (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS s FROM part WHERE p_brand = k.module)) AS title FROM k""")
def _(t):
    line = "concat('l', right(p_brand, 1))"
    pack = f"concat(if(p_type like 'S%', 'x-', concat({line}, '-')), lower(replace(p_type, ' ', '-')), '-items')"
    packs = t.part.selectExpr("p_brand as module", f"{line} as line", f"{pack} as pack", "'Item' as type", """if(p_type like 'S%', '{"a":1}', null) as flags""").distinct()
    out = P.module_manifest(packs, t.part.selectExpr("p_brand as module", "split(p_name, ' ')[0] as source"), "1.0")
    text = F.array_join(F.transform("packs", lambda p: F.concat_ws("=", p["pack"], p["label"], p["path"], F.coalesce(p["flags"]["system"], F.lit("")))), ";")
    return out.select("module", text.alias("packs"), F.array_join("folder.packs", ",").alias("folder"), "title")


@query("a8_split_refused", "SELECT d.doc_id, coalesce(toxic = 1, false) AS refused FROM documents d LEFT JOIN labels USING (doc_id)")
def _(t):
    docs = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "toxic")
    ok, refused = C.split_refused(docs, F.col("toxic") == 1)
    return ok.select("doc_id", F.lit(False).alias("refused")).unionByName(refused.select("doc_id", F.lit(True).alias("refused")))


@query("b6_region_columns")
def _(t):
    runs = t.spanned_runs
    return R.region_columns(runs, R.own_layout(runs)).select("doc_id", "page", "ord", "column")


EDGES = """
starts AS (SELECT doc_id, page, col, floor(x + 0.5) AS start, count(*) AS n FROM v_spanned_runs WHERE col > 0 AND trim(text) <> '' GROUP BY ALL),
modal AS (SELECT doc_id, page, col, arg_min(start, [-n, start]) AS start FROM starts GROUP BY ALL),
votes AS (SELECT doc_id, start::DOUBLE AS start, count(*) AS pages FROM modal GROUP BY ALL),
strong AS (SELECT doc_id, start, pages FROM votes QUALIFY pages >= greatest(3, 0.05 * max(pages) OVER (PARTITION BY doc_id))),
ranked AS (SELECT doc_id, list(start ORDER BY pages DESC, start) AS s FROM strong GROUP BY ALL),
edges AS (SELECT doc_id, list_sort(list_reduce(s, lambda seen, x: CASE WHEN len(list_filter(seen, lambda k: abs(k - x) <= 3)) > 0 THEN seen ELSE list_append(seen, x) END, []::DOUBLE[])) AS e FROM ranked)"""


@query("b16_column_edges", f"""
WITH {EDGES},
every AS (SELECT doc_id FROM votes GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(list_transform(e, lambda x: x::BIGINT), ','), '') AS edges FROM every LEFT JOIN edges USING (doc_id)""")
def _(t):
    edges = R.column_edges(t.spanned_runs)
    return edges.select("doc_id", F.array_join(F.transform("edges", lambda e: e.cast("long").cast("string")), ",").alias("edges"))


@query("b16_cut_regions", f"""
WITH RECURSIVE {EDGES},
cut AS (
  SELECT doc_id, page, ord, x, y, width, size AS height, 'r' AS region, 0 AS depth, true AS open, coalesce(e, []) AS e FROM v_spanned_runs LEFT JOIN edges USING (doc_id)
  UNION ALL
  SELECT doc_id, page, ord, x, y, width, height, CASE WHEN kind IS NULL THEN region ELSE region || '.' || CASE WHEN kind = 0 THEN (CASE WHEN x >= edge - 2 THEN 1 ELSE 0 END)
      WHEN band < first THEN 0 WHEN band <= last THEN 1 ELSE 2 END END, depth + 1, kind IS NOT NULL, e
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, region, ord ORDER BY kind NULLS LAST, edge) AS rk
    FROM (SELECT *, CASE WHEN edge - l < 36 OR r - edge < 36 THEN NULL WHEN nc = 0 AND nr > 0 AND nr < n THEN 0 WHEN first > 1 OR last < bands THEN 1 END AS kind
      FROM (SELECT *, sum(c) OVER g AS nc, sum(CASE WHEN x >= edge - 2 THEN 1 ELSE 0 END) OVER g AS nr, count(*) OVER g AS n, min(x) OVER g AS l, max(x + width) OVER g AS r,
          min(CASE WHEN c = 1 THEN band END) OVER g AS first, max(CASE WHEN c = 1 THEN band END) OVER g AS last, max(band) OVER g AS bands
        FROM (SELECT *, CASE WHEN x < edge - 2 AND x + width > edge - 6 THEN 1 ELSE 0 END AS c
          FROM (SELECT *, unnest(CASE WHEN len(e) = 0 THEN [-1e9] ELSE e END) AS edge
            FROM (SELECT *, sum(CASE WHEN fl IS NULL OR y + height <= fl - 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, region ORDER BY y + height DESC, ord) AS band
              FROM (SELECT *, min(y) OVER (PARTITION BY doc_id, page, region ORDER BY y + height DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fl
                FROM cut WHERE open AND depth < 8))))
        WINDOW g AS (PARTITION BY doc_id, page, region, edge)))) WHERE rk = 1)
SELECT doc_id, page, ord, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY region) - 1)::INT AS region FROM cut WHERE NOT open OR depth = 8""")
def _(t):
    runs = t.spanned_runs.withColumn("height", F.col("size"))
    # what is written between passes has the geometry alone
    placed = runs.select("doc_id", "page", "ord", "x", "y", "width", "height")
    return R.cut_regions(placed, R.column_edges(runs)).select("doc_id", "page", "ord", "region")



@query("c6_drop_figures", rf"""
WITH {LINES.replace('v_full_runs', 'v_runs')},
l AS (SELECT doc_id, page, col, line, max(y) AS y, min(x) AS x, substr(string_agg(text, '' ORDER BY x, ord), 1, 1) AS style FROM lined GROUP BY ALL),
e AS (SELECT doc_id, page, col, x AS edge FROM (SELECT doc_id, page, col, x, count(*) AS n FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page, col ORDER BY n DESC, x) = 1),
o AS (SELECT l.*, abs(x - edge) > 2 AS f FROM l JOIN e USING (doc_id, page, col)),
g AS (SELECT *, lag(f) OVER w AS wf, lag(y) OVER w - y AS gap, lag(x) OVER w AS px FROM o WINDOW w AS (PARTITION BY doc_id, page, col ORDER BY y DESC)),
s AS (SELECT *, sum(CASE WHEN wf IS NULL OR wf <> f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, col ORDER BY y DESC)::BIGINT AS st FROM g),
b AS (SELECT doc_id, page, col, st FROM s WHERE f GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT style) >= 2 AND count(*) FILTER (wf = f AND abs(x - px) > 2) * 2 >= count(*) AND max(CASE WHEN wf = f THEN gap END) >= 1.0 * min(CASE WHEN wf = f THEN gap END))
SELECT doc_id, page, col, line, b.st IS NOT NULL AS figure FROM s LEFT JOIN b USING (doc_id, page, col, st)""")
def _(t):
    lines = L.line_text(L.group_lines(t.runs)).select("doc_id", "page", "col", "line", "y", "x", F.substr("text", F.lit(1), F.lit(1)).alias("style"))
    return R.figure_lines(lines, ["doc_id", "page", "col"], 3, 2, 2, 1.0).select("doc_id", "page", "col", "line", "figure")


@query("i15_branch_paths", """
WITH RECURSIVE b AS (SELECT DISTINCT p_brand AS owner, p_size // 10 + 1 AS level, p_brand || '-' || p_size AS box, p_size % 10 AS x FROM part),
par AS (SELECT c.owner, c.level, c.box, (SELECT arg_min(p.box, [abs(p.x - c.x), p.x]) FROM b p WHERE p.owner = c.owner AND p.level = c.level - 1) AS parent FROM b c),
pth AS (SELECT owner, level, box, box AS path FROM par WHERE parent IS NULL UNION ALL SELECT par.owner, par.level, par.box, pth.path || ' > ' || par.box FROM par JOIN pth ON par.owner = pth.owner AND par.parent = pth.box)
SELECT owner, level, box, path FROM pth""")
def _(t):
    ranks = t.part.selectExpr("p_brand as owner", "p_size div 10 + 1 as level", "concat(p_brand, '-', p_size) as box", "p_size % 10 as x").distinct()
    return N.branch_paths(ranks)


CHARTS = r"""
p AS (SELECT p_partkey // 100 AS doc_id, (p_partkey // 10) % 10 AS page, p_partkey % 10 AS k, p_size, p_name, p_type FROM part),
b AS (SELECT *, 60 + 150 * (k % 3) + 4 * (p_size % 9) AS bx, 700 - 120 * (k // 3) AS b_y, p_size % 5 = 0 AS eaten FROM p WHERE k < 9 OR p_size > 2),
r AS (
  SELECT doc_id, page, 10 * k AS ord, bx AS x, b_y AS y, 100 AS width, 9 AS size, 'Text' AS font, CASE WHEN eaten THEN 'Level: ' ELSE 'XP Level: ' END || format('{:,}', 700 * (k // 3)) || '-' || (700 * (k // 3) + 699) AS text FROM b
  UNION ALL SELECT doc_id, page, 10 * k + 1, bx + 10, b_y + 12, 60, 10, 'Head', p_name || CASE WHEN eaten THEN ' XP' ELSE '' END FROM b
  UNION ALL SELECT doc_id, page, 10 * k + 2, bx + 20, b_y + 24, 40, 10, 'Head', p_type FROM b WHERE p_size % 2 = 0
  UNION ALL SELECT doc_id, page, 10 * k + 3, bx + 10, b_y + 60, 60, 10, 'Head', 'far above' FROM b
  UNION ALL SELECT doc_id, page, 10 * k + 4, bx + 10, b_y + 10, 60, 9, 'Text', 'same face' FROM b),
w AS (SELECT DISTINCT t.doc_id, t.page, t.ord AS t, l.ord AS l FROM r t JOIN r l ON l.doc_id = t.doc_id AND l.page = t.page AND regexp_matches(t.text, '^(.*\p{L}.*?)\s+XP\s*$') AND regexp_matches(l.text, '(?i)^\s*level\s*:?\s*[0-9]')
  AND l.y < t.y AND t.y - l.y <= 4 * l.size AND abs(l.x - t.x) <= t.width),
f AS (SELECT r.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.doc_id = r.doc_id AND w.page = r.page AND w.t = r.ord) THEN regexp_extract(text, '^(.*\p{L}.*?)\s+XP\s*$', 1)
    WHEN EXISTS (SELECT 1 FROM w WHERE w.doc_id = r.doc_id AND w.page = r.page AND w.l = r.ord) THEN 'XP ' || trim(text) ELSE text END AS text) FROM r),
x AS (SELECT *, replace(regexp_extract(text, '(?i)^\s*XP(?:\s+level)?\s*:?\s*([0-9][0-9,]*)\s*(?:[-–—]|\+|to\b)', 1), ',', '') AS xp FROM f),
m AS (SELECT x.doc_id, x.page, x.ord, x.xp::BIGINT AS min_xp, x.x + x.width / 2 AS x, string_agg(trim(h.text), ' ' ORDER BY h.y DESC, h.x) AS title
  FROM x JOIN x h ON h.doc_id = x.doc_id AND h.page = x.page AND x.xp <> '' AND h.xp = '' AND h.font <> x.font AND regexp_matches(h.text, '\p{L}')
    AND h.y > x.y AND h.y <= x.y + 4 * x.size AND h.x + h.width / 2 BETWEEN x.x AND x.x + x.width GROUP BY ALL),
chart AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY min_xp) AS level FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, page) > 1)"""


def chart_runs(t):
    """Parts as charts of ranks, nine or ten boxes to a page, some titles with the XP of the line below."""
    b = t.part.selectExpr("p_partkey div 100 as doc_id", "(p_partkey div 10) % 10 as page", "p_partkey % 10 as k", "p_size", "p_name", "p_type").where("k < 9 or p_size > 2")
    b = b.selectExpr("*", "60 + 150 * (k % 3) + 4 * (p_size % 9) as bx", "700 - 120 * (k div 3) as b_y", "p_size % 5 = 0 as eaten", "700 * (k div 3) as xp")
    run = "named_struct('ord', 10 * k + {o}, 'x', bx + {x}, 'y', b_y + {y}, 'width', {w}, 'size', {s}, 'font', '{f}', 'text', {t})".format
    runs = f"""concat(array({run(o=0, x=0, y=0, w=100, s=9, f='Text', t="concat(if(eaten, 'Level: ', 'XP Level: '), format_number(xp, 0), '-', xp + 699)")},
        {run(o=1, x=10, y=12, w=60, s=10, f='Head', t="concat(p_name, if(eaten, ' XP', ''))")}, {run(o=3, x=10, y=60, w=60, s=10, f='Head', t="'far above'")},
        {run(o=4, x=10, y=10, w=60, s=9, f='Text', t="'same face'")}), if(p_size % 2 = 0, array({run(o=2, x=20, y=24, w=40, s=10, f='Head', t='p_type')}), array()))"""
    return b.selectExpr("doc_id", "page", f"explode({runs}) as r").select("doc_id", "page", "r.*")


@query("i15_rank_charts", f"WITH {CHARTS} SELECT doc_id, page, ord, title, min_xp, x, level FROM chart")
def _(t):
    return N.rank_charts(chart_runs(t)).select("doc_id", "page", "ord", "title", "min_xp", "x", F.col("level").cast("long").alias("level"))


@query("i15_chart_branches", f"""
WITH RECURSIVE {CHARTS},
bx AS (SELECT doc_id * 10 + page AS owner, level, title || '#' || ord AS box, x FROM chart),
par AS (SELECT c.owner, c.level, c.box, (SELECT arg_min(p.box, [abs(p.x - c.x), p.x]) FROM bx p WHERE p.owner = c.owner AND p.level = c.level - 1) AS parent FROM bx c),
pth AS (SELECT owner, level, box, box AS path FROM par WHERE parent IS NULL UNION ALL SELECT par.owner, par.level, par.box, pth.path || ' > ' || par.box FROM par JOIN pth ON par.owner = pth.owner AND par.parent = pth.box)
SELECT owner, level, box, path FROM pth""")
def _(t):
    """Branches of the charts, from boxes alone."""
    boxes = N.rank_charts(chart_runs(t)).select((F.col("doc_id") * 10 + F.col("page")).alias("owner"), F.col("level").cast("long").alias("level"), F.concat("title", F.lit("#"), F.col("ord").cast("string")).alias("box"), "x")
    return N.branch_paths(boxes)


@query("i20_drop_given", r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS name FROM documents)
SELECT name FROM w WHERE regexp_replace(regexp_replace(translate(name, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+', '', 'g'), 's$', '') NOT IN
  (SELECT regexp_replace(regexp_replace(translate(other, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+', '', 'g'), 's$', '') FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS other FROM benchmark))""")
def _(t):
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("name")).distinct()
    given = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("other"))
    return N.drop_given(words, given, "name", "other")
