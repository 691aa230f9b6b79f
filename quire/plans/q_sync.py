"""Queries of inventories J and K."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import editions as E, entities as N, score as S, sync as Y
from quire.plans.registry import query

KEYS = r"lang || '|' || lower(regexp_replace(trim(split_part(text, chr(10), 1)), '\s+', ' ', 'g'))"
KEYED = f"""
inc AS (SELECT doc_id, CASE WHEN n = 1 THEN b ELSE b || '#' || n END AS key, md5(text) AS source_hash
  FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS n FROM (SELECT *, {KEYS} AS b FROM documents))),
ex AS (SELECT doc_id, CASE WHEN lang = 'es' THEN NULL WHEN n = 1 THEN b ELSE b || '#' || n END AS key, source_hash, fingerprint, current_fingerprint
  FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS n FROM (SELECT *, {KEYS} AS b FROM v_imported))),
pl AS (SELECT coalesce(i.key, e.key) AS key, e.doc_id AS existing_id, i.source_hash, CASE WHEN e.key IS NULL THEN 'create'
    WHEN i.key IS NULL AND e.fingerprint <> e.current_fingerprint THEN 'conflict removed' WHEN i.key IS NULL THEN 'remove'
    WHEN i.source_hash = e.source_hash THEN 'unchanged' WHEN e.fingerprint <> e.current_fingerprint THEN 'conflict changed' ELSE 'replace' END AS action
  FROM inc i FULL JOIN (SELECT * FROM ex WHERE key IS NOT NULL) e ON i.key = e.key)
"""


def incoming(t):
    docs = t.documents.withColumn("line", F.split("text", "\n")[0])
    return Y.document_keys(docs, F.col("lang"), F.col("line"), "doc_id").select(
        F.col("doc_id").alias("id"), "key", F.col("line").alias("name"), F.md5("text").alias("source_hash")
    )


def existing(t):
    docs = t.imported.withColumn("line", F.split("text", "\n")[0])
    keyed = Y.document_keys(docs, F.col("lang"), F.col("line"), "doc_id")
    return keyed.select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") != "es", F.col("key")).alias("key"), F.col("line").alias("name"),
        "source_hash", "fingerprint", "current_fingerprint",
    )


@query("k1_document_keys", f"WITH {KEYED} SELECT doc_id AS id, key, source_hash FROM inc")
def _(t):
    return incoming(t).drop("name")


FINGER = """'name="' || p_name || '"' || chr(10) || 'system.description.value="The ' || p_name || ' of ' || p_brand || ' is sold by the piece, size ' || p_size || ' only."' || chr(10) ||
'system.notes=""' || chr(10) || 'system.price.e1=' || trunc(p_retailprice)::BIGINT || chr(10) || 'system.price.e2=' || (trunc(p_retailprice)::BIGINT + p_size) || chr(10) ||
'system.size=' || p_size || chr(10) || 'system.tags=["' || p_brand || '","' || p_type || '"]' || chr(10) || 'type="' || p_type || '"'"""


@query("k2_fingerprint_docs", f"SELECT p_partkey AS card_id, sha256({FINGER}) AS fingerprint FROM part")
def _(t):
    return Y.fingerprint_docs(t.cards).select("card_id", "fingerprint")


@query("k3_plan_import", f"WITH {KEYED} SELECT key, coalesce(existing_id, -1) AS existing_id, action FROM pl")
def _(t):
    return Y.plan_import(incoming(t), existing(t)).select("key", F.coalesce("existing_id", F.lit(-1)).alias("existing_id"), "action")


@query("k4_fresh_ids", """
WITH c AS (SELECT doc_id::VARCHAR AS key, substr(md5(text), 1, 16) AS id FROM documents WHERE lang <> 'de'),
u AS (SELECT DISTINCT substr(md5(text), 1, 16) AS id FROM v_imported)
SELECT key, CASE WHEN u.id IS NULL THEN c.id ELSE substr(sha256(c.id || '#' || key || '#1'), 1, 16) END AS new_id FROM c LEFT JOIN u ON u.id = c.id""")
def _(t):
    created = t.documents.where("lang <> 'de'").select(F.col("doc_id").cast("string").alias("key"), F.substr(F.md5("text"), F.lit(1), F.lit(16)).alias("id"))
    used = t.imported.select(F.substr(F.md5("text"), F.lit(1), F.lit(16)).alias("id"))
    return Y.fresh_ids(created, used).select("key", "new_id")


@query("k5_apply_plan", f"""
WITH {KEYED},
d AS (SELECT *, CASE WHEN action NOT LIKE 'conflict%' THEN action WHEN existing_id % 2 = 1 THEN 'keep' WHEN action = 'conflict changed' THEN 'replace' ELSE 'remove' END AS do FROM pl)
SELECT ex.doc_id AS id, coalesce(ex.key, '') AS key, CASE WHEN d.do = 'keep' THEN coalesce(d.source_hash, 'removal-kept') ELSE ex.source_hash END AS source_hash, current_fingerprint
FROM ex LEFT JOIN d ON d.key = ex.key WHERE ex.key IS NULL OR d.do NOT IN ('remove', 'replace')
UNION ALL
SELECT coalesce(d.existing_id, inc.doc_id), inc.key, inc.source_hash, inc.source_hash FROM d JOIN inc USING (key) WHERE d.do IN ('create', 'replace')""")
def _(t):
    inc, ex = incoming(t), existing(t)
    plan = Y.plan_import(inc, ex)
    asked = plan.where("action like 'conflict%' and existing_id % 2 = 0").select("key", F.lit("replace").alias("resolution"))
    return Y.apply_plan(ex, inc, plan, asked).select("id", F.coalesce("key", F.lit("")).alias("key"), "source_hash", "current_fingerprint")


REF_TEXT = "concat('See {{ref:', l_partkey, '} and {{ref:', l_suppkey * 1000, '}; also {{ref:', l_partkey, '}.')".replace("{{ref", "[ref").replace("}", "]")


@query("j3_resolve_refs", """
SELECT l_orderkey, l_linenumber, l_partkey, 'See ' || p1.p_brand || '.' || p1.p_partkey || ' and ' || coalesce(p2.p_brand || '.' || p2.p_partkey, '') || '; also ' || p1.p_brand || '.' || p1.p_partkey || '.' AS text,
  CASE WHEN p2.p_partkey IS NULL THEN 1 ELSE 0 END AS unresolved
FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) l JOIN part p1 ON p1.p_partkey = l_partkey LEFT JOIN part p2 ON p2.p_partkey = l_suppkey * 1000""")
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    docs = t.lineitem.groupBy(*keys).agg(F.min("l_suppkey").alias("l_suppkey")).select(*keys, F.expr(REF_TEXT).alias("text"))
    targets = t.part.select(F.col("p_partkey").cast("string").alias("ref"), F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("address"))
    return Y.replace_refs(docs, keys, r"\[ref:([0-9]+)\]", targets, F.lit("")).select(*keys, "text", "unresolved")


@query("k6_repoint_refs", """
SELECT page_id, html.text AS text FROM (SELECT o_orderkey AS page_id, 'Pack.' || o_custkey || ' then Pack.' || (o_custkey + 1000000) AS t, o_custkey FROM orders),
LATERAL (SELECT 'World.' || coalesce((SELECT c_nationkey || '-' || c_custkey FROM customer WHERE c_custkey = o_custkey), o_custkey::VARCHAR) || ' then World.' || (o_custkey + 1000000) AS text) html""")
def _(t):
    docs = t.orders.select(F.col("o_orderkey").alias("page_id"), F.expr("concat('Pack.', o_custkey, ' then Pack.', o_custkey + 1000000)").alias("text"))
    ids = t.customer.select(F.col("c_custkey").cast("string").alias("ref"), F.expr("concat('World.', c_nationkey, '-', c_custkey)").alias("address"))
    return Y.replace_refs(docs, ["page_id"], r"Pack\.([0-9]+)", ids, F.concat(F.lit("World."), "ref")).select("page_id", "text")


@query("j1_content_id", """
SELECT p_partkey AS card_id, substr(sha256(p_brand || chr(10) || '{"name":"' || p_name || '","system":{"description":{"value":"The ' || p_name || ' of ' || p_brand || ' is sold by the piece, size ' || p_size ||
  ' only."},"notes":"","price":{"e1":' || trunc(p_retailprice)::BIGINT || ',"e2":' || (trunc(p_retailprice)::BIGINT + p_size) || '},"size":' || p_size || ',"tags":["' || p_brand || '","' || p_type || '"]},"type":"' || p_type || '"}'), 1, 16) AS id
FROM part""")
def _(t):
    return E.content_id(t.cards, Y.VOLATILE).select("card_id", "id")


@query("j2_resolve_collisions", """
SELECT doc_id, CASE WHEN rn = 1 THEN h ELSE substr(sha256(source || chr(10) || text || chr(10) || doc_id), 1, 16) END AS id, rn > 1 AS collided
FROM (SELECT *, substr(sha256(source || chr(10) || text), 1, 16) AS h, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS rn FROM documents)""")
def _(t):
    docs = t.documents.select("doc_id", F.col("source").alias("pack"), F.col("text").alias("content"), F.col("doc_id").alias("ordinal"))
    docs = docs.withColumn("id", E.short_hash(F.concat_ws("\n", "pack", "content")))
    return E.resolve_collisions(docs).select("doc_id", "id", "collided")


GROUPS = """
g AS (SELECT lang, md5(text) AS k FROM documents GROUP BY ALL HAVING count(*) = count(DISTINCT source) AND count(*) >= 2),
m AS (SELECT d.*, md5(text) AS k FROM documents d JOIN g ON g.lang = d.lang AND g.k = md5(d.text))
"""


def grouped(t):
    docs = t.documents.select("doc_id", F.col("source").alias("edition"), "lang", F.md5("text").alias("k"), "n_chars")
    return E.edition_groups(docs, ["lang", "k"])


@query("j4_edition_groups", f"WITH {GROUPS} SELECT doc_id, source AS edition, k FROM m")
def _(t):
    return grouped(t).select("doc_id", "edition", "k")


@query("j5_merge_editions", f"""
WITH {GROUPS},
f AS (SELECT k, source AS edition, unnest([{{'field': 'chars', 'value': n_chars::VARCHAR}}, {{'field': 'doc', 'value': doc_id::VARCHAR}}, {{'field': 'tags', 'value': lang || ',' || source}}], recursive := true) FROM m)
SELECT k, field, max(edition) AS canonical, CASE WHEN field = 'tags' THEN
    (SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM (SELECT unnest(string_split(string_agg(value, ','), ',')) AS v))
  WHEN count(DISTINCT value) = 1 THEN min(value) ELSE string_agg(edition || ':' || value, ';' ORDER BY edition, value) END AS value
FROM f GROUP BY k, field""")
def _(t):
    rows = grouped(t).select(
        "k", "edition",
        F.explode(F.expr("""array(named_struct('field', 'chars', 'value', cast(n_chars as string)), named_struct('field', 'doc', 'value', cast(doc_id as string)),
            named_struct('field', 'tags', 'value', concat(lang, ',', edition)))""")).alias("f"),
    ).select("k", "edition", "f.*")
    return E.merge_editions(rows, ["k"], F.col("edition"), ["tags"])


@query("j5_merged_documents", f"""
WITH {GROUPS},
x AS (SELECT lang, k, '{{"name":"' || k || '","system":{{"chars":' || (CASE WHEN count(DISTINCT n_chars) = 1 THEN min(n_chars)::VARCHAR ELSE '{{' || string_agg('"' || source || '":' || n_chars, ',' ORDER BY source) || '}}' END)
    || ',"doc":{{' || string_agg('"' || source || '":' || doc_id, ',' ORDER BY source) || '}},"tags":["' || array_to_string(list_sort(list_distinct(flatten(list([lang, source])))), '","') || '"]}}}}' AS doc FROM m GROUP BY lang, k)
SELECT doc_id, coalesce(x.doc, '{{"name":"' || md5(d.text) || '","system":{{"chars":' || n_chars || ',"doc":' || doc_id || ',"tags":["' || d.lang || '","' || source || '"]}}}}') AS doc
FROM documents d LEFT JOIN x ON x.lang = d.lang AND x.k = md5(d.text)""")
def _(t):
    """Documents as JSON; those of one text in several editions are merged leaf by leaf and put in the place of each copy."""
    doc = """to_json(named_struct('name', md5(text), 'system', named_struct('chars', n_chars, 'doc', doc_id, 'tags', array(lang, source))))"""
    docs = t.documents.selectExpr("doc_id", "lang", "md5(text) as k", "source as edition", f"{doc} as doc")
    groups = E.edition_groups(docs, ["lang", "k"])
    leaves = S.leaves(groups, ["lang", "k", "edition"], "^$", [], "")
    merged = N.rebuilt(E.merge_leaves(leaves, ["lang", "k"]), ["lang", "k"]).withColumnRenamed("doc", "merged")
    return E.merged_documents(docs, merged, ["lang", "k"]).select("doc_id", "doc")


@query("j6_wrap_edition", "SELECT p_partkey, p_brand || '=' || p_size AS size, p_brand || '=' || p_type AS kind FROM part")
def _(t):
    out = E.wrap_edition(t.part.withColumn("size", F.col("p_size").cast("string")).withColumn("kind", F.col("p_type")), F.col("p_brand"), ["size", "kind"])
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("p_partkey", flat("size").alias("size"), flat("kind").alias("kind"))


@query("j7_pack_flags", """
WITH p AS (SELECT DISTINCT p_brand || '-' || lower(p_type) AS pack FROM part),
l AS (SELECT DISTINCT p_brand || '-' AS prefix FROM part UNION SELECT DISTINCT p_brand FROM part),
h AS (SELECT pack, arg_max(prefix, length(prefix)) AS line FROM p JOIN l ON starts_with(pack, prefix) GROUP BY pack)
SELECT pack, line, substr(pack, length(line) + 1) AS role, row_number() OVER (PARTITION BY line, substr(pack, length(line) + 1) ORDER BY pack) + 1000 AS rank FROM h""")
def _(t):
    packs = t.part.select(F.concat_ws("-", "p_brand", F.lower("p_type")).alias("pack")).distinct()
    brands = t.part.select(F.explode(F.array("p_brand", F.concat("p_brand", F.lit("-")))).alias("prefix")).distinct()
    return E.pack_flags(packs, brands)


@query("j8_module_id", """
WITH e AS (SELECT source AS module, lang || '/' || md5(text || doc_id) AS e, substr(md5(md5(text || doc_id)), 1, 3) AS bucket FROM documents),
p AS (SELECT module, bucket, sha256(string_agg(e, chr(10) ORDER BY e)) AS h FROM e GROUP BY ALL)
SELECT module, substr(sha256(string_agg(h, chr(10) ORDER BY bucket)), 1, 16) AS module_id FROM p GROUP BY module""")
def _(t):
    docs = t.documents.select(F.col("source").alias("module"), F.col("lang").alias("pack"), F.md5(F.concat("text", F.col("doc_id").cast("string"))).alias("id"))
    return E.module_id(docs)


@query("j8_module_identity", """
WITH e AS (SELECT DISTINCT source AS module, lang || '/' || md5(text) AS e FROM documents UNION SELECT DISTINCT source, 'asset/' || lang || '.webp' FROM documents),
h AS (SELECT module, sha256(e) AS h FROM e)
SELECT module, substr(sha256(concat_ws(',', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT)::HUGEINT, sum(('0x' || substr(h, 16, 15))::BIGINT)::HUGEINT,
  sum(('0x' || substr(h, 31, 15))::BIGINT)::HUGEINT, sum(('0x' || substr(h, 46, 15))::BIGINT)::HUGEINT)), 1, 16) AS module_id FROM h GROUP BY module""")
def _(t):
    docs = t.documents.select(F.col("source").alias("module"), F.col("lang").alias("pack"), F.md5("text").alias("id"))
    assets = t.documents.select(F.col("source").alias("module"), F.concat("lang", F.lit(".webp")).alias("name"))
    return E.module_identity(docs, assets)


@query("j9_referenced_assets", r"""
WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages),
a AS (SELECT DISTINCT '/' || unnest(string_split(replace(text, chr(10), ' '), ' ')) AS path FROM documents)
SELECT path, replace(path, '/', 'modules/x/') AS pointed FROM a SEMI JOIN u USING (path)""")
def _(t):
    assets = t.documents.select(F.explode(F.split("text", r"[ \n]")).alias("w")).select(F.concat(F.lit("/"), "w").alias("path")).distinct()
    docs = t.pages.select(F.col("html").alias("text"))
    return E.referenced_assets(assets, docs, 'href="(/[^"]*)"').withColumn("pointed", E.repoint(F.col("path"), "/", "modules/x/"))


@query("j10_run_report", """
SELECT coalesce(p_brand, '*') AS pack, coalesce(p_type, '*') AS type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)""")
def _(t):
    out = E.run_report(t.part, "p_brand", "p_type")
    return out.select(F.coalesce("p_brand", F.lit("*")).alias("pack"), F.coalesce("p_type", F.lit("*")).alias("type"), "n")


@query("j11_check_single", "SELECT DISTINCT 'system' AS system, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS targets FROM orders")
def _(t):
    rows = t.orders.withColumn("system", F.lit("system"))
    n = E.by_target(rows, "o_orderpriority").agg(F.count("*").alias("targets"))
    return E.single_value(rows, "system").withColumn("targets", n.select("targets").scalar())
