"""Queries of inventory I."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import entities as N, score as S, vocab as V
from quire.plans.q_score import EXCLUDED, LEAVES, NK, WB
from quire.plans.registry import query


@query("i1_with_keys", r"""
WITH n AS (SELECT p_partkey AS id, p_name || ' (' || p_brand || ')' AS name FROM part UNION ALL SELECT -c_custkey - 1, c_name FROM customer)
SELECT id, regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g') AS name_key, regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g'), 's$', '') AS singular,
  regexp_replace(lower(regexp_replace(name, '\([^)]*\)?', ' ', 'g')), '[^\p{L}\p{N}]+', '', 'g') AS bare,
  array_to_string(list_sort(list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+'), lambda w: w <> '')), ' ') AS bag,
  trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  (SELECT lower(left(j, 1)) || substr(j, 2) FROM (SELECT array_to_string(list_transform(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') AS j)) AS identifier
FROM n""")
def _(t):
    names = t.part.select(F.col("p_partkey").alias("id"), F.expr("concat(p_name, ' (', p_brand, ')')").alias("name")).unionByName(
        t.customer.select((-F.col("c_custkey") - 1).alias("id"), F.col("c_name").alias("name"))
    )
    return N.with_keys(names, "name").drop("name")


@query("i2_consolidate", """
WITH r AS (SELECT p_partkey, p_type AS pack, lower(replace(p_name, ' ', '')) AS k, CASE WHEN p_size > 25 THEN p_brand END AS sig, p_size FROM part),
s AS (SELECT pack, k, count(DISTINCT sig) AS ns, min(sig) AS sole FROM r GROUP BY ALL),
x AS (SELECT r.*, coalesce(sig, CASE WHEN ns = 1 THEN sole END) AS s2 FROM r JOIN s USING (pack, k))
SELECT pack, k, coalesce(s2, '') AS sig, count(*) AS readings, arg_min(p_partkey, [-p_size, p_partkey]) AS p_partkey FROM x GROUP BY ALL""")
def _(t):
    rows = t.part.select("p_partkey", F.col("p_type").alias("pack"), N.K.singular_key(F.col("p_name")).alias("k"), F.expr("case when p_size > 25 then p_brand end").alias("sig"), "p_size")
    out = N.consolidate(rows, ["pack", "k"], "sig", F.col("p_size"), "p_partkey")
    return out.withColumn("sig", F.coalesce("sig", F.lit("")))


@query("i3_deep_fill", f"""
WITH {LEAVES}
SELECT type, name, path, arg_min(value, card_id) AS value FROM (SELECT leaf.*, p_name AS name FROM leaf JOIN part ON p_partkey = card_id) GROUP BY ALL""")
def _(t):
    rows = S.leaves(t.cards, ["card_id", "type", "name"], EXCLUDED, ["e1", "e2"], "e1")
    return N.deep_fill(rows, ["type", "name"], ["card_id"])


LEVELS = """
s AS (SELECT type, name, string_split(path, '.') AS p, value FROM d),
k3 AS (SELECT type, name, p[1] AS a, p[2] AS b, '{' || string_agg('"' || p[3] || '":' || value, ',' ORDER BY p[3]) || '}' AS v FROM s WHERE len(p) = 3 GROUP BY ALL),
k2 AS (SELECT type, name, a, '{' || string_agg('"' || b || '":' || v, ',' ORDER BY b) || '}' AS v
  FROM (SELECT * FROM k3 UNION ALL SELECT type, name, p[1], p[2], value FROM s WHERE len(p) = 2) GROUP BY ALL)
SELECT type, name, '{' || string_agg('"' || a || '":' || v, ',' ORDER BY a) || '}' AS doc
FROM (SELECT * FROM k2 UNION ALL SELECT type, name, p[1], value FROM s WHERE len(p) = 1) GROUP BY ALL"""


@query("i3_rebuilt", f"""
WITH {LEAVES},
d AS (SELECT type, name, path, arg_min(value, card_id) AS value FROM (SELECT leaf.*, p_name AS name FROM leaf JOIN part ON p_partkey = card_id) GROUP BY ALL),
{LEVELS}""")
def _(t):
    rows = S.leaves(t.cards, ["card_id", "type", "name"], EXCLUDED, ["e1", "e2"], "e1")
    return N.rebuilt(N.deep_fill(rows, ["type", "name"], ["card_id"]), ["type", "name"])


@query("i4_cite", """
SELECT o_custkey, o_orderkey AS cited FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1""")
def _(t):
    return N.cite(t.orders, ["o_custkey"], F.col("o_orderpriority"), "o_orderkey")


@query("i5_attach_prose", rf"""
WITH e AS (SELECT doc_id AS ord, regexp_extract(text, '^([^ \n]*)', 1) AS heading, text AS body FROM documents),
l AS (SELECT * FROM e WHERE len(regexp_split_to_array(trim(body, E' \n\t'), '\s+')) >= 8),
f AS (SELECT {NK.format('heading')} AS k, arg_min(md5(body), ord) AS b FROM l GROUP BY 1)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'own' ELSE coalesce(f.b, md5('')) END AS body
FROM conversations c LEFT JOIN f ON f.k = {NK.format("regexp_extract(c.text, '^([^ ' || chr(10) || ']*)', 1)")} AND f.k <> ''""")
def _(t):
    first = F.regexp_extract("text", r"^([^ \n]*)", 1)
    ents = t.conversations.select("conv_id", "turn", "role", first.alias("name"), F.expr("case when role = 'user' then 'own' else '' end").alias("body"))
    entries = t.documents.select(F.col("doc_id").alias("ord"), first.alias("heading"), F.col("text").alias("body"))
    out = N.attach_prose(ents, entries)
    return out.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("body")).otherwise(F.md5("body")).alias("body"))


@query("i6_introduce", """
WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day, o_totalprice FROM orders)
SELECT a.o_orderkey, coalesce(arg_max(b.o_orderkey, [b.day, b.o_orderkey]), -1) AS introduced
FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.day < a.day AND a.day - b.day <= 90 GROUP BY a.o_orderkey""")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day"))
    entries = o.withColumn("value", F.col("o_orderkey"))
    out = N.introduce(o, entries, "o_custkey", "day", 90, "o_orderkey", "value", 256)
    return out.select("o_orderkey", F.coalesce("introduced", F.lit(-1)).alias("introduced"))


@query("i7_embed_items", """
WITH l AS (SELECT l_orderkey AS owner, l_linenumber AS pos, l_partkey, min(CASE l_linenumber % 4 WHEN 0 THEN 'Item ' || l_partkey WHEN 1 THEN 'Item ' || l_partkey || ' (spare)' WHEN 2 THEN 'item ' || l_partkey || 's' ELSE 'Lost ' || l_partkey END) AS name
  FROM lineitem GROUP BY ALL)
SELECT owner, count(*) AS n, sum(CASE WHEN pos % 4 = 3 THEN 0 ELSE pos % 4 + 1 END)::BIGINT AS tiers,
  string_agg(name || '=' || CASE WHEN pos % 4 = 3 THEN '' ELSE l_partkey::VARCHAR END, ';' ORDER BY pos, name) AS items FROM l GROUP BY owner""")
def _(t):
    name = F.expr("""case l_linenumber % 4 when 0 then concat('Item ', l_partkey) when 1 then concat('Item ', l_partkey, ' (spare)')
        when 2 then concat('item ', l_partkey, 's') else concat('Lost ', l_partkey) end""")
    lists = t.lineitem.select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("pos"), name.alias("name")).distinct()
    items = t.part.select(F.col("p_partkey").alias("id"), F.expr("concat('Item ', p_partkey)").alias("name"))
    emb = N.embed_items(lists, items)
    sums = emb.groupBy("owner").agg(F.count("*").alias("n"), F.sum("tier").alias("tiers"))
    text = F.array_join(F.transform("items", lambda i: F.concat(i["name"], F.lit("="), F.coalesce(i["id"].cast("string"), F.lit("")))), ";")
    return N.nested(emb).select("owner", text.alias("items")).join(sums, "owner")


@query("i8_fill_modal", """
WITH r AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg FROM customer),
m AS (SELECT c_nationkey, seg FROM (SELECT c_nationkey, seg, count(*) AS n FROM r WHERE seg IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, seg) = 1)
SELECT c_custkey, coalesce(r.seg, m.seg, '') AS seg FROM r LEFT JOIN m USING (c_nationkey)""")
def _(t):
    rows = t.customer.select("c_custkey", "c_nationkey", F.expr("case when c_acctbal >= 0 then c_mktsegment end").alias("seg"))
    return N.fill_modal(rows, "c_nationkey", "seg").select("c_custkey", F.coalesce("seg", F.lit("")).alias("seg"))


@query("i9_used_with", """
WITH k AS (SELECT DISTINCT lower(p_type) AS k, p_type AS kind FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2), p_type FROM part WHERE p_size > 45)
SELECT DISTINCT p_partkey AS id, kind FROM part, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) u(w) JOIN k ON k.k = w""")
def _(t):
    ents = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("uses"))
    records = t.part.where("p_size > 45").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"), F.col("p_type").alias("kind"))
    return N.used_with(ents, t.part.select(F.col("p_type").alias("kind")).distinct(), records)


@query("i10_derive_defaults", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand WHEN p_name LIKE '%ring' THEN 'ring.svg' WHEN p_name LIKE 'red%' THEN 'red.svg' WHEN p_type = 'SMALL' THEN 'small.svg' ELSE 'item.svg' END AS icon FROM part""")
def _(t):
    rows = t.part.withColumn("icon", F.expr("case when p_size > 40 then p_brand end"))
    rules = [(F.col("p_name").rlike("ring$"), "ring.svg"), (F.col("p_name").rlike("^red"), "red.svg"), (F.col("p_type") == "SMALL", "small.svg"), (F.lit(True), "item.svg")]
    return N.derive_defaults(rows, "icon", rules).select("p_partkey", "icon")


@query("i11_harmonise_types", """
WITH e AS (SELECT p_name, arg_min(p_type, p_partkey) AS ty FROM part WHERE p_size > 40 GROUP BY p_name)
SELECT p_partkey, CASE WHEN p_size > 40 THEN p_type ELSE coalesce(ty, p_type) END AS p_type FROM part LEFT JOIN e USING (p_name)""")
def _(t):
    out = N.harmonise_types(t.part, N.K.name_key(F.col("p_name")), F.col("p_size") > 40, "p_type", "p_partkey")
    return out.select("p_partkey", "p_type")


@query("i12_drop_named", """
SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, 'Supplier' || l_partkey AS name FROM lineitem) ANTI JOIN (SELECT 'supplier ' || s_suppkey || 's' AS s FROM supplier) ON lower(name) = replace(rtrim(s, 's'), ' ', '') GROUP BY ALL""")
def _(t):
    rows = t.lineitem.select("l_orderkey", F.expr("concat('Supplier', l_partkey)").alias("name"))
    other = t.supplier.select(F.expr("concat('supplier ', s_suppkey, 's')").alias("s"))
    return N.drop_named(rows, other, "name", "s").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("i13_head_nouns", r"""
SELECT DISTINCT regexp_extract(lower(text), '(\S+)\s*$', 1) AS noun FROM v_lines WHERE lang = 'fr' AND trim(text) <> ''
EXCEPT SELECT regexp_extract(lower(text), '(\S+)\s*$', 1) FROM v_lines WHERE lang <> 'fr' AND trim(text) <> ''""")
def _(t):
    return N.head_nouns(t.lines.where("trim(text) <> ''"), "text", F.col("lang") == "fr")


@query("i14_attach_tables", rf"""
WITH tb AS (SELECT source AS book, doc_id AS ord, regexp_extract(text, '^([^.\n]*)', 1) AS title FROM documents),
ow AS (SELECT DISTINCT array_to_string({WB.format("regexp_extract(text, '^([^ ' || chr(10) || ']*)', 1)")}, ' ') AS k FROM conversations),
w AS (SELECT book, ord, {WB.format('title')} AS w FROM tb),
g AS (SELECT book, ord, array_to_string(w[i:i + n - 1], ' ') AS k FROM w, unnest(range(1, len(w) + 1)) a(i), unnest(range(1, (SELECT max(len(string_split(k, ' '))) FROM ow) + 1)) b(n) WHERE i + n - 1 <= len(w)),
h AS (SELECT book, ord, k AS named FROM g SEMI JOIN ow USING (k) QUALIFY row_number() OVER (PARTITION BY book, ord ORDER BY length(k) DESC, k) = 1),
c AS (SELECT tb.*, named, last_value(named IGNORE NULLS) OVER (PARTITION BY tb.book ORDER BY tb.ord) AS owner FROM tb LEFT JOIN h USING (book, ord))
SELECT book, ord, coalesce(owner, '') AS owner, CASE WHEN named IS NOT NULL THEN 'named' WHEN owner IS NOT NULL THEN 'before' ELSE 'shared' END AS how FROM c""")
def _(t):
    tables = t.documents.select(F.col("source").alias("book"), F.col("doc_id").alias("ord"), F.regexp_extract("text", r"^([^.\n]*)", 1).alias("title"))
    word = F.regexp_extract("text", r"^([^ \n]*)", 1)
    owners = t.conversations.select(F.array_join(N.K.name_words(word), " ").alias("name")).distinct()
    return N.attach_tables(tables, owners).select("book", "ord", F.coalesce("owner", F.lit("")).alias("owner"), "how")


@query("i15_rank_numbers", """
SELECT DISTINCT c_nationkey, floor(c_acctbal / 500)::BIGINT AS band, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 500)) AS rank FROM customer""")
def _(t):
    return N.rank_numbers(t.customer.select("c_nationkey", F.floor(F.col("c_acctbal") / 500).alias("band")), "c_nationkey", "band")


@query("i16_advances", """
SELECT p_partkey, p_name AS advance, 100 * p_size AS cost, p_type AS kind, CASE WHEN p_size > 20 THEN p_brand ELSE '' END AS prerequisite FROM part""")
def _(t):
    cells = F.expr("concat(split(p_name, ' '), array(format_number(100 * p_size, 0), p_type), if(p_size > 20, array(p_brand), cast(array() as array<string>)))")
    return N.advances(t.part.select("p_partkey", cells.alias("cells")), "cells").drop("cells")


@query("i16_cost_matrix", """
SELECT p_brand, string_agg(p_type || '=' || c, ',' ORDER BY p_type) AS costs FROM (SELECT p_brand, p_type, min(p_size) AS c FROM part GROUP BY ALL) GROUP BY ALL""")
def _(t):
    out = N.cost_matrix(t.part, "p_brand", "p_type", "p_size")
    return out.select("p_brand", F.array_join(F.transform(F.map_entries("costs"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("costs"))


@query("i17_name_gates", r"""
WITH bw AS (SELECT regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark),
n AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS name FROM bw, unnest(range(1, len(w))) u(i)),
s AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[.!?\n]+\s*')) AS s FROM documents),
m AS (SELECT id, CASE WHEN regexp_matches(s, '(^|[^\p{L}])(not|no|never|ne|nicht)($|[^\p{L}])') THEN 'forbids' WHEN regexp_matches(s, '(^|[^\p{L}])(must|the|la|der|die)($|[^\p{L}])') THEN 'requires' END AS kind,
  regexp_extract_all(s, '\p{L}+') AS w FROM s)
SELECT DISTINCT id, name, kind FROM (SELECT id, kind, w[i] || ' ' || w[i + 1] AS name FROM m, unnest(range(1, len(w))) u(i) WHERE kind IS NOT NULL) SEMI JOIN n USING (name)""")
def _(t):
    words = t.benchmark.select(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w")).where("size(w) > 1")
    names = words.select(F.expr("explode(transform(sequence(1, size(w) - 1), i -> array_join(slice(w, i, 2), ' ')))").alias("name")).distinct()
    return N.name_gates(t.documents.select(F.col("doc_id").alias("id"), "text"), names, "must|the|la|der|die", "not|no|never|ne|nicht")


@query("i18_keep_rejects", """
WITH r AS (SELECT DISTINCT l_orderkey, role, raw FROM (SELECT l_orderkey, 'flag' AS role, l_returnflag AS raw FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT l_orderkey, 'line', l_linestatus FROM lineitem WHERE l_tax > 0.05))
SELECT o_orderkey AS l_orderkey, trim(o_orderpriority || ' ' || coalesce((SELECT string_agg(role || ': ' || raw, '; ' ORDER BY role, raw) FROM r WHERE r.l_orderkey = o_orderkey), '')) AS description FROM orders""")
def _(t):
    rejects = t.lineitem.where("l_returnflag <> 'N'").select("l_orderkey", F.lit("flag").alias("role"), F.col("l_returnflag").alias("raw")).unionByName(
        t.lineitem.where("l_tax > 0.05").select("l_orderkey", F.lit("line").alias("role"), F.col("l_linestatus").alias("raw"))
    )
    return N.keep_rejects(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("description")), rejects, "l_orderkey")


@query("i19_complete_names", """
WITH b AS (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, count(*) AS n FROM part GROUP BY ALL),
f AS (SELECT b, a, n FROM b QUALIFY row_number() OVER (PARTITION BY b ORDER BY n DESC, a) = 1)
SELECT p_partkey, CASE WHEN n >= 2 THEN a || ' ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 2) END AS name FROM part LEFT JOIN f ON f.b = split_part(p_name, ' ', 2)""")
def _(t):
    pairs = V.bigrams(t.part.select(F.col("p_name").alias("text"), F.lit(1).alias("all")), ["all"])
    rows = t.part.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))
    return N.complete_names(rows, pairs, "name")


@query("i20_choice_groups", """
SELECT page_id, n, coalesce(last_value(CASE WHEN tag IN ('h1', 'h2', 'h3') THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n), '') AS choice FROM v_blocks""")
def _(t):
    blocks = t.blocks.withColumn("seg", F.floor(F.col("n") / 256))
    out = N.choice_groups(blocks, ["page_id"], "seg", ["n"], F.col("tag").isin("h1", "h2", "h3"), "text")
    return out.select("page_id", "n", F.coalesce("choice", F.lit("")).alias("choice"))


@query("i21_first_reader_wins", """
SELECT doc_id, source, lang FROM documents QUALIFY source = min(source) OVER (PARTITION BY lang, md5(text))""")
def _(t):
    rows = t.documents.select("doc_id", "source", "lang", F.md5("text").alias("k"))
    return N.first_reader_wins(rows, ["lang"], "source", "k").select("doc_id", "source", "lang")


@query("i22_claim_parts", """
WITH r AS (SELECT page_id, n, tag, n // 16 AS seg, tag IN ('h1', 'h2', 'h3') AS is_head FROM v_blocks),
h AS (SELECT *, max(CASE WHEN is_head THEN n END) OVER (PARTITION BY page_id ORDER BY n) AS head_ord FROM r),
p AS (SELECT *, first_value(tag) OVER (PARTITION BY page_id, head_ord ORDER BY n) AS style FROM h WHERE NOT is_head AND head_ord IS NOT NULL),
b AS (SELECT *, min(CASE WHEN tag <> style OR seg - head_ord // 16 > 1 THEN n END) OVER (PARTITION BY page_id, head_ord) AS brk FROM p)
SELECT page_id, n, head_ord, tag FROM b WHERE brk IS NULL OR n < brk""")
def _(t):
    blocks = t.blocks.withColumn("seg", F.floor(F.col("n") / 16))
    out = N.claim_parts(blocks, ["page_id"], "seg", "n", F.col("tag").isin("h1", "h2", "h3"), "tag")
    return out.select("page_id", "n", "head_ord", "tag")


@query("i23_absorb", """
WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day, o_orderstatus FROM orders)
SELECT a.o_orderkey, coalesce(arg_max(b.o_orderkey, [b.day, b.o_orderkey]), -1) AS absorbed_by
FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderstatus <> 'F' AND b.day <= a.day AND a.day - b.day <= 30 WHERE a.o_orderstatus = 'F' GROUP BY a.o_orderkey""")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day"))
    out = N.absorb(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_custkey", "day", "o_orderkey", 30, 256)
    return out.select("o_orderkey", F.coalesce("absorbed_by", F.lit(-1)).alias("absorbed_by"))


@query("i24_fix_misprints", """
SELECT p_partkey, CASE WHEN p_brand <> first_value(p_brand) OVER w AND p_type <> first_value(p_type) OVER w THEN p_type ELSE p_name END AS fixed
FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)""")
def _(t):
    return N.fix_misprints(t.part, "p_name", "p_brand", "p_type", "p_partkey").select("p_partkey", "fixed")


@query("i25_explode_children", """
SELECT o_orderkey, l_returnflag AS label, string_agg('line ' || l_linenumber || ' (' || o_orderpriority || ')', '; ' ORDER BY 'line ' || l_linenumber || ' (' || o_orderpriority || ')') AS options
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(t):
    owners = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("name"))
    rules = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("label"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("rule"))
    return N.link_children(N.explode_children(owners, rules, "o_orderkey"), "o_orderkey", "label")
