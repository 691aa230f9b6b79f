"""Tables: detection, headers, rows to typed records (inventory F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.scans import carry_last, islands, prefix_sum, previous
from quire.session import cut_lineage

ROW = ["table_id", "row_no"]

# Header words and the role of the column below them, first match wins.
ROLES = [
    ("name", r"(?i)^(name|item|weapon)$"), ("weight", r"(?i)^(wt\.?|weight)$"), ("cost", r"(?i)^(cost|price)$"),
    ("type", r"(?i)^(type|class)$"), ("range", r"(?i)^range$"), ("damage", r"(?i)^(dam\.?|damage)$"),
]

# How a cell of a role is written. Roles of one number, then those of several parts.
NOTATION = {
    "weight": r"^(\d+(?:\.\d+)?) ?(?:kg)?$",
    "cost": r"^(\d{1,3}(?:,\d{3})*|\d+)$",
    "integer": r"^([+-]?\d+)$",
}
RANGE = r"^(\d+)(?:-(\d+))?$"
DAMAGE = r"(?i)^(\d*)d(\d+)(?: ?([+-] ?\d+))? ?([A-Z])?$"
RATE = r"^(S|-)/(\d+|-)/(\d+|-)$"

# Availability grades, most common first.
AVAILABILITY = [
    "Ubiquitous", "Abundant", "Plentiful", "Common", "Average", "Scarce", "Rare", "Very Rare", "Extremely Rare",
    "Near Unique", "Unique",
]


def column_edges(lined: DataFrame, bucket: int = 8, share: float = 0.3) -> DataFrame:
    """Starts shared by enough of a page's lines: (doc_id, page, edge)."""
    page = ["doc_id", "page"]
    at = lined.select(*page, "col", "line", F.floor(F.col("x") / bucket).alias("b"), "x")
    n = at.select(*page, "col", "line").distinct().groupBy(*page).agg(F.count("*").alias("n_lines"))
    hits = at.groupBy(*page, "b", "col", "line").agg(F.min("x").alias("x")).groupBy(*page, "b").agg(
        F.count("*").alias("n"), F.min("x").alias("edge")
    )
    return hits.join(n, page).where(F.col("n") >= share * F.col("n_lines")).select(*page, "edge")


def assign_cells(runs: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest column edge of each run, the left one on a tie. A page has a handful of edges."""
    sets = edges.groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("_e"))
    near = F.array_min(F.transform("_e", lambda e, i: F.struct(F.abs(e - F.col("x")).alias("d"), i.alias("i"))))["i"]
    return runs.join(sets, keys).withColumn("col_no", near).drop("_e")


def cell_text(assigned: DataFrame, row: list[str]) -> DataFrame:
    return assigned.groupBy(*row, "col_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "ord", "text"))), lambda r: r["text"]), " ").alias("text"),
        F.bool_and(F.col("weight") == "bold").alias("bold"),
    )


def aligned_tables(lined: DataFrame, edges: DataFrame, least_cols: int = 3, least_rows: int = 3, prose: int = 24) -> DataFrame:
    """Runs of consecutive lines that fill two of at least three columns, with a bold header row if there is one.

    Prose is rejected by its median cell length.
    """
    page = ["doc_id", "page"]
    wide = edges.groupBy(*page).agg(F.count("*").alias("n_edges")).where(F.col("n_edges") >= least_cols)
    cells = cell_text(assign_cells(lined.join(wide, page, "left_semi"), edges, page), [*page, "line"])
    rows = cells.groupBy(*page, "line").agg(F.count("*").alias("n"), F.bool_and("bold").alias("bold"))
    w = W.partitionBy(*page).orderBy("line")
    rows = rows.where("n >= 2").withColumn("gap", F.col("line") - F.lag("line").over(w))
    rows = rows.withColumn("table_no", islands(F.col("gap").isNull() | (F.col("gap") > 1), page, ["line"]))
    table = [*page, "table_no"]
    stats = rows.join(cells, [*page, "line"]).groupBy(*table).agg(
        F.count_distinct("line").alias("rows"), F.percentile(F.length("text"), F.lit(0.5)).alias("median"),
        F.min(F.when(rows["bold"], F.col("line"))).alias("header_line"),
    )
    ok = stats.where((F.col("rows") >= least_rows) & (F.col("median") <= prose))
    return rows.join(ok, table).select(*page, "table_no", "line", F.coalesce(F.col("line") == F.col("header_line"), F.lit(False)).alias("is_header"), "n")


def captions(lines: DataFrame) -> DataFrame:
    """Captions "Table N: title"; a bare number takes its title from a reference, on its own page first.

    ``lines`` has doc_id, page, ord, text.
    """
    cap = lines.withColumns(
        {
            "number": F.regexp_extract("text", r"^Table (\d+(?:-\d+)?)\b", 1),
            "title": F.regexp_extract("text", r"^Table \d+(?:-\d+)?: (.+)$", 1),
        }
    ).where("number <> ''")
    refs = lines.select(
        "doc_id", F.col("page").alias("ref_page"), F.col("ord").alias("ref_ord"),
        F.regexp_extract("text", r"\S+ Table (\d+(?:-\d+)?): [^.]+", 1).alias("number"),
        F.regexp_extract("text", r"\S+ Table \d+(?:-\d+)?: ([^.]+)", 1).alias("ref_title"),
    ).where("number <> ''")
    own = refs.groupBy("doc_id", "number", F.col("ref_page").alias("page")).agg(F.min_by("ref_title", "ref_ord").alias("_own"))
    any_ = refs.groupBy("doc_id", "number").agg(F.min_by("ref_title", F.struct("ref_page", "ref_ord")).alias("_any"))
    out = cap.join(own, ["doc_id", "number", "page"], "left").join(any_, ["doc_id", "number"], "left")
    return out.withColumn(
        "title", F.when(F.col("title") != "", F.col("title")).otherwise(F.coalesce("_own", "_any", F.lit("")))
    ).drop("_own", "_any")


def captioned_rows(lines: DataFrame, keys: list[str], segment: str, order: str, is_caption: Column, ends: Column) -> DataFrame:
    """Lines under the caption in force, down to the first line that ends the table."""
    cap = F.when(is_caption, F.struct(F.col(order).alias("ord"), F.col("text").alias("title")))
    rows = carry_last(lines.withColumn("_is", is_caption).withColumn("_end", ends & ~is_caption), keys, segment, [order], cap, "_c")
    rows = rows.where("_c is not null and not _is").withColumn("caption_ord", F.col("_c.ord")).withColumn("caption", F.col("_c.title"))
    cut = rows.where("_end").groupBy(*keys, "caption_ord").agg(F.min(order).alias("_cut"))
    rows = rows.join(cut, [*keys, "caption_ord"], "left").where(F.col("_cut").isNull() | (F.col(order) < F.col("_cut")))
    return rows.drop("_is", "_end", "_c", "_cut")


def role_of(header: Column) -> Column:
    chain = None
    for role, pattern in ROLES:
        hit = F.trim(header).rlike(pattern)
        chain = F.when(hit, role) if chain is None else chain.when(hit, role)
    return chain


def header_roles(headers: DataFrame) -> DataFrame:
    """Role of each header cell; a merged header ("Wt/Cost") holds its parts' roles if every part has one."""
    parts = headers.withColumn("_p", F.split("text", r"\s*/\s*"))
    roles = F.transform("_p", role_of)
    whole = role_of(F.col("text"))
    merged = F.when(F.forall(roles, lambda r: r.isNotNull()), F.array_join(roles, "+"))
    return parts.withColumn("role", F.coalesce(whole, merged)).drop("_p")


def header_anchors(cells: DataFrame, least: int = 3) -> DataFrame:
    """Rows that head an uncaptioned table: at least ``least`` cells name different roles."""
    named = cells.withColumn("role", role_of(F.col("text"))).where("role is not null")
    return named.groupBy(*ROW).agg(F.count_distinct("role").alias("roles")).where(F.col("roles") >= least)


def classify_tables(headers: DataFrame, terms: list[tuple[str, str, int]]) -> DataFrame:
    """Type of each table: the share of its header cells that are terms of a type, discriminators weighing more.

    ``terms`` are rules (type, role, weight) of the schema.
    """
    rules = headers.sparkSession.createDataFrame(terms, "type string, role string, weight int")
    roles = header_roles(headers).where("role is not null").select("table_id", "role").distinct()
    n = headers.groupBy("table_id").agg(F.count("*").alias("n"))
    score = roles.join(F.broadcast(rules), "role").groupBy("table_id", "type").agg(F.sum("weight").alias("hits"))
    best = score.groupBy("table_id").agg(F.min_by(F.struct("type", "hits"), F.struct(-F.col("hits"), "type")).alias("b"))
    return n.join(best, "table_id", "left").select("table_id", "b.type", F.round(F.col("b.hits") / F.col("n"), 6).alias("score"))


def exclude_tables(cells: DataFrame, band: str, share: float = 0.5) -> DataFrame:
    """Cells of the tables that are not keyed by bands: at least ``share`` of the first cells match ``band``."""
    banded = cells.where("col_no = 0").groupBy("table_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").rlike(band)).alias("hits")
    ).where(F.col("hits") >= share * F.col("n"))
    return cells.join(banded.select("table_id"), "table_id", "left_anti")


def drop_repeated_headers(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells without the rows that repeat their table's header cell by cell."""
    head = headers.select("table_id", "col_no", F.col("text").alias("head"), F.col("row_no").alias("head_row"))
    width = head.groupBy("table_id").agg(F.count("*").alias("width"))
    same = cells.join(head, ["table_id", "col_no"]).where("row_no <> head_row").groupBy(*ROW).agg(
        F.count("*").alias("n"), F.bool_and(F.col("text") == F.col("head")).alias("same")
    ).where("same").join(width, "table_id").where("n = width")
    return cells.join(same.select(*ROW), ROW, "left_anti")


def unpivot_sets(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Side-by-side column sets one below the other, by the period of the header."""
    row = headers.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col_no", "text"))).alias("h"))
    period = F.expr(
        """get(filter(sequence(1, size(h)), p -> size(h) % p = 0 and
             forall(sequence(0, size(h) - 1), i -> h[i].text = h[i % p].text)), 0)"""
    )
    return cells.join(row.select("table_id", period.alias("period")), "table_id").withColumns(
        {"set_no": F.expr("col_no div period"), "col_no": F.expr("col_no % period")}
    )


def carry_sections(rows: DataFrame, keys: list[str], segment: str, order: list[str], is_section: Column, label: Column) -> DataFrame:
    """Section rows become a column of the rows below them."""
    rows = rows.withColumn("is_section", is_section)
    return carry_last(rows, keys, segment, order, F.when(is_section, label), "section").where("not is_section").drop("is_section")


def continue_tables(parts: DataFrame) -> DataFrame:
    """A headerless part on the next page, as wide as the part before, inherits caption and header.

    ``parts`` has doc_id, page, n_cols, header, caption; "(continued)" is dropped.
    """
    parts = parts.withColumn("seg", F.floor(F.col("page") / 512))
    parts = previous(parts, ["doc_id"], "seg", ["page"], F.struct("page", "n_cols"), "_p")
    opens = (
        F.col("header").isNotNull() | F.col("_p").isNull() | (F.col("page") - F.col("_p.page") > 1) | (F.col("_p.n_cols") != F.col("n_cols"))
    )
    parts = prefix_sum(parts.withColumn("_o", opens.cast("int")), ["doc_id"], "seg", ["page"], F.col("_o"), "chain")
    head = parts.where("_o = 1").select("doc_id", "chain", F.col("header").alias("_h"), F.col("caption").alias("_c"))
    clean = F.trim(F.regexp_replace(F.coalesce("_c", "caption", F.lit("")), r"(?i)\s*\(continued\)\s*$", ""))
    return parts.join(head, ["doc_id", "chain"], "left").select(
        "doc_id", "page", "chain", F.coalesce("header", "_h", F.lit("")).alias("header"), clean.alias("caption")
    )


def resolve_tables(captioned: DataFrame, aligned: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Two detectors' runs: an aligned table that shares enough runs with captioned ones only fills what they lack.

    Both have keys, table_no and ord.
    """
    taken = captioned.select(*keys, "ord", F.lit(True).alias("_taken"))
    both = aligned.join(taken, [*keys, "ord"], "left")
    stat = both.groupBy(*keys, "table_no").agg(F.count("*").alias("n"), F.count("_taken").alias("common"))
    both = both.join(stat, [*keys, "table_no"])
    fate = F.when(F.col("common") == 0, "kept").when(F.col("common") >= share * F.col("n"), "fills").otherwise("dropped")
    extra = both.withColumn("fate", fate).where("fate <> 'dropped' and _taken is null")
    return captioned.select(*keys, "ord", F.lit("captioned").alias("fate")).unionByName(extra.select(*keys, "ord", "fate"))


def anchor_rows(lines: DataFrame, block: list[str]) -> DataFrame:
    """Keyless lines join the nearest key above or below, the one above on a tie.

    ``lines`` has y and key (null where the line has none), inside one block.
    """
    up = W.partitionBy(*block).orderBy(F.desc("y")).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*block).orderBy(F.desc("y")).rowsBetween(0, W.unboundedFollowing)
    mark = F.when(F.col("key").isNotNull(), F.struct("y", "key"))
    lines = lines.withColumns({"_a": F.last(mark, ignorenulls=True).over(up), "_b": F.first(mark, ignorenulls=True).over(down)})
    above = F.col("_b").isNull() | (F.col("_a").isNotNull() & (F.col("_a.y") - F.col("y") <= F.col("y") - F.col("_b.y")))
    return lines.withColumn("anchor", F.when(above, F.col("_a.key")).otherwise(F.col("_b.key"))).drop("_a", "_b")


def merge_continuations(lines: DataFrame, block: list[str]) -> DataFrame:
    """Row of each line: a line nearer to the one above than the block's usual row gap, or after an unfinished cell, continues it."""
    w = W.partitionBy(*block).orderBy(F.desc("y"))
    lines = lines.withColumn("gap", F.lag("y").over(w) - F.col("y")).withColumn("_prev", F.lag("text").over(w))
    cut = lines.groupBy(*block).agg(
        F.expr("percentile_disc(0.1) within group (order by gap)").alias("lo"),
        F.expr("percentile_disc(0.9) within group (order by gap)").alias("hi"),
    )
    lines = lines.join(cut, block)
    two = F.col("hi") > 1.3 * F.col("lo")
    near = two & (F.col("gap") <= (F.col("lo") + F.col("hi")) / 2)
    unfinished = F.col("_prev").rlike(r"[-,(]$")
    opens = F.col("gap").isNull() | ~(near | unfinished)
    return lines.withColumn("_o", opens).withColumn("row", islands(F.col("_o"), block, [F.desc("y")])).drop("_o", "_prev", "lo", "hi")


def join_split_rows(rows: DataFrame, block: list[str], share: float = 0.8) -> DataFrame:
    """Lines nearer than ``share`` of the type size are one row, unless both hold figures in one column.

    ``rows`` has y, size and ``figures`` (columns with figures).
    """
    w = W.partitionBy(*block).orderBy(F.desc("y"))
    near = F.lag("y").over(w) - F.col("y") < share * F.col("size")
    clash = F.arrays_overlap(F.lag("figures").over(w), F.col("figures"))
    rows = rows.withColumn("_o", ~F.coalesce(near & ~clash, F.lit(False)))
    return rows.withColumn("row", islands(F.col("_o"), block, [F.desc("y")])).drop("_o")


def records(cells: DataFrame, roles: DataFrame, wanted: list[str]) -> DataFrame:
    """One row per record, same-role columns joined in column order."""
    marked = cells.join(roles.select("table_id", "col_no", "role"), ["table_id", "col_no"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]), " ")
    # the pivot is written out: the roles are the schema's
    per_role = marked.groupBy(*ROW, "role").agg(joined.alias("v"))
    return per_role.groupBy(*ROW).agg(*[F.max(F.when(F.col("role") == r, F.col("v"))).alias(r) for r in wanted])


def is_dash(raw: Column) -> Column:
    return raw.isNull() | F.trim(raw).rlike(r"^[-‐‑‒–—―−]*$")


def typed_cast(long: DataFrame) -> DataFrame:
    """Typed value of each (role, raw) cell by the notation of its role; ``reject`` marks a filled cell that cannot be read.

    Roles of one number give ``value``; damage gives ``dice, faces, bonus, kind``, a rate ``single, semi, full`` and a range
    ``lo, hi``. What a notation leaves out is null.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"[†‡*§¶]+", ""), "[‐‑‒–—―−]", "-"))
    filled = ~is_dash(F.col("raw"))
    value = F.lit(None).cast("double")
    for role, pattern in NOTATION.items():
        got = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
        value = F.when(F.col("role") == role, got).otherwise(value)

    def part(role: str, pattern: str, group: int, kind: str = "int") -> Column:
        found = F.regexp_replace(F.regexp_extract(text, pattern, group), " ", "")
        return F.when(filled & (F.col("role") == role) & text.rlike(pattern), F.when(found != "", found.try_cast(kind)))

    whole = filled & text.rlike(DAMAGE) & (F.col("role") == "damage")
    out = long.withColumns(
        {
            "value": F.when(filled, value),
            "dice": F.when(whole, F.coalesce(part("damage", DAMAGE, 1), F.lit(1))), "faces": part("damage", DAMAGE, 2),
            "bonus": F.when(whole, F.coalesce(part("damage", DAMAGE, 3), F.lit(0))), "kind": F.upper(part("damage", DAMAGE, 4, "string")),
            "single": F.when(filled & (F.col("role") == "rate") & text.rlike(RATE), F.regexp_extract(text, RATE, 1) == "S"),
            "semi": part("rate", RATE, 2), "full": part("rate", RATE, 3), "lo": part("range", RANGE, 1),
            "hi": F.coalesce(part("range", RANGE, 2), part("range", RANGE, 1)),
        }
    )
    read = F.coalesce(F.col("value"), F.col("faces"), F.col("lo"), F.col("single").cast("int")).isNotNull()
    return out.withColumn("reject", filled & ~read)


def grade_of(raw: Column, grades: list[str] = AVAILABILITY) -> Column:
    """A grade by its name, its initials, an opening of at least two letters, or its first letter and others in order."""
    key = F.lower(F.regexp_replace(raw, r"[^\p{L}]+", ""))
    letters = F.concat(F.lit("^"), F.regexp_replace(key, "(.)", "$1.*"))
    tests = [
        lambda g: key == F.lit(g.lower().replace(" ", "")),
        lambda g: (key == F.lit("".join(w[0] for w in g.lower().split()))) if " " in g else F.lit(False),
        lambda g: (F.length(key) >= 2) & F.lit(g.lower().replace(" ", "")).startswith(key),
        lambda g: (F.length(key) >= 2) & F.rlike(F.lit(g.lower().replace(" ", "")), letters),
    ]
    chain = None
    for test in tests:
        for g in grades:
            chain = F.when(test(g), g) if chain is None else chain.when(test(g), g)
    return chain


# Words a title leaves in lower case.
FUNCTION_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]


def title_case(name: Column) -> Column:
    """Words capitalised, function words inside in lower case."""
    words = F.split(F.lower(name), " ")
    return F.array_join(
        F.transform(words, lambda w, i: F.when((i > 0) & w.isin(FUNCTION_WORDS), w).otherwise(F.initcap(w))), " "
    )


def route_records(rows: DataFrame, longest: int = 60) -> DataFrame:
    """Where each record goes: 'prose', 'broken', 'thin', 'load' or 'record', judged by its name and filled cells.

    ``rows`` has name, cells (array) and roles wanted for a profile as booleans.
    """
    name = F.col("name")
    lower = F.size(F.filter(F.split(name, " "), lambda w: w.rlike(r"^\p{Ll}") & ~w.isin(FUNCTION_WORDS)))
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    filled = F.size(F.filter("cells", lambda c: ~is_dash(c)))
    route = (
        F.when(~name.rlike(r"^[\p{Pi}\p{Ps}\"']*[\p{Lu}\p{N}]") | (F.length(name) > longest), "unnamed")
        .when(lower > 2, "prose")
        .when(last.isin(FUNCTION_WORDS), "broken")
        .when(filled < 2, "thin")
        .otherwise("record")
    )
    return rows.withColumn("route", route)


def fill_from_context(rows: DataFrame, column: str, *contexts: str) -> DataFrame:
    """Own cell, else section, else caption, else heading above."""
    own = F.when(~is_dash(F.col(column)), F.col(column))
    return rows.withColumn(column, F.coalesce(own, *[F.when(F.col(c) != "", F.col(c)) for c in contexts]))


# The dice a roll table may be rolled with.
DICE = [2, 3, 4, 5, 6, 8, 10, 12, 20, 100]


def roll_tables(rows: DataFrame) -> DataFrame:
    """Tables whose first column is a run of ranges from 1: (table_id, die, row_no, lo, hi, outcome)."""
    w = W.partitionBy("table_id").orderBy("row_no")
    broken = F.col("roll").rlike(r"^\s*\d{1,3}\s*[-\u2013]\s*$") & F.lead("roll").over(w).rlike(r"^\s*\d{1,3}\s*$")
    rows = rows.withColumn("_b", broken)
    rows = rows.withColumns({"_nr": F.lead("roll").over(w), "_no": F.lead("outcome").over(w), "_tail": F.lag("_b").over(w)})
    joined = rows.where("not coalesce(_tail, false)").withColumns(
        {
            "roll": F.when(F.col("_b"), F.concat(F.trim("roll"), F.trim("_nr"))).otherwise(F.col("roll")),
            "outcome": F.trim(F.when(F.col("_b"), F.concat_ws(" ", "outcome", "_no")).otherwise(F.col("outcome"))),
        }
    )
    # Fixed value: how a range of a roll table is printed.
    pattern = r"^\s*(\d{1,3})\s*(?:[-\u2013]\s*(\d{1,3})|(\+))?\s*$"
    face = lambda g: F.when(F.regexp_extract("roll", pattern, g).rlike("^0+$"), 100).otherwise(F.regexp_extract("roll", pattern, g).try_cast("int"))
    parsed = joined.withColumns({"lo": face(1), "_hi": face(2), "open": F.regexp_extract("roll", pattern, 3) == "+"})
    parsed = parsed.withColumn("hi", F.coalesce("_hi", "lo")).withColumn("ok", F.col("lo").isNotNull() & (F.col("lo") <= F.col("hi")))
    # notes after the last range are cut, if at least two ranges come before
    parsed = parsed.withColumn("_bad", F.sum((~F.col("ok")).cast("int")).over(w)).withColumn("n", F.row_number().over(w))
    first_bad = parsed.groupBy("table_id").agg(
        F.min(F.when(F.col("_bad") > 0, F.col("n"))).alias("cut"), F.max(F.when(F.col("ok"), F.col("n"))).alias("last_ok")
    )
    kept = parsed.join(first_bad, "table_id").where(
        F.col("cut").isNull() | (F.col("n") < F.col("cut")) | (F.col("last_ok") > F.col("cut")) | (F.col("cut") <= 2)
    )
    kept = kept.withColumn("_reach", F.lag("hi").over(w)).withColumn("_last", F.lead("n").over(w).isNull())
    good = F.col("ok") & (F.col("hi") >= F.coalesce("_reach", F.lit(0))) & (~F.col("open") | F.col("_last")) & (F.col("outcome") != "")
    top = F.array_min(F.filter(F.array(*[F.lit(d) for d in DICE]), lambda d: d >= F.col("reach")))
    tables = kept.groupBy("table_id").agg(F.bool_and(good).alias("good"), F.min("lo").alias("lo"), F.max("hi").alias("reach"))
    tables = tables.where("good and lo = 1").withColumn("die", F.when(F.col("reach") > 100, 100).otherwise(top))
    out = kept.join(tables.select("table_id", "die"), "table_id")
    return out.select(
        "table_id", "die", "row_no", "lo", F.when(F.col("open"), F.greatest("die", "lo")).otherwise(F.col("hi")).alias("hi"), "outcome"
    )


def qualify_by_section(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Names qualified by their section in tables where enough rows repeat a name under other sections."""
    per = rows.groupBy("table_id", "name", "section").agg(F.count("*").alias("n"))
    names = per.groupBy("table_id", "name").agg(F.count("*").alias("sections"), F.sum("n").alias("n"))
    tables = names.groupBy("table_id").agg(
        F.sum(F.when(F.col("sections") > 1, F.col("n")).otherwise(0)).alias("again"), F.sum("n").alias("total")
    ).where(F.col("again") >= share * F.col("total")).select("table_id", F.lit(True).alias("_q"))
    return rows.join(tables, "table_id", "left").withColumn(
        "name", F.when(F.col("_q"), F.concat("name", F.lit(" ("), "section", F.lit(")"))).otherwise(F.col("name"))
    ).drop("_q")


def nest_profiles(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows "Base (label)" become modes of the base row; a base without a value takes the first mode's."""
    base = F.regexp_extract("name", r"^(.*?)\s*\(([^)]*)\)$", 1)
    label = F.regexp_extract("name", r"^(.*?)\s*\(([^)]*)\)$", 2)
    rows = rows.withColumns({"_base": F.when(base != "", base), "_label": label})
    modes = rows.where("_base is not null").groupBy(*keys, F.col("_base").alias("name")).agg(
        F.sort_array(F.collect_list(F.struct(order, "_label", value))).alias("modes")
    )
    return rows.where("_base is null").drop("_base", "_label").join(modes, [*keys, "name"], "left").withColumn(
        value, F.coalesce(value, F.col("modes")[0][value])
    )


def named_results(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Cells "Name: effect" as one record each, in tables where enough rows hold one. ``rows``: table_id, row_no, text."""
    pattern = r"^\s*([^:]{1,60}): (.+)$"
    rows = rows.withColumn("name", F.regexp_extract("text", pattern, 1)).withColumn("effect", F.regexp_extract("text", pattern, 2))
    ok = rows.groupBy("table_id").agg(F.count("*").alias("n"), F.count_if(F.col("name") != "").alias("named")).where(
        F.col("named") >= share * F.col("n")
    )
    return rows.join(ok, "table_id", "left_semi").where("name <> ''").select("table_id", "row_no", "name", "effect")


def graded_map(rows: DataFrame, key: str, grade: str, value: str) -> DataFrame:
    """A graded table as a map by grade; the grades are a short scale."""
    once = rows.groupBy(key, grade).agg(F.min(value).alias("_v"))
    return once.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(grade, "_v")))).alias("grades"))


def table_html(cells: DataFrame) -> DataFrame:
    """HTML rows of a table, put together per printed page, so that no value grows with the table."""
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(F.col("bold"), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), esc, F.lit("</"), tag, F.lit(">"))
    rows = cells.withColumn("_c", cell).groupBy("table_id", "page", "row_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "_c"))), lambda c: c["_c"]), "").alias("_r")
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "_r"))), lambda r: F.concat(F.lit("<tr>"), r["_r"], F.lit("</tr>"))), "")
    return rows.groupBy("table_id", "page").agg(body.alias("html"))


def progression(lines: DataFrame, keys: list[str], segment: str, order: str, columns: list[str]) -> DataFrame:
    """Levels and what each grants: lines without a level continue the one above. ``lines``: level, column, text."""
    rows = carry_last(lines, keys, segment, [order], F.col("level"), "in_level").where("in_level is not null")
    per = rows.groupBy(*keys, "in_level", "column").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda r: r["text"]), " ").alias("v")
    )
    return per.groupBy(*keys, F.col("in_level").alias("level")).agg(
        *[F.max(F.when(F.col("column") == c, F.col("v"))).alias(c) for c in columns]
    )


def column_spans(cells: DataFrame, keys: list[str], join: float = 2) -> DataFrame:
    """Columns as the stretches that cells (x, right) cover together: (keys, x, col_no, left, right) for each start of a cell.

    One sweep over the distinct starts, of which a table has no more than a page is wide; no two cells are paired.
    """
    starts = cells.groupBy(*keys, "x").agg(F.max("right").alias("right"))
    w = W.partitionBy(*keys).orderBy("x")
    starts = starts.withColumn("_reach", F.max("right").over(w.rowsBetween(W.unboundedPreceding, -1)))
    starts = starts.withColumn("col_no", islands(F.col("_reach").isNull() | (F.col("x") > F.col("_reach") + join), keys, ["x"]) - 1)
    whole = W.partitionBy(*keys, "col_no")
    return starts.select(*keys, "x", "col_no", F.min("x").over(whole).alias("left"), F.max("right").over(whole).alias("right"))


def header_columns(words: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Header words (order, x, right, text) under the column they overlap most, else the nearest: (keys, col_no, header)."""
    sets = spans.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("col_no", "left", "right"))).alias("_s"))
    far = F.lit(-1e9)
    score = lambda c: F.when(
        F.least("right", c["right"]) > F.greatest("x", c["left"]), F.least("right", c["right"]) - F.greatest("x", c["left"])
    ).otherwise(far - F.abs((F.col("x") + F.col("right")) / 2 - (c["left"] + c["right"]) / 2))
    best = F.array_max(F.transform("_s", lambda c: F.struct(score(c).alias("score"), (-c["col_no"]).alias("less"))))
    placed = words.join(sets, keys).withColumn("col_no", -best["less"])
    parts = F.sort_array(F.collect_list(F.struct("order", "x", "text")))
    return placed.groupBy(*keys, "col_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("header"))


def level_rows(cells: DataFrame, keys: list[str], segment: str, order: str) -> DataFrame:
    """Cells of level tables, placed by their row: (keys, level, line, x, right, text).

    ``cells`` has one row for each cell of a line: ``segment`` (the region it is set in), ``order`` (the line), cell, x, right
    and text. A line whose first cell is the next level opens a row. Others go on with the row above; in a new region they
    are placed as the next row there is. A cell's x is told from its row's level cell, so a table that goes on in another
    column keeps its columns. A line that reaches back into the level column, or that no row follows in its region, ends the table.
    """
    number = F.when(F.col("cell") == 0, F.regexp_extract("text", r"^(\d{1,2})(?:st|nd|rd|th)?$", 1).try_cast("int"))
    cells = cells.withColumn("_number", number)
    place = F.struct(segment, order)
    # at most 99 numbers to a table
    firsts = cells.where("_number is not null").groupBy(*keys, F.col("_number").alias("level")).agg(
        F.min(place).alias("_at"), F.min_by("x", place).alias("_x"), F.min_by("right", place).alias("_r")
    )
    w = W.partitionBy(*keys).orderBy("level")
    firsts = firsts.withColumn("_ok", (F.row_number().over(w) == F.col("level")) & F.coalesce(F.lag("_at").over(w) < F.col("_at"), F.lit(True)))
    firsts = firsts.withColumn("_ok", F.min("_ok").over(w)).where("_ok")
    anchor = firsts.where("level = 1").select(*keys, F.col("_x").alias("_anchor"), F.col("_r").alias("_edge"))
    rows = firsts.select(*keys, F.col(f"_at.{segment}").alias(segment), F.col(f"_at.{order}").alias(order), F.struct("level", F.col("_x").alias("x"), F.col(f"_at.{segment}").alias("seg")).alias("_row"))
    lines = cells.select(*keys, segment, order).distinct().join(rows, [*keys, segment, order], "left")
    lines = carry_last(lines, keys, segment, [order], F.col("_row"), "_in").where("_in is not null")
    lines = cut_lineage(lines).hint("merge")  # carried once more below, which reads it six times
    back = lines.withColumns({"_bs": -F.col(segment), "_bo": -F.col(order)})
    back = carry_last(back, keys, "_bs", ["_bo"], F.col("_row"), "_next").drop("_bs", "_bo")
    same = F.col("_in.seg") == F.col(segment)
    at = F.when(same, F.col("_in.x")).when(F.col("_next.seg") == F.col(segment), F.col("_next.x"))
    lines = back.join(anchor, keys).select(*keys, segment, order, F.col("_row").isNotNull().alias("_opens"), F.col("_in.level").alias("level"), (at - F.col("_anchor")).alias("_dx"), "_edge")
    placed = cells.join(lines, [*keys, segment, order])
    bad = F.col("_dx").isNull() | (~F.col("_opens") & (F.col("x") - F.col("_dx") <= F.col("_edge")))
    ends = placed.where(bad).groupBy(*keys).agg(F.min(place).alias("_end"))
    placed = placed.join(ends, keys, "left").where(F.col("_end").isNull() | (place < F.col("_end")))
    return placed.select(*keys, "level", F.col(order).alias("line"), (F.col("x") - F.col("_dx")).alias("x"), (F.col("right") - F.col("_dx")).alias("right"), "text")


def level_columns(cells: DataFrame, headers: DataFrame, keys: list[str], segment: str, order: str) -> DataFrame:
    """Level tables with columns found by overlap: (keys, level, col_no, header, text), one row for each filled cell."""
    placed = cut_lineage(level_rows(cells, keys, segment, order)).hint("merge")
    spans = column_spans(placed, keys)
    heads = header_columns(headers, spans, keys)
    parts = F.sort_array(F.collect_list(F.struct("line", "x", "text")))
    filled = placed.join(spans.select(*keys, "x", "col_no"), [*keys, "x"]).groupBy(*keys, "level", "col_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    return filled.join(heads, [*keys, "col_no"], "left").select(*keys, "level", "col_no", F.coalesce("header", F.lit("")).alias("header"), "text")


def header_paths(headers: DataFrame, keys: list[str], slack: float = 2) -> DataFrame:
    """Column labels of stacked headers: (keys, x, right, path), a row for each lowest header cell, left to right.

    ``headers`` has level (0 on top), x, right and text. Above each cell stands the narrowest cell of the next level up that
    spans it, or none; a cell that spans none of the level below is a label of its own. Header cells of one table are as
    few as a page is wide, so the forest grows inside one row.
    """
    cell = F.struct("level", "x", "right", "text")
    sets = headers.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    spans = lambda a, b: (a["x"] <= b["x"] + slack) & (a["right"] >= b["right"] - slack) & (a["level"] < b["level"])
    lowest = F.filter("_c", lambda a: ~F.exists("_c", lambda b: spans(a, b)))
    out = sets.select(*keys, "_c", F.posexplode(F.array_sort(F.transform(lowest, lambda c: F.struct(c["x"], c["right"], c["level"], c["text"])))).alias("col_no", "own"))
    above = F.filter("_c", lambda a: spans(a, F.col("own")))
    width = lambda a: a["right"] - a["x"]
    # the narrowest of each level: no other of that level that spans the cell is narrower
    chain = F.filter(above, lambda a: ~F.exists(above, lambda b: (b["level"] == a["level"]) & (F.struct(width(b), b["x"]) < F.struct(width(a), a["x"]))))
    path = F.concat(F.transform(chain, lambda a: a["text"]), F.array(F.col("own.text")))
    return out.select(*keys, "col_no", F.col("own.x").alias("x"), F.col("own.right").alias("right"), path.alias("path"))


def sub_tables(lines: DataFrame, keys: list[str], segment: str, order: str, caption: Column, header: Column, ends: Column, record: Column, least: int = 2, lead: int = 3) -> DataFrame:
    """Lines of captioned tables by part: (keys, segment, order, caption_ord, part, kind), kind 'header' or 'row'.

    Below a caption, header lines next to each other open a part, and the first line that ends a table ends it. The part
    after it counts if it opens at most ``lead`` lines below that end, holds ``least`` records, and all before it count.
    """
    rows = lines.withColumns({"_caption": F.coalesce(caption, F.lit(False)), "_header": F.coalesce(header & ~caption, F.lit(False)), "_ends": F.coalesce(ends & ~caption & ~header, F.lit(False)), "_record": F.coalesce(record, F.lit(False))})
    rows = carry_last(rows, keys, segment, [order], F.when(F.col("_caption"), F.col(order)), "caption_ord")
    rows = previous(rows, keys, segment, [order], F.col("_header"), "_was")
    opens = F.col("_header") & (~F.coalesce("_was", F.lit(False)))
    rows = prefix_sum(rows, keys, segment, [order], opens.cast("long"), "_part").where("caption_ord is not null and not _caption")
    own = [*keys, "caption_ord", "_part"]
    stop = rows.groupBy(*own).agg(F.min(F.when(F.col("_ends"), F.col(order))).alias("_stop"), F.bool_or("_header").alias("_headed"))
    rows = rows.join(stop, own)
    inside = F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))
    parts = rows.where("_headed").groupBy(*own).agg(F.count_if(inside & F.col("_record") & ~F.col("_header")).alias("_records"), F.count_if(~inside).alias("_lead"))
    w = W.partitionBy(*keys, "caption_ord").orderBy("_part")
    ok = F.lag("_lead").over(w).isNull() | ((F.lag("_lead").over(w) <= lead) & (F.col("_records") >= least))
    parts = parts.withColumn("_ok", ok).withColumn("_ok", F.min("_ok").over(w)).withColumn("part", F.row_number().over(w) - 1).where("_ok").select(*own, "part")
    kind = F.when(F.col("_header"), "header").otherwise("row")
    return rows.where(inside).join(parts, own).select(*keys, segment, order, "caption_ord", "part", kind.alias("kind"))


def within_header(runs: DataFrame, keys: list[str], line: str, reach: float = 2, goes_on: float = 1.5) -> DataFrame:
    """Runs that lie under their table's header, or carry on the run before them on their line.

    ``runs`` has x, width, size, and the header's ``header_right`` and ``header_size``; ``keys`` and ``line`` name one line.
    """
    w = W.partitionBy(*keys, line).orderBy("x", F.col("x") + F.col("width"))
    gap = F.col("x") - F.max(F.col("x") + F.col("width")).over(w.rowsBetween(W.unboundedPreceding, -1))
    under = F.col("x") <= F.col("header_right") + reach * F.col("header_size")
    return runs.withColumn("_in", under | F.coalesce(gap <= goes_on * F.col("size"), F.lit(False))).where("_in").drop("_in")


def boundaries(headers: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Left edge of each header label, moved to where most of the data below it starts; on a tie the leftmost."""
    modal = starts.groupBy(*keys, "col_no", "x").agg(F.count("*").alias("n")).groupBy(*keys, "col_no").agg(
        F.min_by("x", F.struct(-F.col("n"), "x")).alias("_x")
    )
    return headers.join(modal, [*keys, "col_no"], "left").select(*keys, "col_no", F.coalesce("_x", "x").alias("edge"))


def cut_runs(runs: DataFrame, edges: DataFrame, keys: list[str], slack: float = 2) -> DataFrame:
    """Runs that cross a column edge, cut there in proportion to their letters."""
    sets = edges.groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("_e"))
    inside = F.expr(f"filter(_e, e -> e > x + {slack} and e < x + width - {slack})")
    runs = runs.join(sets, keys, "left").withColumn("_in", F.coalesce(inside, F.expr("cast(array() as array<bigint>)")))
    at = "concat(array(0), transform(_in, e -> cast(round((e - x) * length(text) / width) as int)), array(length(text)))"
    runs = runs.withColumn("_at", F.expr(at))
    pieces = F.expr(
        """transform(sequence(1, size(_at) - 1), i -> named_struct(
             'part', i - 1, 'text', substr(text, _at[i - 1] + 1, _at[i] - _at[i - 1]),
             'x', if(i = 1, x, _in[i - 2]), 'right', if(i = size(_at) - 1, x + width, _in[i - 1])))"""
    )
    rest = [c for c in runs.columns if c not in ("text", "x", "width") and not c.startswith("_")]
    return runs.withColumn("_p", F.explode(pieces)).select(
        *rest, F.col("_p.part").alias("part"), F.trim("_p.text").alias("text"), F.col("_p.x").alias("x"),
        (F.col("_p.right") - F.col("_p.x")).alias("width"),
    ).where("text <> '' or part = 0")
