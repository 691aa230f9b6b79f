"""Entity building and merging (inventory I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import keys as K
from quire.functions.jsonleaf import nested as json_of
from quire.functions.scans import as_of, carry_last


def with_keys(df: DataFrame, name: str) -> DataFrame:
    c = F.col(name)
    return df.withColumns(
        {
            "name_key": K.name_key(c), "singular": K.singular_key(c), "bare": K.unqualified(c),
            "bag": K.word_bag(c), "slug": K.slug(c), "identifier": K.identifier(c),
        }
    )


def consolidate(records: DataFrame, key: list[str], signature: str, richness: Column, id_: str) -> DataFrame:
    """One record per key and signature; readings without one join the only signature there is.

    Counts come from an aggregate per (key, signature), so copies combine
    before the shuffle and no group is collected.
    """
    best = records.withColumn("_rich", richness).groupBy(*key, signature).agg(
        F.count("*").alias("n"), F.min_by(id_, F.struct(-F.col("_rich"), F.col(id_))).alias(id_), F.max("_rich").alias("_rich")
    )
    sole = best.where(F.col(signature).isNotNull()).groupBy(*key).agg(F.count("*").alias("n_sig"), F.min(signature).alias("only"))
    joined = best.join(sole, key, "left").withColumn(
        signature, F.coalesce(signature, F.when(F.col("n_sig") == 1, F.col("only")))
    )
    return joined.groupBy(*key, signature).agg(
        F.sum("n").alias("readings"), F.min_by(id_, F.struct(-F.col("_rich"), F.col(id_))).alias(id_)
    )


def deep_fill(leaf_rows: DataFrame, key: list[str], rank: list[str]) -> DataFrame:
    """Per entity and path the first reading's value that has content."""
    filled = leaf_rows.where(~F.col("value").isin('""', "null", "[]", "{}"))
    return filled.groupBy(*key, "path").agg(F.min_by("value", F.struct(*rank)).alias("value"))


def rebuilt(leaf_rows: DataFrame, key: list[str]) -> DataFrame:
    """One JSON document, ``doc``, for each entity's leaves."""
    return leaf_rows.groupBy(*key).agg(F.collect_list(F.struct("path", "value")).alias("_l")).select(*key, json_of(F.col("_l")).alias("doc"))


def cite(readings: DataFrame, key: list[str], tier: Column, page: str) -> DataFrame:
    """The page of the most trusted reading, the first such page."""
    return readings.groupBy(*key).agg(F.min_by(page, F.struct(tier.alias("t"), F.col(page))).alias("cited"))


def attach_prose(entities: DataFrame, entries: DataFrame, words: int = 8) -> DataFrame:
    """Body of the first entry of an entity's name, else of its unqualified name, where it has none.

    Entities have name, body; entries heading, body, ord.
    """
    long = entries.where(F.size(F.split(F.trim("body"), r"\s+")) >= words)
    by_key = lambda key, out: long.withColumn("_k", key).where("_k <> ''").groupBy("_k").agg(F.min_by("body", "ord").alias(out))
    full, bare = by_key(K.name_key(F.col("heading")), "_full"), by_key(K.unqualified(F.col("heading")), "_bare")
    out = entities.withColumns({"_fk": K.name_key(F.col("name")), "_bk": K.unqualified(F.col("name"))})
    out = out.join(full.withColumnRenamed("_k", "_fk"), "_fk", "left").join(bare.withColumnRenamed("_k", "_bk"), "_bk", "left")
    body = F.when(F.coalesce("body", F.lit("")) != "", F.col("body")).otherwise(F.coalesce("_full", "_bare", F.lit("")))
    return out.withColumn("body", body).drop("_fk", "_bk", "_full", "_bare")


def introduce(grids: DataFrame, entries: DataFrame, key: str, page: str, reach: int, id_: str, value: str, segment: int = 64) -> DataFrame:
    """The nearest earlier entry of each grid's name, at most ``reach`` pages before."""
    found = as_of(grids, entries, [key], page, id_, value, "_as", F.floor(F.col(page) / segment))
    near = F.col(page) - F.col("_as.at") <= reach
    return found.withColumn("introduced", F.when(near, F.col("_as.value"))).drop("_as")


def embed_items(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Each listed name resolved: exact, without qualifier, singular, else bare.

    ``lists`` has owner, pos, name; ``items`` id, name. Names are resolved once
    per distinct name, then joined to the lists.
    """
    names = lists.select("name").distinct()
    exact, bare, singular = K.name_key(F.col("name")), K.unqualified(F.col("name")), K.singular_key(F.col("name"))
    asked = names.select("name", F.explode(F.array(
        F.struct(F.lit(1).alias("tier"), exact.alias("k")), F.struct(F.lit(2).alias("tier"), bare.alias("k")),
        F.struct(F.lit(3).alias("tier"), singular.alias("k")))).alias("a")).select("name", "a.*")
    held = items.groupBy(exact.alias("k")).agg(F.min("id").alias("id"))
    hit = asked.join(held, "k").groupBy("name").agg(F.min("tier").alias("tier"), F.min_by("id", "tier").alias("id"))
    return lists.join(hit, "name", "left").select("owner", "pos", "name", F.coalesce("tier", F.lit(0)).alias("tier"), "id")


def nested(embedded: DataFrame) -> DataFrame:
    """Items back into their owners, in list order. An owner's list is part of its own document."""
    return embedded.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "id"))).alias("items"))


def fill_modal(rows: DataFrame, key: str, column: str) -> DataFrame:
    """A missing value takes the one most printed under its key; on a tie the lowest."""
    modal = rows.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n")).groupBy(key).agg(
        F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("_modal")
    )
    return rows.join(modal, key, "left").withColumn(column, F.coalesce(column, "_modal")).drop("_modal")


def used_with(entities: DataFrame, kinds: DataFrame, records: DataFrame) -> DataFrame:
    """Kinds the pieces of a list name, directly or as one of the document's own records, in their three singular forms.

    ``entities`` id, uses; ``kinds`` kind; ``records`` name, kind.
    """
    pieces = entities.select("id", F.explode(F.split(F.lower("uses"), r"\s*(?:,| and | )\s*")).alias("p")).where("p <> ''")
    forms = F.array_distinct(F.array("p", F.regexp_replace("p", "s$", ""), F.regexp_replace("p", "es$", "")))
    pieces = pieces.select("id", F.explode(forms).alias("k"))
    known = kinds.select(F.lower("kind").alias("k"), "kind").unionByName(records.select(F.lower("name").alias("k"), "kind")).distinct()
    return pieces.join(known, "k").select("id", "kind").distinct()


def derive_defaults(rows: DataFrame, column: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """The value of the first rule that holds, only where the column is unset."""
    chain = None
    for holds, value in rules:
        chain = F.when(holds, value) if chain is None else chain.when(holds, value)
    return rows.withColumn(column, F.coalesce(F.col(column), chain))


def harmonise_types(rows: DataFrame, key: Column, is_entry: Column, kind: str, order: str) -> DataFrame:
    """A table row takes the type of the first entry of its name."""
    rows = rows.withColumn("_k", key).withColumn("_entry", is_entry)
    types = rows.where("_entry").groupBy("_k").agg(F.min_by(kind, order).alias("_type"))
    return rows.join(types, "_k", "left").withColumn(
        kind, F.when(~F.col("_entry"), F.coalesce("_type", kind)).otherwise(F.col(kind))
    ).drop("_k", "_entry", "_type")


def drop_named(rows: DataFrame, other: DataFrame, name: str, other_name: str) -> DataFrame:
    """Rows whose name no row of ``other`` bears."""
    named = other.select(K.singular_key(F.col(other_name)).alias("_k")).distinct()
    return rows.withColumn("_k", K.singular_key(F.col(name))).join(named, "_k", "left_anti").drop("_k")


def head_nouns(rows: DataFrame, name: str, of: Column) -> DataFrame:
    """Words that close a name of the class and no name outside it, by one aggregate over both."""
    last = F.element_at(F.split(F.lower(F.trim(name)), r"\s+"), -1)
    return rows.groupBy(last.alias("noun")).agg(F.bool_or(of).alias("inside"), F.bool_or(~of).alias("outside")).where(
        "inside and not outside"
    ).select("noun")


def sequences(rows: DataFrame, names: DataFrame, words: str, name: str) -> DataFrame:
    """``rows`` once for each sequence in the array ``words`` that is as long as one of the ``names`` (``name``: words
    between single spaces). The lengths that names have are one row."""
    lengths = names.agg(F.array_sort(F.collect_set(F.size(F.split(name, " ")))).alias("_lengths"))
    grams = F.expr(
        f"flatten(transform(_lengths, n -> transform(filter(sequence(1, size({words})), i -> i + n - 1 <= size({words})), i -> array_join(slice({words}, i, n), ' '))))"
    )
    return rows.where(F.size(words) > 0).crossJoin(F.broadcast(lengths)).withColumn(name, F.explode(F.array_distinct(grams))).drop(words, "_lengths")


def attach_tables(tables: DataFrame, owners: DataFrame) -> DataFrame:
    """Each table's owner: the longest owner name its title holds, else the last owner named before it.

    ``tables`` book, ord, title; ``owners`` name. Titles are cut to word
    sequences, so names are found by an equality.
    """
    names = owners.select(F.array_join(K.name_words(F.col("name")), " ").alias("k"), "name").distinct()
    asked = sequences(tables.select("book", "ord", K.name_words(F.col("title")).alias("w")), names, "w", "k")
    hit = asked.join(names, "k").groupBy("book", "ord").agg(F.min_by("name", F.struct(-F.length("k"), "k", "name")).alias("named"))
    rows = tables.join(hit, ["book", "ord"], "left").withColumn("seg", F.floor(F.col("ord") / 64))
    out = carry_last(rows, ["book"], "seg", ["ord"], F.col("named"), "owner")
    how = F.when(F.col("named").isNotNull(), "named").when(F.col("owner").isNotNull(), "before").otherwise("shared")
    return out.withColumn("how", how).drop("seg", "named")


def rank_numbers(ranks: DataFrame, owner: str, threshold: str) -> DataFrame:
    """Dense number of each distinct threshold of an owner, from 1. Only distinct thresholds are ordered."""
    w = W.partitionBy(owner).orderBy(threshold)
    return ranks.select(owner, threshold).distinct().withColumn("rank", F.dense_rank().over(w))


def advances(rows: DataFrame, cells: str) -> DataFrame:
    """Advance rows anchored on their cost cell: the name before it, the type and prerequisite after it."""
    at = F.expr(f"coalesce(array_position(transform({cells}, c -> c rlike '^[0-9,]+$'), true), 0)")
    rows = rows.withColumn("_at", at.cast("int")).where("_at > 1")
    return rows.withColumns(
        {
            "advance": F.array_join(F.expr(f"slice({cells}, 1, _at - 1)"), " "),
            "cost": F.expr(f"cast(replace({cells}[_at - 1], ',', '') as bigint)"),
            "kind": F.coalesce(F.get(F.col(cells), F.col("_at")), F.lit("")),
            "prerequisite": F.coalesce(F.get(F.col(cells), F.col("_at") + 1), F.lit("")),
        }
    ).drop("_at")


def cost_matrix(rows: DataFrame, key: str, column: str, cost: str) -> DataFrame:
    """Costs as a map by column name; the columns are the schema's, not the data's."""
    w = rows.groupBy(key, column).agg(F.min(cost).alias("_c"))
    return w.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "_c")))).alias("costs"))


def name_gates(
    texts: DataFrame, names: DataFrame, duty: str = "must|requires?|needs?|only with", ban: str = "cannot|may not|must not|never|without"
) -> DataFrame:
    """Sentences naming another record with a duty or a ban become references of that kind.

    ``texts`` id, text; ``names`` name (lower-case word sequences); ``duty`` and
    ``ban`` are alternatives of words that oblige and forbid.
    """
    sentences = texts.select("id", F.explode(F.split(F.lower("text"), r"[.!?\n]+\s*")).alias("s"))
    holds = lambda words: F.col("s").rlike(rf"(^|[^\p{{L}}])({words})($|[^\p{{L}}])")
    kind = F.when(holds(ban), "forbids").when(holds(duty), "requires")
    marked = sentences.withColumn("kind", kind).where("kind is not null").withColumn("w", F.regexp_extract_all("s", F.lit(r"\p{L}+"), F.lit(0)))
    hits = sequences(marked.select("id", "kind", "w"), names, "w", "name")
    return hits.join(names.select("name").distinct(), "name", "left_semi").select("id", "name", "kind").distinct()


def keep_rejects(entities: DataFrame, rejects: DataFrame, id_: str) -> DataFrame:
    """Values that could not be typed are appended to the description, once each."""
    once = rejects.select(id_, "role", "raw").distinct().groupBy(id_).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("role", "raw"))), lambda r: F.concat_ws(": ", r["role"], r["raw"])), "; ").alias("_kept")
    )
    return entities.join(once, id_, "left").withColumn("description", F.concat_ws(" ", "description", "_kept")).drop("_kept")


def complete_names(records: DataFrame, bigrams: DataFrame, name: str) -> DataFrame:
    """A one-word name takes the word the document most often prints before it."""
    fuller = bigrams.groupBy(F.col("b").alias("_k")).agg(F.min_by("a", F.struct(-F.col("n_pair"), "a")).alias("_lead"), F.max("n_pair").alias("_n"))
    out = records.withColumn("_k", F.lower(name)).join(fuller, "_k", "left")
    return out.withColumn(name, F.when(F.col("_n") >= 2, F.concat_ws(" ", "_lead", name)).otherwise(F.col(name))).drop("_k", "_lead", "_n")


def choice_groups(entries: DataFrame, keys: list[str], segment: str, order: list[str], is_group: Column, label: str) -> DataFrame:
    """Options carry the label of the choice group they stand under."""
    return carry_last(entries, keys, segment, order, F.when(is_group, F.col(label)), "choice")


def first_reader_wins(readings: DataFrame, group: list[str], rank: str, key: str) -> DataFrame:
    """Readings of the first reader of a group, and later ones whose name no earlier reader gave."""
    first = readings.groupBy(*group, key).agg(F.min(rank).alias("_first"))
    return readings.join(first, [*group, key]).where(F.col(rank) == F.col("_first")).drop("_first")


def claim_parts(entries: DataFrame, keys: list[str], segment: str, order: str, is_head: Column, style: str, reach: int = 1) -> DataFrame:
    """Entries after a head, all in one style and within ``reach`` of it, up to the next head or the first break, belong to it."""
    head = F.when(is_head, F.struct(F.col(order).alias("ord"), F.col(segment).alias("page")))
    rows = carry_last(entries.withColumn("_is", is_head), keys, segment, [order], head, "_h")
    parts = rows.where("not _is and _h is not null")
    first = parts.groupBy(*keys, F.col("_h.ord").alias("head_ord")).agg(F.min_by(style, order).alias("_style"))
    parts = parts.withColumn("head_ord", F.col("_h.ord")).join(first, [*keys, "head_ord"])
    fits = (F.col(style) == F.col("_style")) & (F.col(segment) - F.col("_h.page") <= reach)
    parts = parts.withColumn("_fits", fits)
    breaks = parts.where("not _fits").groupBy(*keys, "head_ord").agg(F.min(order).alias("_break"))
    parts = parts.join(breaks, [*keys, "head_ord"], "left").where(F.col("_break").isNull() | (F.col(order) < F.col("_break")))
    return parts.drop("_is", "_h", "_style", "_fits", "_break")


def absorb(records: DataFrame, others: DataFrame, key: str, page: str, id_: str, reach: int = 1, segment: int = 64) -> DataFrame:
    """Each record without its own figure and the record of its name at most ``reach`` before it."""
    found = as_of(records, others, [key], page, id_, id_, "_as", F.floor(F.col(page) / segment), inclusive=True)
    return found.withColumn("absorbed_by", F.when(F.col(page) - F.col("_as.at") <= reach, F.col("_as.value"))).drop("_as")


def fix_misprints(records: DataFrame, name: str, signature: str, section: str, order: str) -> DataFrame:
    """A name repeated with another signature under another section takes that section's name."""
    first = records.groupBy(name).agg(F.min_by(F.struct(signature, section), order).alias("_f"))
    wrong = (F.col(f"_f.{signature}") != F.col(signature)) & (F.col(f"_f.{section}") != F.col(section))
    return records.join(first, name).withColumn("fixed", F.when(wrong, F.col(section)).otherwise(F.col(name))).drop("_f")


def explode_children(owners: DataFrame, rules: DataFrame, owner: str) -> DataFrame:
    """Rules of an owner as records of their own, named ``rule (owner)``."""
    return rules.join(owners, owner).withColumn("child", F.concat("rule", F.lit(" ("), "name", F.lit(")")))


def link_children(children: DataFrame, owner: str, label: str) -> DataFrame:
    """Children back to their owner, options grouped by label."""
    return children.groupBy(owner, label).agg(F.array_join(F.sort_array(F.collect_list("child")), "; ").alias("options"))


def drop_given(inline: DataFrame, named: DataFrame, name: str, other_name: str) -> DataFrame:
    """Inline profiles whose name another reading gives are dropped."""
    return drop_named(inline, named, name, other_name)


# How a chart's box writes where its rank starts, and the two ways in which the title takes the "XP" of that line.
XP_LINE = r"(?i)^\s*XP(?:\s+level)?\s*:?\s*(\d[\d,]*)\s*(?:[-–—]|\+|to\b)"
TITLE_THEN_XP = r"^(.*\p{L}.*?)\s+XP\s*$"
LEVEL_LINE = r"(?i)^\s*level\s*:?\s*\d"
TITLE_REACH = 4


def rank_charts(runs: DataFrame, band: int = 64) -> DataFrame:
    """Ranks of charts: (doc_id, page, ord, title, min_xp, x, level), a box for each line that tells the XP a rank starts at.

    A box's title is the text in other faces that stands just above its XP line, within the line's width. Ranks that start at
    the same XP are branches of one level. Pages with one box alone hold no chart. Lines meet titles in bands of the page.
    """
    page = ["doc_id", "page"]
    bands = lambda lo, hi: F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band))).alias("_band")
    reach = TITLE_REACH * F.col("size")
    titles = runs.where(F.col("text").rlike(TITLE_THEN_XP)).select(*page, F.col("ord").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("width").alias("tw"), F.floor(F.col("y") / band).alias("_band"))
    levels = runs.where(F.col("text").rlike(LEVEL_LINE)).select(*page, F.col("ord").alias("l"), "x", "y", "size", bands(F.col("y"), F.col("y") + reach))
    under = levels.join(titles, [*page, "_band"]).where((F.col("y") < F.col("ty")) & (F.col("ty") - F.col("y") <= reach) & (F.abs(F.col("x") - F.col("tx")) <= F.col("tw")))
    lost = under.select(*page, F.col("t").alias("ord"), F.lit("title").alias("_is")).unionByName(under.select(*page, F.col("l").alias("ord"), F.lit("line").alias("_is")))
    lost = lost.groupBy(*page, "ord").agg(F.max("_is").alias("_is"))
    text = F.when(F.col("_is") == "title", F.regexp_extract("text", TITLE_THEN_XP, 1)).when(F.col("_is") == "line", F.concat(F.lit("XP "), F.trim("text"))).otherwise(F.col("text"))
    runs = runs.join(lost, [*page, "ord"], "left").withColumn("text", text).withColumn("_xp", F.col("text").rlike(XP_LINE))
    lines = runs.where("_xp").select(
        *page, "ord", "font", F.col("x").alias("lx"), F.col("width").alias("lw"), F.col("y").alias("ly"), reach.alias("_reach"),
        F.replace(F.regexp_extract("text", XP_LINE, 1), F.lit(","), F.lit("")).cast("long").alias("min_xp"), bands(F.col("y"), F.col("y") + reach),
    )
    heads = runs.where(~F.col("_xp") & F.col("text").rlike(r"\p{L}")).select(*page, F.col("font").alias("_f"), "x", "y", "width", F.trim("text").alias("text"), F.floor(F.col("y") / band).alias("_band"))
    centre = F.col("x") + F.col("width") / 2
    above = (F.col("y") > F.col("ly")) & (F.col("y") <= F.col("ly") + F.col("_reach")) & (centre >= F.col("lx")) & (centre <= F.col("lx") + F.col("lw"))
    met = lines.join(heads, [*page, "_band"]).where(above & (F.col("_f") != F.col("font")))
    words = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("ny"), "x", "text"))), lambda w: w["text"])
    boxes = met.groupBy(*page, "ord", "min_xp", (F.col("lx") + F.col("lw") / 2).alias("x")).agg(F.array_join(words, " ").alias("title"))
    title = F.trim(F.regexp_replace(F.regexp_replace("title", r"\s+", " "), r"(-\p{Lu}) (\p{Ll})", "$1$2"))
    of_page = W.partitionBy(*page)
    boxes = boxes.withColumns({"title": title, "_n": F.count("*").over(of_page), "level": F.dense_rank().over(of_page.orderBy("min_xp"))})
    return boxes.where("_n > 1").select(*page, "ord", "title", "min_xp", "x", "level")


def branch_paths(ranks: DataFrame) -> DataFrame:
    """Path of each rank down from the first: its parent is the nearest box one level up (x), the left one on a tie.

    ``ranks`` owner, level, box, x. Each step adds a level, for as many as the data has.
    """
    key = ["owner", "level"]
    up = ranks.select("owner", (F.col("level") + 1).alias("level"), F.struct("x", "box").alias("_p"))
    tagged = ranks.select(*key, "box", "x", F.lit(1).alias("side"), F.lit(None).cast(up.schema["_p"].dataType).alias("_p")).unionByName(
        up.select(*key, F.lit(None).cast("string").alias("box"), F.col("_p.x").alias("x"), F.lit(0).alias("side"), "_p")
    )
    w = W.partitionBy(*key).orderBy("x", "side", "_p.box", "box")
    near = tagged.withColumns(
        {
            "_l": F.last("_p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "_r": F.first("_p", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)),
        }
    ).where("side = 1")
    left = F.col("_r").isNull() | (F.col("x") - F.col("_l.x") <= F.col("_r.x") - F.col("x"))
    parent = F.when(F.col("_l").isNotNull() & left, F.col("_l.box")).otherwise(F.col("_r.box"))
    near = near.select("owner", "level", "box", parent.alias("parent"))
    out = near.where("parent is null").select("owner", "level", "box", F.col("box").alias("path"))
    last = out
    for _ in range(ranks.select("level").distinct().count() - 1):
        last = near.join(last.select("owner", F.col("box").alias("parent"), F.col("path").alias("_up")), ["owner", "parent"]).select(
            "owner", "level", "box", F.concat_ws(" > ", "_up", "box").alias("path")
        )
        out = out.unionByName(last)
    return out
