"""Headings, sections, fields and lists (inventory G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.scans import carry_last, carry_stack, islands, prefix_sum, previous, running_number
from quire.functions.text import canonical_font
from quire.session import cut_lineage

COLUMN = ["doc_id", "page", "col"]


def headings(lines: DataFrame, body: DataFrame, longest: int = 60) -> DataFrame:
    """Heading lines: short, not in body style, title-like, no label or sentence; lines that wrap join.

    ``lines`` has font, size, weight beside geometry; ``body`` the style of
    each document. Capitals in a face that sets headings elsewhere count too.
    """
    style = F.concat_ws("|", canonical_font(F.col("font")), "size", "weight")
    lines = lines.withColumn("style", style).join(body.select("doc_id", F.col("style").alias("body_style")), "doc_id", "left")
    title_like = (
        (F.length("text") <= longest) & F.col("text").rlike(r"^[\p{Pi}\p{Ps}\"']*[\p{Lu}\p{N}]") & ~F.col("text").rlike(r"[.:,;!?]$")
    )
    first = title_like & (F.col("style") != F.coalesce("body_style", F.lit("")))
    # faces that set headings, in a window of their lines, so that lines are made once
    face = F.max(first).over(W.partitionBy("doc_id", "style"))
    lines = lines.withColumn("_face", F.when(F.col("doc_id").isNotNull(), face))
    shouted = F.coalesce("_face", F.lit(False)) & (F.length("text") <= longest) & F.col("text").rlike(r"\p{Lu}{2}") & ~F.col("text").rlike(r"\p{Ll}")
    lines = lines.withColumn("is_heading", first | shouted)
    w = W.partitionBy(*COLUMN).orderBy(F.desc("y"))
    follows = (
        F.lag("is_heading").over(w) & F.col("is_heading") & (F.lag("style").over(w) == F.col("style"))
        & (F.lag("y").over(w) - F.col("y") <= 1.5 * F.col("size"))
    )
    lines = lines.withColumn("_opens", ~F.coalesce(follows, F.lit(False)))
    lines = lines.withColumn("heading_no", islands(F.col("_opens"), COLUMN, [F.desc("y")])).where("is_heading")
    return lines.groupBy(*COLUMN, "heading_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("ny"), "text"))), lambda l: l["text"]), " ").alias("heading"),
        F.max("y").alias("y"), F.max("size").alias("size"),
    )


def chapter_titles(lines: DataFrame, body: DataFrame, factor: float = 3.5) -> DataFrame:
    """Lines of at least ``factor`` times the text size at the top of their column."""
    size = F.split("style", r"\|")[1].cast("double")
    tops = lines.groupBy(*COLUMN).agg(F.max("y").alias("top"))
    big = lines.join(body.select("doc_id", size.alias("body_size")), "doc_id").where(F.col("size") >= factor * F.col("body_size"))
    return big.join(tops, COLUMN).where("y = top").drop("top", "body_size")


#: Points between two heading levels, and the fewest headings without text that make a contents list.
LEVEL_STEP, CONTENTS = 0.4, 4


def contents_lists(blocks: DataFrame, keys: list[str], segment: str, order: str, size: Column, text: str, step: float = LEVEL_STEP, least: int = CONTENTS) -> DataFrame:
    """``blocks`` with ``listed``: headings that at least ``least - 1`` like ones without text of their own stand before."""
    rows = blocks.withColumns({"_s": size.cast("double"), "_chars": F.when(size.isNull(), F.length(F.trim(text))).otherwise(0)})
    rows = prefix_sum(rows, keys, segment, [order], F.col("_chars"), "_upto")
    heads = rows.where("_s is not null").select(*keys, segment, order, "_s", "_upto")
    heads = previous(heads, keys, segment, [order], F.struct("_s", "_upto"), "_was")
    alike = (F.abs(F.col("_was._s") - F.col("_s")) < step) & (F.col("_upto") - F.col("_was._upto") <= 2)
    heads = heads.withColumn("_alike", F.coalesce(alike, F.lit(False)))
    heads = running_number(heads, keys, segment, [order], "_no")
    heads = carry_last(heads, keys, segment, [order], F.when(~F.col("_alike"), F.col("_no")), "_open")
    heads = heads.select(*keys, order, (F.col("_no") - F.col("_open") >= least - 1).alias("listed"))
    return rows.drop("_s", "_chars", "_upto").join(heads, [*keys, order], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def section_path(blocks: DataFrame, keys: list[str], segment: str, order: str, level: Column, label: str) -> DataFrame:
    """``size_path`` for headings that tell their level, 1 for the highest."""
    return size_path(blocks, keys, segment, order, -level, label)


def size_path(
    blocks: DataFrame, keys: list[str], segment: str, order: str, size: Column, label: str, listed: Column | None = None,
    until: Column | None = None, step: float = LEVEL_STEP,
) -> DataFrame:
    """``path``: the headings each row stands under, outermost first, by type size.

    A heading ends all sections whose heading is not larger by more than ``step``. One that is ``listed`` in a contents list
    heads only the text up to the next heading. ``until`` is where a caption's section ends with its table (null: it does not).
    Sizes may be any number of different ones. ``keys`` and ``order`` name a row; rows without a size are text.
    """
    stays = size if listed is None else F.when(listed, F.lit(-1e300)).otherwise(size)  # below every size, above none at all
    last = F.lit(None).cast(blocks.schema[order].dataType) if until is None else until
    item = F.struct(F.col(label).alias("name"), last.alias("until"))
    rows = carry_stack(blocks, keys, segment, order, size, stays, item, step, "_above")
    open_ = F.filter("_above", lambda e: e["until"].isNull() | (F.col(order) < e["until"]))
    return rows.withColumn("path", F.transform(open_, lambda e: e["name"])).drop("_above")


def fields(lines: DataFrame, keys: list[str], segment: str, order: str) -> DataFrame:
    """Label/value fields: a labelled line opens one, lines continue it while the one before wraps or is unfinished.

    ``lines`` has text and ``right``; a line wraps when it reaches the
    document's usual right edge.
    """
    pattern = r"^(\p{Lu}[\p{L} ]{1,30}): (.*)$"
    edge = lines.groupBy(*keys, "right").agg(F.count("*").alias("_n"))
    # ninth decile from counts per distinct edge, not from the lines
    up = W.partitionBy(*keys).orderBy("right")
    edge = edge.withColumn("_upto", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    edge = edge.where("_upto >= 0.9 * _all").groupBy(*keys).agg(F.min("right").alias("_edge"))
    lines = lines.join(edge, keys).withColumn("label", F.regexp_extract("text", pattern, 1))
    open_end = (F.col("right") >= F.col("_edge")) | F.col("text").rlike(r"[,\-(]$")
    w = W.partitionBy(*keys, segment).orderBy(order)
    lines = lines.withColumn("_goes_on", F.lag(open_end).over(w) & (F.col("label") == ""))
    lines = lines.withColumn("_opens", ~F.coalesce("_goes_on", F.lit(False)))
    lines = prefix_sum(lines, keys, segment, [order], F.col("_opens").cast("int"), "field_no")
    value = F.when(F.col("label") != "", F.regexp_extract("text", pattern, 2)).otherwise(F.col("text"))
    out = lines.groupBy(*keys, "field_no").agg(
        F.max("label").alias("label"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value.alias("t")))), lambda l: l["t"]), " ").alias("value"),
    )
    return out.where("label <> ''")


def entries(blocks: DataFrame, keys: list[str], segment: str, order: str, is_heading: Column) -> DataFrame:
    """Heading with the body below it, down to the next heading."""
    head = F.when(is_heading, F.struct(F.col(order).alias("ord"), F.col("text").alias("heading")))
    rows = carry_last(blocks.withColumn("_is", is_heading), keys, segment, [order], head, "_h").where("_h is not null")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("_is"), F.struct(order, "text")))), lambda l: l["text"]), "\n")
    return rows.groupBy(*keys, F.col("_h.ord").alias("heading_ord")).agg(F.first("_h.heading").alias("heading"), body.alias("body"))


def split_beside(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs beside a box go to a half column of their own, if the page has more text right of the box than left.

    ``boxes`` has one box per page and column: x0, y0, x1, y1.
    """
    placed = runs.join(boxes, COLUMN, "left")
    level = (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    side = F.when(level & (F.col("x") >= F.col("x1")), "right").when(level & (F.col("x") + F.col("width") <= F.col("x0")), "left")
    placed = placed.withColumn("side", side)
    votes = placed.groupBy(*COLUMN).agg(F.count_if(F.col("side") == "right").alias("r"), F.count_if(F.col("side") == "left").alias("l"))
    out = placed.join(votes, COLUMN)
    beside = (F.col("side") == "right") & (F.col("r") >= F.col("l"))
    return out.withColumn("column", F.when(F.coalesce(beside, F.lit(False)), F.col("col") + 0.5).otherwise(F.col("col").cast("double"))).drop(
        "side", "r", "l", "x0", "y0", "x1", "y1"
    )


def learn_labels(headings_: DataFrame, key: list[str], name: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """Words that close at least ``least`` headings and that share of them: labels, not names."""
    last = F.element_at(F.split(F.lower(F.trim(name)), r"\s+"), -1)
    words = headings_.select(*key, last.alias("label")).groupBy(*key, "label").agg(F.count("*").alias("n"))
    total = words.groupBy(*key).agg(F.sum("n").alias("total"))
    return words.join(total, key).where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select(*key, "label", "n")


def without_labels(rows: DataFrame, labels: DataFrame, key: list[str], name: str) -> DataFrame:
    """Names without the label that closes them."""
    last = F.element_at(F.split(F.lower(F.trim(name)), r"\s+"), -1)
    marked = rows.withColumn("label", last).join(labels.select(*key, "label", F.lit(True).alias("_is")), [*key, "label"], "left")
    return marked.withColumn(name, F.when(F.col("_is"), F.trim(F.regexp_replace(name, r"\s*\S+\s*$", ""))).otherwise(F.col(name))).drop("label", "_is")


def modal_sizes(entries_: DataFrame, kind: str, size: str) -> DataFrame:
    """Heading size most entries of a kind have, the largest on a tie."""
    return entries_.groupBy(kind, size).agg(F.count("*").alias("n")).groupBy(kind).agg(F.max_by(size, F.struct("n", size)).alias("modal"))


def part_of_parent(entries_: DataFrame, modal: DataFrame, kind: str, keys: list[str], segment: str, order: str, size: str) -> DataFrame:
    """Entries smaller than their kind's size belong to the last full-size entry before them."""
    rows = entries_.join(modal, kind).withColumn("is_part", F.col(size) < F.col("modal"))
    return carry_last(rows, keys, segment, [order], F.when(~F.col("is_part"), F.col(order)), "parent").withColumn(
        "parent", F.when(F.col("is_part"), F.col("parent"))
    )


def type_entries(entries_: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Kind of each entry by the first rule that holds over heading, fields and sections."""
    chain = None
    for holds, kind in rules:
        chain = F.when(holds, kind) if chain is None else chain.when(holds, kind)
    return entries_.withColumn("kind", chain)


def sibling_types(entries_: DataFrame, section: list[str], least: int = 2) -> DataFrame:
    """Untyped entries take the kind of their section, if enough siblings have one and all agree."""
    votes = entries_.where("kind is not null").groupBy(*section).agg(
        F.count("*").alias("n"), F.min("kind").alias("a"), F.max("kind").alias("b")
    ).where((F.col("n") >= least) & (F.col("a") == F.col("b")))
    return entries_.join(votes.select(*section, F.col("a").alias("_k")), section, "left").withColumn("kind", F.coalesce("kind", "_k")).drop("_k")


def carry_forward(rows: DataFrame, keys: list[str], segment: str, order: str, value: Column, reset: Column) -> DataFrame:
    """Value in force: the last one named, until a row resets it."""
    state = F.when(value.isNotNull() | reset, F.struct(F.when(~reset, value).alias("v")))
    return carry_last(rows, keys, segment, [order], state, "_s").withColumn("in_force", F.col("_s.v")).drop("_s")


def split_listed(entries_: DataFrame, keys: list[str], is_list: Column) -> DataFrame:
    """A listing entry becomes one entry per item, each with its place in the list."""
    items = F.when(is_list, F.split("text", r"\s*[;\n]\s*")).otherwise(F.array("text"))
    return entries_.select(*keys, F.posexplode(items).alias("item_no", "item")).where("item <> ''")


def label_pairs(text: str, labels: list[str]) -> Column:
    """Map of the text after each label of a fixed set; longest labels are tried first, the first occurrence counts."""
    alternatives = "|".join(sorted(labels, key=lambda v: (-len(v), v)))
    pattern = rf"\b({alternatives}):\s*"
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.slice(F.split(text, pattern, -1), F.lit(2), F.greatest(F.size(names), F.lit(1)))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    # later occurrences of a label are dropped before the map is built
    once = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.map_from_entries(F.transform(once, lambda p: F.struct(p["k"], F.trim(p["v"]))))


def explode_list(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Items of a comma list, commas in brackets not counting: name, note in brackets, count, highest kept per name."""
    items = rows.select(*keys, F.explode(F.split(text, r"\s*,\s*(?![^()]*\))")).alias("item")).where("item <> ''")
    pattern = r"^(.*?)(?: x(\d+))?(?:\s*\(([^)]*)\))?$"
    items = items.select(
        *keys, F.regexp_extract("item", pattern, 1).alias("name"),
        F.coalesce(F.regexp_extract("item", pattern, 2).try_cast("int"), F.lit(1)).alias("count"),
        F.regexp_extract("item", pattern, 3).alias("note"),
    )
    return items.groupBy(*keys, "name").agg(F.max("count").alias("count"), F.max_by("note", F.struct("count", "note")).alias("note"))


def inline_profiles(rows: DataFrame, keys: list[str], text: str, notation: dict[str, str]) -> DataFrame:
    """Profiles "name (part; part)" in running text, each part placed by its notation."""
    pattern = r"([\p{Lu}][\p{L}\p{N} ]*?) \(([^()]*;[^()]*)\)"
    found = rows.select(
        *keys, F.explode(F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("parts"))).alias("p")
    ).select(*keys, "p.name", F.split("p.parts", r"\s*;\s*").alias("parts"))
    return found.select(
        *keys, "name", *[F.get(F.filter("parts", lambda v: v.rlike(p)), F.lit(0)).alias(role) for role, p in notation.items()]
    )


def amounts(rows: DataFrame, keys: list[str], text: str, vocab: list[str], unique: bool = False) -> DataFrame:
    """Signed amounts of known keys summed; clauses that state a condition are left out.

    A row's amounts are summed inside it. With ``unique`` (no two rows have the same ``keys``) that is all; otherwise rows are summed up.
    """
    # Words that make a clause conditional.
    plain = F.filter(F.split(text, r"[.;]\s*|,\s*(?=[a-z])"), lambda c: ~c.rlike(r"(?i)\b(if|unless|when|while|against)\b"))
    pattern = rf"([+-]\d+) ({'|'.join(vocab)})\b"
    found = F.flatten(F.transform(plain, lambda c: F.arrays_zip(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("k")
    )))
    total = lambda k: F.aggregate("_found", F.lit(0).cast("long"), lambda s, p: F.when(p["k"] == k, s + p["n"].cast("int")).otherwise(s))
    # the array of one entry is worked out once
    rows = rows.select(*keys, F.explode(F.array(found)).alias("_found"))
    sums = F.transform(F.array_distinct(F.col("_found.k")), lambda k: F.struct(k.alias("key"), total(k).alias("amount")))
    rows = rows.select(*keys, F.explode(sums).alias("p")).select(*keys, "p.key", "p.amount")
    return rows if unique else rows.groupBy(*keys, "key").agg(F.sum("amount").alias("amount"))


def gates(rows: DataFrame, keys: list[str], text: str, vocab: list[str]) -> DataFrame:
    """Minimums "Key 30" of a list as rows; alternatives ("A 30 or B 20") stay text."""
    parts = rows.select(*keys, F.explode(F.split(text, r"\s*,\s*")).alias("part")).where("part <> ''")
    pattern = rf"^({'|'.join(vocab)}) (\d+)\+?$"
    key = F.regexp_extract("part", pattern, 1)
    return parts.select(
        *keys, F.when(key != "", key).otherwise("text").alias("key"),
        F.when(key != "", F.regexp_extract("part", pattern, 2)).otherwise(F.col("part")).alias("value"),
    )


def page_numbering(runs: DataFrame, page_height: float = 792, least: int = 5, gap: int = 3, region: int = 5) -> DataFrame:
    """Printed number minus page index where margin numbers agree: (doc_id, offset, first, last, pages).

    Votes of an offset form regions of pages with small gaps; only the regions
    of a document's numbers are kept, not its pages.
    """
    marginal = (F.col("y") < page_height * 0.08) | (F.col("y") > page_height * 0.92)
    votes = runs.where(marginal & F.col("text").rlike(r"^\d{1,4}$")).select(
        "doc_id", "page", (F.col("text").cast("int") - F.col("page")).alias("offset")
    ).distinct()
    # a few rows a page, which several branches below read: the runs are read once for them
    votes = cut_lineage(votes)
    votes = previous(votes.withColumn("seg", F.floor(F.col("page") / 1024)), ["doc_id", "offset"], "seg", ["page"], F.col("page"), "_p")
    votes = votes.withColumn("_o", F.col("_p").isNull() | (F.col("page") - F.col("_p") > gap))
    votes = prefix_sum(votes, ["doc_id", "offset"], "seg", ["page"], F.col("_o").cast("int"), "region")
    regions = votes.groupBy("doc_id", "offset", "region").agg(
        F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("pages")
    )
    return regions.where((F.col("pages") >= least) & (F.col("last") - F.col("first") + 1 >= region)).drop("region")


def printed_page(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Printed number of each page: the offset of the best supported region it lies in, else the document's main offset, else one."""
    main = regions.groupBy("doc_id").agg(F.min_by("offset", F.struct(-F.col("pages"), "offset")).alias("_main"))
    inside = pages.join(regions, "doc_id").where("page between first and last").groupBy("doc_id", "page").agg(
        F.min_by("offset", F.struct(-F.col("pages"), "offset")).alias("_in")
    )
    return pages.join(inside, ["doc_id", "page"], "left").join(main, "doc_id", "left").select(
        "doc_id", "page", (F.col("page") + F.coalesce("_in", "_main", F.lit(1))).alias("printed")
    )


def cited_ranges(citing: DataFrame, readings: DataFrame, pattern: str = r"pages (\d+)-(\d+)") -> DataFrame:
    """Readings on a printed page that their book's text cites. Cited spans become page keys, so the join is an equality."""
    spans = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("lo"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("hi")
    )
    cited = citing.select("book", F.explode(spans).alias("s")).select("book", F.col("s.lo").cast("int").alias("lo"), F.col("s.hi").cast("int").alias("hi"))
    cited = cited.where("lo <= hi").distinct().select("book", F.explode(F.sequence("lo", "hi")).alias("page")).distinct()
    return readings.join(cited, ["book", "page"], "left_semi")
