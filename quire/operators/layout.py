"""Geometry of pages: gutters, columns, reading order, lines and cells (inventory B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.geometry import in_furniture_band, in_side_margin, quantise
from quire.functions.scans import islands, running_number
from quire.functions.text import canonical_font
from quire.session import cut_lineage

PAGE = ["doc_id", "page"]


def quantise_columns(df: DataFrame, columns: list[str], step: float) -> DataFrame:
    return df.withColumns({c: quantise(F.col(c), step) for c in columns})


def encode_faces(runs: DataFrame) -> DataFrame:
    """Canonical font, and the index of font and size in the sorted sets of their document.

    A document sets text in a few faces and quantised sizes, so the sets are
    small whatever its length.
    """
    runs = runs.withColumn("face", canonical_font(F.col("font"))).withColumn("qsize", quantise(F.col("size"), 0.25))
    seen = runs.groupBy("doc_id", "face", "qsize").agg(F.lit(1).alias("_one"))
    sets = seen.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("face")).alias("faces"), F.sort_array(F.collect_set("qsize")).alias("sizes")
    )
    return (
        runs.join(sets, "doc_id")
        .withColumn("font_no", F.array_position("faces", F.col("face")) - 1)
        .withColumn("size_bucket", F.array_position("sizes", F.col("qsize")) - 1)
        .drop("faces", "sizes")
    )


def page_gutters(
    runs: DataFrame, page_width: float = 612, page_height: float = 792, min_width: int = 8, max_crossing: int = 2
) -> DataFrame:
    """Empty vertical channels of each page: (doc_id, page, gutter_no, gutter_left, gutter_right).

    Coverage changes only where a run begins or ends, so the histogram is a
    sweep over those points (two rows per run before map-side sums), not a row
    per covered point.
    """
    body = (
        (F.col("width") > 0)
        & ~in_furniture_band(F.col("y"), F.lit(page_height))
        & ~in_side_margin(F.col("x"), F.col("x") + F.col("width"), F.lit(page_width))
    )
    one = F.when(body, 1).otherwise(0)
    ends = runs.where("x is not null and width is not null").select(
        *PAGE,
        F.explode(
            F.array(
                F.struct(F.floor("x").alias("at"), one.alias("step"), F.lit(0).alias("side")),
                F.struct(F.ceil(F.col("x") + F.col("width")).alias("at"), (-one).alias("step"), F.lit(1).alias("side")),
            )
        ).alias("e"),
    )
    # runs that cover nothing count for the bounds of their page alone
    sweep = ends.groupBy(*PAGE, F.col("e.at").alias("at")).agg(
        F.sum("e.step").alias("step"), F.min("e.side").alias("side"), F.max("e.side").alias("other")
    )
    page = W.partitionBy(*PAGE)
    sweep = sweep.withColumns(
        {"lo": F.min(F.when(F.col("side") == 0, F.col("at"))).over(page), "hi": F.max(F.when(F.col("other") == 1, F.col("at"))).over(page)}
    )
    w = W.partitionBy(*PAGE).orderBy("at")
    sweep = sweep.withColumn("over", F.sum("step").over(w)).withColumn("open", F.col("over") <= max_crossing)
    sweep = sweep.withColumn("was", F.lag("open").over(w)).where("was is null or was <> open")
    channels = sweep.withColumn("until", F.lead("at").over(w)).where(
        F.col("open") & F.col("was").isNotNull() & F.col("until").isNotNull()
        & (F.col("until") - F.col("at") >= min_width)
    )
    return (
        channels.where("at > lo and until < hi")
        .withColumn("gutter_no", F.row_number().over(w))
        .select(*PAGE, "gutter_no", F.col("at").alias("gutter_left"), F.col("until").alias("gutter_right"))
    )


def doc_layouts(
    gutters: DataFrame, page_width: float = 612, min_pages: int = 2, tolerance: float = 4, min_share: float = 0.15
) -> DataFrame:
    """Column layouts a document keeps per facing parity: modal gutters and median column ends.

    Every statistic is a count per distinct position first, so the windows see
    positions (bounded by the page width), not pages. Gutters are found once: several statistics read them.
    """
    pages = cut_lineage(gutters).withColumn("n_cols", F.count("*").over(W.partitionBy(*PAGE)) + 1)
    pages = pages.withColumn("parity", F.col("page") % 2)
    shape = ["doc_id", "parity", "n_cols"]
    modes = (
        pages.groupBy(*shape, "gutter_no", "gutter_right")
        .agg(F.count("*").alias("n"))
        .groupBy(*shape, "gutter_no")
        .agg(F.min_by("gutter_right", F.struct(-F.col("n"), "gutter_right")).alias("gutter"))
    )
    near = pages.join(modes, [*shape, "gutter_no"]).withColumn(
        "near", F.abs(F.col("gutter_right") - F.col("gutter")) <= tolerance
    )
    follows = near.groupBy(*shape, "page").agg(F.bool_and("near").alias("ok")).where("ok").drop("ok")
    support = follows.groupBy(*shape).agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    ordered = W.partitionBy(*shape).orderBy("gutter_no")
    narrow = (
        modes.withColumn("step", F.col("gutter") - F.lag("gutter").over(ordered))
        .groupBy(*shape)
        .agg(F.min("step").alias("narrowest"))
        .where(F.coalesce(F.col("narrowest"), F.lit(page_width)) >= min_share * page_width)
    )
    ends = (
        near.join(follows, [*shape, "page"], "left_semi")
        .groupBy(*shape, "gutter_no", "gutter_left")
        .agg(F.count("*").alias("n"))
    )
    up = W.partitionBy(*shape, "gutter_no").orderBy("gutter_left")
    all_ends = W.partitionBy(*shape, "gutter_no")
    rights = (
        ends.withColumn("upto", F.sum("n").over(up))
        .withColumn("total", F.sum("n").over(all_ends))
        .where("upto > total div 2")
        .groupBy(*shape, "gutter_no")
        .agg(F.min("gutter_left").alias("column_end"))
    )
    return (
        modes.join(support, shape).join(narrow.select(*shape), shape).join(rights, [*shape, "gutter_no"])
        .select(*shape, "gutter_no", "gutter", "column_end", "n_pages")
    )


def assign_column(runs: DataFrame, gutters: DataFrame, tolerance: float = 2) -> DataFrame:
    """Column of each run: how many gutters end at or left of its start."""
    edges = gutters.groupBy(*PAGE).agg(F.sort_array(F.collect_list("gutter_right")).alias("edges"))
    inside = F.size(F.filter(F.col("edges"), lambda e: F.col("x") >= e - tolerance))
    return (
        runs.join(edges, PAGE, "left")
        .withColumn("column", F.when(F.col("edges").isNull(), 0).otherwise(inside))
        .drop("edges")
    )


def reading_order(runs: DataFrame, page_height: float = 792, band: float = 2.0) -> DataFrame:
    """Place of each run in its document: page, column, band from the top, x, render order."""
    runs = runs.withColumn("band", F.floor((F.lit(page_height) - F.col("y")) / band))
    return running_number(runs, ["doc_id"], "page", ["col", "band", "x", "ord"], "place")


def fingerprint(runs: DataFrame) -> DataFrame:
    """What a document looks like: pages, modal column count, margin box, faces and sizes."""
    runs = runs.withColumn("face", canonical_font(F.col("font")))
    box = runs.groupBy("doc_id", "page").agg(
        F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"),
        F.min("y").alias("y0"), F.max(F.col("y") + F.col("size")).alias("y1"), (F.max("col") + 1).alias("columns"),
    )
    boxes = box.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.min("x0").alias("left"), F.max("x1").alias("right"),
        F.min("y0").alias("bottom"), F.max("y1").alias("top"),
    )
    modal = (
        box.groupBy("doc_id", "columns").agg(F.count("*").alias("n"))
        .groupBy("doc_id").agg(F.min_by("columns", F.struct(-F.col("n"), "columns")).alias("columns"))
    )
    styles = runs.groupBy("doc_id", "face", "size").agg(F.lit(1).alias("_one"))
    sets = styles.groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.collect_set("face")), ",").alias("fonts"),
        F.array_join(F.sort_array(F.collect_set("size")), ",").alias("sizes"),
    )
    return boxes.join(modal, "doc_id").join(sets, "doc_id")


def body_style(runs: DataFrame) -> DataFrame:
    """The upright normal style that carries most characters; on a tie the lowest name. Styles are named once summed up."""
    style = F.concat_ws("|", canonical_font(F.col("font")), "size", "weight")
    return (
        runs.where("weight = 'normal'")
        .groupBy("doc_id", "font", "size", "weight")
        .agg(F.sum(F.length("text")).alias("chars"))
        .groupBy("doc_id", style.alias("style"))
        .agg(F.sum("chars").alias("chars"))
        .groupBy("doc_id")
        .agg(
            F.min_by("style", F.struct(-F.col("chars"), "style")).alias("style"),
            F.max("chars").alias("chars"),
        )
    )


def margin_bands(
    runs: DataFrame, page_height: float = 792, bin_share: float = 0.005, per_page: float = 0.5, gap: float = 0.02
) -> DataFrame:
    """Where the margin bands of a document end, as shares of the page height.

    The histogram has 1 / bin_share bins whatever the document's length.
    """
    pages = runs.groupBy("doc_id", "page").agg(F.lit(1).alias("_one")).groupBy("doc_id").agg(F.count("*").alias("pages"))
    bins = (
        runs.where("trim(text) <> ''")
        .groupBy("doc_id", F.floor(F.col("y") / F.lit(page_height) / F.lit(bin_share)).alias("bin"))
        .agg(F.count("*").alias("n"))
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("hist"))
    )
    reach, last = round(0.06 / bin_share), round(1 / bin_share) - 1

    def edge(start: int, step: int) -> Column:
        zone = f"sequence({start}, {start + step * (reach - 1)}, {step})"
        walk = f"sequence({start}, {start + step * reach}, {step})"
        count = "coalesce(hist[cast({} as bigint)], 0)".format
        peak = f"aggregate({zone}, {start}, (best, b) -> if({count('b')} > {count('best')}, b, best))"
        # the walk starts at the peak and stops at the first near-empty bin
        return F.expr(
            f"""transform(array({peak}), peak ->
                  if({count('peak')} < {per_page} * pages, null,
                     get(filter({walk}, b -> {step} * b >= {step} * peak and {count('b')} < {gap} * {count('peak')}), 0)))[0]"""
        )

    return (
        bins.join(pages, "doc_id")
        .withColumn("low", edge(0, 1))
        .withColumn("high", edge(last, -1))
        .select(
            "doc_id",
            F.round(F.coalesce(F.col("low") * F.lit(bin_share), F.lit(0.0)), 4).alias("bottom"),
            F.round(F.coalesce((F.col("high") + 1) * F.lit(bin_share), F.lit(1.0)), 4).alias("top"),
        )
    )


COLUMN = ["doc_id", "page", "col"]


def group_lines(runs: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Line of each run in its column: a new line opens where the baseline drops by more than the tolerance."""
    w = W.partitionBy(*COLUMN).orderBy(F.col("y").desc(), "x", "ord")
    runs = runs.withColumn("_drop", F.lag("y").over(w) - F.col("y"))
    opens = F.col("_drop").isNull() | (F.col("_drop") > tolerance)
    return runs.withColumn(
        "line", islands(opens, COLUMN, [F.col("y").desc(), "x", "ord"])
    ).drop("_drop")


def line_text(lined: DataFrame, em: float = 0.15, capital: float = 1.2, fonts: bool = False) -> DataFrame:
    """Text of each line: a space where the gap exceeds the word space, after punctuation or at a larger capital.

    ``fonts``: with the font of its first run, blank ones included.
    """
    line = [*COLUMN, "line"]
    w = W.partitionBy(*line).orderBy("x", "ord")
    font = []
    if fonts:
        opening = F.min_by("font", F.struct("x", "ord")).over(W.partitionBy(*line).orderBy("x", "ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        lined, font = lined.withColumn("_font", opening), ["_font"]
    runs = lined.where("text <> ''").select(
        *line, "x", "y", "ord", "text", "size", "weight", "width", *font,
        (F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)).alias("gap"),
        F.lag("size").over(w).alias("psize"), F.lag("text").over(w).alias("ptext"),
    )
    breaks = (
        (F.col("gap") > em * F.greatest("size", "psize"))
        | (F.col("ptext").rlike(r"[,.:;!?]$") & F.col("text").rlike(r"^\p{L}"))
        | ((F.col("size") > capital * F.col("psize")) & F.col("text").rlike(r"^\p{Lu}") & F.col("ptext").rlike(r"\p{Ll}$"))
    )
    piece = F.when(F.coalesce(breaks, F.lit(False)), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    return (
        runs.withColumn("piece", F.struct("x", "ord", piece.alias("t")))
        .groupBy(*line)
        .agg(
            F.max("y").alias("y"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"),
            F.max("size").alias("size"), F.min_by("weight", F.struct("x", "ord")).alias("weight"),
            F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["t"]), "").alias("text"),
            F.min("ord").alias("ord"), *[F.first(c).alias("font") for c in font],
        )
        .withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    )


def line_cells(lined: DataFrame, gap_em: float = 1.2, weight_em: float = 0.6) -> DataFrame:
    """Cells of each line: cut at wide gaps, at half of them where the weight changes."""
    line = [*COLUMN, "line"]
    w = W.partitionBy(*line).orderBy("x", "ord")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    cut = gap > F.when(F.lag("weight").over(w) != F.col("weight"), weight_em).otherwise(gap_em) * F.col("size")
    runs = lined.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    runs = runs.withColumn("cell", islands(F.col("_cut"), line, ["x", "ord"]))
    return runs.groupBy(*line, "cell").agg(
        F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("x", "ord", "text"))), lambda p: p["text"]), " "
        ).alias("text"),
    )


def paragraphs(lines: DataFrame, factor: float = 1.5) -> DataFrame:
    """Paragraph of each line in its column: a gap above ``factor`` times the type size opens one."""
    w = W.partitionBy(*COLUMN).orderBy(F.col("y").desc())
    gap = F.lag("y").over(w) - F.col("y")
    lines = lines.withColumn("_gap", gap)
    opens = F.col("_gap").isNull() | (F.col("_gap") > factor * F.col("size"))
    return lines.withColumn("para", islands(opens, COLUMN, [F.col("y").desc()])).drop("_gap")
