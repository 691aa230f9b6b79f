"""Numeric grids and statistics rows (inventory H)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.scans import as_of, islands, prefix_sum

PAGE = ["doc_id", "page"]
NUMERIC = r"^\d{1,3}$"


def font_roles(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Body face by runs, grid size by its commonest bold number."""
    face = runs.groupBy(*keys, "font", "size").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").rlike(NUMERIC) & (F.col("weight") == "bold")).alias("numbers")
    )
    return face.groupBy(*keys).agg(
        F.min_by(F.concat_ws("|", "font", "size"), F.struct(-F.col("n"), "font", "size")).alias("body"),
        F.min_by("size", F.when(F.col("numbers") > 0, F.struct(-F.col("numbers"), "size"))).alias("grid_size"),
    )


def number_lattice(runs: DataFrame, row_gap: float = 60, col_gap: float = 85) -> DataFrame:
    """Bold numbers of a page in blocks, rows and columns: numbers nearer than the gaps share a block."""
    nums = runs.where(F.col("text").rlike(NUMERIC) & (F.col("weight") == "bold"))
    w = W.partitionBy(*PAGE).orderBy(F.desc("y"))
    nums = nums.withColumn("_d", F.lag("y").over(w) - F.col("y"))
    nums = nums.withColumn("block", islands(F.col("_d").isNull() | (F.col("_d") > row_gap), PAGE, [F.desc("y")])).drop("_d")
    block = [*PAGE, "block"]
    x = W.partitionBy(*block).orderBy("x")
    nums = nums.withColumn("_d", F.col("x") - F.lag("x").over(x))
    nums = nums.withColumn("side", islands(F.col("_d").isNull() | (F.col("_d") > col_gap), block, ["x"])).drop("_d")
    group = [*block, "side"]
    return nums.withColumn("row", F.dense_rank().over(W.partitionBy(*group).orderBy(F.desc("y")))).withColumn(
        "column", F.dense_rank().over(W.partitionBy(*group).orderBy("x"))
    )


def grids(runs: DataFrame) -> DataFrame:
    """Full three by three grids with their values, the label above each value and the banner above the grid."""
    group = [*PAGE, "block", "side"]
    cells = number_lattice(runs)
    full = cells.groupBy(*group).agg(
        F.count("*").alias("n"), F.max("row").alias("r"), F.max("column").alias("c"), F.max("y").alias("top"), F.min("x").alias("left"), F.max("x").alias("right")
    ).where("n = 9 and r = 3 and c = 3")
    cells = cells.join(full.select(*group), group, "left_semi")
    labels = runs.where("size < 8").select(*PAGE, F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("text").alias("label"), F.floor(F.col("y") / 32).alias("band"))
    near = cells.select("*", F.explode(F.array(F.floor(F.col("y") / 32), F.floor(F.col("y") / 32) + 1)).alias("band")).join(labels, [*PAGE, "band"])
    near = near.where("ly > y and ly - y <= 20 and abs(lx - x) <= 20")
    found = near.groupBy(*group, "row", "column").agg(F.min_by("label", F.struct(F.col("ly") - F.col("y"), F.abs(F.col("lx") - F.col("x")), "label")).alias("label"))
    # a value without a label keeps its place
    named = cells.join(found, [*group, "row", "column"], "left").withColumn("label", F.coalesce("label", F.lit("")))
    values = named.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("row", "column", "label", F.col("text").cast("int").alias("value")))).alias("cells")
    )
    banner = runs.where("size >= 14").select(*PAGE, F.col("y").alias("by"), F.col("text").alias("banner"))
    top = full.join(banner, PAGE, "left").where("by is null or by > top").groupBy(*group).agg(F.min_by("banner", "by").alias("name"))
    return values.join(top, group, "left").select(
        *group, "name", F.array_join(F.transform("cells", lambda c: c["label"]), ",").alias("labels"),
        F.array_join(F.transform("cells", lambda c: c["value"].cast("string")), ",").alias("values"),
    )


def stat_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A line of labels over a line of values: each label with the value nearest below it.

    ``lines`` has y, xs, texts. Letters read for digits are put right when most values are numbers.
    """
    w = W.partitionBy(*keys).orderBy(F.desc("y"))
    rows = lines.withColumns({"_vx": F.lead("xs").over(w), "_vt": F.lead("texts").over(w)})
    labels = F.forall("texts", lambda v: v.rlike(r"^\p{L}{1,12}$"))
    fixed = F.transform("_vt", lambda v: F.translate(v, "IlOo", "1100"))
    n_num = F.size(F.filter("_vt", lambda v: v.rlike(r"^\d+$")))
    rows = rows.where(labels & (F.size("_vt") >= 1)).withColumn("_fixed", F.when(n_num * 2 > F.size("_vt"), fixed).otherwise(F.col("_vt")))
    rows = rows.where(F.forall("_fixed", lambda v: v.rlike(r"^\d+$")))
    out = rows.select(*keys, "y", "_vx", "_fixed", F.posexplode(F.arrays_zip(F.col("xs").alias("x"), F.col("texts").alias("t"))).alias("i", "l"))
    nearest = F.expr("array_min(transform(_vx, (v, j) -> named_struct('d', abs(v - l.x), 'j', j))).j")
    return out.select(*keys, "y", "i", F.col("l.t").alias("label"), F.get(F.col("_fixed"), nearest).cast("int").alias("value"))


def lattice_rows(lines: DataFrame, keys: list[str], order: list[str], agree: float = 0.25, reach: float = 0.4) -> DataFrame:
    """Values under a row of labels of which some were lost: (keys, y, i, label, value, inferred).

    ``lines`` has y, xs (centres) and texts; ``order`` is the order in which labels are printed. A row of labels in that order
    stands on a lattice: each two of them propose a pitch and an offset, and the lattice on which most labels stand wins, the
    closest of equal ones. Each value of the line below belongs to its nearest place, whether its label was read or not.
    ``keys`` bound the lines that can follow each other (a page's column). Letters read for digits are put right where half
    of the values are numbers; a dash is 0; values set in pieces are joined. A row with another value is left out.
    """
    names = ", ".join(f"'{v.lower()}'" for v in order)
    w = W.partitionBy(*keys).orderBy(F.desc("y"))
    rows = lines.withColumns({"_vx": F.lead("xs").over(w), "_vt": F.lead("texts").over(w)})
    # an array of one entry names a value that is used twice; as one generator, nothing of it is worked out again
    named = "transform(array({1}), {0} -> {2})[0]".format
    kept = "if({0}, {1}, array())".format
    known = f"size(texts) >= 2 and _vt is not null and forall(texts, t -> array_contains(array({names}), lower(trim(t))))"
    places = f"transform(texts, t -> cast(array_position(array({names}), lower(trim(t))) - 1 as int))"
    in_order = "forall(sequence(1, size(os) - 1), i -> os[i] > os[i - 1])"
    fixed = r"if(size(filter(_vt, v -> v rlike '^\\d+$')) * 2 >= size(_vt), transform(_vt, v -> translate(v, 'IlOo', '1100')), _vt)"
    fits = kept(r"forall(vt, v -> v rlike '^(\\d+|[-–—]+)$')", "array(named_struct('os', os, 'cs', cast(xs as array<double>), 'vx', cast(_vx as array<double>), 'vt', vt))")
    rows = rows.select(*keys, "y", F.explode(F.expr(kept(known, named("os", places, kept(in_order, named("vt", fixed, fits)))))).alias("r"))
    rows = rows.select(*keys, "y", "r.*").withColumn("at", _fitted(len(order), agree, reach)("os", "cs", "vx"))
    one = "filter(transform(vt, (t, j) -> named_struct('i', get(at, j), 't', t, 'inferred', not array_contains(os, get(at, j)))), v -> v.i >= 0)"
    pieces = "sort_array(transform(filter(sequence(0, size(vt) - 1), j -> get(at, j) = i), j -> named_struct('x', get(vx, j), 't', vt[j])))"
    more = f"transform(filter(array_distinct(at), i -> i >= 0), i -> named_struct('i', i, 't', array_join(transform({pieces}, v -> v.t), ''), 'inferred', not array_contains(os, i)))"
    out = F.expr(kept("size(vt) > 0", f"if(size(array_distinct(at)) = size(at), {one}, {more})"))
    out = rows.select(*keys, "y", F.explode(out).alias("v")).select(*keys, "y", "v.*")
    label = F.element_at(F.array(*map(F.lit, order)), F.col("i") + 1)
    value = F.when(F.col("t").rlike(r"^\d+$"), F.col("t").cast("int")).otherwise(0)
    return out.select(*keys, "y", "i", label.alias("label"), value.alias("value"), "inferred")


def _fitted(places: int, agree: float, reach: float):
    """The place of each value (-1: none) on the lattice of a row of labels, from the labels' places and centres and the values' centres."""

    def whole(x: np.ndarray, digits: int) -> np.ndarray:
        return np.sign(x) * np.floor(np.abs(x) * 10**digits + 0.5)

    def lattice(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pitch and offset of each row, NaN where no two labels agree."""
        i, j = np.triu_indices(places, 1)
        p = (c[:, j] - c[:, i]) / (j - i)
        b = c[:, i] - p * i
        n, err = np.zeros(p.shape), np.zeros(p.shape)
        for k in range(places):
            off = np.abs(c[:, k : k + 1] - b - p * k)
            near = off <= agree * p
            n += near
            err += np.where(near, off, 0)
        best = (p > 0) & (n >= 2)
        none = ~best.any(axis=1)
        # of equal ones the closest, then the narrowest, then the leftmost
        for key in (-n, whole(err, 3), whole(p, 6), whole(b, 6)):
            key = np.where(best, key, np.inf)
            best &= key == key.min(axis=1, keepdims=True)
        row, at = np.arange(len(c)), best.argmax(axis=1)
        return tuple(np.where(none, np.nan, whole(v[row, at], 6) / 1e6) for v in (p, b))

    @F.arrow_udf("array<int>")
    def fit(os: pa.Array, cs: pa.Array, vx: pa.Array) -> pa.Array:
        c = np.full((len(os), places), np.nan)
        c[np.repeat(np.arange(len(os)), np.diff(os.offsets)), os.flatten()] = cs.flatten().to_numpy(zero_copy_only=False)
        ends = vx.offsets.to_numpy() - vx.offsets[0].as_py()
        x = vx.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            p, b = (np.repeat(v, np.diff(ends)) for v in lattice(c))
            i = np.floor((x - b) / p + 0.5)
            good = (np.abs(x - b - p * i) <= reach * p) & (i >= 0) & (i < places)
        return pa.ListArray.from_arrays(pa.array(ends, "int32"), pa.array(np.where(good, i, -1).astype("int32")))

    return fit


def panel_blocks(lines: DataFrame, keys: list[str], segment: str, order: str) -> DataFrame:
    """A line "Label: text" opens a block, other lines continue it."""
    pattern = r"^(\p{Lu}[\p{L} ]*):\s*(.*)$"
    lines = lines.withColumn("_label", F.regexp_extract("text", pattern, 1))
    lines = prefix_sum(lines, keys, segment, [order], (F.col("_label") != "").cast("int"), "block_no").where("block_no > 0")
    text = F.when(F.col("_label") != "", F.regexp_extract("text", pattern, 2)).otherwise(F.col("text"))
    return lines.groupBy(*keys, "block_no").agg(
        F.max("_label").alias("label"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("t")))), lambda l: l["t"]), " ").alias("text"),
    )


def overlay_variants(variants: DataFrame, bases: DataFrame, keys: list[str], at: str, id_: str, reach: int, segment: int = 256) -> DataFrame:
    """A variant's own values written over those of the nearest base before it, within reach. Both have ``values`` maps."""
    found = as_of(variants, bases, keys, at, id_, "values", "_base", F.floor(F.col(at) / segment))
    base = F.when(F.col(at) - F.col("_base.at") <= reach, F.col("_base.value"))
    own = F.col("values")
    left = F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k))
    return found.withColumn("values", F.when(base.isNull(), own).otherwise(F.map_concat(left, own))).drop("_base")


def diagram(figures: DataFrame, labels: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """Figures and labels of a page that are each other's nearest within reach.

    Both have x, y, id. They meet on squares of ``reach`` points.
    """
    square = lambda c: F.floor(F.col(c) / reach)
    around = F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> named_struct('sx', sx + a, 'sy', sy + b))))")
    f = figures.select(*keys, F.col("id").alias("figure"), F.col("x").alias("fx"), F.col("y").alias("fy"), square("x").alias("sx"), square("y").alias("sy"))
    g = labels.select(*keys, F.col("id").alias("label"), F.col("x").alias("gx"), F.col("y").alias("gy"), square("x").alias("sx"), square("y").alias("sy"))
    g = g.withColumn("s", F.explode(around)).select(*keys, "label", "gx", "gy", "s.sx", "s.sy")
    d = F.hypot(F.col("fx") - F.col("gx"), F.col("fy") - F.col("gy"))
    near = f.join(g, [*keys, "sx", "sy"]).withColumn("d", d).where(F.col("d") <= reach)
    by_figure = near.groupBy(*keys, "figure").agg(F.min_by("label", F.struct("d", "label")).alias("label"))
    by_label = near.groupBy(*keys, "label").agg(F.min_by("figure", F.struct("d", "figure")).alias("figure"))
    return by_figure.join(by_label, [*keys, "figure", "label"])
