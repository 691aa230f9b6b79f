"""Running values over a long ordered key, split by segment.

A window ordered over a whole document puts that document in one task. These
helpers run the window inside (key, segment) - a page, or a block of lines -
and carry one summary row per segment across the key, so a document that holds
a third of all rows is still spread over as many tasks as it has pages. The
summaries are themselves carried in blocks of ``WIDTH`` segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WIDTH = 1024


def _before(w: W) -> W:
    return w.rowsBetween(W.unboundedPreceding, -1)


def _upto(w: W) -> W:
    return w.rowsBetween(W.unboundedPreceding, W.currentRow)


def _carry_segments(seg: DataFrame, keys: list[str], segment: str, value: str, out: str) -> DataFrame:
    """Last non-null ``value`` of an earlier segment, per segment row."""
    seg = seg.withColumn("_blk", F.floor(F.col(segment) / F.lit(WIDTH)).cast("long"))
    inside = W.partitionBy(*keys, "_blk").orderBy(segment)
    seg = seg.withColumn("_near", F.last(value, ignorenulls=True).over(_before(inside)))
    blocks = seg.groupBy(*keys, "_blk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(segment))).alias("_bv")
    )
    over = W.partitionBy(*keys).orderBy("_blk")
    blocks = blocks.withColumn("_far", F.last("_bv", ignorenulls=True).over(_before(over))).drop("_bv")
    return (
        seg.join(blocks, [*keys, "_blk"])
        .withColumn(out, F.coalesce("_near", "_far"))
        .select(*keys, segment, out)
    )


def carry_last(
    df: DataFrame, keys: list[str], segment: str, order: list[str], value: Column, out: str
) -> DataFrame:
    """``last_value(value) ignore nulls`` up to the current row of ``keys`` ordered by (segment, order)."""
    df = df.withColumn("_v", value)
    w = W.partitionBy(*keys, segment).orderBy(*order)
    df = df.withColumn("_here", F.last("_v", ignorenulls=True).over(_upto(w)))
    seg = df.groupBy(*keys, segment).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_v")
    )
    carried = _carry_segments(seg, keys, segment, "_v", "_past")
    return (
        df.join(carried, [*keys, segment])
        .withColumn(out, F.coalesce("_here", "_past"))
        .drop("_v", "_here", "_past")
    )


def prefix_sum(
    df: DataFrame, keys: list[str], segment: str, order: list[str], value: Column, out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of ``value`` over ``keys`` ordered by (segment, order)."""
    df = df.withColumn("_v", value)
    w = W.partitionBy(*keys, segment).orderBy(*order)
    frame = _upto(w) if inclusive else _before(w)
    df = df.withColumn("_here", F.coalesce(F.sum("_v").over(frame), F.lit(0)))
    seg = df.groupBy(*keys, segment).agg(F.sum("_v").alias("_s"))
    seg = seg.withColumn("_blk", F.floor(F.col(segment) / F.lit(WIDTH)).cast("long"))
    near = W.partitionBy(*keys, "_blk").orderBy(segment)
    blocks = seg.groupBy(*keys, "_blk").agg(F.sum("_s").alias("_bs"))
    far = W.partitionBy(*keys).orderBy("_blk")
    blocks = blocks.withColumn("_far", F.coalesce(F.sum("_bs").over(_before(far)), F.lit(0))).drop("_bs")
    seg = (
        seg.withColumn("_near", F.coalesce(F.sum("_s").over(_before(near)), F.lit(0)))
        .join(blocks, [*keys, "_blk"])
        .withColumn("_past", F.col("_near") + F.col("_far"))
        .select(*keys, segment, "_past")
    )
    return (
        df.join(seg, [*keys, segment])
        .withColumn(out, F.col("_here") + F.col("_past"))
        .drop("_v", "_here", "_past")
    )


def running_number(df: DataFrame, keys: list[str], segment: str, order: list[str], out: str) -> DataFrame:
    """``row_number()`` over ``keys`` ordered by (segment, order)."""
    return prefix_sum(df, keys, segment, order, F.lit(1).cast("long"), out)


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by a map-side combined aggregate instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")


def islands(flag: Column, keys: list[str], order: list[str | Column]) -> Column:
    """Island number inside a bounded window: the running count of ``flag``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return F.sum(F.when(flag, 1).otherwise(0)).over(_upto(w))


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, id_: str, value: str, out: str, segment: Column,
    inclusive: bool = False,
) -> DataFrame:
    """For each left row the struct of ``value`` and time of the latest right row of its key before it.

    Both sides are one sorted stream, carried forward segment by segment: no
    pairs are formed, so a hot key costs its own rows only. ``segment`` maps
    the time column to a growing whole number.
    """
    side = 0 if inclusive else 2  # at one time, rights come before lefts only where equal times count
    lhs = left.withColumn("_side", F.lit(1)).withColumn("_val", F.lit(None).cast(right.schema[value].dataType))
    rhs = right.select(*keys, at, id_, F.lit(side).alias("_side"), F.col(value).alias("_val"))
    both = lhs.unionByName(rhs, allowMissingColumns=True).withColumn("_seg", segment)
    seen = F.when(F.col("_side") != 1, F.struct(F.col(at).alias("at"), F.col(id_).alias("id"), F.col("_val").alias("value")))
    carried = carry_last(both, keys, "_seg", [at, "_side", id_], seen, out)
    return carried.where("_side = 1").drop("_side", "_val", "_seg")


def carry_many(df: DataFrame, keys: list[str], segment: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Several ``carry_last`` columns over one sort."""
    df = df.withColumns({f"_v_{out}": v for out, v in values.items()})
    w = _upto(W.partitionBy(*keys, segment).orderBy(*order))
    df = df.withColumns({f"_h_{out}": F.last(f"_v_{out}", ignorenulls=True).over(w) for out in values})
    at = F.struct(*order)
    seg = df.groupBy(*keys, segment).agg(
        *[F.max_by(f"_v_{out}", F.when(F.col(f"_v_{out}").isNotNull(), at)).alias(f"_s_{out}") for out in values]
    )
    seg = seg.withColumn("_blk", F.floor(F.col(segment) / F.lit(WIDTH)).cast("long"))
    near = _before(W.partitionBy(*keys, "_blk").orderBy(segment))
    blocks = seg.groupBy(*keys, "_blk").agg(
        *[F.max_by(f"_s_{out}", F.when(F.col(f"_s_{out}").isNotNull(), F.col(segment))).alias(f"_b_{out}") for out in values]
    )
    far = _before(W.partitionBy(*keys).orderBy("_blk"))
    blocks = blocks.select(*keys, "_blk", *[F.last(f"_b_{out}", ignorenulls=True).over(far).alias(f"_f_{out}") for out in values])
    seg = seg.withColumns({f"_n_{out}": F.last(f"_s_{out}", ignorenulls=True).over(near) for out in values})
    seg = seg.join(blocks, [*keys, "_blk"]).select(
        *keys, segment, *[F.coalesce(f"_n_{out}", f"_f_{out}").alias(f"_p_{out}") for out in values]
    )
    df = df.join(seg, [*keys, segment]).withColumns({out: F.coalesce(f"_h_{out}", f"_p_{out}") for out in values})
    return df.drop(*[f"_{k}_{out}" for out in values for k in "vhp"])


def previous(df: DataFrame, keys: list[str], segment: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``lag(value)`` over ``keys`` ordered by (segment, order), for values that are never null."""
    df = df.withColumn("_v", value)
    w = W.partitionBy(*keys, segment).orderBy(*order)
    df = df.withColumn("_here", F.lag("_v").over(w))
    seg = df.groupBy(*keys, segment).agg(F.max_by("_v", F.struct(*order)).alias("_v"))
    past = _carry_segments(seg, keys, segment, "_v", "_past")
    return df.join(past, [*keys, segment]).withColumn(out, F.coalesce("_here", "_past")).drop("_v", "_here", "_past")


def _over(state: Column, more: Column, step: float) -> Column:
    """What stands after ``more`` is put on ``state``: entries that its greatest size covers go, its own come on top."""
    left = F.filter(state["stack"], lambda e: e["size"] > more["most"] + F.lit(step))
    return F.struct(F.greatest(state["most"], more["most"]).alias("most"), F.concat(left, more["stack"]).alias("stack"))


def _states(parts: Column, kind: str, step: float) -> Column:
    """The state before each of the ordered parts, and the one after them all."""
    none = F.array(F.struct(F.lit(float("-inf")).alias("most"), F.array().cast(kind).alias("stack")))
    return F.aggregate(parts, none, lambda seen, e: F.concat(seen, F.array(_over(F.element_at(seen, -1), e, step))))


def carry_stack(
    df: DataFrame, keys: list[str], segment: str, order: str, size: Column, stays: Column, item: Column, step: float, out: str, block: int = 64
) -> DataFrame:
    """``out``: the items of a monotone stack below each row, outermost first.

    A row with a ``size`` takes off what is not larger than it by more than ``step`` and is put on top, where it counts with
    the size ``stays``; rows without one only look. A stack made over a part of the rows acts on an earlier one by its
    greatest size alone, so parts are folded inside (key, segment) and their results across segments, in blocks.
    """
    df = df.withColumns({"_size": size.cast("double"), "_stays": stays.cast("double"), "_item": item})
    kind = f"array<struct<size: double, item: {df.schema['_item'].dataType.simpleString()}>>"
    entry = F.struct(
        F.col(order).alias("at"), F.col("_size").alias("most"), F.array(F.struct(F.col("_stays").alias("size"), F.col("_item").alias("item"))).cast(kind).alias("stack")
    )
    before = _before(W.partitionBy(*keys, segment).orderBy(order))
    df = df.withColumn("_nth", F.count("_size").over(before))
    own = df.groupBy(*keys, segment).agg(_states(F.sort_array(F.collect_list(F.when(F.col("_size").isNotNull(), entry))), kind, step).alias("_own"))
    end = F.element_at("_own", -1)
    seg = own.select(*keys, segment, F.floor(F.col(segment) / block).cast("long").alias("_blk"), end["most"].alias("most"), end["stack"].alias("stack"))
    parts = F.sort_array(F.collect_list(F.struct(F.col(segment).alias("at"), "most", "stack")))
    blocks = seg.groupBy(*keys, "_blk").agg(parts.alias("_parts")).withColumn("_near", _states(F.col("_parts"), kind, step))
    last = F.element_at("_near", -1)
    whole = blocks.select(*keys, F.struct(F.col("_blk").alias("at"), last["most"].alias("most"), last["stack"].alias("stack")).alias("p"))
    whole = whole.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("_parts")).withColumn("_far", _states(F.col("_parts"), kind, step))
    far = whole.select(*keys, F.explode(F.arrays_zip(F.col("_parts.at").alias("at"), F.slice("_far", 1, F.size("_parts")).alias("far"))).alias("p"))
    far = far.select(*keys, F.col("p.at").alias("_blk"), F.col("p.far").alias("_far"))
    near = blocks.select(*keys, "_blk", F.explode(F.arrays_zip(F.col("_parts.at").alias("at"), F.slice("_near", 1, F.size("_parts")).alias("near"))).alias("p"))
    past = near.join(far, [*keys, "_blk"]).select(*keys, F.col("p.at").alias(segment), _over(F.col("_far"), F.col("p.near"), step).alias("_past"))
    local = own.select(*keys, segment, F.posexplode("_own").alias("_nth", "_here")).withColumn("_nth", F.col("_nth").cast("long"))
    rows = df.join(local, [*keys, segment, "_nth"]).join(past, [*keys, segment])
    full = _over(F.col("_past"), F.col("_here"), step)["stack"]
    standing = F.when(F.col("_size").isNull(), full).otherwise(F.filter(full, lambda e: e["size"] > F.col("_size") + F.lit(step)))
    return rows.withColumn(out, F.transform(standing, lambda e: e["item"])).drop("_size", "_stays", "_item", "_nth", "_here", "_past")
