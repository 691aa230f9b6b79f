"""Approximate nearest neighbours by a hash-prefix forest (operator 10).

Each of ``TREES`` trees is an array of hash strings in order; a string's symbols are signed axes, those nearest to the
vector after random rotations (2d symbols for d dimensions). A query descends to the longest prefixes that items share
with it and ascends in all trees at once, one symbol at a time, until the trees together count ``LEAST`` items and ``SHARE``
of all items with its prefix (one found by several trees counts for each); at the root that is every item. All of these
are compared exactly, by cosine in double precision. The share keeps recall where the table grows: unstructured vectors
need about a fifth of all as candidates, however many there are.

The strings are built from every row, nothing is fitted or sampled. Equal vectors are one item with its smallest ids, so a
vector that fills a third of the table is one row of the forest. A tree's items lie in parts by first symbol, larger ones
in several of at most about ``PART`` items, which a query visits all. Vectors that are null, zero or hold null or
non-finite components take no part, nor do those of another length than most have. Of repeated ids the first stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import cut

TREES, DEPTH = 36, 3
LEAST = 8192
SHARE = 0.25
PART = 20_000
NEIGHBOURS = 5


def rotations(dim: int, trees: int, depth: int, seed: int = 7) -> np.ndarray:
    """``trees * depth`` random orthogonal matrices side by side."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(trees * depth)], axis=1)


def hash_strings(x: np.ndarray, turned: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each row and tree its string as one number, first symbol first."""
    n, dim = x.shape
    out = np.zeros((n, trees), np.int64)
    for t in range(trees):
        for k in range(depth):
            y = x @ turned[:, (t * depth + k) * dim : (t * depth + k + 1) * dim]
            axis = np.abs(y).argmax(axis=1)
            out[:, t] = out[:, t] * (2 * dim) + 2 * axis + (y[np.arange(n), axis] > 0)
    return out


def sound(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``id, v``: rows that take part, one for each id, and their length."""
    real = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(real)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    dim = sizes[0]["size"] if sizes else 0
    return rows.where(F.size("v") == dim).dropDuplicates(["id"]), dim


def best(query: np.ndarray, items: np.ndarray, ids: np.ndarray, spans: list[tuple[int, int]], k: int, rows: int = 128):
    """(query, item, score) of the ``k`` nearest of each query among its span of items, ties to the smaller id."""
    qn, xn = np.linalg.norm(query, axis=1), np.linalg.norm(items, axis=1)
    for begin in range(0, len(query), rows):
        scores = (query[begin : begin + rows] @ items.T) / xn / qn[begin : begin + rows, None]
        for j in range(len(scores)):
            lo, hi = spans[begin + j]
            own = scores[j, lo:hi]
            if not len(own):
                continue
            cut_at = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -2.0
            hit = np.flatnonzero(own >= cut_at - 1e-12)
            order = np.lexsort((ids[lo + hit], -np.round(own[hit], 12)))[:k]
            yield from ((begin + j, lo + int(i), float(own[i])) for i in hit[order])


def nearest(df: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, depth: int = DEPTH, least: int = LEAST, share: float = SHARE, part: int = PART) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``df`` for each id in ``queries`` (one column), but itself."""
    spark = df.sparkSession
    rows, dim = sound(df, key, vector)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    asked = queries.select(F.col(queries.columns[0]).alias("id")).distinct()
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)  # limited before the shuffle
    items = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("item", F.col("ids")[0])
    turned = spark.sparkContext.broadcast(rotations(dim, trees, depth))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part_of = batch.slice(begin, 2048)
                x = np.array(part_of.column("v").to_pylist(), float)
                code = hash_strings(x, turned.value, trees, depth)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * trees, code.ravel())
                yield pa.RecordBatch.from_arrays([*(part_of.column(c) for c in ("item", "v", "ids")), lists], names=["item", "v", "ids", "codes"])

    items = cut(items.select("item", "v", "ids").mapInArrow(hashed, "item long, v array<double>, ids array<long>, codes array<long>"))
    n = items.count()
    asking = cut(rows.join(asked, "id").join(items.select("item", "v"), "v").select("id", "item"))
    vectors = items.join(asking.select("item").distinct(), "item", "left_semi")

    # how many items share each query's prefixes of each length, over all trees
    symbols = 2 * dim
    strings = lambda d: d.select("item", F.posexplode("codes").alias("tree", "code"))
    prefix = lambda x: F.floor(F.col("code") / F.lit(symbols ** (depth - x))).cast("long")
    levels = lambda d: strings(d).select("item", "tree", F.explode(F.array(*[F.struct(F.lit(x).alias("depth"), prefix(x).alias("prefix")) for x in range(1, depth + 1)])).alias("p")).select("item", "tree", "p.*")
    counts = levels(items).groupBy("tree", "depth", "prefix").agg(F.count("*").alias("many"))
    held = levels(vectors).join(counts, ["tree", "depth", "prefix"]).groupBy("item", "depth").agg(F.sum("many").alias("many"))
    chosen = held.where(F.col("many") >= max(least, share * n)).groupBy("item").agg(F.max("depth").alias("depth"))
    chosen = vectors.join(chosen, "item", "left").select("item", "v", "codes", F.coalesce("depth", F.lit(0)).alias("depth"))
    chosen = cut(chosen)

    # parts: (tree, first symbol, share) of the trees, or a block of all items for queries at the root
    sizes = counts.where("depth = 1").select("tree", F.col("prefix").alias("symbol"), F.ceil(F.col("many") / part).cast("int").alias("shares"))
    blocks = max(1, -(-n // part))
    tree_of = lambda d: d.select("*", F.posexplode("codes").alias("tree", "code")).drop("codes").withColumn("symbol", prefix(1))
    dealt = lambda shares: F.pmod(F.xxhash64("item"), shares).cast("int")
    columns = ("tree", "symbol", "share", "item", "v", "code")
    deep = chosen.where("depth > 0")
    some_root, some_deep = chosen.where("depth = 0").limit(1).count() > 0, deep.limit(1).count() > 0
    pairs = []
    if some_deep:
        sized = F.broadcast(sizes)  # at most trees * 2 * dimensions rows
        pairs.append((tree_of(items).join(sized, ["tree", "symbol"]).withColumn("share", dealt(F.col("shares"))).select(*columns), tree_of(deep).join(sized, ["tree", "symbol"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(*columns, "depth")))
    if some_root:
        at_root = {"tree": F.lit(-1), "symbol": F.lit(0).cast("long"), "code": F.lit(0).cast("long")}
        own = items.withColumns(at_root | {"share": dealt(F.lit(blocks))}).select(*columns)
        asks = chosen.where("depth = 0").withColumns(at_root | {"share": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).select(*columns, "depth")
        pairs.append((own, asks))

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "item": [], "score": []})
        left = left.sort_values(["code", "item"], kind="stable")
        code, ids = left["code"].to_numpy(), left["item"].to_numpy()
        spans = []
        for c, d in zip(right["code"].tolist(), right["depth"].tolist(), strict=True):
            width = symbols ** (depth - d) if d else 1
            low = c // width * width
            spans.append((int(np.searchsorted(code, low)), int(np.searchsorted(code, low + width))))
        asked_ids = right["item"].tolist()
        found = [(asked_ids[q], int(ids[i]), s) for q, i, s in best(np.stack(right["v"]), np.stack(left["v"]), ids, spans, k + 1)]
        return pd.DataFrame(found, columns=["query", "item", "score"])

    out = None
    for own, asks in pairs:
        own, asks = own.toDF(*own.columns), asks.toDF(*asks.columns)
        group = ["tree", "symbol", "share"]
        got = own.groupBy(*group).cogroup(asks.groupBy(*group)).applyInPandas(searched, "query long, item long, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return empty
    merged = out.groupBy("query", "item").agg(F.max("score").alias("score")).withColumn("near", F.round("score", 12))
    top = Window.partitionBy("query").orderBy(F.desc("near"), "item")  # some rows from each tree and part
    merged = merged.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1)
    listed = merged.join(items.select("item", "ids"), "item").select("query", "score", "near", F.explode("ids").alias("vec_id"))
    answers = asking.join(listed, asking["item"] == listed["query"]).where(F.col("id") != F.col("vec_id"))
    order = Window.partitionBy("id").orderBy(F.desc("near"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
