"""Best-fit packing planned over a length histogram (operator 7).

1. Tokens: each document's ids and an end id; what is longer than a sequence is cut into full pieces and a rest.
2. The plan: best-fit decreasing over (length, count) rows, never over documents. Sequences that are filled alike are one
   class with a count, so the plan's size depends on the sequence length alone (at most a few classes a length).
3. Slots: the plan says for each length which ranks go where; a piece takes its slot by its rank within its length.
   Ranks are counted per (length, hash bucket) and shifted by the buckets before, so no length is one task.

Null texts count as empty (one end id). Repeated rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.blocks import strings, text_blocks
from quire.llm.bpe import Codec, shared_spec
from quire.llm.shared import cut

CAPACITY = 2048
#: Pieces that one rank bucket holds on average.
BUCKET_ROWS = 20_000


def pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of every document's tokens with ``end_id`` behind them."""
    spec = shared_spec(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value)
        for block in text_blocks(batches, text):
            rows: list[tuple[int, int, int, int, int]] = []
            for at, found in enumerate(codec.encode(strings(block.column(text)))):
                ids = np.append(found, np.array([end_id], "<u4")).astype("<u4")
                for k, begin in enumerate(range(0, len(ids), capacity)):
                    part = ids[begin : begin + capacity]
                    rows.append((at, k, begin, len(part), zlib.crc32(part)))
            at, *rest = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [block.column(key).take(pa.array(at)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])],
                names=["key", "piece", "start", "length", "crc"],
            )

    out = df.select(key, text).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, piece int, start long, length long, crc long")
    return out.toDF(key, "piece", "start", "length", "ids_crc32")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: count}``.

    Returns ``(length, first rank, ranks, first sequence, offset)``: that many pieces of this length, in rank order, go to
    consecutive sequences from the first one, each at the offset.
    """
    open_at: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many) that are filled alike
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in open_at if r >= length), default=0)
            if room:
                first, many = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
            else:  # as many new sequences as the rest of this length fills
                room, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            taken = min(many, left)
            plan.append((length, rank, taken, first, capacity - room))
            if taken < many:
                open_at.setdefault(room, []).append((first + taken, many - taken))
            if room > length:
                open_at.setdefault(room - length, []).append((first, taken))
            left -= taken
            rank += taken
    return plan


def pack(parts: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``parts`` (with ``length``) with ``sequence_id`` and ``offset``. Plans on the histogram of lengths, which has at
    most ``capacity`` rows; ``parts`` should be cheap to read twice (a checkpoint)."""
    spark = parts.sparkSession
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return parts.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    buckets = max(1, sum(counts.values()) // bucket_rows)
    plan = spark.createDataFrame(
        best_fit(counts, capacity), "length long, lo long, ranks long, first long, offset long"
    )
    spread = parts.withColumn("bucket", F.pmod(F.xxhash64(*[c for c in parts.columns if c != "length"]), F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "bucket").orderBy(*[c for c in parts.columns if c != "length"])
    ranked = spread.withColumn("rank", F.row_number().over(own) - 1).join(shift, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("shift"))
    slots = plan.withColumnRenamed("length", "slot_length")
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("ranks"))
    placed = ranked.join(F.broadcast(slots), fits)  # the plan's size is bounded by the sequence length
    return placed.select(*parts.columns, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def packed(df: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document of ``df`` with their place."""
    return pack(cut(pieces(df, capacity, end_id, path, key, text)), capacity)
