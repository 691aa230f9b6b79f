"""MinHash near-duplicates by fast similarity sketching (operator 8).

Sketch: in round i every element of a set is hashed to one bin with a value; rounds go on until each bin is filled, and
rounds t to 2t - 1 place every element in bin i - t, so that every coordinate fills; a coordinate keeps the least
(round, value). Sets of more than t log t elements are done after about one round. Coordinates agree with probability J
and estimates concentrate as for independent hashes.

Banding: ``BANDS`` bands of ``ROWS`` coordinates. Two sets with J of 0.85 share no band with probability 2e-6.

Verification, on full sets of 64-bit shingle values, and exact for every candidate:

- equal sets are one representative (the smallest id), so copies never form pairs;
- a bucket of up to ``SMALL`` representatives gives all of its pairs;
- a larger bucket first gives a star around its most common member (the one with the fewest shingles that no other
  document of such buckets has). What is then not yet in the component of the star's centre is compared with the bucket
  only where private shingles and what both share with the centre leave room for the threshold; these bounds are exact, so
  no link is lost.

Null texts and texts without words have no set and are linked with nothing. Rows with one doc_id count as one document
with several texts; each row comes back once. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import mix, text_blocks
from quire.llm.shared import cut
from quire.llm.shingles import shingle_sets

BANDS, ROWS = 28, 6
SMALL = 24
THRESHOLD = 85  # in hundredths


def sketches(values: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """One row of ``t`` coordinates for each set; sets without elements get the greatest value everywhere."""
    n = len(offsets) - 1
    empty = np.uint64(2**64 - 1)
    out = np.full(n * t, empty, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    left = np.diff(offsets) > 0
    elements = values
    for i in range(2 * t):
        if not len(elements):
            break
        v = mix(elements + np.uint64((i + 1) * 0xD1B54A32D192ED03 % 2**64))
        bins = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(v), i - t)
        np.minimum.at(out, owner * t + bins, (np.uint64(i) << np.uint64(32)) | (v & np.uint64(0xFFFFFFFF)))
        left &= (out.reshape(n, t) == empty).any(axis=1)
        stay = left[owner]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, n, digest, bands`` of each row; sets without elements have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text):
            values, offsets = shingle_sets(block.column(text))
            n = np.diff(offsets)
            keys = band_keys(sketches(values, offsets, bands * rows), bands, rows)[n > 0]
            sums = [np.add.reduceat(np.append(f(values), np.uint64(0)), np.minimum(offsets[:-1], len(values))) for f in (mix, lambda v: mix(v ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
            digest = np.stack(sums, axis=1).astype("<u8") if len(n) else np.zeros((0, 2), "<u8")
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays(
                [block.column(key), pa.array(n.astype(np.int64)), pa.array([x.tobytes() for x in digest], pa.binary()), lists],
                names=["id", "n", "digest", "bands"],
            )

    return docs.select(key, text).mapInArrow(run, "id long, n long, digest binary, bands array<long>")


def sets_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, elements``: the sorted shingle values of each row, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text):
            values, offsets = shingle_sets(block.column(text))
            raw = values.astype("<u8").tobytes()
            out = [raw[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(key), pa.array(out, pa.binary())], names=["id", "elements"])

    return docs.select(key, text).mapInArrow(run, "id long, elements binary")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``na, nb``, the sizes of their full sets, and ``both``, that of the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("ea"), batch.column("eb"), strict=True):
                a, b = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                few, many = (a, b) if len(a) <= len(b) else (b, a)
                both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()) if len(few) else 0
                rows.append((len(a), len(b), both))
            counts = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *map(pa.array, counts)], names=["a", "b", "na", "nb", "both"])

    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long, na long, nb long, both long")


def linked(measured: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Those of ``overlaps`` that reach the threshold."""
    return measured.where((F.col("both") > 0) & (100 * F.col("both") >= threshold * (F.col("na") + F.col("nb") - F.col("both")))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that each end of an edge can reach.

    Labels take the least label beside them and then the label of their label, until none changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = cut(labels)
    while True:
        beside = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(beside, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        roots = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = cut(least.join(roots, "component", "left").select("id", "old", F.least("component", "root").alias("component")))
        labels = new.select("id", "component")
        if not new.where(F.col("old") != F.col("component")).limit(1).count():
            return labels


def links(reps: DataFrame, docs: DataFrame, key: str, text: str, threshold: int = THRESHOLD, small: int = SMALL) -> DataFrame:
    """Verified links (a, b) between representatives ``id, n, bands`` that suffice to connect all that are linked."""
    banded = reps.select("id", "n", F.explode("bands").alias("bucket"))
    # written (as the centres below), so that joins meet two shuffles and adaptive execution can split a frequent bucket
    sizes = cut(banded.groupBy("bucket").agg(F.count("*").alias("many")).where(F.col("many") > 1))
    members = cut(banded.join(sizes, "bucket"))
    alike = lambda a, b: 100 * F.least(a, b) >= threshold * F.greatest(a, b)

    listed = members.where(F.col("many") <= small).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("m"))  # at most `small`
    pairs = listed.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, F.lit(small))).alias("y"))
    pairs = pairs.where(alike(F.col("x.n"), F.col("y.n"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    wanted = members.select(F.col("id").alias("wanted")).distinct()
    texts = docs.select(key, text).join(wanted, F.col(key) == F.col("wanted"), "left_semi")
    sets = cut(sets_of(texts, key, text))

    large = members.where(F.col("many") > small)
    if large.limit(1).count() == 0:
        return cut(linked(overlaps(pairs, sets), threshold))
    crowd = large.select("id").distinct()

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("elements"), strict=True):
                e = np.frombuffer(x.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), i)), pa.array(e)], names=["id", "element"])

    rows = sets.join(crowd, "id", "left_semi").mapInArrow(exploded, "id long, element long")
    owned = rows.groupBy("element").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count("*").alias("own"))
    large = cut(large.join(owned, "id", "left").fillna(0, ["own"]))
    centres = cut(large.groupBy("bucket").agg(F.min(F.struct("own", "id", "n")).alias("c"), F.min("n").alias("least_n")))
    large = large.join(centres, "bucket").withColumns({"a": F.least("id", "c.id"), "b": F.greatest("id", "c.id")})
    star = cut(overlaps(large.where((F.col("id") != F.col("c.id")) & alike(F.col("n"), F.col("c.n"))).select("a", "b").distinct(), sets))
    found = cut(linked(overlaps(pairs, sets).unionByName(star), threshold))

    # What the star has not joined to its centre's component meets the bucket again, where the bounds leave room: common
    # shingles are common with the centre in both (`inner`), or foreign to it and private to neither (`outer`).
    label = components(found)
    of_centre = label.select(F.col("id").alias("centre"), F.col("component").alias("main"))
    placed = large.join(label, "id", "left").join(of_centre, F.col("c.id") == F.col("centre"), "left")
    placed = placed.join(star.select("a", "b", "both"), ["a", "b"], "left")
    shared = F.col("n") - F.col("own")
    inner = F.when(F.col("id") == F.col("c.id"), F.col("n")).otherwise(F.coalesce("both", shared))
    placed = cut(
        placed.select(
            "bucket", "id", "n", shared.alias("shared"), "least_n", F.coalesce("component", "id").alias("component"),
            F.coalesce("main", "c.id").alias("main"), inner.alias("inner"), F.when(F.col("both").isNull() & (F.col("id") != F.col("c.id")), shared).otherwise(shared - inner).alias("outer"),
        )
    )
    room = lambda n, m, both: 100 * both >= threshold * (n + m - both)
    rest = placed.where((F.col("component") != F.col("main")) & room(F.col("n"), F.greatest("least_n", "shared"), F.col("shared")))
    rest = rest.select("bucket", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "shared", "component", "inner", "outer")])
    most = F.least("shared", "x_shared", F.least("inner", "x_inner") + F.least("outer", "x_outer"))
    more = rest.join(placed, "bucket").where(
        (F.col("component") != F.col("x_component")) & alike(F.col("n"), F.col("x_n")) & room(F.col("n"), F.col("x_n"), most)
    )
    more = more.select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b")).distinct()
    return found.union(cut(linked(overlaps(more, sets), threshold)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row."""
    rows = cut(sketched(docs, key, text))
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"))
    reps = cut(rows.where("n > 0").join(classes, ["digest", "id"]).select("id", "n", "bands").dropDuplicates(["id"]))
    label = components(links(reps, docs, key, text, threshold))
    of_class = classes.join(label, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = rows.join(of_class, ["digest"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
