"""Suffix-array de-duplication of long exact repeats over all documents (operator 6).

Every byte is removed that lies in a string of ``LENGTH`` bytes which starts anywhere else too.

1. Anchors. Of the first ``LENGTH - CONTENT + 1`` places of each window of ``LENGTH`` bytes, the one with the least hash is
   its anchor: equal windows have equal anchors, with equal ``CONTENT`` bytes behind them. About one anchor in 100 bytes
   stands for a run of windows (its span). An anchor whose content is found nowhere else has no repeated window.
2. A span that is found twice as a whole is removed as a whole, and from then on one copy of it stands for all.
3. What is left (contents with different spans: the edges of repeats) is sorted by suffix, shard by shard, by external
   induction with common prefixes (``suffixes``): equal contents share a shard, whatever documents they are from. A
   content with more than ``CROWD`` different spans is dealt again, by longer contents for narrower ranges of windows and
   at last by the windows themselves, so no shard grows with a frequent passage.

Null texts count as empty. Texts shorter than ``LENGTH`` stay as they are. Rows that are repeated are repeats of each other.
Ranges refer to rows by a 64-bit hash of id and text, so that an id may be null or name several texts.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import flat_bytes, mix, text_blocks
from quire.llm.shared import cut
from quire.llm.suffixes import repeats

LENGTH, CONTENT = 400, 200
CROWD = 4096
#: Bytes of spans that are sorted together, and the memory for queues beyond which they lie in files.
SHARD_BYTES, QUEUE_BYTES = 2 << 20, 128 << 20
#: Bytes of texts whose anchors are sought together; each takes about 100 bytes of memory.
ANCHOR_BYTES = 1 << 20
_PLACE = np.uint64(30)
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LETTERS = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) for seed in (11, 12)]


def rolling(data: np.ndarray, lane: int):
    """A function of (starts, stops) that gives a 64-bit value for each of those strings."""
    n = len(data) + 1
    base, back = np.full(n, _STEPS[lane], np.uint64), np.full(n, pow(_STEPS[lane], -1, 2**64), np.uint64)
    base[0] = back[0] = 1
    base = np.cumprod(base, dtype=np.uint64)
    total = np.zeros(n, np.uint64)
    np.cumsum(_LETTERS[lane][data] * np.cumprod(back, dtype=np.uint64)[:-1], out=total[1:])
    return lambda a, b: mix((total[b] - total[a]) * base[a] + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def least_in_window(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(key.dtype).max, key.dtype)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_in(data: np.ndarray, offsets: np.ndarray, length: int, content: int):
    """Row, anchor, first and last window start (from the row's begin), content value and two span values, as arrays."""
    width, n = length - content + 1, len(data)
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 3
    gram = np.zeros(n, np.uint64)
    gram[:] = data
    for k in (1, 2, 4):  # eight bytes from each place on
        gram[:-k] |= gram[k:] << np.uint64(8 * k)
    key = (mix(gram) >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64)
    least = least_in_window(key, width)[: n - length + 1] & np.uint64(2**30 - 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(n - length + 1)
    inside = start + length <= offsets[owner[: n - length + 1] + 1]
    start = start[inside]
    anchor, row = least[inside].astype(np.int64), owner[start]
    if not len(start):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 3
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, at, row = start[first], start[last], anchor[first], row[first]
    one, two = rolling(data, 0), rolling(data, 1)
    where = (at - lo).astype(np.uint64)
    spans = [mix(f(lo, hi + length) + where) for f in (one, two)]
    begin = offsets[row]
    return [row, at - begin, lo - begin, hi - begin, one(at, at + content), *spans]


def anchored(docs: DataFrame, key: str, text: str, length: int, content: int) -> DataFrame:
    """``content, s1, s2, id, at, lo, hi`` of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text, ANCHOR_BYTES):
            data, offsets = flat_bytes(block.column(text))
            row, at, lo, hi, *values = anchors_in(data, offsets, length, content)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v.view(np.int64)) for v in values), block.column(key).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (at, lo, hi))],
                names=["content", "s1", "s2", "id", "at", "lo", "hi"],
            )

    return docs.select(key, text).mapInArrow(run, "content long, s1 long, s2 long, id long, at int, lo int, hi int")


def sliced(docs: DataFrame, wanted: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """The bytes of wanted spans: rows (content, s1, s2, again, at, lo, hi) by ``id``, with ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text):
            data, offsets = flat_bytes(block.column(text))
            rows: dict[str, list] = {n: [] for n in ("content", "again", "id", "at", "lo", "hi", "body")}
            for k, (i, spans) in enumerate(zip(block.column("id").to_pylist(), block.column("spans").to_pylist(), strict=True)):
                for s in spans:
                    begin = int(offsets[k]) + s["lo"]
                    values = (s["content"], s["again"], i, s["at"], s["lo"], s["hi"], data[begin : begin + s["hi"] - s["lo"] + length].tobytes())
                    for name, v in zip(rows, values, strict=True):
                        rows[name].append(v)
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    listed = wanted.groupBy("id").agg(F.collect_list(F.struct("content", "again", "at", "lo", "hi")).alias("spans"))  # of one document
    found = docs.select(F.col(key).alias("id"), text).join(listed, "id")
    return found.mapInArrow(run, "content long, again boolean, id long, at int, lo int, hi int, body binary")


def promising(bodies: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Pieces (body, begin, stop) that hold all windows whose hash is found twice among ``bodies``; no other can be repeated,
    so that only these are sorted."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    many = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(bodies)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = place + (ends - sizes)[owner]
    value = rolling(data, 0)(start, start + length)
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(len(value), bool)
    twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(value) else False
    hit = np.flatnonzero(twice)
    if not len(hit):
        return []
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    return list(zip(owner[hit[first]].tolist(), place[hit[first]].tolist(), (place[hit[last]] + length).tolist(), strict=True))


def sorted_shards(spans: DataFrame, length: int, shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """``id, begin, stop`` of what is repeated in ``spans`` (content, again, id, lo, body), equal contents together.

    Spans marked ``again`` only take part; what is known of them needs no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int, int, bytes]] = []
        size = 0

        def done() -> pa.RecordBatch:
            bodies = [h[4] for h in held]
            pieces = promising(bodies, length)
            out: list[tuple[int, int, int]] = []
            found = repeats([bodies[k][a:b] for k, a, b in pieces], length, queue_bytes)
            for (k, begin, _), at in zip(pieces, found, strict=True):
                _, again, i, lo, _ = held[k]
                if again or not len(at):
                    continue
                cuts = np.flatnonzero(np.diff(at) > length) + 1  # windows that touch or overlap are one
                for part in np.split(at + begin + lo, cuts):
                    out.append((i, int(part[0]), int(part[-1]) + length))
            i, a, b = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id", "begin", "stop"])

        for batch in batches:
            for content, again, i, lo, body in zip(*(batch.column(c).to_pylist() for c in ("content", "again", "id", "lo", "body")), strict=True):
                if held and size >= shard_bytes and held[-1][0] != content:
                    yield done()
                    held, size = [], 0
                held.append((content, again, i, lo, body))
                size += len(body)
        if held:
            yield done()

    dealt = spans.select("content", "again", "id", "lo", "body").repartition("content").sortWithinPartitions("content")
    return dealt.mapInArrow(run, "id long, begin long, stop long")


def narrowed(spans: DataFrame, cells: int, length: int, content: int) -> DataFrame:
    """Spans dealt again: by ranges of the distance from window to anchor, with the bytes that all windows of a range share
    as their new content. One row stands for spans that are equal in a range."""
    width = -(-(length - content + 1) // cells)
    cell = F.explode(F.sequence(F.floor((F.col("at") - F.col("hi")) / width).cast("int"), F.floor((F.col("at") - F.col("lo")) / width).cast("int")))
    rows = spans.withColumn("cell", cell)
    least, most = F.col("cell") * width, F.least((F.col("cell") + 1) * width, F.lit(length - content + 1)) - 1
    lo = F.greatest(F.col("lo"), F.col("at") - most).cast("int")
    hi = F.least(F.col("hi"), F.col("at") - least).cast("int")
    rows = rows.withColumns({"first": lo, "final": hi})
    core = F.substring("body", F.col("at") - least - F.col("lo") + 1, length - (most - least))
    part = F.substring("body", F.col("first") - F.col("lo") + 1, F.col("final") - F.col("first") + length)
    return rows.select(F.xxhash64("content", "cell", core).alias("content"), "again", "id", "at", F.col("first").alias("lo"), F.col("final").alias("hi"), part.alias("body"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, content: int = CONTENT, crowd: int = CROWD) -> DataFrame:
    """``id, begin, stop``: byte ranges (that may overlap) of all that is to be removed; ``key`` is a long that names one text."""
    anchors = anchored(docs, key, text, length, content)
    # written, so that the join below meets two shuffles and adaptive execution can split a frequent content
    met = cut(anchors.groupBy("content").agg(F.count("*").alias("many")).where("many > 1").select("content"))
    marks = cut(anchors.join(met, "content", "left_semi"))
    spans = marks.groupBy("content", "s1", "s2").agg(F.count("*").alias("many"), F.min(F.struct("id", "at", "lo", "hi")).alias("one"))
    spans = cut(spans)
    whole = marks.join(spans.where("many > 1").select("content", "s1", "s2"), ["content", "s1", "s2"], "left_semi")
    whole = whole.select("id", F.col("lo").cast("long").alias("begin"), (F.col("hi") + length).cast("long").alias("stop"))
    mixed = spans.groupBy("content").agg(F.count("*").alias("kinds")).where("kinds > 1").select("content")
    edges = spans.join(mixed, "content", "left_semi").select("content", (F.col("many") > 1).alias("again"), "one.*")
    edges = cut(sliced(docs, edges, key, text, length))
    found = [whole]
    for cells in (8, length - content + 1):
        crowds = edges.groupBy("content").agg(F.count("*").alias("kinds")).where(F.col("kinds") > crowd).select("content")
        crowds = cut(crowds)
        if crowds.limit(1).count() == 0:
            break
        found.append(cut(sorted_shards(edges.join(crowds, "content", "left_anti"), length)))
        finer = narrowed(edges.join(crowds, "content", "left_semi"), cells, length, content)
        # one row for equal bytes; where they are found twice, both are repeats
        rows = cut(finer)
        alike = rows.groupBy("content", "body").agg(F.count("*").alias("many"), F.max("again").alias("again"), F.min(F.struct("id", "at", "lo", "hi")).alias("one"))
        alike = cut(alike)
        twice = alike.where("many > 1").select("content", "body")
        again = rows.where("not again").join(twice, ["content", "body"], "left_semi")
        found.append(again.select("id", F.col("lo").cast("long").alias("begin"), (F.col("hi") + length).cast("long").alias("stop")))
        edges = alike.select("content", (F.col("again") | (F.col("many") > 1)).alias("again"), "one.*", "body")
        edges = cut(edges.join(edges.groupBy("content").agg(F.count("*").alias("kinds")).where("kinds > 1").select("content"), "content", "left_semi"))
    else:
        found.append(sorted_shards(edges, length))
        edges = None
    if edges is not None:
        found.append(sorted_shards(edges, length))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def merged_ranges(begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order, those that overlap or touch made one."""
    order = np.argsort(begins, kind="stable")
    begins, stops = begins[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], begins[1:] > stops[:-1]])
    return begins[new], stops[np.append(np.flatnonzero(new)[1:], len(begins)) - 1]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with ``removed``, byte ranges as array<struct<begin,stop>> in any order, null for none. A column of that name is
    replaced. Rows of one id and one text get the same ranges."""
    docs = docs.drop("removed").withColumn("_row", F.xxhash64(key, text))
    ranges = repeated(docs, "_row", text, **how).groupBy(F.col("id").alias("_row")).agg(F.collect_list(F.struct("begin", "stop")).alias("removed"))
    return docs.join(ranges, "_row", "left").drop("_row")


def ranges_of(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    flat = value.values
    return merged_ranges(flat.field("begin").to_numpy(zero_copy_only=False), flat.field("stop").to_numpy(zero_copy_only=False))


def kept_bytes(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> bytes:
    places = np.concatenate([[0], np.stack([begins, stops], 1).ravel(), [len(data)]])
    return b"".join(data[a:b].tobytes() for a, b in zip(places[::2].tolist(), places[1::2].tolist(), strict=True))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of ``without_repeats(docs)``; ``with_text`` adds the remaining bytes as
    ``text`` (without letters that are left in part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text):
            data, offsets = flat_bytes(block.column(text))
            rows = []
            for k, ranges in enumerate(block.column("removed")):
                own = data[offsets[k] : offsets[k + 1]]
                begins, stops = ranges_of(ranges) if ranges.is_valid else (np.zeros(0, np.int64),) * 2
                kept = kept_bytes(own, begins, stops)
                rows.append((len(own), int((stops - begins).sum()), len(begins), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
            n, gone, spans, sha, left = zip(*rows, strict=True)
            names = ["k", "n", "r", "s", "h", "t"]
            yield pa.RecordBatch.from_arrays([block.column(key), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sha), pa.array(left, pa.string())], names=names)

    out = docs.select(key, text, "removed").mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, n long, r long, s long, h string, t string")
    out = out.toDF(key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
    return out if with_text else out.drop("text")


def trimmed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of ``without_repeats(docs)`` without the ranges; a letter that is removed in part only stays. ``removed`` goes."""
    kept = [c for c in docs.columns if c not in (text, "removed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text):
            data, offsets = flat_bytes(block.column(text))
            texts = block.column(text).to_pylist()
            for k, ranges in enumerate(block.column("removed")):
                if not ranges.is_valid:
                    continue
                own = data[offsets[k] : offsets[k + 1]]
                gone = np.zeros(len(own), bool)
                for a, b in zip(*ranges_of(ranges), strict=True):
                    gone[a:b] = True
                letter = np.cumsum((own & 0xC0) != 0x80) - 1
                whole = np.ones(int(letter[-1]) + 1, bool)
                whole[letter[~gone]] = False
                texts[k] = own[~whole[letter]].tobytes().decode()
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text])

    from pyspark.sql.types import StructType

    schema = StructType([*(docs.schema[c] for c in kept), docs.schema[text]])
    return docs.select(*kept, text, "removed").mapInArrow(run, schema)
