"""Removal of word windows that other documents have too, with a count-min sketch in front of the exact grouping (operator 13).

A word goes if it lies in a window of ``SIZE`` words whose words also start in a document with a smaller id.

1. Sketch: every task counts its windows (each once a document) in one row of cells that hold 0, 1 or "more". The row has some
   300 cells for each window, so it is held and sent as its cells alone: sorted, 16 low bits each and what is above them in
   unary, about 2.5 bytes a window. Merged, the cells with "more" are put into two rows of at most ``2 ** (BITS - 1)`` cells, which
   go to all tasks. A window's estimate is the least of its cells, so it is never too low: what it calls single is single.
2. Exact grouping: only windows estimated repeated are grouped, by 96 bits of their words, each task's copies merged to
   their least id before they are sent. So a window costs one entry a task, however many documents have it. Each window then
   gives one answer, to the document with the least id: there it stays. Nothing is sent to all its other documents.
3. Each document goes through its windows once more: a window estimated repeated that no answer keeps is removed. The
   answers of a document are never more than its own windows.

The cells of both follow the bytes of the texts; the two rows have ``2 ** BITS`` (128 MB in a Python worker) at most. Only repeated windows are
put there, so they fill up not with the number of windows but with that of the repeated ones: beyond about 300 million of these
more windows are grouped exactly, at most all of them; none is ever lost.

Null texts have no words. Rows that repeat an id are documents with one id: neither is smaller. Rows with a null id take no
part: nothing is removed from them or because of them. Texts with fewer than ``SIZE`` words stay whole. Windows are judged on the input.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import mix, text_blocks
from quire.llm.words import WORD_BLOCK, Words, grams

SIZE = 13
BITS, LEAST_BITS = 30, 20
#: Bits of the row that tasks count in beyond those of the bytes of the texts; the bits of a cell that are sent as they are; bits of a group
#: of cells that is merged; windows that a task counts before it sends their cells.
FINER, LOW, GROUPED, COUNTED = 6, 16, 10, 8_000_000
#: Cells of a region, and bytes of texts for one shard of the exact grouping.
REGION = 1 << 16
SHARD_BYTES = 128 << 20
#: Candidates that a task holds before it merges and sends them.
HELD = 2_000_000


def block_windows(texts: pa.Array, size: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, and for each window its first word and two values."""
    words = Words(texts)
    values, owners = words.values(), words.owners()
    first = np.flatnonzero(owners[: max(0, len(owners) - size + 1)] == owners[size - 1 :])
    return words, first, grams(values, size)[first], grams(values, size, 77)[first]


def cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in both rows, of ``2 ** (bits - 1)`` cells each, in like regions of the two."""
    own = hashes >> np.uint64(65 - bits)
    inside = np.uint64(REGION - 1)
    return own, (own & ~inside | mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) & inside) + np.uint64(1 << (bits - 1))


class Sketch:
    """Cells as two bits: found, and found more than once. Tasks count in a sparse row instead; this form is kept for tests."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.more = np.zeros((2, 1 << (bits - 6)), np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        for at in cells(hashes, self.bits):
            at = np.sort(at)
            again = np.unique(at[1:][at[1:] == at[:-1]])
            at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
            place, bit = self._set(at)
            self.more[place] |= self.once[place] & bit
            self.once[place] |= bit
            place, bit = self._set(again)
            self.more[place] |= bit

    @staticmethod
    def _set(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
        if not len(place):
            return place, bit
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        return place[begin], np.bitwise_or.reduceat(bit, begin)

    def regions(self) -> Iterator[tuple[int, bytes, bytes]]:
        width = REGION >> 6
        for k in range(len(self.once) // width):
            part = self.once[k * width : (k + 1) * width]
            if part.any():
                yield k, squeezed(part), squeezed(self.more[k * width : (k + 1) * width])


def squeezed(part: np.ndarray) -> bytes:
    """A region's bits: as they are, or as the number of set bits for each 256 and the low bytes of their places."""
    at = np.flatnonzero(np.unpackbits(part.view(np.uint8), bitorder="little"))
    counts = np.bincount(at >> 8, minlength=256)
    if len(at) + 256 >= REGION // 8 or counts.max() > 255:
        return part.tobytes()
    return counts.astype(np.uint8).tobytes() + (at & 255).astype(np.uint8).tobytes() if len(at) else b""


def spread(found: bytes) -> np.ndarray:
    """The opposite of ``squeezed``."""
    if len(found) == REGION // 8:
        return np.frombuffer(found, np.uint64)
    bits = np.zeros(REGION, np.uint8)
    if found:
        counts, low = np.frombuffer(found[:256], np.uint8), np.frombuffer(found[256:], np.uint8)
        bits[(np.repeat(np.arange(256), counts) << 8) | low] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def packed(cells: np.ndarray, wide: int) -> tuple[bytes, bytes]:
    """Sorted, different cells below ``2 ** wide``: the bits above ``LOW`` in unary, and the lower ones."""
    high = (cells >> np.uint64(LOW)).astype(np.int64) + np.arange(len(cells))
    bits = np.zeros(len(cells) + (1 << (wide - LOW)), np.uint8)
    bits[high] = 1
    return np.packbits(bits).tobytes(), cells.astype(np.uint16).tobytes()


def unpacked(high: bytes, low: bytes) -> np.ndarray:
    """The opposite of ``packed``."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))
    return ((at - np.arange(len(at))).astype(np.uint64) << np.uint64(LOW)) | np.frombuffer(low, np.uint16)


def fine_bits(bits: int, total: int) -> int:
    """Bits of a cell of the row that tasks count in."""
    return min(56, max(bits, int(total).bit_length() + FINER))


def folded(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """The regions of both rows with the cells of these hashes."""
    for at in cells(hashes, bits):
        region = (at >> np.uint64(16)).astype(np.int64)
        order = np.argsort(region, kind="stable")
        at, region = at[order], region[order]
        begin = np.flatnonzero(np.append(True, region[1:] != region[:-1])) if len(at) else []
        for one, two in zip(begin, [*begin[1:], len(at)], strict=True):
            part = np.zeros(REGION, np.uint8)
            part[at[one:two] & np.uint64(REGION - 1)] = 1
            yield int(region[one]), squeezed(np.packbits(part, bitorder="little").view(np.uint64))


def sketch(df: DataFrame, bits: int, fine: int, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``region, more``: two rows of ``2 ** (bits - 1)`` cells with those of the cells of one row of ``2 ** fine`` that more than one
    window of different documents may have hit."""
    groups = min(GROUPED, bits - 17)
    wide, down = fine - groups, np.uint64(64 - fine)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = np.sort(np.concatenate(held))
        new = np.append(True, found[1:] != found[:-1])
        at = np.flatnonzero(new)
        found, more = found[at], np.diff(np.append(at, len(found))) > 1
        edges = np.searchsorted(found, np.arange((1 << groups) + 1, dtype=np.uint64) << np.uint64(wide)).tolist()
        rows = []
        for k, (one, two) in enumerate(zip(edges, edges[1:])):
            if one < two:
                own = found[one:two] & np.uint64((1 << wide) - 1)
                rows.append((k, *packed(own, wide), np.packbits(more[one:two]).tobytes() if more[one:two].any() else b""))
        for k in range(0, len(rows), 128):
            group, *parts = zip(*rows[k : k + 128], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *(pa.array(c, pa.binary()) for c in parts)], names=["cells", "high", "low", "more"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for block in text_blocks(batches, text, WORD_BLOCK):
            words, first, hashes, _ = block_windows(block.column(text), size)
            text_of = words.owners()[first]
            order = np.lexsort((hashes, text_of))
            hashes, text_of = hashes[order], text_of[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
            held.append(hashes[new] >> down)
            many += len(held[-1])
            if many > COUNTED:
                yield from send(held)
                held, many = [], 0
        if many:
            yield from send(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def again() -> Iterator[pa.RecordBatch]:
            """What is held, twice over and "more" with it: its cells found more than once."""
            both = np.sort(np.concatenate(held))
            twice = np.unique(both[1:][both[1:] == both[:-1]])
            yield from (merged_batch([row]) for row in folded(((np.uint64(now << wide) | twice) << down), bits))

        for batch in batches:
            for group, high, low, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    if held:
                        yield from again()
                    now, held = group, []
                own = unpacked(high, low)
                held.append(own)
                if more:
                    held.append(own[np.unpackbits(np.frombuffer(more, np.uint8))[: len(own)] > 0])
        if held:
            yield from again()

    parts = df.where(F.col(key).isNotNull()).select(text).mapInArrow(count, "cells int, high binary, low binary, more binary")
    return parts.repartition("cells").sortWithinPartitions("cells").mapInArrow(merge, "region int, more binary")


def merged_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    region, more = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(region, pa.int32()), pa.array(more, pa.binary())], names=["region", "more"])


class Estimates:
    """Which windows the merged sketch estimates repeated."""

    def __init__(self, found: dict[int, bytes], bits: int, fine: int = 64):
        self.bits, self.known = bits, np.uint64((1 << 64) - (1 << (64 - fine)))
        self.more = np.zeros(1 << (bits - 6), np.uint64)
        width = REGION >> 6
        for region, part in found.items():
            self.more[region * width : (region + 1) * width] = spread(part)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in cells(hashes & self.known, self.bits):
            out &= (self.more[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


def least(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different pair of values with the least id, in the order of the first values."""
    one, two, ids = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((ids, two, one))
    one, two, ids = one[order], two[order], ids[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one[new], two[new], ids[new]


def keepers(df: DataFrame, estimates: Broadcast, bits: int, fine: int, shards: int, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, stays``: values of the windows estimated repeated that stay in this document, for no smaller one has them."""

    def send(held: list) -> Iterator[pa.RecordBatch]:
        one, two, ids = least(held)
        edges = np.searchsorted(one, (np.arange(1, shards, dtype=object) * 2**64 // shards).astype(np.uint64))
        parts = [p for p in zip(range(shards), *(np.split(c, edges) for c in (one, two, ids)), strict=True) if len(p[1])]
        names = ["shard", "one", "two", "ids"]
        columns = [[p[0] for p in parts], *([p[k].tobytes() for p in parts] for k in (1, 2, 3))]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, many = Estimates(estimates.value, bits, fine), [], 0
        for block in text_blocks(batches, text, WORD_BLOCK):
            words, first, one, two = block_windows(block.column(text), size)
            again = known.repeated(one)
            ids = block.column(key).to_numpy(zero_copy_only=False).astype(np.int64)[words.owners()[first[again]]]
            held.append(least([(one[again], (two[again] >> np.uint64(32)).astype(np.uint32), ids)]))
            many += len(held[-1][0])
            if many > HELD:
                yield from send(held)
                held, many = [], 0
        if many:
            yield from send(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def answers() -> Iterator[pa.RecordBatch]:
            one, _, ids = least(held)
            for k in range(0, len(one), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 200_000]), pa.array(one[k : k + 200_000].view(np.int64))], names=["id", "stay"])

        for batch in batches:
            for shard, one, two, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if held:
                        yield from answers()
                    now, held = shard, []
                held.append((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint32), np.frombuffer(ids, np.int64)))
        if held:
            yield from answers()

    found = df.where(F.col(key).isNotNull()).select(key, text).mapInArrow(find, "shard int, one binary, two binary, ids binary")
    kept = found.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(settle, "id long, stay long")
    return kept.groupBy("id").agg(F.collect_list("stay").alias("stays"))


def without_windows(df: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", most_bits: int = BITS) -> DataFrame:
    """Every row's ``key, n_words, n_removed, kept_text`` and ``removed``, the first word and the number of words of each
    removed stretch."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(most_bits, max(LEAST_BITS, int(total).bit_length()))
    fine = fine_bits(bits, total)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES)
    found = {r.region: bytes(r.more) for r in sketch(df, bits, fine, size, key, text).collect()}  # at most a bit a cell
    estimates = spark.sparkContext.broadcast(found)
    answers = keepers(df, estimates, bits, fine, shards, size, key, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Estimates(estimates.value, bits, fine)
        for block in text_blocks(batches, "text", WORD_BLOCK):
            words, first, one, _ = block_windows(block.column("text"), size)
            owners, ids = words.owners(), block.column("key")
            stays = block.column("stays")
            goes = known.repeated(one) & ids.is_valid().to_numpy(zero_copy_only=False)[owners[first]]
            goes[goes] = ~kept_in(one[goes], owners[first[goes]], stays)
            step = np.zeros(len(owners) + 1, np.int64)
            np.add.at(step, first[goes], 1)
            np.subtract.at(step, first[goes] + size, 1)
            gone = np.cumsum(step[:-1]) > 0
            data, offsets = words.joined(~gone)
            counts, begins = words.counts(), words.begins
            removed = np.zeros(len(gone) + 1, np.int64)
            np.cumsum(gone, out=removed[1:])
            edge = np.zeros(len(gone), bool)
            if len(gone):
                edge[0] = gone[0]
                edge[1:] = gone[1:] & (~gone[:-1] | (owners[1:] != owners[:-1]))
            at = np.flatnonzero(edge)
            last = np.zeros(len(gone), bool)
            if len(gone):
                last[-1] = gone[-1]
                last[:-1] = gone[:-1] & (~gone[1:] | (owners[1:] != owners[:-1]))
            length = np.flatnonzero(last) - at + 1
            spans = pa.StructArray.from_arrays([pa.array(at - begins[owners[at]]), pa.array(length)], names=["first", "words"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, begins).astype(np.int32)), spans)
            texts = [data[a:b].decode() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts), pa.array(removed[begins[1:]] - removed[begins[:-1]]), pa.array(texts, pa.string()), lists],
                names=["key", "n_words", "n_removed", "kept_text", "removed"],
            )

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    joined = rows.join(answers.hint("merge"), F.col("key") == F.col("id"), "left").select("key", "text", "stays")
    out = joined.mapInArrow(cut, "key long, n_words long, n_removed long, kept_text string, removed array<struct<first: bigint, words: bigint>>")
    return out.withColumnRenamed("key", key)


def kept_in(hashes: np.ndarray, owners: np.ndarray, stays: pa.ListArray) -> np.ndarray:
    """Whether each hash is in its text's list."""
    lists = stays.fill_null([]) if stays.null_count else stays
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(sizes)), sizes)
    both, of = np.concatenate([flat, hashes]), np.concatenate([own, owners])
    asked = np.concatenate([np.zeros(len(flat), bool), np.ones(len(hashes), bool)])
    order = np.lexsort((asked, both, of))
    both, of, asked = both[order], of[order], asked[order]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    known = np.repeat(~asked[begin], np.diff(np.append(begin, len(both)))) if len(both) else new
    out = np.zeros(len(both), bool)
    out[order] = known
    return out[len(flat) :]


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.col("kept_text").alias("text"))


def oracle_sql(size: int = SIZE) -> str:
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {size - 1}], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {size - 2}))) AS i FROM w)),
lo AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS k FROM win JOIN lo USING (s) WHERE lo < doc_id),
kept AS (SELECT doc_id, string_agg(ws[i], ' ' ORDER BY i) AS t
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) p
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.k = p.i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(t, '') AS text
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""
