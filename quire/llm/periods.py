"""Detection of periodic runs of words with a sparse diagonal recurrence (operator 11).

A run is a stretch of words with smallest period q and at least ``max(LEAST, 3 * q)`` words that cannot be made longer.

The words of a text are gone through in order. An earlier occurrence of what ends at a word is a match on the diagonal of
its lag; the diagonal's length grows by one with each word that matches again, and where it breaks a run is emitted if the
length suffices. Diagonals are kept sparse without losing a run: a run with period q, m/2 < q <= m, has its last m words
at no smaller lag than q, or its period would be smaller. So on the level of m words (8, 16, 32, ...) only the nearest earlier
occurrence counts, and only lags above m/2 (on the first level all up to 8). A text of n words costs n log n steps, the same
for one repeated word and for prose. Levels go on with the words that still have an earlier occurrence.

Every text is handled whole within one task; nothing is shuffled. Null texts have no words and no runs, as texts with fewer
than ``LEAST`` words. Repeated rows and null ids give a row each. Texts are cut in blocks of several; a very long one is a
block of its own. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import mix, text_blocks
from quire.llm.words import WORD_BLOCK, Words

LEAST = 24
FIRST_LEVEL = 8


def runs(values: np.ndarray, begins: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``text, start, length, period`` of every run; ``values`` are the texts' words, ``begins`` the n + 1 places where each
    begins. Rows are in the order of text, start, period.

    ``least`` must be 24 at least, so that a run with a period up to 8 holds 8 words twice.
    """
    if least < 3 * FIRST_LEVEL:
        raise ValueError("least must be 24 or more")
    counts = np.diff(begins)
    owners = np.repeat(np.arange(len(counts)), counts)
    grams = mix(values ^ mix(owners.astype(np.uint64)))  # of the level's number of words, by the last one
    size, ends = 1, np.arange(len(values))
    found = [np.zeros((0, 4), np.int64)]
    while len(ends):
        # grams of 2 * size words: this gram and the one that ends size words before it
        double = ends[(ends - size >= begins[owners[ends]] + size - 1)]
        before = np.searchsorted(ends, double - size)
        before[before == len(ends)] = 0
        both = ends[before] == double - size
        here = np.searchsorted(ends, double[both])
        ends, grams = double[both], mix(grams[before[both]] * np.uint64(0x9E3779B97F4A7C15) + grams[here])
        size *= 2
        order = np.argsort(grams, kind="stable")  # ends ascend already
        same = np.zeros(len(order), bool)
        same[1:] = grams[order][1:] == grams[order][:-1]
        lag = np.zeros(len(order), np.int64)
        lag[order[1:]] = np.where(same[1:], ends[order][1:] - ends[order][:-1], 0)
        if size >= FIRST_LEVEL:
            lags = np.where((lag <= size) & ((lag > size // 2) | (size == FIRST_LEVEL)), lag, 0)
            at = np.flatnonzero(lags)
            new = np.ones(len(at), bool)
            new[1:] = (ends[at][1:] != ends[at][:-1] + 1) | (lags[at][1:] != lags[at][:-1]) | (owners[ends[at]][1:] != owners[ends[at]][:-1])
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
            period, first, last = lags[at[begin]], ends[at[begin]], ends[at[stop]]
            start = first - size + 1 - period
            length = last - start + 1
            long = length >= np.maximum(least, 3 * period)
            text = owners[start[long]]
            found.append(np.stack([text, start[long] - begins[text], length[long], period[long]], 1))
        # only grams that are found again can grow; their earlier copies are needed too
        again = same.copy()
        again[:-1] |= same[1:]
        keep = np.zeros(len(ends), bool)
        keep[order] = again
        ends, grams = ends[keep], grams[keep]
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def rewritten(counts: np.ndarray, hashes: list[int | None]) -> list[np.ndarray | None]:
    """The words that the contract's periodic texts take: a text whose hash is a multiple of 10 repeats a stretch to its end."""
    out: list[np.ndarray | None] = []
    for n, h in zip(counts.tolist(), hashes, strict=True):
        if n == 0 or h is None or h % 10:
            out.append(None)
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at = np.arange(n)
        at[a:] = a + (at[a:] - a) % p
        out.append(at)
    return out


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, repeat: bool = False) -> DataFrame:
    """Every row's ``key, n_words, runs, collapsed``: its runs by start and period, and its words without the repeats of any
    run after its first period. ``repeat`` first rewrites texts as ``rewritten`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", WORD_BLOCK):
            words = Words(block.column("text"))
            values, begins, counts = words.values(), words.begins, words.counts()
            take = np.arange(len(values))
            changed = [None] * len(counts)
            if repeat:
                ids = block.column("key").to_pylist()
                changed = rewritten(counts, [None if i is None else zlib.crc32(str(i).encode()) for i in ids])
                for k, at in enumerate(changed):
                    if at is not None:
                        take[begins[k] : begins[k + 1]] = begins[k] + at
            rows = runs(values[take], begins, least)
            step = np.zeros(len(values) + 1, np.int64)
            np.add.at(step, begins[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
            np.subtract.at(step, begins[rows[:, 0]] + rows[:, 1] + rows[:, 2], 1)
            kept = np.cumsum(step[:-1]) == 0
            plain = kept.copy()
            for k, at in enumerate(changed):
                if at is not None:
                    plain[begins[k] : begins[k + 1]] = False
            data, offsets = words.joined(plain)
            texts = [data[a:b].decode() for a, b in zip(offsets, offsets[1:])]
            for k, at in enumerate(changed):
                if at is not None:
                    which = begins[k] + at[kept[begins[k] : begins[k + 1]]]
                    texts[k] = b" ".join(words.data[a:b].tobytes() for a, b in zip(words.starts[which], words.stops[which])).decode()
            edges = np.searchsorted(rows[:, 0], np.arange(len(counts) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), pa.array(counts), pa.ListArray.from_arrays(pa.array(edges), spans), pa.array(texts, pa.string())],
                names=["key", "n_words", "runs", "collapsed"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("key", key)


def best(found: list[dict]) -> dict | None:
    """The run with the greatest exact exponent, then the least start, then the least period."""
    return max(found, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a text: its number of runs, the run of the greatest exponent, and hashes of all runs and of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs").to_pylist()
            top = [best(f) for f in lists]
            line = ["".join(f"{r['start']},{r['length']},{r['period']}\n" for r in f) for f in lists]
            columns = [pa.array([len(f) for f in lists], pa.int64())]
            columns += [pa.array([r and r[c] for r in top], pa.int64()) for c in ("start", "length", "period")]
            columns.append(pa.array([r and 1000 * r["length"] // r["period"] for r in top], pa.int64()))
            columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in line]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns, batch.column("collapsed_sha256")], names=OUT)

    rows = found.select(F.col(key).alias("key"), "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    kind = found.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    return out.withColumnRenamed("key", key)


OUT = ["key", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
