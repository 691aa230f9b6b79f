"""Quality rules by a hashed n-gram log-likelihood ratio (operator 3).

Every text gives counts of its byte n-grams, hashed to ``BUCKETS``. One multinomial is of the trusted target (all texts that
labels call good), the other of the raw corpus, counted over all documents. Only texts that a filter of the good ids lets through
meet the labels in a join. A text's
score is the mean log ratio of its n-grams, so length does not matter; it is kept if the score reaches a threshold that is
fixed once for all documents: the cut between labelled good and bad texts that errs least, where losing a good text weighs
``LOSS`` times as much; the lowest of equal ones. The cut is sought in a histogram of all labelled scores, rounded to ``DIGITS`` digits.

Base counts are of whole texts. Words are ``[^\\x20\\x09-\\x0D]+``; null texts have none. A text without an n-gram scores 0.
Without labels the target is the raw corpus, every score is 0, and the base rules decide alone. Labels that are null are
left out; of several labels of one document the least counts. Repeated rows are judged each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import flat_bytes, mix, text_blocks
from quire.llm.shingles import SPACE, word_values

GRAM = 4
BUCKETS = 1 << 16
FILTER_BITS = 1 << 24  # of labelled ids, 2 MB
PART = 1024  # buckets whose counts a task sends together
DIGITS = 4
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20
LOSS = 10


def grams(texts: pa.Array, n: int = GRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram inside a text, and the text it is in."""
    data, offsets = flat_bytes(texts)
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        value = value << np.uint64(8) | data[k : len(data) - n + 1 + k]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(value)]
    inside = np.arange(len(value)) + n <= offsets[owner + 1]
    return (mix(value[inside]) % np.uint64(buckets)).astype(np.int64), owner[inside]


def repeats_by_row(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which (owner, value) stand more than once."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    out = np.zeros(len(values), bool)
    out[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return out


def base_counts(texts: pa.Array) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(texts)
    data, offsets = flat_bytes(texts)
    words, begins = word_values(texts, fold=False)
    per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    space = SPACE[data]
    chars, symbols = per_row(~space & ((data & 0xC0) != 0x80)), per_row(symbol[data])
    counts = np.diff(begins)

    windows = np.maximum(counts - 4, 0)
    owner = np.repeat(np.arange(n), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[:-1][owner]
    value = np.zeros(len(at), np.uint64)
    for k in range(5):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[at + k]) if len(at) else value
    found = at[repeats_by_row(value, owner)] if len(at) else at
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[: len(words)] > 0)])
    repeated = covered[begins[1:]] - covered[begins[:-1]]

    dup = np.zeros(n, np.int64)
    if len(data):
        new = data == 10
        first = np.zeros(len(data) + 1, bool)
        first[:-1][np.unique(offsets[:-1][np.diff(offsets) > 0])] = True
        first[1:] |= new
        starts = np.flatnonzero(first[:-1])
        stops = np.append(starts[1:], len(data))
        ends = np.where(new[stops - 1], stops - 1, stops)
        letters = np.concatenate([[0], np.cumsum(~space)])
        real = letters[ends] > letters[starts]
        starts, ends = starts[real], ends[real]
        line = strings_values(data, starts, ends)
        row = np.searchsorted(offsets, starts, side="right") - 1
        order = np.lexsort((line, row))
        same = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
        dup = np.bincount(row[order][1:][same], minlength=n)
    return np.stack([counts, chars, symbols, dup, repeated])


def strings_values(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    from quire.llm.repeats import rolling

    return rolling(data, 0)(starts, stops)


class Ratio:
    """Log ratio of each bucket, and the threshold."""

    def __init__(self, raw: np.ndarray, trusted: np.ndarray, threshold: float | None = None):
        smooth = lambda c: (c + 0.5) / (c.sum() + 0.5 * len(c))
        self.log = np.log(smooth(trusted) / smooth(raw)) if trusted.sum() else np.zeros(len(raw))
        self.threshold = threshold

    def scores(self, texts: pa.Array) -> np.ndarray:
        bucket, owner = grams(texts, buckets=len(self.log))
        total = np.bincount(owner, weights=self.log[bucket], minlength=len(texts))
        return total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)


def best_cut(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the least sum of error rates, a lost good text weighing ``LOSS`` times as much, midway between the scores
    on its sides; minus infinity if one kind is missing. Scores are distinct and in order, with counts of good and bad texts."""
    if not good.sum() or not bad.sum():
        return float("-inf")
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()  # good ones below the cut
    let = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    k = int(np.argmin(LOSS * lost + let))
    return float("-inf") if k == 0 else float("inf") if k == len(scores) else float((scores[k - 1] + scores[k]) / 2)


def likely(texts: DataFrame, good: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Texts whose id may be in ``good``, by a Bloom filter: only they need to move to the labels. None that is in is lost;
    where ids fill the filter, more texts move."""
    places = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in range(2)]
    ids = good.select(F.col("labelled").alias("id")).select(F.explode(F.array(*places)).alias("at"))
    words = ids.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.ones(batch.num_rows, bool)
            for name in ("p0", "p1"):
                at = batch.column(name).to_numpy()
                there &= shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0
            yield batch.select(["id", "text"]).filter(pa.array(there))

    kind = texts.schema["id"].dataType.simpleString()
    return texts.where(F.col("id").isNotNull()).select("id", "text", *(p.alias(f"p{k}") for k, p in enumerate(places))).mapInArrow(kept, f"id {kind}, text string")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> Ratio:
    """Counts over all documents and all trusted ones, summed in partitions before they meet."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("labelled")).agg((F.min(label) > 0).alias("good"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    meet = F.col("id") == F.col("labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for block in text_blocks(batches, "text"):
            found += np.bincount(grams(block.column("text"), buckets=buckets)[0], minlength=buckets)
        parts = [(k, found[k : k + PART].tobytes()) for k in range(0, buckets, PART) if found[k : k + PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([n for _, n in parts], pa.binary())], names=["first", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("first").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(counts, np.int64)
        for k, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(k + np.arange(len(counts))), pa.array(counts)], names=["bucket", "n"])

    def sums(rows: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        parts = rows.select("text").mapInArrow(counted, "first int, counts binary").repartition("first")
        for r in parts.mapInArrow(summed, "bucket long, n long").collect():  # at most `buckets`
            out[r.bucket] = r.n
        return out

    good = known.where("good").select("labelled")
    raw, trusted = sums(texts), sums(likely(texts, good).join(good.hint("merge"), meet, "left_semi"))
    model = Ratio(raw, trusted)
    ratio = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(ratio.value.scores(block.column("text")))], names=["id", "score"])

    scores = texts.mapInArrow(scored, f"id {docs.schema[key].dataType.simpleString()}, score double")  # no text is shuffled for the cut
    seen = scores.join(known.hint("merge"), meet).groupBy(F.round("score", DIGITS).alias("score"))
    seen = seen.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("score").collect()  # one row for each rounded score
    model.threshold = best_cut(*(np.array([r[c] for r in seen], float) for c in range(3)))
    return model


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score`` of every row."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key=key, text=text, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text):
            counts = base_counts(block.column(text))
            words, repeated = counts[0], counts[4]
            failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
            score = ratio.value.scores(block.column(text))
            kept = ~failed & (score >= ratio.value.threshold)
            yield pa.RecordBatch.from_arrays([block.column(key), *map(pa.array, counts.astype(np.int64)), pa.array(failed), pa.array(kept), pa.array(score)], names=list("abcdefghi"))

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"a {kind}, b long, c long, d long, e long, f long, g boolean, h boolean, i double")
    return out.toDF(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
