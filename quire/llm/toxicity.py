"""Toxicity from the nearest labelled examples (operator 2).

Terms are all words of at least ``WORD_DOCS`` training rows, and beginnings (four to eight letters) of longer words, as far as
their presence is associated with the label (G-squared and lift over the training rows). Examples are TF-IDF vectors over
these terms, in which association is a weight, in a block-max inverted index: postings of the rarer terms are summed, the
greatest weights of blocks of examples bound what common terms add, and only examples whose bound reaches the k-th best
are completed: the neighbours are the exact ones. Their labels are voted with their cosines as weights; votes become probabilities by a monotone fit on votes that the examples get from the others. The
neighbours are returned as evidence.

Fit: at most ``SAMPLE`` labelled rows, those with the least hash of their id, all if there are fewer. Only text is scored.
Null texts count as empty; a text without a known word gets the rate of training rows without one. Repeated rows are scored
each. Labels that are null are left out; of several labels of one document the greatest counts. Without labels, every
score is the prior. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from quire.llm.blocks import strings, text_blocks
from quire.llm.shared import cut

SAMPLE = 16_000
WORD_DOCS = 2
LEAST_DOCS, LEAST_G2, LEAST_LIFT = 4, 20.0, 20.0
BEGINNINGS = range(4, 9)
NEIGHBOURS = 16
BLOCK = 128
COMMON = 384  # terms that are held as rows
FIT_BLOCK, SCORE_BLOCK = 1 << 20, 2 << 20  # bytes of texts whose terms a task holds
TOGETHER = 64  # texts that are searched at a time
VOTERS = 12  # tasks of the votes on examples
PRIOR = 0.1
_WORD = re.compile(r"[^\W_]+")


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def features(chunk: str) -> list[str]:
    """Terms of a part between white spaces: its words, and beginnings marked by a star."""
    out = []
    for w in _WORD.findall(chunk):
        out.append(w)
        out += [w[:k] + "*" for k in BEGINNINGS if len(w) > k]
    return out


class Terms:
    """Counts of known terms in texts; what a chunk holds is remembered."""

    def __init__(self, ids: dict[str, int], most: int = 50_000):
        self.ids, self.most, self.known = ids, most, {}
        self.stems = {t[: BEGINNINGS[0]] for t in ids if t.endswith("*")}

    def terms(self, chunk: str) -> list[int]:
        """The known ones of ``features(chunk)``."""
        out = []
        for w in (chunk,) if chunk.isalnum() else _WORD.findall(chunk):
            if (i := self.ids.get(w)) is not None:
                out.append(i)
            if w[: BEGINNINGS[0]] in self.stems:
                out += [i for k in BEGINNINGS if len(w) > k and (i := self.ids.get(w[:k] + "*")) is not None]
        return out

    def count(self, text: str) -> dict[int, int]:
        chunks = Counter(text.lower().split())
        known = self.known
        if len(known) > self.most:
            known.clear()
        out: dict[int, int] = {}
        for c, n in chunks.items():
            if (ids := known.get(c)) is None:
                ids = known[c] = self.terms(c)
            for i in ids:
                out[i] = out.get(i, 0) + n
        return out


def weighted(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term ids and weights of length one."""
    w = (1 + np.log(counts)) * idf[ids]
    return ids, w / math.sqrt(float(w @ w)) if len(w) else w


def vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term ids in order and weights of length one."""
    ids = np.fromiter(counts, np.int64, len(counts))
    order = np.argsort(ids)
    return weighted(ids[order], np.fromiter(counts.values(), float, len(counts))[order], idf)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes[i]`` numbers from ``starts[i]`` on, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class BlockMax:
    """Exact nearest vectors by cosine. Vectors lie in blocks that share their commonest term and are of like length, so that
    their weights are alike.

    The terms of most vectors (``COMMON`` of them) are held as rows of the vectors, with the greatest weight of each block;
    the postings of all others by term. A search adds up the postings, which gives every vector's exact share of the rarer
    terms, bounds what the common terms can add by the blocks' greatest weights, and completes only vectors whose bound
    reaches the k-th best, in 64 bits.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK, common: int = COMMON):
        none = [np.zeros(0, np.int32)], [np.zeros(0)]
        terms, weights = (np.concatenate([*first, *parts]) for first, parts in zip(none, zip(*vectors) if vectors else ((), ()), strict=True))
        self.fill(np.array([len(i) for i, _ in vectors], np.int64), terms.astype(np.int32), weights, block, common)

    @classmethod
    def of(cls, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int = BLOCK, common: int = COMMON) -> "BlockMax":
        """The index of vectors that lie one behind the other."""
        new = cls.__new__(cls)
        new.fill(sizes, term, weight, block, common)
        return new

    def fill(self, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int, common: int) -> None:
        self.n, self.block = len(sizes), block
        df = np.bincount(term)
        self.rank = rank = np.empty(len(df), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
        lead = np.full(self.n, len(df))  # each vector's commonest term: texts of one language share it
        np.minimum.at(lead, np.repeat(np.arange(self.n), sizes), rank[term])
        self.place = np.lexsort((sizes, lead)).astype(np.int32)  # the vector at each inner place
        inner = np.empty(self.n, np.int32)
        inner[self.place] = np.arange(self.n, dtype=np.int32)
        at = np.repeat(inner, sizes)
        del inner, lead
        self.terms = len(df)
        most = np.sort(np.argsort(-df, kind="stable")[:common])
        self.row = np.full(self.terms, -1, np.int32)  # the column of a common term
        self.row[most] = np.arange(len(most), dtype=np.int32)
        own = self.row[term] >= 0
        self.dense = np.zeros((self.n, len(most)), np.float32)
        self.dense[at[own], self.row[term[own]]] = weight[own]
        self.rest = np.zeros_like(self.dense)  # what 32 bits leave of the weights
        self.rest[at[own], self.row[term[own]]] = weight[own] - weight[own].astype(np.float32)
        blocks = np.arange(0, self.n, block)
        self.most = np.maximum.reduceat(self.dense, blocks, axis=0) if self.n else self.dense
        term, at, weight = term[~own], at[~own], weight[~own]
        order = np.argsort(term, kind="stable")
        self.at, self.weight = at[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(self.terms + 1))

    def lead(self, ids: np.ndarray) -> int:
        """The rank of the commonest of the terms."""
        return int(self.rank[ids[ids < self.terms]].min(initial=self.terms))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest that share a term, nearest first, ties to the smaller place."""
        return self.nearest_of([(ids, weights)], k)[0]

    def nearest_of(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for several vectors, which meet each block together."""
        if not self.n or not self.terms:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in asked]
        blocks = len(self.most)
        share = np.zeros((len(asked), blocks * self.block))
        common = np.zeros((len(asked), self.dense.shape[1]))
        for q, (ids, weights) in enumerate(asked):
            known = ids < self.terms
            ids, weights = ids[known], weights[known]
            column = self.row[ids]
            rare = column < 0
            common[q, column[~rare]] = weights[~rare]
            many = self.first[ids[rare] + 1] - self.first[ids[rare]]
            posts = ranges(self.first[ids[rare]], many)
            share[q] = np.bincount(self.at[posts], np.repeat(weights[rare], many) * self.weight[posts], minlength=share.shape[1])
        short = common.astype(np.float32)
        upper = share.reshape(len(asked), blocks, self.block).max(2) + (short @ self.most.T) * 1.00001 + 1e-6  # of 32-bit sums
        score = np.full(share.shape, -1.0)
        floor = np.full(len(asked), 1e-9)
        order = np.argsort(-upper, axis=1)[:, : 2 + k // self.block * 2]
        todo = np.zeros(upper.shape, bool)
        np.put_along_axis(todo, order, True, axis=1)
        done = np.zeros(upper.shape, bool)
        for last in (False, True):  # the most promising blocks give a floor, then all that reach it
            for b in np.flatnonzero(todo.any(0)):
                at = slice(b * self.block, min((b + 1) * self.block, self.n))
                own = todo[:, b] if 2 * todo[:, b].sum() < len(asked) else slice(None)  # for most is as dear as for all
                score[own, at] = share[own, at] + short[own] @ self.dense[at].T
            if not last:
                for q in range(len(asked)):
                    some = score[q][score[q] >= 0]
                    if len(some) >= k:
                        floor[q] = max(floor[q], np.partition(some, -k)[-k] - 1e-5)
                todo = (upper >= floor[:, None]) & ~todo
        out = []
        for q in range(len(asked)):
            hit = np.flatnonzero(score[q] >= floor[q])
            if len(hit) > k:
                hit = hit[score[q, hit] >= np.partition(score[q, hit], -k)[-k] - 1e-5]
            column = np.flatnonzero(common[q])
            rows = self.dense[hit[:, None], column].astype(np.float64) + self.rest[hit[:, None], column]
            exact = share[q, hit] + rows @ common[q, column]
            hit, exact = hit[exact > 0], exact[exact > 0]
            best = np.lexsort((self.place[hit], -np.round(exact, 12)))[:k]
            out.append((self.place[hit[best]].astype(np.int64), exact[best]))
        return out


class Model:
    """Terms, index, label counts of each indexed vector and the fitted steps from votes to scores.

    ``examples`` are document, label, term ids in order and their counts."""

    def __init__(self, ids: dict[str, int], idf: np.ndarray, examples: Iterator[tuple[int, int, np.ndarray, np.ndarray]], k: int = NEIGHBOURS):
        self.ids, self.idf, self.k = ids, idf, k
        groups: dict[tuple, list] = {}
        self.none = [0, 0]
        for doc, label, terms, counts in examples:
            if not len(terms):
                self.none[0] += 1
                self.none[1] += label
                continue
            g = groups.setdefault((terms.astype(">i4").tobytes(), counts.astype(">i4").tobytes()), [0, 0, doc])
            g[0] += 1
            g[1] += label
            g[2] = min(g[2], doc)
        keys = sorted(groups)
        self.rows = np.array([groups[x][0] for x in keys], float)
        self.toxic = np.array([groups[x][1] for x in keys], float)
        self.docs = [groups[x][2] for x in keys]
        # one after the other and small, for this is what is sent; the index is built where it is used
        self.offsets = np.cumsum([0, *(len(t) // 4 for t, _ in keys)])
        self.terms = np.frombuffer(b"".join(t for t, _ in keys), ">i4").astype(np.int32)
        counts = np.frombuffer(b"".join(c for _, c in keys), ">i4")
        self.counts = counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.int32)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None
        self.built: BlockMax | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    @property
    def index(self) -> BlockMax:
        if self.built is None:
            weight = (1 + np.log(self.counts.astype(float))) * self.idf[self.terms]
            sizes = np.diff(self.offsets)
            length = np.sqrt(np.add.reduceat(weight * weight, self.offsets[:-1])) if len(sizes) else np.zeros(0)
            weight /= np.repeat(length, sizes)
            self.built = BlockMax.of(sizes, self.terms, weight)
        return self.built

    def example(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.offsets[place], self.offsets[place + 1])
        return weighted(self.terms[own].astype(np.int64), self.counts[own].astype(float), self.idf)

    def votes_on(self, places: list[int]) -> Iterator[tuple[float, int, float]]:
        """The vote of the other examples on each, its label and how many rows it stands for."""
        for begin in range(0, len(places), TOGETHER):
            some = places[begin : begin + TOGETHER]
            for place, (at, near) in zip(some, self.index.nearest_of([self.example(p) for p in some], self.k + 1), strict=True):
                for label, many in ((1, self.toxic[place]), (0, self.rows[place] - self.toxic[place])):
                    if many:
                        yield self.vote(at, near, (place, label)), label, many

    def vote(self, at: np.ndarray, near: np.ndarray, without: tuple[int, int] | None = None) -> float:
        """The toxic share of neighbours, weighted by cosine; -1 if there are none."""
        rows, toxic = self.rows[at], self.toxic[at]
        if without is not None:
            own = at == without[0]
            rows, toxic = rows - own, toxic - own * without[1]
        total = float(near @ rows)
        return float(near @ toxic) / total if total > 0 else -1.0

    def rate(self, rows: float, toxic: float) -> float:
        return (toxic + PRIOR) / (rows + 1)

    def fit(self, votes: list[tuple[float, int, float]]) -> None:
        """Pool adjacent violators over votes; a vote of -1 (no neighbour) is part of the lowest pool."""
        pools: list[list[float]] = []
        for v, label, many in sorted(votes):
            pools.append([v, many, label * many])
            while len(pools) > 1 and (pools[-1][0] == pools[-2][0] or pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]):
                v2, n2, t2 = pools.pop()
                pools[-1][1] += n2
                pools[-1][2] += t2
        self.steps = (np.array([p[0] for p in pools]), np.array([self.rate(p[1], p[2]) for p in pools]))

    def scores(self, counts: list[dict[int, int]]) -> list[tuple[float, list[tuple[int, float, float]]]]:
        """The score of each text's terms, and its neighbours with cosines and labels."""
        starts, values = self.steps
        out: list = [(self.rate(*self.none), [])] * len(counts)
        full = [(i, vector(c, self.idf)) for i, c in enumerate(counts) if c] if len(starts) else []
        full.sort(key=lambda v: self.index.lead(v[1][0]))  # like texts meet like blocks
        for begin in range(0, len(full), TOGETHER):
            some = full[begin : begin + TOGETHER]
            for (i, _), (at, near) in zip(some, self.index.nearest_of([v for _, v in some], self.k), strict=True):
                step = int(np.searchsorted(starts, self.vote(at, near), side="right")) - 1
                share = self.toxic[at] / self.rows[at]
                out[i] = float(values[max(0, step)]), [(self.docs[j], s, y) for j, s, y in zip(at.tolist(), near.tolist(), share.tolist(), strict=True)]
        return out


def sampled(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, sample: int) -> DataFrame:
    """``key, text, label`` of the bounded sample of training rows."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    few = known.orderBy(F.xxhash64(key), key).limit(sample)
    return docs.select(key, text).join(F.broadcast(few), key)  # at most `sample` rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, k: int = NEIGHBOURS) -> Model:
    rows = cut(sampled(docs, labels, label, key, text, sample))  # read three times

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for block in text_blocks(batches, text, FIT_BLOCK):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(strings(block.column(text)), block.column("label").to_pylist(), strict=True):
                terms = set()
                for c in set(t.lower().split()):
                    if (f := known.get(c)) is None:
                        f = known[c] = features(c)
                    terms.update(f)
                found[y > 0].update(terms)
            known.clear()
            every = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), *(pa.array([f[e] for e in every], pa.int64()) for f in found)], names=["term", "clean", "toxic"]
            )

    sizes = {r.label > 0: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    ids: dict[str, int] = {}
    idf = np.zeros(0)
    spark = docs.sparkSession
    if n0 and n1:
        seen = rows.mapInArrow(present, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
        part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
        df, n = F.col("c") + F.col("t"), n0 + n1
        cells = [(F.col("t"), n1, df), (F.col("c"), n0, df), (n1 - F.col("t"), n1, n - df), (n0 - F.col("c"), n0, n - df)]
        g2 = 2 * sum((part(o, side * total / n) for o, side, total in cells), F.lit(0.0))
        lift = ((F.col("t") + 0.5) / (n1 + 1)) / ((F.col("c") + 0.5) / (n0 + 1))
        seen = seen.withColumns({"g2": g2, "df": df, "lift": lift, "beginning": F.col("term").endswith("*")})
        tied = ((F.col("lift") >= LEAST_LIFT) | (F.col("lift") <= 1 / LEAST_LIFT)) & (F.col("g2") >= LEAST_G2) & (F.col("df") >= LEAST_DOCS)
        first = seen.where(F.col("beginning") & tied)
        kept = seen.where(~F.col("beginning") & (F.col("df") >= WORD_DOCS)).unionByName(first)  # bounded by the words of the sample
        best = kept.select("term", "df", "g2", "lift").toArrow().sort_by([("g2", "descending"), ("term", "ascending")])
        ids = {t: i for i, t in enumerate(best.column("term").to_pylist())}
        many, g2, lift = (best.column(c).to_numpy() for c in ("df", "g2", "lift"))
        tie = np.sqrt(np.maximum(0, g2 - LEAST_G2)) * np.minimum(1, np.abs(np.log(lift)) / math.log(LEAST_LIFT))
        idf = (np.log((1 + n) / (1 + many)) + 1) * (1 + tie)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(ids)
        for block in text_blocks(batches, text, FIT_BLOCK):
            counts = [terms.count(t) for t in strings(block.column(text))]
            yield pa.RecordBatch.from_arrays(
                [block.column(key), block.column("label"), pa.array([sorted(c) for c in counts], pa.list_(pa.int32())), pa.array([[c[i] for i in sorted(c)] for c in counts], pa.list_(pa.int32()))],
                names=["id", "label", "terms", "counts"],
            )

    vectors = rows.mapInArrow(counted, f"id {docs.schema[key].dataType.simpleString()}, label int, terms array<int>, counts array<int>").toArrow()  # at most `sample`

    def examples() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for batch in vectors.to_batches():
            for i, y, t, c in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("terms"), batch.column("counts"), strict=True):
                yield i, int(y > 0), t.values.to_numpy(), c.values.to_numpy()

    model = Model(ids, idf, examples(), k)
    shared = spark.sparkContext.broadcast(model)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = list(m.votes_on(batch.column("id").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([v[j] for v in got], t) for j, t in enumerate((pa.float64(), pa.int32(), pa.float64()))], names=["vote", "label", "many"])

    votes = spark.range(0, len(model.docs), 1, VOTERS).mapInArrow(voted, "vote double, label int, many double").toArrow()
    model.fit(list(zip(*(c.to_pylist() for c in votes.columns), strict=True)))
    shared.destroy()
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``evidence`` (the nearest examples, their cosines and labels)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the number of terms
    kept = [c for c in docs.columns if c not in ("score", "evidence")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        terms = Terms(m.ids)
        kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.float64())]))
        for block in text_blocks(batches, text, SCORE_BLOCK):
            got = m.scores([terms.count(t) for t in strings(block.column(text))])
            told = [[{"example": d, "cosine": c, "label": y} for d, c, y in e] for _, e in got]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in kept), pa.array([s for s, _ in got], pa.float64()), pa.array(told, kind)], names=[*kept, "score", "evidence"])

    schema = StructType([docs.schema[c] for c in kept]).add("score", DoubleType())
    schema = schema.add("evidence", ArrayType(StructType().add("example", LongType()).add("cosine", DoubleType()).add("label", DoubleType())))
    return docs.select(kept).mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted, evidence`` of every row."""
    out = scored(docs.select(key, text), fit(docs, labels, key=key, text=text), key, text)
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
