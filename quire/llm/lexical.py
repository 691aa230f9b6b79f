"""Ranked lexical search with a tree of the documents' restricted term vectors (operator 12).

1. Statistics over all documents: N, the number of terms, and for the terms of the items the documents that hold them. Each
   task sends one row a term.
2. Each task cuts its documents down to the items' terms, orders each vector by how many documents hold the term, and
   makes a tree of a block of them: documents that begin with the same terms share the path. Every node keeps, for each
   term below it, the greatest tf, and the least m; both only raise a score, so they bound every document below.
3. Each item goes through the tree depth first, the child with the greatest bound first, and leaves out what is bounded
   below its twentieth score so far, which goes on from block to block. Documents are scored only in leaves that are reached.
4. The tasks' best rows are ranked in two steps (salted parts of an item, then the item), so no task sees all of an item.

``RAREST_FIRST``: the rarest terms lead a path. Documents that share a rare term of an item then lie together, and all of the rest is
bounded by its frequent terms at once; with the commonest first, leaves hold unlike rare terms and bounds say nothing.

Items are taken in blocks of ``ITEMS`` (broadcast: that many texts), each against all documents. Null or empty items
have no terms and no rows; items with one id are ranked apart and then numbered together, ties to the smaller document.
Null texts and texts without terms count in nothing. Rows that repeat a document are ranked each. Rows with a null id take
no part, in the statistics neither. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quire.llm.blocks import text_blocks
from quire.llm.words import MARKS, WORD_BLOCK, Words

TOP = 20
#: Items of a block, documents of a leaf, bytes of texts of one tree.
ITEMS, LEAF, TREE_BYTES = 5000, 24, 64 << 20
RAREST_FIRST = True
UNIT = 1_000_000_000


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The value of each term and the n + 1 places where each text's terms begin."""
    words = Words(texts, MARKS)
    return words.values(fold=True), words.begins


def item_terms(items: list[Row], key: str, text: str) -> list[tuple[int, Counter]]:
    out = []
    for row in items:
        values, _ = terms(pa.array([row[text]], pa.string()))
        out.append((row[key], Counter(values.tolist())))
    return out


def statistics(df: DataFrame, known: np.ndarray, key: str, text: str) -> tuple[int, int, dict[int, int]]:
    """N, the number of all terms, and the number of documents for each of the known terms (sorted)."""
    spark = df.sparkSession
    asked = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, many = np.zeros(len(asked.value), np.int64), 0, 0
        for block in text_blocks(batches, text, WORD_BLOCK):
            found, begins = terms(block.column(text))
            sizes = np.diff(begins)
            held += int((sizes > 0).sum())
            many += len(found)
            place, of, _ = restricted(found, begins, asked.value)
            own += np.bincount(place, minlength=len(own))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(own[at], [held, many]))], names=["term", "n"])

    rows = df.where(F.col(key).isNotNull()).select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    sums = {r.term: r.n for r in rows.collect()}  # a row a term of the items
    return sums.get(-1, 0), sums.get(-2, 0), {k: v for k, v in sums.items() if k >= 0}


def restricted(found: np.ndarray, begins: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``term, text, tf`` for each known term of each text, by text and term."""
    if not len(known) or not len(found):
        return (np.zeros(0, np.int64),) * 3
    place = np.searchsorted(known, found)
    place[place == len(known)] = 0
    there = known[place] == found
    owners = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[there]
    both, tf = np.unique(owners * len(known) + place[there], return_counts=True)
    return both % len(known), both // len(known), tf


class Tree:
    """A tree over restricted vectors: ``rank`` (term, in path order), ``text`` and ``tf``, by text and rank; ``m`` of each text.

    Node arrays: documents ``lo`` to ``hi`` in path order, children ``kids``, and for the terms below it the greatest
    contribution (of the greatest tf with the least m).
    """

    def __init__(self, rank: np.ndarray, text: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf: int = LEAF):
        sizes = np.bincount(text, minlength=len(m))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        paths = [rank[a:b].astype(">i4").tobytes() for a, b in zip(begin, begin[1:])]
        self.order = np.array(sorted((k for k in range(len(m)) if sizes[k]), key=paths.__getitem__), np.int64)
        self.m = m[self.order]
        self.sizes = sizes[self.order]
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        at = np.repeat(begin[self.order] - self.begin[:-1], self.sizes) + np.arange(self.begin[-1])
        self.rank, self.tf = rank[at], tf[at]
        self.gain = UNIT * self.tf // (1000 * self.tf + 12 * np.repeat(self.m, self.sizes))
        self.lo, self.hi, self.kids, self.below, self.bound = [], [], [], [], []
        if len(self.order):
            self._grow(leaf)

    def _grow(self, leaf: int) -> None:
        stack = [(0, len(self.order), 0, -1)]
        while stack:
            lo, hi, depth, parent = stack.pop()
            node = len(self.lo)
            if parent >= 0:
                self.kids[parent].append(node)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([])
            entries = slice(self.begin[lo], self.begin[hi])
            ranks, tf = self.rank[entries], self.tf[entries]
            order = np.argsort(ranks, kind="stable")
            here = np.flatnonzero(np.append(True, ranks[order][1:] != ranks[order][:-1]))
            most = np.maximum.reduceat(tf[order], here)
            self.below.append(ranks[order][here])
            self.bound.append(UNIT * most // (1000 * most + 12 * int(self.m[lo:hi].min())))
            if hi - lo <= leaf:
                continue
            while True:  # the next term of the path at which these documents part
                ended = self.sizes[lo:hi] <= depth
                branch = np.where(ended, -1, self.rank[np.minimum(self.begin[lo:hi] + depth, len(self.rank) - 1)])
                edges = np.flatnonzero(branch[1:] != branch[:-1]) + 1
                if len(edges) or ended.all():
                    break
                depth += 1
            if not len(edges):  # equal vectors
                continue
            # neighbouring branches of few documents are one child, so that leaves are not too small
            cuts, last = [], 0
            for edge in [*edges.tolist(), hi - lo]:
                if edge - last >= leaf or edge == hi - lo:
                    cuts.append((last, edge))
                    last = edge
            if len(cuts) == 1 and len(edges):
                cuts = [(0, int(edges[0])), (int(edges[0]), hi - lo)]
            for a, b in cuts:
                alike = a + 1 == b or bool((branch[a:b] == branch[a]).all())
                stack.append((lo + a, lo + b, depth + alike, node))

    def search(self, weight: np.ndarray, score_of_last: int, top: int = TOP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts and scores of all leaves that can hold a score of at least the ``top``-th so far; ``weight`` by rank."""
        if not self.lo:
            return
        best = np.zeros(0, np.int64)
        floor = max(score_of_last, 1)
        stack = [(int(weight[self.below[0]] @ self.bound[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if bound < floor:
                continue
            if self.kids[node]:
                kids = [(int(weight[self.below[k]] @ self.bound[k]), k) for k in self.kids[node]]
                stack += sorted(k for k in kids if k[0] >= floor)  # the greatest bound is taken first
                continue
            lo, hi = self.lo[node], self.hi[node]
            part = slice(self.begin[lo], self.begin[hi])
            sums = np.concatenate([[0], np.cumsum(weight[self.rank[part]] * self.gain[part])])
            edges = self.begin[lo : hi + 1] - self.begin[lo]
            scores = sums[edges[1:]] - sums[edges[:-1]]
            good = scores >= floor
            if good.any():
                yield self.order[lo:hi][good], scores[good]
                best = np.sort(np.concatenate([best, scores[good]]))[-top:]
                if len(best) == top:
                    floor = max(floor, int(best[0]))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, key, score``: each item's ``top`` best documents."""
    blocks = max(1, -(-items.count() // ITEMS))
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == k)
        asked = item_terms(own.select(item, item_text).collect(), item, item_text)  # about ITEMS texts
        parts.append(found(docs, asked, top, key, text, items.schema[item].dataType))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = [F.desc("score"), F.asc("doc")]
    some = rows.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = some.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("place") <= top)
    return best.select(F.col("item").alias(item), F.col("place").alias("rank"), F.col("doc").alias(key), "score")


def found(docs: DataFrame, asked: list[tuple[int, Counter]], top: int, key: str, text: str, kind: DataType) -> DataFrame:
    """Every task's best documents of each item, salted by task."""
    context = docs.sparkSession.sparkContext
    known = np.array(sorted({t for _, c in asked for t in c}), np.uint64)
    n, total, df = statistics(docs, known, key, text)
    held = np.array([df.get(k, 0) for k in range(len(known))], np.int64)
    worth = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)
    path = np.lexsort((known, held if RAREST_FIRST else -held))  # terms in path order
    rank_of = np.empty(len(known), np.int64)
    rank_of[path] = np.arange(len(known))
    place = {t: k for k, t in enumerate(known.tolist())}
    sparse = [(i, [(int(rank_of[place[t]]), many * int(worth[place[t]])) for t, many in c.items()]) for i, c in asked if c]
    shared, arrow_kind = context.broadcast((known, rank_of, sparse)), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank_of, items = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in trees(batches, key, text, known):
            ids, place, of, tf, sizes = whole
            m = 75 + (25 * sizes * n) // total
            rank = rank_of[place]
            order = np.lexsort((rank, of))
            tree = Tree(rank[order], of[order], tf[order], m)
            weight = np.zeros(len(known), np.int64)
            for k, (_, pairs) in enumerate(items):
                at, w = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
                weight[at] = w
                docs_so_far, scores_so_far = best.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                got = list(tree.search(weight, int(scores_so_far[-1]) if len(scores_so_far) == top else 0, top))
                weight[at] = 0
                if got:
                    docs_now = np.concatenate([docs_so_far, *(ids[t] for t, _ in got)])
                    scores_now = np.concatenate([scores_so_far, *(s for _, s in got)])
                    first = np.lexsort((docs_now, -scores_now))[:top]
                    best[k] = docs_now[first], scores_now[first]
        for k in range(0, len(items), 256):
            some = [(items[j][0], *best[j]) for j in range(k, min(k + 256, len(items))) if j in best]
            if some:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, d, _ in some for _ in range(len(d))], arrow_kind), pa.array(np.concatenate([d for _, d, _ in some])), pa.array(np.concatenate([s for *_, s in some]))],
                    names=["item", "doc", "score"],
                )

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"item {kind.simpleString()}, doc long, score long")
    return rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))


def trees(batches: Iterator[pa.RecordBatch], key: str, text: str, known: np.ndarray) -> Iterator[tuple]:
    """Restricted vectors of about ``TREE_BYTES`` of texts: ids, then term, text and tf of each entry, then the texts' numbers of terms."""
    held, size, base = [], 0, 0
    for block in text_blocks(batches, text, WORD_BLOCK):
        values, begins = terms(block.column(text))
        place, of, tf = restricted(values, begins, known)
        held.append((block.column(key).to_numpy(zero_copy_only=False).astype(np.int64), place, of + base, tf, np.diff(begins)))
        base += len(begins) - 1
        size += block.column(text).nbytes
        if size >= TREE_BYTES:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, size, base = [], 0, 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def oracle_sql(top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda column: rf"unnest(regexp_extract_all(translate({column}, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return rf"""
WITH d AS (SELECT doc_id, {words('text')} AS t FROM documents),
q AS (SELECT item_id, t, count(*) AS many FROM (SELECT item_id, {words('text')} AS t FROM benchmark) GROUP BY item_id, t),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM size),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t),
m AS (SELECT doc_id, 75 + (25 * n * nn) // l AS m FROM size, total),
s AS (SELECT item_id, doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {top}"""
