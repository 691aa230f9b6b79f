"""Cuts of pages at column edges against a recursion over one page at a time."""

import random

from pyspark.sql import functions as F

from quire.operators import regions as R

SCHEMA = "doc_id int, page int, col int, ord int, x double, y double, width double, height double, text string"


def cut(runs, edges, gap, depth):
    l, r = min(q[0] for q in runs), max(q[0] + q[2] for q in runs)
    able = [e for e in edges if e - l >= 36 and r - e >= 36]
    if depth:
        for e in able:
            right = [q for q in runs if q[0] >= e - 2]
            rest = [q for q in runs if q[0] < e - 2]
            if right and rest and all(q[0] + q[2] <= e - 6 for q in rest):
                return cut(rest, edges, gap, depth - 1) + cut(right, edges, gap, depth - 1)
        for e in able:
            over = {q for q in runs if q[0] < e - 2 and q[0] + q[2] > e - 6}
            bands, floor = [], float("inf")
            for q in sorted(runs, key=lambda q: (-(q[1] + q[3]), q[4])):
                if not bands or q[1] + q[3] <= floor - gap:
                    bands.append([])
                bands[-1].append(q)
                floor = min(floor, q[1])
            hit = [k for k, b in enumerate(bands) if over & set(b)]
            if hit and (hit[0] > 0 or hit[-1] < len(bands) - 1):
                parts = [sum(bands[: hit[0]], []), sum(bands[hit[0] : hit[-1] + 1], []), sum(bands[hit[-1] + 1 :], [])]
                return [leaf for p in parts if p for leaf in cut(p, edges, gap, depth - 1)]
    return [runs]


def page(rnd, n):
    """Blocks of one, two or three columns below each other, some of them nested, with wide lines between."""
    out, y, ord_ = [], 760.0, 0
    while y > 60 and n:
        n -= 1
        starts = rnd.choice(([54.0], [54.0, 330.0], [54.0, 240.0, 420.0], [54.0, 330.0, 420.0]))
        for row in range(rnd.randrange(1, 5)):
            for col, (x, end) in enumerate(zip(starts, [*starts[1:], 570.0])):
                if rnd.random() < 0.9:
                    w = min(float(rnd.randrange(20, 280)), end - x - rnd.choice((1, 8, 8, 8)))
                    out.append((x, y, w, 10.0, ord_, col))
                    ord_ += 1
            y -= 12
        y -= rnd.choice((2, 14, 30))
    return out


def test_regions_equal_recursion(spark):
    rnd = random.Random(6)
    edges = [240.0, 330.0, 420.0]
    rows, want, most = [], {}, 0
    for p in range(150):
        own = page(rnd, rnd.randrange(1, 9))
        rows += [(p % 7, p, c, o, x, y, w, h, "t") for x, y, w, h, o, c in own]
        leaves = cut([q[:5] for q in own], edges, 10, 8)
        most = max(most, len(leaves))
        want |= {(p, q[4]): k for k, leaf in enumerate(leaves) for q in leaf}
    runs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    lists = runs.select("doc_id").distinct().withColumn("edges", F.array(*map(F.lit, edges)))
    got = {(r.page, r.ord): r.region for r in R.cut_regions(runs, lists).collect()}
    assert got == want and most > 6
    bare = R.cut_regions(runs, lists.where("doc_id > 100"))
    assert {r.region for r in bare.select("region").distinct().collect()} == {0}
    assert R.cut_regions(runs.limit(0), lists).count() == 0


def test_column_edges(spark):
    rows = [(1, p, c, k, x, 10.0 * k, 5.0, 10.0, "t") for p in range(40) for k in range(4) for c, x in ((0, 54.0), (1, 330.0 if p < 30 else 332.0), (2, 450.4 if p < 2 else 480.0)) if c < 2 or p < 5]
    rows += [(2, p, 1, 0, 300.0, 0.0, 5.0, 10.0, "t") for p in range(2)] + [(3, p, 1, 0, 300.0, 0.0, 5.0, 10.0, " ") for p in range(9)]
    got = {r.doc_id: r.edges for r in R.column_edges(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [330.0, 480.0], 2: []}


def test_passes_write_geometry_alone(spark):
    """every pass of the cuts wrote the runs with their texts and fonts."""
    import __spark_entry__ as entry

    plan = entry.queries()["b16_cut_regions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    kept = [line for line in plan.split("\n") if "LogicalRDD" in line]
    assert kept and not any("text#" in line or "font#" in line for line in kept)
