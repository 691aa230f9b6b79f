"""Section paths by size against a stack that is kept by hand."""

import random

from pyspark.sql import functions as F

from quire.operators import sections as X


def by_hand(rows, step=0.4, least=4):
    """rows: (n, size or None, text, until). Returns the path of each."""
    stack, out, run, before, chars = [], {}, 0, None, 0
    for n, size, text, until in rows:
        if size is None:
            chars += len(text.strip())
            out[n] = [e[1] for e in stack if e[2] is None or n < e[2]]
            continue
        run = run + 1 if before is not None and abs(before - size) < step and chars <= 2 else 0
        while stack and (stack[-1][0] <= size + step or stack[-1][3]):
            stack.pop()
        out[n] = [e[1] for e in stack if e[2] is None or n < e[2]]
        stack.append((size, text, until, run >= least - 1))
        before, chars = size, 0
    return out


def test_size_path_equals_a_stack(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for doc in range(12):
        own, n = [], 0
        for _ in range(rnd.choice((0, 5, 400))):
            if rnd.random() < 0.15:  # a contents list
                size = rnd.choice((9.0, 12.0))
                heads = [size + rnd.choice((0, 0.2)) for _ in range(rnd.randrange(2, 9))]
            else:
                heads = [rnd.choice((9.0, 9.3, 9.6, 12.0, 12.25, 15.5, 20.0, 31.0))]
            for size in heads:
                own.append((n, size, f"h{n}", rnd.choice((None, None, None, n + rnd.randrange(1, 9)))))
                n += 1
            for _ in range(rnd.randrange(0, 4)):
                own.append((n, None, rnd.choice(("", " ", "x", "some text")), None))
                n += 1
        want |= {(doc, k): v for k, v in by_hand(own).items()}
        rows += [(doc, k // 5, *r) for k, r in enumerate(own)]
    assert len(want) > 2000
    blocks = spark.createDataFrame(rows, "doc int, seg long, n int, size double, text string, until int").repartition(5)
    listed = X.contents_lists(blocks, ["doc"], "seg", "n", F.col("size"), "text")
    got = X.size_path(listed, ["doc"], "seg", "n", F.col("size"), "text", F.col("listed"), F.col("until"))
    assert {(r.doc, r.n): r.path for r in got.collect()} == want
    assert X.size_path(listed.limit(0), ["doc"], "seg", "n", F.col("size"), "text", F.col("listed")).count() == 0
