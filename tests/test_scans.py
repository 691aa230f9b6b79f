"""Segmented scans against plain loops, whatever the partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import scans as S


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(k, i, rng.choice([None, None, rng.randint(1, 99)])) for k in ("a", "b") for i in range(400)]


def frame(spark, rows, parts):
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(parts)
    return df.withColumn("seg", F.floor(F.col("i") / 7))


@pytest.mark.parametrize("parts", [1, 5])
def test_carry_last(spark, rows, parts, monkeypatch):
    monkeypatch.setattr(S, "WIDTH", 4)
    out = S.carry_last(frame(spark, rows, parts), ["k"], "seg", ["i"], F.col("v"), "c").collect()
    want, last = {}, {}
    for k, i, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[k, i] = last[k]
    assert {(r.k, r.i): r.c for r in out} == want


def test_carry_many_is_carry_last(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "WIDTH", 4)
    df = frame(spark, rows, 3)
    one = S.carry_last(df, ["k"], "seg", ["i"], F.col("v"), "c").select("k", "i", "c")
    many = S.carry_many(df, ["k"], "seg", ["i"], {"c": F.col("v")}).select("k", "i", "c")
    assert one.exceptAll(many).count() == 0


def test_prefix_sum_and_previous(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "WIDTH", 4)
    df = frame(spark, rows, 3).withColumn("v", F.coalesce("v", F.lit(0)))
    out = S.prefix_sum(df, ["k"], "seg", ["i"], F.col("v"), "s")
    out = S.previous(out, ["k"], "seg", ["i"], F.col("v"), "p").collect()
    total, before = {}, {}
    want = {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
        want[k, i] = (total[k], before.get(k))
        before[k] = v or 0
    assert {(r.k, r.i): (r.s, r.p) for r in out} == want


@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of(spark, inclusive):
    rng = random.Random(3)
    left = [("a", rng.randint(0, 60), n) for n in range(40)]
    right = [("a", rng.randint(0, 60), n, n * 10) for n in range(15)]
    l = spark.createDataFrame(left, "k string, t int, id int")
    r = spark.createDataFrame(right, "k string, t int, id int, v int")
    out = S.as_of(l, r, ["k"], "t", "id", "v", "x", F.floor(F.col("t") / 9), inclusive).collect()
    for row in out:
        seen = [(t, i, v) for _, t, i, v in right if t < row.t or (inclusive and t == row.t)]
        assert (row.x.value if row.x else None) == (max(seen)[2] if seen else None)


def test_first_row(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, n int, t string")
    assert sorted((r.k, r.t) for r in S.first_row(df, ["k"], [F.col("n")]).collect()) == [("a", "y"), ("b", "z")]
