"""JSON documents to leaves and back."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions.jsonleaf import leaf_array, nest, nested
from quire.operators import editions as E

DOCS = [
    {"a": "}}}}", "b": {"c": {"d": {"e": 1}}}},
    {"a.b": 1, "a": {"b": 2, "c\\": {"x.y\\": [1, {"k": 2}], "": None}}},
    {"t": 'say "{" \\', "u": {}, "v": {"w": [], "é": 1.5, "ü\"q": True}},
    {"k" + str(n): {"n": n, "deep": {"er": {"est": "x" * n}}} for n in range(20)},
    {}, {"x": {"y": {}, "": 1}},
]


def deep(n):
    return {"s": "{{", "z": 1} if n == 0 else {f"k{n}": deep(n - 1), "{": n}


@pytest.fixture(scope="module")
def rows(spark):
    docs = [*DOCS, deep(12)]
    frame = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "id int, j string")
    leaves = frame.selectExpr("id", "parse_json(j) as doc").select("id", leaf_array("doc").alias("l"))
    return docs, leaves.cache()


def flat(doc, at=()):
    if isinstance(doc, dict) and doc:
        return [x for k, v in doc.items() for x in flat(v, (*at, k))]
    return [(".".join(k.replace("\\", "\\\\").replace(".", "\\.") for k in at), doc)]


def test_leaves_by_hand(rows):
    docs, leaves = rows
    for r in leaves.collect():
        assert {x.path: json.loads(x.value) for x in r.l} == dict(flat(docs[r.id]))


def test_round_trip(rows):
    docs, leaves = rows
    for r in leaves.select("id", nested(F.col("l")).alias("d"), nest(F.col("l.path"), F.col("l.value")).alias("e")).collect():
        assert json.loads(r.d) == docs[r.id]
        assert r.d == json.dumps(docs[r.id], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if docs[r.id]:
            assert json.loads(r.e) == docs[r.id]


def test_nested_of_odd_leaves(spark):
    build = lambda *l: spark.createDataFrame([([*l],)], "l array<struct<path: string, value: string>>").select(nested(F.col("l"))).first()[0]
    assert build() == "{}" and build(("", "5")) == "5"
    assert build(("a", "1"), ("a.b", "2"), ("a", "3")) == '{"a":{"b":2}}'
    assert build(("b", "2"), ("a", "1"), ("b", "3")) == '{"a":1,"b":2}'


def test_merge_leaves(spark):
    rows = [("k", "e1", "n", "1"), ("k", "e2", "n", "1"), ("k", "e1", "m", '"a"'), ("k", "e2", "m", '"b"'), ("k", "e1", "l", '["y","x"]'), ("k", "e2", "l", '["z","x"]'), ("k", "e2", "only", "true")]
    got = {r.path: r.value for r in E.merge_leaves(spark.createDataFrame(rows, "k string, edition string, path string, value string"), ["k"]).collect()}
    assert got == {"n": "1", "m": '{"e1":"a","e2":"b"}', "l": '["x","y","z"]', "only": '{"e2":true}'}
