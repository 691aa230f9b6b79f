"""Readers over folders, and operators with two outputs."""

import json


from quire.operators import dedup as D
from quire.operators import score as S
from quire.sources import corpus as C
from quire.sources import packs as P


def test_read_corpus_leaves_other_versions_out(spark, tmp_path):
    for kind in ("runs", "pages", "ocr", "placements"):
        spark.createDataFrame([(1, 3), (2, 4)], "doc_id int, ir_version int").write.partitionBy("ir_version").parquet(str(tmp_path / kind))
    tables = C.read_corpus(spark, str(tmp_path), 4)
    assert {k: [tuple(r) for r in df.collect()] for k, df in tables.items()} == dict.fromkeys(("runs", "pages", "ocr", "placements"), [(2,)])


def test_read_packs(spark, tmp_path):
    for module in ("m1", "m2"):
        (tmp_path / module / "packs").mkdir(parents=True)
        packs = [{"name": "a", "type": "Item", "path": "packs/a"}, {"name": "gone", "type": "Item", "path": "packs/gone"}]
        (tmp_path / module / "module.json").write_text(json.dumps({"id": module, "packs": packs}, indent=1))
        (tmp_path / module / "packs" / "a.db").write_text('{"n":1}\n{"n":2}\n')
        (tmp_path / module / "packs" / "unnamed.db").write_text('{"n":3}\n')
    got = sorted(tuple(r) for r in P.read_packs(spark, str(tmp_path)).collect())
    assert got == [(m, "a", "Item", f'{{"n":{n}}}') for m in ("m1", "m2") for n in (1, 2)]


def test_module_manifest(spark):
    packs = spark.createDataFrame([("m", "dh2", "dh2-book-big-guns", "Item", None), ("m", "dh2", "other-tables", "RollTable", '{"x":1}')], "module string, line string, pack string, type string, flags string")
    books = spark.createDataFrame([("m", "B"), ("m", "A"), ("m", "B")], "module string, source string")
    row = P.module_manifest(packs, books, "1.2").first()
    assert [(p.label, p.path, p.flags.release, p.flags.system) for p in row.packs] == [("Book Big Guns", "packs/dh2-book-big-guns", "1.2", None), ("Other Tables", "packs/other-tables", "1.2", '{"x":1}')]
    assert row.title == "A, B" and row.folder.packs == ["dh2-book-big-guns", "other-tables"]


def test_drop_reprints_gives_kept_runs_and_copies(spark):
    run = lambda o, x, w, t: (1, 0, 10.0, x, w, 10.0, "F", "normal", t, o)
    rows = [run(1, 10.0, 50.0, "Table"), run(2, 10.0, 50.0, "Table"), run(3, 12.0, 30.0, "T bl"), run(4, 100.0, 20.0, "x")]
    runs = spark.createDataFrame(rows, "doc_id int, page int, y double, x double, width double, size double, font string, weight string, text string, ord int")
    kept, copies = D.drop_reprints(runs)
    assert sorted(r.ord for r in kept.collect()) == [1, 4] and [r.ord for r in copies.collect()] == [2]


def test_edge_heads_and_losses(spark):
    pages = spark.createDataFrame([(1, p, ["Combat", str(p)] + ["Rare"] * (p == 0)) for p in range(3)], "doc_id int, page int, edge_text array<string>")
    assert sorted((r.page, r.text) for r in D.edge_heads(pages).collect()) == [(p, "Combat") for p in range(3)]
    scores = spark.createDataFrame([("a", 10.0, 9.0), ("b", 10.0, 2.0), ("c", 3.0, 3.0)], "type string, checks double, score double")
    assert [r.type for r in S.biggest_losses(scores, ["type"], 2).collect()] == ["b", "a"]
