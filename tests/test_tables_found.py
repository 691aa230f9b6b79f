"""Columns found by overlap, stacked headers and sub-tables."""

from pyspark.sql import functions as F

from quire.operators import tables as T


def test_level_table_in_two_columns(spark):
    line = lambda seg, o, *cells: [(1, seg, o, k, float(x), float(r), t) for k, (x, r, t) in enumerate(cells)]
    rows = line(0, 1, (50, 70, "Intro")) + line(0, 2, (54, 60, "1st"), (90, 150, "Rage,"), (200, 210, "2")) + line(0, 3, (92, 140, "Defence"))
    rows += line(0, 4, (54, 60, "2nd"), (90, 170, "Reckless"), (202, 212, "3")) + line(1, 5, (372, 420, "Attack")) + line(1, 6, (334, 340, "3rd"), (370, 400, "Path"))
    rows += line(1, 7, (334, 340, "7th"), (380, 400, "stray")) + line(1, 8, (334, 340, "4th"), (480, 490, "9"))
    cells = spark.createDataFrame(rows, "doc int, seg int, line int, cell int, x double, right double, text string")
    heads = spark.createDataFrame([(1, 0, 50.0, 70.0, "Level"), (1, 0, 100.0, 130.0, "Features"), (1, 0, 230.0, 250.0, "Cost")], "doc int, order int, x double, right double, text string")
    got = {(r.level, r.header): r.text for r in T.level_columns(cells, heads, ["doc"], "seg", "line").collect()}
    # the stray line reaches into the level column and ends the table
    assert got == {(1, "Level"): "1st", (1, "Features"): "Rage, Defence", (1, "Cost"): "2", (2, "Level"): "2nd", (2, "Features"): "Reckless Attack", (2, "Cost"): "3", (3, "Level"): "3rd", (3, "Features"): "Path"}


def test_three_header_levels(spark):
    cells = [(0, 100, 300, "Weapons"), (1, 100, 200, "Ranged"), (1, 100, 300, "All"), (2, 101, 140, "Range"), (2, 150, 201, "RoF"), (2, 210, 290, "Cost"), (1, 310, 350, "Notes"), (2, 400, 420, "Page")]
    rows = spark.createDataFrame([("t", *c) for c in cells], "t string, level int, x int, right int, text string")
    got = [(r.col_no, r.path) for r in T.header_paths(rows, ["t"]).orderBy("col_no").collect()]
    assert got == [(0, ["Weapons", "Ranged", "Range"]), (1, ["Weapons", "Ranged", "RoF"]), (2, ["Weapons", "All", "Cost"]), (3, ["Notes"]), (4, ["Page"])]


def test_sub_tables(spark):
    kinds = "C hh rrr e n h rr e nnn h rr C h r e h rr C h rrr e h r h rr".replace(" ", "")
    lines = spark.createDataFrame([(1, i // 4, i, k) for i, k in enumerate(kinds)], "doc int, seg int, ord int, k string")
    k = F.col("k")
    out = T.sub_tables(lines, ["doc"], "seg", "ord", k == "C", k == "h", k == "e", k == "r").orderBy("ord").collect()
    assert "".join(kinds[r.ord] for r in out) == "hhrrr" + "hrr" + "hr" + "hrr" + "hrrr"
    assert [r.part for r in out] == [0] * 5 + [1] * 3 + [0] * 2 + [1] * 3 + [0] * 4
    assert {r.kind for r in out if kinds[r.ord] == "h"} == {"header"}


def test_within_header(spark):
    rows = [(1, 1, 10.0, 50.0, 10.0), (1, 1, 115.0, 30.0, 10.0), (1, 1, 155.0, 30.0, 10.0), (1, 2, 10.0, 20.0, 10.0), (1, 2, 130.0, 9.0, 10.0), (1, 2, 145.0, 9.0, 10.0)]
    runs = spark.createDataFrame([(*r, 100.0, 10.0) for r in rows], "doc int, line int, x double, width double, size double, header_right double, header_size double")
    got = sorted((r.line, r.x) for r in T.within_header(runs, ["doc"], "line").collect())
    assert got == [(1, 10.0), (1, 115.0), (1, 155.0), (2, 10.0), (2, 145.0)]
