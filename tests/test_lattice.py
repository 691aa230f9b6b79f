"""Label rows with lost labels."""

from quire.operators import grids as H

ORDER = ["WS", "BS", "S", "T", "Ag", "Int", "Per", "WP", "Fel"]


def read(spark, *lines):
    rows = [(1, 0, y, [float(x) for x in xs], ts) for y, xs, ts in lines]
    out = H.lattice_rows(spark.createDataFrame(rows, "doc_id int, page int, y int, xs array<double>, texts array<string>"), ["doc_id", "page"], ORDER)
    return [(r.y, r.label, r.value, r.inferred) for r in out.orderBy("y", "i").collect()]


def test_two_lost_labels_and_one_past_the_end(spark):
    at = [20, 51, 79, 110, 141, 170, 200, 229, 260]
    values = ["31", "2O", "l5", "4", "-", "38", "3", "33", "12"]
    left = [0, 1, 3, 4, 6, 7]  # S, Int and the last are gone
    labels = (500, [at[k] for k in left], [ORDER[k].upper() for k in left])
    got = read(spark, labels, (488, [x + 1 for x in at], values))
    assert got == [(500, ORDER[k], n, k not in left) for k, n in enumerate((31, 20, 15, 4, 0, 38, 3, 33, 12))]


def test_an_odd_label_does_not_move_the_lattice(spark):
    got = read(spark, (500, [20, 50, 95, 110, 140], ORDER[:5]), (488, [20, 50, 80, 110, 140], list("12345")))
    assert [v for _, _, v, _ in got] == [1, 2, 3, 4, 5]


def test_pieces_of_a_value_and_lines_that_are_no_rows(spark):
    got = read(spark, (500, [20, 50, 80], ["WS", "BS", "S"]), (488, [17, 23, 50, 110], ["0", "5", "7", "9"]))
    assert [(r[1], r[2], r[3]) for r in got] == [("WS", 5, False), ("BS", 7, False), ("T", 9, True)]
    assert read(spark, (500, [20, 50, 80], ["BS", "WS", "T"]), (488, [20, 50, 80], list("123"))) == []
    assert read(spark, (500, [20, 50, 80], ["WS", "BS", "S"]), (488, [20, 50, 80], ["1", "a", "3"])) == []
    assert read(spark, (500, [20, 50], ["WS", "BS"])) == []


def test_labels_are_read_once(spark):
    """labels and lattices were worked out again for each pair of labels that looked at them."""
    rows = [(1, 0, 500, [20.0, 50.0, 80.0], ["WS", "BS", "S"]), (1, 0, 488, [20.0, 50.0, 80.0], ["1", "2", "3"])]
    lines = spark.createDataFrame(rows, "doc_id int, page int, y int, xs array<double>, texts array<string>")
    plan = H.lattice_rows(lines, ["doc_id", "page"], ORDER)._jdf.queryExecution().optimizedPlan().toString()
    # once to tell a row of labels, once to place them
    assert plan.count("lower(") == 2 and plan.count("PythonUDF") + plan.count("fit(") <= 2


def test_rows_without_a_lattice_and_values_out_of_reach(spark):
    assert read(spark, (500, [80, 50, 20], ["WS", "BS", "S"]), (488, [20, 50, 80], list("123"))) == []
    got = read(spark, (500, [20, 50, 80], ["WS", "BS", "S"]), (488, [5, 66, 80], list("123")))
    assert [(r[1], r[2]) for r in got] == [("S", 3)]
