"""Several readings of a page, groups of tokens and charts, by hand."""

from pyspark.sql import functions as F

from quire.operators import editions as E
from quire.operators import entities as N
from quire.operators import reconcile as R


def test_resolve_points_and_full_words(spark):
    bad = "�"
    rows = [(f"{bad}75kg", "75kg", 90), (f"2{bad}5kg", "25kg", 90), (f"1{bad}500", "1500", 90), (f"2{bad}5kg", "2.5kg", 90), (f"Ab{bad}c", "Abc", 90), (f"{bad}5 kg", "5 kg", 90),
            ("Full 18kg", "Full18kg", 90), ("T here", "There", 90), (f"{bad}75kg", "75kg", 20), (f"1{bad}5000", "15000", 90), ("saMPle", "SAMPLE", 90)]
    groups = spark.createDataFrame(rows, "layer string, read string, confidence int")
    got = [r.resolved for r in R.resolve(groups).collect()]
    assert got == [".75kg", "2.5kg", "1,500", "2.5kg", "Abc", "5 kg", "Full 18kg", "There", f"{bad}75kg", "1.5000", "SAMPLE"]


def test_merge_readings(spark):
    word = lambda p, o, x, sure, y=0.0: (1, 0, p, o, float(x), y, float(x) + 30, y + 10, sure, f"w{p}{o}")
    rows = [word(0, 1, 0, 30), word(0, 2, 200, 90), word(0, 3, 400, 30, 50.0)]
    rows += [word(1, 1, 2, 80), word(1, 2, 205, 99), word(1, 3, 245, 95), word(1, 4, 300, 95), word(1, 5, 600, 40)]  # weak under; sure under; beside; apart; unsure
    rows += [word(2, 1, 4, 95), word(2, 2, 402, 70, 51.0), word(2, 3, 330, 90)]
    words = spark.createDataFrame(rows, "doc_id int, page int, pass int, ord int, x0 double, y0 double, x1 double, y1 double, confidence int, text string")
    assert sorted(r.text for r in R.merge_readings(words, 3).collect()) == ["w02", "w11", "w14", "w22", "w23"]
    assert R.merge_readings(words.limit(0), 3).count() == 0


def test_rank_charts_and_branches(spark):
    box = lambda o, x, y, xp, *titles: [(1, 0, o, float(x), float(y), 100.0, 9.0, "T", xp)] + [(1, 0, o + k, float(x) + 10, y + 12.0 * k, 40.0, 10.0, "H", t) for k, t in enumerate(titles, 1)]
    rows = box(0, 200, 700, "XP: 0-999", "Initiate") + box(10, 100, 500, "XP Level: 1,000–1,999", "Preceptor-S avant") + box(20, 300, 500, "Level: 1,000-1,999", "Sage XP", "High")
    rows += box(30, 120, 300, "XP 2000+", "Master") + [(1, 0, 90, 110.0, 560.0, 40.0, 10.0, "H", "too far"), (2, 0, 1, 0.0, 0.0, 9.0, 9.0, "T", "XP: 5+")]
    runs = spark.createDataFrame(rows, "doc_id int, page int, ord int, x double, y double, width double, size double, font string, text string")
    boxes = N.rank_charts(runs)
    assert sorted((r.title, r.min_xp, r.x, r.level) for r in boxes.collect()) == [("High Sage", 1000, 350.0, 2), ("Initiate", 0, 250.0, 1), ("Master", 2000, 170.0, 3), ("Preceptor-Savant", 1000, 150.0, 2)]
    paths = N.branch_paths(boxes.select(F.col("doc_id").alias("owner"), "level", F.col("title").alias("box"), "x"))
    assert {r.box: r.path for r in paths.collect()}["Master"] == "Initiate > Preceptor-Savant > Master"


def test_module_identity(spark):
    docs = spark.createDataFrame([("m", "p", "1"), ("m", "p", "2"), ("n", "p", "1"), ("n", "p", "2"), ("o", "p", "1"), ("m", "p", "1")], "module string, pack string, id string")
    assets = spark.createDataFrame([("m", "a"), ("n", "b")], "module string, name string")
    ids = {r.module: r.module_id for r in E.module_identity(docs.repartition(3), assets).collect()}
    again = {r.module: r.module_id for r in E.module_identity(docs.orderBy(F.desc("id")), assets).collect()}
    assert ids == again and len({*ids.values()}) == 3
    assert {r.module: r.module_id for r in E.module_identity(docs, assets.limit(0)).collect()}["m"] == {r.module: r.module_id for r in E.module_identity(docs, assets.limit(0)).collect()}["n"]


def test_scan_words_and_upright_inserts(spark):
    rows = [(1, 0, 1, "word", 0.0, 0.0, 30.0, 10.0, 50, 7, 1.0, 11.0), (1, 0, 2, "Tab", 0.0, 0.0, 5.0, 30.0, 90, 7, 1.0, 11.0), (1, 0, 3, "|]", 0.0, 0.0, 5.0, 9.0, 99, 7, 1.0, 11.0),
            (1, 0, 4, "41", 0.0, 0.0, 5.0, 10.0, 90, 7, -4.0, 11.0), (1, 0, 5, "-", 0.0, 0.0, 5.0, 5.0, 80, 7, 1.0, 11.0), (1, 0, 6, "cell", 0.0, 20.0, 30.0, 30.0, 60, 7, 28.0, 11.0)]
    schema = "doc_id int, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, confidence int, line int, baseline double, line_height double"
    words = spark.createDataFrame(rows, schema)
    got = sorted((r.text, r.line, r.baseline, r.line_height) for r in R.scan_words(words).collect())
    assert got == [("41", 10_000_004, 0.0, 10.0), ("cell", 10_000_006, 20.0, 10.0), ("word", 7, 1.0, 11.0)]
    runs = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, "a", 8)], "doc_id int, page int, x double, y double, width double, text string, ord int")
    out = R.insert_lineless(runs, words.withColumn("confidence", F.lit(90)))
    assert sorted((r.text, r.inserted) for r in out.collect()) == [("a", False), ("cell", True), ("word", True)]


def test_passes_of_a_page_are_one_row(spark):
    """words of each pass were joined on squares to all placed before; now a page is taken as one, whole and in any company."""
    import random

    import __spark_entry__ as entry
    from quire.operators import reconcile as R

    rng = random.Random(3)
    rows = []
    for k in range(900):
        x, y = rng.choice([None, -50, 0]) if k % 97 == 0 else rng.randint(-60, 300), rng.randint(-60, 200)
        rows.append((rng.choice([1, 1, 2, None]), rng.randint(0, 1), rng.randint(0, 3), k, x, y, x and x + rng.randint(0, 60), y + rng.randint(0, 30), rng.randint(40, 90), f"w{k}"))
    words = spark.createDataFrame(rows, "doc_id long, page long, pass int, ord long, x0 long, y0 long, x1 long, y1 long, confidence int, text string")

    def over(a, b):
        return None not in (a[4], b[4]) and a[4] < b[6] and b[4] < a[6] and a[5] < b[7] and b[5] < a[7]

    def beside(a, b):
        if None in (a[4], b[4]) or over(a, b):
            return False
        return min(a[7], b[7]) - max(a[5], b[5]) >= 0.5 * min(a[7] - a[5], b[7] - b[5]) and max(b[4] - a[6], a[4] - b[6]) <= 2 * (b[7] - b[5])

    for full in (False, True):
        placed = first = [r for r in rows if r[2] == 0]
        for p in (1, 2, 3):
            near = lambda a, b: a[0] is not None and a[:2] == b[:2]
            new = [a for a in rows if a[2] == p and a[8] >= 60 and not any(near(a, b) and b[8] >= 60 and over(a, b) for b in placed)]
            if full:
                new = [a for a in new if not any(near(a, b) and beside(a, b) for b in first)]
                placed = [b for b in placed if not any(near(a, b) and over(a, b) for a in new)]
            placed = placed + new
        got = R.merge_readings(words, 4) if full else R.merge_passes(words)
        assert sorted(r.text for r in got.collect()) == sorted(r[9] for r in placed) and got.columns == words.columns
    for name in ("e8_merge_passes", "e8_merge_readings"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and "Join" not in plan
