"""Plans and views at sizes that files do not tell."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["h2_grids", "h6_diagram", "e15_grid_gaps", "f3_assign_cells"])
def test_exploded_rows_are_not_broadcast(spark, name):
    """rows made many of a small file stay out of the driver."""
    plan = entry.queries()[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_words_are_placed_in_their_line(spark, tmp_path):
    """offsets of words come from the line's row, so that no word is shuffled before the page is laid out."""
    from quire.plans.registry import Tables

    texts = ["a b  c " * 100 + "\n" + "é x " * 70, "", None, "\n\n z", "w" * 300 + " end"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    runs = Tables(spark, str(tmp_path)).runs
    want = set()
    for i, text in enumerate(texts):
        v0 = 0
        for n, line in enumerate((text if text is not None else "").split("\n")):
            at = 0
            for k, word in enumerate(line.split(" ")):
                if word:
                    v = v0 + at // 48
                    want.add((i, v // 100, v // 50 % 2, 54 + 276 * (v // 50 % 2) + 4 * (at % 48), 738 - 13 * (v % 50), n * 100000 + k, word))
                at += len(word) + 1
            v0 += len(line) // 48 + 1
    assert {tuple(r) for r in runs.select("doc_id", "page", "col", "x", "y", "ord", "text").collect()} == want
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "word_no" not in "".join(line for line in plan.split("\n") if "Window" in line or "Join" in line)


BY_DOCUMENT = """c1_drop_reprints c2_trim_repeated_lead c3_merge_overprint c4_drop_shadows c5_running_furniture e2_nearest_run e3_align e4_resolve
    e5_apply_rewrites e6_insert_lineless e8_merge_readings e11_scan_scale e13_word_weights e16_arbitration_report b7_assign_column b8_reading_order
    b14_line_cells d8_line_quality d2_vouch d7_misencoded_faces""".split()


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_words_stay_with_their_document(spark, name):
    """Lines are dealt by document once, and no word is moved after that."""
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    dealt = re.findall(r"Exchange (\w+(?:\([^)]*\))?)", plan)
    assert dealt and all(re.fullmatch(r"hashpartitioning\(doc_id#\w+, \d+\)", d) for d in dealt)


def test_lines_of_figures_are_made_once(spark):
    """lines were joined to their own edges and stretches and split in two, each time from the text layer on."""
    plan = entry.queries()["c6_drop_figures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_amounts_are_summed_in_their_row(spark):
    """amounts of rows with keys of their own went through hash tables of all rows of a task."""
    from quire.operators import sections

    plan = entry.queries()["g16_amounts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    rows = spark.createDataFrame([(1, "+2 Size, then -1 Price; +3 Size"), (1, "+4 Size. -9 Price if tired"), (2, None), (3, "+1 Other")], "k int, text string")
    for unique, want in ((False, [(1, "Price", -1), (1, "Size", 9)]), (True, [(1, "Price", -1), (1, "Size", 4), (1, "Size", 5)])):
        assert sorted(map(tuple, sections.amounts(rows, ["k"], "text", ["Size", "Price"], unique).collect())) == want


def test_prose_is_scored_in_its_row(spark):
    """words of prose were dealt out by leaf and word, and rows with equal keys got each other's words."""
    from quire.operators import score

    plan = entry.queries()["l6_leaf_agreement"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" not in plan and plan.count("Join") == 1
    eight = "a b c d e f g h"
    rows = [(1, f'"{eight}"', f'"{eight} h"'), (1, f'"{eight}"', '"x y"'), (2, f'"{eight} a a"', '"A, a a b."'), (3, f'"{eight}"', None), (4, f'"{eight}"', '"..."')]
    out = score.leaf_agreement(spark.createDataFrame(rows, "k int, want string, got string"), ["k"]).select("k", "score")
    assert sorted(map(tuple, out.collect())) == [(1, 0.0), (1, 0.941176), (2, 0.571429), (3, 0.0), (4, 0.0)]


def test_both_readings_are_counted_in_one_pass(spark):
    """the text layer was laid out once for each reading."""
    from pyspark.sql import functions as F

    from quire.operators import score
    from quire.plans.registry import Tables

    plan = entry.queries()["l3_worst_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan
    t, keys = Tables(spark, "/root/testdata/sf0.001"), ["doc_id", "page"]
    two = score.bag_score(t.ocr.select(*keys, "text"), t.runs.select(*keys, "text"), keys)
    one = score.bag_counts(t.readings, keys)
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0 < one.count()
    # words that are their own token are taken as they are, to the same end
    words = spark.createDataFrame([(w,) for w in ("Über", "a-b", "(x)", "ﬁx", "ǅ9", "", "a b", "n­")] + [(None,)], "w string")
    got = words.select("w", score.tokens(F.col("w")).alias("t"), score.tokens(F.concat("w", F.lit(" .")), True).alias("u")).where("w is not null").collect()
    assert [[v.lower() for v in r.u] for r in got] == [r.t for r in got]


def test_page_numbers_read_the_layer_once_each(spark):
    """votes and pages were made from the text layer again in every branch that read them."""
    plan = entry.queries()["g18_page_numbering"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan and "LogicalRDD" in plan


def layouts(spark, name):
    """How often the plan of a query lays words out."""
    return entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode(transform(")


@pytest.mark.parametrize("name, most", [("b5_doc_layouts", 0), ("b4_page_gutters", 1), ("b7_assign_column", 2), ("b14_line_cells", 1), ("c5_running_furniture", 1), ("e4_resolve", 1), ("e5_apply_rewrites", 2)])
def test_words_are_laid_out_once(spark, name, most):
    """Page furniture comes from lines, gutters and heads from one pass of the words."""
    assert layouts(spark, name) <= most


def test_pages_are_found_in_lines(spark, tmp_path):
    """pages of the furniture are those of the words, blanks and long words included."""
    from quire.plans.registry import Tables

    texts = ["a b  c " * 900 + "\n" + "é x " * 70, "", " ", None, "\n\n z", "w" * 9700 + " end", " " * 9600 + "z", "x" + " " * 4799 + "y", "q " * 2400]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    got = {tuple(r) for r in t.printed_pages.select("doc_id", "page", "source").collect()}
    assert got == {tuple(r) for r in t.runs.select("doc_id", "page", "source").distinct().collect()} and len(got) == 9
    assert "Generate posexplode(transform(" not in t.furniture._jdf.queryExecution().optimizedPlan().toString()


def test_runs_that_cover_nothing_bound_their_page(spark):
    """bounds and channels come from one sweep; marginal runs widen the bounds and open no channel."""
    from quire.operators.layout import page_gutters

    column = [(1, 0, x, 700 - 12 * k, 100) for x in (60, 200) for k in range(5)]
    runs = column + [(1, 0, 10, 780, 5), (1, 0, 500, 10, 40), (1, 0, 170, 400, 0)]
    got = page_gutters(spark.createDataFrame(runs, "doc_id long, page long, x long, y long, width long")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, 160, 200)]


def test_a_donor_gives_to_all_its_hosts(spark):
    """one join tells what becomes of each run; a donor that is a host goes, and null donors give nothing."""
    from quire.operators.reconcile import apply_rewrites

    runs = spark.createDataFrame([(1, 0, k, 10 * k, 8, "abcde"[k]) for k in range(5)], "doc_id long, page long, ord long, x long, width long, text string")
    edits = spark.createDataFrame([(1, 0, 0, 1, "A"), (1, 0, 2, 1, "C"), (1, 0, 2, 3, "B"), (1, 0, 3, None, "D"), (1, 0, 4, None, "E")], "doc_id long, page long, host long, donor long, text string")
    got = apply_rewrites(runs, edits).select("ord", "x", "width", "text").collect()
    assert {tuple(r) for r in got} == {(0, 0, 18, "A"), (2, 10, 28, "C"), (4, 40, 8, "E")}


def test_spaces_of_the_reading_keep_the_letters(spark):
    """letters of the layer are dealt to the pieces of the reading."""
    from quire.operators.reconcile import resolve

    rows = [("ABc", "a bc"), ("a b", "ab"), ("éx", " é  X "), ("abc", "abc")]
    got = resolve(spark.createDataFrame([(a, b, 70) for a, b in rows], "layer string, read string, confidence int")).collect()
    assert [(r["rule"], r["resolved"]) for r in got] == [("same", "A Bc"), ("same", "ab"), ("same", " é  x "), ("same", "abc")]


def test_readings_are_aligned_from_one_pass(spark):
    """lines of equal and of other readings were each made from the text layer on, and every group was measured."""
    assert layouts(spark, "e3_align") <= 3
    plan = entry.queries()["e3_align"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "levenshtein" not in plan


def test_groups_of_lines_by_hand(spark):
    """groups found in batches are those of the rule, whatever the letters; missing texts end a line's groups."""
    import random
    from decimal import Decimal

    from quire.operators.reconcile import _groups

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    rng = random.Random(7)
    some = lambda: ["".join(rng.choice("abcé\U0001f600") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 7))]
    lines = [(k, some(), some()) for k in range(200)] + [(200, None, None), (201, ["a", None, "b"], ["b", "a"]), (202, ["ab" * 200], ["ab" * 199 + "a"]), (203, [], ["a"])]
    found = spark.createDataFrame(lines, "k int, t array<string>, w array<string>").select("k", _groups(3, 0.34)("t", "w").alias("s")).collect()
    for (k, t, w), got in zip(lines, sorted(found), strict=True):
        t, w = ([] if v is None else v[: v.index(None)] if None in v else v for v in (t, w))
        want = []
        for i in range(len(t)):
            for j in range(len(w)):
                for a, b in [(n, 1) for n in range(1, 4)] + [(1, 2), (1, 3)]:
                    one, two = "".join(t[i : i + a]), "".join(w[j : j + b])
                    least, most = sorted((len(one), len(two)))
                    if i + a <= len(t) and j + b <= len(w) and most and least >= Decimal("0.66") * most and (far := edits(one, two) / most) <= 0.34:
                        want.append((i + a, j + b, i, a, j, b, far))
        assert [tuple(s) for s in got.s] == sorted(want), k


def test_words_are_not_joined_to_their_line(spark):
    """Words met lines by a sort of their bands, and were joined to what they found by another."""
    plan = entry.queries()["e2_nearest_run"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 1


def test_tall_words_ask_every_band(spark):
    """A word of many bands, one below all lines, one upside down, and one ord that two words have."""
    from quire.operators.reconcile import assign_words

    boxes = spark.createDataFrame([(1, 0, 0, k, 10, 90, 700 - 13 * k, 710 - 13 * k, 10) for k in range(30)], "doc_id long, page long, col long, line long, lx0 long, lx1 long, ly0 long, ly1 long, lsize long")
    words = [(1, 0, 1, 20, 30, 400, 503), (1, 0, 2, 20, 30, 700, 710), (1, 0, 3, 20, 30, 10, 30), (1, 0, 4, 20, 30, 710, 700), (1, 0, 5, 200, 210, 700, 710), (1, 0, 6, 20, 30, 700, 706), (1, 0, 6, 25, 35, 687, 697), (None, 0, 7, 20, 30, 700, 710), (1, 0, 8, 20, 30, None, 710)]
    matched, lineless = assign_words(boxes, spark.createDataFrame(words, "doc_id long, page long, ord long, x0 long, x1 long, y0 long, y1 long"))
    assert sorted((r.ord, r.y0, r.line) for r in matched.collect()) == [(1, 400, 16), (2, 700, 0), (6, 687, 1), (6, 700, 1)]
    assert sorted(r.ord for r in lineless.collect()) == [3, 4, 5, 7, 8]


@pytest.mark.parametrize("name, most", [("g1_headings", 2), ("d9_doc_title", 0), ("c4_drop_shadows", 1)])
def test_lines_are_made_once(spark, name, most):
    """lines were made again for fonts, faces, covers and printed words, copies again for what is kept of them."""
    assert layouts(spark, name) <= most


def test_copies_of_a_text_fold_left_to_right(spark):
    """copies of one text on one line meet in one row; blank runs stay, runs without a text go."""
    from quire.operators.dedup import drop_shadows

    runs = [(1, 0, 0, 0, 10, 20, 5, "a"), (1, 0, 0, 0, 10, 20, 3, " a"), (1, 0, 0, 0, 15, 20, 4, "a"), (1, 0, 0, 0, 25, 20, 6, "a"), (1, 0, 0, 0, 26, 20, 7, "b"),
            (1, 0, 0, 0, 10, 5, 8, " "), (1, 0, 0, 0, 10, 5, 9, ""), (1, 0, 0, 0, 10, 5, 10, None), (1, 0, 0, 1, 10, 20, 11, "a"), (None, 0, 0, 0, 10, 20, 12, "c")]
    df = spark.createDataFrame(runs, "doc_id long, page long, col long, line long, x long, width long, ord long, text string")
    got = drop_shadows(df)
    assert got.columns == df.columns and sorted(r.ord for r in got.where("doc_id is not null").collect()) == [3, 6, 7, 8, 9, 11]
