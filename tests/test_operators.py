"""Operators on small hand-made frames, and against brute force where SQL is no help."""

import itertools
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.functions.geometry import quantise
from quire.functions.jsonleaf import leaf_array
from quire.functions.keys import name_key
from quire.functions.text import canonical_text
from quire.operators import entities as N, grids as H, layout as L, reconcile as R, regions as G, score as S, sections as X, sync as Y, tables as T
from quire.sources import packs as P


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [("ﬁre  ﬂow", "fire flow"), ("a­b — c", "ab - c"), ("été ", "été"), (" x y", "x y")])
def test_canonical_text(spark, raw, want):
    assert one(spark, canonical_text(F.lit(raw))) == want


@pytest.mark.parametrize("value, step, want", [(0.35, 0.1, 0.3), (0.25, 0.1, 0.2), (10.125, 0.25, 10.0), (10.375, 0.25, 10.5)])
def test_quantise_ties_to_even(spark, value, step, want):
    assert one(spark, quantise(F.lit(value), step)) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1] + row
        for j, y in enumerate(b):
            row[j + 1] = min(row[j + 1] + (x != y), row[j] + 1, row[j + 2] + 1)
        row.pop()
    return row[-1]


def cost_of(tokens, words, groups, distance):
    used_t = sum(len(a) for a, _ in groups)
    used_w = sum(len(b) for _, b in groups)
    return len(tokens) - used_t + len(words) - used_w + sum(distance(a, b) for a, b in groups)


def brute(tokens, words, limit):
    def distance(a, b):
        left, right = "".join(tokens[i] for i in a), "".join(words[j] for j in b)
        return edits(left, right) / max(len(left), len(right))

    best = {}

    def go(i, j):
        if (i, j) in best:
            return best[i, j]
        if i == len(tokens) or j == len(words):
            best[i, j] = len(tokens) - i + len(words) - j
            return best[i, j]
        options = [1 + go(i + 1, j), 1 + go(i, j + 1)]
        for a in range(1, len(tokens) - i + 1):
            for b in range(1, len(words) - j + 1):
                if a == 1 or b == 1:
                    d = distance(range(i, i + a), range(j, j + b))
                    if d <= limit:
                        options.append(d + go(i + a, j + b))
        best[i, j] = min(options)
        return best[i, j]

    return go(0, 0), distance


def test_edits():
    assert [edits(*p) for p in (("", "abc"), ("kitten", "sitting"), ("abc", "abc"), ("ab", "ba"))] == [3, 3, 0, 2]


def test_align_is_cheapest(spark):
    rng = random.Random(5)
    line = "doc_id long, page long, col long, line long, x long, ord long, text string"
    some = lambda: ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
    cases = [(some(), some()) for _ in range(60)]
    frame = lambda k: spark.createDataFrame([(n, 0, 0, 0, i, i, t) for n, case in enumerate(cases) for i, t in enumerate(case[k])], line)
    got = {}
    for r in R.align(frame(0), frame(1)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for n, (tokens, words) in enumerate(cases):
        want, distance = brute(tokens, words, 0.34)
        at, groups = 0, []
        for r in sorted(got.get(n, []), key=lambda r: r.token_no):
            read = r.read.split(" ")
            at = next(j for j in range(at, len(words)) if words[j : j + len(read)] == read)
            groups.append((range(r.token_no, r.token_no + r.n_tokens), range(at, at + len(read))))
            at += len(read)
        assert abs(cost_of(tokens, words, groups, distance) - want) < 1e-9


def test_align_joins_split_words(spark):
    line = "doc_id long, page long, col long, line long, x long, ord long, text string"
    tokens = spark.createDataFrame([(1, 0, 0, 1, 10, 0, "Lan"), (1, 0, 0, 1, 20, 1, "tern"), (1, 0, 0, 1, 40, 2, "oil")], line)
    words = spark.createDataFrame([(1, 0, 0, 1, 9, 0, "Lantern"), (1, 0, 0, 1, 41, 1, "oil")], line)
    got = sorted((r.token_no, r.n_tokens, r.n_words, r.read) for r in R.align(tokens, words).collect())
    assert got == [(0, 2, 1, "Lantern"), (2, 1, 1, "oil")]


def test_fuzzy_takes_the_one_nearest(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    out_names = sorted({word(rng.randint(6, 14)) for _ in range(60)})
    ref_names = sorted({n[:2] + rng.choice("abcd") + n[3:] for n in out_names[:40]} | {word(13) for _ in range(10)})
    frame = lambda names: S.keyed(spark.createDataFrame([(i, "t", n) for i, n in enumerate(names)], "id long, type string, name string"))
    got = {r.ref_id: r.out_id for r in S.tier_fuzzy(frame(ref_names), frame(out_names)).collect()}
    claims = {}
    for i, a in enumerate(ref_names):
        most = 3 if len(a) >= 12 else 2
        near = sorted((edits(a, b), j) for j, b in enumerate(out_names))
        near = [n for n in near if n[0] <= most]
        if near and (len(near) == 1 or near[0][0] < near[1][0]):
            claims.setdefault(near[0][1], i)
    assert got == {i: j for j, i in claims.items()}


def test_tiers_match_in_turn(spark):
    ref = spark.createDataFrame([(1, "w", "Sword"), (2, "w", "Axe (great)"), (3, "w", "Bow Long"), (4, "w", "Lantern")], "id long, type string, name string")
    out = spark.createDataFrame([(11, "w", "The Swords"), (12, "w", "Axe"), (13, "w", "Long Bow"), (14, "w", "Lamtern")], "id long, type string, name string")
    got = {(r.ref_id, r.out_id, r.tier) for r in S.match_tiers(ref, out).collect()}
    assert got == {(1, 11, "exact"), (2, 12, "qualifier"), (3, 13, "words"), (4, 14, "fuzzy")}


def test_region_below_a_spanning_block(spark):
    rows = []
    for k in range(6):
        rows += [(1, 0, 54, 700 - 12 * k, 240, 10, 2 * k), (1, 0, 320, 700 - 12 * k, 240, 10, 2 * k + 1)]
    rows += [(1, 0, 54, 600 - 12 * k, 506, 10, 50 + k) for k in range(3)]
    runs = spark.createDataFrame(
        [(*r, "normal", "F", "x" * 40) for r in rows],
        "doc_id long, page long, x long, y long, width long, size int, ord long, weight string, font string, text string",
    )
    got = {r.ord: r.column for r in G.region_columns(runs, G.own_layout(runs)).collect()}
    assert {got[2 * k] for k in range(6)} == {0} and {got[2 * k + 1] for k in range(6)} == {1} and {got[50 + k] for k in range(3)} == {2}


def test_lines_do_not_depend_on_partitioning(spark):
    rows = [(1, 0, 0, x, 700 - 12 * y, 20, 10, "normal", "F", f"w{x}{y}", 100 * y + x) for y, x in itertools.product(range(20), range(0, 90, 30))]
    df = spark.createDataFrame(rows, "doc_id long, page long, col long, x long, y long, width long, size int, weight string, font string, text string, ord long")
    texts = lambda d: sorted((r.line, r.text) for r in L.line_text(L.group_lines(d)).collect())
    assert texts(df.repartition(1)) == texts(df.repartition(7, "x"))


@pytest.mark.parametrize(
    "role, raw, value, reject",
    [("weight", "3 kg", 3.0, False), ("cost", "1,200", 1200.0, False), ("cost", "—", None, False), ("weight", "heavy", None, True), ("range", "5-10", None, False), ("range", "far", None, True), ("damage", "2d10+3 Q3", None, True), ("integer", "S/3/10", None, True)],
)
def test_typed_cast(spark, role, raw, value, reject):
    row = T.typed_cast(spark.createDataFrame([(role, raw)], "role string, raw string")).first()
    assert (row.value, row.reject) == (value, reject)


@pytest.mark.parametrize("raw, want", [("Sc", "Scarce"), ("Cm", "Common"), ("VR", "Very Rare"), ("plntfl", "Plentiful"), ("Near Uni", "Near Unique"), ("Zq", None), ("c", None)])
def test_grades(spark, raw, want):
    assert one(spark, T.grade_of(F.lit(raw))) == want


def test_names_meet_without_accents(spark):
    assert one(spark, name_key(F.lit("Čaroděj Őr Ørsted e\u0301"))) == "carodejorørstede"


def test_grid_keeps_values_without_label(spark):
    runs = [(1, 0, 100 + 60 * (k % 3), 500 - 40 * (k // 3), 12, "bold", str(10 + k), k) for k in range(9)]
    runs += [(1, 0, 100 + 60 * (k % 3), 514 - 40 * (k // 3), 6, "normal", f"L{k}", 20 + k) for k in range(9) if k != 4]
    row = H.grids(spark.createDataFrame(runs, "doc_id long, page long, x long, y long, size int, weight string, text string, ord long")).first()
    assert (row["values"], row.labels) == ("10,11,12,13,14,15,16,17,18", "L0,L1,L2,L3,,L5,L6,L7,L8")


def test_letters_of_the_layer_survive_a_tab(spark):
    groups = spark.createDataFrame([("ab\tcd", "ab cd", 90)], "layer string, read string, confidence int")
    assert R.resolve(groups).first().resolved == "ab cd"


def test_typed_parts(spark):
    rows = [("damage", "2d10+3 E"), ("damage", "d6"), ("damage", "1d5 - 1 i"), ("rate", "S/3/10"), ("rate", "-/-/4"), ("range", "5–10"), ("range", "30")]
    got = [tuple(r) for r in T.typed_cast(spark.createDataFrame(rows, "role string, raw string")).select("dice", "faces", "bonus", "kind", "single", "semi", "full", "lo", "hi", "reject").collect()]
    none = (None,) * 3
    assert got[:3] == [(2, 10, 3, "E", *none, None, None, False), (1, 6, 0, None, *none, None, None, False), (1, 5, -1, "I", *none, None, None, False)]
    assert got[3:5] == [(None, *none, True, 3, 10, None, None, False), (None, *none, False, None, 4, None, None, False)]
    assert [r[7:] for r in got[5:]] == [(5, 10, False), (30, 30, False)]


def test_nothing_is_cut_off(spark):
    """Levels, name lengths, passes, nesting and list places come from the data."""
    ranks = spark.createDataFrame([("o", n, f"b{n}", 1) for n in range(1, 16)], "owner string, level int, box string, x int")
    assert len(N.branch_paths(ranks).where("level = 15").first().path.split(" > ")) == 15
    name = "Lord of the Seven Iron Gates"
    tables = spark.createDataFrame([("b", 1, f"Gear of {name} here"), ("b", 2, "other")], "book string, ord int, title string")
    owners = spark.createDataFrame([(name,)], "name string")
    assert [(r.owner, r.how) for r in N.attach_tables(tables, owners).orderBy("ord").collect()] == [(name, "named"), (name, "before")]
    gates = spark.createDataFrame([(1, "You must hold the one old iron key. She saw it."), (2, "Never the one old iron key")], "id int, text string")
    keys = spark.createDataFrame([("the one old iron key",)], "name string")
    assert sorted((r.id, r.kind) for r in N.name_gates(gates, keys).collect()) == [(1, "requires"), (2, "forbids")]
    word = lambda p, c, x: (1, 0, p, p, f"w{p}", 10.0 * x, 0.0, 10.0 * x + 5, 5.0, c)
    words = spark.createDataFrame([word(0, 90, 0), word(1, 90, 0), word(2, 90, 1), word(4, 90, 2)], "doc_id long, page long, ord long, pass int, text string, x0 double, y0 double, x1 double, y1 double, confidence int")
    assert sorted(r.text for r in R.merge_passes(words).collect()) == ["w0", "w2", "w4"]
    deep = "{" + "".join(f'"k{i}":{{' for i in range(10)) + '"z":1,"s":"{{"' + "}" * 11
    leaves = spark.createDataFrame([(deep,)], "j string").selectExpr("parse_json(j) as doc").select(leaf_array("doc").alias("l")).first().l
    path = ".".join(f"k{i}" for i in range(10))
    assert sorted((x.path, x.value) for x in leaves) == [(f"{path}.s", '"{{"'), (f"{path}.z", "1")]
    blocks = spark.createDataFrame([("p", 0, n, n, f"h{n}") for n in range(1, 8)] + [("p", 0, 8, None, "body")], "doc string, seg int, n int, level int, text string")
    path = X.section_path(blocks, ["doc"], "seg", "n", F.col("level"), "text").where("n = 8").first().path
    assert path == [f"h{n}" for n in range(1, 8)]


def test_roll_table_with_broken_range_and_notes(spark):
    rows = [("t", 1, "1-", "a"), ("t", 2, "5", "b"), ("t", 3, "6-9", "c"), ("t", 4, "10+", "d"), ("t", 5, "Note", "e"), ("u", 1, "2-3", "x")]
    got = T.roll_tables(spark.createDataFrame(rows, "table_id string, row_no int, roll string, outcome string")).orderBy("row_no").collect()
    assert [(r.die, r.lo, r.hi, r.outcome) for r in got] == [(10, 1, 5, "a b"), (10, 6, 9, "c"), (10, 10, 10, "d")]


def test_plan_leaves_the_users_rows(spark):
    incoming = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "key string, source_hash string")
    existing = spark.createDataFrame(
        [("i1", "a", "1", "f", "f"), ("i2", "b", "0", "f", "f"), ("i3", "c", "0", "f", "g"), ("i4", "x", "0", "f", "f"), ("i5", "y", "0", "f", "g"),
         ("i6", None, "0", "f", "g"), ("i7", "z", Y.REMOVAL_KEPT, "f", "g")],
        "id string, key string, source_hash string, fingerprint string, current_fingerprint string",
    )
    got = {r.key: r.action for r in Y.plan_import(incoming, existing).collect()}
    assert got == {"a": "unchanged", "b": "replace", "c": "conflict changed", "d": "create", "x": "remove", "y": "conflict removed", "z": "kept"}


def test_packs_are_written_in_order_and_read_back(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.createDataFrame([("p", f"{i:03d}", '{"b":1,"a":%d}' % i) for i in range(50)] + [("q", "1", "{}")], "pack string, id string, doc string")
    P.write_packs(docs, f"{root}/out", files=4)
    back = spark.read.text(f"{root}/out/pack=p").select(F.col("value"), F.input_file_name().alias("f")).collect()
    assert sorted(r.value for r in back)[0] == '{"a":0,"b":1}' and len(back) == 50
    assert S.files_of(spark, f"{root}/out").where("path like 'pack=%'").count() >= 2


def test_json_tree_skips_drafts_and_shows_bad_files(spark):
    import os

    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for path, text in [("core/items/_source/a.json", '{"n":1}'), ("core/items/_source/b.json", "{"), ("homebrew-x/items/_source/c.json", "{}"), ("_old/items/_source/d.json", "{}")]:
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)
    got = sorted((r.grp, r.file, r.bad) for r in P.read_json_tree(spark, root).collect())
    assert got == [("core", "a.json", False), ("core", "b.json", True)]
