"""Rows that tie in a query's order come out as its SQL states."""

from __future__ import annotations

import __spark_entry__ as entry
from compare import compare, connect


def held(spark, folder, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/out")
    next(iter((folder / "out").glob("*.parquet"))).rename(folder / "documents.parquet")
    return compare(entry.queries()[name](spark, str(folder)), connect(str(folder)), entry.oracle_sql()[name])


def test_one_text_in_two_languages(spark, tmp_path):
    """two readings of one edition, of different languages, in the order of their values."""
    kept = [("en", "a"), ("en", "b"), ("de", "a"), ("de", "c")]
    rows = [(1000 + 4 * i + 3 - j, f"same text {i}", lang, source, 11) for i in range(20) for j, (lang, source) in enumerate(kept)]
    assert held(spark, tmp_path, "j5_merge_editions", rows) == ""


def test_title_over_two_columns(spark, tmp_path):
    """a first line that fills the first page opens both of its columns at one height and size; the left one counts."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(1, 1800)]
    rows = [(i, " ".join(words[i:] + words[:i]), "en", "s", 0) for i in range(12)]
    assert held(spark, tmp_path, "d9_doc_title", rows) == ""


def test_dominant_neighbours_by_hand(spark):
    """words met as rows for each of their letters; now a key's words meet in one row, to the same end."""
    import random

    import __spark_entry__ as entry
    from quire.operators.vocab import dominant_neighbour

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aé\U0001f600ß") for _ in range(rng.randint(0, 4)))
    asked = [(rng.choice([1, 2, None]), rng.randint(0, 2), word()) for _ in range(300)] + [(4, 0, "aa")]
    known = sorted({(rng.choice([1, 2, 3]), rng.randint(0, 2), word()) for _ in range(300)})
    known = [(*k, rng.choice([1, 2, 3, 6, 9])) for k in known]
    for keys in (["doc_id", "page"], ["doc_id"]):
        counts = {k[: len(keys)] + k[2:3]: k[3] for k in known}
        rows = [(*k, n) for k, n in counts.items()]
        want = set()
        for core in {a[: len(keys)] + a[2:] for a in asked}:
            near = sorted((-n, w) for *k, w, n in rows if tuple(k) == core[:-1] and len(w) == len(core[-1]) and sum(map(lambda a, b: a != b, w, core[-1])) == 1)
            if near and -near[0][0] >= 2 and (len(near) == 1 or -near[0][0] >= 3 * -near[1][0]):
                want.add((*core, near[0][1]))
        schema = "doc_id long, page long, word string, n long" if len(keys) == 2 else "doc_id long, word string, n long"
        got = dominant_neighbour(spark.createDataFrame(asked, "doc_id long, page long, core string"), spark.createDataFrame(rows, schema), keys)
        assert {tuple(r) for r in got.select(*keys, "core", "better").collect()} == want and want and got.count() == len(want)
    plan = entry.queries()["d2_vouch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "mask" not in plan
