"""Periodic runs, ranked search and window removal against brute force, on small frames with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import lexical, periods, windows
from quire.llm.words import MARKS, Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns bear names that the operators use inside.
SCHEMA = "doc_id long, text string, key string, id string, stays int, item string, doc string, score string, rank string, salt int, place string, runs int, region string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "i", 1, "x", "d", "s", "r", 2, "p", 3, "q", "h") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty texts, a long one, repeats inside and across texts, repeated rows and ids, ties."""
    rnd = random.Random(5)
    bag = ["".join(rnd.choice("abcdEé") for _ in range(rnd.randrange(1, 7))) for _ in range(150)]
    say = lambda n: " ".join(rnd.choice(bag) for _ in range(n))
    shared, line = say(40), say(9)
    texts = [None, "", " \n\t ", "one two", say(20000), "la " * 3000, (line + "\n") * 60, shared, say(30) + " " + shared, shared + "\n" + say(30), f"{say(5)} {shared} {say(5)} {shared}", " x ÀÉ 😀 " * 30]
    texts += [say(rnd.randrange(1, 90)) for _ in range(60)]
    out = list(enumerate(texts))
    return [*out, (8, out[8][1]), (9, say(30) + " " + shared), (None, shared), (None, None), (200, say(12)), (201, out[-1][1])]


def test_words_and_joined_text():
    rnd = random.Random(2)
    texts = [None, "", "a", " a", "a ", "a  b\tc\n", "é😀 x", "\x0b", *("".join(rnd.choice("ab é\n\t.") for _ in range(rnd.randrange(30))) for _ in range(300))]
    words = Words(pa.array(texts))
    flat = [w for t in texts for w in WORD.findall(t or "")]
    assert [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.stops)] == flat
    values = words.values()
    assert len({*zip(flat, values.tolist())}) == len({*flat}) == len({*values.tolist()})
    for chance in (0, 0.5, 1):
        kept = np.array([rnd.random() < chance for _ in flat], bool)
        data, offsets = words.joined(kept)
        for k in range(len(texts)):
            own = [w for w, y in zip(flat[words.begins[k] : words.begins[k + 1]], kept[words.begins[k] : words.begins[k + 1]]) if y]
            assert data[offsets[k] : offsets[k + 1]].decode() == " ".join(own)
    found = Words(pa.array(["Ab-c_d", "é9\x7fZ", "@[`{"]), MARKS)
    assert [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.stops)] == ["Ab", "c", "d", "é9", "Z"]


def runs_by_hand(ws, least=24):
    out = []
    for q in range(1, len(ws) // 3 + 1):
        k = q
        while k < len(ws):
            begin = k
            while k < len(ws) and ws[k] == ws[k - q]:
                k += 1
            start, length = begin - q, k - begin + q
            part = ws[start : start + length]
            if length >= max(least, 3 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((start, length, q))
            k += k == begin
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    texts = []
    for _ in range(800):
        ws = [rnd.randrange(rnd.randrange(1, 6)) for _ in range(rnd.randrange(160))]
        for _ in range(rnd.randrange(3)):
            if len(ws) > 30:
                a = rnd.randrange(len(ws))
                p = rnd.randrange(1, max(2, (len(ws) - a) // 3 + 1))
                for i in range(a + p, rnd.randrange(a, len(ws))):
                    ws[i] = ws[i - p]
        texts.append(ws)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = periods.runs(np.array([w + 1 for t in texts for w in t], np.uint64), begins)
    want = [(k, *r) for k, t in enumerate(texts) for r in runs_by_hand(t)]
    assert got.tolist() == [list(r) for r in want] and len(want) > 100
    assert periods.runs(np.ones(100_000, np.uint64), np.array([0, 100_000])).tolist() == [[0, 0, 100_000, 1]]
    assert not len(periods.runs(np.zeros(0, np.uint64), np.array([0, 0])))
    with pytest.raises(ValueError):
        periods.runs(np.zeros(0, np.uint64), np.array([0]), 12)


def test_periodic_query(spark, rows):
    docs = frame(spark, rows)
    got = Counter(tuple(r) for r in periods.digest(periods.periodic(docs, repeat=True)).collect())
    want, changed = Counter(), 0
    for i, t in rows:
        ws = WORD.findall(t or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and ws:
            g = h // 10
            a = g % len(ws)
            p = 1 + (len(ws) - a) // (3 + g % 8)
            ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
            changed += 1
        found = [(0, 3000, 1)] if i == 5 else runs_by_hand(ws) if len(ws) < 5000 else [tuple(r) for r in periods.runs(np.array([hash(w) & 2**63 - 1 for w in ws], np.uint64), np.array([0, len(ws)]))[:, 1:].tolist()]
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want[(i, len(found), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], sha(lines), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))] += 1
    assert got == want and changed > 2
    assert periods.digest(periods.periodic(docs.limit(0))).count() == 0
    plain = periods.periodic(docs).where("doc_id = 6").first()
    assert [tuple(r) for r in plain.runs] == [(0, 540, 9)] and len(plain.collapsed.split()) == 9


def ranks_by_hand(rows, items, top=20):
    docs = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in rows if i is not None and t]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


@pytest.mark.parametrize("rarest", [True, False])
def test_ranked_equals_brute_force(spark, rows, rarest, monkeypatch):
    monkeypatch.setattr(lexical, "RAREST_FIRST", rarest)
    rnd = random.Random(8)
    more = [(300 + k, " ".join(rnd.choice(rows[12 + rnd.randrange(50)][1].split()) for _ in range(rnd.randrange(1, 60)))) for k in range(400)]
    rows = [*rows, *more, *((1000 + k, "tie tie") for k in range(30))]
    items = [(0, rows[8][1]), (1, "Tie"), (2, None), (3, ""), (4, "unheard-of"), *((10 + k, f"{t} {t[:20]}, é") for k, (_, t) in enumerate(more[:25]))]
    docs = frame(spark, rows).repartition(3)
    asked = spark.createDataFrame([(i, t, 1, "d") for i, t in items], "item_id int, text string, rank int, doc string")
    got = sorted(tuple(r) for r in lexical.ranked(docs, asked).collect())
    assert got == ranks_by_hand(rows, items) and len(got) > 400
    assert lexical.ranked(docs.limit(0), asked).count() == 0 and lexical.ranked(docs, asked.limit(0)).count() == 0


def test_items_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 3)
    items = [(k, rows[12 + k][1]) for k in range(9)]
    got = sorted(tuple(r) for r in lexical.ranked(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), top=4).collect())
    assert got == ranks_by_hand(rows, items, 4)


def test_tree_leaves_out_documents():
    """Bounds leave out most leaves where rare terms set documents apart."""
    rng = np.random.default_rng(4)
    text = np.repeat(np.arange(4000), 6)
    rank = np.sort(np.column_stack([rng.integers(0, 300, (4000, 3)), rng.integers(300, 320, (4000, 3))]), axis=1)
    rank = np.sort(rank + np.arange(6) * 320, axis=1).ravel()
    tree = lexical.Tree(rank, text, rng.integers(1, 4, len(rank)), rng.integers(75, 140, 4000))
    weight = np.zeros(320 * 6, np.int64)
    weight[rank[:6]] = [9000, 9000, 9000, 800, 800, 800]
    found = [p for p in tree.search(weight, 0)]
    texts, scores = (np.concatenate(c) for c in zip(*found, strict=True))
    gain = lexical.UNIT * tree.tf // (1000 * tree.tf + 12 * np.repeat(tree.m, tree.sizes))
    whole = np.bincount(np.repeat(tree.order, tree.sizes), weight[tree.rank] * gain, 4000).astype(np.int64)
    assert len(texts) < 1000 and sorted(scores)[-20:] == sorted(whole)[-20:] and (whole[texts] == scores).all()


def windows_by_hand(rows, size=13):
    first = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        for k in range(len(ws) - size + 1):
            if i is not None:
                first[tuple(ws[k : k + size])] = min(i, first.get(tuple(ws[k : k + size]), i))
    out = Counter()
    for i, t in rows:
        ws = WORD.findall(t or "")
        gone = {k + j for k in range(len(ws) - size + 1) if i is not None and first[tuple(ws[k : k + size])] < i for j in range(size)}
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[(i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    return out


@pytest.mark.parametrize("bits", [30, 17])
def test_windows_equal_brute_force(spark, rows, bits):
    """With 2**17 cells most windows are estimated repeated; the result is the same."""
    docs = frame(spark, rows).repartition(3)
    found = windows.without_windows(docs, most_bits=bits)
    got = Counter(tuple(r) for r in windows.digest(found).collect())
    want = windows_by_hand(rows)
    assert got == want and sum(n for *_, n in ((r[2],) for r in want)) >= 200
    for r in found.collect():
        assert sum(s.words for s in r.removed) == r.n_removed
    assert windows.without_windows(docs.limit(0)).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(4)]
    twice = parts[0][:300]
    parts[3] = np.concatenate([parts[3], twice])
    once, more = defaultdict(lambda: 0), defaultdict(lambda: 0)
    for p in parts:
        s = windows.Sketch(20)
        s.add(p)
        for k, one, two in s.regions():
            a, b = windows.spread(one), windows.spread(two)
            assert (windows.spread(windows.squeezed(a)) == a).all()
            more[k] = more[k] | b | (once[k] & a)
            once[k] = once[k] | a
    known = windows.Estimates({k: windows.squeezed(m) for k, m in more.items()}, 20)
    assert known.repeated(twice).all()
    assert known.repeated(parts[1]).mean() < 0.01


def test_full_cells_do_not_send_windows_to_the_grouping(spark):
    """beyond a billion windows the sketch filled up, and most single windows were sent to be grouped (disk at 6 GB)."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(map(str, rng.integers(0, 10**9, 1500)))) for k in range(300)]
    rows.append((300, rows[7][1]))
    bits = 18  # two rows of 131,072 cells for 447,000 windows
    docs = frame(spark, rows)
    fine = windows.fine_bits(bits, sum(len(t) for _, t in rows))
    found = {r.region: bytes(r.more) for r in windows.sketch(docs, bits, fine).collect()}
    known = windows.Estimates(found, bits, fine)
    _, _, hashes, _ = windows.block_windows(pa.array([t for _, t in rows]), windows.SIZE)
    again = known.repeated(hashes)
    assert again[-1488:].all() and again[7 * 1488 : 8 * 1488].all() and again.mean() < 0.03
    cells = np.unique(rng.integers(0, 2**24, 5000, dtype=np.uint64))
    assert (windows.unpacked(*windows.packed(cells, 24)) == cells).all()
