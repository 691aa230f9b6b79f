"""License scans by patience alignment (operator 9).

A text's words that are key words of a template gather in places. In a place, a copy of the template shows as key words that
stand as far from its begin as in the template, within a quarter of its length: each such copy is aligned in a window of
its own, so that copies in a row and everyday words around do not hide one another. A place without such a copy found is
aligned as a whole (copies with much put between). Alignment: equal
beginnings and ends first, then words that both hold exactly once are anchors, the longest increasing subsequence of
anchors stays, and the gaps between anchors are aligned in the same way. Coverage is the share of the template's words
that found a partner; a template is found where it is ``LEAST`` or more.

Null and empty texts have no license. Of equal coverage the template with more matched words wins, then the name that
comes first, then the earlier place. Whole texts are read. Repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.blocks import strings, text_blocks

LEAST = 0.8
#: Public notices and headers of well-known licenses; fixed values. A name may have several templates.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("MIT", "Released under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
)
#: Words too common to be key words.
COMMON = frozenset("a all an and any are as at by can for form forms free from in is it its later met of on or that the this to under use v with work you".split())
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def words_of(text: str) -> list[str]:
    """Words between white space in lower case, without marks at their edges."""
    return [w if w.isalnum() else _EDGE.sub("", w) for w in text.lower().split()]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = v, i
        back.append(top_at[pile - 1] if pile else -1)
    out = []
    i = top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in text, in template), in order."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(text[a:b]).items() if n == 1} & {w for w, n in Counter(template[c:d]).items() if n == 1}
        where = {w: i for i, w in enumerate(text[a:b], a) if w in once}
        both = [(where[w], j) for j, w in enumerate(template[c:d], c) if w in once]
        anchors = [both[i] for i in increasing([x for x, _ in both])]
        if not anchors:
            continue
        out += anchors
        ends = [*anchors, (b, d)]
        begins = [(a - 1, c - 1), *anchors]
        gaps += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(begins, ends, strict=True) if q > p + 1 and s > r + 1]
    return sorted(out)


def begins(hits: list[tuple[int, str]], at: dict[str, int], drift: int) -> Iterator[tuple[int, int]]:
    """Least and greatest place where a copy would begin by its key words, of each group within ``drift`` that holds at least
    half of the key words ``at`` (with their places in the template), the fullest of overlapping groups."""
    seen = sorted((i - at[w], w) for i, w in hits if w in at)
    many: Counter = Counter()
    stop, best = 0, None
    for first, (low, word) in enumerate(seen):
        if best is not None and low > best[2]:
            yield best[1:]
            best = None
        while stop < len(seen) and seen[stop][0] <= low + drift:
            many[seen[stop][1]] += 1
            stop += 1
        if len(many) * 2 >= len(at) and (best is None or len(many) > best[0]):
            best = (len(many), low, seen[stop - 1][0])
        many[word] -= 1
        if not many[word]:
            del many[word]
    if best is not None:
        yield best[1:]


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.least = least
        self.templates = [(name, words_of(body)) for name, body in templates]
        self.keys = [frozenset(words) - COMMON for _, words in self.templates]
        self.any_key = frozenset().union(*self.keys)
        # key words that a template holds once, with their places
        self.places = [{w: j for j, w in enumerate(words) if w in keys and words.count(w) == 1} for (_, words), keys in zip(self.templates, self.keys, strict=True)]

    def found(self, text: str) -> list[tuple[float, int, str, int, int]]:
        """Coverage, matched words, name, first and last word (exclusive) of each place, the best first."""
        words = words_of(text)
        hits = [i for i, w in enumerate(words) if w in self.any_key]
        out = []
        for (name, template), keys, at in zip(self.templates, self.keys, self.places, strict=True) if hits else ():
            own = [i for i in hits if words[i] in keys]
            n = len(template)
            lead = next(k for k, w in enumerate(template) if w in keys)
            begin = 0
            for k in range(1, len(own) + 1):
                if k < len(own) and own[k] - own[k - 1] <= n:
                    continue
                place, begin = own[begin:k], k
                if len({words[i] for i in place}) * 2 < len(keys):
                    continue
                before, drift = len(out), n // 4 + 1
                for low, high in begins([(i, words[i]) for i in place], at, drift):
                    start = max(0, low - drift)
                    pairs = aligned(words[start : high + n + drift], template)
                    if len(pairs) >= self.least * n:  # equal words at the ends of the window may lie outside the copy
                        middle = pairs[len(pairs) // 2]
                        close = max(0, start + middle[0] - middle[1])
                        near = aligned(words[close : close + n], template)
                        if len(near) >= len(pairs):
                            start, pairs = close, near
                    if len(pairs) >= self.least * n:
                        out.append((len(pairs) / n, len(pairs), name, start + pairs[0][0], start + pairs[-1][0] + 1))
                if len(out) > before:
                    continue
                stop = min(len(words), place[-1] + n + 1)
                for start in (place[0] - n, place[0] - lead):  # with room before it, or where the template would begin
                    start = max(0, start)
                    pairs = aligned(words[start:stop], template)
                    if len(pairs) >= self.least * n:
                        out.append((len(pairs) / n, len(pairs), name, start + pairs[0][0], start + pairs[-1][0] + 1))
        return sorted(out, key=lambda x: (-x[0], -x[1], x[2], x[3]))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``key, license, coverage, n_matched, first_word, last_word`` of the best place (null without one) and ``licenses``, all
    names found, in order and comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for block in text_blocks(batches, text):
            rows = []
            for t in strings(block.column(text)):
                found = scanner.found(t)
                best = found[0] if found else (None,) * 5
                rows.append((best[2], best[0], best[1], best[3], best[4], ",".join(sorted({f[2] for f in found}))))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([block.column(key), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=list("abcdefg"))

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"a {kind}, b string, c double, d long, e long, f long, g string")
    return out.toDF(key, "license", "coverage", "n_matched", "first_word", "last_word", "licenses")
