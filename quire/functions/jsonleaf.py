"""JSON documents as leaves: every primitive or array by dotted path.

A document walks inside its own row, one object level per step, so no shuffle
is needed. Leaf values are canonical JSON text, which
keeps the type of each (``"1"`` is not ``1``).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def leaf_array(doc: str, editions: list[str] | None = None, edition: str | None = None) -> Column:
    """``array<struct<path, value>>`` of variant column ``doc``; per-edition containers give the edition's value.

    One step opens one level; there are as many steps as the document nests objects. A dot inside a key is written as
    ``\\.`` (and a backslash as two), so that a path tells its levels apart. An empty key at the
    top reads as no key.
    """
    is_object = "schema_of_variant({0}) like 'OBJECT<_%' and schema_of_variant({0}) <> 'OBJECT<>'"
    level = "acc"
    if editions:
        names = ", ".join(f"'{e}'" for e in editions)
        level = f"""filter(transform({level}, it -> if({is_object.format('it.v')}
              and forall(map_keys(cast(it.v as map<string, variant>)), k -> k in ({names})),
              named_struct('path', it.path, 'v', try_element_at(cast(it.v as map<string, variant>), '{edition}')), it)),
            it -> it.v is not null)"""
    key = r"replace(replace(e.key, '\\', '\\\\'), '.', '\\.')"
    step = f"""flatten(transform({level}, it -> if({is_object.format('it.v')},
          transform(map_entries(cast(it.v as map<string, variant>)),
            e -> named_struct('path', concat(it.path, if(it.path = '', '', '.'), {key}), 'v', e.value)),
          array(it))))"""
    # braces inside strings do not nest: strings go first, with what a backslash escapes
    braces = f"""split(regexp_replace(regexp_replace(to_json({doc}), r'"(\\\\.|[^"\\\\])*+"', ''), '[^{{}}]', ''), '')"""
    deepest = f"""aggregate({braces}, named_struct('now', 0, 'most', 1),
        (d, c) -> named_struct('now', d.now + if(c = '{{', 1, if(c = '}}', -1, 0)), 'most', greatest(d.most, d.now + if(c = '{{', 1, 0))), d -> d.most)"""
    first = f"array(named_struct('path', '', 'v', {doc}))"
    items = f"aggregate(sequence(1, coalesce({deepest}, 1) + 1), {first}, (acc, i) -> {step})"
    return F.expr(f"transform({items}, it -> named_struct('path', it.path, 'value', to_json(it.v)))")


def canonical(leaves: Column) -> Column:
    """One text per content: sorted ``path=value`` lines."""
    return F.array_join(F.transform(F.array_sort(leaves), lambda l: F.concat(l["path"], F.lit("="), l["value"])), "\n")


def canonical_json(doc: Column) -> Column:
    """JSON with keys sorted at every level."""
    return F.to_json(F.parse_json(doc))


def path_steps(path: Column) -> Column:
    """The keys of a leaf's path, as ``array<string>``."""
    parts = F.split(path, r"(?<=(?<!\\)(?:\\\\){0,50})\.")
    return F.transform(parts, lambda k: F.regexp_replace(k, r"\\(.)", "$1"))


def quoted(key: Column) -> Column:
    """A string as JSON."""
    text = F.to_json(F.array(key))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def nested(leaves: Column) -> Column:
    """The JSON document of ``array<struct<path, value>>``, keys in byte order: the opposite of ``leaf_array``.

    Leaves in the order of their keys tell by what they share with the one before which objects close and open, so the text is
    written in one pass, at any depth. A leaf whose path others go on from gives way to them; of equal paths the first value
    stays. A single leaf without a path is the whole document. No leaves give an empty object.
    """
    rows = F.array_sort(F.transform(leaves, lambda l: F.struct(path_steps(l["path"]).alias("k"), l["value"].alias("v"))))
    begins = lambda a, b: F.slice(b, F.lit(1), F.size(a)) == a
    last = lambda r, i: F.get(r, i + 1)["k"]
    once = F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["k"] != x["k"]))
    kept = F.filter(once, lambda x, i: F.coalesce(~begins(x["k"], last(once, i)), F.lit(True)))

    def piece(kept: Column, x: Column, i: Column) -> Column:
        before, own, n = F.coalesce(F.get(kept, i - 1)["k"], F.array().cast("array<string>")), x["k"], F.size(x["k"])
        alike = F.transform(F.sequence(F.lit(1), n), lambda j: F.slice(before, F.lit(1), j) == F.slice(own, F.lit(1), j))
        shared = F.size(F.filter(alike, lambda a: a))
        closes = F.repeat(F.lit("}"), F.greatest(F.size(before) - 1 - shared, F.lit(0)))
        opens = F.array_join(F.transform(F.slice(own, shared + 1, n - shared), quoted), ":{")
        return F.concat(F.when(i == 0, F.lit("{")).otherwise(F.concat(closes, F.lit(","))), opens, F.lit(":"), x["v"])

    whole = F.concat(F.array_join(F.transform(kept, lambda x, i: piece(kept, x, i)), ""), F.repeat(F.lit("}"), F.size(F.element_at(kept, -1)["k"])))
    bare = (F.size(leaves) == 1) & (F.get(leaves, F.lit(0))["path"] == "")
    return F.when(F.size(leaves) == 0, F.lit("{}")).when(bare, F.get(leaves, F.lit(0))["value"]).otherwise(whole)


def steps(path: str) -> list[str]:
    """The keys of a leaf's path."""
    keys = [""]
    for part in re.findall(r"\\.|\.|[^.\\]+", path):
        if part == ".":
            keys.append("")
        else:
            keys[-1] += part[1:] if part[0] == "\\" else part
    return keys


@F.pandas_udf(T.StringType())
def nest(paths: pd.Series, values: pd.Series) -> pd.Series:
    """A JSON document from its leaves: parallel arrays of dotted paths and JSON values."""

    def build(names, texts):
        root: dict = {}
        for name, text in zip(names, texts):
            at = root
            *heads, last = steps(name)
            for head in heads:
                at = at.setdefault(head, {})
            at[last] = json.loads(text)
        return json.dumps(root, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([build(p, v) for p, v in zip(paths, values)])
