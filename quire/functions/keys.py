"""Keys that bring the spellings of one name together."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

def _accents() -> tuple[str, str]:
    """Lower-case letters that decompose into a plain letter and marks, and those plain letters; then the marks, which go."""
    letters = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower()}
    folded = {c: base for c, base in letters.items() if base != c and base.isascii()}
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(folded) + marks, "".join(folded.values())


ACCENTED, PLAIN = _accents()


def plain(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def name_key(name: Column) -> Column:
    """Letters and digits only, in lower case without accents."""
    return F.regexp_replace(plain(name), r"[^\p{L}\p{N}]+", "")


def singular_key(name: Column) -> Column:
    return F.regexp_replace(name_key(name), "s$", "")


def unqualified(name: Column) -> Column:
    """Name key without what stands in brackets."""
    return name_key(F.regexp_replace(name, r"\([^)]*\)?|\[[^\]]*\]?", " "))


def name_words(name: Column) -> Column:
    return F.filter(F.split(plain(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_bag(name: Column) -> Column:
    return F.array_join(F.array_sort(name_words(name)), " ")


def slug(name: Column) -> Column:
    s = F.regexp_replace(plain(name), r"['\"]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", "entry").otherwise(s)


def identifier(name: Column) -> Column:
    """Lower camel case of the name's words."""
    ws = F.filter(F.split(plain(name), r"[^a-z0-9]+"), lambda w: w != "")
    joined = F.array_join(F.transform(ws, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")
    return F.concat(F.lower(F.substr(joined, F.lit(1), F.lit(1))), F.substr(joined, F.lit(2)))
