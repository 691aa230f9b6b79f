"""Text rules as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# How ligature glyphs, dashes and spaces are spelled.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
DASHES = "‐‑‒–—―−"
SOFT_HYPHEN = "­"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def composed(text: Column) -> Column:
    """Unicode NFC. Text without a character above U+02FF is composed as it is and never leaves the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike("[̀-\U0010ffff]"), text)), text)


def canonical_text(text: Column, nfc: bool = True) -> Column:
    """Ligatures, soft hyphens, dashes, whitespace, NFC and trim, in this order."""
    for glyph, letters in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(letters))
    text = F.replace(text, F.lit(SOFT_HYPHEN), F.lit(""))
    text = F.translate(text, DASHES, "-" * len(DASHES))
    text = F.regexp_replace(text, r"[\s   ]+", " ")
    return F.trim(composed(text) if nfc else text)


def canonical_font(font: Column) -> Column:
    """Font name without its subset prefix, in lower case."""
    return F.lower(F.regexp_replace(font, r"^[A-Z]{6}\+(.+)$", "$1"))


def letters(text: Column) -> Column:
    """The text without white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def is_subsequence(part: str, whole: str) -> Column:
    """Whether column ``part`` is a subsequence of column ``whole``."""
    return F.expr(
        f"""aggregate(split({part}, ''), 1, (at, ch) ->
              case when at = 0 or locate(ch, {whole}, at) = 0 then 0 else locate(ch, {whole}, at) + 1 end) > 0"""
    )


def words_of(text: Column) -> Column:
    """All letter sequences in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
