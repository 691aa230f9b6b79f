"""Five-word shingle sets of whole texts as sorted 64-bit values, for a block of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.llm.blocks import flat_bytes, mix

#: A random value for each byte, A-Z as a-z; the multiplier of the rolling value and its inverse modulo 2**64.
_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_values(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each word ``[^\\x20\\x09-\\x0D]+`` (``fold``: A-Z as a-z), and the n + 1 places where each text's
    words begin."""
    data, offsets = flat_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = SPACE[data]
    first = np.ones(len(data), bool)  # a word begins at a text's begin or after white space
    first[1:] = space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    starts = np.flatnonzero(first & ~space)
    stops_at = np.ones(len(data), bool)
    stops_at[:-1] = space[1:]
    stops_at[inner - 1] = True
    stops = np.flatnonzero(stops_at & ~space) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUES)[data] * _powers(_BACK, len(data)), out=total[1:])
    words = mix((total[stops] - total[starts]) * _powers(_STEP, len(data) + 1)[starts] + (stops - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, one text after the other, and the n + 1 offsets.

    A text with fewer words than ``size`` has one shingle, all of its words; without words it has none.
    """
    words, begins = word_values(texts)
    n = len(texts)
    counts = np.diff(begins)
    many = np.maximum(counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(n), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + begins[:-1][owner]
    length = np.minimum(counts, size)[owner]
    values = mix(length.astype(np.uint64))
    for k in range(size):
        there = length > k
        at = np.where(there, place + k, 0)
        values = np.where(there, mix(values * np.uint64(_STEP) + words[at]), values) if len(words) else values
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n + 1))
