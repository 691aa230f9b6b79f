"""Words of a block of texts: where they stand in the flat bytes, and a 64-bit value for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.llm.blocks import flat_bytes, mix

_VALUES = np.random.default_rng(20250301).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
#: Bytes between words ``[^\x20\x09-\x0D]+``, and bytes between terms (all of ASCII but letters and digits).
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Bytes of texts whose words are taken at a time: each byte needs some thirty for a moment.
WORD_BLOCK = 2 << 20
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(c).isalnum() for c in range(128)]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """``data`` and ``offsets`` of the texts, ``starts`` and ``stops`` of their words, and the n + 1 places ``begins`` where
    each text's words begin. Null texts have none."""

    def __init__(self, texts: pa.Array, between: np.ndarray = SPACES):
        self.data, self.offsets = flat_bytes(texts)
        apart = between[self.data]
        first, last = np.ones(len(self.data), bool), np.ones(len(self.data), bool)
        first[1:], last[:-1] = apart[:-1], apart[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        first[inner] = True
        last[inner - 1] = True
        self.starts = np.flatnonzero(first & ~apart)
        self.stops = np.flatnonzero(last & ~apart) + 1
        self.begins = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.begins)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def values(self, fold: bool = False) -> np.ndarray:
        """A value for each word's bytes (``fold``: A-Z as a-z)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        table = _VALUES.copy()
        if fold:
            table[65:91] = table[97:123]
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * powers(_BACK, len(self.data)), out=total[1:])
        shift = powers(_STEP, len(self.data) + 1)[self.starts]
        return mix((total[self.stops] - total[self.starts]) * shift + (self.stops - self.starts).astype(np.uint64))

    def joined(self, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The kept words of each text with one space between them, all texts behind each other, and the n + 1 offsets."""
        data = self.data.copy()
        ends = self.offsets[1:][self.owners()]
        stops = np.minimum(self.stops + 1, ends)  # with the byte behind, which becomes the space
        data[self.stops[self.stops < ends]] = 32
        step = np.zeros(len(data) + 1, np.int8)
        step[self.starts[kept]] = 1
        step[stops[kept]] -= 1  # each place once
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        last = np.zeros(len(self.offsets) - 1, np.int64)  # the last kept word of a text, plus one
        where = np.flatnonzero(kept)
        last[self.owners()[where]] = where + 1
        closing = last[last > 0] - 1
        extra = closing[self.stops[closing] < ends[closing]]
        inside[self.stops[extra]] = False
        out = data[inside]
        sizes = np.zeros(len(data) + 1, np.int64)
        np.cumsum(inside, out=sizes[1:])
        return out.tobytes(), sizes[self.offsets]


def grams(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A value for each ``size`` neighbouring words, whatever texts they are of; ``size - 1`` fewer than words."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed), np.uint64)
    step = np.uint64(_STEP + 2 * seed)
    for k in range(size):
        out = out * step + values[k : k + n]
    return mix(out)
