"""Hashes of the words of many texts at once, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from skerry.llm.arrow_text import BLANK, CLASS, DIGIT, LETTER, LOWER, PUNCT, WIDE, as_bytes, per_text, starts_of

_PRIME = np.uint64(0x100000001B3)
_POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << 12) - 1, _PRIME, np.uint64)))
# Tokens are runs of letters (ASCII or wider), of digits, or of punctuation.
_KIND = np.array([0, 1, 2, 3, 1], np.uint8)
assert (BLANK, LETTER, DIGIT, PUNCT, WIDE) == (0, 1, 2, 3, 4)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser that spreads every bit."""
    h = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Tokens of a column of texts: place, size, kind and hash of each, and the n + 1 offsets of the texts in tokens."""

    def __init__(self, texts: pa.Array):
        data, offsets = as_bytes(texts)
        kind = _KIND[CLASS[data]]
        mark = np.zeros(len(data), bool)
        mark[1:] = kind[1:] != kind[:-1]
        starts = starts_of(mark, offsets) if len(data) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        full = kind[starts] != 0
        self.raw, self.data = data, LOWER[data]
        self.starts, self.sizes = starts[full], (ends - starts)[full]
        self.kinds = kind[self.starts]
        self.offsets = per_text(self.starts, offsets)
        self._all, self._full = (starts, ends - starts), full

    def hashes(self) -> np.ndarray:
        """Of the whole tokens, A-Z in lower case."""
        starts, sizes = self._all
        if not len(starts):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.data)) - np.repeat(starts, sizes)
        values = (self.data.astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)]
        return mixed(np.add.reduceat(values, starts)[self._full])

    def prefix_hashes(self, size: int) -> np.ndarray:
        """Of the first `size` bytes of the tokens; zero where a token is shorter."""
        held = self.sizes >= size
        h = np.zeros(len(self.starts), np.uint64)
        at = self.starts[held]
        for k in range(size):
            h[held] += (self.data[at + k].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
        h[held] = mixed(h[held], size)
        return h

    def upper(self) -> np.ndarray:
        """Whether the first and the second byte of a token are A-Z (2: both, 1: the first, 0: neither)."""
        first = (self.raw[self.starts] - np.uint8(65)) < 26
        second = (self.raw[np.minimum(self.starts + 1, len(self.raw) - 1)] - np.uint8(65)) < 26 if len(self.raw) else first
        return first.astype(np.uint8) + (first & second & (self.sizes > 1))
