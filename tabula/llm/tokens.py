"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _MIX, dtype=np.uint64))

BLANK_BYTES = np.zeros(256, dtype=bool)
BLANK_BYTES[[32, 9, 10, 11, 12, 13]] = True
#: ASCII letters and digits, and every byte of other characters.
LETTER_BYTES = np.zeros(256, dtype=bool)
LETTER_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def leads(ids: np.ndarray) -> np.ndarray:
    """Positions at which a new value begins."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, dtype=np.int64)


def word_spans(data: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes for which `in_word` holds."""
    inside = np.r_[False, in_word[data], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word, never 0."""
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - begins
    total = int(sizes.sum())
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    offset = np.arange(total) - np.repeat(first, sizes)
    taken = data[np.repeat(begins, sizes) + offset].astype(np.uint64) + np.uint64(1)
    taken *= _POWERS[offset & 63]
    if int(sizes.max()) > 64:
        taken *= (2 * (offset >> 6) + 1).astype(np.uint64)
    value = np.add.reduceat(taken, first)
    value ^= value >> np.uint64(29)
    value *= _MIX
    value ^= value >> np.uint64(32)
    return np.maximum(value, np.uint64(1))


def owners(lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which text each word belongs to; texts of `lengths` bytes are joined by one byte."""
    return np.searchsorted(np.cumsum(lengths + 1), begins, side="right")
