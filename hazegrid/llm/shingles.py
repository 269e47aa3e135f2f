"""Hashes of words and word shingles, computed over whole byte buffers."""

from __future__ import annotations

import numpy as np

from hazegrid.llm.common import ASCII_LOWER

_RNG = np.random.default_rng(7_919)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class _Powers:
    """Powers of the base and of its inverse, extended to the longest text seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, size, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased."""
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.encode().translate(ASCII_LOWER), np.uint8)
    up, down = _POWERS.upto(len(data) + 1)
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix((sums[last] - sums[first]) * down[first])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; of fewer words, the sequence as one."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mix(total + words[k : k + len(total)] * np.uint64(2 * k + 1))
    return np.unique(total)
