"""Hashes of words and of word sequences, for a whole text at once.

A polynomial hash of all prefixes gives that of any stretch by one subtraction, so that the
hashes of all phrases of a text take one pass.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_WRAP = (1 << 64) - 1


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, made as far as they are needed."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, 1 << 64)
        self.tables = [np.ones(1, np.uint64)] * 2

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << max(12, (n - 1).bit_length())
            self.tables = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in self.bases]
        return self.tables[0][:n], self.tables[1][:n]


_BYTES, _WORDS = _Powers(_BASE | 1), _Powers(_STEP | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text (UTF-8 bytes) start and end."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[text]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    up, down = _BYTES(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(words: np.ndarray, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of the n words from each start."""
    up, down = _WORDS(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mixed((total[start + n] - total[start]) * down[start])
