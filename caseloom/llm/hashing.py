"""Hashes of words and of windows of words, in numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from .common import held

#: Words that a worker remembers the hashes of; beyond that it starts anew.
CACHE_WORDS = 300_000
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """bytes -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes() -> WordHashes:
    """A worker's own."""
    return held("hashes", None, WordHashes)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of polynomial hashes (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Windows:
    """Polynomial hashes of all windows of n words, by one prefix sum modulo 2**64."""

    def __init__(self, multiplier: int):
        self.p, self.q = multiplier, pow(multiplier, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.array([1] + [x] * (n - 1), np.uint64), dtype=np.uint64) for x in (self.p, self.q))

    def of(self, words: np.ndarray, n: int) -> np.ndarray:
        if len(words) < n:
            return np.zeros(0, np.uint64)
        self._powers(len(words) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.down[: len(words)], dtype=np.uint64)])
            last = len(words) - n + 1
            return mixed((sums[n:] - sums[:last]) * self.up[n - 1 : n - 1 + last])
