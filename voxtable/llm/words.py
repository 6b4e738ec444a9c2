"""Words of a batch of texts as arrays: distinct words, their code points, and hashes of their parts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def tokens(texts: list[str], pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of words of each text, word numbers of all texts in order, the distinct words)."""
    found = [pattern.findall(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for x in found for w in x]
    codes, distinct = pd.factorize(flat)
    return sizes, codes.astype(np.int64), distinct.tolist()


class Spelling:
    """Code points of distinct words, each between two marks, laid end to end."""

    def __init__(self, words: list[str]) -> None:
        self.n = len(words)
        joined = "".join(["\x02" + w + "\x03" for w in words])
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.sizes = np.fromiter(map(len, words), np.int64, self.n) + 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(self.n), self.sizes)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n code points from each place on, and whether they lie within one word."""
        h = np.full(len(self.points), n * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for k in range(n):
            h[: len(h) - k] = (h[: len(h) - k] ^ self.points[k:]) * np.uint64(0x100000001B3)
        last = np.arange(len(h)) + n - 1
        inside = last < (self.starts + self.sizes)[self.word] if self.n else np.zeros(0, bool)
        return mix(h), inside

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word's first n code points, and whether it has more than that."""
        h = np.full(self.n, n * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
        last = max(len(self.points) - 1, 0)
        for k in range(1, n + 1):
            h = (h ^ self.points[np.minimum(self.starts + k, last)]) * np.uint64(0x100000001B3)
        return mix(h), self.sizes - 2 >= n

    def whole(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not self.n:
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.points)) - self.starts[self.word]
        with np.errstate(over="ignore"):
            terms = mix(self.points + mix((place + 1).astype(np.uint64)))
            return mix(np.add.reduceat(terms, self.starts))
