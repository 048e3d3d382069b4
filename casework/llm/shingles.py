"""Hashed word shingles of whole texts, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

PRIME = 0x9E3779B97F4A7C15
MOST_WORDS = 500_000


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before (and forgotten beyond MOST_WORDS, to bound memory)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: bytes | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text (ASCII lower case); a shorter text is one shingle, none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * np.uint64(PRIME) + w[j : len(w) - n + 1 + j]
    return np.unique(mixed(h))
