"""Per-worker results for distinct words.

A tokenizer that never looks across blanks gives a word the same ids wherever it stands. Tasks
therefore look at the distinct words of a chunk only, and keep results of words already seen in a
bounded cache that lives as long as the Python worker. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

CACHE_WORDS = 1_000_000


class WordCache:
    """Word hash -> a run of unsigned values; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = CACHE_WORDS, dtype=np.uint16):
        self.limit, self.dtype = limit, dtype
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.dtype)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == hashes

    def lookup(self, hashes: np.ndarray, word_at, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values for ascending distinct ``hashes``: begin, size, pool.

        ``word_at(k)`` is the k-th word as bytes; ``encode(words)`` gives a list of value lists.
        """
        at, known = self._find(hashes)
        if not known.all():
            if len(self.keys) > self.limit:
                self._clear()
                known = np.zeros(len(hashes), bool)
            new = np.flatnonzero(~known)
            values = encode([word_at(k) for k in new])
            sizes = np.fromiter(map(len, values), np.int32, len(values))
            begins = len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes
            flat = np.fromiter((x for v in values for x in v), self.dtype, int(sizes.sum()))
            place = np.searchsorted(self.keys, hashes[new])
            self.keys = np.insert(self.keys, place, hashes[new])
            self.begin, self.size = np.insert(self.begin, place, begins), np.insert(self.size, place, sizes)
            self.pool = np.concatenate([self.pool, flat])
            at, _ = self._find(hashes)
        return self.begin[at], self.size[at], self.pool


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all values of consecutive runs (begin, size)."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(begin - (ends - size), size)
