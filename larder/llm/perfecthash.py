"""Minimal perfect hashing of 64-bit keys, level by level.

A level is a bit array somewhat larger than the number of keys that have come to it. A key that meets no other one at its
place sets the bit there and is settled; all others go on to the next level under another hash. A key's number is the
count of set bits before its own, so the numbers of n keys are exactly 0 to n - 1. A key that was never put in may also be
given a number: whoever looks up compares the key that the number stands for.
"""

from __future__ import annotations

import numpy as np

from larder.llm.textbuf import mix

SPACE = 2.0
_STEP = 0x9E3779B97F4A7C15


class PerfectHash:
    """Numbers 0 to n - 1 for n different keys, in about four bits a key."""

    def __init__(self, keys: np.ndarray, space: float = SPACE):
        left = np.ascontiguousarray(keys).astype(np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys of a perfect hash must differ")
        self.n = len(left)
        self.sizes: list[int] = []
        words = []
        while len(left):
            size = -(-max(64, int(space * len(left))) // 64) * 64
            at = self._place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=bool)
            bits[at[alone]] = True
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            self.sizes.append(size)
            left = left[~alone]
        self.words = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((_STEP * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1, or the number of another key, for a key that is not in the set."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        left = np.ascontiguousarray(keys).astype(np.uint64)
        base = 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self._place(left, level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            low = self.words[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[open_[found]] = self.before[word[found]] + np.bitwise_count(low)
            open_, left = open_[~found], left[~found]
            base += size >> 6
        return out


class KeyedCounts:
    """Whole numbers by key: a dense vector that a perfect hash indexes, with the keys beside it."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray | None = None):
        self.hash = PerfectHash(keys)
        at = self.hash.numbers(keys)
        self.keys = np.empty(len(keys), dtype=np.int64)
        self.keys[at] = keys
        self.counts = np.zeros(len(keys), dtype=np.int64)
        if counts is not None:
            self.counts[at] = counts

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add to the counts of different keys, all of the set."""
        at = self.hash.numbers(keys)
        if (at < 0).any() or (self.keys[at] != keys).any():
            raise KeyError("a key that the hash was not made of")
        self.counts[at] += counts

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys, 0 for those that are not in the set."""
        at = self.hash.numbers(keys)
        own = at >= 0
        own[own] = self.keys[at[own]] == keys[own]
        return np.where(own, self.counts[np.where(own, at, 0)], 0) if self.hash.n else np.zeros(len(keys), dtype=np.int64)
