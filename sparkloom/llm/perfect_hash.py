"""A minimal perfect hash over 128-bit hashes: levels of bit fields, each for the keys that fell together in the one before.

A key belongs to the first level in which no other key has its bit; its slot is the number of set bits before it. Three to
four bits a key; all steps are on whole arrays.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each of its keys, and levels, which double keys alone could exhaust.
SPACE, MOST_LEVELS = 2, 100


def mixed(high: np.ndarray, low: np.ndarray, number: int) -> np.ndarray:
    """Another 64-bit hash of (high, low) for each number."""
    h = high ^ (low + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        """sizes: bits of each level, in multiples of 64. words: the bits of all levels."""
        self.sizes, self.words = sizes, words
        self.starts = np.cumsum(sizes) - sizes
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """Over distinct keys."""
        sizes, levels = [], []
        while len(high):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-SPACE * len(high) // 64) * 64
            at = (mixed(high, low, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at]
            high, low = high[left], low[left]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.empty(0, "<u8"))

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each key; of one that does not belong any slot, or -1."""
        found, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for number, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist(), strict=True)):
            if not len(left):
                break
            at = start + (mixed(high[left], low[left], number) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            own = (word >> bit & np.uint64(1)).astype(bool)
            lower = word & ((np.uint64(1) << bit) - np.uint64(1))
            found[left[own]] = (self.before[at >> 6] + np.bitwise_count(lower))[own]
            left = left[~own]
        return found
