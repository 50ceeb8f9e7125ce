"""Minimal perfect hash functions over sets of 64-bit keys."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from weekloom.llm.words import mix, random_words

#: Bits of a level for each key that gets there.
_ROOM = 2
_LEVELS = random_words(256, 23)
_ONE = np.uint64(1)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ _LEVELS[level]) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """Numbers from 0 to n - 1 for n different keys; any other key gets some number, or -1.

    A level has a bit for every place that just one of its keys hashes to; the other keys go on to the next
    level. A key's number is the count of bits before its own. All levels lie one after another in `bits`.
    """

    sizes: list[int]
    bits: np.ndarray  # 64-bit words
    before: np.ndarray  # bits set before each of them

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """`keys` are different from each other."""
        sizes, levels = [], []
        left = keys
        while len(left):
            if len(sizes) == len(_LEVELS):
                raise ValueError("keys of a perfect hash have to be different")
            size = -(-_ROOM * len(left) // 64) * 64
            place = _places(left, len(sizes), size)
            count = np.bincount(place, minlength=size)
            levels.append(np.packbits(count == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[count[place] > 1]
        bits = np.concatenate(levels) if levels else np.empty(0, np.uint64)
        counts = np.bitwise_count(bits).astype(np.int64)
        return cls(sizes, bits, (np.cumsum(counts) - counts).astype(np.uint32))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        offset = 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            place = _places(keys[left], level, size) + offset
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            there = (word >> bit) & _ONE == _ONE
            lower = word & ((_ONE << bit) - _ONE)
            rank = self.before[place >> 6] + np.bitwise_count(lower)
            out[left[there]] = rank[there]
            left = left[~there]
            offset += size
        return out
