"""Whole-array hashing for code that runs inside tasks."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class Lookup:
    """Open-addressed table from 64-bit keys to values, filled and read as whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, dtype=U64)
        self.values = np.full(size, np.nan)
        left, at = keys.astype(U64), self._place(keys.astype(U64))
        values = values.astype(float)
        while len(left):
            free = np.isnan(self.values[at])
            first = np.unique(at[free], return_index=True)[1]
            put = np.nonzero(free)[0][first]
            self.keys[at[put]], self.values[at[put]] = left[put], values[put]
            rest = np.ones(len(left), dtype=bool)
            rest[put] = False
            left, values, at = left[rest], values[rest], (at[rest] + 1) & (size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> U64(29))) * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where a key is missing."""
        at = self._place(keys)
        value = self.values[at]
        there = self.keys[at] == keys
        out = np.where(there, value, np.nan)
        left = np.nonzero(~there & ~np.isnan(value))[0]
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            there, value = self.keys[at] == keys[left], self.values[at]
            out[left[there]] = value[there]
            go = ~there & ~np.isnan(value)
            left, at = left[go], at[go]
        return out
