"""A read-only map from 64-bit keys to row numbers for whole arrays of keys at once."""

from __future__ import annotations

import numpy as np

from palimpsest.llm.common import ship_by_value

ship_by_value(__name__)

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class HashIndex:
    """Keys sorted by hash, with an index over the hash's leading bits, so that a look-up touches few places."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 2).bit_length()))
        hashed = keys * MULTIPLIER
        self.row = np.argsort(hashed, kind="stable").astype(np.int32)
        self.hashed = hashed[self.row]
        self.start = np.searchsorted(self.hashed >> self.shift, np.arange((1 << int(np.uint64(64) - self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        if not len(self.hashed):
            return np.full(len(keys), -1, np.int32)
        hashed = keys * MULTIPLIER
        slot = (hashed >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        top = len(self.hashed) - 1
        hit = (self.hashed[np.minimum(at, top)] == hashed) & (at < end)
        out = np.where(hit, self.row[np.minimum(at, top)], np.int32(-1))
        left = np.flatnonzero(~hit & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.hashed[at[left]] == hashed[left]
            out[left[hit]] = self.row[at[left[hit]]]
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return out
