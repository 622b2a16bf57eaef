"""Minimal perfect hash over 64-bit keys: levels of bit arrays with ranks, built and read with numpy.

Each level hashes the keys that are left into gamma bits a key; keys alone in their bit are placed there, the others
go on to the next level. A key's number is the rank of its bit, so n keys get 0..n-1. 16-bit fingerprints stored in
that order reject keys that were never added (wrongly accepted: 1 of 65,536; callers that must not err compare keys).
"""

from __future__ import annotations

import io

import numpy as np

from pointlake.llm.bytetext import mix

GAMMA = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + _STEP * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], fingerprints: np.ndarray):
        self.levels, self.fingerprints = levels, fingerprints

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: distinct unsigned 64-bit values."""
        left, levels, placed = keys.astype(np.uint64), [], 0
        if len(np.unique(left)) != len(left):
            raise ValueError("keys must be distinct")
        while len(left):
            slot = _slot(left, len(levels), size := max(1, GAMMA * len(left)))
            alone = np.bincount(slot, minlength=size) == 1
            levels.append((alone, placed + np.cumsum(alone) - alone))
            placed += int(alone.sum())
            left = left[~alone[slot]]
        out = cls(levels, np.zeros(len(keys), np.uint16))
        out.fingerprints[out._rank(keys.astype(np.uint64))] = cls._print(keys.astype(np.uint64))
        return out

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ _STEP) >> np.uint64(48)).astype(np.uint16)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(left):
                break
            slot = _slot(keys[left], level, len(alone))
            hit = alone[slot]
            out[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those whose stored fingerprint differs."""
        keys = keys.astype(np.uint64)
        at = self._rank(keys)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == self._print(keys[known])
        return np.where(known, at, -1)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, fingerprints=self.fingerprints, **{f"level{k}": np.packbits(a) for k, (a, _) in enumerate(self.levels)}, sizes=np.array([len(a) for a, _ in self.levels], np.int64))
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> MinimalPerfectHash:
        got = np.load(io.BytesIO(data))
        levels, placed = [], 0
        for k, size in enumerate(got["sizes"]):
            alone = np.unpackbits(got[f"level{k}"], count=int(size)).astype(bool)
            levels.append((alone, placed + np.cumsum(alone) - alone))
            placed += int(alone.sum())
        return cls(levels, got["fingerprints"])
