"""Majority votes over the bits of many hashes, by document."""

from __future__ import annotations

import numpy as np

#: A byte's eight bits, first bit first, each in a byte of its own, so that sums of up to 255 rows don't overflow.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def votes(rows: np.ndarray, number: np.ndarray, weight: np.ndarray | None = None, heaviest: int = 1) -> np.ndarray:
    """How much weight has each bit set, per document: int64 of shape (documents, 8 * bytes a row).

    rows: uint8 of shape (hashes, bytes a row), documents one after the other, number of them each. weight: whole
    numbers from 1 to `heaviest` (by default all 1).
    """
    docs, width = len(number), rows.shape[1]
    out = np.zeros((docs, width * 8), np.int64)
    full = np.flatnonzero(number)
    if not len(full):
        return out
    most, count = 255 // heaviest, number[full]
    parts = -(-count // most)
    first = np.cumsum(count) - count
    within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = np.repeat(first, parts) + within * most
    start = np.cumsum(parts) - parts
    for k in range(width):
        spread = _SPREAD[rows[:, k]]
        if weight is not None:
            spread = spread * weight.astype(np.uint64)
        sums = np.add.reduceat(spread, cut).view(np.uint8).reshape(-1, 8)
        out[full, k * 8 : k * 8 + 8] = np.add.reduceat(sums, start, axis=0, dtype=np.int64)
    return out
