"""Words and their hashes straight from UTF-8 bytes, vectorised.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. All separators are single
ASCII bytes, so working on bytes equals working on code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_EXACT = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _EXACT[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, factor in enumerate((_BASE, _INVERSE)):
            p = np.full(n, factor, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray, fold: bool = True) -> np.ndarray:
    """S with S[i] the polynomial hash sum of data[:i], A-Z as lower case if `fold`; see span_hash()."""
    power, _ = _power(max(1 << 20, len(data)) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _EXACT)[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal spans have equal hashes wherever they lie."""
    _, inverse = _power(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Words:
    """The words of the documents data[offsets[i]:offsets[i+1]], in order; count has their number per document."""
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    first[bounds] = inside[bounds]
    last[bounds - 1] = inside[bounds - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    count = np.diff(np.searchsorted(start, offsets))
    doc = np.repeat(np.arange(len(offsets) - 1), count)
    return Words(start, end, doc, count, span_hash(prefix_sums(data), start, end) if hashed else np.zeros(0, np.uint64))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, number per document) of runs of `size` words; a document of fewer words, but some, has one
    made of all its words."""
    n, one = len(w.hash), np.uint64(_BASE)
    first = np.cumsum(w.count) - w.count
    number = np.where(w.count >= size, w.count - size + 1, (w.count > 0).astype(np.int64))
    value = np.zeros(n, np.uint64)
    left = np.repeat(first + w.count, w.count) - np.arange(n)
    for k in range(size):
        part = np.zeros(n, np.uint64)
        part[: n - k] = w.hash[k:]
        value = value * one + np.where(left > k, part, np.uint64(k + 1))
    at = np.arange(int(number.sum())) + np.repeat(first - (np.cumsum(number) - number), number)
    return mix(value[at]), np.repeat(np.arange(len(w.count)), number), number
