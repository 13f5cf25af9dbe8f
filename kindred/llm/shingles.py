"""Hashed word shingles of whole texts, for a batch of texts at once in numpy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A shingle is a
64-bit hash of consecutive words. Two different shingles share a hash with probability 2^-64, which
can only matter where it falls into the comparison of two given texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kindred.llm.arrow import text_bytes

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64: fixed constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U))
_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept between batches."""
    global _powers, _inverses
    if len(_powers) < n:
        for name, base in (("_powers", _BASE), ("_inverses", _BASE_INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers[:n], _inverses[:n]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start (one more entry than texts)."""
    data, bounds = text_bytes(column)
    if not len(data):
        return np.empty(0, _U), np.zeros(len(bounds), np.int64)
    inside = _IS_WORD[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after)
    powers, inverses = _weights(len(data))
    sums = np.cumsum(_BYTE[_LOWER[data]] * powers, dtype=_U)
    low = np.where(starts > 0, sums[starts - 1], _U(0))
    hashes = mix((sums[ends] - low) * inverses[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, bounds)


def shingles(column: pa.Array, size: int) -> list[np.ndarray]:
    """The shingles of each text in order, repeats included.

    A text with fewer words than `size` has its whole sequence as one shingle; a text without words
    (null, empty, white space) has none.
    """
    hashes, starts = words(column)
    joined = np.zeros(max(0, len(hashes) - size + 1), _U)
    for k in range(size):
        joined = mix(joined + hashes[k:k + len(joined)] * _U(2 * k + 3))
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= size:
            out.append(joined[a:b - size + 1])
        else:
            whole = np.full(min(1, b - a), b - a, _U)
            for k in range(a, b):
                whole = mix(whole + hashes[k:k + 1] * _U(2 * (k - a) + 3))
            out.append(whole)
    return out


def digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed longs: sums of scrambled members."""
    first = mix(members + _U(0x51)).sum(dtype=_U)
    second = mix(members ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)
    return int(first.astype(np.int64)), int(second.astype(np.int64))
