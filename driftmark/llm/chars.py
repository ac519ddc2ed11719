"""Texts as arrays of code points."""

from __future__ import annotations

from functools import cache

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def folded_letters(digits: bool) -> np.ndarray:
    """Lower-case code point of each letter (with digits, of each digit too) of the basic plane, and 32 for all else."""
    table = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        table[i] = _folded(i, digits)
    return table


def _folded(point: int, digits: bool) -> int:
    c = chr(point)
    return ord(c.lower()[0]) if c.isalpha() or digits and c.isalnum() else 32


def folded(points: np.ndarray, digits: bool) -> np.ndarray:
    """Lower-case letters (and digits) of all planes; 32 stands for any other character."""
    out = folded_letters(digits)[np.minimum(points, (1 << 16) - 1)]
    high = points >= 1 << 16
    if high.any():
        distinct, place = np.unique(points[high], return_inverse=True)
        out[high] = np.array([_folded(int(p), digits) for p in distinct], np.uint32)[place]
    return out


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each run of n values."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(size, np.uint64)
    for i in range(n):
        key = (key + points[i : i + size].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(31))
