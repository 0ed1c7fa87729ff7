"""Texts as arrays of code points, for feature hashing in numpy."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

#: Multiplier of the rolling hash (the golden ratio in 64 bits, odd).
K = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def class_table(digits: bool) -> np.ndarray:
    """For every code point whether it is a letter (or digit)."""
    of = str.isalnum if digits else str.isalpha
    return np.fromiter((of(chr(i)) for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def spaced(text: str, digits: bool = False) -> np.ndarray:
    """Lower-cased letters as code points, each stretch of anything else as one 32; begins and ends with 32."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    a = np.concatenate(([32], np.where(class_table(digits)[a], a, 32), [32]))
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
    return a[keep].astype(np.uint64)


def gram_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n code points; shorter input gives none."""
    if len(a) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(a) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ a[i : len(a) - n + 1 + i]) * K
        h ^= h >> np.uint64(29)
    return h
