"""Numpy twin of Spark's ``xxhash64`` for an int followed by a long column."""

from __future__ import annotations

import numpy as np

from .xxh import P1, P2, P3, P4, P5, U, _rot, _round


def _fin(h):
    h = h ^ (h >> U(33))
    h = h * P2
    h = h ^ (h >> U(29))
    h = h * P3
    return h ^ (h >> U(32))


def hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = seed + P5 + U(8)
        h = _rot(h ^ _round(U(0), x), 27) * P1 + P4
        return _fin(h)


def hash_int(i: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(1, U(seed) + P5 + U(4), U)
        h = h ^ (np.full(1, i & 0xFFFFFFFF, U) * P1)
        h = _rot(h, 23) * P2 + P3
        return _fin(h)


def spark_xxhash64_pair(i: int, x: np.ndarray) -> np.ndarray:
    """F.xxhash64(lit(i), column) for int i and 64-bit values, unsigned."""
    return hash_long(x.astype(U), hash_int(i, 42))
