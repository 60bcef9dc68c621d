"""XXH64 of many byte ranges of one buffer at once (numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
# The five primes of XXH64.
P1 = U(11400714785074694791)
P2 = U(14029467366897019727)
P3 = U(1609587929392839161)
P4 = U(9650029242287828579)
P5 = U(2870177450012600261)
LONG = 512


def _rot(x, r):
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned hashes of buf[starts[i] : starts[i] + lengths[i]]."""
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    half = np.ndarray((len(data) - 3,), "<u4", buffer=data, strides=(1,))
    s = U(seed)
    with np.errstate(over="ignore"):
        acc = np.full(len(starts), s + P5, U)
        at, left = starts.astype(np.int64), lengths.astype(np.int64)
        big = np.flatnonzero((left >= 32) & (left <= LONG))
        if len(big):
            v = [np.full(len(big), x, U) for x in (s + P1 + P2, s + P2, s, s - P1)]
            stripes, place = left[big] // 32, at[big]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for j in range(4):
                    v[j][on] = _round(v[j][on], wide[place[on] + 32 * k + 8 * j])
            mixed = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                mixed = (mixed ^ _round(np.zeros_like(x), x)) * P1 + P4
            acc[big] = mixed
            at, left = at.copy(), left.copy()
            at[big] += 32 * stripes
            left[big] -= 32 * stripes
        acc += lengths.astype(U)
        on = np.flatnonzero((left >= 8) & (lengths <= LONG))
        while len(on):
            acc[on] = _rot(acc[on] ^ _round(U(0), wide[at[on]]), 27) * P1 + P4
            at[on] += 8
            left[on] -= 8
            on = on[left[on] >= 8]
        on = np.flatnonzero((left >= 4) & (lengths <= LONG))
        acc[on] = _rot(acc[on] ^ (half[at[on]].astype(U) * P1), 23) * P2 + P3
        at[on] += 4
        left[on] -= 4
        on = np.flatnonzero((left >= 1) & (lengths <= LONG))
        while len(on):
            acc[on] = _rot(acc[on] ^ (data[at[on]].astype(U) * P5), 11) * P1
            at[on] += 1
            left[on] -= 1
            on = on[left[on] >= 1]
        acc ^= acc >> U(33)
        acc *= P2
        acc ^= acc >> U(29)
        acc *= P3
        acc ^= acc >> U(32)
    for i in np.flatnonzero(lengths > LONG):
        acc[i] = xxhash.xxh64_intdigest(buf[starts[i]:starts[i] + lengths[i]].tobytes(), seed)
    return acc
