"""XXH64 of many byte runs at once (numpy), as in the published specification of the hash."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

#: Longer runs are hashed one by one by the library.
LONG = 512


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _u(r)) | (x >> _u(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hash of ``data[start:end]`` for each pair; ``data`` holds bytes."""
    with np.errstate(over="ignore"):
        return _xxh64(data, starts, ends, seed)


def _xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    length = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # Views of the same bytes as a word at every offset.
    u64 = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    u32 = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    out = np.full(len(starts), np.uint64(seed) + P5)
    at = starts.copy()
    wide = np.flatnonzero((length >= 32) & (length <= LONG))
    if len(wide):
        s = np.uint64(seed)
        acc = [np.full(len(wide), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
        stripes = length[wide] // 32
        for k in range(int(stripes.max())):
            live = np.flatnonzero(stripes > k)
            p = at[wide[live]] + 32 * k
            for lane in range(4):
                acc[lane][live] = _round(acc[lane][live], u64[p + 8 * lane])
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.zeros(len(wide), np.uint64), a)) * P1 + P4
        out[wide] = h
        at[wide] += 32 * stripes
    out += length.astype(np.uint64)
    rest = ends - at
    rest[length > LONG] = 0
    for k in range(3):
        live = np.flatnonzero(rest >= 8)
        if not len(live):
            break
        lane = _round(np.zeros(len(live), np.uint64), u64[at[live]])
        out[live] = _rotl(out[live] ^ lane, 27) * P1 + P4
        at[live] += 8
        rest[live] -= 8
    live = np.flatnonzero(rest >= 4)
    out[live] = _rotl(out[live] ^ (u32[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
    at[live] += 4
    rest[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(rest > 0)
        out[live] = _rotl(out[live] ^ (data[at[live]].astype(np.uint64) * P5), 11) * P1
        at[live] += 1
        rest[live] -= 1
    out ^= out >> _u(33)
    out *= P2
    out ^= out >> _u(29)
    out *= P3
    out ^= out >> _u(32)
    for i in np.flatnonzero(length > LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out
