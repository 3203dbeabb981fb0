"""XXH64 of many slices of one byte buffer at once (numpy, public algorithm)."""

from __future__ import annotations

import numpy as np
import xxhash

# XXH64's fixed primes.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

#: Longer slices are hashed one by one; below, all of a length class together.
LONG = 1024


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def _merge(acc, v):
    return (acc ^ _round(np.zeros_like(v), v)) * P1 + P4


def xxh64_slices(data: bytes, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hash of data[s:s+n] for every (s, n), as uint64."""
    buf = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    u64 = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    u32 = np.ndarray((len(buf) - 3,), dtype="<u4", buffer=buf, strides=(1,))
    with np.errstate(over="ignore"):
        seed64 = np.uint64(seed)
        pos, rem = starts.astype(np.int64), lens.astype(np.int64)
        acc = np.full(len(pos), seed64 + P5, dtype=np.uint64)
        big = np.flatnonzero((rem >= 32) & (rem <= LONG))
        if big.size:
            v = [np.full(big.size, x, dtype=np.uint64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            stripes = rem[big] // 32
            for s in range(int(stripes.max())):
                at = np.flatnonzero(stripes > s)
                p = pos[big[at]] + 32 * s
                for j in range(4):
                    v[j][at] = _round(v[j][at], u64[p + 8 * j])
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = _merge(h, x)
            acc[big] = h
            pos[big] += 32 * stripes
            rem[big] -= 32 * stripes
        acc += lens.astype(np.uint64)
        short = lens <= LONG
        for _ in range(3):
            at = np.flatnonzero((rem >= 8) & short)
            if not at.size:
                break
            k = _round(np.zeros(at.size, dtype=np.uint64), u64[pos[at]])
            acc[at] = _rotl(acc[at] ^ k, 27) * P1 + P4
            pos[at] += 8
            rem[at] -= 8
        at = np.flatnonzero((rem >= 4) & short)
        acc[at] = _rotl(acc[at] ^ (u32[pos[at]].astype(np.uint64) * P1), 23) * P2 + P3
        pos[at] += 4
        rem[at] -= 4
        for _ in range(3):
            at = np.flatnonzero((rem > 0) & short)
            if not at.size:
                break
            acc[at] = _rotl(acc[at] ^ (buf[pos[at]].astype(np.uint64) * P5), 11) * P1
            pos[at] += 1
            rem[at] -= 1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        acc ^= acc >> np.uint64(32)
    for i in np.flatnonzero(~short):
        acc[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + lens[i]], seed)
    return acc
