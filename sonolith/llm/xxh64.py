"""XXH64 of many byte spans at once, in numpy."""

from __future__ import annotations

import numpy as np

# Fixed values of the published XXH64 algorithm.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)

#: Bytes that a buffer needs behind its last span, for whole-word loads.
PAD = 8


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotl(acc + word * P2, 31) * P1


def xxh64(buffer: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hash of ``buffer[start:start + size]`` for each span; the uint8 buffer has PAD bytes to spare."""
    words = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer.data, strides=(1,))
    halves = np.ndarray(len(buffer) - 3, dtype="<u4", buffer=buffer.data, strides=(1,))
    seed_ = np.uint64(seed)
    at, left = start.astype(np.int64), size.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed_ + P5, dtype=np.uint64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            acc = [np.full(len(long), v, dtype=np.uint64) for v in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
            pos, stripes = at[long].copy(), left[long] // 32
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for i in range(4):
                    acc[i][on] = _lane(acc[i][on], words[pos[on] + 8 * i])
                pos[on] += 32
            merged = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for v in acc:
                merged = (merged ^ _lane(np.uint64(0), v)) * P1 + P4
            h[long] = merged
            at = at.copy()
            at[long] += 32 * stripes
            left = left % 32 if len(long) == len(left) else np.where(left >= 32, left % 32, left)
        h += size.astype(np.uint64)
        for k in range(3):
            on = np.flatnonzero(left >= 8 * (k + 1))
            if len(on):
                h[on] = _rotl(h[on] ^ _lane(np.uint64(0), words[at[on] + 8 * k]), 27) * P1 + P4
        at, left = at + (left & ~7), left & 7
        on = np.flatnonzero(left >= 4)
        if len(on):
            h[on] = _rotl(h[on] ^ (halves[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
        at, left = at + (left & 4), left & 3
        for k in range(3):
            on = np.flatnonzero(left > k)
            if len(on):
                h[on] = _rotl(h[on] ^ (buffer[at[on] + k].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
