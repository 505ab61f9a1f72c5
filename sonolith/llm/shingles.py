"""Word shingles of many texts at once, hashed."""

from __future__ import annotations

import numpy as np

from sonolith.llm.common import starts_of
from sonolith.llm.xxh64 import PAD, xxh64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts and where each text starts: A-Z in lower case, words between white space (space, tab to CR), hashed by XXH64 with seed 42.

    Fewer words than a shingle has make one shingle; a text without words has none.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b" ".join(raw) + b" " * (PAD + 1), dtype=np.uint8)
    doc_at = starts_of(np.array([len(r) + 1 for r in raw], dtype=np.int64))
    space = _SPACE[buffer]
    # of each run of white space only the first byte stays, as a space
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[doc_at[1:-1] - 1] = True  # the byte between two texts always stays
    new_at = np.zeros(len(buffer) + 1, dtype=np.int64)
    np.cumsum(keep, out=new_at[1:])
    flat = np.where(space, np.uint8(32), _LOWER[buffer])[keep]
    flat = np.concatenate([flat, np.full(PAD, 32, np.uint8)])
    word = flat != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    doc_of = np.searchsorted(new_at[doc_at[1:]], begin, side="right")
    n = np.bincount(doc_of, minlength=len(texts))
    first = starts_of(n)
    shingles = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    at = starts_of(shingles)
    which = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], shingles)
    last = which + np.repeat(np.minimum(n, words), shingles) - 1
    return xxh64(flat, begin[which], end[last] - begin[which]), at
