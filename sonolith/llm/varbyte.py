"""Token files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

The vocabulary is one array of uint32 for all files: the id of each rank; rank 0 is the most frequent
id of the whole corpus. A file is blocks, each behind its size as int64. A block holds documents in
order of id:

    magic, int64 documents, int64 ids
    documents x int64     document id        documents x uint8   1 where the document id is null
    documents x int64     number of ids
    control bytes         four ids a byte, two bits each: data bytes of the rank, less one
    data bytes            ranks, lowest byte first

A control byte looked up in a table gives the four lengths, so a block is decoded by table lookup,
one cumulative sum and one gather for each byte place.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"SNLTOK02"
_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)


def ranked(counts: np.ndarray) -> np.ndarray:
    """Ids that occur, most frequent first, ties by id."""
    used = np.flatnonzero(counts)
    return used[np.lexsort((used, -counts[used]))].astype(np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    code = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    take = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[take].tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of control and data bytes (uint8 arrays)."""
    size = _LENGTHS[control].ravel()[:n]
    end = np.cumsum(size, dtype=np.int64)
    begin = end - size
    out = data[begin].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        on = np.flatnonzero(size > k)
        out[on] |= data[begin[on] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def rank_table(vocabulary: np.ndarray) -> np.ndarray:
    """Rank of each id, for ids that are in the vocabulary."""
    out = np.zeros(int(vocabulary.max()) + 1 if len(vocabulary) else 1, dtype=np.uint32)
    out[vocabulary] = np.arange(len(vocabulary), dtype=np.uint32)
    return out


def pack(docs: np.ndarray, none: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    """A whole block of documents' ranks, one behind the other."""
    control, data = encode(ranks)
    head = np.array([len(docs), len(ranks)], dtype="<i8")
    return b"".join((MAGIC, head.tobytes(), docs.astype("<i8").tobytes(), none.astype(np.uint8).tobytes(), sizes.astype("<i8").tobytes(), control, data))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are null, ranks of each document, and all ranks."""
    if blob[:8] != MAGIC:
        raise ValueError("not a block of a token file")
    docs, n = (int(x) for x in np.frombuffer(blob, dtype="<i8", count=2, offset=8))
    at = 24

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype=dtype, count=count, offset=at)
        at += out.nbytes
        return out

    ids, none, sizes = take("<i8", docs), take("u1", docs), take("<i8", docs)
    control = take("u1", -(-n // 4))
    data = take("u1", len(blob) - at)
    if int(_LENGTHS[control].ravel()[:n].sum(dtype=np.int64)) != len(data):
        raise ValueError("block is cut short")
    return ids, none.astype(bool), sizes, decode(control, data, n)
