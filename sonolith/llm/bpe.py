"""Byte-level BPE by rank, on padded numpy matrices.

The distinct pieces of a batch lie in matrices of similar length, one row a piece, one column a
token. Each round looks up the rank of every adjacent pair in a hash table, merges in each row the
leftmost pair of least rank, closes the gap, and takes out the rows that have no pair left. A piece
over LONG_BYTES is a matrix of one row, whose rounds merge every place of the least pair.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonolith.llm.common import arrow_map, named, starts_of, text_chunks
from sonolith.llm.piece_ids import PIECE_CHARS, PieceIds, gathered

#: Bytes from which a piece has a matrix of its own, in which a round merges every place of the least pair.
LONG_BYTES = 256
_NONE = np.uint32(0xFFFFFFFF)


class PairTable:
    """(left, right) -> rank of the two joined, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        size = 1 << int(len(rank) * 2 + 2).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.ranks = np.full(size, _NONE, dtype=np.uint32)
        key = self._key(left, right)
        slot, todo, self.reach = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.reach += 1
            free = todo[self.keys[slot[todo]] == 0xFFFFFFFFFFFFFFFF]
            self.keys[slot[free]] = key[free]  # of those that meet in a slot the last stays
            got = free[self.keys[slot[free]] == key[free]]
            self.ranks[slot[got]] = rank[got]
            todo = np.setdiff1d(todo, got, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = key * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) >> np.uint64(7) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, the greatest uint32 where there is none."""
        key = self._key(left, right).ravel()
        slot = self._slot(key)
        out = np.full(len(key), _NONE, dtype=np.uint32)
        todo = np.arange(len(key))
        for _ in range(self.reach):
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held != 0xFFFFFFFFFFFFFFFF)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        return out.reshape(left.shape)


class Ranks:
    """A rank file: tokens, the pairs that join to one, and their bytes for decoding."""

    def __init__(self, path: str) -> None:
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a rank file needs all 256 single bytes")
        joins = [(self.rank[t[:i]], self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        left, right, rank = (np.array(x, dtype=np.uint32) for x in zip(*joins, strict=True))
        self.pairs = PairTable(left, right, rank)
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.uint32)
        top = max(self.rank.values()) + 1
        spelled = [b""] * top
        for t, r in self.rank.items():
            spelled[r] = t
        self.size = np.array([len(t) for t in spelled], dtype=np.int64)
        self.at = starts_of(self.size)
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        matrix = []
        for i, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                out[i] = np.array([r], dtype=np.uint32)
            elif len(p) > LONG_BYTES:
                out[i] = self._merge_long(p)
            elif p:
                matrix.append(i)
            else:
                out[i] = np.zeros(0, dtype=np.uint32)
        order = np.array(matrix, dtype=np.int64)
        order = order[np.argsort(sizes[order], kind="stable")]
        low = 0
        while low < len(order):  # a bucket: lengths within a quarter of each other, 1 MB of tokens
            width = int(sizes[order[low]]) * 5 // 4 + 1
            high = int(np.searchsorted(sizes[order], width, side="right"))
            high = min(high, low + max(1, (1 << 18) // width))
            rows = order[low:high]
            self._merge([pieces[i] for i in rows], rows, out)
            low = high
        return out

    def _merge(self, pieces: list[bytes], rows: np.ndarray, out: list) -> None:
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        tokens = np.full((len(pieces), int(size.max())), _NONE, dtype=np.uint32)
        tokens[np.arange(tokens.shape[1])[None, :] < size[:, None]] = self.byte_rank[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = self._pair_ranks(tokens)
        while len(rows):
            best = rank.argmin(axis=1)  # the leftmost of equal ones
            line = np.arange(len(rows))
            least = rank[line, best]
            over = least == _NONE
            if over.any():
                for i in np.flatnonzero(over):
                    out[rows[i]] = tokens[i, : size[i]].copy()
                on = ~over
                width = int(size[on].max()) if on.any() else 1
                rows, size, best, least = rows[on], size[on], best[on], least[on]
                tokens, rank = tokens[on, :width], rank[on, : max(width - 1, 1)]
                line = line[: len(rows)]
                if not len(rows):
                    return
            # close the gap behind each merged pair
            width = tokens.shape[1]
            source = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > best[:, None])
            tokens = np.take_along_axis(tokens, source, axis=1)
            tokens[line, best] = least
            size = size - 1
            if width - 1 < 2:
                rank = np.full((len(rows), 1), _NONE, dtype=np.uint32)
                continue
            # pairs but the two that touch the merged token keep their rank
            pair = np.arange(width - 2)[None, :]
            rank = np.take_along_axis(rank, pair + (pair > best[:, None]), axis=1)
            for shift in (-1, 0):
                at = best + shift
                on = np.flatnonzero((at >= 0) & (at < width - 2))
                a, b = tokens[on, at[on]], tokens[on, at[on] + 1]
                rank[on, at[on]] = np.where(b == _NONE, _NONE, self.pairs.find(a, b))

    def _pair_ranks(self, tokens: np.ndarray) -> np.ndarray:
        if tokens.shape[1] < 2:
            return np.full((len(tokens), 1), _NONE, dtype=np.uint32)
        a, b = tokens[:, :-1], tokens[:, 1:]
        return np.where(b == _NONE, _NONE, self.pairs.find(a, b))

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for a long piece, a matrix of one row: a round merges all places of the least pair.

        From left to right and without overlap, that is what as many rounds of one merge would do, as
        long as no new pair has a lesser rank; places from the first that would give one wait.
        """
        row = self.byte_rank[np.frombuffer(piece, dtype=np.uint8)]
        rank = self.pairs.find(row[:-1], row[1:])
        while len(rank) and (least := rank.min()) != _NONE:
            at = np.flatnonzero(rank == least)
            # of places that touch, every second one
            turn = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
            at = at[(np.arange(len(at)) - np.repeat(turn, np.diff(turn, append=len(at)))) % 2 == 0]
            while True:
                gone = np.ones(len(row), dtype=bool)
                gone[at + 1] = False
                new = row.copy()
                new[at] = least
                new = new[gone]
                place = at - np.arange(len(at))  # of the merged tokens
                left, right = place[place > 0] - 1, place[place < len(new) - 1]
                before, after = np.full(len(at), _NONE), np.full(len(at), _NONE)
                before[place > 0] = self.pairs.find(new[left], new[left + 1])
                after[place < len(new) - 1] = self.pairs.find(new[right], new[right + 1])
                low = np.flatnonzero(np.minimum(before, after) <= least)
                if not len(low) or len(at) == 1:
                    break
                at = at[: max(1, int(low[0]))]
            held = np.delete(rank, at)
            held[left] = before[place > 0]
            held[right] = after[place < len(new) - 1]
            row, rank = new, held
        return row

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids."""
        return gathered(self.spelled, self.at[ids], self.size[ids]).tobytes()

    def decode_spans(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids, and where those of the spans at ``at`` begin, and the end."""
        return self.decode(ids), starts_of(self.size[ids])[at]


@cache
def ranks(path: str) -> Ranks:
    """One table a worker process."""
    return Ranks(path)


@cache
def _pieces_of(path: str) -> PieceIds:
    table = ranks(path)

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = table.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])
        return np.concatenate(ids), starts_of(np.array([len(x) for x in ids], dtype=np.int64))

    return PieceIds(encode)


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one behind the other (uint32), and where each text's start, and the end."""
    return _pieces_of(path).ids(texts)


def encode_rows(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids of each whole text and, decoded from them, its bytes.

    Null texts count as empty and have no ids; the text of a special token is ordinary text.
    Repeated rows give repeated rows, an empty table an empty one; other columns are not looked at.
    """

    def columns(ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        spelled, byte_at = ranks(path).decode_spans(ids, at)
        return [
            pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32))),
            pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(byte_at.astype(np.int32)), pa.py_buffer(spelled)]),
        ]

    return _encoded(df, path, id_col, text_col, columns, {"ids": "array<int>", "decoded": "binary"})


def encode_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what ``encode_rows`` gives, hashed where it is made."""

    def hashes(data: bytes, at: np.ndarray) -> pa.Array:
        whole = memoryview(data)
        return pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())

    def columns(ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.diff(at)), hashes(ids.astype("<u4").tobytes(), 4 * at), hashes(*ranks(path).decode_spans(ids, at))]

    return _encoded(df, path, id_col, text_col, columns, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def _encoded(df: DataFrame, path: str, id_col: str, text_col: str, columns: Callable[[np.ndarray, np.ndarray], list[pa.Array]], kinds: dict[str, str]) -> DataFrame:
    """The id and ``columns`` of each row's ids, a chunk of texts at a time."""
    source = named(df, id_col, text_col)
    id_type = source.schema[0].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, texts in text_chunks(batch.column(1), PIECE_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *columns(*encode_texts(path, texts))], names=["id", *kinds])

    out = arrow_map(source, work, ", ".join(["id " + id_type, *(f"{c} {kind}" for c, kind in kinds.items())]))
    return out.toDF(id_col, *kinds)
