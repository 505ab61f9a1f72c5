"""Token ids of pieces, remembered by worker: each distinct piece is encoded once, texts are put together in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sonolith.llm.common import starts_of
from sonolith.llm.pieces import hashes, spans, strings

#: Pieces that a worker remembers at most, beside those of one batch; characters that are put together at a time.
REMEMBERED, PIECE_CHARS = 1_500_000, 1 << 21

#: New pieces -> their ids, one piece behind the other, and where each piece starts, and the end.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``data[start:start + size]`` of all spans, one behind the other."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return data[np.repeat(start - (end - size), size) + np.arange(total)]


class _Table:
    """Hash -> number of a piece, by open addressing."""

    def __init__(self, room: int) -> None:
        size = 1 << max(12, (2 * room).bit_length())
        self.mask, self.filled = np.uint64(size - 1), 0
        self.key, self.code = np.zeros(size, np.uint64), np.full(size, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number, -1 where there is none."""
        out = np.full(len(h), -1, dtype=np.int64)
        slot, todo = self._slot(h), np.arange(len(h))
        while len(todo):
            code = self.code[slot]
            hit = (code >= 0) & (self.key[slot] == h[todo])
            out[todo[hit]] = code[hit]
            on = ~hit & (code >= 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def put(self, h: np.ndarray, code: np.ndarray) -> None:
        """Different hashes that are not there yet, into a table that is half empty."""
        slot, todo = self._slot(h), np.arange(len(h))
        while len(todo):
            free = self.code[slot] < 0
            self.code[slot[free]] = code[todo[free]]  # of those that meet in a slot the last stays
            won = free & (self.code[slot] == code[todo])
            self.key[slot[won]] = h[todo[won]]
            todo, slot = todo[~won], (slot[~won] + np.uint64(1)) & self.mask
        self.filled += len(h)


class _Flat:
    """Spans one behind the other, in room that grows."""

    def __init__(self) -> None:
        self.data, self.at = np.zeros(1 << 12, np.uint32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, at: np.ndarray) -> None:
        old, new = int(self.at[-1]), int(self.at[-1]) + len(flat)
        if new > len(self.data):
            self.data = np.concatenate([self.data[:old], np.zeros(2 * new - old, np.uint32)])
        self.data[old:new] = flat
        self.at = np.concatenate([self.at, old + at[1:]])

    def only(self, held: np.ndarray) -> _Flat:
        out, size = _Flat(), np.diff(self.at)[held]
        out.add(gathered(self.data, self.at[:-1][held], size), starts_of(size))
        return out


class PieceIds:
    """Ids of pieces seen. When too many are remembered, the half that was used least goes.

    Pieces are looked up by hash and then compared with what is remembered, code point by code
    point; one whose hash belongs to another piece is encoded anew each time.
    """

    def __init__(self, encode: Encode, most: int | None = None) -> None:
        self.encode, self.most = encode, most
        self.table, self.hash = _Table(1 << 16), np.zeros(0, np.uint64)
        self.text, self.token = _Flat(), _Flat()
        self.used = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.used)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and where each text's start, and the end."""
        cp, at, first = spans(texts)
        if len(at) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        if len(self) > (self.most or REMEMBERED):
            self._forget()
        h, place = hashes(cp, at)
        code = self.table.find(h)
        new = np.flatnonzero(code < 0)
        if len(new):
            kinds, one, which = np.unique(h[new], return_index=True, return_inverse=True)
            code[new] = len(self) + which
            self._learn(cp, at, new[one], kinds)
        size = np.diff(at)
        wrong = np.diff(self.text.at)[code] != size
        like = np.where(wrong, 0, self.text.at[:-1][code])
        differs = cp != self.text.data[np.minimum(np.repeat(like, size) + place, len(self.text.data) - 1)]
        if wrong.any() or differs.any():
            other = np.flatnonzero(wrong | np.logical_or.reduceat(differs, at[:-1]))
            code[other] = len(self) + np.arange(len(other))
            self._learn(cp, at, other, None)
        self.used += np.bincount(code, minlength=len(self.used))
        size = np.diff(self.token.at)[code]
        return gathered(self.token.data, self.token.at[:-1][code], size), starts_of(size)[first]

    def _learn(self, cp: np.ndarray, at: np.ndarray, pieces: np.ndarray, h: np.ndarray | None) -> None:
        start, size = at[pieces], at[pieces + 1] - at[pieces]
        self.token.add(*self.encode(strings(cp, start, size)))
        self.text.add(gathered(cp, start, size), starts_of(size))
        codes = np.arange(len(self.used), len(self.used) + len(pieces))
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int64)])
        self.hash = np.concatenate([self.hash, np.zeros(len(pieces), np.uint64) if h is None else h])
        if h is not None:
            if 2 * (self.table.filled + len(h)) > len(self.table.code):
                self._index(int(codes[0]), len(h))
            self.table.put(h, codes)

    def _index(self, n: int, more: int = 0) -> None:
        """The table anew, of the first n pieces, with room for as many again and ``more``."""
        self.table = _Table(2 * n + more + (1 << 16))
        kinds, one = np.unique(self.hash[:n], return_index=True)
        self.table.put(kinds, one)

    def _forget(self) -> None:
        held = np.sort(np.argsort(-self.used, kind="stable")[: len(self.used) // 2])
        self.text, self.token = self.text.only(held), self.token.only(held)
        self.hash, self.used = self.hash[held], self.used[held] // 2
        self._index(len(held))
