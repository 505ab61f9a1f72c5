"""Pieces of text before byte-level BPE, found for many texts at once in numpy.

Gives the matches of PATTERN, which both public byte-level vocabularies use.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points of the first four planes.
_PLANES = 0x40000
# Unicode's White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions of the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Fixed value: the pattern whose matches are found here.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A surrogate, which no text has, goes between pieces; base of the polynomial hash.
_MARK, _BASE = 0xDC00, np.uint64(0x9E3779B97F4A7C15)


def _matching(pattern: str, text: str) -> list[int]:
    """Code points of the text that match, by the regular expressions of the tokenizers library."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    left = {ch for piece, _ in Split(Regex(pattern), behavior="removed").pre_tokenize_str(text) for ch in piece}
    return [ord(ch) for ch in text if ch not in left]


@cache
def classes() -> np.ndarray:
    """For each code point: letter, number, white space or other.

    Python's tables may be older than the library's, so code points that Python does not know are
    asked of the library; those behind the fourth plane are no text.
    """
    kind = {"L": LETTER, "N": NUMBER}
    name = [unicodedata.category(chr(i)) for i in range(_PLANES)]
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    out[:_PLANES] = [kind.get(c[0], OTHER) for c in name]
    unknown = "".join(chr(i) for i, c in enumerate(name) if c == "Cn")
    for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        out[_matching(pattern, unknown)] = k
    out[WHITE_SPACE] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def boundaries(cp: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of texts laid end to end; doc_at: where each text starts, and the end."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[cp]
    new_doc = np.zeros(n + 1, dtype=bool)
    new_doc[doc_at] = True
    start = new_doc[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before other text: a space goes with what follows, any other stands alone
    turn = np.flatnonzero(start[1:] & ~new_doc[1:n] & (kind[:-1] == SPACE)) + 1
    start[turn - 1] = True
    start[turn[cp[turn - 1] == 0x20]] = False
    # an apostrophe that begins a piece takes a contraction with it; the letters after that begin a piece
    quote = np.flatnonzero((cp == 0x27) & start)
    for end in sorted(CONTRACTIONS, key=len):
        k = len(end)
        at = quote[quote + k < n]
        for i, ch in enumerate(end):
            at = at[(cp[at + 1 + i] == ord(ch)) & ~new_doc[at + 1 + i]]
        start[at + 1] = False
        rest = at[at + 1 + k < n] + 1 + k
        start[rest[kind[rest] == LETTER]] = True
        quote = np.setdiff1d(quote, at, assume_unique=True)
    return np.flatnonzero(start)


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where each piece starts in them, and the end, and the first piece of each text, and the end."""
    cp = code_points("".join(texts))
    doc_at = np.concatenate(([0], np.cumsum(np.array([len(t) for t in texts], dtype=np.int64))))
    at = boundaries(cp, doc_at)
    return cp, np.append(at, len(cp)), np.searchsorted(at, doc_at)


def strings(cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[str]:
    """The spans as strings."""
    if not len(start):
        return []
    end = np.cumsum(size + 1)
    flat = np.full(int(end[-1]) - 1, _MARK, dtype=np.uint32)
    into = np.repeat(end - size - 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    flat[into] = cp[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(chr(_MARK))


@cache
def _hashed() -> np.ndarray:
    """A random number for each code point."""
    return np.random.default_rng(64).integers(1, 1 << 64, sys.maxunicode + 1, dtype=np.uint64)


def hashes(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A polynomial hash of each piece, and each code point's place in its piece."""
    size = np.diff(at)
    place = np.arange(len(cp)) - np.repeat(at[:-1], size)
    power = np.full(int(size.max()) + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    return np.add.reduceat(_hashed()[cp] * np.cumprod(power)[place], at[:-1]), place


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces in order, and where each text's pieces start, and the end."""
    cp, at, first = spans(texts)
    return strings(cp, at[:-1], np.diff(at)), first
