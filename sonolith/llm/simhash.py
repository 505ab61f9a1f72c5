"""Near duplicates by SimHash: byte-position inverted index with count filtering.

A fingerprint has eight bytes, so eight positional bytes: (position, byte). Two fingerprints that
differ in two bits at most share at least six of them. A list for each single positional byte would
hold a 256th of all fingerprints, so lists are split by more positions, such that every pair with
six shared bytes still meets: the positions in four pairs, a list for each two of them (six lists a
fingerprint, of four positional bytes each). In a list the other four positions are tallied for each
pair of members; pairs that reach six with the four of the list go on and are verified by their
differing bits. A list over POSTING is split by two more of the other positions, six ways: there
the list itself makes up six shared bytes, and what is left, the verification, is done by looking up
each member's values at one and two bits, as such a list can hold 65,536 members.

For a similarity of shingle sets the fingerprints' links are only the beginning: see ``similar_components``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm import shingle_join
from sonolith.llm.common import arrow_map, cut, cut_narrow, if_few, keyed_lookup, named, runs, starts_of, text_chunks
from sonolith.llm.components import component_ids, component_roots
from sonolith.llm.shingles import shingle_hashes

#: Words of a shingle; bits that linked fingerprints may differ in.
WORDS, DISTANCE = 3, 2
#: Fingerprints of a list whose pairs are tallied. Ids that are broadcast at most.
POSTING, BROADCAST_IDS = 2048, 1_000_000
#: Positional bytes that two fingerprints share at least if they differ in DISTANCE bits.
SHARED = 8 - DISTANCE

#: For a byte, its bits as eight bytes of a word.
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).astype(np.uint8).view("<u8").ravel()


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    """SimHash of each text. A bit is set if it is set in over half of the shingles' hashes, repeats included; a text without words has fingerprint 0."""
    return majority(*shingle_hashes(texts, words))


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from its shingles' hashes."""
    n = np.diff(at)
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # sums of bytes don't overflow over 255 hashes
    pieces = -(-n[some] // 255)
    first = starts_of(pieces)
    chunk = np.repeat(at[some], pieces) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], pieces))
    as_bytes = h.view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(some), 64), dtype=np.int64)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[as_bytes[:, k]], chunk).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums, first[:-1], axis=0)
    bits = (2 * ones > n[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long."""
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = [fingerprints(texts) for _, texts in text_chunks(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(done).view(np.int64))], names=["id", "fp"])

    return arrow_map(named(df, id_col, text_col), work, f"id {id_type}, fp long")


def _bytes(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes at these positions, as one long."""
    out = F.lit(0).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
    return out


_PAIRS = [(0, 1), (2, 3), (4, 5), (6, 7)]
_KEYS = [a + b for a, b in combinations(_PAIRS, 2)]


def _key(fp: Column, k: int) -> Column:
    return _bytes(fp, _KEYS[k]).bitwiseOR(F.lit(k << 32).cast("long"))


def _finer(fp: Column, k: int) -> list[Column]:
    """The six keys by which a large posting of key k is refined."""
    rest = [p for p in range(8) if p not in _KEYS[k]]
    return [_bytes(fp, two).bitwiseOR(F.lit((i + 1) << 16).cast("long")) for i, two in enumerate(combinations(rest, 2))]


def _posting_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one list: tally the shared positional bytes of each pair, keep pairs with SHARED or more, verify."""
    if len(fp) > POSTING:
        return _dense_links(fp)
    by_position = fp.view(np.uint8).reshape(-1, 8)
    same = (by_position == by_position[0]).all(axis=0)
    found = []
    for i in range(0, len(fp), 256):
        tally = np.full((len(fp[i : i + 256]), len(fp)), same.sum(), dtype=np.uint8)
        for p in np.flatnonzero(~same):
            tally += by_position[i : i + 256, p, None] == by_position[None, :, p]
        a, b = np.nonzero(tally >= SHARED)
        a, b = a[a + i < b], b[a + i < b]
        near = np.bitwise_count(fp[a + i] ^ fp[b]) <= DISTANCE
        found.append((fp[a[near] + i], fp[b[near]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _dense_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a list that was split further, whose members share six bytes: verify by looking up each member's near values."""
    every = np.bitwise_or.reduce(fp ^ fp[0])
    bits = [np.uint64(1) << np.uint64(i) for i in range(64) if int(every) >> i & 1]
    masks = [*bits, *(x | y for x, y in combinations(bits, 2))]
    fp = np.sort(fp)
    found = []
    for m in masks:
        other = fp ^ m
        at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
        hit = (fp[at] == other) & (fp < other)
        found.append((fp[hit], other[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A posting's links as one edge from each linked fingerprint to the least of its component there."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = low.copy()
        np.minimum.at(least, x, low[y])
        np.minimum.at(least, y, low[x])
        least = least[least]
        if (least == low).all():
            break
        low = least
    off = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[off], nodes[low[off]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, sub, fp) in order of key: edges (a, b). Holds one posting at a time."""
    rest = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        cut_at = runs(cols[:2])
        yield from _edges(cols, cut_at[:-1])
        rest = [c[cut_at[-2] :] for c in cols]
    if rest is not None and len(rest[0]):
        yield from _edges(rest, runs(rest[:2]))


def _edges(cols: list[np.ndarray], cut_at: np.ndarray) -> Iterator[pa.RecordBatch]:
    fp = cols[2].view(np.uint64)
    found = []
    for g in np.flatnonzero(np.diff(cut_at) > 1):
        a, b = _posting_links(fp[cut_at[g] : cut_at[g + 1]])
        if len(a):
            found.append(_stars_of(a, b))
    if found:
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def link_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints ``fp`` of ``nodes``."""
    fp = F.col("fp")
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _key(fp, k).alias("key")) for k in range(6)])).alias("x")).select("fp", "x.k", "x.key")
    large = keyed.groupBy("key").count().where(F.col("count") > POSTING).select("key", F.lit(True).alias("large"))
    finer = F.lit(None).cast("array<bigint>")
    for k in range(6):
        finer = F.when(F.col("k") == k, F.array(*_finer(fp, k))).otherwise(finer)
    plain = F.array(F.lit(0).cast("long"))
    postings = keyed.join(large, "key", "left").select("key", F.explode(F.when(F.col("large"), finer).otherwise(plain)).alias("sub"), "fp")
    sorted_ = postings.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return sorted_.mapInArrow(_links, "a long, b long")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row: 16 hex digits, and the least id reachable over links.

    Fingerprints link if they differ in two bits at most; equal ones (such as 0, of all texts
    without words, null and empty ones included) are one class. Null ids take part but are never
    the least, unless a component has no other. Repeated rows give repeated rows, an empty table an
    empty one. Ids, links and classes stay distributed; no task holds a class.
    """
    rows = cut(fingerprint_rows(df, id_col, text_col))
    nodes = cut_narrow(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    classes = component_ids(nodes, component_roots(link_edges(nodes)), "fp")
    return keyed_lookup(rows, classes, "fp", "n", rows.count()).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for each row: the least id reachable over texts with a similarity of 4/5 or more over five-word shingles.

    The links of fingerprints (of five-word shingles, two bits) are found as above, verified by the
    texts' whole shingle sets, and make the first components. A similarity of 4/5 lets about ten of
    64 bits differ, for which no number of shared bytes is sure; what is still apart is therefore
    compared by ``shingle_join``, which misses nothing. Rules for rows as in ``near_components``.
    """
    return shingle_join.near_components(df, id_col, text_col, majority, link_edges)


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", components: Callable[[DataFrame, str, str], DataFrame] = similar_components) -> DataFrame:
    """Of each component the row with the least id stays, with all its columns.

    ``components`` is ``similar_components``, or ``near_components`` for linked fingerprints. Of rows
    that repeat both id and text one stays, that with the least hash of its columns. Rows without an
    id can't be told apart and all stay. An id should have one text; where it has several, each goes
    if any of them is in a component with a lesser id. Rows meet the ids that go by broadcast while
    these are few, and then stay where they lie.
    """
    columns = [f"c{i}" for i in range(len(df.columns))]
    inner = df.toDF(*columns)
    id_at, text_at = columns[df.columns.index(id_col)], columns[df.columns.index(text_col)]
    marked = components(inner, id_at, text_at).select(F.col(id_at).alias("id"), "component_id").where("id is not null")
    decided = marked.groupBy("id").agg(F.max(F.col("id") != F.col("component_id")).alias("gone"), (F.count(F.lit(1)) > 1).alias("twice"))
    decided = cut_narrow(decided.where("gone or twice"))
    table, few = if_few(decided, BROADCAST_IDS)
    found = inner if few else inner.where(F.col(id_at).isNotNull())
    found = found.join(table, F.col(id_at) == F.col("id"), "left")
    out = found.where("gone is null").select(*columns)
    if not few:
        out = out.unionByName(inner.where(F.col(id_at).isNull()))
    if not decided.where("twice and not gone").isEmpty():
        again = found.where("twice and not gone").groupBy(id_at, F.xxhash64(text_at).alias("h"))
        out = out.unionByName(again.agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*"))
    return out.toDF(*df.columns)
