"""Sharding by histogram sort: probe, count exactly, refine, exchange once.

Rows are ordered by (key, tie). Each round counts on all partitions the exact bytes and rows below a
list of probes; probes are then moved into the gaps that still hold a boundary, until every shard
boundary is within the tolerance or one key wide. Keys that repeat too often to be cut between two
values are cut inside by ``tie``, the row's place among the rows as they are stored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.llm.common import beside, shared_folder, stored

#: Probes for each boundary in a round.
PROBES = 32
#: Share of a shard's bytes by which a boundary may miss its target.
TOLERANCE = 1e-4
#: Rows and bytes of text that one task sorts and numbers, about.
ROWS_PER_RANGE, BYTES_PER_RANGE = 1_000_000, 64 << 20


@dataclass(frozen=True)
class Splitters:
    """Boundaries of consecutive ranges: a row belongs to the last range whose (key, tie) is not above its own."""

    keys: np.ndarray
    ties: np.ndarray
    below_rows: np.ndarray
    below_bytes: np.ndarray


def _count(digest: DataFrame, column: str, probes: list[int], within: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exact rows and bytes with ``column`` below each probe, of all rows or of those with key ``within``."""
    edges = np.array(probes, dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column(0).to_numpy(zero_copy_only=False), side="right")
            rows += np.bincount(at, minlength=len(edges) + 1)
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(rows[used]), pa.array(size[used])], names=["bin", "rows", "bytes"])

    source = digest if within is None else digest.where(F.col("key") == within)
    counted = source.select(column, "size").mapInArrow(work, "bin long, rows long, bytes long")
    rows, size = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in counted.groupBy("bin").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).toLocalIterator():
        rows[r["bin"]], size[r["bin"]] = r["rows"], r["bytes"]
    return np.cumsum(rows)[:-1], np.cumsum(size)[:-1]


def _spread(low: int, high: int, n: int) -> list[int]:
    """Up to n probes strictly between two keys."""
    gap = high - low
    return sorted({low + gap * (i + 1) // (n + 1) for i in range(n)} - {low, high}) if gap > 1 else []


def _refine(digest: DataFrame, column: str, low: int, high: int, targets: list[float], slack: float, within: int | None) -> dict[int, tuple[int, int]]:
    """Probe -> (rows, bytes) below it. Ends when each target has a probe within ``slack`` or adjacent keys around it."""
    known: dict[int, tuple[int, int]] = {}
    wanted = np.array(targets, dtype=np.float64)
    asked = _spread(low, high + 1, PROBES * len(targets)) or [low + 1]
    while asked:
        rows, size = _count(digest, column, asked, within)
        known |= {p: (int(r), int(b)) for p, r, b in zip(asked, rows, size, strict=True)}
        have = sorted(known)
        sizes = np.array([known[p][1] for p in have], dtype=np.float64)
        missed = np.abs(sizes[_nearest(sizes, wanted)] - wanted) > slack
        ask: set[int] = set()
        for k in np.unique(np.searchsorted(sizes, wanted[missed])).tolist():
            ask |= set(_spread(have[k - 1] if k else low, have[k] if k < len(have) else high + 1, PROBES))
        asked = sorted(ask - known.keys())
    return known


def _nearest(ascending: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of the number nearest to each value, the lesser if two are."""
    right = np.searchsorted(ascending, values).clip(0, len(ascending) - 1)
    left = (right - 1).clip(0)
    return np.where(np.abs(ascending[left] - values) <= np.abs(ascending[right] - values), left, right)


def find_splitters(digest: DataFrame, shards: int, tolerance: float = TOLERANCE) -> Splitters:
    """Boundaries that cut the rows of ``digest`` (key, tie, size) into ``shards`` of near equal bytes."""
    low, high, total, rows = digest.agg(F.min("key"), F.max("key"), F.sum("size"), F.count(F.lit(1))).first()
    if not rows:
        return Splitters(*(np.zeros(0, np.int64) for _ in range(4)))
    targets = [total * i / shards for i in range(1, shards)]
    slack = tolerance * total / shards
    known = _refine(digest, "key", low, high, targets, slack, None) if shards > 1 and high > low else {}
    have = [low, *sorted(known), high + 1]
    below = [(0, 0), *(known[p] for p in sorted(known)), (rows, total)]
    cuts: list[tuple[int, int, int, int]] = []
    sizes = np.array([b[1] for b in below], dtype=np.float64)
    for t, k in zip(targets, _nearest(sizes, np.array(targets, dtype=np.float64)).tolist(), strict=True):
        if abs(sizes[k] - t) <= slack:
            cuts.append((have[k], 0, *below[k]))
            continue
        k = int(np.searchsorted(sizes, t, side="right")) - 1
        if below[k + 1][0] - below[k][0] < 2:  # one row spans the target: the nearer side
            k += int(abs(sizes[k + 1] - t) < abs(sizes[k] - t))
            cuts.append((have[k], 0, *below[k]))
            continue
        # one key holds the boundary: cut it by tie
        first, last = digest.where(F.col("key") == have[k]).agg(F.min("tie"), F.max("tie")).first()
        inside = _refine(digest, "tie", first, last, [t - sizes[k]], slack, have[k])
        tie = min(inside, key=lambda p: abs(inside[p][1] + sizes[k] - t))
        cuts.append((have[k], tie, below[k][0] + inside[tie][0], below[k][1] + inside[tie][1]))
    return Splitters(*(np.array(x, dtype=np.int64) for x in zip(*cuts, strict=True))) if cuts else Splitters(*(np.zeros(0, np.int64) for _ in range(4)))


def _ranges(digest: DataFrame, rows: int, size: int, shards: int, edges: Splitters) -> Splitters:
    """The shard boundaries and, where there is much to sort, further ones between them, each with its exact counts."""
    more = max(1, rows // (ROWS_PER_RANGE * shards), size // (BYTES_PER_RANGE * shards))
    return edges if more == 1 else find_splitters(digest, shards * more, 0.5)


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of the text in UTF-8, 0 for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def shard_rows(df: DataFrame, shards: int = 8, key_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, folder: str | None = None) -> DataFrame:
    """All rows and columns, with size (UTF-8 bytes of the text plus 1), law, shard, slot and grown_shard behind them.

    Law ``bytes``: shards are consecutive ranges of the key and differ in bytes by ``tolerance`` of a
    shard plus one row at most. ``slot`` numbers a shard's rows from 0 without gaps, by key. Keys
    that are no whole numbers go by a hash. A null text has size 1; null keys come first. Rows that
    share a key, or are wholly equal, may lie in neighbouring shards, so a key with any share of the
    rows doesn't unbalance them. An empty table gives no rows. Input columns with the name of a new
    one, or of another, get ``_in`` behind theirs. The rows, each with its place, are written to
    ``folder`` (by default a new one in the checkpoint folder) and read again from there: only
    numbers for the counts, everything for the one exchange.
    """
    spark = df.sparkSession
    names = beside(df.columns, "size", "law", "shard", "slot", "grown_shard")
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = (F.col(f"c{df.columns.index(c)}") for c in (key_col, text_col))
    whole = isinstance(inner.schema[df.columns.index(key_col)].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    work = inner.withColumns({
        "key": F.coalesce(key.cast("long") if whole else F.when(key.isNotNull(), F.xxhash64(key)), F.lit(-(1 << 62)).cast("long")),
        "tie": F.monotonically_increasing_id(),
        "size": F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + F.lit(1).cast("long"),
    })
    rows = stored(work, folder or shared_folder(spark, "rows"))
    digest = rows.select("key", "tie", "size")
    edges = find_splitters(digest, shards, tolerance)
    total, size = digest.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    fine = _ranges(digest, int(total), int(size), shards, edges)
    order = sorted({(int(k), int(t), int(r)) for e in (edges, fine) for k, t, r in zip(e.keys, e.ties, e.below_rows, strict=True)} | {(-(1 << 63), 0, 0)})
    bound = sorted((int(k), int(t), int(r)) for k, t, r in zip(edges.keys, edges.ties, edges.below_rows, strict=True))
    places = []
    for i, (k, t, r) in enumerate(order):
        shard = bisect_right(bound, (k, t, 1 << 63))
        places.append((i, k, t, shard, r - (bound[shard - 1][2] if shard else 0)))
    keys, ties = np.array([p[1] for p in places], np.int64), np.array([p[2] for p in places], np.int64)
    many = np.flatnonzero(np.diff(keys, append=keys[-1] + 1) == 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = set(keys[many].tolist())
        for b in batches:
            k, t = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "tie"))
            at = np.searchsorted(keys, k, side="right") - 1
            at -= (keys[at] == k) & (ties[at] > t)
            for key_ in inside.intersection(k.tolist()) if inside else ():  # a repeated key that holds boundaries
                low, high = np.searchsorted(keys, [key_, key_ + 1])
                mine = k == key_
                at[mine] = low - 1 + np.searchsorted(ties[low:high], t[mine], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int64))], names=[*b.schema.names, "range"])

    placed = rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("range", T.LongType())]))
    table = spark.createDataFrame([(p[0], p[3], p[4]) for p in places], "range long, shard int, base long")
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy("key", "tie")))
    out = numbered.join(F.broadcast(table), "range")  # one row per boundary: bytes / BYTES_PER_RANGE at most
    return out.select(
        *[f"c{i}" for i in range(len(names))], "size", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ).toDF(*names, "size", "law", "shard", "slot", "grown_shard")
