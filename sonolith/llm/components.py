"""Connected components of an edge table: in one task while the edges fill one partition, else by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import NARROW_ROWS, cut, cut_narrow, keyed_lookup


def _stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One round on edges (a, b), a > b; each node's least neighbour is a partial minimum, joined back."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).coalesce(parts)
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("low")).coalesce(parts)
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = out.unionByName(least.select("a", F.col("low").alias("b")))
    return out.where("a > b").coalesce(parts).distinct().coalesce(parts)


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), ascending, and of each the least node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while len(x):
        # each root goes below the least root that an edge leads to, then each node to its root
        np.minimum.at(low, np.maximum(low[x], low[y]), np.minimum(low[x], low[y]))
        while ((up := low[low]) != low).any():
            low = up
        apart = low[x] != low[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[low]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all edges: rows (node, root)."""
    held = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches]
    if held:
        found = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a and b, any order): root is the least node reachable.

    Nodes without an edge have no row; loops and repeated edges count for nothing; an empty table
    gives an empty one. Fewer than NARROW_ROWS edges of longs, which one partition holds, go through
    one task: rounds over them are dozens of small shuffles, which cost the driver memory. The
    number of rounds grows with the logarithm of the longest chain; edges, which don't grow in
    number, are kept on as many partitions as they fill.
    """
    now = cut_narrow(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    )
    seen = _print_of(now)
    if seen[0] < NARROW_ROWS and {kind for _, kind in now.dtypes} == {"bigint"}:
        return now.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    while seen[0]:
        parts = seen[0] // NARROW_ROWS + 1
        now = cut(_stars(_stars(now, True, parts), False, parts))
        was, seen = seen, _print_of(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def component_ids(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, n, component_id) for each of ``nodes`` (key, low, n): the least ``low`` among all nodes with its root."""
    rooted = cut_narrow(nodes.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key)))
    groups = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    return cut_narrow(keyed_lookup(rooted, cut_narrow(groups), "root", "nodes", rooted.count()).select(key, "n", "component_id"))
