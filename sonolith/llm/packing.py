"""Packing: optimal length buckets and token-budget batches.

The global histogram of lengths goes through a dynamic programme that chooses the bucket boundaries
with the least padding. Inside a bucket every batch holds as many texts as the budget allows at the
bucket's boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import cut, named, starts_of

#: Buckets; padded tokens a batch may have; rows that one task numbers, about.
BUCKETS, TOKEN_BUDGET, ROWS_PER_PART = 16, 65_536, 500_000
#: Slices of a part, at least; a part of one repeated id has as many as its rows need.
SLICES = 8


def word_length(text: Column) -> Column:
    """Words between white space, 0 for null, empty and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")).cast("long"), F.lit(0).cast("long"))


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most ``buckets`` buckets, and the padding that they need; the least possible.

    ``lengths`` ascend. Cost of a bucket from i to j: rows times length j, less their lengths. As
    best left ends move right with the right end, each level is solved by halving, all halves of one
    depth in one step.
    """
    n = len(lengths)
    if not n:
        return [], 0
    rows = np.concatenate(([0], np.cumsum(counts.astype(object)))) if float(counts.sum()) * float(lengths[-1]) > 2**62 else np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
    mass = np.concatenate(([0], np.cumsum(counts * lengths)))
    wide = lengths.astype(rows.dtype)

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return wide[j] * (rows[j + 1] - rows[i]) - (mass[j + 1] - mass[i])

    best = cost(np.zeros(n, dtype=np.int64), np.arange(n))
    left = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        now, arg = best.copy(), np.zeros(n, dtype=np.int64)
        a, b, low, high = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while len(a):  # the middles of all halves of one depth at once
            mid = (a + b) // 2
            first = np.maximum(low, 1)
            count = np.maximum(np.minimum(high, mid) - first + 1, 0)
            some = np.flatnonzero(count)
            at = low.copy()
            if len(some):
                begin = starts_of(count[some])
                i = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[some], count[some])
                total = best[i - 1] + cost(i, np.repeat(mid[some], count[some]))
                least = np.minimum.reduceat(total, begin[:-1])
                equal = np.flatnonzero(total == np.repeat(least, count[some]))
                leftmost = equal[np.searchsorted(equal, begin[:-1])]
                at[some] = i[leftmost]
                better = least < now[mid[some]]
                now[mid[some[better]]], arg[mid[some[better]]] = least[better], i[leftmost[better]]
            a, b, low, high = (np.concatenate(x) for x in ((a, mid + 1), (mid - 1, b), (low, at), (at, high)))
            on = a <= b
            a, b, low, high = a[on], b[on], low[on], high[on]
        left.append(arg)
        best = now
    ends, j = [], n - 1
    for level in reversed(left):
        ends.append(int(lengths[j]))
        if level[j] == 0:
            break
        j = int(level[j]) - 1
    return ends[::-1], int(best[n - 1])


def length_buckets(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Boundaries for all rows of ``lengths`` (column length), from their exact histogram.

    The driver gets two numbers for each different length; these are sqrt(2 * words of all texts) at most.
    """
    histogram = lengths.groupBy("length").count().orderBy("length").toArrow()
    return optimal_boundaries(histogram.column("length").to_numpy(), histogram.column("count").to_numpy(), buckets)[0]


def pack_batches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, length: Column | None = None) -> DataFrame:
    """(id, length, bucket, boundary, padding, batch, place) for each row.

    A batch has floor(budget / boundary) places, one at least, so only a text that is longer than
    the budget exceeds it, alone in its batch. Only the last batch of a bucket has places left.
    Null, empty and blank texts have length 0 and share the first bucket. Inside a bucket rows go
    by a hash of the id, then the id; null ids and repeated rows take places like any others. An
    empty table gives no rows.
    """
    source = named(df, id_col, text_col).toDF("id", "text")
    rows = cut(source.select("id", (word_length(F.col("text")) if length is None else length).alias("length")))
    ends = length_buckets(rows, buckets)
    if not ends:
        ends = [0]
    spark = df.sparkSession
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])  # ``buckets`` of them at most
    bucket = F.size(F.filter(bounds, lambda e: e < F.col("length")))
    parts = max(1, rows.count() // ROWS_PER_PART)
    placed = rows.withColumns({"bucket": bucket, "mix": F.xxhash64("id")}).withColumn("part", F.pmod("mix", F.lit(parts)).cast("int") if parts > 1 else F.lit(0))
    # equal ids can be many, so a part of a bucket is cut further by a number given where the row lies
    placed = cut(placed.withColumn("line", F.monotonically_increasing_id()))
    most = placed.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    slices = max(SLICES, -(-most // ROWS_PER_PART))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("line"), F.lit(slices)).cast("int"))
    sizes = placed.groupBy("bucket", "part", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    nth = F.row_number().over(Window.partitionBy("bucket", "part", "slice").orderBy("mix", "id", "line")) - 1
    ranked = placed.withColumn("nth", nth).join(offsets, ["bucket", "part", "slice"]).withColumn("rank", F.col("base") + F.col("nth"))
    table = spark.createDataFrame([(i, e, max(1, budget // max(e, 1))) for i, e in enumerate(ends)], "bucket int, boundary long, places long")
    out = ranked.join(F.broadcast(table), "bucket")  # one row a bucket
    return out.select(
        F.col("id").alias(id_col), "length", "bucket", "boundary", (F.col("boundary") - F.col("length")).alias("padding"),
        F.expr("rank div places").alias("batch"), F.expr("rank % places").cast("long").alias("place"),
    )
