"""Table verbs that need more than one DataFrame call."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a dense grid at most.
MOST_CELLS = 10_000_000


def replace_slice(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``table`` whose keys ``new`` has go, then ``new`` is added; doing it twice changes nothing."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with equal keys the last."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dense_grid(counts: DataFrame, dims: list[DataFrame], value: str, fill: int = 0) -> DataFrame:
    """All combinations of the dims, ``fill`` where ``counts`` has none. Dims are lists of labels, not of rows: over MOST_CELLS combinations raise."""
    labels = [d.distinct() for d in dims]
    if math.prod(d.count() for d in labels) > MOST_CELLS:
        raise ValueError(f"a grid of over {MOST_CELLS} cells is not made of labels")
    grid = labels[0]
    for d in labels[1:]:
        grid = grid.crossJoin(F.broadcast(d))
    return grid.join(counts, grid.columns, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def mean_sem(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and standard error (sample deviation); the error is null for one row."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def stack(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def require_all(rows: DataFrame, dimension: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows, if all their keys are in the dimension; the first that isn't raises, in the job that reads it."""
    known = dimension.select(*keys).distinct().withColumn("__known", F.lit(True))
    message = F.concat(F.lit(f"no {what} for "), F.to_json(F.struct(*keys)))
    joined = rows.join(known, keys, "left")
    return joined.where(F.when(F.col("__known"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("__known")


def beside(frames: list[tuple[DataFrame, list[str]]], place: str, rows_each: int = 1_000_000) -> DataFrame:
    """Frames side by side, each in order of its own columns (the first of them a number): row i of all, nulls where a frame has ended.

    Beyond ``rows_each`` rows a frame is cut at quantiles of its first column, and the parts' sizes
    are added, so no task numbers a whole frame.
    """
    out = None
    for frame, order in frames:
        cuts = frame.count() // rows_each
        edges = sorted(set(frame.approxQuantile(order[0], [i / (cuts + 1) for i in range(1, cuts + 1)], 0.01))) if cuts else []
        part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(order[0]))) if edges else F.lit(0)
        parts = frame.withColumn("__part", F.coalesce(part, F.lit(0)))
        sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a part
        before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
        nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
        numbered = parts.withColumn("__nth", nth).join(F.broadcast(before), "__part").withColumn(place, (F.col("__before") + F.col("__nth")).cast("long")).drop("__part", "__nth", "__before")
        out = numbered if out is None else out.join(numbered, place, "full")
    return out
