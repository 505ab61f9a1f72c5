"""Point processes: counts in windows around anchors, shifts, peri-event histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOW_OPEN, _POINT, _HIGH_CLOSED = 0, 1, 2


def count_in_windows(points: DataFrame, windows: DataFrame, keys: tuple[str, ...], closed: bool = False, t: str = "t") -> DataFrame:
    """Adds n to each window (low, high): points of its keys in [low, high), or [low, high] if closed.

    Bounds and points are put in one order and counted by a running sum, so a window costs two rows
    whatever it holds. Windows need a column window_id that is unique within the keys.
    """
    high_tag = _HIGH_CLOSED if closed else _LOW_OPEN
    line = (
        points.select(*keys, F.col(t).alias("at"), F.lit(_POINT).alias("tag"), F.lit(None).cast("long").alias("window_id"), F.lit(0).alias("side"))
        .unionByName(windows.select(*keys, F.col("low").alias("at"), F.lit(_LOW_OPEN).alias("tag"), F.col("window_id").cast("long"), F.lit(-1).alias("side")))
        .unionByName(windows.select(*keys, F.col("high").alias("at"), F.lit(high_tag).alias("tag"), F.col("window_id").cast("long"), F.lit(1).alias("side")))
    )
    w = Window.partitionBy(*keys).orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, 0)
    counted = line.withColumn("seen", F.sum((F.col("tag") == _POINT).cast("long")).over(w)).where("side <> 0")
    return counted.groupBy(*keys, "window_id").agg(F.sum(F.col("seen") * F.col("side")).alias("n"))


def circular_shift(t: Column, shift: Column | float, duration: float) -> Column:
    """(t + shift) modulo the duration."""
    return F.pmod(t + (F.lit(shift) if isinstance(shift, int | float) else shift), F.lit(float(duration)))


def shift_table(spark: SparkSession, n: int, low: float, high: float, seed: int) -> DataFrame:
    """(shuffle, shift): n uniform shifts, drawn on the driver so that a seed gives them again."""
    drawn = np.random.default_rng(seed).uniform(low, high, n)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(drawn)], "shuffle int, shift double")


def peri_event_histogram(points: DataFrame, anchors: DataFrame, keys: tuple[str, ...], low: float, high: float, width: float, unit: str = "unit_id", t: str = "t") -> DataFrame:
    """Points of each unit in bins [low + i * width, low + (i + 1) * width) around the anchors of its session.

    Points and anchors meet by a bucket of time as long as the whole span, so only near ones do.
    Bins without points have no row. Anchors need anchor_id and start.
    """
    span = high - low
    n = int(round(span / width))
    edges = F.array(*[F.lit(float(x)) for x in np.linspace(low, high, n + 1)])
    a = anchors.select(*keys, "anchor_id", F.col("start").alias("anchor"))
    a = a.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("anchor") + low) / span), F.floor((F.col("anchor") + high) / span))))
    p = points.select(*keys, unit, F.col(t).alias("at")).withColumn("bucket", F.floor(F.col("at") / span))
    near = p.join(a, [*keys, "bucket"]).withColumn("rel", F.col("at") - F.col("anchor")).where((F.col("rel") >= low) & (F.col("rel") < high))
    return near.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("rel"))) - 1).groupBy(*keys, unit, "bin").agg(F.count(F.lit(1)).alias("n"))


def hopping_windows(anchors: DataFrame, window: float, step: float, n: int) -> DataFrame:
    """Windows [start + k * step, start + k * step + window] for k from 0."""
    out = anchors.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns({"low": F.col("start") + F.col("k") * F.lit(step)}).withColumn("high", F.col("low") + F.lit(window))


def assign_to_sessions(points: DataFrame, sessions: DataFrame, fps: float, stretch: float, t: str = "t") -> DataFrame:
    """Points on one clock to sessions [begin, end): seconds and frame in the session, the last frame at most.

    ``sessions``: session_id, begin, end, n_frames. Both sides meet by stretches of time, so the
    number of sessions isn't bounded.
    """
    cut = sessions.withColumn("__k", F.explode(F.sequence(F.floor(F.col("begin") / stretch), F.floor(F.col("end") / stretch))))
    near = points.withColumn("__k", F.floor(F.col(t) / stretch)).join(cut, "__k").where((F.col(t) >= F.col("begin")) & (F.col(t) < F.col("end"))).drop("__k")
    sec = F.col(t) - F.col("begin")
    return near.withColumns({"seconds": sec, "frame": F.least(F.rint(sec * fps).cast("long"), F.col("n_frames") - 1)})


def drop_refractory(points: DataFrame, keys: tuple[str, ...], least: float, t: str = "t") -> DataFrame:
    """Without points that follow the point before them by less than ``least``."""
    w = Window.partitionBy(*keys).orderBy(t)
    return points.withColumn("__gap", F.col(t) - F.lag(t).over(w)).where(F.col("__gap").isNull() | (F.col("__gap") >= least)).drop("__gap")
