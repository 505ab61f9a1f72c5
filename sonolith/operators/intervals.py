"""Interval events in order: gaps, bouts, merged intervals, as-of lookups, runs, edges.

Every operator works inside a session; a session is one group of a window. ``keys`` names the
columns that make a session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SESSION = ("session_id",)


def _over(keys: tuple[str, ...], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def same_emitter_intervals(events: DataFrame, mode: str = "e2s", keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Interval from each event to the one before it in file order, where one identified sex made both.

    ``s2s`` runs from start to start, ``e2s`` from stop to start. Rows are taken in file order
    (row_idx), not sorted by start, and every row moves the pointer, so noise must be filtered
    before. Adds interval_s and log_interval; intervals of 0 or less stay, marked by ``dropped``.
    """
    before = {"s2s": "start", "e2s": "stop"}[mode]
    w = _over(keys, "row_idx")
    out = events.withColumns({"__sex": F.lag("sex").over(w), "__from": F.lag(before).over(w)})
    out = out.where((F.col("sex") == F.col("__sex")) & F.col("sex").isin("male", "female"))
    out = out.withColumn("interval_s", F.col("start") - F.col("__from"))
    return out.withColumns({"dropped": F.col("interval_s") <= 0, "log_interval": F.when(F.col("interval_s") > 0, F.log("interval_s"))}).drop("__sex", "__from")


def ibi_threshold(log_mean: float, log_sd: float, z: float) -> float:
    """Gap that ends a bout, from the log-normal of gaps inside bouts."""
    return math.exp(log_mean + z * log_sd)


def detect_bouts(events: DataFrame, gap: float, strict: bool = True, keys: tuple[str, ...] = SESSION, order: tuple[str, ...] = ("start", "row_idx")) -> DataFrame:
    """Adds bout (from 0): a bout ends where the gap from the stop of the row before exceeds ``gap`` (or reaches it).

    The stop is the previous row's, not the latest so far, so overlapping calls give negative gaps.
    """
    w = _over(keys, *order)
    since = F.col("start") - F.lag("stop").over(w)
    breaks = since > gap if strict else since >= gap
    return events.withColumn("__new", F.coalesce(breaks, F.lit(False)).cast("long")).withColumn("bout", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def bout_summary(bouts: DataFrame, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Onset, offset, duration, calls and mean call of each bout."""
    return bouts.groupBy(*keys, "bout").agg(
        F.min("start").alias("onset"), F.max("stop").alias("offset"), F.count(F.lit(1)).alias("n_calls"), F.avg("duration").alias("mean_call_s")
    ).withColumn("bout_s", F.col("offset") - F.col("onset"))


def merge_intervals(intervals: DataFrame, keys: tuple[str, ...] = SESSION, start: str = "start", stop: str = "stop") -> DataFrame:
    """Unions of overlapping or touching intervals."""
    w = _over(keys, start, stop)
    latest = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(start) > latest, F.lit(True)).cast("long")
    island = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = intervals.select(*keys, start, stop).withColumn("__new", fresh).withColumn("__island", island)
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("n_merged")).drop("__island")


def clean_gaps(merged: DataFrame, low: float, high: float, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """What merged intervals leave free between ``low`` and ``high``; a session without any isn't in the result."""
    w = _over(keys, "start")
    after = merged.select(*keys, F.greatest(F.col("stop"), F.lit(low)).alias("free_from"), F.least(F.coalesce(F.lead("start").over(w), F.lit(high)), F.lit(high)).alias("free_to"))
    before = merged.groupBy(*keys).agg(F.min("start").alias("free_to")).select(*keys, F.lit(low).alias("free_from"), F.least("free_to", F.lit(high)).alias("free_to"))
    return after.unionByName(before).where("free_to > free_from")


def clean_tiles(events: DataFrame, history: float, duration: float, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Tile times from start + history in steps of history, in stretches free of events and of the history behind them."""
    forbidden = events.select(*keys, "start", (F.col("stop") + history).alias("stop"))
    free = clean_gaps(merge_intervals(forbidden, keys), history, duration, keys)
    n = F.floor((F.col("free_to") - F.col("free_from")) / history).cast("long")
    return free.withColumn("n", n).where("n >= 1").select(*keys, F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda i: F.col("free_from") + i * F.lit(history))).alias("tile"))


def latest_other_stop(events: DataFrame, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Adds latest_stop: the latest stop of events that start strictly before; null if none."""
    at = events.groupBy(*keys, "start").agg(F.max("stop").alias("__stop"))
    w = _over(keys, "start").rowsBetween(Window.unboundedPreceding, -1)
    seen = at.select(*keys, "start", F.max("__stop").over(w).alias("latest_stop"))
    return events.join(seen, [*keys, "start"])


def isolated(events: DataFrame, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Adds is_isolated: no other event overlaps (touching is no overlap).

    By running maxima over the sorted rows, so that no pair of events is made: something overlaps
    from before if an earlier start has a later stop, from behind if the next start comes before the stop.
    """
    w = _over(keys, "start", "stop", "row_idx")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(F.col("stop") > F.col("start"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    hit = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("stop"), F.lit(False))
    return events.withColumn("is_isolated", ~hit)


def overlapping_window(events: DataFrame, low: float, high: float) -> DataFrame:
    """Events that overlap [low, high)."""
    return events.where((F.col("start") < high) & (F.col("stop") > low))


def run_lengths(rows: DataFrame, label: str, keys: tuple[str, ...] = SESSION, order: str = "row_idx") -> DataFrame:
    """Runs of one label as half-open ranges [run_from, run_to) of the ordinal."""
    w = _over(keys, order)
    fresh = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(order).over(w).isNull()).cast("long")
    marked = rows.select(*keys, order, label).withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__run", label).agg(F.min(order).alias("run_from"), (F.max(order) + 1).alias("run_to")).drop("__run")


def longest_true_run(rows: DataFrame, mask: str, order: str, n: int, keys: tuple[str, ...], circular: bool = False) -> DataFrame:
    """Length and first place of the longest run of true; the first of equal ones; wraps if circular, n at most."""
    base = rows.select(*keys, F.col(order).alias("__at"), F.col(mask).alias("__on"))
    if circular:
        base = base.unionByName(base.withColumn("__at", F.col("__at") + n))
    w = _over(keys, "__at")
    marked = base.withColumn("__off", F.sum((~F.coalesce("__on", F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = marked.where("__on").groupBy(*keys, "__off").agg(F.least(F.count(F.lit(1)), F.lit(n).cast("long")).alias("max_run"), F.min("__at").alias("run_from"))
    best = run.groupBy(*keys).agg(F.max(F.struct("max_run", (-F.col("run_from")).alias("neg"))).alias("best"))
    found = best.select(*keys, F.col("best.max_run").alias("max_run"), F.pmod(-F.col("best.neg"), F.lit(n)).alias("run_from"))
    return rows.select(*keys).distinct().join(found, list(keys), "left").withColumn("max_run", F.coalesce("max_run", F.lit(0).cast("long")))


def occupied_frames(events: DataFrame, fps: float, n_frames: int, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Frames from floor(start * fps) up to ceil(stop * fps), one at least, inside the recording; each frame once."""
    first = F.floor(F.col("start") * fps)
    last = F.greatest(F.ceil(F.col("stop") * fps), first + 1) - 1
    spans = events.select(*keys, F.greatest(first, F.lit(0)).cast("long").alias("start"), (F.least(last, F.lit(n_frames - 1)) + 1).cast("long").alias("stop")).where("stop > start")
    merged = merge_intervals(spans, keys)  # so that no frame is made twice
    return merged.select(*keys, F.explode(F.expr("sequence(start, stop - 1)")).alias("frame_index"))


def step_edges(samples: DataFrame, value: str, threshold: float, keys: tuple[str, ...] = SESSION, order: str = "row_idx") -> DataFrame:
    """Where a signal that was still moves by more than the threshold: ordinal and sign (+1 up; -1 down, one later)."""
    w = _over(keys, order)
    step = F.col(value) - F.lag(value).over(w)
    steps = samples.select(*keys, order, step.alias("__d")).where("__d is not null")
    nxt = F.lead("__d").over(w)
    marked = steps.withColumn("__n", nxt).where((F.abs("__d") < threshold) & (F.abs("__n") > threshold))
    return marked.select(*keys, F.when(F.col("__n") > 0, F.col(order)).otherwise(F.col(order) + 1).alias("at"), F.when(F.col("__n") > 0, 1).otherwise(-1).alias("sign"))


def drop_short_flips(edges: DataFrame, least: float, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Without pairs of neighbouring edges that are less than ``least`` apart; both of a pair go."""
    w = _over(keys, "at", "sign")
    short = (F.lead("at").over(w) - F.col("at")) < least
    return edges.withColumn("__s", F.coalesce(short, F.lit(False))).withColumn("__b", F.coalesce(F.lag("__s").over(w), F.lit(False))).where("not __s and not __b").drop("__s", "__b")


def alternating(edges: DataFrame, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Edges that follow one of the other sign; the first of a row of equal ones stays."""
    w = _over(keys, "at", "sign")
    return edges.withColumn("__p", F.lag("sign").over(w)).where("__p is null or __p <> sign").drop("__p")


def rising_edges(samples: DataFrame, bit: Column, keys: tuple[str, ...] = SESSION, order: str = "row_idx") -> DataFrame:
    """Ordinals at which a bit goes from 0 to 1, with the gap to the next."""
    w = _over(keys, order)
    on = samples.select(*keys, order, bit.cast("int").alias("__b")).withColumn("__p", F.lag("__b").over(w)).where("__b = 1 and __p = 0")
    return on.select(*keys, F.col(order).alias("at"), (F.lead(order).over(w) - F.col(order)).alias("gap"))


def central_difference(frames: DataFrame, value: str, k: int, fps: float, angle: bool = False, keys: tuple[str, ...] = SESSION) -> Column:
    """(x[i + k] - x[i - k]) / (2 k / fps); differences of angles taken the short way round."""
    from sonolith.functions.scalars import wrap_degrees

    w = _over(keys, "frame_index")
    d = F.lead(value, k).over(w) - F.lag(value, k).over(w)
    return (wrap_degrees(d) if angle else d) / F.lit(2 * k / fps)


def anchor_bins(anchors: DataFrame, edges: list[tuple[float, float]], duration: float, latest: str = "latest_stop") -> DataFrame:
    """Each anchor by each relative bin, with whether the bin is usable.

    ``in_recording``: inside [0, duration]; ``clean_post``: begins after the latest other stop.
    """
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(edges)])
    out = anchors.withColumn("__b", F.explode(bins)).withColumns({"bin": F.col("__b.bin"), "lo": F.col("start") + F.col("__b.lo"), "hi": F.col("start") + F.col("__b.hi")}).drop("__b")
    return out.withColumns({"in_recording": (F.col("lo") >= 0) & (F.col("hi") <= duration), "clean_post": F.coalesce(F.col("lo") > F.col(latest), F.lit(True))})
