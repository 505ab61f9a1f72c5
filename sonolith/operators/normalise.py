"""Pooled normalisation, class balance, splits and history windows for models."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.functions.scalars import nan_to_null


def bounded(value: Column, low: float | None, high: float | None, absolute: bool = False, smooth: float | None = None) -> Column:
    """abs(x), or sqrt(x^2 + eps^2), then null outside the bounds."""
    x = nan_to_null(value)
    x = F.sqrt(x * x + smooth * smooth) if smooth is not None else (F.abs(x) if absolute else x)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.when(ok, x)


def pooled_zscore(frames: DataFrame, features: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Each feature less its mean, over its sample deviation, pooled over all sessions (or per ``keys``).

    Nulls and NaN don't count; a deviation of 0 or null counts as 1. One pass of partial sums for all features.
    """
    aggs = []
    for f in features:
        x = nan_to_null(F.col(f))
        aggs += [F.avg(x).alias(f"__m_{f}"), F.stddev_samp(x).alias(f"__s_{f}")]
    stats = frames.groupBy(*keys).agg(*aggs)
    joined = frames.join(stats, list(keys)) if keys else frames.join(F.broadcast(stats))  # one row
    out = {}
    for f in features:
        s = F.col(f"__s_{f}")
        out[f] = (nan_to_null(F.col(f)) - F.col(f"__m_{f}")) / F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)
    return joined.withColumns(out).select(*frames.columns)


def balanced(rows: DataFrame, label: str, mix: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every class cut down to the size of the least, by the order of ``mix``."""
    w = Window.partitionBy(*keys, label).orderBy(mix)
    sizes = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    least = sizes.groupBy(*keys).agg(F.min("__n").alias("__least"))
    ranked = rows.withColumn("__r", F.row_number().over(w))
    joined = ranked.join(least, list(keys)) if keys else ranked.join(F.broadcast(least))  # one row
    return joined.where("__r <= __least").drop("__r", "__least")


def capped(rows: DataFrame, key: str, total: int, mix: Column) -> DataFrame:
    """As many rows of each key as total // number of keys, by the order of ``mix``."""
    n = rows.select(F.count_distinct(key).alias("__k"))
    w = Window.partitionBy(key).orderBy(mix)
    return rows.withColumn("__r", F.row_number().over(w)).join(F.broadcast(n)).where(F.col("__r") <= F.floor(F.lit(total) / F.col("__k"))).drop("__r", "__k")


def holdout_sessions(ids: list, proportion: float, seed: int) -> list:
    """floor(n * p) of the sorted ids, by a seeded permutation; none if that is 0. All or no ids raise."""
    if not ids:
        raise ValueError("no sessions to hold out from")
    n = int(len(ids) * proportion)
    if n == 0:
        return []
    if n >= len(ids):
        raise ValueError("every session would be held out")
    order = np.random.default_rng(seed).permutation(len(ids))
    return sorted(sorted(ids)[i] for i in order[:n])


def stratified_session_splits(counts: dict, n_splits: int, proportion: float, tolerance: float, seed: int, widen: float = 0.02, every: int = 1000, most: int = 50_000) -> list[list]:
    """Seeded test sets of sessions whose class shares are within the tolerance of all rows'.

    ``counts``: session -> rows of each class. A draw takes the sessions first by a hash of seed, draw
    and id. Sets that miss are drawn again; after every ``every`` draws the tolerance widens.
    """
    ids = sorted(counts)
    table = np.array([counts[i] for i in ids], dtype=float)
    want = table.sum(axis=0) / table.sum()
    out, tries = [], 0
    size = max(1, int(round(len(ids) * proportion)))
    while len(out) < n_splits:
        tries += 1
        if tries > most:
            raise ValueError("no split is near enough to the distribution of classes")
        if tries % every == 0:
            tolerance += widen
        pick = sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed}:{tries}:{ids[i]}".encode()).hexdigest(), i))[:size]
        have = table[pick].sum(axis=0)
        rest = table.sum(axis=0) - have
        if have.sum() and rest.min() > 0 and have.min() > 0 and np.abs(have / have.sum() - want).max() <= tolerance:
            out.append(sorted(ids[i] for i in pick))
    return out


def history_mean(frames: DataFrame, value: str, h: int, keys: tuple[str, ...] = ("session_id",)) -> Column:
    """Mean of the h frames before each, nulls and NaN as 0; fewer at the beginning."""
    w = Window.partitionBy(*keys).orderBy("frame_index").rowsBetween(-h, -1)
    return F.avg(F.coalesce(nan_to_null(F.col(value)), F.lit(0.0))).over(w)


def history_window(frames: DataFrame, value: str, h: int, keys: tuple[str, ...] = ("session_id",)) -> Column:
    """The h values before each frame, in order; null where there are fewer."""
    w = Window.partitionBy(*keys).orderBy("frame_index").rowsBetween(-h, -1)
    seen = F.collect_list(F.coalesce(nan_to_null(F.col(value)), F.lit(0.0))).over(w)
    return F.when(F.size(seen) == h, seen)


def unrolled(rows: DataFrame, array: str, keys: list[str]) -> DataFrame:
    """(keys, time, value) for each element."""
    return rows.select(*keys, F.posexplode(array).alias("time", "value"))


def harmonised(rows: DataFrame, features: list[str]) -> DataFrame:
    """Missing features as 0, float."""
    have = set(rows.columns)
    return rows.withColumns({f: F.coalesce(F.col(f).cast("float"), F.lit(0.0).cast("float")) if f in have else F.lit(0.0).cast("float") for f in features})


def seeded_hash(seed: int, value: Column) -> Column:
    """The md5 of seed and value as text: an order that depends on the seed, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")))


def held_out(sessions: DataFrame, session: str, share: float, seed: int, strata: tuple[str, ...] = ()) -> DataFrame:
    """``sessions``, one row each, with held_out: ``share`` of them, one at least, or of each stratum, first by a seeded hash.

    The table has a row a session; without strata one task orders it.
    """
    order = Window.partitionBy(*strata).orderBy(seeded_hash(seed, F.col(session)), session)
    n = F.count(F.lit(1)).over(Window.partitionBy(*strata))
    return sessions.withColumn("held_out", F.row_number().over(order) <= F.greatest(F.lit(1), F.bround(F.lit(share) * n).cast("long")))
