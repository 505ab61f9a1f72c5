"""Coactivity of units over trials, and nulls by shifts, bootstraps and permutations."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.operators.points import count_in_windows


def coactivity(counts: np.ndarray) -> tuple[float, float, float]:
    """Of units x trials: mean correlation of pairs of units, mean cosine of pairs of trials, mean correlation of pairs of trials.

    Means over pairs come from sums of unit vectors: (|sum|^2 - n) / (n (n - 1)), with no pair made.
    Trials without spikes add 0 to the cosine but stay in its denominator.
    """

    def mean_pair(v: np.ndarray, n: int) -> float:
        own = (v * v).sum()
        s = v.sum(axis=0)
        return float((s @ s - own) / (n * (n - 1))) if n > 1 else np.nan

    def unit(v: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    c = counts.astype(float)
    units = unit(c - c.mean(axis=1, keepdims=True))
    moving = units[np.abs(units).sum(axis=1) > 0]
    trials = c.T
    centred = unit(trials - trials.mean(axis=1, keepdims=True))
    live = centred[np.abs(centred).sum(axis=1) > 0]
    return mean_pair(moving, len(moving)), mean_pair(unit(trials), len(trials)), mean_pair(live, len(live))


def count_matrices(spikes: DataFrame, anchors: DataFrame, window: float, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """(keys, trial, group, counts) with one count a unit of the session, in order of unit; windows [start, start + window]."""
    units = spikes.select(*keys, "unit_id").distinct()
    w = anchors.join(units, list(keys)).select(*keys, "unit_id", F.col("anchor_id").alias("window_id"), F.col("start").alias("low"), (F.col("start") + window).alias("high"), "group")
    n = count_in_windows(spikes, w, (*keys, "unit_id"), closed=True)
    full = w.join(n, [*keys, "unit_id", "window_id"])
    return full.groupBy(*keys, F.col("window_id").alias("trial"), "group").agg(F.transform(F.sort_array(F.collect_list(F.struct("unit_id", "n"))), lambda x: x["n"]).alias("counts"))


def _matrix(p: pd.DataFrame) -> np.ndarray:
    return np.stack(p.sort_values("trial")["counts"].to_numpy()).T if len(p) else np.zeros((0, 0))


def coactivity_by_group(matrices: DataFrame, key: str = "session_id") -> DataFrame:
    """The three metrics of each session and group of trials."""
    kind = matrices.schema[key].dataType.simpleString()

    def work(p: pd.DataFrame) -> pd.DataFrame:
        r, c, t = coactivity(_matrix(p))
        return pd.DataFrame({key: [p[key].iloc[0]], "group": [p["group"].iloc[0]], "n_trials": [len(p)], "r_sc": [r], "cosine": [c], "pop_corr": [t]})

    return matrices.groupBy(key, "group").applyInPandas(work, f"{key} {kind}, group string, n_trials long, r_sc double, cosine double, pop_corr double")


def hashed(*parts: object) -> int:
    """A number below 2^32 that depends on the parts alone, so that any engine draws alike."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def bootstrap_coactivity(matrices: DataFrame, n_target: int, n_iterations: int, seed: int, key: str = "session_id") -> DataFrame:
    """Metrics of trials drawn with replacement, by iteration; draws are places among the trials in order, told by a seeded hash."""
    kind = matrices.schema[key].dataType.simpleString()

    def work(p: pd.DataFrame) -> pd.DataFrame:
        m, name = _matrix(p), p[key].iloc[0]
        rows = [(name, i, *coactivity(m[:, [hashed(seed, name, i, k) % m.shape[1] for k in range(n_target)]])) for i in range(n_iterations)]
        return pd.DataFrame(rows, columns=[key, "iteration", "r_sc", "cosine", "pop_corr"])

    return matrices.groupBy(key).applyInPandas(work, f"{key} {kind}, iteration int, r_sc double, cosine double, pop_corr double")


def permute_labels(matrices: DataFrame, a: str, b: str, n: int, seed: int, key: str = "session_id") -> DataFrame:
    """Difference of the groups' metrics, its z, and one- and two-sided p with + 1, over permuted labels.

    A permutation gives the first group's label to the trials first by a seeded hash.
    """
    kind = matrices.schema[key].dataType.simpleString()

    def work(p: pd.DataFrame) -> pd.DataFrame:
        own = p[p["group"].isin([a, b])].sort_values("trial")
        m, is_a = _matrix(own), (own["group"] == a).to_numpy()
        if is_a.sum() < 2 or (~is_a).sum() < 2:
            return pd.DataFrame({key: [p[key].iloc[0]], "delta": [np.nan], "z": [np.nan], "p_one": [np.nan], "p_two": [np.nan]})
        trials = own["trial"].tolist()

        def permuted(i: int) -> np.ndarray:
            order = sorted(range(len(trials)), key=lambda k: (hashlib.md5(f"{seed}:{i}:{trials[k]}".encode()).hexdigest(), trials[k]))
            mask = np.zeros(len(trials), dtype=bool)
            mask[order[: int(is_a.sum())]] = True
            return mask

        def delta(mask: np.ndarray) -> float:
            return coactivity(m[:, mask])[1] - coactivity(m[:, ~mask])[1]

        d = delta(is_a)
        null = np.array([delta(permuted(i)) for i in range(n)])
        sd = null.std()
        null, d = np.round(null, 9), round(d, 9)  # equal splits are equal
        return pd.DataFrame({key: [p[key].iloc[0]], "delta": [d], "z": [(d - null.mean()) / sd if sd > 1e-9 else np.nan], "p_one": [((null >= d).sum() + 1) / (n + 1)], "p_two": [((np.abs(null) >= abs(d)).sum() + 1) / (n + 1)]})

    return matrices.groupBy(key).applyInPandas(work, f"{key} {kind}, delta double, z double, p_one double, p_two double")


def shifted_coactivity(spikes: DataFrame, anchors: DataFrame, window: float, duration: float, shifts: list[float], key: str = "session_id") -> DataFrame:
    """Metrics after the spikes of a session are moved together by each shift, modulo the duration.

    Works on each session's sorted spikes, so shifts make no rows.
    """
    kind = spikes.schema[key].dataType.simpleString()
    sp = spikes.groupBy(key, "unit_id").agg(F.sort_array(F.collect_list("t")).alias("t")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("unit_id", "t"))).alias("units"))
    an = anchors.groupBy(key).agg(F.sort_array(F.collect_list("start")).alias("onsets"))

    def work(p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in p.iterrows():
            on = np.asarray(r["onsets"], float)
            for i, s in enumerate(shifts):
                m = []
                for u in r["units"]:
                    t = np.sort((np.asarray(u["t"], float) + s) % duration)
                    m.append(np.searchsorted(t, on + window, "right") - np.searchsorted(t, on, "left"))
                rows.append((r[key], i, *coactivity(np.array(m))))
        return pd.DataFrame(rows, columns=[key, "shuffle", "r_sc", "cosine", "pop_corr"])

    return sp.join(an, key).groupBy(key).applyInPandas(work, f"{key} {kind}, shuffle int, r_sc double, cosine double, pop_corr double")
