"""Softmax regressions of many feature sets and folds side by side, by Newton's method over partial sums.

The rows stay where they lie. Each round is one pass in which every part of them gives, for each
model, its gradient and curvature; what is exchanged is a few kilobytes a model and part, whatever
the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.functions.learning import softmax


@dataclass(frozen=True)
class Model:
    """Columns of the feature array, and the fold that is left out (None: none)."""

    columns: tuple[int, ...]
    left_out: int | None


@dataclass(frozen=True)
class Rows:
    """A table with x (array), y (class from 0) and fold, and its features' mean and deviation."""

    table: DataFrame
    classes: int
    mean: np.ndarray
    deviation: np.ndarray

    @classmethod
    def of(cls, table: DataFrame, size: int, classes: int) -> Rows:
        own = table.select("x", F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
        value = [F.get("x", F.lit(i)).cast("double") for i in range(size)]
        m = own.agg(*[F.avg(v) for v in value], *[F.stddev_pop(v) for v in value]).first()
        s = np.array([v or 0.0 for v in m[size:]])
        return cls(own, classes, np.array([v or 0.0 for v in m[:size]]), np.where(s > 0, s, 1.0))


def _summed(rows: Rows, models: list[Model], part, size: int) -> np.ndarray:
    """Sums over all rows of what ``part(x, y, fold, model number)`` gives: an array of ``size`` for each model."""
    mean, deviation = rows.mean, rows.deviation

    def partial(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        total = np.zeros((len(models), size))
        for p in batches:
            if len(p):
                x = (np.stack(p["x"].to_numpy()).astype(float) - mean) / deviation
                y, fold = p["y"].to_numpy(int), p["fold"].to_numpy(int)
                for k in range(len(models)):
                    total[k] += part(x, y, fold, k)
        yield pd.DataFrame({"model": np.arange(len(models)), "sums": [t.tobytes() for t in total]})

    def add(p: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in p["sums"]], axis=0)
        return pd.DataFrame({"model": [int(p["model"].iloc[0])], "sums": [total.tobytes()]})

    summed = rows.table.mapInPandas(partial, "model int, sums binary").groupBy("model").applyInPandas(add, "model int, sums binary")
    out = np.zeros((len(models), size))
    for r in summed.collect():  # one row a model
        out[r["model"]] = np.frombuffer(bytes(r["sums"]))
    return out


def _design(x: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
    return np.column_stack([x[:, list(columns)], np.ones(len(x))])


def fit_many(rows: Rows, models: list[Model], l2: float = 1e-3, rounds: int = 8) -> list[np.ndarray]:
    """Coefficients (features and, last, the intercept, by class) of each model: mean log loss plus l2 / 2 of the squared slopes, at its least."""
    k = rows.classes
    found = [np.zeros((len(m.columns) + 1, k)) for m in models]
    widest = max(len(m.columns) + 1 for m in models) * k
    size = 1 + widest + widest * widest
    for _ in range(rounds):
        now = [b.copy() for b in found]

        def part(x: np.ndarray, y: np.ndarray, fold: np.ndarray, i: int) -> np.ndarray:
            m, out = models[i], np.zeros(size)
            on = np.ones(len(y), dtype=bool) if m.left_out is None else fold != m.left_out
            a = _design(x[on], m.columns)
            p = softmax(a @ now[i])
            d, w = a.shape[1], a.shape[1] * k
            grad = a.T @ (p - np.eye(k)[y[on]])
            curve = np.zeros((d, k, d, k))
            for c in range(k):
                for e in range(k):
                    curve[:, c, :, e] = (a * (p[:, c] * ((c == e) - p[:, e]))[:, None]).T @ a
            out[0], out[1 : 1 + w], out[1 + widest : 1 + widest + w * w] = on.sum(), grad.ravel(), curve.ravel()
            return out

        sums = _summed(rows, models, part, size)
        moved = 0.0
        for i, m in enumerate(models):
            w = (len(m.columns) + 1) * k
            n = max(sums[i, 0], 1.0)
            slopes = np.repeat(np.r_[np.ones(len(m.columns)), 0.0], k)
            grad = sums[i, 1 : 1 + w] / n + l2 * slopes * found[i].ravel()
            curve = sums[i, 1 + widest : 1 + widest + w * w].reshape(w, w) / n + np.diag(l2 * slopes + 1e-9)
            step = np.linalg.solve(curve, grad)
            found[i] = found[i] - np.clip(step, -5, 5).reshape(found[i].shape)
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-6:
            break
    return found


def held_out_losses(rows: Rows, models: list[Model], coefficients: list[np.ndarray]) -> np.ndarray:
    """Mean log loss of each model over the rows of the fold that it left out."""

    def part(x: np.ndarray, y: np.ndarray, fold: np.ndarray, i: int) -> np.ndarray:
        on = fold == models[i].left_out
        p = softmax(_design(x[on], models[i].columns) @ coefficients[i])
        return np.array([on.sum(), -np.log(np.clip(p[np.arange(on.sum()), y[on]], 1e-12, 1)).sum()])

    sums = _summed(rows, models, part, 2)
    return sums[:, 1] / np.maximum(sums[:, 0], 1)


def forward_selection(table: DataFrame, features: dict[str, tuple[int, ...]], classes: int, least_gain: float = 1e-4, l2: float = 1e-3) -> list[tuple[str, float]]:
    """Features (columns of the array x) in the order that they lower the held-out log loss most, while they do; ties to the name first in order."""
    size = 1 + max(c for cols in features.values() for c in cols)
    rows = Rows.of(table, size, classes)
    folds = sorted(r["fold"] for r in rows.table.select("fold").distinct().collect())
    counts = {r["y"]: r["count"] for r in rows.table.groupBy("y").count().collect()}
    total = sum(counts.values())
    if not total:
        return []
    best, chosen, out = -sum(c / total * np.log(c / total) for c in counts.values()), [], []
    while len(chosen) < len(features):
        names = [n for n in features if n not in chosen]
        models = [Model(tuple(c for m in (*chosen, n) for c in features[m]), f) for n in names for f in folds]
        losses = held_out_losses(rows, models, fit_many(rows, models, l2)).reshape(len(names), len(folds)).mean(axis=1)
        loss, name = min(zip(losses.tolist(), names, strict=True))
        if best - loss < least_gain:
            break
        best = loss
        chosen.append(name)
        out.append((name, loss))
    return out
