"""Hidden chains with given parameters and regressions by sums: paths, likelihoods and searches that need no fit of their own."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.functions.learning import viterbi
from sonolith.operators.kernels import per_group


def normal_log(x: Column, mean: float, sd: float) -> Column:
    return F.lit(-0.5) * ((x - mean) / sd) ** 2 - F.lit(math.log(sd) + 0.5 * math.log(2 * math.pi))


def von_mises_log(angle: Column, mean: Column, kappa: float) -> Column:
    """Log density on the circle; the normaliser is the power series of the Bessel function."""
    bessel = sum((kappa / 2) ** (2 * i) / math.factorial(i) ** 2 for i in range(60))
    return F.lit(kappa) * F.cos(angle - mean) - F.lit(math.log(2 * math.pi * bessel))


def softmax_log(scores: list[Column], chosen: Column) -> Column:
    """Log probability of class ``chosen`` (from 0)."""
    top = F.greatest(*scores)
    total = sum((F.exp(s - top) for s in scores), F.lit(0.0))
    return F.get(F.array(*scores), chosen) - top - F.log(total)


def paths(rows: DataFrame, keys: list[str], order: str, emissions: list[str], start: np.ndarray, move: np.ndarray) -> DataFrame:
    """Likeliest states of each sequence, one a row; a sequence is a task's."""

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        p = p.sort_values(order)
        return zip(p[order].tolist(), viterbi(start, move, p[emissions].to_numpy(float)).tolist(), strict=True)

    return per_group(rows, keys, work, f"{order} long, state int")


def driven_likelihood(rows: DataFrame, keys: list[str], order: str, emissions: list[str], driver: str, stay: list[tuple[float, float]]) -> DataFrame:
    """Log likelihood of sequences of a chain of two states whose chance to stay is logistic in an input: (intercept, slope) for each state."""

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        p = p.sort_values(order)
        e, u = p[emissions].to_numpy(float), p[driver].to_numpy(float)
        a, total = np.full(2, 0.5) * np.exp(e[0]), 0.0
        for i in range(len(p)):
            if i:
                s = [1 / (1 + math.exp(-(c + d * u[i]))) for c, d in stay]
                a = np.array([a[0] * s[0] + a[1] * (1 - s[1]), a[0] * (1 - s[0]) + a[1] * s[1]]) * np.exp(e[i])
            total += math.log(a.sum())
            a = a / a.sum()
        return [(len(p), total)]

    return per_group(rows, keys, work, "n int, loglik double")


def products(rows: DataFrame, features: list[str], target: str, fold: str) -> dict[int, np.ndarray]:
    """For each fold the sums of products of (1, features, target): all that least squares and its errors need. A few numbers a fold."""
    names = [F.lit(1.0), *map(F.col, features), F.col(target)]
    n = len(names)
    sums = [F.sum(names[i] * names[j]) for i in range(n) for j in range(i, n)]
    out = {}
    for r in rows.groupBy(fold).agg(*sums).collect():
        m = np.zeros((n, n))
        m[np.triu_indices(n)] = r[1:]
        out[r[0]] = m + np.triu(m, 1).T
    return out


def held_out_error(parts: dict[int, np.ndarray], columns: list[int], l2: float) -> list[float]:
    """Mean squared error over each fold of a ridge fit on the others; ``columns`` are features from 1, slopes alone are shrunk."""
    total, at, errors = sum(parts.values()), [0, *columns], []
    for m in (parts[f] for f in sorted(parts)):
        train = total - m
        n = train[0, 0]
        penalty = l2 * np.diag([0.0, *[1.0] * len(columns)])
        b = np.linalg.solve(train[np.ix_(at, at)] / n + penalty, train[at, -1] / n)
        errors.append(float((m[-1, -1] - 2 * b @ m[at, -1] + b @ m[np.ix_(at, at)] @ b) / m[0, 0]))
    return errors


def search_penalty(parts: dict[int, np.ndarray], columns: list[int], penalties: list[float]) -> list[tuple[float, float, float, bool, bool]]:
    """(penalty, mean error, its standard error, least, largest within one standard error of the least)."""
    rows = []
    for l2 in penalties:
        e = np.array(held_out_error(parts, columns, l2))
        rows.append((l2, float(e.mean()), float(e.std(ddof=1) / math.sqrt(len(e)))))
    least = min(rows, key=lambda r: (r[1], r[0]))
    within = max(r[0] for r in rows if r[1] <= least[1] + least[2])
    return [(*r, r[0] == least[0], r[0] == within) for r in rows]


def select_stepwise(parts: dict[int, np.ndarray], names: list[str], least_gain: float, l2: float = 0.0) -> list[tuple[str, float]]:
    """Features in the order that they lower the held-out error most, while they do; ties to the first by name."""
    best, chosen, out = float(np.mean(held_out_error(parts, [], l2))), [], []
    while len(chosen) < len(names):
        error, name = min((float(np.mean(held_out_error(parts, [*chosen, i + 1], l2))), n) for i, n in enumerate(names) if i + 1 not in chosen)
        if best - error < least_gain:
            break
        best = error
        chosen.append(names.index(name) + 1)
        out.append((name, error))
    return out
