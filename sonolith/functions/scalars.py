"""Expressions on columns: strings, numbers, angles, bins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sex_of(emitter: Column) -> Column:
    """Sex of an emitter id; ids are dealt to male, female and unassigned in turn."""
    return F.when(emitter % 3 == 0, "male").when(emitter % 3 == 1, "female").otherwise("unassigned")


def normalise_emitter(name: Column) -> Column:
    """Without NUL padding and white space on both sides; null stays null."""
    return F.regexp_replace(name, r"^[\x00\s]+|[\x00\s]+$", "")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """Null where not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def keep_unless(condition: Column) -> Column:
    """True unless the condition is true: rows of which it is unknown stay."""
    return F.coalesce(~condition, F.lit(True))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def float_ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it where b is 0: infinite, or NaN for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(F.try_divide(a, b))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def torus_difference(a: Column, b: Column, period: float) -> Column:
    """Signed difference, least way round, halves to even."""
    d = a - b
    return d - F.lit(period) * F.rint(d / F.lit(period))


def torus_distance(ax: Column, ay: Column, bx: Column, by: Column, period: float) -> Column:
    dx, dy = torus_difference(ax, bx, period), torus_difference(ay, by, period)
    return F.sqrt(dx * dx + dy * dy)


def linear_edges(low: float, high: float, n: int) -> list[float]:
    """n + 1 edges, as numpy's linspace has them."""
    return [float(x) for x in np.linspace(low, high, n + 1)]


def open_closed_bin(x: Column, edges: list[float], first_closed: bool = False) -> Column:
    """Bin by (low, high]; the least edge belongs to no bin, or to the first one. Null outside.

    Edges are compared one by one: dividing by the width puts values on edges in the wrong bin.
    """
    k = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x)) - 1
    inside = (x > edges[0]) & (x <= edges[-1])
    out = F.when(inside, k)
    return F.when(x == edges[0], F.lit(0)).otherwise(out) if first_closed else out


def closed_open_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Bin by [low, high), -1 outside and for null and NaN."""
    k = F.floor((x - F.lit(low)) / F.lit((high - low) / n))
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= low) & (x < high), F.least(k, F.lit(n - 1))).otherwise(F.lit(-1)).cast("int")


def wrap_degrees(x: Column) -> Column:
    """A difference of angles into one turn around 0."""
    return F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)


def log_bessel_i0(kappa: float) -> float:
    """log I0, by its series and, for large values, its asymptotic expansion."""
    if kappa < 30:
        term, total, k = 1.0, 1.0, 0
        while term > 1e-18 * total:
            k += 1
            term *= (kappa / 2 / k) ** 2
            total += term
        return math.log(total)
    s = 1 + 1 / (8 * kappa) + 9 / (128 * kappa**2) + 225 / (3072 * kappa**3) + 11025 / (98304 * kappa**4)
    return kappa - 0.5 * math.log(2 * math.pi * kappa) + math.log(s)
