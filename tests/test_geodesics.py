from __future__ import annotations

import numpy as np
import pytest

from sonolith.functions import numeric as N
from sonolith.plans import kernels


def test_geodesics_weigh_all_points(spark, monkeypatch):
    """Points beyond the first 2,000 lie elsewhere; the order of the rows and their parts change nothing."""
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(1.5, 0.4, (2100, 2)), rng.normal(4.5, 0.4, (1900, 2))])
    c = (np.arange(8) + 0.5) * 6 / 8
    dens = N.kde(xy, np.array([(a, b) for a in c for b in c]), 6.0)
    dens = dens / dens.mean() + 1e-3
    edges = []
    for i in range(8):
        for j in range(8):
            for di, dj in ((0, 1), (1, 0), (1, 1), (1, -1)):
                a, b = i * 8 + j, ((i + di) % 8) * 8 + (j + dj) % 8
                edges.append((a, b, np.hypot(di, dj) * 6 / 8 * 2 / (dens[a] + dens[b])))
    want = N.geodesic_matrix(edges, 64)
    for order, parts in ((slice(None), 1), (slice(None, None, -1), 3)):
        points = spark.createDataFrame(xy[order].tolist(), "x double, y double").repartition(parts)
        monkeypatch.setattr(kernels.A, "points", lambda *_, p=points: p)
        got = kernels.geodesics(spark, "").collect()
        assert len(got) == 64 * 63 // 2
        for r in got:
            assert r.d == pytest.approx(want[r.a, r.b], rel=1e-9)
