"""Queries without SQL take in every row of their table: held against numpy over whole groups."""

from __future__ import annotations

import numpy as np
import pytest

from sonolith import adapters as A
from sonolith import plans
from sonolith.functions import learning as L
from sonolith.functions import numeric as N
from sonolith.plans import pose

QUERIES = plans.load()[0]


@pytest.fixture(scope="module")
def sessions(spark, sf_dir):
    return dict(iter(A.frames(spark, sf_dir).toPandas().groupby("session_id")))


def rows_by(query, spark, sf_dir):
    out = {}
    for r in QUERIES[query](spark, sf_dir).collect():
        out.setdefault(r.session_id, []).append(r)
    return out


def test_signed_ranks_are_of_all_frames(spark, sf_dir, sessions):
    got = rows_by("paired_signed_rank", spark, sf_dir)
    assert got.keys() == sessions.keys()
    for s, p in sessions.items():
        assert tuple(got[s][0])[1:] == pytest.approx(N.wilcoxon(p["speed"].to_numpy(), p["distance"].to_numpy()))


def test_regressions_are_of_all_frames(spark, sf_dir, sessions):
    ridge, gamma = rows_by("ridge_regression", spark, sf_dir), rows_by("gamma_regression", spark, sf_dir)
    assert ridge.keys() == gamma.keys() == sessions.keys()
    for s, p in sessions.items():
        x, y = p[["speed", "yaw"]].to_numpy(float), p["distance"].to_numpy(float)
        want = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
        assert tuple(ridge[s][0])[1:] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-7)
        assert tuple(gamma[s][0])[1:] == pytest.approx(L.gamma_glm(L.standardised(x), y + 0.1).tolist(), rel=1e-5, abs=1e-7)


def test_polar_density_is_of_all_frames(spark, sf_dir, sessions):
    got = rows_by("polar_density", spark, sf_dir)
    assert got.keys() == sessions.keys()
    for s, p in sessions.items():
        xy = p[["distance", "yaw"]].to_numpy(float) / np.array([10.0, 30.0])
        own = xy[p["speed"].to_numpy() > 40]
        q = np.array([(r.distance / 10, r.angle / 30) for r in got[s]])

        def density(x):
            factor = np.cov(x.T) * len(x) ** (-1 / 3)
            diff = q[:, None, :] - x[None, :, :]
            return np.exp(-0.5 * ((diff @ np.linalg.inv(factor)) * diff).sum(axis=2)).sum(axis=1) / (len(x) * 2 * np.pi * np.sqrt(np.linalg.det(factor)))

        for r, v, w in zip(got[s], density(own), density(xy), strict=True):
            assert (r.ratio is None) == (w <= 1e-6) and (r.ratio is None or r.ratio == pytest.approx(v / w))


def test_sources_are_of_all_waveforms(spark, sf_dir):
    got = QUERIES["source_positions"](spark, sf_dir).select("vec_id").collect()
    assert sorted(got) == sorted(pose._curves(spark, sf_dir, 8).select("vec_id").collect())
