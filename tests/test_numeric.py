"""Kernels against closed forms and naive versions."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolith.functions import learning as L
from sonolith.functions import mixtures as X
from sonolith.functions import numeric as N
from sonolith.functions import scalars as S
from sonolith.operators import manifold as M
from sonolith.operators import normalise as Z
from sonolith.operators import resampling as R


def test_smoothing_keeps_constants_and_nan():
    x = np.full(50, 3.0)
    x[10] = np.nan
    y = N.smooth(x, 2.0)
    assert np.isnan(y[10]) and np.allclose(np.delete(y, 10), 3.0)
    assert not np.isnan(N.smooth(x, 2.0, keep_nan=False)[10])
    d = np.zeros(41)
    d[20] = 1
    assert np.allclose(N.smooth(d, 2.0)[12:29], N.gaussian_kernel(2.0))
    assert np.allclose(N.smooth_2d(np.ones((9, 7)), 1.0), 1.0)


def test_speed_of_even_motion():
    xy = np.arange(30)[:, None, None] * np.array([0.01, 0.0])[None, None, :] + np.zeros((30, 3, 2))
    v = N.speed(xy, 150.0, 1.0)
    assert np.isnan(v[0]) and np.allclose(v[1:], 150.0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-4, 4), min_size=1, max_size=9))
def test_wilcoxon_counts_all_signs(d):
    x = np.array(d, dtype=float)
    w, p, n = N.wilcoxon(x, np.zeros(len(x)))
    assert n == len(d)
    if not x.any():
        assert p == 1.0
        return
    r = N.average_ranks(np.abs(x))
    zero = r[x == 0].sum() / 2
    assert w == pytest.approx(min(r[x > 0].sum(), r[x < 0].sum()) + zero)
    sums = [sum(ri for ri, s in zip(r, signs, strict=True) if s) for signs in product([0, 1], repeat=len(d))]
    assert p == pytest.approx(min(1.0, 2 * np.mean([s <= w + 1e-9 for s in sums])))


def test_wilcoxon_large_is_normal():
    x = np.arange(1, 61) * np.where(np.arange(60) % 3 == 0, -1, 1.0)
    _, p, n = N.wilcoxon(x, np.zeros(60))
    assert n == 60 and 0 < p < 0.05


def test_student_and_normal():
    for nu, t in ((1, 1.0), (3, -0.7), (10, 2.228138852)):
        grid = np.linspace(-400, t, 400_001)
        dens = math.gamma((nu + 1) / 2) / (math.sqrt(nu * math.pi) * math.gamma(nu / 2)) * (1 + grid**2 / nu) ** (-(nu + 1) / 2)
        assert N.t_cdf(t, nu) == pytest.approx(np.trapezoid(dens, grid), abs=2e-3)
    assert N.t_cdf(2.228138852, 10) == pytest.approx(0.975, abs=1e-8)
    assert N.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert N.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert N.correlation_p(0.0, 20) == pytest.approx(1.0)


def test_bessel_and_kappa():
    k = np.linspace(0, math.pi, 20001)
    for kappa in (0.5, 3.0, 29.9, 30.1, 80.0):
        want = math.log(np.trapezoid(np.exp(kappa * (np.cos(k) - 1)), k) / math.pi) + kappa
        assert S.log_bessel_i0(kappa) == pytest.approx(want, abs=1e-6)
    assert M.fit_kappa(0.0) == 0
    w = np.exp(4 * np.cos(k))
    assert M.fit_kappa(float(np.trapezoid(w * np.cos(k), k) / np.trapezoid(w, k))) == pytest.approx(4, abs=1e-3)


def test_kde_integrates_to_one():
    rng = np.random.default_rng(0)
    xy = rng.normal(3, 0.5, (80, 2)) % 6
    c = (np.arange(60) + 0.5) / 10
    q = np.array([(a, b) for a in c for b in c])
    assert N.kde(xy, q, 6.0).sum() * 0.01 == pytest.approx(1, abs=0.01)


def test_distance_correlation():
    x = np.linspace(0, 1, 40)
    assert N.distance_correlation(x, 3 * x + 1) == pytest.approx(1)
    assert N.distance_correlation(x, np.ones(40)) == 0


def test_autocorrelation_matches_sums():
    x = np.random.default_rng(1).normal(size=70)
    acf, y = N.autocorrelation(x, 10), x - x.mean()
    assert np.allclose(acf, [(y[: 70 - k] * y[k:]).sum() / (y * y).sum() for k in range(11)])
    assert N.integrated_time(np.array([1, 0.5, 0.2, -0.1, 0.9])) == pytest.approx(2.4)
    assert N.first_below(np.array([1, 0.5, 0.05]), 0.1) == 2 and N.first_below(np.ones(3), 0.1) is None


def test_variance_inflation():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 300))
    v = N.variance_inflation(np.column_stack([a, b, a + b, np.ones(300)]))
    assert np.isinf(v).all()
    v = N.variance_inflation(np.column_stack([a, a + 0.5 * b]))
    r2 = np.corrcoef(a, a + 0.5 * b)[0, 1] ** 2
    assert v == pytest.approx([1 / (1 - r2)] * 2)
    assert np.isnan(N.variance_inflation(np.ones((3, 2)))).all()


def test_bases():
    b = N.bsplines(25, np.array([0, 5, 10, 15, 20]))
    assert b.shape == (25, 5) and np.allclose(b[5:20].sum(axis=1), 1)
    x = np.arange(25)[::-1]
    assert np.allclose(N.spline_knots(np.array([0, 5, 10, 15, 20]), 3, False), [0] * 4 + [10] + [20] * 4)
    assert np.allclose(b[x < 10, 0], (1 - x[x < 10] / 10) ** 3) and np.allclose(b[x > 20, 4], (x[x > 20] / 10 - 1) ** 3)
    ring = N.bsplines(21, np.array([0, 5, 10, 15, 20]), 3, True)
    assert ring.shape == (21, 5) and np.allclose(N.spline_knots(np.array([0, 5, 10, 15, 20]), 3, True), np.arange(-15, 36, 5))
    assert np.allclose(ring[20, :3], [1 / 6, 2 / 3, 1 / 6])
    assert np.allclose(N.bsplines(9, np.arange(0, 9, 2), 2).sum(axis=1), 1)
    r = N.raised_cosine(2, 5, (0, 10), 2, 30, 8)
    size = np.linalg.norm(r, axis=0)
    assert r.shape == (30, 8) and np.allclose(size[:7], 1) and size[7] == 0
    assert r[29, 0] == r[28, 1] == 1 and (np.diff(r[:, 2:7].argmax(axis=0)) < 0).all()
    open_ = N.raised_cosine(1, 4, (0, 8), 1)
    assert np.isfinite(open_).all() and open_.shape == (1 + math.ceil(math.exp(math.log(9) * 5 / 3) - 1), 5)
    p = N.laplacian_pyramid(64, 4, 1.0, 1.0)
    assert p.shape[0] == 64 and np.allclose(np.linalg.norm(p, axis=0), 1)
    assert p.shape[1] == sum(int(64 / 2.0 ** (k - 1) - 1) - 1 for k in range(4))
    with pytest.raises(ValueError):
        N.laplacian_pyramid(1, 1, 1.0, 1.0)
    assert (N.identity_basis(4) == np.eye(4)[::-1]).all()


def test_lattices():
    assert np.allclose(N.fibonacci_lattice(7)[:, 0] * 13, np.arange(13))
    assert np.allclose(N.korobov(3, 3, 10)[1], [0.1, 0.3, 0.9])
    g = 1 / (1 - N.roberts(2, 1)[1, 0])
    assert g == pytest.approx((1 + math.sqrt(5)) / 2)


def test_watershed_and_boxes():
    ten = np.arange(10)
    assert N.watershed_segments(np.full(10, 0.1), np.full(10, 0.15), ten, 0.005, 3, 0.5) == [pytest.approx((0.1, 0.15))]
    two = N.watershed_segments(np.r_[np.full(5, 0.0), np.full(5, 0.08), 0.0], np.r_[np.full(5, 0.05), np.full(5, 0.12), 0.12], np.r_[np.arange(5), np.arange(5), 9], 0.01, 3, 0.5)
    assert len(two) == 2
    assert N.watershed_segments(np.zeros(0), np.zeros(0), np.zeros(0), 0.01, 1, 0.5) == []
    boxes = [(0, 1, 0, 1), (1.5, 2, 0, 1), (2.4, 3, 0.5, 2), (9, 10, 0, 1), (0, 1, 50, 60)]
    assert N.merge_boxes(boxes, 0.5, 0.5) == [(0, 1, 50, 60), (0, 3, 0, 2), (9, 10, 0, 1)]


def test_censoring_and_medoid():
    assert N.censored(np.array([0, 1, 2, 5, 5.5, 9]), 2).tolist() == [True, False, False, True, False, True]
    assert N.medoid(np.array([[0, 0], [1, 0], [0, 1], [9, 9], [0.4, 0.4]])) == 4


def test_geodesics():
    d = N.geodesic_matrix([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], 4)
    assert d[0, 2] == 2 and np.isinf(d[0, 3]) and (np.diag(d) == 0).all()


@pytest.fixture(scope="module")
def logs():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(-3, 0.3, 600), rng.normal(1, 0.6, 300)])


@pytest.mark.parametrize("student", [False, True])
def test_mixture_recovers_components(logs, student):
    m = X.fit(logs, 2, 0, student)
    assert np.allclose(m.mean, [-3, 1], atol=0.12) and np.allclose(m.weight, [2 / 3, 1 / 3], atol=0.03)
    for q in (0.1, 0.5, 0.9):
        assert m.cdf(m.quantile(q)) == pytest.approx(q, abs=1e-6)
    b = m.boundary(0)
    p = m.posterior(np.array([math.log(b)]))[0]
    assert p[0] == pytest.approx(0.5, abs=1e-6)
    assert X.icl(m, logs) >= X.bic(m, len(logs)) and m.loglik == pytest.approx(m.loglik_of(logs))
    assert abs(m.sample(4000, np.random.default_rng(1)).mean() - logs.mean()) < 0.2


@pytest.mark.parametrize("student", [False, True])
def test_counted_logs_fit_like_repeated_ones(logs, student):
    values, counts = np.unique(np.round(logs, 2), return_counts=True)
    one, many = X.fit(values, 2, 0, student, count=counts), X.fit(np.repeat(values, counts), 2, 0, student)
    assert one.loglik == pytest.approx(many.loglik, rel=1e-5) and one.mean == pytest.approx(many.mean, abs=0.02)
    assert X.icl(one, values, counts) == pytest.approx(X.icl(many, np.repeat(values, counts)), rel=1e-3)


def test_binned_logs_lose_nothing(spark, logs):
    from sonolith.operators import kernels as K

    rows = spark.createDataFrame([("m", float(x)) for x in logs] + [("m", None), ("f", 1.0)], "sex string, v double")
    got = {r.sex: r for r in K.binned_logs(rows, "sex", "v").collect()}
    assert sum(got["m"].n) == len(logs) and got["f"].x == [1.0]
    assert np.dot(got["m"].x, got["m"].n) == pytest.approx(logs.sum()) and got["m"].x == sorted(got["m"].x)
    fits = K.mixture_sweep(rows.where("sex = 'm'"), "sex", range(2, 3), 1, 0, False, "v").collect()
    assert fits[0].loglik == pytest.approx(X.fit(logs, 2, 0, False, 2).loglik, rel=1e-5)


def test_mixture_selection(logs):
    assert min(range(1, 4), key=lambda k: X.bic(X.fit(logs, k, 0), len(logs))) == 2
    lr, p, null = X.bootstrap_lrt(logs[::3], 1, 8, 0, False)
    assert p == 0 and len(null) == 8 and lr > max(null)
    assert X.step_up([(1, 2, 0.0), (2, 3, 0.3), (3, 4, 0.0)], 0.05) == 2 and X.step_up([(1, 2, 0.0), (2, 3, 0.01)], 0.05) == 3
    assert math.isinf(X.cv_loss(logs[:3], 2, 0, False)) and X.cv_loss(logs, 2, 0, False) < X.cv_loss(logs, 1, 0, False)


def test_ridge_is_least_squares_without_penalty():
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(80, 3)), rng.uniform(0.5, 2, 80)
    y = x @ np.array([1.0, -2, 0.5]) + 3 + rng.normal(size=80) * 0.1
    b, c = L.ridge(x, y, 0.0, weight=w)
    a = np.column_stack([x, np.ones(80)])
    want = np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ y)
    assert np.allclose(np.r_[b[:, 0], c], want)
    hb, _ = L.huber_ridge(x, np.where(np.arange(80) == 5, 500, y), 0.0)
    assert np.allclose(hb[:, 0], [1, -2, 0.5], atol=0.2)
    t = np.column_stack([(x[:, 0] * 0.2 + 3) % 6, (x[:, 1] * 0.2 + 1) % 6])
    d = L.torus_ridge(x, t, 6.0, 1e-6) - t
    assert np.abs(d - 6 * np.rint(d / 6)).max() < 0.3


def test_classifiers():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.2 * rng.normal(size=300) > 0).astype(int)
    p = L.predict_proba(x, L.multinomial(x, y, 2))
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(1) == y).mean() > 0.9 and L.auc(y, p[:, 1]) > 0.95
    chosen = L.forward_selection({"noise": x[:, 1:], "signal": x[:, :1]}, y, np.arange(300) % 3, 2)
    assert chosen[0][0] == "signal"
    z = np.exp(0.5 * x[:, 0] + 1) * rng.gamma(20, 1 / 20, 300)
    assert np.allclose(L.gamma_glm(x, z), [0.5, 0, 1], atol=0.1)


def test_paired_margin():
    m, low, high, p = L.paired_margin(np.array([1.0, 2, 3, 4]), np.zeros(4), 500, 0)
    assert m == 2.5 and low < m < high and p == 0
    assert L.paired_margin(np.array([1.0]), np.zeros(1), 10, 0)[3] == 1.0


def test_hidden_states():
    rng = np.random.default_rng(6)
    start, move, emit = (np.log(rng.dirichlet(np.ones(3))) for _ in range(1)), np.log(rng.dirichlet(np.ones(3), 3)), rng.normal(size=(5, 3))
    start = next(start)
    paths = {s: start[s[0]] + emit[0, s[0]] + sum(move[s[i - 1], s[i]] + emit[i, s[i]] for i in range(1, 5)) for s in product(range(3), repeat=5)}
    total, post, moves = L.forward_backward(start, move, emit)
    assert total == pytest.approx(math.log(sum(math.exp(v) for v in paths.values())))
    assert tuple(L.viterbi(start, move, emit)) == max(paths, key=paths.get)
    assert np.allclose(post.sum(axis=1), 1) and moves.sum() == pytest.approx(4)
    x = np.concatenate([rng.normal(0, 0.3, (60, 1)), rng.normal(5, 0.3, (60, 1))])
    fits = [L.fit_gaussian_hmm([x, x[::-1]], k, 0) for k in (1, 2)]
    assert fits[1]["bic"] < fits[0]["bic"] and len(set(fits[1]["states"][0][:60])) == 1


def test_coactivity_matches_pairs():
    c = np.random.default_rng(7).poisson(2, (6, 9)).astype(float)
    c[:, 4] = 0
    r, cos, pop = R.coactivity(c)
    units = np.corrcoef(c)
    assert r == pytest.approx(units[np.triu_indices(6, 1)].mean())
    size = np.linalg.norm(c, axis=0)
    pairs = [(c[:, i] @ c[:, j]) / (size[i] * size[j]) if size[i] and size[j] else 0.0 for i in range(9) for j in range(9) if i != j]
    assert cos == pytest.approx(np.mean(pairs))


def test_splits():
    ids = [f"s{i}" for i in range(20)]
    held = Z.holdout_sessions(ids, 0.1, 1)
    assert len(held) == 2 and held == Z.holdout_sessions(ids[::-1], 0.1, 1) and Z.holdout_sessions(ids, 0.01, 1) == []
    for bad in ((ids, 1.0), ([], 0.1)):
        with pytest.raises(ValueError):
            Z.holdout_sessions(*bad, 1)
    counts = {f"s{i}": [10 + i % 3, 20 - i % 4] for i in range(20)}
    for part in Z.stratified_session_splits(counts, 3, 0.2, 0.05, 1):
        have = np.sum([counts[s] for s in part], axis=0)
        want = np.sum(list(counts.values()), axis=0)
        assert np.abs(have / have.sum() - want / want.sum()).max() <= 0.05


def test_spectral_moments():
    t = np.arange(4096) / 1000
    s = N.spectrum(np.sin(2 * np.pi * 125 * t), 64, 16)
    m = N.spectral_moments(s, np.fft.rfftfreq(64, 1 / 1000))
    assert m["peak_freq"] == pytest.approx(125) and m["mean_freq"] == pytest.approx(125, abs=3) and m["entropy"] < 0.5
    assert math.isnan(N.spectral_moments(np.zeros((5, 2)), np.arange(5))["mean_freq"])
    g = N.spectrogram(np.array([np.sin(t * 700), np.cos(t * 200)]), 64, 16, (20, 30))
    assert g.shape == (20, 30) and g.min() == 0 and g.max() == 1
