"""Softmax regressions by partial sums against the kernel that has all rows."""

from __future__ import annotations

import numpy as np
import pytest

from sonolith.functions import learning as L
from sonolith.operators import regression as G

SCHEMA = "x array<double>, y int, fold int"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    score = np.column_stack([x[:, 0] * 2, x[:, 1] - x[:, 0], 0.5 * x[:, 4]]) + rng.gumbel(size=(400, 3))
    return x, score.argmax(axis=1), np.arange(400) % 4


def table(spark, x, y, fold):
    return spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], SCHEMA).repartition(3)


def test_fits_have_no_gradient_left(spark, data):
    x, y, fold = data
    rows = G.Rows.of(table(spark, *data), 6, 3)
    z = L.standardised(x)
    models = [G.Model((0, 1), None), G.Model((0, 4, 5), 2)]
    for m, b in zip(models, G.fit_many(rows, models), strict=True):
        on = fold != m.left_out if m.left_out is not None else np.ones(len(y), dtype=bool)
        a = np.column_stack([z[on][:, m.columns], np.ones(on.sum())])
        grad = a.T @ (L.softmax(a @ b) - np.eye(3)[y[on]]) / on.sum() + 1e-3 * np.r_[np.ones(len(m.columns)), 0.0][:, None] * b
        assert np.abs(grad).max() < 1e-7
    assert G.held_out_losses(rows, models[1:], G.fit_many(rows, models[1:]))[0] == pytest.approx(L.log_loss(y[fold == 2], L.predict_proba(z[fold == 2][:, [0, 4, 5]], L.multinomial(z[fold != 2][:, [0, 4, 5]], y[fold != 2], 3, rounds=2000))), rel=1e-3)


def test_selection_chooses_like_the_kernel(spark, data):
    x, y, fold = data
    features = {"a": (0, 1), "b": (2, 3), "c": (4, 5)}
    got = G.forward_selection(table(spark, *data), features, 3)
    want = L.forward_selection({n: x[:, list(c)] for n, c in features.items()}, y, fold, 3)
    assert [n for n, _ in got] == [n for n, _ in want][: len(got)] and got[0][0] == "a"
    assert [v for _, v in got] == pytest.approx([v for _, v in want][: len(got)], rel=0.01)
    assert G.forward_selection(table(spark, *data).limit(0), features, 3) == []
