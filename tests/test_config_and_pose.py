from __future__ import annotations

import math

import numpy as np
import pytest

from sonolith.functions import config as C
from sonolith.functions import pose as P


def test_settings():
    s = {"a": {"k": 1, "b": {"k": 2}}, "z": 3}
    assert C.paths_of(s, "k") == ["a.k", "a.b.k"]
    assert C.overridden(s, ["z=4", "a.b.k=[1, 2]"]) == {"a": {"k": 1, "b": {"k": [1, 2]}}, "z": 4} and s["z"] == 3
    with pytest.raises(KeyError):
        C.overridden(s, ["k=5"])
    assert C.typed("true") is True and C.typed("None") is None and C.typed("1e-3") == 0.001 and C.typed("plain") == "plain"
    assert C.digest({"a": 1, "b": 2}) == C.digest({"b": 2, "a": 1})


def test_provenance():
    a, b = {"v": 1, "t": {"run": 1}, "run": 7}, {"v": 1, "t": {"run": 1}, "run": 8}
    assert C.blocks_equal(a, b, ("run",)) and not C.blocks_equal(a, {**b, "t": {"run": 2}}, ("run",))
    p = C.attach({"x": 1}, _run_metadata={"v": 1})
    assert C.detach(p) == ({"x": 1}, {"_run_metadata": {"v": 1}})
    for bad in ({"odd": {}}, {"_run_metadata": {}}):
        with pytest.raises(ValueError):
            C.attach(p, **bad)


def test_rotations_and_frames():
    a, b, c = 0.3, -0.4, 1.1
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    assert np.allclose(P.euler_angles((rz @ ry @ rx)[None]), np.degrees([[a, b, c]]))
    m = P.head_frame(np.array([[2.0, 0, 0]]), np.array([[1.0, 1, 0]]), np.array([[1.0, -1, 0]]), np.array([[0.0, 0, 0]]), 1e-6)
    assert np.allclose(m[0], np.eye(3))
    assert np.isnan(P.head_frame(*[np.zeros((1, 3))] * 4, 1e-6)).any()


def test_curvature():
    t = np.linspace(0, math.pi / 2, 9)
    arc = np.column_stack([np.cos(t), np.sin(t)])[None]
    assert P.tail_curvature(arc)[0] == pytest.approx(t[1], rel=0.01)
    assert P.tail_curvature(np.column_stack([t, t])[None])[0] == pytest.approx(0, abs=1e-6)
    assert np.isnan(P.tail_curvature(np.zeros((1, 5, 2)))[0])


def test_sources():
    x = P.nelder_mead(lambda p: float((p[0] - 3) ** 2 + (p[1] + 1) ** 2), np.zeros(2))
    assert np.allclose(x, [3, -1], atol=1e-3)
    d = np.arange(6.0)
    assert P.exponential_decay(d, 5 * np.exp(-0.7 * d)) == pytest.approx(0.7)
    contacts = np.array([(x, y) for y in range(0, 160, 20) for x in (0, 32)], dtype=float)
    r = np.sqrt(((contacts - [10, 70]) ** 2).sum(axis=1) + 30**2)
    assert np.allclose(P.triangulate(contacts, 900 / r)[:3], [10, 70, 30], atol=1.0)
    assert math.isnan(P.noise_deviation(np.zeros(0), np.zeros(0), 1, 1)) and P.noise_deviation(np.zeros(1), np.ones(1), 1, 1) == 0


def test_modes_and_lattice():
    assert P.modes(np.array([0.5, 0.5]), np.array([-3.0, 3.0]), np.array([0.5, 0.5])) == pytest.approx([-3, 3], abs=1e-4)
    assert len(P.modes(np.array([0.5, 0.5]), np.array([-0.1, 0.1]), np.array([1.0, 1.0]))) == 1
    post = P.lattice_posterior(np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[1.0, 0.0]]))
    assert post[0, 0] > 0.98
    assert P.lattice_embedding(np.array([[0.5, 0.5]]), np.array([[0.95], [0.05]])) == pytest.approx(0, abs=1e-9)
