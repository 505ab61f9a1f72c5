from __future__ import annotations

import numpy as np

from sonolith.functions import masks as M


def block(a, b, c, d):
    m = np.zeros((8, 10), dtype=bool)
    m[a:b, c:d] = True
    return m


def test_instances_merge_to_a_fixed_point():
    got = M.merge_instances([block(0, 4, 0, 4), block(0, 4, 1, 5), block(1, 2, 1, 2), block(6, 8, 8, 10), np.zeros((8, 10), bool)], 0.5, 0.9)
    assert [int(m.sum()) for m in got] == [20, 4]
    assert M.merge_instances([], 0.5, 0.5) == []


def test_components_touch_at_corners():
    m = block(0, 2, 0, 2) | block(2, 4, 2, 4) | block(6, 8, 8, 10)
    c = M.components(m)
    assert c.max() == 2 and c[0, 0] == c[3, 3] != c[7, 9] and c[5, 5] == 0
    assert (M.components(np.ones((3, 3), bool)) == 1).all() and (M.components(np.zeros((3, 3), bool)) == 0).all()


def test_windows_and_unions():
    assert M.time_window(0.5, 1.0, 2, 10).sum() == 10 and M.time_window(0.0, 1.0, 2, 10).sum() == 2
    w = block(0, 1, 0, 1)
    assert (M.union([], w) == w).all() and M.union([block(0, 1, 0, 2), block(3, 4, 0, 2)], w).sum() == 4


def test_boxes_find_a_bright_patch():
    rng = np.random.default_rng(0)
    s = rng.normal(size=(20, 30)) * 0.1
    s[5:9, 10:16] += 10
    assert len(M.boxes(s, 0.7, 6.0, 4)) == 1
    t0, t1, f0, f1 = M.boxes(s, 0.7, 6.0, 4)[0]
    assert t0 <= 10 and t1 >= 16 and f0 <= 5 and f1 >= 9
    assert M.boxes(np.zeros((5, 5)), 1.0, 1.0, 1) == []


def test_full_mask_gives_the_wave_back():
    w = np.sin(np.arange(200) / 3)
    out = M.masked_waveform(w, np.ones((17, 60), bool), 32, 4)
    assert np.allclose(out[32:160], w[32:160])
    assert np.allclose(M.masked_waveform(w, np.zeros((17, 60), bool), 32, 4), 0)


def test_spiral_uses_each_point_once():
    p = np.random.default_rng(1).normal(size=(30, 2))
    o = M.spiral_order(p, p.mean(axis=0), 3.0, 12)
    assert len(set(o.tolist())) == 12 and len(M.spiral_order(p[:3], p[0], 2.0, 9)) == 3 and len(M.spiral_order(p[:0], np.zeros(2), 2.0, 9)) == 0
