"""Hand-made cases: ties, touching and overlapping intervals, unknown labels, exact edges, empty sessions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sonolith.functions import scalars as S
from sonolith.functions import strings as T
from sonolith.operators import intervals as I
from sonolith.operators import normalise as Z
from sonolith.operators import points as P
from sonolith.operators import relational as R
from sonolith.operators import triage as G
from sonolith.operators import tuning as U

EV = "session_id string, row_idx long, event_id long, sex string, start double, stop double, duration double"


def events(spark, rows):
    return spark.createDataFrame([("s", i, i, sex, a, b, b - a) for i, (sex, a, b) in enumerate(rows)], EV)


def test_pointer_moves_on_every_row(spark):
    df = events(spark, [("male", 0.0, 1.0), ("female", 2.0, 3.0), ("male", 4.0, 5.0), ("male", 6.0, 7.0), ("male", 6.5, 8.0), ("unassigned", 9.0, 9.5), ("unassigned", 10.0, 11.0)])
    got = {r.row_idx: (r.interval_s, r.dropped) for r in I.same_emitter_intervals(df, "e2s").collect()}
    assert got == {3: (1.0, False), 4: (-0.5, True)}
    assert [r.interval_s for r in I.same_emitter_intervals(df, "s2s").orderBy("row_idx").collect()] == [2.0, 0.5]


def test_bout_rules_at_the_threshold(spark):
    df = events(spark, [("male", 0.0, 1.0), ("male", 3.0, 4.0), ("male", 3.5, 3.6), ("male", 5.7, 6.0)])
    strict = [r.bout for r in I.detect_bouts(df, 2.0, True).orderBy("row_idx").collect()]
    inclusive = [r.bout for r in I.detect_bouts(df, 2.0, False).orderBy("row_idx").collect()]
    assert strict == [0, 0, 0, 1] and inclusive == [0, 1, 1, 2]


def test_touching_intervals_merge(spark):
    df = events(spark, [("male", 0.0, 1.0), ("male", 1.0, 2.0), ("male", 0.5, 0.6), ("male", 2.1, 3.0)])
    assert sorted((r.start, r.stop, r.n_merged) for r in I.merge_intervals(df).collect()) == [(0.0, 2.0, 3), (2.1, 3.0, 1)]


def test_tied_starts_do_not_see_each_other(spark):
    df = events(spark, [("male", 1.0, 9.0), ("male", 1.0, 2.0), ("male", 3.0, 4.0)])
    assert {r.event_id: r.latest_stop for r in I.latest_other_stop(df).collect()} == {0: None, 1: None, 2: 9.0}
    assert {r.event_id: r.is_isolated for r in I.isolated(df).collect()} == {0: False, 1: False, 2: False}
    apart = events(spark, [("male", 0.0, 1.0), ("male", 1.0, 2.0)])
    assert all(r.is_isolated for r in I.isolated(apart).collect())


def test_window_ends(spark):
    pts = spark.createDataFrame([("s", t) for t in (1.0, 2.0, 2.0, 3.0)], "session_id string, t double")
    w = spark.createDataFrame([("s", 1, 1.0, 2.0), ("s", 2, 2.0, 3.0), ("s", 3, 8.0, 9.0)], "session_id string, window_id long, low double, high double")
    n = {c: {r.window_id: r.n for r in P.count_in_windows(pts, w, ("session_id",), closed=c).collect()} for c in (False, True)}
    assert n[False] == {1: 1, 2: 2, 3: 0} and n[True] == {1: 3, 2: 3, 3: 0}


def test_values_on_edges(spark):
    e = S.linear_edges(-32, 32, 14)
    df = spark.createDataFrame([(x,) for x in [*e, float("nan"), -40.0, None]], "x double")
    got = [r[0] for r in df.select(S.open_closed_bin(S.nan_to_null(F.col("x")), e)).collect()]
    assert got == [None, *range(14), None, None, None]
    assert df.select(S.open_closed_bin(F.col("x"), e, True)).first()[0] == 0
    assert [r[0] for r in df.select(S.closed_open_bin(F.col("x"), -32, 32, 14)).collect()][-4:] == [-1, -1, -1, -1]


def test_occupied_frames(spark):
    df = events(spark, [("male", 0.0, 0.0), ("male", 0.25, 0.5), ("male", 0.4, 0.55), ("male", 99.0, 100.0)])
    assert sorted(r.frame_index for r in I.occupied_frames(df, 10.0, 20).collect()) == [0, 2, 3, 4, 5]


def test_runs(spark):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate([True, False, True, True, False, True, True])], "k string, at long, on boolean")
    assert I.longest_true_run(rows, "on", "at", 7, ("k",)).first()[1:] == (2, 2)
    assert I.longest_true_run(rows, "on", "at", 7, ("k",), True).first()[1:] == (3, 5)
    none = rows.withColumn("on", F.lit(False))
    assert I.longest_true_run(none, "on", "at", 7, ("k",)).first()[1:] == (0, None)
    whole = rows.withColumn("on", F.lit(True))
    assert I.longest_true_run(whole, "on", "at", 7, ("k",), True).first().max_run == 7


def test_unknown_labels(spark):
    df = spark.createDataFrame([("error",), ("click",), (None,)], "c string")
    noise = F.col("c").isin("error")
    assert df.where(S.keep_unless(noise)).count() == 2 and df.where(~noise).count() == 1


def test_names(spark):
    df = spark.createDataFrame([("\x00\x00 m1 \x00",), (None,)], "e string")
    assert [r[0] for r in df.select(S.normalise_emitter(F.col("e"))).collect()] == ["m1", None]
    u = spark.createDataFrame([("imec0_cl0012_ch003_good",)], "u string").select(T.parse_unit_id(F.col("u")).alias("p")).first().p
    assert tuple(u) == (0, 12, 3, "good")
    with pytest.raises(Exception, match="not a unit id"):
        spark.createDataFrame([("nonsense",)], "u string").select(T.parse_unit_id(F.col("u"))).collect()
    z = spark.createDataFrame([(3,), (12345,)], "i long").select(T.zero_padded(F.col("i"))).collect()
    assert [r[0] for r in z] == ["0003", "12345"]
    m = spark.createDataFrame([("a=1\nnoise\nb=x=y",)], "t string").select(T.key_values(F.col("t")).alias("m")).first().m
    assert m == {"a": "1", "b": "x=y"}


def test_zero_denominators(spark):
    c = spark.createDataFrame([("s", 0, 0.0, 1.0), ("s", 1, 0.0, 2.0)], "k string, bin int, rate double, seconds double")
    assert U.selectivity(c, ("k",)).first().selectivity is None
    i = U.information(c, ("k",)).first()
    assert i.info_rate == 0 and i.sparsity is None
    one = spark.createDataFrame([("s", 0, 5.0, 1.0), ("s", 1, 0.0, 1.0)], c.schema)
    i = U.information(one, ("k",)).first()
    assert i.info_rate == pytest.approx(2.5) and i.sparsity == pytest.approx(0.5)


def test_constant_feature_is_only_centred(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (2.0, float("nan"))], "a double, b double")
    got = Z.pooled_zscore(df, ["a", "b"]).collect()
    assert [r.a for r in got] == [0, 0, 0] and got[2].b is None and got[1].b == pytest.approx(2**-0.5)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("b", 8)], "k string, v int")
    once = R.replace_slice(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 8), ("b", 9)] == sorted(map(tuple, R.replace_slice(once, new, ["k"]).collect()))


@pytest.mark.parametrize("each", [3, 1000])
def test_frames_side_by_side(spark, each):
    a = spark.createDataFrame([(i * 7 % 20, f"a{i * 7 % 20:02}") for i in range(20)], "k int, a string")
    b = spark.createDataFrame([(-i, f"b{i}") for i in range(12)], "j int, b string")
    got = sorted((r.place, r.a, r.b) for r in R.beside([(a, ["k"]), (b, ["j"])], "place", each).collect())
    assert got == [(i, f"a{i:02}", f"b{11 - i}" if i < 12 else None) for i in range(20)]


def test_foreign_keys_raise(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    assert R.require_all(rows, rows, ["k"], "mouse").count() == 2
    with pytest.raises(Exception, match="no mouse"):
        R.require_all(rows, rows.where("k = 1"), ["k"], "mouse").collect()


def test_majority_is_strict_and_tolerance_inclusive(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 0.0), (2, 1.0), (2, 5.0), (2, 9.0), (3, 0.0)], "unit_id int, peak double")
    assert [(r.unit_id, r.k) for r in G.consistent_peak(df, 1.0, 2).collect()] == [(1, 2)]


def test_half_frames_go_to_even(spark):
    s = spark.createDataFrame([("s", 0.0, 10.0, 100)], "session_id string, begin double, end double, n_frames long")
    p = spark.createDataFrame([(0.05,), (0.15,), (0.25,), (9.99,), (10.0,)], "t double")
    got = P.assign_to_sessions(p, s, 10.0, 60.0).orderBy("t").collect()
    assert [r.frame for r in got] == [0, 2, 2, 99]
