"""Traces and state models take in all sessions and frames."""

from __future__ import annotations

from sonolith import adapters as A
from sonolith import plans
from sonolith.operators import intervals as I
from sonolith.plans import kernels

QUERIES = plans.load()[0]


def test_traces_are_of_all_frames(spark, sf_dir):
    assert QUERIES["smoothed_traces"](spark, sf_dir).count() == A.frames(spark, sf_dir).count()


def test_intervals_are_of_all_days(spark, sf_dir):
    every = I.same_emitter_intervals(A.calls(spark, sf_dir), "s2s").where("not dropped")
    assert kernels._logs(spark, sf_dir).count() == every.count()


def test_states_are_of_all_sessions(spark, sf_dir):
    got = QUERIES["hidden_state_sweep"](spark, sf_dir).collect()
    assert {r.session_id for r in got} == {r.session_id for r in A.frames(spark, sf_dir).select("session_id").distinct().collect()}


def test_null_distributions_are_of_all_days(spark, sf_dir):
    want = {r.session_id for r in kernels._anchors(spark, sf_dir).where("group = 'a'").join(A.spikes(spark, sf_dir), "session_id").select("session_id").distinct().collect()}
    assert max(s.day for s in want) > 10
    for query in ("circular_shuffle_null", "bootstrap_coactivity"):
        assert max(r.session_id.day for r in QUERIES[query](spark, sf_dir).select("session_id").distinct().collect()) > 10
