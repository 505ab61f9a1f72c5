"""Queries on tables that the generated ones have no rows like: against their SQL over the same tables."""

from __future__ import annotations

import math
import time

import duckdb
import numpy as np
import pytest

from sonolith import plans
from sonolith.functions import learning as L
from sonolith.operators import manifold as M
from tests.compare import check

QUERIES, ORACLES = plans.load()


def same_as_sql(name, spark, folder, **tables):
    """Holds a query against its SQL over tables given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    check(QUERIES[name], ORACLES[name], spark, str(folder), con)


def events(sf_dir, value):
    return f"select * replace ({value} as value) from '{sf_dir}/events.parquet'"


def test_bouts_that_last_no_time(spark, sf_dir, tmp_path):
    """Their rate is infinite with a spike at the onset and NaN without, as in SQL."""
    same_as_sql("vocal_modulation_index", spark, tmp_path, events=events(sf_dir, "case when event_id % 2 = 0 then 0 else value end"))


def test_geometric_means_of_events_that_last_no_time(spark, sf_dir, tmp_path):
    """One makes the mean 0, as in SQL; events of unknown length come last."""
    same_as_sql("amplitude_strata", spark, tmp_path, events=events(sf_dir, "case event_id % 50 when 0 then 0 when 1 then null else value end"))


def test_channels_of_a_place_are_cut_to_the_nearest_before_they_meet_units(spark, sf_dir, tmp_path):
    """Few rows meet units however many channels there are; units twice or of unknown place are as in SQL."""
    part = f"select p_partkey, case when p_partkey % 7 <> 0 then p_size end as p_size from '{sf_dir}/part.parquet'"
    part += f" union all select p_partkey, p_size + 1 from '{sf_dir}/part.parquet' where p_partkey % 5 = 0"
    same_as_sql("nearest_channels", spark, tmp_path, part=part, supplier="select i as s_suppkey from range(3000) r(i)")
    many = tmp_path / "many"
    many.mkdir()
    duckdb.execute(f"copy (select i as p_partkey, cast(i % 50 + 1 as integer) as p_size from range(40000) r(i)) to '{many}/part.parquet' (format parquet)")
    duckdb.execute(f"copy (select i as s_suppkey from range(400000) r(i)) to '{many}/supplier.parquet' (format parquet)")  # 16 billion pairs
    assert QUERIES["nearest_channels"](spark, str(many)).count() == 200_000


def test_chains_of_many_sequences():
    """As forward_backward and viterbi have each sequence by itself, in a small part of their time."""
    rng = np.random.default_rng(1)
    for k in (1, 2, 3):
        start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
        emit = rng.normal(0, 30, (7, 5, k))
        total, post, moves = L.expected_states(start, move, emit)
        one = [L.forward_backward(np.log(start), np.log(move), emit[:, i]) for i in range(5)]
        assert total == pytest.approx(sum(x[0] for x in one)) and moves == pytest.approx(sum(x[2] for x in one))
        assert all(post[:, i] == pytest.approx(x[1]) for i, x in enumerate(one))
        paths = L.likeliest_paths(np.log(start), np.log(move), emit)
        assert all((paths[:, i] == L.viterbi(np.log(start), np.log(move), emit[:, i])).all() for i in range(5))
    x = np.repeat(rng.integers(0, 2, 4000), 5)[:, None] * 5.0 + rng.normal(size=(20_000, 2))
    begun = time.process_time()
    m = L.fit_gaussian_hmm(np.split(x, [*range(100, 19_900, 100), 19_930]), 3, 2, 15)
    assert time.process_time() - begun < 4  # one sequence after another takes 15 s and more
    assert sum(map(len, m["states"])) == 20_000 and math.isfinite(m["loglik"])


def test_amplitudes_of_one_long_unit(spark, tmp_path):
    """40,000 bins of a unit are groups, not passes over its rows; a unit of few rows is NaN, one of a single row isn't there."""
    unit = "case when i % 1000 = 7 then 1 when i = 3 then 2 else 5 * (i % 3) end"
    same_as_sql("amplitude_variation", spark, tmp_path, lineitem=f"select {unit} as l_suppkey, cast(i as bigint) as l_orderkey, cast(hash(i) % 9973 as double) + 1 as l_extendedprice from range(2000000) r(i) where i > 300000 or i % 1000 <> 7")


def test_neighbours_are_sought_in_few_rows(spark, tmp_path):
    """Dense spots, copies and points across the seam give what brute force gives, and no join makes pairs of near points."""
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.uniform(0, 6, (1500, 2)), np.mod(rng.normal(0, 1e-3, (1500, 2)), 6), np.repeat(rng.uniform(0, 6, (20, 2)), 30, axis=0), rng.integers(0, 12, (900, 2)) / 2])
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xy)], "vec_id long, x double, y double")
    got = {}
    for r in M.nearest_neighbours(points, 5, 6.0, 100).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.d, r.other)
    for i, v in enumerate(xy):
        g = v - xy
        g -= 6 * np.rint(g / 6)
        d = np.sqrt((g**2).sum(axis=1))
        d[i] = np.inf
        assert got[i] == {n + 1: (pytest.approx(d[j]), j) for n, j in enumerate(np.argsort(d, kind="stable")[:5])}


def test_neighbours_of_a_crowd(spark, tmp_path):
    """40,000 points in a cell of a fixed grid would make 1.6 billion pairs."""
    near = "[1 + hash(i) % 100003 / 1e7, 1 + hash(i + 7) % 100019 / 1e7, 0, 0]::FLOAT[]"
    duckdb.execute(f"copy (select cast(i as bigint) as vec_id, {near} as embedding, 0 as label from range(40000) r(i)) to '{tmp_path}/embeddings.parquet' (format parquet)")
    assert QUERIES["torus_neighbours"](spark, str(tmp_path)).count() == 200_000
