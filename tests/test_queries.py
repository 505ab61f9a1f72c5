"""Every query that SQL can express gives what DuckDB gives; the others run and keep their schema."""

from __future__ import annotations

import math

import pytest

from sonolith import plans
from tests.compare import check, plain

QUERIES, ORACLES = plans.load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    check(QUERIES[name], ORACLES[name], spark, sf_dir, duck)


def numbers(value):
    if isinstance(value, float):
        yield value
    elif isinstance(value, list | tuple):
        for v in value:
            yield from numbers(v)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_gives_finite_rows_twice_alike(name, spark, sf_dir):
    """What SQL can't express; values are held against naive versions where the kernels are tested."""
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and all(math.isfinite(v) for r in rows for v in numbers(tuple(r)))
    again = QUERIES[name](spark, sf_dir).collect()
    order = lambda x: sorted(tuple(plain(v if not isinstance(v, float) else float(f"{v:.6g}")) for v in r) for r in x)
    assert order(rows) == order(again)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
