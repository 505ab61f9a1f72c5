"""Rows of Spark and of DuckDB, made comparable."""

from __future__ import annotations

import math
from decimal import Decimal


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return repr(v)


def check(query, sql, spark, sf_dir, duck):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    run = duck.execute(sql)
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in run.fetchall())
    assert got == want
