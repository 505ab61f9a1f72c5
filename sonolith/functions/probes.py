"""Probe metadata as text, and synchronisation of recordings, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_triple(text: Column) -> Column:
    """``ap,lf,sync`` as a struct of ints; null where it isn't three numbers."""
    p = F.split(text, ",")
    n = [F.get(p, F.lit(i)).try_cast("int") for i in range(3)]
    return F.when((F.size(p) == 3) & n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull(), F.struct(n[0].alias("ap"), n[1].alias("lf"), n[2].alias("sync")))


def imro_entries(text: Column) -> Column:
    """Entries behind the header of ``(type,n)(channel bank ref ap_gain lf_gain filter)...`` as arrays of ints."""
    entries = F.regexp_extract_all(text, F.lit(r"\((\d+(?: \d+)+)\)"), F.lit(1))
    return F.transform(entries, lambda e: F.transform(F.split(e, " "), lambda v: v.cast("int")))


def volts_per_sample(range_max: Column, max_int: Column, gain: Column) -> Column:
    """Volts of one step: range / largest integer / gain; null if either is 0."""
    return F.try_divide(F.try_divide(range_max, max_int), gain)


def contact_position(kind: Column, geometry: tuple[Column, Column], shank: tuple[Column, Column, Column], pitch: float = 250.0, row: float = 15.0, column: float = 32.0) -> tuple[Column, Column]:
    """x and y of a contact: as its geometry map tells, else from shank, column and row of the older map."""
    s, c, r = shank
    return F.when(kind == "geom", geometry[0]).otherwise(s * pitch + c * column), F.when(kind == "geom", geometry[1]).otherwise(r * row)


def ccf_to_mlapdv(ap: Column, dv: Column, ml: Column, bregma: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """Atlas coordinates (AP backwards, DV down, ML from the left, in um) as ML, AP and DV from bregma, right, front and up positive."""
    a, d, m = (F.lit(float(x)) for x in bregma)
    return ml - m, a - ap, d - dv


def pulse_edges(level: Column, before: Column, threshold: float) -> Column:
    """1 where a signal rises over the threshold, -1 where it falls under, else 0; null at the first sample."""
    on, was = level > threshold, before > threshold
    return F.when(before.isNull(), F.lit(None).cast("int")).when(on & ~was, 1).when(~on & was, -1).otherwise(0)
