"""Names and metadata texts taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT = r"^imec(\d+)_cl(\d+)_ch(\d+)_(.+)$"


def parse_unit_id(name: Column) -> Column:
    """Struct of probe, cluster, channel and label of ``imec<i>_cl<n>_ch<n>_<label>``; other names raise."""
    ok = F.when(name.isNull() | name.rlike(_UNIT), name).otherwise(F.raise_error(F.concat(F.lit("not a unit id: "), name)).cast("string"))
    part = [F.regexp_extract(ok, _UNIT, i) for i in range(1, 5)]
    return F.struct(*[p.cast("int").alias(n) for p, n in zip(part, ("probe", "cluster", "channel"), strict=False)], part[3].alias("label"))


def decode_label(code: Column, classes: dict[str, str] | None = None) -> Column:
    """Struct of number (the first run of digits, 0 if none) and, per class, the letters of it that occur."""
    number = F.coalesce(F.regexp_extract(code, r"\d+", 0).try_cast("int"), F.lit(0))
    found = [F.regexp_extract_all(code, F.lit(f"([{letters}])"), 1).alias(name) for name, letters in (classes or {}).items()]
    return F.when(code.isNotNull(), F.struct(number.alias("number"), *found))


def key_values(text: Column) -> Column:
    """``key=value`` lines as a map; lines without = are left out, of equal keys the last counts."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    return F.map_from_entries(pairs)


def geometry(rows: DataFrame, text: str, keys: list[str], fields: list[str]) -> DataFrame:
    """``(a,b,..)(a,b,..)`` as one row a tuple: place and whole-number fields."""
    tuples = F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), 1)
    out = rows.select(*keys, F.posexplode(tuples).alias("place", "t")).withColumn("t", F.split("t", ","))
    return out.select(*keys, "place", *[F.trim(F.col("t")[i]).cast("int").alias(f) for i, f in enumerate(fields)])


def zero_padded(index: Column, width: int = 4) -> Column:
    """The number with zeros in front; longer numbers stay whole."""
    s = index.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))
