"""Flags on tested modulations and their roll-ups over units, sessions and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.functions.scalars import finite


def modulation_flag(vmi: Column, p: Column, n: Column, alpha: float = 0.01, least: int = 10) -> Column:
    """``excited`` or ``suppressed`` by sign, where there are enough bouts and p is below alpha; else null."""
    return F.when((n >= least) & (p < alpha), F.when(vmi > 0, "excited").when(vmi < 0, "suppressed"))


def run_flag(max_run: Column, peak: Column, z: float = 3.0, least: int = 3) -> Column:
    return F.coalesce((max_run >= least) & (F.abs(peak) >= z), F.lit(False))


def valid(tests: DataFrame, least: int = 10) -> DataFrame:
    """Tests with enough bouts and a p value."""
    return tests.where((F.col("n_bouts") >= least) & F.col("p").isNotNull() & finite(F.col("vmi")).isNotNull())


def best_session(tests: DataFrame, least: int = 10, alpha: float = 0.01) -> DataFrame:
    """Per unit the test of greatest absolute index, of all valid ones, significant or not; the first if tied."""
    first = F.struct(F.abs("vmi").alias("a"), (-F.col("test_id")).alias("t"), (-F.col("line")).alias("l"), "vmi", "session_id", (F.col("p") < alpha).alias("s"))
    best = valid(tests, least).groupBy("unit_id").agg(F.max(first).alias("b"))
    return best.select("unit_id", F.col("b.vmi").alias("vmi"), F.col("b.session_id").alias("session_id"), F.col("b.s").alias("significant"))


def condition_medians(tests: DataFrame, a: str, b: str, least: int = 10, alpha: float = 0.01) -> DataFrame:
    """Units tested in both conditions: median index of each, any significant, median rate over both."""
    own = valid(tests, least).where(F.col("condition").isin(a, b))
    return (
        own.groupBy("unit_id")
        .agg(
            F.median(F.when(F.col("condition") == a, F.col("vmi"))).alias("median_a"), F.median(F.when(F.col("condition") == b, F.col("vmi"))).alias("median_b"),
            F.bool_or(F.col("p") < alpha).alias("any_significant"), F.median("rate").alias("median_rate"),
        )
        .where("median_a is not null and median_b is not null")
    )


def consistency(tests: DataFrame, n_least: int, least: int = 10, alpha: float = 0.01) -> DataFrame:
    """Share of a unit's tested sessions in which it is significant, and its mean greatest index."""
    per = valid(tests, least).groupBy("unit_id", "session_id").agg(F.max(F.abs("vmi")).alias("top"), F.bool_or(F.col("p") < alpha).alias("sig"))
    out = per.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_tested"), F.sum(F.col("sig").cast("long")).alias("n_sig"), F.avg("top").alias("mean_top"))
    return out.where(F.col("n_tested") >= n_least).withColumn("share", F.col("n_sig") / F.col("n_tested"))


def sign_flips(tests: DataFrame, n_least: int, least: int = 10, alpha: float = 0.01) -> DataFrame:
    """Units by whether they are significant in both directions, one, or never."""
    sig = F.col("p") < alpha
    per = valid(tests, least).groupBy("unit_id").agg(
        F.count_distinct("session_id").alias("n"), F.bool_or(sig & (F.col("vmi") > 0)).alias("pos"), F.bool_or(sig & (F.col("vmi") < 0)).alias("neg")
    )
    kind = F.when(F.col("pos") & F.col("neg"), "both").when(F.col("pos"), "positive_only").when(F.col("neg"), "negative_only").otherwise("never")
    return per.where(F.col("n") >= n_least).select("unit_id", kind.alias("kind"))


def unit_index(tests: DataFrame, least: int = 10, alpha: float = 0.01) -> DataFrame:
    """One index a unit: of the significant ones the extreme (positive if tied), else the median of all."""
    sig = F.col("p") < alpha
    per = valid(tests, least).groupBy("unit_id").agg(
        F.max(F.when(sig & (F.col("vmi") > 0), F.col("vmi"))).alias("top"), F.min(F.when(sig & (F.col("vmi") < 0), F.col("vmi"))).alias("low"), F.median("vmi").alias("mid")
    )
    both = F.when(F.col("top") >= -F.col("low"), F.col("top")).otherwise(F.col("low"))
    value = F.when(F.col("top").isNotNull() & F.col("low").isNotNull(), both).otherwise(F.coalesce("top", "low", "mid"))
    return per.select("unit_id", value.alias("vmi"))


def consistent_peak(peaks: DataFrame, tolerance: float, k_least: int, key: str = "unit_id", value: str = "peak") -> DataFrame:
    """Units whose significant peaks agree: the largest set within the tolerance (inclusive), of k_least or more and over half.

    The largest set begins at some peak, so each peak counts those from itself to itself + tolerance.
    """
    ahead = f"count(*) over (partition by {key} order by {value} range between current row and {float(tolerance)!r}D following)"
    per = peaks.withColumn("k", F.expr(ahead)).groupBy(key).agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n_sig"), F.median(value).alias("median_peak"))
    return per.where((F.col("n_sig") >= 2) & (F.col("k") >= k_least) & (F.col("k") / F.col("n_sig") > 0.5))


def set_overlap(flags: DataFrame, sets: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in each combination of memberships."""
    return flags.groupBy(*by, *sets).agg(F.count(F.lit(1)).alias("n"))


def tier(a: Column, b: Column, c: Column, names: tuple[str, str, str] = ("pose", "movement", "dyadic")) -> Column:
    """Name of the combination of three booleans, ``none`` if all are false."""
    parts = F.filter(F.array(*[F.when(x, F.lit(n)) for x, n in zip((a, b, c), names, strict=True)]), lambda v: v.isNotNull())
    return F.when(F.size(parts) == 0, "none").otherwise(F.array_join(parts, "+"))
