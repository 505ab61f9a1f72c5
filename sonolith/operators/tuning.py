"""Occupancy-normalised tuning: histograms of features, rates by bin, and what is said of a curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.functions.scalars import linear_edges, nan_to_null, open_closed_bin, ratio


def occupancy(frames: DataFrame, feature: str, low: float, high: float, n: int, fps: float, keys: tuple[str, ...], first_closed: bool = False) -> DataFrame:
    """Seconds a feature spends in each bin (low, high]; its exact minimum counts only if ``first_closed``."""
    at = open_closed_bin(nan_to_null(F.col(feature)), linear_edges(low, high, n), first_closed)
    return frames.withColumn("bin", at).where("bin is not null").groupBy(*keys, "bin").agg((F.count(F.lit(1)) / F.lit(fps)).alias("seconds"))


def occupancy_2d(frames: DataFrame, x: str, y: str, low: float, high: float, n_side: int, fps: float, keys: tuple[str, ...]) -> DataFrame:
    """Seconds in each cell of a square grid, bins (low, high] on both axes."""
    edges = linear_edges(low, high, n_side)
    out = frames.withColumns({"gx": open_closed_bin(F.col(x), edges), "gy": open_closed_bin(F.col(y), edges)}).where("gx is not null and gy is not null")
    return out.groupBy(*keys, "gx", "gy").agg((F.count(F.lit(1)) / F.lit(fps)).alias("seconds"))


def rate_map(frames: DataFrame, spikes: DataFrame, feature: str, low: float, high: float, n: int, fps: float, keys: tuple[str, ...], unit: str = "unit_id", shuffles: DataFrame | None = None, n_frames: int | None = None) -> DataFrame:
    """Spikes and seconds of each (unit, bin), and of each shuffle if there are any.

    Spikes are counted by frame before they meet the frames, so the join works on counts. A shuffle
    (shuffle, shift) adds its whole number of frames, modulo ``n_frames``; then each unit's counts
    meet its session's bins as one array (frames from 0 without gaps), and shuffles are made and
    summed where they lie, so what is exchanged doesn't grow with them.
    """
    edges = linear_edges(low, high, n)
    binned = frames.withColumn("bin", open_closed_bin(nan_to_null(F.col(feature)), edges)).where("bin is not null").select(*keys, "frame_index", "bin")
    seconds = binned.groupBy(*keys, "bin").agg((F.count(F.lit(1)) / F.lit(fps)).alias("seconds"))
    per_frame = spikes.groupBy(*keys, unit, "frame").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("frame", "frame_index")
    by = [*keys, unit, "bin"]
    if shuffles is None:
        counts = per_frame.join(binned, [*keys, "frame_index"]).groupBy(*by).agg(F.sum("n").alias("spikes"))
    else:
        at = open_closed_bin(nan_to_null(F.col(feature)), edges)
        bins = frames.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", at.alias("bin")))), lambda x: x["bin"]).alias("bins"))
        fired = per_frame.groupBy(*keys, unit).agg(F.collect_list(F.struct("frame_index", "n")).alias("fired"))
        moved = fired.join(bins, list(keys)).join(F.broadcast(shuffles))  # a parameter table
        one = F.transform("fired", lambda x: F.struct(F.get("bins", F.pmod(x["frame_index"] + F.col("shift"), F.lit(n_frames)).cast("int")).alias("bin"), x["n"].alias("n")))
        by.append("shuffle")
        counts = moved.select(*keys, unit, "shuffle", F.inline(one)).where("bin is not null").groupBy(*by).agg(F.sum("n").alias("spikes"))
    return counts.join(seconds, [*keys, "bin"]).withColumn("rate", F.col("spikes") / F.col("seconds"))


def null_block(rates: DataFrame, keys: tuple[str, ...], value: str = "rate") -> DataFrame:
    """Over shuffles: mean, population deviation, and the 0.5, 2.5, 97.5 and 99.5 percentiles."""
    x = nan_to_null(F.col(value))
    p = F.percentile(x, F.array(*[F.lit(v) for v in (0.005, 0.025, 0.975, 0.995)]))
    out = rates.groupBy(*keys).agg(F.avg(x).alias("null_mean"), F.stddev_pop(x).alias("null_std"), p.alias("p"))
    return out.select(*keys, "null_mean", "null_std", *[F.col("p")[i].alias(name) for i, name in enumerate(("p_low", "p025", "p975", "p_high"))])


def peak_z(curve: DataFrame, keys: tuple[str, ...], order: str = "bin") -> DataFrame:
    """Bin and value of the greatest absolute z; bins whose null doesn't vary are left out; first of equal ones."""
    z = F.when(F.col("null_std") > 0, (F.col("rate") - F.col("null_mean")) / F.col("null_std"))
    best = F.max(F.struct(F.abs("z").alias("a"), (-F.col(order)).alias("neg"), F.col("z").alias("z")))
    return curve.withColumn("z", z).where("z is not null").groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.neg")).alias("peak_bin"), F.col("b.z").alias("peak_z"))


def selectivity(curve: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(max - min) / (max + min); null where that is 0."""
    return curve.groupBy(*keys).agg(ratio(F.max("rate") - F.min("rate"), F.max("rate") + F.min("rate")).alias("selectivity"))


def information(curve: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Skaggs' information in bits a second and sparsity, over occupied bins, those without spikes included.

    ``curve``: rate and seconds of each bin. Rates of 0 count in the mean and add nothing to the information.
    """
    t, r = F.col("seconds"), F.col("rate")
    sums = curve.where("seconds > 0").groupBy(*keys).agg(
        F.sum(t).alias("t"), F.sum(t * r).alias("tr"), F.sum(t * r * r).alias("trr"), F.sum(F.when(r > 0, t * r * F.log2(r)).otherwise(0.0)).alias("trl"),
    )
    mean = F.col("tr") / F.col("t")
    # sum of p r log2(r / mean), as the sum of p r is the mean
    info = F.when(mean > 0, F.col("trl") / F.col("t") - mean * F.log2(mean)).otherwise(0.0)
    return sums.select(*keys, info.alias("info_rate"), ratio(mean * mean, F.col("trr") / F.col("t")).alias("sparsity"))


def coherence(grid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Correlation of each cell's rate with the mean of its neighbours, eight at most."""
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    lent = grid.withColumn("s", F.explode(steps)).select(*keys, (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), "rate")
    around = lent.groupBy(*keys, "gx", "gy").agg(F.avg("rate").alias("around"))
    return grid.join(around, [*keys, "gx", "gy"]).groupBy(*keys).agg(F.corr("rate", "around").alias("coherence"))


def ranked(rows: DataFrame, value: str, keys: tuple[str, ...], out: str) -> DataFrame:
    """Adds ranks from 1, ties by their mean."""
    w = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return rows.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)


def monotonicity(curve: DataFrame, keys: tuple[str, ...], order: str = "bin") -> DataFrame:
    """Spearman's correlation of bin and rate, from three bins on; null where either doesn't vary."""
    x = ranked(ranked(curve.where(F.col("rate").isNotNull() & ~F.isnan("rate")), order, keys, "__a"), "rate", keys, "__b")
    agg = x.groupBy(*keys).agg(F.corr("__a", "__b").alias("r"), F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, F.when(F.col("n") >= 3, nan_to_null(F.col("r"))).alias("monotonicity"))


def ramp_index(curve: DataFrame, keys: tuple[str, ...], late: float = -0.1, early: float = -1.5, centre: str = "centre") -> DataFrame:
    """(late - early) / (late + early), of the bins with the nearest centres, the earlier if two are as near."""
    a = F.min_by("rate", F.struct(F.abs(F.col(centre) - late), F.col(centre)))
    b = F.min_by("rate", F.struct(F.abs(F.col(centre) - early), F.col(centre)))
    return curve.groupBy(*keys).agg(a.alias("a"), b.alias("b")).select(*keys, ratio(F.col("a") - F.col("b"), F.col("a") + F.col("b")).alias("ramp"))


def outside_null(curve: DataFrame) -> DataFrame:
    """Adds excited (above the 99.5 percentile of the null) and suppressed (below the 0.5)."""
    return curve.withColumns({"excited": F.col("rate") > F.col("p_high"), "suppressed": F.col("rate") < F.col("p_low")})
