"""How good predictions are: scores over rows, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.functions.scalars import nan_to_null, ratio
from sonolith.operators.tuning import ranked


def brier(rows: DataFrame, probabilities: list[str], y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over rows of the sum over classes of (p - 1 if it is the class)^2; classes are 0, 1, .."""
    s = sum(((F.col(p) - (F.col(y) == i).cast("double")) ** 2 for i, p in enumerate(probabilities)), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.avg(s).alias("brier"))


def top_label(rows: DataFrame, probabilities: list[str]) -> DataFrame:
    """Adds y_hat (the first of equal ones) and confidence."""
    p = F.array(*probabilities)
    return rows.withColumns({"confidence": F.array_max(p), "y_hat": (F.array_position(p, F.array_max(p)) - 1).cast("int")})


def calibration_error(rows: DataFrame, n_bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error of the top label over bins (low, high] of confidence; confidence 0 is in none."""
    from sonolith.functions.scalars import linear_edges, open_closed_bin

    b = rows.withColumn("__bin", open_closed_bin(F.col("confidence"), linear_edges(0.0, 1.0, n_bins)))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    per = b.where("__bin is not null").groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("k"), F.avg((F.col("y") == F.col("y_hat")).cast("double")).alias("acc"), F.avg("confidence").alias("conf"))
    joined = per.join(total, list(keys)) if keys else per.join(F.broadcast(total))  # one row
    return joined.groupBy(*keys).agg(F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("k") / F.col("__n")).alias("ece"))


def confusion(rows: DataFrame, labels: list[int], y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Counts of all pairs of labels, in order, 0 where there are none."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "y int, y_hat int")
    n = rows.groupBy(F.col(y).alias("y"), F.col(y_hat).alias("y_hat")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["y", "y_hat"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def matthews(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Correlation of classes over any number of them; 0 where one side has a single class."""
    cell = rows.groupBy(*keys, "y", "y_hat").agg(F.count(F.lit(1)).alias("n"))
    t = cell.groupBy(*keys, "y").agg(F.sum("n").alias("n"))
    p = cell.groupBy(*keys, "y_hat").agg(F.sum("n").alias("n"))
    both = t.select(*keys, F.col("y").alias("k"), F.col("n").alias("t"), F.lit(0).alias("p")).unionByName(p.select(*keys, F.col("y_hat").alias("k"), F.lit(0).alias("t"), F.col("n").alias("p")))
    per = both.groupBy(*keys, "k").agg(F.sum("t").cast("double").alias("t"), F.sum("p").cast("double").alias("p"))
    sums = per.groupBy(*keys).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") ** 2).alias("tt"), F.sum(F.col("p") ** 2).alias("pp"), F.sum("t").alias("s"))
    right = cell.groupBy(*keys).agg(F.sum(F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(0)).cast("double").alias("c"))
    j = sums.join(right, list(keys)) if keys else sums.join(F.broadcast(right))  # one row
    d = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return j.select(*keys, F.coalesce(ratio(F.col("c") * F.col("s") - F.col("tp"), d), F.lit(0.0)).alias("mcc"))


def pearson(rows: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Correlation; null where either side doesn't vary."""
    return rows.groupBy(*keys).agg(F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), nan_to_null(F.corr(a, b))).alias("r"))


def spearman(rows: DataFrame, a: str, b: str, keys: tuple[str, ...]) -> DataFrame:
    """Correlation of ranks, ties by their mean."""
    return pearson(ranked(ranked(rows, a, keys, "__ra"), b, keys, "__rb"), "__ra", "__rb", keys).withColumnRenamed("r", "rho")


def errors(y: Column, y_hat: Column) -> dict[str, Column]:
    """Aggregates: root mean squared and mean absolute error."""
    return {"rmse": F.sqrt(F.avg((y - y_hat) ** 2)), "mae": F.avg(F.abs(y - y_hat))}


def cohens_d(rows: DataFrame, value: str, group: str, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Difference of means over the pooled sample deviation, finite values only."""
    from sonolith.functions.scalars import finite

    x = finite(F.col(value))
    g = {s: F.when(F.col(group) == v, x) for s, v in (("a", a), ("b", b))}
    agg = rows.groupBy(*keys).agg(*[f(g[s]).alias(f"{n}{s}") for s in "ab" for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(ratio((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), F.col("na") + F.col("nb") - 2))
    return agg.select(*keys, ratio(F.col("ma") - F.col("mb"), pooled).alias("d"))


def null_position(boot: DataFrame, null: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """p = (null values of at least the mean + 1) / (n + 1) and z by the null's population deviation."""
    m = boot.groupBy(*keys).agg(F.avg(value).alias("m"))
    j = null.join(m, list(keys)).groupBy(*keys).agg(F.first("m").alias("observed"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) >= F.col("m")).alias("k"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    return j.select(*keys, "observed", ((F.col("k") + 1) / (F.col("n") + 1)).alias("p"), ratio(F.col("observed") - F.col("mu"), F.col("sd")).alias("z"))


def mann_whitney(rows: DataFrame, value: str, group: str, a: str, keys: tuple[str, ...]) -> DataFrame:
    """U of the group a, its z by the normal approximation with ties, and sizes."""
    own = rows.where(F.col(value).isNotNull())
    x = ranked(own, value, keys, "__r")
    same = Window.partitionBy(*keys, value)
    x = x.withColumn("__t", F.count(F.lit(1)).over(same))
    is_a = F.col(group) == a
    agg = x.groupBy(*keys).agg(F.count_if(is_a).alias("na"), F.count_if(~is_a).alias("nb"), F.sum(F.when(is_a, F.col("__r"))).alias("ra"), F.sum(F.col("__t").cast("double") ** 2 - 1).alias("ties"))
    n = F.col("na") + F.col("nb")
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1))))
    return agg.select(*keys, "na", "nb", u.alias("u"), ratio(u - F.col("na") * F.col("nb") / 2, sd).alias("z"))


def anova(rows: DataFrame, value: str, group: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One-way F, omega squared and degrees of freedom."""
    per = rows.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per = per.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    agg = per.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    msw = ratio(F.col("ssw"), F.col("n") - F.col("k"))
    return agg.select(*keys, "k", "n", ratio(F.col("ssb") / (F.col("k") - 1), msw).alias("f"), ratio(F.col("ssb") - (F.col("k") - 1) * msw, F.col("ssb") + F.col("ssw") + msw).alias("omega2"))


def align_probabilities(classes: Column, probabilities: Column, canonical: list[int]) -> Column:
    """Probabilities in canonical order, 0 for classes that the model lacks; unknown classes raise."""
    if canonical != sorted(canonical):
        raise ValueError("canonical classes are not sorted")
    known = F.array(*[F.lit(c) for c in canonical])
    odd = F.array_except(classes, known)
    own = F.map_from_arrays(classes, probabilities)
    placed = F.transform(known, lambda c: F.coalesce(own[c], F.lit(0.0)))
    return F.when(F.size(odd) == 0, placed).otherwise(F.raise_error(F.concat(F.lit("unknown classes: "), F.to_json(odd))).cast("array<double>"))
