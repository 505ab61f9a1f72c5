"""Numerical kernels by group: each group of rows goes to numpy once, through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.functions import learning as L
from sonolith.functions import mixtures as X
from sonolith.functions import numeric as N


def per_group(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], Iterable[tuple]], schema: str) -> DataFrame:
    """``work`` gives tuples of the schema's columns; the keys are put before them."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *[c.split()[0] for c in schema.split(", ")]]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        head = tuple(p[k].iloc[0] for k in keys)
        return pd.DataFrame([(*head, *t) for t in work(p)], columns=names)

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def smoothed(rows: DataFrame, keys: list[str], order: str, value: str, sigma: float) -> DataFrame:
    """Gaussian smoothing in order, edges repeated; null and NaN have no weight and stay null. Window expressions over one sort."""
    k = N.gaussian_kernel(sigma)
    r = len(k) // 2
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.when(~F.isnan(value), F.col(value).cast("double"))
    nth, n, first, last = F.row_number().over(w), F.count(F.lit(1)).over(whole), F.first(x).over(whole), F.last(x).over(whole)
    at = [F.when(nth + i < 1, first).when(nth + i > n, last).otherwise(F.lag(x, -i).over(w)) if i else x for i in range(-r, r + 1)]
    placed = rows.select(*keys, order, x.alias("__x"), *[v.alias(f"__{i}") for i, v in enumerate(at)])
    num = sum((F.coalesce(F.col(f"__{i}"), F.lit(0.0)) * float(q) for i, q in enumerate(k)), F.lit(0.0))
    den = sum((F.col(f"__{i}").isNotNull().cast("double") * float(q) for i, q in enumerate(k)), F.lit(0.0))
    return placed.select(*keys, order, F.when(F.col("__x").isNotNull(), F.try_divide(num, den)).alias("smoothed"))


def linear_fit(rows: DataFrame, keys: list[str], a: str, b: str, y: str) -> DataFrame:
    """Least squares of y on a, b and a constant, from partial sums of products."""
    c = lambda u, v: F.covar_pop(u, v)
    m = rows.groupBy(*keys).agg(
        c(a, a).alias("aa"), c(a, b).alias("ab"), c(b, b).alias("bb"), c(a, y).alias("ay"), c(b, y).alias("by"),
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    m = m.withColumns({"b_a": F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det), "b_b": F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det)})
    return m.select(*keys, "b_a", "b_b", (F.col("my") - F.col("b_a") * F.col("ma") - F.col("b_b") * F.col("mb")).alias("intercept"))


def paired_test(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Wilcoxon's signed-rank test of two columns."""
    return per_group(rows, keys, lambda p: [N.wilcoxon(p[a].to_numpy(), p[b].to_numpy())], "w double, p double, n int")


def timescales(rows: DataFrame, keys: list[str], order: str, value: str, lags: int, threshold: float) -> DataFrame:
    """Integrated autocorrelation time and the first lag below the threshold."""

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        acf = N.autocorrelation(p.sort_values(order)[value].to_numpy(float), lags)
        at = N.first_below(acf, threshold)
        return [(N.integrated_time(acf), -1 if at is None else at, float(acf[1]))]

    return per_group(rows, keys, work, "iat double, decorrelated int, lag1 double")


def collinearity(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Variance inflation of each feature that varies, and the condition number of them all."""

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        x = p[features].to_numpy(float)
        on = x.var(axis=0) > 0
        vif, cond = N.variance_inflation(x[:, on]), N.condition_number(x[:, on])
        return [(f, float(v), cond) for f, v in zip(np.array(features)[on], vif, strict=True)]

    return per_group(rows, keys, work, "feature string, vif double, condition double")


def distance_correlations(rows: DataFrame, keys: list[str], a: list[str], b: list[str], n_sub: int, n_rep: int, seed: int) -> DataFrame:
    """Mean distance correlation of ``n_rep`` samples of at most ``n_sub`` rows, without replacement."""

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        x, y, rng = p[a].to_numpy(float), p[b].to_numpy(float), np.random.default_rng(seed)
        if len(x) <= n_sub:
            return [(N.distance_correlation(x, y), len(x))]
        picks = [rng.choice(len(x), n_sub, replace=False) for _ in range(n_rep)]
        return [(float(np.mean([N.distance_correlation(x[i], y[i]) for i in picks])), len(x))]

    return per_group(rows, keys, work, "dcor double, n int")


def density_weights(rows: DataFrame, keys: list[str], row_id: str, clip: float, eps: float, period: float) -> DataFrame:
    def work(p: pd.DataFrame) -> Iterable[tuple]:
        xy = p[["x", "y"]].to_numpy(float)
        w = N.inverse_density_weights(xy, clip, eps, period) if len(xy) > 3 else np.ones(len(xy))
        return zip(p[row_id].tolist(), w.tolist(), strict=True)

    return per_group(rows, keys, work, f"{row_id} long, weight double")


def density_peaks(rows: DataFrame, keys: list[str], grid: int, period: float) -> DataFrame:
    """Grid cell of the greatest density of each group."""

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        xy = p[["x", "y"]].to_numpy(float)
        if len(xy) < 4:
            return [(float(xy[:, 0].mean()), float(xy[:, 1].mean()), len(xy))]
        c = (np.arange(grid) + 0.5) * period / grid
        q = np.array([(a, b) for a in c for b in c])
        at = q[N.kde(xy, q, period).argmax()]
        return [(float(at[0]), float(at[1]), len(xy))]

    return per_group(rows, keys, work, "px double, py double, n int")


def medoids(rows: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    def work(p: pd.DataFrame) -> Iterable[tuple]:
        p = p.sort_values(row_id)
        return [(int(p[row_id].iloc[N.medoid(p[["x", "y"]].to_numpy(float))]),)]

    return per_group(rows, keys, work, "medoid long")


#: Width of the bins that logs of intervals are counted in before a fit.
LOG_WIDTH = 1e-4


def binned_logs(intervals: DataFrame, key: str, log_col: str, width: float = LOG_WIDTH) -> DataFrame:
    """(key, x, n): mean and number of the logs in each bin, in order, as arrays.

    All rows count, and a key's arrays are as long as its logs are wide, whatever their number: the
    likelihood of a fit is off by width^2 / 24 over the components' variance a row, at most.
    """
    bins = intervals.where(F.col(log_col).isNotNull() & ~F.isnan(log_col)).groupBy(key, F.floor(F.col(log_col) / width).alias("bin")).agg(F.avg(log_col).alias("x"), F.count(F.lit(1)).alias("n"))
    packed = bins.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("b"))
    return packed.select(key, F.transform("b", lambda v: v["x"]).alias("x"), F.transform("b", lambda v: v["n"]).alias("n"))


def mixture_sweep(intervals: DataFrame, key: str, ks: range, repeats: int, seed: int, student: bool, log_col: str = "log_interval") -> DataFrame:
    """One fit for each key, K and repeat, with BIC, ICL, weights, means and deviations; fits run side by side on binned logs."""
    spark = intervals.sparkSession
    grid = spark.createDataFrame([(k, r) for k in ks for r in range(repeats)], "k int, rep int")
    packed = binned_logs(intervals, key, log_col).join(F.broadcast(grid))  # a parameter grid

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        x, n, k, r = np.asarray(p["x"].iloc[0], float), np.asarray(p["n"].iloc[0], float), int(p["k"].iloc[0]), int(p["rep"].iloc[0])
        if n.sum() < 2 * k:
            return []
        m = X.fit(x, k, seed + 1000 * r, student, 2, count=n)
        return [(m.loglik, X.bic(m, int(n.sum())), X.icl(m, x, n), m.weight.tolist(), m.mean.tolist(), np.sqrt(m.var).tolist())]

    return per_group(packed, [key, "k", "rep"], work, "loglik double, bic double, icl double, weights array<double>, means array<double>, sds array<double>")


def best_k(sweep: DataFrame, key: str, ic: str = "bic") -> DataFrame:
    """K and repeat of the least criterion; NaN counts as none, ties go to the lesser K, then repeat."""
    value = F.when(~F.isnan(ic), F.col(ic))
    return sweep.withColumn("__v", value).where("__v is not null").groupBy(key).agg(F.min(F.struct("__v", "k", "rep")).alias("b")).select(key, F.col("b.k").alias("k"), F.col("b.rep").alias("rep"), F.col("b.__v").alias(ic))


def lrt_sweep(intervals: DataFrame, key: str, ks: range, n_boot: int, n_sub: int, seed: int, student: bool, log_col: str = "log_interval") -> DataFrame:
    """Bootstrap likelihood ratio of each pair (K, K + 1), on all logs or, beyond ``n_sub``, on so many of them: the sampling is the operator's."""
    spark = intervals.sparkSession
    grid = spark.createDataFrame([(k,) for k in ks], "k int")
    packed = binned_logs(intervals, key, log_col).join(F.broadcast(grid))  # a parameter grid

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        x, n, k = np.asarray(p["x"].iloc[0], float), np.asarray(p["n"].iloc[0], np.int64), int(p["k"].iloc[0])
        if n.sum() > n_sub:
            n = np.random.default_rng(seed).multivariate_hypergeometric(n, n_sub, method="marginals")
        lr, pv, null = X.bootstrap_lrt(np.repeat(x, n), k, n_boot, seed, student)
        return [(k + 1, lr, pv, null)]

    return per_group(packed, [key, "k"], work, "k_alt int, lr double, p double, null_lr array<double>")


def selected_k(lrt: DataFrame, key: str, alpha: float, bonferroni: bool = False) -> DataFrame:
    """K of the first pair that isn't rejected, else the greatest."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    level = F.lit(alpha) / n if bonferroni else F.lit(alpha)
    marked = lrt.withColumn("__keep", F.col("p") >= level)
    return marked.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("__keep"), F.col("k"))), F.max("k_alt")).alias("k_selected"))


def cross_validated(rows: DataFrame, feature: str, y: str, x: str, fold: str, classes: int, l2: float = 1e-3) -> DataFrame:
    """Held-out log loss and accuracy of softmax regression for each feature and fold, beside those of permuted labels."""

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        a, t, f = N_rows(p[x]), p[y].to_numpy(int), p[fold].to_numpy()
        a = L.standardised(a)
        rng = np.random.default_rng(0)
        for k in np.unique(f):
            out = f == k
            for null in (False, True):
                target = rng.permutation(t) if null else t
                q = L.predict_proba(a[out], L.multinomial(a[~out], target[~out], classes, l2, rounds=100))
                yield int(k), null, L.log_loss(t[out], q), float((q.argmax(axis=1) == t[out]).mean())

    return per_group(rows, [feature], work, "fold int, null boolean, log_loss double, accuracy double")


def N_rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def hmm_sweep(rows: DataFrame, key: str, sequence: str, order: str, features: list[str], ks: range, seed: int) -> DataFrame:
    """Gaussian chains of each number of states over the sequences of a key, whose rows go to numpy once for all of them."""

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        own = p[sequence].to_numpy()
        at = np.lexsort((p[order].to_numpy(), own))
        seqs = np.split(p[features].to_numpy(float)[at], np.flatnonzero(np.diff(own[at])) + 1)
        for k in ks:
            m = L.fit_gaussian_hmm(seqs, k, seed, 15)
            share = np.bincount(np.concatenate(m["states"]), minlength=k) / len(p)
            yield k, m["loglik"], m["bic"], share.tolist()

    return per_group(rows, [key], work, "k int, loglik double, bic double, share array<double>")


def amplitude_variation(rows: DataFrame, keys: list[str], per_bin: int = 50, least_bins: int = 10) -> DataFrame:
    """Median and spread (p95 - p5) of deviation over mean of amplitudes in bins of about ``per_bin`` rows of equal width.

    ``rows``: keys, amplitude, at. A bin is a group of rows, so a key isn't bound to a task. NaN under ``least_bins`` bins.
    """
    size = rows.groupBy(*keys).agg((F.max("at") + 1).cast("double").alias("__n"), F.floor(F.count(F.lit(1)) / per_bin).alias("__bins"))
    size = size.select(*[F.col(c).alias(f"__{c}_of") for c in keys], "__n", "__bins")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}_of")) for c in keys]
    k = F.least(F.floor(F.col("at") / F.col("__n") * F.col("__bins")), F.col("__bins") - 1)
    placed = rows.join(F.broadcast(size), reduce(and_, same)).groupBy(*keys, k.alias("__k"))  # a row a key
    bins = placed.agg(F.count(F.lit(1)).alias("n"), F.avg("amplitude").alias("mean"), F.stddev_pop("amplitude").alias("sd")).where("n > 1 and mean <> 0")
    q = bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col("sd") / F.abs("mean"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    known = lambda x: F.when(F.col("n") >= least_bins, x).otherwise(F.lit(float("nan")))
    return q.select(*keys, known(F.col("q")[1]).alias("cv_median"), known(F.col("q")[2] - F.col("q")[0]).alias("cv_range"))


def merged_detections(rows: DataFrame, key: str, bin_s: float, peak_min: int, valley: float, stretch: float = 3600.0) -> DataFrame:
    """Detections on channels as events. Regions that no detection bridges are independent, so those that
    begin in one stretch of time make a group, however long a session is.

    ``rows``: key, start, stop, channel.
    """
    w = Window.partitionBy(key).orderBy("start", "stop", "channel")
    edge = F.coalesce(F.col("start") > F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 2 * bin_s, F.lit(True))
    begun = F.last(F.when(F.col("__new"), F.col("start")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = rows.select(key, "start", "stop", "channel").withColumn("__new", edge).withColumn("part", F.floor(begun / stretch)).drop("__new")

    def work(p: pd.DataFrame) -> Iterable[tuple]:
        return N.watershed_segments(p["start"].to_numpy(float), p["stop"].to_numpy(float), p["channel"].to_numpy(), bin_s, peak_min, valley)

    return per_group(own, [key, "part"], work, "start double, stop double").drop("part")


def waveform_features(rows: DataFrame, row_id: str, wave: str, rate: float, nperseg: int, hop: int) -> DataFrame:
    """RMS and spectral moments of each waveform; short ones have RMS alone."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        freqs = np.fft.rfftfreq(nperseg, 1 / rate)
        for p in batches:
            out = []
            for i, w in zip(p[row_id], p[wave], strict=True):
                w = np.asarray(w, float)
                m = N.spectral_moments(N.spectrum(w, nperseg, hop), freqs) if len(w) >= nperseg else dict.fromkeys(("mean_freq", "peak_freq", "bandwidth", "mean_amplitude", "max_amplitude", "entropy"), np.nan)
                out.append((i, float(np.sqrt((w**2).mean())) if len(w) else np.nan, m["mean_freq"], m["peak_freq"], m["bandwidth"], m["entropy"]))
            yield pd.DataFrame(out, columns=[row_id, "rms", "mean_freq", "peak_freq", "bandwidth", "entropy"])

    return rows.select(row_id, wave).mapInPandas(run, f"{row_id} long, rms double, mean_freq double, peak_freq double, bandwidth double, entropy double")
