"""Queries for resampling, mixtures, models and signals. SQL can't express most; tests hold those against closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.functions import learning as L
from sonolith.functions import numeric as N
from sonolith.operators import intervals as I
from sonolith.operators import kernels as K
from sonolith.operators import normalise as Z
from sonolith.operators import regression as G
from sonolith.operators import resampling as R
from sonolith.plans.registry import query

FRAMES, SPIKES, CALLS, POINTS = (A.with_sql(x) for x in ("frames", "spikes", "calls", "points"))


def r6(x, n: int = 6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    e = A.events(spark, sf).where(F.col("category").isin("signup", "purchase"))
    return e.select("session_id", F.col("event_id").alias("anchor_id"), "start", F.when(F.col("category") == "signup", "a").otherwise("b").alias("group"))


def _matrices(spark: SparkSession, sf: str) -> DataFrame:
    return R.count_matrices(A.spikes(spark, sf), _anchors(spark, sf), 3600.0)


_COUNTS = SPIKES + """, a AS (SELECT session_id, event_id AS trial, start, CASE WHEN category = 'signup' THEN 'a' ELSE 'b' END AS grp FROM events_m WHERE category IN ('signup', 'purchase')),
    u AS (SELECT DISTINCT session_id, unit_id FROM spikes),
    n AS (SELECT a.session_id, a.trial, a.grp, u.unit_id, count(s.t)::DOUBLE AS n FROM a JOIN u USING (session_id) LEFT JOIN spikes s ON s.session_id = a.session_id AND s.unit_id = u.unit_id AND s.t >= a.start AND s.t <= a.start + 3600 GROUP BY ALL)"""


@query(_COUNTS + """, z AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY session_id, trial)) AS len FROM n), v AS (SELECT session_id, grp, unit_id, sum(CASE WHEN len > 0 THEN n / len ELSE 0 END) AS s FROM z GROUP BY ALL),
    t AS (SELECT session_id, grp, count(DISTINCT trial) AS k, count(DISTINCT CASE WHEN len > 0 THEN trial END) AS live FROM z GROUP BY ALL)
    SELECT session_id, grp AS "group", any_value(k) AS n_trials, round((sum(s * s) - any_value(live)) / (any_value(k) * (any_value(k) - 1)), 6) AS cosine FROM v JOIN t USING (session_id, grp) GROUP BY session_id, grp""")
def coactivity_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return R.coactivity_by_group(_matrices(spark, sf)).select("session_id", "group", "n_trials", r6("cosine").alias("cosine"))


@query(_COUNTS + """, c AS (SELECT a.session_id, a.grp, a.unit_id AS u1, b.unit_id AS u2, CASE WHEN stddev_pop(a.n) > 0 AND stddev_pop(b.n) > 0 THEN corr(a.n, b.n) END AS r FROM n a JOIN n b ON a.session_id = b.session_id AND a.trial = b.trial AND a.unit_id < b.unit_id GROUP BY ALL)
    SELECT session_id, grp AS "group", round(avg(r), 6) AS r_sc FROM c GROUP BY ALL""")
def coactivity_noise_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return R.coactivity_by_group(_matrices(spark, sf)).select("session_id", "group", r6("r_sc").alias("r_sc"))


@query(_COUNTS + " SELECT session_id, trial, grp AS \"group\", CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS top FROM n GROUP BY ALL")
def snippet_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = _matrices(spark, sf)
    return m.select("session_id", "trial", "group", F.aggregate("counts", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_max("counts").alias("top"))


def _metrics_sql(rel: str, keys: str) -> str:
    """The three metrics of counts ``rel`` (keys, trial, unit_id, n)."""
    return f""", ma AS (SELECT *, avg(n) OVER (PARTITION BY {keys}, unit_id) AS mu, avg(n) OVER (PARTITION BY {keys}, trial) AS mt, sqrt(sum(n * n) OVER (PARTITION BY {keys}, trial)) AS lt FROM {rel}),
    mb AS (SELECT *, sqrt(sum((n - mu) * (n - mu)) OVER (PARTITION BY {keys}, unit_id)) AS su, sqrt(sum((n - mt) * (n - mt)) OVER (PARTITION BY {keys}, trial)) AS st FROM ma),
    mt AS (SELECT {keys}, trial, sum(CASE WHEN su > 0 THEN (n - mu) / su ELSE 0 END) AS s, any_value(lt) > 0 AS seen, any_value(st) > 0 AS live FROM mb GROUP BY {keys}, trial),
    mu AS (SELECT {keys}, unit_id, any_value(su) > 0 AS moving, sum(CASE WHEN lt > 0 THEN n / lt ELSE 0 END) AS c, sum(CASE WHEN st > 0 THEN (n - mt) / st ELSE 0 END) AS p FROM mb GROUP BY {keys}, unit_id),
    mx AS (SELECT {keys}, sum(s * s) AS ss, count(*) AS k, count(*) FILTER (seen) AS seen, count(*) FILTER (live) AS live FROM mt GROUP BY {keys}),
    my AS (SELECT {keys}, sum(c * c) AS cc, sum(p * p) AS pp, count(*) FILTER (moving) AS u FROM mu GROUP BY {keys})
    SELECT {keys}, CASE WHEN u > 1 THEN round((ss - u) / (u * (u - 1)), 6) END AS r_sc, CASE WHEN k > 1 THEN round((cc - seen) / (k * (k - 1)), 6) END AS cosine, CASE WHEN live > 1 THEN round((pp - live) / (live * (live - 1)), 6) END AS pop_corr
    FROM mx JOIN my USING ({keys})"""


def _rounded(metrics: DataFrame, *keys: str) -> DataFrame:
    return metrics.select(*keys, *[r6(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("r_sc", "cosine", "pop_corr")])


@query(_COUNTS + """, o AS (SELECT session_id, trial, row_number() OVER (PARTITION BY session_id ORDER BY trial) - 1 AS nth, count(*) OVER (PARTITION BY session_id) AS k FROM (SELECT DISTINCT session_id, trial FROM n WHERE grp = 'a')),
    d AS (SELECT DISTINCT session_id, k, CAST(i AS INTEGER) AS iteration, j AS draw, ('0x' || substr(md5('7:' || strftime(session_id, '%Y-%m-%d') || ':' || i || ':' || j), 1, 8))::BIGINT % k AS nth FROM o, range(50) r(i), range(40) t(j)),
    bs AS (SELECT d.session_id, d.iteration, d.draw AS trial, n.unit_id, n.n FROM d JOIN o USING (session_id, nth) JOIN n ON n.session_id = o.session_id AND n.trial = o.trial)""" + _metrics_sql("bs", "session_id, iteration"))
def bootstrap_coactivity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.bootstrap_coactivity(_matrices(spark, sf).where("group = 'a'"), 40, 50, 7), "session_id", "iteration")


@query(_COUNTS + """, tr AS (SELECT session_id, trial, any_value(grp) = 'a' AS a FROM n GROUP BY ALL), na AS (SELECT session_id, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM tr GROUP BY session_id),
    pm AS (SELECT session_id, trial, -1 AS i, a FROM tr UNION ALL SELECT tr.session_id, trial, i, row_number() OVER (PARTITION BY tr.session_id, i ORDER BY md5('11:' || i || ':' || trial), trial) <= na FROM tr JOIN na USING (session_id), range(100) r(i)),
    z AS (SELECT session_id, trial, unit_id, n, sqrt(sum(n * n) OVER (PARTITION BY session_id, trial)) AS l FROM n),
    v AS (SELECT z.session_id, i, a, unit_id, sum(CASE WHEN l > 0 THEN n / l ELSE 0 END) AS s, count(*) AS k, count(*) FILTER (l > 0) AS live FROM z JOIN pm USING (session_id, trial) GROUP BY ALL),
    c AS (SELECT session_id, i, a, (sum(s * s) - any_value(live)) / (any_value(k) * (any_value(k) - 1)) AS c FROM v GROUP BY session_id, i, a),
    d AS (SELECT session_id, i, max(c) FILTER (a) - max(c) FILTER (NOT a) AS d FROM c GROUP BY session_id, i),
    m AS (SELECT session_id, max(d) FILTER (i < 0) AS d, avg(d) FILTER (i >= 0) AS mean, stddev_pop(d) FILTER (i >= 0) AS sd FROM d GROUP BY session_id)
    SELECT d.session_id, round(any_value(m.d), 6) AS delta, CASE WHEN any_value(sd) > 1e-9 THEN round((any_value(m.d) - any_value(mean)) / any_value(sd), 5) END AS z, round((count(*) FILTER (i >= 0 AND round(d.d, 9) >= round(m.d, 9)) + 1) / 101.0::DOUBLE, 6) AS p_one,
           round((count(*) FILTER (i >= 0 AND abs(round(d.d, 9)) >= abs(round(m.d, 9))) + 1) / 101.0::DOUBLE, 6) AS p_two FROM d JOIN m USING (session_id) JOIN na USING (session_id) WHERE na >= 2 AND nb >= 2 GROUP BY d.session_id""")
def label_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """Of sessions that have two trials of each group at least."""
    p = R.permute_labels(_matrices(spark, sf), "a", "b", 100, 11).where("not isnan(delta)")
    return p.select("session_id", r6("delta").alias("delta"), r6(F.when(~F.isnan("z"), F.col("z")), 5).alias("z"), r6("p_one").alias("p_one"), r6("p_two").alias("p_two"))


_SHIFTS = [float(s) for s in np.random.default_rng(5).uniform(20, 60, 20) * 60]


@query(SPIKES + f""", a AS (SELECT session_id, event_id AS trial, start FROM events_m WHERE category = 'signup'), u AS (SELECT DISTINCT session_id, unit_id FROM spikes),
    sh AS (SELECT unnest(range(20)) AS shuffle, unnest({_SHIFTS}::DOUBLE[]) AS s), ms AS (SELECT session_id, unit_id, shuffle, (t + s) % 86400 AS t FROM spikes, sh),
    hit AS (SELECT a.session_id, shuffle, trial, unit_id, count(*) AS n FROM a JOIN ms ON ms.session_id = a.session_id AND t >= start AND t <= start + 3600 GROUP BY ALL),
    cs AS (SELECT a.session_id, CAST(shuffle AS INTEGER) AS shuffle, a.trial, u.unit_id, coalesce(hit.n, 0)::DOUBLE AS n FROM a JOIN u USING (session_id) CROSS JOIN (SELECT shuffle FROM sh) LEFT JOIN hit USING (session_id, shuffle, trial, unit_id))""" + _metrics_sql("cs", "session_id, shuffle"))
def circular_shuffle_null(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.shifted_coactivity(A.spikes(spark, sf), _anchors(spark, sf).where("group = 'a'"), 3600.0, 86400.0, _SHIFTS), "session_id", "shuffle")


# 1 - erf(x) as 2 / sqrt(pi) times the series of its integral; under 5e-9 beyond 4
_ERFC = "CASE WHEN x >= 4 THEN 0 ELSE 1 - 2 / sqrt(pi()) * (SELECT sum((CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(x) - lgamma(i + 1)) / (2 * i + 1)) FROM range(120) t(i)) END"


@query(FRAMES + """, d AS (SELECT session_id, speed - distance AS d FROM frames),
    r AS (SELECT session_id, d, rank() OVER (PARTITION BY session_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY session_id, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d),
    s AS (SELECT session_id, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) + coalesce(sum(r) FILTER (d = 0), 0) / 2 AS up, coalesce(sum(r) FILTER (d < 0), 0) + coalesce(sum(r) FILTER (d = 0), 0) / 2 AS down, count(*) FILTER (d = 0) AS n0 FROM r GROUP BY session_id),
    g AS (SELECT session_id, sum(k::DOUBLE ** 3 - k) AS ties FROM (SELECT session_id, count(*) AS k FROM d GROUP BY session_id, abs(d)) GROUP BY session_id),
    z AS (SELECT session_id, n, least(up, down) AS w, (n * (n + 1) / 4.0 - least(up, down) - 0.5) / sqrt(2 * (n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48 - n0 * (n0 + 1) * (2 * n0 + 1) / 24.0)) AS x FROM s JOIN g USING (session_id))
    SELECT session_id, w, round(""" + _ERFC + """, 6) AS p, CAST(n AS INTEGER) AS n FROM z""")
def paired_signed_rank(spark: SparkSession, sf: str) -> DataFrame:
    f = A.frames(spark, sf)
    return K.paired_test(f, ["session_id"], "speed", "distance").withColumn("p", r6("p"))


@query(FRAMES + """, k AS (SELECT i, exp(-0.5 * (i / 2.0) ** 2) / sum(exp(-0.5 * (i / 2.0) ** 2)) OVER () AS w FROM range(-8, 9) t(i)),
    m AS (SELECT session_id, max(frame_index) AS top FROM frames GROUP BY session_id),
    j AS (SELECT f.session_id, f.frame_index, w, greatest(0, least(top, f.frame_index + i)) AS at FROM frames f JOIN m USING (session_id), k)
    SELECT j.session_id, j.frame_index, round(sum(w * g.speed), 6) AS smoothed FROM j JOIN frames g ON g.session_id = j.session_id AND g.frame_index = j.at GROUP BY ALL""")
def smoothed_traces(spark: SparkSession, sf: str) -> DataFrame:
    f = A.frames(spark, sf).select("session_id", "frame_index", "speed")
    return K.smoothed(f, ["session_id"], "frame_index", "speed", 2.0).withColumn("smoothed", r6("smoothed"))


@query(FRAMES + """, c AS (SELECT session_id, frame_index, speed - avg(speed) OVER (PARTITION BY session_id) AS x FROM frames),
    l AS (SELECT session_id, list(x ORDER BY frame_index) AS l FROM c GROUP BY session_id),
    a AS (SELECT session_id, k, list_inner_product(list_slice(l, 1, len(l) - k), list_slice(l, k + 1, len(l))) / list_inner_product(l, l) AS r FROM l, range(101) t(k)),
    s AS (SELECT session_id, min(k) FILTER (k > 0 AND r <= 0) AS stop, min(k) FILTER (r < 0.1) AS low, max(r) FILTER (k = 1) AS lag1 FROM a GROUP BY session_id)
    SELECT session_id, round(1 + 2 * coalesce(sum(r) FILTER (k > 0 AND k < coalesce(stop, 101)), 0), 6) AS iat, CAST(coalesce(any_value(low), -1) AS INTEGER) AS decorrelated, round(any_value(lag1), 6) AS lag1
    FROM a JOIN s USING (session_id) GROUP BY session_id""")
def predictor_timescales(spark: SparkSession, sf: str) -> DataFrame:
    t = K.timescales(A.frames(spark, sf).select("session_id", "frame_index", "speed"), ["session_id"], "frame_index", "speed", 100, 0.1)
    return t.select("session_id", r6("iat").alias("iat"), "decorrelated", r6("lag1").alias("lag1"))


_VIF2 = " SELECT session_id, 'speed' AS feature, round(1 / (1 - corr(speed, distance) ** 2), 6) AS vif FROM frames GROUP BY ALL UNION ALL SELECT session_id, 'distance', round(1 / (1 - corr(speed, distance) ** 2), 6) FROM frames GROUP BY ALL"


@query(FRAMES + _VIF2)
def variance_inflation(spark: SparkSession, sf: str) -> DataFrame:
    c = K.collinearity(A.frames(spark, sf).select("session_id", "speed", "distance"), ["session_id"], ["speed", "distance"])
    return c.select("session_id", "feature", r6("vif").alias("vif"))


@query(FRAMES + """, k AS (SELECT session_id, rank() OVER (PARTITION BY session_id ORDER BY speed) + (count(*) OVER (PARTITION BY session_id, speed) - 1) / 2.0 AS a, rank() OVER (PARTITION BY session_id ORDER BY distance) + (count(*) OVER (PARTITION BY session_id, distance) - 1) / 2.0 AS b FROM frames), r AS (SELECT session_id, corr(a, b) AS rho FROM k GROUP BY session_id)
    SELECT session_id, round(rho, 6) AS rho, CASE WHEN abs(rho) >= 0.9 THEN 'exclude' ELSE 'concern' END AS tier FROM r WHERE abs(rho) >= 0.5""")
def flagged_predictor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from sonolith.operators.metrics import spearman

    s = spearman(A.frames(spark, sf), "speed", "distance", ("session_id",))
    return s.where(F.abs("rho") >= 0.5).select("session_id", r6("rho").alias("rho"), F.when(F.abs("rho") >= 0.9, "exclude").otherwise("concern").alias("tier"))


@query(POINTS + """, d AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS p, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS q FROM points a JOIN points b USING (label)),
    c AS (SELECT label, p - avg(p) OVER (PARTITION BY label, i) - avg(p) OVER (PARTITION BY label, j) + avg(p) OVER (PARTITION BY label) AS p, q - avg(q) OVER (PARTITION BY label, i) - avg(q) OVER (PARTITION BY label, j) + avg(q) OVER (PARTITION BY label) AS q FROM d)
    SELECT label, round(sqrt(greatest(avg(p * q), 0) / sqrt(avg(p * p) * avg(q * q))), 6) AS dcor, CAST(round(sqrt(count(*))) AS INTEGER) AS n FROM c GROUP BY label""")
def distance_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Of all points of a label, or, beyond 2,500, of three samples of so many: the sampling is the operator's."""
    return K.distance_correlations(A.points(spark, sf), ["label"], ["x", "y"], ["px", "py"], 2500, 3, 1).withColumn("dcor", r6("dcor"))


# inverse of Scott's covariance, and the norm of the density
_KERNEL = """, v AS (SELECT label, count(*) AS n, var_samp(x) * count(*) ** (-1 / 3.0) AS xx, covar_samp(x, y) * count(*) ** (-1 / 3.0) AS xy, var_samp(y) * count(*) ** (-1 / 3.0) AS yy FROM points GROUP BY label),
    kr AS (SELECT label, n, yy / (xx * yy - xy * xy) AS a, -xy / (xx * yy - xy * xy) AS b, xx / (xx * yy - xy * xy) AS c, 1 / (n * 2 * pi() * sqrt(xx * yy - xy * xy)) AS norm FROM v),
    im AS (SELECT 6.0 * i AS sx, 6.0 * j AS sy FROM range(-1, 2) s(i), range(-1, 2) t(j))"""


@query(POINTS + _KERNEL + """, k AS (SELECT q.label, q.vec_id, any_value(norm) * sum(exp(-0.5 * (a * (q.x - p.x - sx) ** 2 + 2 * b * (q.x - p.x - sx) * (q.y - p.y - sy) + c * (q.y - p.y - sy) ** 2))) AS f
          FROM points q JOIN points p USING (label) JOIN kr USING (label), im WHERE n > 3 GROUP BY q.label, q.vec_id),
    w AS (SELECT label, vec_id, 1 / (f + 0.001) AS w FROM k), t AS (SELECT label, quantile_cont(w, 0.99) AS top FROM w GROUP BY label),
    l AS (SELECT label, vec_id, least(w, top) AS w FROM w JOIN t USING (label))
    SELECT label, vec_id, round(w / avg(w) OVER (PARTITION BY label), 6) AS weight FROM l UNION ALL SELECT label, vec_id, 1.0 FROM points JOIN kr USING (label) WHERE n <= 3""")
def inverse_density_weights(spark: SparkSession, sf: str) -> DataFrame:
    return K.density_weights(A.points(spark, sf), ["label"], "vec_id", 99.0, 1e-3, 6.0).withColumn("weight", r6("weight"))


@query(POINTS + _KERNEL + """, g AS (SELECT i * 24 + j AS node, (i + 0.5) * 6 / 24 AS gx, (j + 0.5) * 6 / 24 AS gy FROM range(24) s(i), range(24) t(j)),
    k AS (SELECT p.label, node, gx, gy, sum(exp(-0.5 * (a * (gx - p.x - sx) ** 2 + 2 * b * (gx - p.x - sx) * (gy - p.y - sy) + c * (gy - p.y - sy) ** 2))) AS f FROM points p JOIN kr USING (label), im, g WHERE n > 3 GROUP BY ALL)
    SELECT label, round(arg_max(gx, f), 6) AS px, round(arg_max(gy, f), 6) AS py, (SELECT CAST(n AS INTEGER) FROM kr WHERE kr.label = k.label) AS n FROM k GROUP BY label
    UNION ALL SELECT label, round(avg(x), 6), round(avg(y), 6), CAST(count(*) AS INTEGER) FROM points GROUP BY label HAVING count(*) < 4""")
def density_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return K.density_peaks(A.points(spark, sf), ["label"], 24, 6.0).select("label", r6("px").alias("px"), r6("py").alias("py"), "n")


@query(POINTS.replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (SELECT 0 AS it, label, avg(x) AS mx, avg(y) AS my FROM points GROUP BY label UNION ALL
          SELECT m.it + 1, m.label, sum(x / greatest(sqrt((x - mx) ** 2 + (y - my) ** 2), 1e-12)) / sum(1 / greatest(sqrt((x - mx) ** 2 + (y - my) ** 2), 1e-12)), sum(y / greatest(sqrt((x - mx) ** 2 + (y - my) ** 2), 1e-12)) / sum(1 / greatest(sqrt((x - mx) ** 2 + (y - my) ** 2), 1e-12))
          FROM m JOIN points p ON p.label = m.label WHERE m.it < 200 GROUP BY m.it, m.label)
    SELECT label, arg_min(vec_id, (x - mx) ** 2 + (y - my) ** 2) AS medoid FROM points JOIN m USING (label) WHERE it = 200 GROUP BY label""")
def medoids(spark: SparkSession, sf: str) -> DataFrame:
    return K.medoids(A.points(spark, sf), ["label"], "vec_id")


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    d = I.same_emitter_intervals(A.calls(spark, sf), "s2s").where("not dropped")
    return d.select("sex", "log_interval")


@query()
def gaussian_mixture_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return K.mixture_sweep(_logs(spark, sf), "sex", range(1, 4), 2, 3, False)


@query()
def student_mixture_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return K.mixture_sweep(_logs(spark, sf), "sex", range(1, 3), 1, 3, True)


@query()
def best_number_of_components(spark: SparkSession, sf: str) -> DataFrame:
    return K.best_k(K.mixture_sweep(_logs(spark, sf), "sex", range(1, 4), 2, 3, False), "sex")


@query()
def bootstrap_likelihood_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return K.lrt_sweep(_logs(spark, sf), "sex", range(1, 3), 10, 15_000, 3, False)


@query()
def components_by_likelihood_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return K.selected_k(K.lrt_sweep(_logs(spark, sf), "sex", range(1, 3), 10, 15_000, 3, False), "sex", 0.05, True)


@query()
def univariate_models(spark: SparkSession, sf: str) -> DataFrame:
    """Each feature's history in a model of its own, cross-validated beside a null."""
    e = A.table(spark, sf, "embeddings").where("size(embedding) >= 32").select((F.pmod("label", F.lit(3))).cast("int").alias("y"), (F.col("vec_id") % 4).alias("fold"), *[F.slice("embedding", 1 + 8 * k, 8).alias(f"f{k}") for k in range(4)])
    long = e.unpivot(["y", "fold"], [f"f{k}" for k in range(4)], "feature", "x")
    return K.cross_validated(long, "feature", "y", "x", "fold", 3)


@query()
def forward_model_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Features chosen stepwise on held-out loss; each pass over the rows serves all candidates and folds of a step."""
    e = A.table(spark, sf, "embeddings").where("size(embedding) >= 12").select((F.array_position(F.slice("embedding", 1, 3), F.array_max(F.slice("embedding", 1, 3))) - 1).cast("int").alias("y"), (F.col("vec_id") % 4).cast("int").alias("fold"), F.slice("embedding", 1, 12).alias("x"))
    chosen = G.forward_selection(e, {f"f{k}": tuple(range(3 * k, 3 * k + 3)) for k in range(4)}, 3)
    return spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(chosen)], "step int, feature string, log_loss double")


@query()
def manifold_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Positions on the torus from features, by ridge on cos and sin; errors by label."""
    e = A.table(spark, sf, "embeddings").where("size(embedding) >= 16").select("label", F.slice("embedding", 5, 12).alias("x"), *[F.pmod(F.col("embedding")[i].cast("double") * 3 + 3, F.lit(6.0)).alias(n) for i, n in enumerate("ab")])

    def work(p):
        y = p[["a", "b"]].to_numpy(float)
        q = L.torus_ridge(K.N_rows(p["x"]), y, 6.0, 0.1, 0.01)
        d = q - y
        d -= 6.0 * np.rint(d / 6.0)
        return [(float(np.sqrt((d**2).sum(axis=1)).mean()), len(p))]

    return K.per_group(e, ["label"], work, "mae double, n int")


@query()
def gamma_regression(spark: SparkSession, sf: str) -> DataFrame:
    f = A.frames(spark, sf)

    def work(p):
        b = L.gamma_glm(L.standardised(p[["speed", "yaw"]].to_numpy(float)), p["distance"].to_numpy(float) + 0.1)
        return [(float(b[0]), float(b[1]), float(b[2]))]

    return K.per_group(f, ["session_id"], work, "b_speed double, b_yaw double, intercept double")


@query(FRAMES + """, m AS (SELECT session_id, covar_pop(speed, speed) AS aa, covar_pop(speed, yaw) AS ab, covar_pop(yaw, yaw) AS bb, covar_pop(speed, distance) AS ay, covar_pop(yaw, distance) AS y, avg(speed) AS ma, avg(yaw) AS mb, avg(distance) AS my FROM frames GROUP BY session_id),
    b AS (SELECT *, (ay * bb - y * ab) / (aa * bb - ab * ab) AS b1, (y * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m)
    SELECT session_id, round(b1, 9) AS b_speed, round(b2, 9) AS b_yaw, round(my - b1 * ma - b2 * mb, 9) AS intercept FROM b""")
def ridge_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares of a session's frames, from partial sums."""
    b = K.linear_fit(A.frames(spark, sf), ["session_id"], "speed", "yaw", "distance")
    return b.select("session_id", r6("b_a", 9).alias("b_speed"), r6("b_b", 9).alias("b_yaw"), r6("intercept", 9).alias("intercept"))


@query()
def hidden_state_sweep(spark: SparkSession, sf: str) -> DataFrame:
    f = A.frames(spark, sf).withColumns({"seq": F.floor(F.col("frame_index") / 100), "speed": F.col("speed") / 10, "distance": F.col("distance") / 20})
    return K.hmm_sweep(f.select("session_id", "seq", "frame_index", "speed", "distance"), "session_id", "seq", "frame_index", ["speed", "distance"], range(1, 4), 2)


@query()
def merged_channel_detections(spark: SparkSession, sf: str) -> DataFrame:
    e = A.calls(spark, sf).select("session_id", F.col("start"), (F.col("start") + F.col("duration") / 2).alias("stop"), (F.col("user_id") % 16).alias("channel"))
    return K.merged_detections(e, "session_id", 1.0, 1, 0.5)


_DFT = """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL),
    w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 31) AS w FROM range(32) r(i)),
    d AS (SELECT vec_id, f, k, sum(x[8 * f + i + 1] * w * cos(2 * pi() * k * i / 32)) AS re, sum(x[8 * f + i + 1] * w * sin(2 * pi() * k * i / 32)) AS im FROM x, w, range(1000) a(f), range(17) b(k) WHERE 8 * f + 32 <= len(x) GROUP BY vec_id, f, k),
    e AS (SELECT vec_id, k, k * 250000 / 32.0::DOUBLE AS hz, sum(re * re + im * im) AS e FROM d GROUP BY vec_id, k),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, sum(e) OVER (PARTITION BY vec_id ORDER BY k) / sum(e) OVER (PARTITION BY vec_id) AS c FROM e)"""


@query(_DFT + """ SELECT x.vec_id, CASE WHEN any_value(len(x)) > 0 THEN round(sqrt(any_value(list_inner_product(x, x)) / any_value(len(x))), 6) END AS rms, round(sum(hz * p), 3) AS mean_freq, round(arg_max(hz, e), 3) AS peak_freq,
    round(coalesce(min(hz) FILTER (c >= 0.95), CASE WHEN count(hz) > 0 THEN 125000 END) - min(hz) FILTER (c >= 0.05), 3) AS bandwidth, round(-sum(CASE WHEN p > 0 THEN p * log2(p) WHEN p = 0 THEN 0 END) / log2(17), 6) AS entropy FROM x LEFT JOIN p ON p.vec_id = x.vec_id GROUP BY x.vec_id""")
def waveform_features(spark: SparkSession, sf: str) -> DataFrame:
    w = K.waveform_features(A.table(spark, sf, "embeddings").where("embedding is not null"), "vec_id", "embedding", 250000.0, 32, 8)
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return w.select("vec_id", *[r6(known(c), n).alias(c) for c, n in (("rms", 6), ("mean_freq", 3), ("peak_freq", 3), ("bandwidth", 3), ("entropy", 6))])


@query("""WITH x AS (SELECT vec_id, c, list_transform(embedding[32 * c + 1:32 * c + 32], lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings, range(2) r(c) WHERE len(embedding) = 64),
    v AS (SELECT vec_id, c, x, list_inner_product(x, x) / 32 - pow(list_sum(x) / 32, 2) AS v FROM x), n AS (SELECT *, v / sum(v) OVER (PARTITION BY vec_id) AS share FROM v),
    w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 15) AS w FROM range(16) r(i)),
    d AS (SELECT vec_id, c, f, k, any_value(share) AS share, sum(x[4 * f + i + 1] * w * cos(2 * pi() * k * i / 16)) AS re, sum(x[4 * f + i + 1] * w * sin(2 * pi() * k * i / 16)) AS im FROM n, w, range(5) a(f), range(9) b(k) GROUP BY vec_id, c, f, k),
    b AS (SELECT vec_id, k, f, 10 * log10(sum(share * (re * re + im * im)) + 1e-12) AS db FROM d GROUP BY vec_id, k, f),
    g AS (SELECT j, j * 4 / 11.0::DOUBLE AS q FROM range(12) r(j)),
    i AS (SELECT lo.vec_id, lo.k, j, lo.db * (1 - (q - floor(q))) + hi.db * (q - floor(q)) AS v FROM g JOIN b lo ON lo.f = floor(q) JOIN b hi ON hi.vec_id = lo.vec_id AND hi.k = lo.k AND hi.f = least(floor(q) + 1, 4))
    SELECT vec_id, CAST(k AS INTEGER) AS freq, CAST(j AS INTEGER) AS time, round((v - min(v) OVER (PARTITION BY vec_id)) / (max(v) OVER (PARTITION BY vec_id) - min(v) OVER (PARTITION BY vec_id)), 6) AS value FROM i""")
def resized_spectrograms(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", "embedding")

    def run(batches):
        import pandas as pd

        for p in batches:
            out = [N.spectrogram(np.asarray(w, float).reshape(2, -1), 16, 4, (9, 12)) for w in p["embedding"]]
            yield pd.DataFrame({"vec_id": p["vec_id"], "spec": [s.ravel().tolist() for s in out]})

    cells = e.mapInPandas(run, "vec_id long, spec array<double>").select("vec_id", F.posexplode("spec").alias("at", "v"))
    return cells.select("vec_id", F.floor(F.col("at") / 12).cast("int").alias("freq"), (F.col("at") % 12).alias("time"), r6("v").alias("value"))


@query("""WITH s AS (SELECT l_suppkey % 5 AS unit_id, l_extendedprice AS a, l_orderkey AS o, max(l_orderkey) OVER (PARTITION BY l_suppkey % 5) + 1 AS n_samples, CAST(floor(count(*) OVER (PARTITION BY l_suppkey % 5) / 50) AS BIGINT) AS bins FROM lineitem),
    k AS (SELECT unit_id, least(floor(o / CAST(n_samples AS DOUBLE) * bins), bins - 1) AS k, stddev_pop(a) / abs(avg(a)) AS cv FROM s GROUP BY ALL HAVING count(*) > 1 AND avg(a) <> 0)
    SELECT unit_id, CASE WHEN count(*) >= 10 THEN round(median(cv), 6) ELSE 'nan'::DOUBLE END AS cv_median, CASE WHEN count(*) >= 10 THEN round(quantile_cont(cv, 0.95) - quantile_cont(cv, 0.05), 6) ELSE 'nan'::DOUBLE END AS cv_range FROM k GROUP BY unit_id""")
def amplitude_variation(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("unit_id"), F.col("l_extendedprice").alias("amplitude"), F.col("l_orderkey").alias("at"))
    cv = K.amplitude_variation(li, ["unit_id"])
    return cv.select("unit_id", r6("cv_median").alias("cv_median"), r6("cv_range").alias("cv_range"))


@query(SPIKES.replace("WITH ", "WITH RECURSIVE ", 1) + """, kept AS (SELECT session_id, unit_id, min(t) AS t FROM spikes GROUP BY ALL UNION ALL
          SELECT k.session_id, k.unit_id, min(s.t) FROM kept k JOIN spikes s ON s.session_id = k.session_id AND s.unit_id = k.unit_id AND s.t - k.t > 600 GROUP BY k.session_id, k.unit_id)
    SELECT session_id, unit_id, CAST(any_value(n) AS INTEGER) AS n, CAST(count(*) AS INTEGER) AS n_kept FROM kept JOIN (SELECT session_id, unit_id, count(*) AS n FROM spikes GROUP BY ALL) USING (session_id, unit_id) GROUP BY ALL""")
def censored_spikes(spark: SparkSession, sf: str) -> DataFrame:
    """Spikes that stay when each that follows the last kept one within the period goes."""
    s = A.spikes(spark, sf)

    def work(p):
        t = np.sort(p["t"].to_numpy(float))
        return [(len(t), int(N.censored(t, 600.0).sum()))]

    return K.per_group(s.select("session_id", "unit_id", "t"), ["session_id", "unit_id"], work, "n int, n_kept int")


@query()
def merged_boxes(spark: SparkSession, sf: str) -> DataFrame:
    e = A.calls(spark, sf).where("category = 'click'").select("session_id", F.floor(F.col("start") / 3600).alias("hour"), F.col("start").alias("t0"), F.col("stop").alias("t1"), (F.col("user_id") % 50).cast("double").alias("f0"))
    work = lambda p: N.merge_boxes([(a, b, f, f + 5) for a, b, f in zip(p["t0"], p["t1"], p["f0"], strict=True)], 30.0, 2.0)
    return K.per_group(e, ["session_id", "hour"], work, "t0 double, t1 double, f0 double, f1 double")


_STEP = """, d{b} AS (SELECT x.a, y.b, min(x.d + y.d) AS d FROM d{a} x JOIN d{a} y ON x.b = y.a GROUP BY ALL)"""


def geodesics(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest paths over a neighbour graph of a grid on the torus; edges cost their length over the density of points."""
    p = A.points(spark, sf).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n, period = 8, 6.0
    c = (np.arange(n) + 0.5) * period / n
    nodes = np.array([(a, b) for a in c for b in c])
    count, xx, xy, yy = p.agg(F.count(F.lit(1)), F.var_samp("x"), F.covar_samp("x", "y"), F.var_samp("y")).first()
    if count < 3:  # no density
        return spark.createDataFrame([], "a int, b int, d double")
    inv = np.linalg.inv(np.array([[xx, xy], [xy, yy]]) * count ** (-1 / 3))  # Scott's bandwidth

    def sums(batches):
        import pandas as pd

        for q in batches:
            yield pd.DataFrame({"node": range(n * n), "s": N.kernel_sums(q[["x", "y"]].to_numpy(float), nodes, inv, period)})

    density = p.mapInPandas(sums, "node int, s double").groupBy("node").agg(F.sum("s").alias("s"))

    def work(rows):
        dens = rows.sort_values("node")["s"].to_numpy(float)
        dens = dens / dens.mean() + 1e-3
        edges = []
        for i in range(n):
            for j in range(n):
                for di, dj in ((0, 1), (1, 0), (1, 1), (1, -1)):
                    a, b = i * n + j, ((i + di) % n) * n + (j + dj) % n
                    edges.append((a, b, np.hypot(di, dj) * period / n * 2 / (dens[a] + dens[b])))
        d = N.geodesic_matrix(edges, n * n)
        return [(int(a), int(b), float(d[a, b])) for a in range(n * n) for b in range(n * n) if a < b]

    # one task, for the 64 sums
    return K.per_group(density.withColumn("grid", F.lit(0)), ["grid"], work, "a int, b int, d double").select("a", "b", "d")


@query(POINTS + """, v AS (SELECT count(*) AS n, var_samp(x) * count(*) ** (-1 / 3.0) AS xx, covar_samp(x, y) * count(*) ** (-1 / 3.0) AS xy, var_samp(y) * count(*) ** (-1 / 3.0) AS yy FROM points),
    kr AS (SELECT yy / (xx * yy - xy * xy) AS a, -xy / (xx * yy - xy * xy) AS b, xx / (xx * yy - xy * xy) AS c FROM v),
    im AS (SELECT 6.0 * i AS sx, 6.0 * j AS sy FROM range(-1, 2) s(i), range(-1, 2) t(j)),
    g AS (SELECT i, j, (i + 0.5) * 6 / 8 AS gx, (j + 0.5) * 6 / 8 AS gy FROM range(8) s(i), range(8) t(j)),
    f AS (SELECT i, j, sum(exp(-0.5 * (a * (gx - x - sx) ** 2 + 2 * b * (gx - x - sx) * (gy - y - sy) + c * (gy - y - sy) ** 2))) AS f FROM points, kr, im, g GROUP BY ALL),
    q AS (SELECT i, j, f / avg(f) OVER () + 0.001 AS f FROM f),
    e AS (SELECT p.i * 8 + p.j AS a, r.i * 8 + r.j AS b, sqrt(di * di + dj * dj) * 0.75 * 2 / (p.f + r.f) AS d FROM q p, (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) m(di, dj), q r WHERE r.i = (p.i + di) % 8 AND r.j = (p.j + dj + 8) % 8),
    d0 AS (SELECT a, b, d FROM e UNION ALL SELECT b, a, d FROM e UNION ALL SELECT n, n, 0 FROM range(64) t(n))""" + "".join(_STEP.format(a=k, b=k + 1) for k in range(6)) + """
    SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(d, 6) AS d FROM d6 WHERE a < b""")
def density_geodesics(spark: SparkSession, sf: str) -> DataFrame:
    """``geodesics``, rounded."""
    return geodesics(spark, sf).select("a", "b", r6("d").alias("d"))


@query("SELECT CAST(i AS BIGINT) AS i, round(i * 1 / 377.0::DOUBLE, 9) AS x, round(i * 233 / 377.0::DOUBLE, 9) AS y FROM range(377) r(i)")
def fibonacci_lattice(spark: SparkSession, sf: str) -> DataFrame:
    b = N.fibonacci_lattice(14)[1]
    return spark.range(377).select(F.col("id").alias("i"), F.round(F.col("id") * F.lit(float(b[0])), 9).alias("x"), F.round(F.col("id") * F.lit(float(b[1])), 9).alias("y"))


@query("SELECT CAST(i AS BIGINT) AS i, round(i / 512.0::DOUBLE, 9) AS x0, round(i * 17 / 512.0::DOUBLE, 9) AS x1, round(i * 289 / 512.0::DOUBLE, 9) AS x2 FROM range(512) r(i)")
def korobov_lattice(spark: SparkSession, sf: str) -> DataFrame:
    b = N.korobov(17, 3, 512)[1]
    return spark.range(512).select(F.col("id").alias("i"), *[F.round(F.col("id") * F.lit(float(x)), 9).alias(f"x{k}") for k, x in enumerate(b)])


@query("WITH g AS (SELECT 1.3247179572447460 AS g) SELECT CAST(i AS BIGINT) AS i, round(i * (1 - 1 / g), 7) AS x0, round(i * (1 - 1 / (g * g)), 7) AS x1 FROM range(500) r(i), g")
def roberts_sequence(spark: SparkSession, sf: str) -> DataFrame:
    b = N.roberts(2, 2)[1]
    return spark.range(500).select(F.col("id").alias("i"), *[F.round(F.col("id") * F.lit(float(x)), 7).alias(f"x{k}") for k, x in enumerate(b)])


@query("SELECT CAST(i * 20 + j AS BIGINT) AS node, round((i + 0.5) * 6 / 20, 9) AS x, round((j + 0.5) * 6 / 20, 9) AS y FROM range(20) a(i), range(20) b(j)")
def torus_grid(spark: SparkSession, sf: str) -> DataFrame:
    i, j = F.floor(F.col("id") / 20), F.col("id") % 20
    return spark.range(400).select(F.col("id").alias("node"), F.round((i + 0.5) * 6 / 20, 9).alias("x"), F.round((j + 0.5) * 6 / 20, 9).alias("y"))


_RC = """p AS (SELECT ln(CAST({p0} AS DOUBLE) + {b} + 1e-20) AS low, ln(CAST({p1} AS DOUBLE) + {b} + 1e-20) AS high),
    q AS (SELECT low, high, (high - low) / ({n} - 1) AS gap, CAST(ceil(exp(high + 2 * (high - low) / ({n} - 1)) - 1e-20 - {b}) AS BIGINT) AS steps FROM p),
    bump AS (SELECT k, i, steps - 1 - i AS row, {e} + steps AS rows,
                    (1 + cos(least(pi(), greatest(-pi(), (ln(i + CAST({b} AS DOUBLE) + 1e-20) - low - gap * k) * pi() / (2 * gap))))) / 2 AS v
             FROM q, range({n}) c(k), (SELECT unnest(range(100000)) AS i) t WHERE i < steps),
    cut AS (SELECT {e} + k AS component, row - rows + {w} AS time, v FROM bump WHERE row >= rows - {w}
            UNION ALL SELECT k, rows - 1 - k - rows + {w}, 1.0 FROM range({e}) c(k), (SELECT max(rows) AS rows FROM bump)),
    rc AS (SELECT CAST(time AS INTEGER) AS time, CAST(component AS INTEGER) AS component, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY component)), 0) AS value FROM cut)"""
_LAPLACE = """lv AS (SELECT l, pow(2, l - 1) AS gap, CAST(floor({w} / pow(2, l - 1) - 1) AS BIGINT) AS places FROM (SELECT unnest(range(0, 100)) * CAST({s} AS DOUBLE) AS l) WHERE l < {n}),
    ctr AS (SELECT l, j, gap, floor(({w} - ((places - 1) * gap + 1)) / 2 + gap / 2 + gap * j) + 1 AS c FROM lv, (SELECT unnest(range({w} * 2)) AS j) WHERE j BETWEEN 1 AND places - 1),
    num AS (SELECT *, row_number() OVER (ORDER BY l, j) - 1 AS component FROM ctr),
    raw AS (SELECT component, i, exp(-((i - c) * (i - c)) / (2 * pow(gap / 2.35 * {f}, 2))) AS g FROM num, range({w}) t(i)),
    lp AS (SELECT CAST(i AS INTEGER) AS time, CAST(component AS INTEGER) AS component, g / sqrt(sum(g * g) OVER (PARTITION BY component)) AS value FROM raw)"""
_SPLINE = """kn AS (SELECT i - 1 AS i, t FROM (SELECT unnest({knots}) AS t, generate_subscripts({knots}, 1) AS i)),
    s0 AS (SELECT a.i, x, CASE WHEN a.i = least(greatest((SELECT max(k.i) FROM kn k WHERE k.t <= x), {d}), (SELECT count(*) FROM kn) - {d} - 2) THEN 1.0 ELSE 0.0 END AS v FROM kn a, range({w}) r(x) WHERE a.i < (SELECT count(*) FROM kn) - 1)"""
_RISE = """s{d} AS (SELECT a.i, a.x, coalesce((a.x - t0.t) / nullif(t1.t - t0.t, 0), 0) * a.v + coalesce((t3.t - a.x) / nullif(t3.t - t2.t, 0), 0) * b.v AS v
    FROM s{c} a JOIN s{c} b ON b.i = a.i + 1 AND b.x = a.x JOIN kn t0 ON t0.i = a.i JOIN kn t1 ON t1.i = a.i + {d} JOIN kn t2 ON t2.i = a.i + 1 JOIN kn t3 ON t3.i = a.i + 1 + {d})"""
_KNOTS = "[0.0, 0.0, 0.0, 0.0, 12.0, 20.0, 36.0, 36.0, 36.0, 36.0]"


@query("WITH " + _RC.format(p0=1, p1=12, b=2, n=5, e=2, w=30) + ", " + _LAPLACE.format(w=40, s=0.5, n=3, f=1.2) + ", " + _SPLINE.format(knots=_KNOTS, d=3, w=40) + "".join(", " + _RISE.format(d=d, c=d - 1) for d in (1, 2, 3)) + """
    SELECT 'raised_cosine' AS basis, time, component, round(value, 9) AS value FROM rc WHERE value > 1e-12
    UNION ALL SELECT 'laplacian', time, component, round(value, 9) FROM lp WHERE value > 1e-12
    UNION ALL SELECT 'bspline', CAST(39 - x AS INTEGER), CAST(i AS INTEGER), round(v, 9) FROM s3 WHERE i < 6 AND abs(v) > 1e-12
    UNION ALL SELECT 'identity', CAST(7 - k AS INTEGER), CAST(k AS INTEGER), 1.0 FROM range(8) r(k)""")
def basis_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Bases that histories are projected on, as (basis, time, component, value) where they aren't 0."""
    made = {
        "raised_cosine": N.raised_cosine(2, 5, (1, 12), 2, 30), "laplacian": N.laplacian_pyramid(40, 3, 0.5, 1.2),
        "bspline": N.bsplines(40, np.array([0, 4, 12, 20, 30, 36])), "identity": N.identity_basis(8),
    }
    rows = [(name, int(t), int(c), round(float(m[t, c]), 9)) for name, m in made.items() for t, c in zip(*np.nonzero(np.abs(m) > 1e-12), strict=True)]
    return spark.createDataFrame(rows, "basis string, time int, component int, value double")


@query("WITH " + _RC.format(p0=1, p1=60, b=1, n=5, e=0, w=64) + """, e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS time FROM embeddings WHERE len(embedding) = 64)
    SELECT vec_id, """ + ", ".join(f"round(sum(CASE WHEN component = {k} THEN x * value END), 6) AS b{k}" for k in range(5)) + " FROM e JOIN rc USING (time) GROUP BY vec_id")
def projected_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Histories of 64 steps on five bumps, as expressions over the arrays."""
    b = N.raised_cosine(0, 5, (1, 60), 1, 64)
    x = F.transform("embedding", lambda v: v.cast("double"))
    dot = [r6(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in b[:, k]]), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)).alias(f"b{k}") for k in range(5)]
    return A.table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", *dot)


@query(A.with_sql("events_m") + """, s AS (SELECT session_id, count(*) AS n FROM events_m GROUP BY session_id)
    SELECT session_id, n, row_number() OVER (ORDER BY md5('42:' || strftime(session_id, '%Y-%m-%d')), session_id) <= greatest(1, CAST(round_even(0.1 * (SELECT count(*) FROM s), 0) AS BIGINT)) AS held_out FROM s""")
def held_out_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events by whether their session is held out; a tenth of the sessions, those first by a seeded hash of their id."""
    s = A.events(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return Z.held_out(s, "session_id", 0.1, 42)


@query(CALLS + """, n AS (SELECT session_id, count(*) FILTER (category = 'click') AS a, count(*) FILTER (category = 'view') AS b, count(*) FILTER (category = 'purchase') AS c, count(*) FILTER (category = 'signup') AS d FROM calls GROUP BY session_id),
    t AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d, sum(a + b + c + d) AS n, greatest(1, CAST(round_even(count(*) * 0.2, 0) AS BIGINT)) AS size FROM n),
    o AS (SELECT k, n.*, row_number() OVER (PARTITION BY k ORDER BY md5('42:' || k || ':' || strftime(session_id, '%Y-%m-%d')), session_id) AS place FROM n, range(1, 3000) r(k)),
    p AS (SELECT o.* FROM o, t WHERE place <= size), h AS (SELECT k, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d, sum(a + b + c + d) AS n FROM p GROUP BY k),
    g AS (SELECT k FROM h, t WHERE least(h.a, h.b, h.c, h.d) > 0 AND least(t.a - h.a, t.b - h.b, t.c - h.c, t.d - h.d) > 0
          AND greatest(abs(h.a / h.n - t.a / t.n), abs(h.b / h.n - t.b / t.n), abs(h.c / h.n - t.c / t.n), abs(h.d / h.n - t.d / t.n)) <= 0.05 + 0.02 * (k // 1000) ORDER BY k LIMIT 5)
    SELECT CAST(dense_rank() OVER (ORDER BY g.k) - 1 AS INTEGER) AS split, session_id FROM g JOIN p USING (k)""")
def stratified_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Test sessions of seeded splits whose classes are distributed as all are."""
    n = A.calls(spark, sf).groupBy("session_id").pivot("category", ["click", "view", "purchase", "signup"]).agg(F.count(F.lit(1))).na.fill(0).collect()
    splits = Z.stratified_session_splits({r["session_id"]: list(r[1:]) for r in n}, 5, 0.2, 0.05, 42)
    return spark.createDataFrame([(i, s) for i, part in enumerate(splits) for s in part], "split int, session_id date")


@query(CALLS + " SELECT event_id, category FROM calls QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('17:' || event_id), event_id) <= 50")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty events of each category without replacement; which ones depends on the seed."""
    w = Window.partitionBy("category").orderBy("r", "event_id")
    e = A.calls(spark, sf).select("event_id", "category").withColumn("r", Z.seeded_hash(17, F.col("event_id")))
    return e.withColumn("k", F.row_number().over(w)).where("k <= 50").select("event_id", "category")
