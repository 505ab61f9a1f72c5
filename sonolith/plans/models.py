"""Queries for models with given parameters, penalties and stepwise regression, and settings."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.functions import config as C
from sonolith.functions import mixtures as X
from sonolith.operators import chains as H
from sonolith.operators import triage as T
from sonolith.operators import tuning as U
from sonolith.plans.curves import _RATE, _spk
from sonolith.plans.registry import query

FRAMES, POINTS, CALLS = (A.with_sql(x) for x in ("frames", "points", "calls"))


def r6(x, n: int = 6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


@query(_RATE + """, g AS (SELECT session_id, unit_id, bin, rate, avg(rate) OVER w AS m, stddev_pop(rate) OVER w AS s FROM r WINDOW w AS (PARTITION BY session_id, unit_id)),
    i AS (SELECT *, bin - row_number() OVER (PARTITION BY session_id, unit_id ORDER BY bin) AS island FROM g WHERE rate > m + 1e-9),
    l AS (SELECT session_id, unit_id, max(n) AS longest FROM (SELECT session_id, unit_id, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY ALL),
    p AS (SELECT session_id, unit_id, max(CASE WHEN s > 1e-9 THEN (rate - m) / s END) AS peak FROM g GROUP BY ALL)
    SELECT session_id, unit_id, CAST(coalesce(longest, 0) AS BIGINT) AS longest, coalesce(coalesce(longest, 0) >= 3 AND round(peak, 6) >= 1.5, false) AS flag FROM p LEFT JOIN l USING (session_id, unit_id)""")
def flagged_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Units with three neighbouring bins or more over their mean rate, and a peak that stands out."""
    keys = ["session_id", "unit_id"]
    w = Window.partitionBy(*keys)
    r = U.rate_map(A.frames(spark, sf), _spk(spark, sf), "speed", 0, 50, 10, 150.0, ("session_id",)).select(*keys, "bin", "rate", F.avg("rate").over(w).alias("m"), F.stddev_pop("rate").over(w).alias("s"))
    island = r.where(F.col("rate") > F.col("m") + 1e-9).withColumn("island", F.col("bin") - F.row_number().over(w.orderBy("bin")))
    longest = island.groupBy(*keys, "island").count().groupBy(*keys).agg(F.max("count").alias("longest"))
    peak = r.groupBy(*keys).agg(F.max(F.when(F.col("s") > 1e-9, (F.col("rate") - F.col("m")) / F.col("s"))).alias("peak"))
    out = peak.join(longest, keys, "left").withColumn("longest", F.coalesce("longest", F.lit(0)).cast("long"))
    return out.select(*keys, "longest", T.run_flag(F.col("longest"), r6("peak"), 1.5, 3).alias("flag"))


_NORMALS = X.Mixture(np.array([0.6, 0.4]), np.array([-1.0, 2.0]), np.array([0.25, 1.0]), None, 0.0)
_STUDENTS = X.Mixture(np.array([0.6, 0.4]), np.array([-1.0, 2.0]), np.array([0.25, 1.0]), np.array([4.0, 7.0]), 0.0)


@query("""WITH x AS (SELECT i, -4 + 0.04 * i AS v FROM range(200) r(i)), m AS (SELECT * FROM (VALUES (0.6, -1.0, 0.5, 4.0), (0.4, 2.0, 1.0, 7.0)) t(w, mu, sd, nu)),
    z AS (SELECT i, w::DOUBLE AS w, nu::DOUBLE AS nu, ((v - mu) / sd)::DOUBLE AS z FROM x, m),
    s AS (SELECT i, w, z, any_value(abs(z)) / 1200 * sum(c * exp(-0.5 * pow(z * k / 400, 2))) / sqrt(2 * pi()) AS a,
                 any_value(abs(z)) / 1200 * sum(c * pow(1 + pow(z * k / 400, 2) / nu, -(nu + 1) / 2)) * any_value(exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi())) AS b
          FROM z, (SELECT k, CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS c FROM range(401) r(k)) GROUP BY i, w, z, nu)
    SELECT CAST(i AS BIGINT) AS id, round(sum(w * (0.5 + sign(z) * a)), 6) AS normal, round(sum(w * (0.5 + sign(z) * b)), 6) AS student FROM s GROUP BY i""")
def mixture_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of intervals below 200 places, under a mixture of normals and one of Student-t."""

    def run(batches):
        import pandas as pd

        for p in batches:
            x = [math.exp(-4 + 0.04 * i) for i in p["id"]]
            yield pd.DataFrame({"id": p["id"], "normal": [_NORMALS.cdf(v) for v in x], "student": [_STUDENTS.cdf(v) for v in x]})

    return spark.range(200).mapInPandas(run, "id long, normal double, student double").select("id", r6("normal").alias("normal"), r6("student").alias("student"))


_LOGS = CALLS + """, l AS (SELECT session_id, sex, start - lag(start) OVER w AS i, sex = lag(sex) OVER w AS same FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY row_idx)),
    x AS (SELECT sex, ln(i) AS x FROM l WHERE same AND sex <> 'unassigned' AND i > 0)"""


@query(_LOGS + """, d AS (SELECT sex, ln(0.5) - 0.5 * pow((x - 3) / 2, 2) - ln(2 * sqrt(2 * pi())) AS a, ln(0.5) - 0.5 * pow((x - 7) / 1.5, 2) - ln(1.5 * sqrt(2 * pi())) AS b FROM x),
    t AS (SELECT sex, a, b, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS t FROM d)
    SELECT sex, count(*) AS n, round(sum(t), 4) AS loglik, round(-2 * sum(t) + 5 * ln(count(*)), 4) AS bic, round(-2 * sum(t) + 5 * ln(count(*)) - 2 * sum(exp(a - t) * (a - t) + exp(b - t) * (b - t)), 4) AS icl FROM t GROUP BY sex""")
def information_criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Log likelihood, BIC and ICL of a given mixture of two normals on the logs of intervals, as sums."""
    from sonolith.plans.kernels import _logs

    a, b = (F.lit(math.log(0.5)) + H.normal_log(F.col("log_interval"), m, s) for m, s in ((3.0, 2.0), (7.0, 1.5)))
    d = _logs(spark, sf).select("sex", a.alias("a"), b.alias("b")).withColumn("top", F.greatest("a", "b"))
    d = d.withColumn("t", F.col("top") + F.log(F.exp(F.col("a") - F.col("top")) + F.exp(F.col("b") - F.col("top"))))
    gain = sum((F.exp(F.col(c) - F.col("t")) * (F.col(c) - F.col("t")) for c in "ab"), F.lit(0.0))
    s = d.groupBy("sex").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("l"), F.sum(gain).alias("g"))
    bic = -2 * F.col("l") + 5 * F.log("n")
    return s.select("sex", "n", r6("l", 4).alias("loglik"), r6(bic, 4).alias("bic"), r6(bic - 2 * F.col("g"), 4).alias("icl"))


_SEQ = FRAMES + """, q AS (SELECT session_id, frame_index // 100 AS seq, frame_index % 100 AS i, -0.5 * pow((speed - 14.3) / 9, 2) - ln(9 * sqrt(2 * pi())) AS e0, -0.5 * pow((speed - 35.1) / 11, 2) - ln(11 * sqrt(2 * pi())) AS e1, yaw / 180 AS u FROM frames)"""


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of a hundred frames with the log densities of two states and an input."""
    f = A.frames(spark, sf)
    return f.select("session_id", F.floor(F.col("frame_index") / 100).cast("long").alias("seq"), "frame_index", H.normal_log(F.col("speed"), 14.3, 9.0).alias("e0"), H.normal_log(F.col("speed"), 35.1, 11.0).alias("e1"), (F.col("yaw") / 180).alias("u"))


@query(_SEQ.replace("WITH ", "WITH RECURSIVE ", 1) + """, v AS (SELECT session_id, seq, 0::BIGINT AS i, ln(0.5) + e0 AS d0, ln(0.5) + e1 AS d1, 0 AS n0, 1 AS n1 FROM q WHERE i = 0 UNION ALL
      SELECT v.session_id, v.seq, q.i, greatest(d0 + ln(0.9), d1 + ln(0.1)) + e0, greatest(d0 + ln(0.1), d1 + ln(0.9)) + e1, CASE WHEN d0 + ln(0.9) >= d1 + ln(0.1) THEN n0 ELSE n1 END, 1 + CASE WHEN d0 + ln(0.1) >= d1 + ln(0.9) THEN n0 ELSE n1 END
      FROM v JOIN q ON q.session_id = v.session_id AND q.seq = v.seq AND q.i = v.i + 1)
    SELECT session_id, seq, i + 1 AS n, CAST(CASE WHEN d0 >= d1 THEN n0 ELSE n1 END AS BIGINT) AS n_high FROM v QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY i DESC) = 1""")
def likeliest_states(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of each stretch that the likeliest path spends in the second of two states."""
    p = H.paths(_sequences(spark, sf), ["session_id", "seq"], "frame_index", ["e0", "e1"], np.log([0.5, 0.5]), np.log([[0.9, 0.1], [0.1, 0.9]]))
    return p.groupBy("session_id", "seq").agg(F.count(F.lit(1)).alias("n"), F.sum("state").alias("n_high"))


@query(_SEQ.replace("WITH ", "WITH RECURSIVE ", 1) + """, v AS (SELECT session_id, seq, 0::BIGINT AS i, exp(e0) / (exp(e0) + exp(e1)) AS a0, exp(e1) / (exp(e0) + exp(e1)) AS a1, ln(0.5 * (exp(e0) + exp(e1))) AS l FROM q WHERE i = 0 UNION ALL
      SELECT session_id, seq, i, x / (x + y), y / (x + y), l + ln(x + y) FROM (
        SELECT v.session_id, v.seq, q.i, l, (a0 / (1 + exp(-(2 + u))) + a1 * (1 - 1 / (1 + exp(-(1 - 0.5 * u))))) * exp(e0) AS x, (a0 * (1 - 1 / (1 + exp(-(2 + u)))) + a1 / (1 + exp(-(1 - 0.5 * u)))) * exp(e1) AS y
        FROM v JOIN q ON q.session_id = v.session_id AND q.seq = v.seq AND q.i = v.i + 1))
    SELECT session_id, seq, CAST(i + 1 AS INTEGER) AS n, round(l, 5) AS loglik FROM v QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY i DESC) = 1""")
def driven_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Log likelihood of each stretch where an input drives the chance to stay in a state."""
    d = H.driven_likelihood(_sequences(spark, sf), ["session_id", "seq"], "frame_index", ["e0", "e1"], "u", [(2.0, 1.0), (1.0, -0.5)])
    return d.withColumn("loglik", r6("loglik", 5))


_BESSEL = sum(1.25 ** (2 * i) / math.factorial(i) ** 2 for i in range(60))


@query(POINTS + f""", v AS (SELECT label, 2.5 * cos((x - px) * pi() / 3) + 2.5 * cos((y - py) * pi() / 3) - 2 * ln(2 * pi() * {_BESSEL!r}) AS l FROM points),
    s AS (SELECT label, list_transform(embedding[1:3], lambda v: CAST(v AS DOUBLE) * 2) AS s, vec_id % 3 AS c FROM embeddings WHERE len(embedding) >= 4),
    m AS (SELECT label, s[CAST(c + 1 AS INTEGER)] - ln(exp(s[1]) + exp(s[2]) + exp(s[3])) AS l FROM s)
    SELECT label, round(any_value(a.l), 5) AS von_mises, round(any_value(b.l), 5) AS multinomial FROM (SELECT label, sum(l) AS l FROM v GROUP BY label) a JOIN (SELECT label, sum(l) AS l FROM m GROUP BY label) b USING (label) GROUP BY label""")
def emission_likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    """Log likelihood of positions on the torus and of classes, by label."""
    turn = lambda c: F.col(c) * F.lit(math.pi / 3)
    scores = [F.get("s", F.lit(i)).cast("double") * 2 for i in range(3)]
    s = A.table(spark, sf, "embeddings").where("size(embedding) >= 4").select("vec_id", F.slice("embedding", 1, 3).alias("s"))
    p = A.points(spark, sf).join(s, "vec_id")
    v = H.von_mises_log(turn("x"), turn("px"), 2.5) + H.von_mises_log(turn("y"), turn("py"), 2.5)
    m = H.softmax_log(scores, (F.col("vec_id") % 3).cast("int"))
    return p.groupBy("label").agg(r6(F.sum(v), 5).alias("von_mises"), r6(F.sum(m), 5).alias("multinomial"))


# regressions by sums


def _target(spark: SparkSession, sf: str) -> DataFrame:
    f = A.frames(spark, sf)
    return f.withColumns({"y": F.col("distance") + 0.3 * F.col("speed") + 0.05 * F.col("yaw"), "fold": (F.col("frame_index") % 4).cast("int")})


_SUMS = FRAMES + """, f AS (SELECT *, distance + 0.3 * speed + 0.05 * yaw AS y, frame_index % 4 AS fold FROM frames),
    a AS (SELECT fold, unnest(['speed', 'yaw', 'space_x', 'space_y']) AS f, unnest([speed, yaw, space_x, space_y]) AS v, session_id, frame_index, y FROM f),"""
_FOLDS = [0.0, 0.1, 1.0, 10.0, 100.0, 1000.0]


@query(FRAMES + f""", f AS (SELECT *, distance + 0.3 * speed + 0.05 * yaw AS y, frame_index % 4 AS fold FROM frames), k AS (SELECT unnest(range(4)) AS k),
    t AS (SELECT k, covar_pop(speed, speed) AS aa, covar_pop(speed, yaw) AS ab, covar_pop(yaw, yaw) AS bb, covar_pop(speed, y) AS ay, covar_pop(yaw, y) AS bz, avg(speed) AS ma, avg(yaw) AS mb, avg(y) AS my FROM f, k WHERE fold <> k GROUP BY k),
    c AS (SELECT k, l, (ay * (bb + l) - bz * ab) / ((aa + l) * (bb + l) - ab * ab) AS b1, (bz * (aa + l) - ay * ab) / ((aa + l) * (bb + l) - ab * ab) AS b2, ma, mb, my FROM t, (SELECT unnest({_FOLDS}::DOUBLE[]) AS l)),
    e AS (SELECT l, k, avg(pow(y - my - b1 * (speed - ma) - b2 * (yaw - mb), 2)) AS e FROM f JOIN c ON c.k = f.fold GROUP BY l, k),
    s AS (SELECT l AS penalty, avg(e) AS error, stddev_samp(e) / 2 AS se FROM e GROUP BY l), m AS (SELECT arg_min(error + se, (error, penalty)) AS top, arg_min(penalty, (error, penalty)) AS best FROM s)
    SELECT penalty, round(error, 5) AS error, round(se, 5) AS standard_error, penalty = best AS least, penalty = (SELECT max(penalty) FROM s, m WHERE error <= top) AS one_error FROM s, m""")
def penalty_search(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out errors of ridge fits over a grid of penalties, the least, and the largest within one standard error of it."""
    found = H.search_penalty(H.products(_target(spark, sf), ["speed", "yaw"], "y", "fold"), [1, 2], _FOLDS)
    return spark.createDataFrame(found, "penalty double, error double, standard_error double, least boolean, one_error boolean").withColumns({"error": r6("error", 5), "standard_error": r6("standard_error", 5)})


@query(_SUMS + """ k AS (SELECT unnest(range(4)) AS k),
    o AS (SELECT k, f, covar_pop(v, y) / var_pop(v) AS b, avg(v) AS mv, avg(y) AS my FROM a, k WHERE fold <> k GROUP BY k, f),
    e1 AS (SELECT f, avg(e) AS e FROM (SELECT a.f, o.k, avg(pow(y - my - b * (v - mv), 2)) AS e FROM a JOIN o ON o.k = a.fold AND o.f = a.f GROUP BY a.f, o.k) GROUP BY f),
    one AS (SELECT f, e FROM e1 ORDER BY e, f LIMIT 1),
    pr AS (SELECT p.fold, q.f, p.v AS u, q.v AS v, p.y FROM a p JOIN one ON one.f = p.f JOIN a q ON q.session_id = p.session_id AND q.frame_index = p.frame_index AND q.f <> p.f),
    t AS (SELECT k, f, covar_pop(u, u) AS aa, covar_pop(u, v) AS ab, covar_pop(v, v) AS bb, covar_pop(u, y) AS ay, covar_pop(v, y) AS bz, avg(u) AS mu, avg(v) AS mv, avg(y) AS my FROM pr, k WHERE fold <> k GROUP BY k, f),
    e2 AS (SELECT f, avg(e) AS e FROM (SELECT t.f, t.k, avg(pow(y - my - (ay * bb - bz * ab) / (aa * bb - ab * ab) * (u - mu) - (bz * aa - ay * ab) / (aa * bb - ab * ab) * (v - mv), 2)) AS e FROM pr JOIN t ON t.k = pr.fold AND t.f = pr.f GROUP BY t.f, t.k) GROUP BY f),
    two AS (SELECT f, e FROM e2 ORDER BY e, f LIMIT 1)
    SELECT 0 AS step, f AS feature, round(e, 5) AS error FROM one UNION ALL SELECT 1, two.f, round(two.e, 5) FROM two, one WHERE one.e - two.e >= 0.5""")
def stepwise_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Features chosen one after the other on held-out error, out of one pass of sums."""
    names = ["speed", "yaw", "space_x", "space_y"]
    found = H.select_stepwise(H.products(_target(spark, sf), names, "y", "fold"), names, 0.5)
    return spark.createDataFrame([(i, n, round(e, 5)) for i, (n, e) in enumerate(found)], "step int, feature string, error double")


# settings


@query("""SELECT event_id, 'model.k' AS path, CAST(CASE WHEN event_id % 2 = 0 THEN 7 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS BIGINT) AS value,
    sha256('{"model":{"k":' || CASE WHEN event_id % 2 = 0 THEN '7' ELSE json_extract_string(props, '$.k') END || '},"name":"' || event_type || '"}') AS digest, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') = '7' ELSE true END AS unchanged FROM events""")
def overridden_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of each event with one value overridden in every second: where it is, what it becomes, a digest, and whether anything changed."""

    def run(batches):
        import pandas as pd

        for p in batches:
            rows = []
            for i, props, name in zip(p["event_id"], p["props"], p["event_type"], strict=True):
                own = {"model": json.loads(props), "name": name}
                now = C.overridden(own, ["k=7"]) if i % 2 == 0 else own
                path = C.paths_of(now, "k")[0]
                rows.append((i, path, now["model"]["k"], C.digest(now), C.blocks_equal(own, now)))
            yield pd.DataFrame(rows, columns=["event_id", "path", "value", "digest", "unchanged"])

    return A.table(spark, sf, "events").select("event_id", "props", "event_type").mapInPandas(run, "event_id long, path string, value long, digest string, unchanged boolean")


# tables side by side


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_name FROM nation), b AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, r_name FROM region)
    SELECT coalesce(a.i, b.i) AS place, n_name, r_name FROM a FULL JOIN b ON a.i = b.i""")
def horizontal_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables side by side by place, nulls where the shorter one ends."""
    from sonolith.operators.relational import beside

    return beside([(A.table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]), (A.table(spark, sf, "region").select("r_regionkey", "r_name"), ["r_regionkey"])], "place").select("place", "n_name", "r_name")


@query("SELECT label, count(*) AS n, round(sum(vec_id * 0.5), 6) AS total FROM (SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings WHERE label < 3) GROUP BY label")
def vertical_concat(spark: SparkSession, sf: str) -> DataFrame:
    """One table below another of the same columns, repeated rows kept, written as CSV and read again."""
    from sonolith.plans.streams import _work_dir

    e = A.table(spark, sf, "embeddings").select("vec_id", "label")
    base = _work_dir(spark)
    e.unionByName(e.where("label < 3")).write.option("header", True).csv(base)
    back = spark.read.schema("vec_id long, label int").option("header", True).csv(base)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("vec_id") * 0.5)).alias("total"))
