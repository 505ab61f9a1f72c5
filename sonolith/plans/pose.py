"""Queries for pose geometry, unit quality, lattice embeddings and what follows from mixtures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.functions import learning as L
from sonolith.functions import mixtures as X
from sonolith.functions import numeric as N
from sonolith.functions import pose as P
from sonolith.functions import scalars as S
from sonolith.operators import kernels as K
from sonolith.plans.registry import query

FRAMES, POINTS, CALLS = (A.with_sql(x) for x in ("frames", "points", "calls"))


def r6(x, n: int = 6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


@query(FRAMES + """ SELECT session_id, frame_index, round(0.8 * space_x - 0.6 * space_y, 6) AS rx, round(0.6 * space_x + 0.8 * space_y, 6) AS ry, round(((space_x - 1) * 0.8 - (space_y - 2) * 0.6) * 10, 6) AS ax FROM frames""")
def rotated_points(spark: SparkSession, sf: str) -> DataFrame:
    f = A.frames(spark, sf)
    theta = math.atan2(0.6, 0.8)
    p = (F.col("space_x"), F.col("space_y"), F.lit(0.0))
    r, a = P.rotate(p, "z", theta), P.affine(p, (1.0, 2.0, 0.0), theta, 10.0)
    return f.select("session_id", "frame_index", r6(r[0]).alias("rx"), r6(r[1]).alias("ry"), r6(a[0]).alias("ax"))


@query(FRAMES + """, a AS (SELECT session_id, frame_index, yaw, CASE WHEN sqrt((10 - space_x) ** 2 + (5 - space_y) ** 2) >= 1 THEN degrees(atan2(5 - space_y, 10 - space_x)) END - yaw AS d FROM frames)
    SELECT session_id, frame_index, round(d - 360 * ceil(round(d / 360 - 0.5, 9)), 5) AS bearing FROM a""")
def egocentric_bearings(spark: SparkSession, sf: str) -> DataFrame:
    f = A.frames(spark, sf)
    a, _ = P.yaw_pitch(F.lit(10.0) - F.col("space_x"), F.lit(5.0) - F.col("space_y"), F.lit(0.0), 1.0)
    d = a - F.col("yaw")
    return f.select("session_id", "frame_index", r6(d - F.lit(360.0) * F.ceil(F.round(d / 360 - F.lit(0.5), 9)), 5).alias("bearing"))


@query(FRAMES + """, v AS (SELECT session_id, quantile_cont(speed, 0.99) AS vmax FROM frames GROUP BY session_id),
    e AS (SELECT session_id, frame_index, cos(radians(yaw)) AS c, least(speed / vmax, 1) + exp(-distance / 20) AS g FROM frames JOIN v USING (session_id))
    SELECT session_id, count(*) AS n, round(avg(sign(c) * pow(abs(c), 2.0) * g), 6) AS mean_sei, round(max(sign(c) * pow(abs(c), 2.0) * g), 6) AS max_sei FROM e GROUP BY session_id""")
def social_engagement(spark: SparkSession, sf: str) -> DataFrame:
    f = A.frames(spark, sf)
    v = f.groupBy("session_id").agg(F.percentile("speed", F.lit(0.99)).alias("vmax"))
    e = f.join(v, "session_id").select("session_id", P.engagement(F.col("speed"), F.col("yaw"), F.col("distance"), F.col("vmax"), 2.0, 20.0).alias("sei"))
    return e.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("sei")).alias("mean_sei"), r6(F.max("sei")).alias("max_sei"))


def _curves(spark: SparkSession, sf: str, size: int) -> DataFrame:
    return A.table(spark, sf, "embeddings").where(f"size(embedding) >= {size}").select("vec_id", "label", F.slice("embedding", 1, size).alias("x"))


@query("""WITH n AS (SELECT vec_id, k, CAST(embedding[3 * k + 1] AS DOUBLE) AS x, CAST(embedding[3 * k + 2] AS DOUBLE) AS y, CAST(embedding[3 * k + 3] AS DOUBLE) AS z FROM embeddings, range(8) t(k) WHERE len(embedding) >= 24),
    s AS (SELECT a.vec_id, a.k, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) AS l FROM n a JOIN n b ON b.vec_id = a.vec_id AND b.k = a.k + 1),
    u AS (SELECT vec_id, k, CASE WHEN l > 1e-6 THEN l END AS l, CASE WHEN l > 1e-6 THEN x / l END AS x, CASE WHEN l > 1e-6 THEN y / l END AS y, CASE WHEN l > 1e-6 THEN z / l END AS z FROM s),
    c AS (SELECT a.vec_id, avg(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) / ((a.l + b.l) / 2)) AS c FROM u a JOIN u b ON b.vec_id = a.vec_id AND b.k = a.k + 1 GROUP BY a.vec_id)
    SELECT vec_id, round(any_value(c) * avg(l), 6) AS curvature FROM u JOIN c USING (vec_id) GROUP BY vec_id""")
def tail_curvatures(spark: SparkSession, sf: str) -> DataFrame:
    def run(batches):
        import pandas as pd

        for p in batches:
            yield pd.DataFrame({"vec_id": p["vec_id"], "curvature": P.tail_curvature(K.N_rows(p["x"]).reshape(len(p), 8, 3))})

    return _curves(spark, sf, 24).mapInPandas(run, "vec_id long, curvature double").withColumn("curvature", r6("curvature"))


@query("""WITH m AS (SELECT vec_id, list_transform(embedding[1:12], lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) >= 12),
    f AS (SELECT vec_id, e[1] - e[10] AS fx, e[2] - e[11] AS fy, e[3] - e[12] AS fz, e[4] - e[7] AS sx, e[5] - e[8] AS sy, e[6] - e[9] AS sz FROM m),
    g AS (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS fl FROM f), h AS (SELECT vec_id, fx / fl AS ax, fy / fl AS ay, fz / fl AS az, sx, sy, sz FROM g WHERE fl >= 1e-6),
    i AS (SELECT *, sx * ax + sy * ay + sz * az AS d FROM h), j AS (SELECT vec_id, ax, ay, az, sx - d * ax AS lx, sy - d * ay AS ly, sz - d * az AS lz FROM i),
    k AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS ll FROM j)
    SELECT vec_id, round(degrees(atan2(lz / ll, (ax * ly - ay * lx) / ll)), 5) AS roll, round(degrees(-asin(greatest(-1, least(1, az)))), 5) AS pitch, round(degrees(atan2(ay, ax)), 5) AS yaw FROM k WHERE ll >= 1e-6""")
def head_angles(spark: SparkSession, sf: str) -> DataFrame:
    """Roll, pitch and yaw of the head from four landmarks."""

    def run(batches):
        import pandas as pd

        for p in batches:
            m = K.N_rows(p["x"]).reshape(len(p), 4, 3)
            a = P.euler_angles(P.head_frame(m[:, 0], m[:, 1], m[:, 2], m[:, 3], 1e-6))
            yield pd.DataFrame({"vec_id": p["vec_id"], "roll": a[:, 0], "pitch": a[:, 1], "yaw": a[:, 2]})

    a = _curves(spark, sf, 12).mapInPandas(run, "vec_id long, roll double, pitch double, yaw double").where("not isnan(roll)")
    return a.select("vec_id", *[r6(c, 5).alias(c) for c in ("roll", "pitch", "yaw")])


@query("""WITH d AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings WHERE len(embedding) >= 3),
    u AS (SELECT label, x / greatest(sqrt(x * x + y * y + z * z), 1e-12) AS x, y / greatest(sqrt(x * x + y * y + z * z), 1e-12) AS y, z / greatest(sqrt(x * x + y * y + z * z), 1e-12) AS z FROM d)
    SELECT label, round(atan2(sum(y), sum(x)), 6) AS yaw, round(atan2(sum(z), sqrt(sum(x) ** 2 + sum(y) ** 2)), 6) AS pitch FROM u GROUP BY label""")
def back_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """The angles of the axis that directions lie nearest to on the whole: those of their sum."""
    yaw, pitch = P.mean_axis(*[F.col("x")[i].cast("double") for i in range(3)])
    return _curves(spark, sf, 3).groupBy("label").agg(r6(yaw).alias("yaw"), r6(pitch).alias("pitch"))


@query("""WITH f AS (SELECT l_suppkey % 5 AS unit_id, l_orderkey AS t, min(l_extendedprice) AS a FROM lineitem GROUP BY ALL),
    d AS (SELECT unit_id, a - lag(a) OVER (PARTITION BY unit_id ORDER BY t) AS d FROM f)
    SELECT unit_id, round(stddev_pop(d) / sqrt(2) / sqrt(100 ** 2 + 10 ** 2), 6) AS sd_ratio FROM d GROUP BY unit_id""")
def spike_noise_ratio(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("unit_id"), F.col("l_extendedprice").alias("a"), F.col("l_orderkey").cast("double").alias("at"))
    return K.per_group(li, ["unit_id"], lambda p: [(P.noise_deviation(p["at"].to_numpy(float), p["a"].to_numpy(float), 0.5, 100.0, 10.0),)], "sd_ratio double").withColumn("sd_ratio", r6("sd_ratio"))


@query("""WITH e AS (SELECT vec_id, i, CAST(i % 2 * 32 AS DOUBLE) AS cx, CAST(i // 2 * 40 AS DOUBLE) AS cy, abs(CAST(embedding[i + 1] AS DOUBLE)) + 0.01 AS a FROM embeddings, range(8) r(i) WHERE len(embedding) >= 8),
    m AS (SELECT vec_id, arg_max(cx, (a, -i)) AS mx, arg_max(cy, (a, -i)) AS my FROM e GROUP BY vec_id),
    d AS (SELECT e.vec_id, sqrt((cx - mx) ** 2 + (cy - my) ** 2) AS x, a * a AS w, ln(a) AS y FROM e JOIN m USING (vec_id))
    SELECT vec_id, round(-(sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2), 6) AS decay FROM d GROUP BY vec_id""")
def contact_decays(spark: SparkSession, sf: str) -> DataFrame:
    """Decay of amplitudes with distance from the contact that has the greatest."""

    def run(batches):
        import pandas as pd

        contacts = np.array([(x, y) for y in range(0, 160, 40) for x in (0, 32)], dtype=float)
        for p in batches:
            a = np.abs(K.N_rows(p["x"])) + 0.01 if len(p) else np.zeros((0, 8))
            d = [np.sqrt(((contacts - contacts[v.argmax()]) ** 2).sum(axis=1)) for v in a]
            yield pd.DataFrame({"vec_id": p["vec_id"], "decay": [P.exponential_decay(x, v) for x, v in zip(d, a, strict=True)]})

    return _curves(spark, sf, 8).mapInPandas(run, "vec_id long, decay double").withColumn("decay", r6("decay"))


@query()
def source_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Decay with distance and position of sources from amplitudes on a grid of contacts."""

    def run(batches):
        import pandas as pd

        contacts = np.array([(x, y) for y in range(0, 160, 40) for x in (0, 32)], dtype=float)
        for p in batches:
            rows = []
            for i, x in zip(p["vec_id"], p["x"], strict=True):
                a = np.abs(np.asarray(x, float)) + 0.01
                d = np.sqrt(((contacts - contacts[a.argmax()]) ** 2).sum(axis=1))
                rows.append((i, P.exponential_decay(d, a), *P.triangulate(contacts, a)[:3].tolist()))
            yield pd.DataFrame(rows, columns=["vec_id", "decay", "x", "y", "z"])

    return _curves(spark, sf, 8).mapInPandas(run, "vec_id long, decay double, x double, y double, z double")


@query("""WITH w AS (SELECT vec_id, list_transform(embedding[1:64], lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) >= 64),
    t AS (SELECT vec_id, x, list_position(x, list_min(x)) AS t, list_min(x) AS low FROM w),
    p AS (SELECT vec_id, low, coalesce(list_max(list_append(x[1:t - 1], 0)), 0) AS before, list_max(list_append(x[t:64], 0)) AS after, len(list_filter(x, lambda v: v < low / 2)) / 30000.0 * 1000 AS width FROM t)
    SELECT vec_id, -low > greatest(before, after) AND before < -0.5 * low AND width > 0.05 AS somatic FROM p""")
def somatic_waveforms(spark: SparkSession, sf: str) -> DataFrame:
    def run(batches):
        import pandas as pd

        for p in batches:
            yield pd.DataFrame({"vec_id": p["vec_id"], "somatic": [P.somatic(np.asarray(x, float), 30000.0) for x in p["x"]]})

    return _curves(spark, sf, 64).mapInPandas(run, "vec_id long, somatic boolean")


@query("""WITH l AS (SELECT i AS p, i / 34.0::DOUBLE AS x, i * 21 / 34.0::DOUBLE - floor(i * 21 / 34.0::DOUBLE) AS y FROM range(34) r(i)),
    c AS (SELECT i AS c, i / 16.0::DOUBLE AS x, i * 5 / 16.0::DOUBLE - floor(i * 5 / 16.0::DOUBLE) AS y FROM range(16) r(i)),
    a AS (SELECT p, c, 0.1 + 0.8 * exp(-(((l.x - c.x) - round_even(l.x - c.x, 0)) ** 2 + ((l.y - c.y) - round_even(l.y - c.y, 0)) ** 2) / 0.05) AS q FROM l, c),
    e AS (SELECT vec_id, k - 1 AS c, embedding[k] > 0 AS hit FROM embeddings, range(1, 17) r(k) WHERE len(embedding) >= 16),
    s AS (SELECT vec_id, p, sum(CASE WHEN hit THEN ln(q) ELSE ln(1 - q) END) AS ll FROM e JOIN a USING (c) GROUP BY ALL),
    w AS (SELECT vec_id, p, exp(ll - max(ll) OVER (PARTITION BY vec_id)) AS w FROM s),
    m AS (SELECT vec_id, sum(w) AS w, sum(w * sin(2 * pi() * x)) AS sx, sum(w * cos(2 * pi() * x)) AS cx, sum(w * sin(2 * pi() * y)) AS sy, sum(w * cos(2 * pi() * y)) AS cy FROM w JOIN l USING (p) GROUP BY vec_id),
    o AS (SELECT vec_id, CASE WHEN sqrt(sx * sx + cx * cx) >= 1e-9 * w THEN atan2(sx, cx) / (2 * pi()) END AS u, CASE WHEN sqrt(sy * sy + cy * cy) >= 1e-9 * w THEN atan2(sy, cy) / (2 * pi()) END AS v FROM m)
    SELECT vec_id, round(u - floor(u), 6) AS u, round(v - floor(v), 6) AS v FROM o""")
def lattice_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Positions on the unit torus from posteriors over a lattice whose patterns are smooth bumps."""
    lattice = np.mod(N.fibonacci_lattice(9), 1)
    centre = np.mod(N.korobov(5, 2, 16), 1)
    gap = lattice[:, None, :] - centre[None, :, :]
    gap -= np.rint(gap)
    atlas = 0.1 + 0.8 * np.exp(-((gap**2).sum(axis=2)) / 0.05)

    def run(batches):
        import pandas as pd

        for p in batches:
            e = P.lattice_embedding(P.lattice_posterior(atlas, (K.N_rows(p["x"]) > 0).astype(float)), lattice)
            yield pd.DataFrame({"vec_id": p["vec_id"], "u": e[:, 0], "v": e[:, 1]})

    return _curves(spark, sf, 16).mapInPandas(run, "vec_id long, u double, v double").select("vec_id", *[r6(F.when(~F.isnan(c), F.col(c))).alias(c) for c in "uv"])


@query()
def mixture_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Of the best of three fits a sex: modes, boundaries between components, and quantiles, in seconds."""
    from sonolith.plans.kernels import _logs

    def work(p):
        x, n = np.asarray(p["x"].iloc[0], float), np.asarray(p["n"].iloc[0], float)
        m = min((X.fit(x, k, 1, False, 2, count=n) for k in (1, 2, 3)), key=lambda f: X.bic(f, int(n.sum())))
        out = [("mode", i, math.exp(v)) for i, v in enumerate(P.modes(m.weight, m.mean, np.sqrt(m.var)))]
        out += [("boundary", i, b) for i in range(m.k - 1) if (b := m.boundary(i)) is not None]
        return out + [("quantile", int(q * 100), m.quantile(q)) for q in (0.05, 0.5, 0.95)]

    return K.per_group(K.binned_logs(_logs(spark, sf), "sex", "log_interval"), ["sex"], work, "what string, place int, seconds double")


@query(FRAMES + """, p AS (SELECT session_id, distance / 10 AS x, yaw / 30 AS y, speed > 40 AS own FROM frames),
    b AS (SELECT session_id, x, y, 'own' AS part FROM p WHERE own UNION ALL SELECT session_id, x, y, 'base' FROM p),
    v AS (SELECT session_id, part, count(*) AS n, var_samp(x) * count(*) ** (-1 / 3.0) AS xx, covar_samp(x, y) * count(*) ** (-1 / 3.0) AS xy, var_samp(y) * count(*) ** (-1 / 3.0) AS yy FROM b GROUP BY ALL),
    q AS (SELECT 1 + 1.6 * i AS qx, -5 + 2.0 * j AS qy FROM range(6) s(i), range(6) t(j)),
    d AS (SELECT session_id, part, qx, qy, sum(exp(-0.5 * (yy * (qx - x) ** 2 - 2 * xy * (qx - x) * (qy - y) + xx * (qy - y) ** 2) / (xx * yy - xy * xy))) / (any_value(n) * 2 * pi() * sqrt(any_value(xx * yy - xy * xy))) AS f FROM b JOIN v USING (session_id, part), q GROUP BY ALL)
    SELECT session_id, CAST(round(qx * 10, 6) AS DOUBLE) AS distance, CAST(round(qy * 30, 6) AS DOUBLE) AS angle, CASE WHEN max(f) FILTER (part = 'base') > 1e-6 THEN round(max(f) FILTER (part = 'own') / max(f) FILTER (part = 'base'), 6) END AS ratio FROM d GROUP BY session_id, qx, qy""")
def polar_density(spark: SparkSession, sf: str) -> DataFrame:
    """Density of events over that of all frames, by distance and angle."""
    f = A.frames(spark, sf)

    def work(p):
        xy = p[["distance", "yaw"]].to_numpy(float) / np.array([10.0, 30.0])
        q = np.array([(a, b) for a in np.linspace(1, 9, 6) for b in np.linspace(-5, 5, 6)])
        own = xy[p["speed"].to_numpy() > 40]
        d, base = N.kde(own, q), N.kde(xy, q)
        return [(float(a * 10), float(b * 30), float(v / w) if w > 1e-6 else None) for (a, b), v, w in zip(q, d, base, strict=True)]

    d = K.per_group(f, ["session_id"], work, "distance double, angle double, ratio double")
    return d.select("session_id", *[r6(c).alias(c) for c in ("distance", "angle", "ratio")])


@query()
def paired_fold_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Margins of models over their nulls in paired folds, resampled."""
    from sonolith.plans.kernels import univariate_models

    folds = univariate_models(spark, sf).groupBy("feature", "fold").agg(F.sum(F.when(F.col("null"), F.col("log_loss"))).alias("n"), F.sum(F.when(~F.col("null"), F.col("log_loss"))).alias("a"))

    def work(p):
        p = p.sort_values("fold")
        return [L.paired_margin(p["n"].to_numpy(), p["a"].to_numpy(), 1000, 1)]

    return K.per_group(folds, ["feature"], work, "margin double, low double, high double, p double")


@query(POINTS + """, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM points GROUP BY label), d AS (SELECT vec_id, label, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 9) AS d FROM points JOIN c USING (label))
    SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS INTEGER) AS place FROM d QUALIFY place <= 5""")
def nearest_to_centre(spark: SparkSession, sf: str) -> DataFrame:
    """Five examples of each category, those nearest to its centre."""
    p = A.points(spark, sf)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = F.round(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2), 9)
    w = Window.partitionBy("label").orderBy("d", "vec_id")
    return p.join(c, "label").withColumn("d", d).withColumn("place", F.row_number().over(w)).where("place <= 5").select("vec_id", "label", "place")


@query("SELECT vec_id, round(CAST(floor(embedding[1]::DOUBLE * 32767) AS DOUBLE) / 32768, 9) AS scaled, CAST(floor((greatest(least(embedding[2]::DOUBLE, 0.999), -1) + 1) * 8) AS INTEGER) AS cell FROM embeddings")
def scaled_samples(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding")
    return A.table(spark, sf, "embeddings").select("vec_id", F.round(F.floor(x[0].cast("double") * 32767).cast("double") / 32768, 9).alias("scaled"), F.floor((S.clip(x[1].cast("double"), -1.0, 0.999) + 1) * 8).cast("int").alias("cell"))


@query(CALLS + """, e AS (SELECT unnest([struct_pack(modality := 'start', flag := start > 40000), struct_pack(modality := 'duration', flag := duration > 50), struct_pack(modality := 'male', flag := sex = 'male')]) AS m FROM calls)
    SELECT m.modality AS modality, count(*) AS n_tested, count(*) FILTER (m.flag) AS n_flagged FROM e GROUP BY ALL""")
def records_per_modality(spark: SparkSession, sf: str) -> DataFrame:
    """Every tested modality gives a record, with its flag."""
    m = F.array(*[F.struct(F.lit(n).alias("modality"), c.alias("flag")) for n, c in (("start", F.col("start") > 40000), ("duration", F.col("duration") > 50), ("male", F.col("sex") == "male"))])
    e = A.calls(spark, sf).select(F.inline(m))
    return e.groupBy("modality").agg(F.count(F.lit(1)).alias("n_tested"), F.count_if("flag").alias("n_flagged"))
