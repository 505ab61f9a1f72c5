"""Queries behind summary figures: assignment, participation, rates by stage, histograms, trends, regressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.functions import scalars as S
from sonolith.operators import intervals as I
from sonolith.operators import relational as R
from sonolith.plans.registry import ORACLES, query

EV, CALLS, FRAMES, POINTS, TRIAGE = (A.with_sql(x) for x in ("events_m", "calls", "frames", "points", "triage"))


def r6(x, n: int = 6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


_STAGE = "CASE day(session_id) % 4 WHEN 0 THEN 'proestrus' WHEN 1 THEN 'estrus' WHEN 2 THEN 'metestrus' ELSE 'diestrus' END"


def _stage():
    k = F.dayofmonth("session_id") % 4
    return F.when(k == 0, "proestrus").when(k == 1, "estrus").when(k == 2, "metestrus").otherwise("diestrus")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.calls(spark, sf).groupBy("session_id").agg(*[F.count_if(F.col("sex") == s).alias(s) for s in ("male", "female", "unassigned")])


_C = CALLS + ", c AS (SELECT session_id, count(*) FILTER (sex = 'male') AS male, count(*) FILTER (sex = 'female') AS female, count(*) FILTER (sex = 'unassigned') AS unassigned FROM calls GROUP BY session_id)"


@query(_C + " SELECT session_id, male + female + unassigned AS total, round(male / (male + female + unassigned)::DOUBLE, 6) AS p_male, round(female / (male + female + unassigned)::DOUBLE, 6) AS p_female, CAST(row_number() OVER (ORDER BY male + female + unassigned DESC, session_id) AS INTEGER) AS place FROM c")
def assignment_bars(spark: SparkSession, sf: str) -> DataFrame:
    c = _counts(spark, sf).withColumn("total", F.col("male") + F.col("female") + F.col("unassigned"))
    return c.select("session_id", "total", r6(S.ratio(F.col("male"), F.col("total"))).alias("p_male"), r6(S.ratio(F.col("female"), F.col("total"))).alias("p_female"), F.row_number().over(Window.orderBy(F.desc("total"), "session_id")).alias("place"))  # a row a session


@query(_C + """, u AS (SELECT unnest(['male', 'female', 'unassigned']) AS category, unnest([male, female, unassigned]) AS n FROM c)
    SELECT category, CAST(sum(n) AS BIGINT) AS total, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS q2, round(quantile_cont(n, 0.75) - quantile_cont(n, 0.25), 6) AS iqr, round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM u GROUP BY category""")
def assignment_panel(spark: SparkSession, sf: str) -> DataFrame:
    u = _counts(spark, sf).unpivot(["session_id"], ["male", "female", "unassigned"], "category", "n")
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = u.groupBy("category").agg(F.sum("n").alias("total"), q.alias("q"))
    all_ = g.agg(F.sum("total").alias("a"))
    return g.join(F.broadcast(all_)).select("category", "total", r6(F.col("q")[0]).alias("q1"), r6(F.col("q")[1]).alias("q2"), r6(F.col("q")[2] - F.col("q")[0]).alias("iqr"), r6(F.col("total") / F.col("a")).alias("share"))  # one row


@query(CALLS + """, a AS (SELECT user_id, count(*) AS n, count(DISTINCT session_id) FILTER (category = 'signup') AS s FROM calls GROUP BY user_id) SELECT user_id, n, s AS n_sessions, round(CASE WHEN s = 0 THEN 0 ELSE n / s::DOUBLE END, 6) AS rate FROM a""")
def participation(spark: SparkSession, sf: str) -> DataFrame:
    a = A.calls(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("category") == "signup", F.col("session_id"))).alias("n_sessions"))
    return a.withColumn("rate", r6(F.coalesce(S.ratio(F.col("n"), F.col("n_sessions")), F.lit(0.0))))


@query(CALLS + ", h AS (SELECT session_id, sex, CAST(floor(start / 3600) AS BIGINT) AS hour, count(*) AS n FROM calls GROUP BY ALL) SELECT sex, round(corr(hour, n), 6) AS r, round(regr_slope(n, hour), 6) AS slope, count(*) AS n FROM h GROUP BY sex")
def hourly_regressions(spark: SparkSession, sf: str) -> DataFrame:
    h = A.calls(spark, sf).groupBy("session_id", "sex", F.floor(F.col("start") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("sex").agg(r6(F.corr("hour", "n")).alias("r"), r6(F.regr_slope("n", "hour")).alias("slope"), F.count(F.lit(1)).alias("n"))


# two-sided p of Student's t with n - 2 degrees by Simpson's rule over its angle
@query("WITH h AS (" + ORACLES["hourly_regressions"] + """), t AS (SELECT sex, r, n - 2 AS nu, atan(abs(r) * sqrt(1 / (1 - r * r))) AS top FROM h),
    s AS (SELECT sex, any_value(r) AS r, any_value(nu) AS nu, any_value(top) / 6000 * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(top * i / 2000), nu - 1)) AS area FROM t, range(2001) k(i) GROUP BY sex)
    SELECT sex, r, round(1 - 2 * exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(pi()) * area, 6) AS p FROM s""")
def hourly_regression_p(spark: SparkSession, sf: str) -> DataFrame:
    """The same correlations with their p values, by Student's distribution on the few rows of the result."""
    from sonolith.functions.numeric import correlation_p
    from sonolith.operators.kernels import per_group

    return per_group(hourly_regressions(spark, sf), ["sex"], lambda p: [(float(p["r"].iloc[0]), correlation_p(float(p["r"].iloc[0]), int(p["n"].iloc[0])))], "r double, p double").withColumn("p", r6("p"))


@query(CALLS + """, m AS (SELECT session_id, median(duration) AS mid, count(*) FILTER (sex = 'unassigned') / count(*)::DOUBLE AS share FROM calls GROUP BY session_id HAVING count(*) >= 2)
    SELECT count(*) AS n, round(corr(mid, share), 6) AS r FROM m""")
def unassigned_against_distance(spark: SparkSession, sf: str) -> DataFrame:
    m = A.calls(spark, sf).groupBy("session_id").agg(F.median("duration").alias("mid"), (F.count_if(F.col("sex") == "unassigned") / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    return m.agg(F.count(F.lit(1)).alias("n"), r6(F.corr("mid", "share")).alias("r"))


@query(CALLS + " SELECT sex, CAST(floor(duration / 10) AS BIGINT) AS bin, count(*) AS n FROM calls WHERE duration <= 300 GROUP BY ALL")
def duration_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return A.calls(spark, sf).where("duration <= 300").groupBy("sex", F.floor(F.col("duration") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(CALLS + " SELECT sex, round(avg(duration), 6) AS mean_s, round(median(duration), 6) AS median_s, count(*) AS n FROM calls GROUP BY sex")
def duration_by_sex(spark: SparkSession, sf: str) -> DataFrame:
    return A.calls(spark, sf).groupBy("sex").agg(r6(F.avg("duration")).alias("mean_s"), r6(F.median("duration")).alias("median_s"), F.count(F.lit(1)).alias("n"))




@query(CALLS + """, c AS (SELECT session_id, sex, category, CAST(floor(start / 7200) AS BIGINT) AS bin, count(*) AS n FROM calls WHERE sex <> 'unassigned' AND start < 72000 GROUP BY ALL), m AS (SELECT category, bin, avg(n) AS v FROM c GROUP BY ALL),
    g AS (SELECT category, bin, coalesce(v, 0) AS v FROM (SELECT * FROM (SELECT DISTINCT category FROM m), (SELECT CAST(range AS BIGINT) AS bin FROM range(12))) LEFT JOIN m USING (category, bin))
    SELECT category, bin, round(v / max(v) OVER (PARTITION BY category), 6) AS v FROM g""")
def category_fatigue_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """Mean counts over sessions that have any, bins without any as 0, over the greatest of the row."""
    c = A.calls(spark, sf).where("sex <> 'unassigned' and start < 72000").groupBy("session_id", "sex", "category", F.floor(F.col("start") / 7200).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("category", "bin").agg(F.avg("n").alias("v"))
    g = R.dense_grid(m, [m.select("category"), spark.range(12).withColumnRenamed("id", "bin")], "v")
    return g.withColumn("v", r6(S.ratio(F.col("v"), F.max("v").over(Window.partitionBy("category")))))


@query(_C + f", s AS (SELECT {_STAGE} AS stage, greatest(male, 1) / greatest(female, 1)::DOUBLE AS ratio FROM c) SELECT stage, count(*) AS n, round(avg(ratio), 6) AS mean_ratio, round(coalesce(stddev_samp(ratio) / sqrt(count(*)), 0), 6) AS sem, round(pow(10, avg(log10(ratio))), 6) AS geo_mean FROM s GROUP BY stage")
def stage_ratios(spark: SparkSession, sf: str) -> DataFrame:
    s = _counts(spark, sf).select(_stage().alias("stage"), (F.greatest("male", F.lit(1)) / F.greatest("female", F.lit(1))).alias("ratio"))
    return s.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ratio")).alias("mean_ratio"), r6(F.coalesce(F.stddev_samp("ratio") / F.sqrt(F.count(F.lit(1))), F.lit(0.0))).alias("sem"), r6(F.pow(F.lit(10.0), F.avg(F.log10("ratio")))).alias("geo_mean"))


@query(_C + f", s AS (SELECT {_STAGE} AS stage, male, female FROM c) SELECT stage, count(*) AS n_sessions, round(sum(male) / count(*)::DOUBLE, 6) AS male_rate, round(sum(female) / count(*)::DOUBLE, 6) AS female_rate, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM s GROUP BY stage")
def stage_rates(spark: SparkSession, sf: str) -> DataFrame:
    s = _counts(spark, sf).withColumn("stage", _stage())
    g = s.groupBy("stage").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("male").alias("m"), F.sum("female").alias("f"))
    return g.join(F.broadcast(g.agg(F.sum("n_sessions").alias("t")))).select("stage", "n_sessions", r6(S.ratio(F.col("m"), F.col("n_sessions"))).alias("male_rate"), r6(S.ratio(F.col("f"), F.col("n_sessions"))).alias("female_rate"), r6(S.ratio(F.col("n_sessions"), F.col("t"))).alias("share"))  # one row


@query(CALLS + f", s AS (SELECT category, {_STAGE} AS stage, session_id, sex FROM calls) SELECT category, stage, count(DISTINCT session_id) AS n_sessions, round(count(*) FILTER (sex = 'male') / count(DISTINCT session_id)::DOUBLE, 6) AS male_rate, round(count(*) FILTER (sex = 'female') / count(DISTINCT session_id)::DOUBLE, 6) AS female_rate FROM s GROUP BY ALL")
def category_stage_rates(spark: SparkSession, sf: str) -> DataFrame:
    per = A.calls(spark, sf).groupBy("category", _stage().alias("stage"), "session_id").agg(F.count_if(F.col("sex") == "male").alias("m"), F.count_if(F.col("sex") == "female").alias("f"))
    return per.groupBy("category", "stage").agg(F.count(F.lit(1)).alias("n_sessions"), r6(F.avg("m")).alias("male_rate"), r6(F.avg("f")).alias("female_rate"))


@query(CALLS + f""", s AS (SELECT category, {_STAGE} AS stage, session_id, greatest(count(*) FILTER (sex = 'male'), 1) / greatest(count(*) FILTER (sex = 'female'), 1)::DOUBLE AS ratio FROM calls GROUP BY ALL)
    SELECT category, stage, round(avg(ratio), 6) AS mean_ratio, round(pow(10, avg(log10(ratio))), 6) AS geo_mean, round(coalesce(stddev_samp(log10(ratio)) / sqrt(count(*)), 0), 6) AS log_sem FROM s GROUP BY category, stage""")
def category_stage_ratios(spark: SparkSession, sf: str) -> DataFrame:
    s = A.calls(spark, sf).groupBy("category", _stage().alias("stage"), "session_id").agg((F.greatest(F.count_if(F.col("sex") == "male"), F.lit(1)) / F.greatest(F.count_if(F.col("sex") == "female"), F.lit(1))).alias("ratio"))
    lg = F.log10("ratio")
    return s.groupBy("category", "stage").agg(r6(F.avg("ratio")).alias("mean_ratio"), r6(F.pow(F.lit(10.0), F.avg(lg))).alias("geo_mean"), r6(F.coalesce(F.stddev_samp(lg) / F.sqrt(F.count(F.lit(1))), F.lit(0.0))).alias("log_sem"))


@query(CALLS + " SELECT category, sex, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sex)::DOUBLE, 6) AS share FROM calls GROUP BY category, sex")
def category_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    c = A.calls(spark, sf).groupBy("category", "sex").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", r6(S.ratio(F.col("n"), F.sum("n").over(Window.partitionBy("sex")))))


@query(CALLS + """, t AS (SELECT session_id, CASE CAST(day(session_id) % 3 AS INTEGER) WHEN 0 THEN 'male_female' WHEN 1 THEN 'female_female' ELSE 'lone_male' END AS kind, count(*) AS n FROM calls GROUP BY ALL)
    SELECT kind, count(*) AS n_sessions, round(avg(n), 6) AS mean_n, round(stddev_samp(n) / sqrt(count(*)), 6) AS sem FROM t GROUP BY kind""")
def counts_by_session_type(spark: SparkSession, sf: str) -> DataFrame:
    k = F.dayofmonth("session_id") % 3
    t = A.calls(spark, sf).groupBy("session_id", F.when(k == 0, "male_female").when(k == 1, "female_female").otherwise("lone_male").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    m = R.mean_sem(t, ["kind"], "n")
    return m.select("kind", F.col("n").alias("n_sessions"), r6("mean").alias("mean_n"), r6("sem").alias("sem"))


@query(FRAMES + """, u AS (SELECT session_id, unnest(['speed', 'yaw', 'distance']) AS feature, unnest([speed, yaw, distance]) AS v FROM frames) SELECT feature, CAST(floor(v / 10) AS BIGINT) AS bin, count(*) AS n FROM u GROUP BY ALL""")
def property_histograms(spark: SparkSession, sf: str) -> DataFrame:
    u = A.frames(spark, sf).unpivot(["session_id"], ["speed", "yaw", "distance"], "feature", "v")
    return u.groupBy("feature", F.floor(F.col("v") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(CALLS + " SELECT event_id, sex, round(start, 6) AS start, round(stop, 6) AS stop, CAST(row_number() OVER (ORDER BY start, event_id) AS INTEGER) AS place FROM calls WHERE session_id = DATE '2024-01-05' AND start >= 10000 AND start < 60000")
def session_timeline(spark: SparkSession, sf: str) -> DataFrame:
    e = A.calls(spark, sf).where("session_id = date'2024-01-05' and start >= 10000 and start < 60000")
    return e.select("event_id", "sex", r6("start").alias("start"), r6("stop").alias("stop"), F.row_number().over(Window.orderBy("start", "event_id")).alias("place"))  # a stretch of one session


@query(CALLS + """, a AS (SELECT session_id, event_id, duration, CAST(ntile(4) OVER (ORDER BY duration, event_id) AS INTEGER) AS q, sex FROM calls WHERE sex <> 'unassigned')
    SELECT q, sex, count(*) AS n, round(exp(avg(ln(duration))), 6) AS geo_mean, round(min(duration), 6) AS lo, round(max(duration), 6) AS hi FROM a GROUP BY ALL""")
def amplitude_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Events in four equal parts by amplitude, cut at exact ranks that are counted and not sorted in one task."""
    e = A.calls(spark, sf).where("sex <> 'unassigned'").select("event_id", "duration", "sex")
    n = e.count()
    sizes = [n // 4 + (i < n % 4) for i in range(4)]
    edges = [sum(sizes[: i + 1]) for i in range(4)]
    per = e.groupBy("duration").agg(F.count(F.lit(1)).alias("k"))
    parts = 16
    bounds = per.approxQuantile("duration", [i / parts for i in range(1, parts)], 0.01)
    at = F.when(F.col("duration").isNull(), parts).otherwise(F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col("duration"))))  # null comes last
    marked = e.withColumn("part", at)
    base = marked.groupBy("part").agg(F.count(F.lit(1)).alias("k")).withColumn("base", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("k")
    ranked = marked.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("duration", "event_id"))).join(F.broadcast(base), "part")  # 16 rows
    q = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda x: x < F.col("r") + F.col("base"))) + 1
    log = F.when(F.col("duration") == 0, -math.inf).otherwise(F.log("duration"))  # a single 0 makes the geometric mean 0
    return ranked.groupBy(q.alias("q"), "sex").agg(F.count(F.lit(1)).alias("n"), r6(F.exp(F.avg(log))).alias("geo_mean"), r6(F.min("duration")).alias("lo"), r6(F.max("duration")).alias("hi"))


@query(CALLS + """, g AS (SELECT session_id, category, count(*) AS n FROM calls GROUP BY ALL) SELECT category, count(*) AS n_sessions, round(avg(n), 6) AS mean_n, round(stddev_samp(n) / sqrt(count(*)), 6) AS sem, round(avg(n) - 2 * stddev_samp(n) / sqrt(count(*)), 6) AS low FROM g GROUP BY category""")
def mean_and_error(spark: SparkSession, sf: str) -> DataFrame:
    g = A.calls(spark, sf).groupBy("session_id", "category").agg(F.count(F.lit(1)).alias("n"))
    m = R.mean_sem(g, ["category"], "n")
    return m.select("category", F.col("n").alias("n_sessions"), r6("mean").alias("mean_n"), r6("sem").alias("sem"), r6(F.col("mean") - 2 * F.col("sem")).alias("low"))


@query(POINTS + """, s AS (SELECT label, CAST(least(floor(x / 0.5), 11) AS INTEGER) AS ix, CAST(least(floor(y / 0.5), 11) AS INTEGER) AS iy FROM points), n AS (SELECT ix, iy, label, count(*) AS n FROM s GROUP BY ALL),
    l AS (SELECT ix, iy, arg_max(label, struct_pack(n := n, l := -label)) AS cell_label FROM n GROUP BY ALL) SELECT cell_label, count(*) AS n_cells FROM l GROUP BY cell_label""")
def label_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a grid by the label that most of their points have."""
    s = A.points(spark, sf).select("label", *[F.least(F.floor(F.col(v) / 0.5), F.lit(11)).cast("int").alias(f"i{v}") for v in "xy"])
    n = s.groupBy("ix", "iy", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("ix", "iy").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("cell_label")).groupBy("cell_label").agg(F.count(F.lit(1)).alias("n_cells"))


@query(POINTS + """, s AS (SELECT vec_id, label, CAST(least(floor(x / 0.5), 11) AS INTEGER) AS ix, CAST(least(floor(y / 0.5), 11) AS INTEGER) AS iy FROM points), n AS (SELECT ix, iy, label, count(*) AS n FROM s GROUP BY ALL),
    l AS (SELECT ix, iy, arg_max(label, struct_pack(n := n, l := -label)) AS cell_label FROM n WHERE (ix + iy) % 3 <> 0 GROUP BY ALL) SELECT vec_id, cell_label FROM s LEFT JOIN l USING (ix, iy)""")
def labels_of_points(spark: SparkSession, sf: str) -> DataFrame:
    from sonolith.operators.manifold import grid_label

    p = A.points(spark, sf)
    s = p.select("label", *[F.least(F.floor(F.col(v) / 0.5), F.lit(11)).cast("int").alias(f"i{v}") for v in "xy"])
    n = s.groupBy("ix", "iy", "label").agg(F.count(F.lit(1)).alias("n"))
    grid = n.where((F.col("ix") + F.col("iy")) % 3 != 0).groupBy("ix", "iy").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("cell_label"))
    return grid_label(p.drop("label"), grid, 12, 6.0).select("vec_id", "cell_label")


@query("SELECT l_returnflag AS cluster, CAST(l_linenumber AS BIGINT) AS template, count(*) AS n FROM lineitem GROUP BY ALL")
def cluster_template_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("cluster"), F.col("l_linenumber").cast("long").alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT a.p_partkey AS unit, b.s_suppkey AS channel, abs(a.p_size * 4 - b.s_suppkey % 200) AS d FROM part a, supplier b)
    SELECT unit, channel, CAST(row_number() OVER (PARTITION BY unit ORDER BY d, channel) AS INTEGER) AS rank FROM d QUALIFY rank <= 5""")
def nearest_channels(spark: SparkSession, sf: str) -> DataFrame:
    """The five channels that lie nearest to each unit: places of units meet the first five channels of each place of channels."""
    u = A.table(spark, sf, "part").select(F.col("p_partkey").alias("unit"), (F.col("p_size") * 4).alias("u"))
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("channel"), (F.col("s_suppkey") % 200).alias("c"))
    by_channel, by_distance = F.asc_nulls_last("channel"), F.asc_nulls_last("d")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(by_channel))).where("rank <= 5").drop("rank")
    # five rows a place, of which a modulus leaves 400 at most; places of units are few as well, as sizes are
    near = u.select("u").distinct().join(F.broadcast(s)).withColumn("d", F.abs(F.col("u") - F.col("c")))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(by_distance, by_channel))).where("rank <= 5").drop("rank", "c").withColumnRenamed("u", "at")
    each = u.join(F.broadcast(near), F.col("u").eqNullSafe(F.col("at"))).withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(by_distance, by_channel)))
    return each.where("rank <= 5").select("unit", "channel", "rank")


@query("SELECT n_regionkey AS shank, array_to_string(list(n_nationkey ORDER BY n_nationkey % 7, n_nationkey), ',') AS channels FROM nation GROUP BY n_regionkey")
def channel_order_per_shank(spark: SparkSession, sf: str) -> DataFrame:
    n = A.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("shank")).agg(F.sort_array(F.collect_list(F.struct((F.col("n_nationkey") % 7).alias("d"), F.col("n_nationkey").alias("k")))).alias("x"))
    return n.select("shank", F.array_join(F.transform("x", lambda v: v["k"].cast("string")), ",").alias("channels"))


@query("WITH r AS (SELECT CASE WHEN n_nationkey % 11 = 0 THEN NULL ELSE n_regionkey END AS region, n_nationkey AS at FROM nation), f AS (SELECT *, CASE WHEN region IS DISTINCT FROM lag(region) OVER (ORDER BY \"at\") OR \"at\" = 0 THEN 1 ELSE 0 END AS n FROM r), g AS (SELECT *, sum(n) OVER (ORDER BY \"at\" ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT 0 AS probe, region, min(\"at\") AS run_from, max(\"at\") + 1 AS run_to FROM g GROUP BY region, k".replace(" AS at ", " AS \"at\" "))
def region_ranges(spark: SparkSession, sf: str) -> DataFrame:
    n = A.table(spark, sf, "nation").select(F.lit(0).alias("probe"), F.when(F.col("n_nationkey") % 11 != 0, F.col("n_regionkey")).alias("region"), F.col("n_nationkey").alias("at"))
    return I.run_lengths(n, "region", ("probe",), "at")


@query(EV + """, d AS (SELECT session_id, min(start) AS t0, max(stop) AS t1, round(quantile_cont(duration, 0.06), 9) AS lo, round(quantile_cont(duration, 0.94), 9) AS hi FROM events_m GROUP BY session_id)
    SELECT session_id, count(*) AS n, round(sum(duration), 4) AS total FROM events_m JOIN d USING (session_id) WHERE duration > lo AND duration < hi GROUP BY session_id""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Events between the 6th and 94th percentile of their session's durations."""
    e = A.events(spark, sf)
    p = F.percentile("duration", F.array(F.lit(0.06), F.lit(0.94)))
    d = e.groupBy("session_id").agg(p.alias("p")).select("session_id", F.round(F.col("p")[0], 9).alias("lo"), F.round(F.col("p")[1], 9).alias("hi"))
    return e.join(d, "session_id").where("duration > lo and duration < hi").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 4).alias("total"))


@query(CALLS + """, m AS (SELECT session_id, sex, count(*) AS n FROM calls WHERE sex <> 'unassigned' GROUP BY ALL) SELECT session_id, arg_max(sex, struct_pack(n := n, m := sex = 'male')) AS self_side FROM m GROUP BY session_id""")
def self_side(spark: SparkSession, sf: str) -> DataFrame:
    """The sex with most events of a session; male if tied."""
    m = A.calls(spark, sf).where("sex <> 'unassigned'").groupBy("session_id", "sex").agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy("session_id").agg(F.max_by("sex", F.struct("n", F.col("sex") == "male")).alias("self_side"))


@query("SELECT count(DISTINCT o_orderpriority) AS n_fps, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS single FROM orders")
def common_value_or_map(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders")
    return o.agg(F.count_distinct("o_orderpriority").alias("n_fps"), F.when(F.count_distinct("o_orderpriority") == 1, F.min("o_orderpriority")).alias("single"))


@query("WITH r AS (SELECT n_regionkey, n_name, 'a' AS version, n_nationkey % 2 AS run FROM nation) SELECT n_regionkey, count(*) AS n, count(DISTINCT version) = 1 AS consistent FROM r GROUP BY n_regionkey")
def consolidated_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts merge if their provenance is equal but for ignored keys."""
    from sonolith.sources.tables import load_provenance

    n = A.table(spark, sf, "nation").withColumn("provenance", F.create_map(F.lit("version"), F.lit("a"), F.lit("run"), (F.col("n_nationkey") % 2).cast("string")))
    h = load_provenance(n, ["run"])
    return h.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("provenance_hash") == 1).alias("consistent"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) - CAST(list_position(embedding, list_min(embedding)) AS BIGINT) AS samples, round((list_position(embedding, list_max(embedding)) - list_position(embedding, list_min(embedding))) / 30000.0 * 1000, 9) AS duration_ms FROM embeddings")
def waveform_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Peak to trough of each waveform, signed."""
    d = F.array_position("embedding", F.array_max("embedding")) - F.array_position("embedding", F.array_min("embedding"))
    return A.table(spark, sf, "embeddings").select("vec_id", d.alias("samples"), F.round(d / F.lit(30000.0) * 1000, 9).alias("duration_ms"))


@query("""WITH c AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT label, k, max(v) - min(v) AS ptp FROM c GROUP BY ALL), n AS (SELECT *, ptp / max(ptp) OVER (PARTITION BY label) AS r FROM p)
    SELECT label, CAST(max(k) - min(k) AS INTEGER) AS spread FROM n WHERE r > 0.8 GROUP BY label""")
def waveform_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Range of channels whose peak-to-peak exceeds a share of the greatest."""
    c = A.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    p = c.groupBy("label", "k").agg((F.max("v") - F.min("v")).alias("ptp"))
    n = p.withColumn("r", F.col("ptp") / F.max("ptp").over(Window.partitionBy("label"))).where("r > 0.8")
    return n.groupBy("label").agg((F.max("k") - F.min("k")).alias("spread"))
