"""Queries for probes, synchronisation, playback, group comparison, positions with angles, and provenance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.functions import probes as P
from sonolith.operators import normalise as Z
from sonolith.plans.registry import query

CALLS, FRAMES, POINTS, EVENTS, TRIAGE = (A.with_sql(x) for x in ("calls", "frames", "points", "events_m", "triage"))


def r6(x, n: int = 6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


# probes


@query("SELECT p_partkey AS unit_id, p_size * 8 AS ap, p_size AS lf, 1 AS sync FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 7 = 0")
def channel_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of channels out of a text; every seventh is broken."""
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), F.when(F.col("p_partkey") % 7 == 0, F.lit("384,x")).otherwise(F.concat_ws(",", F.col("p_size") * 8, "p_size", F.lit(1))).alias("t"))
    c = P.channel_triple(F.col("t"))
    return p.select("unit_id", c["ap"].alias("ap"), c["lf"].alias("lf"), c["sync"].alias("sync"))


@query("SELECT p_partkey AS unit_id, CAST(k AS INTEGER) AS channel, CAST(p_size AS INTEGER) AS ap_gain, CAST(k * 2 AS INTEGER) AS lf_gain FROM part, range(1, 4) r(k)")
def imro_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Channel and gains of each entry of a probe's table."""
    entry = [F.concat(F.lit(f"({k} 0 1 "), F.col("p_size").cast("string"), F.lit(f" {2 * k} 1)")) for k in (1, 2, 3)]
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), F.explode(P.imro_entries(F.concat(F.lit("(24,3)"), *entry))).alias("e"))
    return p.select("unit_id", F.get("e", F.lit(0)).alias("channel"), F.get("e", F.lit(3)).alias("ap_gain"), F.get("e", F.lit(4)).alias("lf_gain"))


@query("""SELECT p_partkey AS unit_id, CAST(CASE WHEN p_size > 25 THEN p_size * 3 ELSE p_partkey % 4 * 250 + p_partkey % 2 * 32 END AS DOUBLE) AS x, CAST(CASE WHEN p_size > 25 THEN p_partkey % 100 ELSE p_size * 15 END AS DOUBLE) AS y, p_partkey % 11 <> 0 AS connected FROM part""")
def probe_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts by the newer or the older map; bad channels are not connected."""
    p = A.table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = P.contact_position(F.when(size > 25, "geom").otherwise("shank"), (size * 3, k % 100), (k % 4, k % 2, size))
    return p.select(k.alias("unit_id"), x.cast("double").alias("x"), y.cast("double").alias("y"), (k % 11 != 0).alias("connected"))


@query("SELECT p_partkey AS unit_id, CASE WHEN p_partkey % 5 <> 0 THEN round(0.6 / 512 / (p_partkey % 5 * 100) * 1e9, 6) END AS nanovolts FROM part")
def volts_per_sample(spark: SparkSession, sf: str) -> DataFrame:
    v = P.volts_per_sample(F.lit(0.6), F.lit(512.0), (F.col("p_partkey") % 5 * 100).cast("double"))
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), r6(v * 1e9).alias("nanovolts"))


@query(FRAMES + " SELECT session_id, frame_index, space_y - 5739 AS ml, 5400 - space_x AS ap, 332 - distance AS dv FROM frames")
def ccf_positions(spark: SparkSession, sf: str) -> DataFrame:
    ml, ap, dv = P.ccf_to_mlapdv(F.col("space_x"), F.col("distance"), F.col("space_y"), (5400, 332, 5739))
    return A.frames(spark, sf).select("session_id", "frame_index", ml.alias("ml"), ap.alias("ap"), dv.alias("dv"))


@query("""WITH m AS (SELECT s_suppkey AS local, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS raw, s_nationkey AS shank FROM supplier)
    SELECT l_orderkey AS spike, l_linenumber AS line, raw AS channel FROM lineitem JOIN m ON local = l_suppkey""")
def raw_channel_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Channel numbers as they are in the raw file; the map has a row a channel."""
    s = A.table(spark, sf, "supplier")
    m = s.select(F.col("s_suppkey").alias("l_suppkey"), (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("long").alias("channel"))
    return A.table(spark, sf, "lineitem").join(m, "l_suppkey").select(F.col("l_orderkey").alias("spike"), F.col("l_linenumber").alias("line"), "channel")


@query("SELECT row_number() OVER (ORDER BY 'channel_' || s_suppkey) - 1 AS place, 'channel_' || s_suppkey AS name, s_nationkey AS shank FROM supplier")
def unified_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Channels of all shanks in one list, in order of name; one task orders a probe's channels."""
    s = A.table(spark, sf, "supplier").select(F.concat(F.lit("channel_"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_nationkey").alias("shank"))
    return s.withColumn("place", (F.row_number().over(Window.orderBy("name")) - 1).cast("long"))


# synchronisation


@query(FRAMES + """, e AS (SELECT session_id, frame_index, speed > 30 AS v, lag(speed) OVER (PARTITION BY session_id ORDER BY frame_index) > 30 AS p FROM frames)
    SELECT session_id, count(*) FILTER (v AND NOT p) AS n_on, count(*) FILTER (NOT v AND p) AS n_off, min(frame_index) FILTER (v AND NOT p) AS first_on, max(frame_index) FILTER (NOT v AND p) AS last_off FROM e GROUP BY session_id""")
def video_sync_trains(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of a brightness over its threshold."""
    f = A.frames(spark, sf)
    e = f.withColumn("edge", P.pulse_edges(F.col("speed"), F.lag("speed").over(Window.partitionBy("session_id").orderBy("frame_index")), 30.0))
    at = lambda v: F.when(F.col("edge") == v, F.col("frame_index"))
    return e.groupBy("session_id").agg(F.count(at(1)).alias("n_on"), F.count(at(-1)).alias("n_off"), F.min(at(1)).alias("first_on"), F.max(at(-1)).alias("last_off"))


@query(FRAMES + """, e AS (SELECT session_id, frame_index, speed > 30 AS v, lag(speed) OVER (PARTITION BY session_id ORDER BY frame_index) > 30 AS p, distance > 50 AS a, lag(distance) OVER (PARTITION BY session_id ORDER BY frame_index) > 50 AS q FROM frames),
    x AS (SELECT session_id, frame_index - lag(frame_index) OVER (PARTITION BY session_id ORDER BY frame_index) AS i, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) AS k FROM e WHERE v AND NOT p),
    y AS (SELECT session_id, frame_index - lag(frame_index) OVER (PARTITION BY session_id ORDER BY frame_index) AS i, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) AS k FROM e WHERE a AND NOT q)
    SELECT session_id, count(*) AS n, count(*) FILTER (abs(x.i - y.i) <= 1) AS n_matched, round(avg(abs(x.i - y.i)), 6) AS mean_off FROM x JOIN y USING (session_id, k) WHERE x.i IS NOT NULL GROUP BY session_id""")
def audio_sync_trains(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals between pulses of two recordings, pulse by pulse, and how many agree to one frame."""
    w = Window.partitionBy("session_id").orderBy("frame_index")
    f = A.frames(spark, sf)

    def intervals(column: str, threshold: float, name: str) -> DataFrame:
        on = f.withColumn("edge", P.pulse_edges(F.col(column), F.lag(column).over(w), threshold)).where("edge = 1")
        return on.select("session_id", F.row_number().over(w).alias("k"), (F.col("frame_index") - F.lag("frame_index").over(w)).alias(name))

    both = intervals("speed", 30.0, "x").join(intervals("distance", 50.0, "y"), ["session_id", "k"]).where("x is not null").withColumn("off", F.abs(F.col("x") - F.col("y")))
    return both.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("off") <= 1).alias("n_matched"), r6(F.avg("off")).alias("mean_off"))


@query(FRAMES + """, s AS (SELECT session_id, count(*) AS n, max(frame_index) - min(frame_index) + 1 AS span FROM frames GROUP BY session_id)
    SELECT session_id, n, span, abs(span - n) <= 2 AS valid, sum(span) OVER (ORDER BY session_id) - span AS changepoint FROM s""")
def sync_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Whether pulses cover their span, and where each session begins on the common clock; one row a session."""
    s = A.frames(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), (F.max("frame_index") - F.min("frame_index") + 1).alias("span"))
    before = F.sum("span").over(Window.orderBy("session_id")) - F.col("span")
    return s.select("session_id", "n", "span", (F.abs(F.col("span") - F.col("n")) <= 2).alias("valid"), before.cast("decimal(38,0)").cast("long").alias("changepoint"))


@query(FRAMES + """, e AS (SELECT session_id, frame_index, distance > 90 AS v, lag(distance) OVER (PARTITION BY session_id ORDER BY frame_index) > 90 AS p FROM frames)
    SELECT session_id, min(frame_index) FILTER (v AND NOT p) * 1600 AS first_sample, max(frame_index) FILTER (NOT v AND p) * 1600 AS last_sample FROM e GROUP BY session_id""")
def cropped_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of an audio file between the first rise and the last fall of the trigger; the file itself is cut elsewhere."""
    e = A.frames(spark, sf).withColumn("edge", P.pulse_edges(F.col("distance"), F.lag("distance").over(Window.partitionBy("session_id").orderBy("frame_index")), 90.0))
    at = lambda v: F.when(F.col("edge") == v, F.col("frame_index") * 1600)
    return e.groupBy("session_id").agg(F.min(at(1)).alias("first_sample"), F.max(at(-1)).alias("last_sample"))


# playback


@query(CALLS + """, c AS (SELECT event_id, duration, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM calls),
    d AS (SELECT i AS draw, ('0x' || substr(md5('9:' || i), 1, 8))::BIGINT AS h FROM range(500) r(i)),
    j AS (SELECT draw, event_id, duration FROM d JOIN c ON k = h % n)
    SELECT draw, event_id, round(sum(duration + 0.05) OVER (ORDER BY draw) - duration - 0.05, 6) AS onset FROM j""")
def playback_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Five hundred calls drawn with replacement, laid one behind the other with pauses; a fixed number of draws."""
    c = A.calls(spark, sf).select("event_id", "duration")
    total = c.count()
    numbered = c.withColumn("k", (F.row_number().over(Window.orderBy("event_id")) - 1).cast("long"))
    h = F.conv(F.substring(Z.seeded_hash(9, F.col("id")), 1, 8), 16, 10).cast("long") % F.lit(max(total, 1))
    d = spark.range(500).select(F.col("id").alias("draw"), h.alias("k"))
    onset = F.sum(F.col("duration") + 0.05).over(Window.orderBy("draw")) - F.col("duration") - 0.05
    return d.join(numbered, "k").select("draw", "event_id", r6(onset).alias("onset"))


@query(CALLS + """, b AS (SELECT session_id, sex, count(*) AS n, sum(duration) AS length FROM calls GROUP BY ALL),
    w AS (SELECT *, exp(-0.5 * ((n - 100) / 30.0) ** 2) AS weight, ('0x' || substr(md5('13:' || strftime(session_id, '%Y-%m-%d') || ':' || sex), 1, 8))::BIGINT AS h FROM b),
    o AS (SELECT *, sum(length + 30) OVER (ORDER BY round(-ln((h + 1) / 4294967297.0::DOUBLE) / weight, 6), session_id, sex) AS used FROM w WHERE weight > 1e-6)
    SELECT session_id, sex, n, round(used - length - 30, 4) AS onset FROM o WHERE used - 30 <= 40000""")
def naturalistic_playback(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts drawn without replacement, likelier the nearer their size is to a hundred calls, until the time is used up.

    The draw is by exponential keys, so it needs no state between bouts; one task sums the bouts' lengths.
    """
    b = A.calls(spark, sf).groupBy("session_id", "sex").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("length"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("13"), F.col("session_id").cast("string"), "sex")), 1, 8), 16, 10).cast("long")
    w = b.withColumn("weight", F.exp(F.lit(-0.5) * ((F.col("n") - 100) / F.lit(30.0)) ** 2)).where("weight > 1e-6")
    key = F.round(-F.log((h + 1) / F.lit(4294967297.0)) / F.col("weight"), 6)
    used = w.withColumn("used", F.sum(F.col("length") + 30).over(Window.orderBy(key, "session_id", "sex")))
    return used.where("used - 30 <= 40000").select("session_id", "sex", "n", r6(F.col("used") - F.col("length") - 30, 4).alias("onset"))


# comparisons and units


@query("""WITH v AS (SELECT l_returnflag AS metric, l_linestatus AS part, l_discount + l_tax AS x FROM lineitem),
    b AS (SELECT metric, avg(x) AS m FROM v WHERE part = 'O' GROUP BY metric)
    SELECT metric, round(any_value(m), 6) AS mean, round((any_value(m) - avg(x)) / stddev_pop(x), 6) AS z, round((count(*) FILTER (x >= m) + 1) / (count(*) + 1.0::DOUBLE), 6) AS p FROM v JOIN b USING (metric) WHERE part = 'F' GROUP BY metric""")
def bootstrap_against_null(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of a bootstrap against a null distribution: z, and p with + 1."""
    v = A.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("part"), (F.col("l_discount") + F.col("l_tax")).alias("x"))
    b = v.where("part = 'O'").groupBy("metric").agg(F.avg("x").alias("m"))
    j = v.where("part = 'F'").join(F.broadcast(b), "metric")  # a row a metric
    n = j.groupBy("metric").agg(F.first("m").alias("m"), F.avg("x").alias("a"), F.stddev_pop("x").alias("s"), F.count_if(F.col("x") >= F.col("m")).alias("k"), F.count(F.lit(1)).alias("n"))
    return n.select("metric", r6("m").alias("mean"), r6((F.col("m") - F.col("a")) / F.col("s")).alias("z"), r6((F.col("k") + 1) / (F.col("n") + F.lit(1.0))).alias("p"))


@query(EVENTS + """, g AS (SELECT session_id, sex AS grp, avg(duration) AS v, count(*) AS n FROM events_m WHERE sex <> 'unassigned' GROUP BY ALL)
    SELECT CAST(count(*) FILTER (grp = 'male') AS BIGINT) AS n_a, CAST(count(*) FILTER (grp = 'female') AS BIGINT) AS n_b, round(avg(v) FILTER (grp = 'male'), 6) AS mean_a, round(avg(v) FILTER (grp = 'female'), 6) AS mean_b,
           round(avg(v) FILTER (grp = 'male') - avg(v) FILTER (grp = 'female'), 6) AS delta FROM g""")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Two groups' session means side by side."""
    g = A.events(spark, sf).where("sex <> 'unassigned'").groupBy("session_id", "sex").agg(F.avg("duration").alias("v"))
    of = lambda s: F.when(F.col("sex") == s, F.col("v"))
    a, b = F.avg(of("male")), F.avg(of("female"))
    return g.agg(F.count(of("male")).alias("n_a"), F.count(of("female")).alias("n_b"), r6(a).alias("mean_a"), r6(b).alias("mean_b"), r6(a - b).alias("delta"))


@query(EVENTS + """, a AS (SELECT session_id, event_id, start, category FROM events_m WHERE category IN ('signup', 'purchase')), c AS (SELECT session_id, start, duration FROM events_m WHERE category IN ('view', 'click'))
    SELECT a.session_id, a.category AS "group", count(*) AS n, round(avg(c.duration), 6) AS mean_amplitude, round(max(c.duration), 6) AS top_amplitude FROM a JOIN c ON c.session_id = a.session_id AND c.start >= a.start AND c.start <= a.start + 600 GROUP BY ALL""")
def group_acoustics(spark: SparkSession, sf: str) -> DataFrame:
    """Sound in the ten minutes behind each group's onsets; both sides meet by stretches of time."""
    e = A.events(spark, sf)
    a = e.where("category in ('signup', 'purchase')").select("session_id", F.col("start").alias("t"), F.col("category").alias("group"))
    a = a.withColumn("k", F.explode(F.sequence(F.floor(F.col("t") / 600), F.floor((F.col("t") + 600) / 600))))
    c = e.where("category in ('view', 'click')").select("session_id", "start", "duration", F.floor(F.col("start") / 600).alias("k"))
    near = a.join(c, ["session_id", "k"]).where((F.col("start") >= F.col("t")) & (F.col("start") <= F.col("t") + 600))
    return near.groupBy("session_id", "group").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("duration")).alias("mean_amplitude"), r6(F.max("duration")).alias("top_amplitude"))


@query(TRIAGE + """, f AS (SELECT unit_id, condition, count(*) AS n, count(*) FILTER (p < 0.03) AS k FROM triage GROUP BY ALL), o AS (SELECT unit_id, k >= 2 AND k * 2 > n AS flag FROM f)
    SELECT unit_id, bool_or(flag) AS vocal FROM o GROUP BY unit_id""")
def vocal_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Units with a condition in which two results or more, and the majority, are significant."""
    f = A.triage(spark, sf).groupBy("unit_id", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") < 0.03).alias("k"))
    return f.groupBy("unit_id").agg(F.bool_or((F.col("k") >= 2) & (F.col("k") * 2 > F.col("n"))).alias("vocal"))


@query(A.with_sql("units", "triage") + " SELECT u.unit_name, u.area, u.depth, round(avg(t.vmi), 6) AS vmi FROM units u JOIN triage t USING (unit_id) WHERE u.area LIKE 'PROMO%' GROUP BY ALL")
def unit_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and mean modulation of the units of a region."""
    u = A.units(spark, sf).where(F.col("area").startswith("PROMO"))
    return u.join(A.triage(spark, sf), "unit_id").groupBy("unit_name", "area", "depth").agg(r6(F.avg("vmi")).alias("vmi"))


@query("SELECT event_type AS property, CASE event_type WHEN 'click' THEN 12 ELSE 30 END AS n_bins FROM events GROUP BY event_type")
def property_bin_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of each property: twelve for the one that is a count."""
    return A.table(spark, sf, "events").select(F.col("event_type").alias("property")).distinct().withColumn("n_bins", F.when(F.col("property") == "click", 12).otherwise(30))


@query("""WITH r AS (SELECT l_suppkey % 20 AS feature, CASE l_linestatus WHEN 'O' THEN 'actual' ELSE 'null' END AS strategy, CASE WHEN l_suppkey % 20 < 5 THEN NULL ELSE l_discount END AS vm, CASE WHEN l_suppkey % 20 < 2 THEN NULL ELSE l_tax END AS dcor, l_quantity / 50 AS r2 FROM lineitem),
    k AS (SELECT feature, CASE WHEN count(vm) > 0 THEN 'vm_logscore' WHEN count(dcor) > 0 THEN 'dcor_xy' ELSE 'r2_spatial' END AS metric FROM r WHERE strategy = 'actual' GROUP BY feature)
    SELECT feature, strategy, metric, round(avg(CASE metric WHEN 'vm_logscore' THEN vm WHEN 'dcor_xy' THEN dcor ELSE r2 END), 6) AS value FROM r JOIN k USING (feature) GROUP BY ALL""")
def univariate_headline(spark: SparkSession, sf: str) -> DataFrame:
    """Of each feature the first metric that has values, averaged over folds without NaN, by strategy."""
    nan, k = F.lit(float("nan")), F.col("l_suppkey") % 20
    r = A.table(spark, sf, "lineitem").select(
        k.alias("feature"), F.when(F.col("l_linestatus") == "O", "actual").otherwise("null").alias("strategy"),
        F.when(k < 5, nan).otherwise(F.col("l_discount")).alias("vm_logscore"), F.when(k < 2, nan).otherwise(F.col("l_tax")).alias("dcor_xy"), (F.col("l_quantity") / 50).alias("r2_spatial"),
    )
    names = ("vm_logscore", "dcor_xy", "r2_spatial")
    means = r.groupBy("feature", "strategy").agg(*[F.avg(F.nanvl(n, F.lit(None).cast("double"))).alias(n) for n in names])
    first = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names])
    chosen = means.where("strategy = 'actual'").select("feature", first.alias("metric"))
    value = F.when(F.col("metric") == "vm_logscore", F.col("vm_logscore")).when(F.col("metric") == "dcor_xy", F.col("dcor_xy")).otherwise(F.col("r2_spatial"))
    return means.join(chosen, "feature").select("feature", "strategy", "metric", r6(value).alias("value"))


@query(POINTS + """, e AS (SELECT label, x, y, abs(x - px) - 6 * CASE WHEN abs(x - px) > 3 THEN 1 ELSE 0 END AS dx, abs(y - py) - 6 * CASE WHEN abs(y - py) > 3 THEN 1 ELSE 0 END AS dy, px, py FROM points)
    SELECT label AS region, count(*) AS n, round(avg(sqrt(dx * dx + dy * dy)), 6) AS mae, round(sqrt(avg(dx * dx + dy * dy)), 6) AS rmse, round(corr(x, px), 6) AS r_x, round(corr(y, py), 6) AS r_y FROM e GROUP BY label HAVING count(*) >= 10""")
def regional_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of predicted positions on the torus and correlations, by region with ten events or more."""
    p = A.points(spark, sf)
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) - F.when(F.abs(F.col(a) - F.col(b)) > 3, 6.0).otherwise(0.0)
    d = p.withColumn("d", off("x", "px") ** 2 + off("y", "py") ** 2)
    m = d.groupBy(F.col("label").alias("region")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.sqrt("d"))).alias("mae"), r6(F.sqrt(F.avg("d"))).alias("rmse"), r6(F.corr("x", "px")).alias("r_x"), r6(F.corr("y", "py")).alias("r_y"))
    return m.where("n >= 10")


@query(POINTS + """, g AS (SELECT label, CAST(floor(x / 0.75) AS BIGINT) % 8 AS i, CAST(floor(y / 0.75) AS BIGINT) % 8 AS j, CAST(floor(px / 0.75) AS BIGINT) % 8 AS k, CAST(floor(py / 0.75) AS BIGINT) % 8 AS l FROM points),
    s AS (SELECT label, least(abs(i - k), 8 - abs(i - k)) AS a, least(abs(j - l), 8 - abs(j - l)) AS b FROM g)
    SELECT label, round(avg(0.75 * (greatest(a, b) - least(a, b) + sqrt(2) * least(a, b))), 6) AS mae FROM s GROUP BY label""")
def grid_geodesic_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean shortest way between the grid nodes of truth and prediction, on a torus grid of eight neighbours with even cost."""
    node = lambda c: F.pmod(F.floor(F.col(c) / 0.75).cast("long"), F.lit(8).cast("long"))
    p = A.points(spark, sf).select("label", *[node(c).alias(c) for c in ("x", "y", "px", "py")])
    gap = lambda a, b: F.least(F.abs(F.col(a) - F.col(b)), 8 - F.abs(F.col(a) - F.col(b)))
    a, b = gap("x", "px"), gap("y", "py")
    return p.groupBy("label").agg(r6(F.avg((F.greatest(a, b) - F.least(a, b) + F.lit(math.sqrt(2)) * F.least(a, b)) * 0.75)).alias("mae"))


# positions with angles


_RAW = "CAST(embedding[1] AS DOUBLE) AS mx, CAST(embedding[2] AS DOUBLE) AS my, exp(CAST(embedding[3] AS DOUBLE)) AS a, CAST(embedding[4] AS DOUBLE) AS b, exp(CAST(embedding[5] AS DOUBLE)) AS c"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and Cholesky factor of a position, as a network gives them."""
    e = A.table(spark, sf, "embeddings").where("size(embedding) >= 13")
    x = [F.col("embedding")[i].cast("double") for i in range(5)]
    return e.select("vec_id", x[0].alias("mx"), x[1].alias("my"), F.exp(x[2]).alias("a"), x[3].alias("b"), F.exp(x[4]).alias("c"), F.transform(F.slice("embedding", 6, 8), lambda v: F.exp(v.cast("double"))).alias("h"))


@query(f"WITH e AS (SELECT vec_id, {_RAW} FROM embeddings WHERE len(embedding) >= 13) SELECT vec_id, round(a * a, 6) AS xx, round(a * b, 6) AS xy, round(b * b + c * c, 6) AS yy, round(ln(a * a * c * c), 6) AS log_det FROM e")
def pair_covariances(spark: SparkSession, sf: str) -> DataFrame:
    """Covariances out of triangular factors with positive diagonals."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return _raw(spark, sf).select("vec_id", r6(a * a).alias("xx"), r6(a * b).alias("xy"), r6(b * b + c * c).alias("yy"), r6(F.log(a * a * c * c)).alias("log_det"))


_PMF = f"""WITH e AS (SELECT vec_id, {_RAW}, list_transform(embedding[6:13], lambda v: exp(CAST(v AS DOUBLE))) AS h FROM embeddings WHERE len(embedding) >= 13),
    g AS (SELECT -2 + 0.5 * i AS x, -2 + 0.5 * j AS y FROM range(9) s(i), range(9) t(j)),
    s AS (SELECT vec_id, x, y, k, exp(-0.5 * (((x - mx) / a) ** 2 + ((y - my - b * (x - mx) / a) / c) ** 2)) * h[k + 1] AS w FROM e, g, range(8) r(k)),
    p AS (SELECT vec_id, x, y, k, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM s)"""


def _pmf(spark: SparkSession, sf: str) -> DataFrame:
    """The probability of each cell of a grid of 9 x 9 places and 8 angles: a normal of the place times a histogram of the angle."""
    grid = spark.range(9 * 9 * 8).select((F.floor(F.col("id") / 72) * 0.5 - 2).alias("x"), (F.floor(F.col("id") / 8) % 9 * 0.5 - 2).alias("y"), (F.col("id") % 8).alias("k"))
    u = (F.col("x") - F.col("mx")) / F.col("a")
    v = (F.col("y") - F.col("my") - F.col("b") * u) / F.col("c")
    s = _raw(spark, sf).join(F.broadcast(grid)).withColumn("w", F.exp(F.lit(-0.5) * (u * u + v * v)) * F.get("h", F.col("k").cast("int")))  # 648 cells
    return s.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("vec_id"))).select("vec_id", "x", "y", "k", "p")


@query(_PMF + " SELECT vec_id, round(sum(p * x), 6) AS mean_x, round(sum(p * y), 6) AS mean_y, round(max(p), 9) AS top, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy FROM p GROUP BY vec_id")
def position_angle_masses(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    return _pmf(spark, sf).groupBy("vec_id").agg(r6(F.sum(p * F.col("x"))).alias("mean_x"), r6(F.sum(p * F.col("y"))).alias("mean_y"), r6(F.max(p), 9).alias("top"), r6(-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy"))


@query(_PMF + """, o AS (SELECT vec_id, x, y, k, p, sum(p) OVER (PARTITION BY vec_id ORDER BY round(p, 12) DESC, x, y, k) - p AS before FROM p)
    SELECT vec_id, count(*) AS n_cells, round(sum(p), 6) AS mass, CAST(count(DISTINCT k) AS BIGINT) AS n_angles FROM o WHERE round(before, 9) < 0.9 GROUP BY vec_id""")
def position_angle_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest cells that hold nine tenths of the probability."""
    w = Window.partitionBy("vec_id").orderBy(F.round("p", 12).desc(), "x", "y", "k").rowsBetween(Window.unboundedPreceding, 0)
    o = _pmf(spark, sf).withColumn("before", F.sum("p").over(w) - F.col("p")).where(F.round("before", 9) < 0.9)
    return o.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n_cells"), r6(F.sum("p")).alias("mass"), F.countDistinct("k").alias("n_angles"))


# records and provenance


@query("""WITH f AS (SELECT l_returnflag AS interval_type, l_linestatus AS sex, l_linenumber AS k, min(round(l_extendedprice / l_quantity, 6)) AS ic FROM lineitem GROUP BY ALL)
    SELECT interval_type, sex, arg_min(k, (ic, k)) AS k, min(ic) AS ic FROM f GROUP BY ALL""")
def best_fit_records(spark: SparkSession, sf: str) -> DataFrame:
    """Of stored fits the one with the least criterion, ties to fewer components."""
    f = A.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("interval_type"), F.col("l_linestatus").alias("sex"), F.col("l_linenumber").alias("k")).agg(F.min(r6(F.col("l_extendedprice") / F.col("l_quantity"))).alias("ic"))
    return f.groupBy("interval_type", "sex").agg(F.min(F.struct("ic", "k")).alias("b")).select("interval_type", "sex", F.col("b.k").alias("k"), F.col("b.ic").alias("ic"))


@query("""SELECT vec_id, CAST(i AS INTEGER) AS spec, CAST(f AS INTEGER) AS freq, CAST(t AS INTEGER) AS time FROM embeddings, range(4) a(i), range(4) b(f), range(4) c(t) WHERE len(embedding) >= 64 AND embedding[i * 16 + f * 4 + t + 1] > 0.2""")
def flattened_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that are on in each event's masks, as rows."""
    e = A.table(spark, sf, "embeddings").where("size(embedding) >= 64").select("vec_id", F.posexplode(F.slice("embedding", 1, 64)).alias("at", "v")).where("v > 0.2f")
    return e.select("vec_id", F.floor(F.col("at") / 16).cast("int").alias("spec"), (F.floor(F.col("at") / 4) % 4).cast("int").alias("freq"), (F.col("at") % 4).alias("time"))


@query("""WITH s AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step, o_totalprice AS score FROM orders)
    SELECT run, CAST(arg_max(step, (score, -step)) AS INTEGER) AS step, max(score) AS score, CAST(count(*) AS BIGINT) AS n_steps FROM s GROUP BY run""")
def selection_best_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The best step of each stepwise selection, the first of equals."""
    s = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).alias("step"), F.col("o_totalprice").alias("score"))
    b = s.groupBy("run").agg(F.max(F.struct("score", (-F.col("step")).alias("back"))).alias("b"), F.count(F.lit(1)).alias("n_steps"))
    return b.select("run", (-F.col("b.back")).cast("int").alias("step"), F.col("b.score").alias("score"), "n_steps")


@query("""WITH z AS (SELECT 'self.' || event_type AS feature FROM events UNION SELECT 'other.' || event_type FROM events UNION SELECT a.event_type || '-' || b.event_type FROM (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT event_type FROM events) b WHERE a.event_type < b.event_type)
    SELECT feature, CAST(d AS VARCHAR) AS derivative FROM z, (VALUES (''), ('1st'), ('2nd')) v(d) WHERE d = '' OR feature NOT LIKE '%.view'""")
def feature_zoo(spark: SparkSession, sf: str) -> DataFrame:
    """All feature names: of each animal, of the pair, and their derivatives where these mean something."""
    t = A.table(spark, sf, "events").select(F.col("event_type").alias("t")).distinct()
    own = t.select(F.explode(F.array(F.concat(F.lit("self."), "t"), F.concat(F.lit("other."), "t"))).alias("feature"))
    pair = t.join(F.broadcast(t.withColumnRenamed("t", "u")), F.col("t") < F.col("u")).select(F.concat_ws("-", "t", "u").alias("feature"))  # a row a feature
    z = own.unionByName(pair).withColumn("derivative", F.explode(F.array(*map(F.lit, ("", "1st", "2nd")))))
    return z.where((F.col("derivative") == "") | ~F.col("feature").endswith(".view"))


@query("""SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS session_id, CAST(row_number() OVER (ORDER BY md5('21:' || strftime(CAST(ts AS DATE), '%Y-%m-%d'))) - 1 AS INTEGER) AS place, CASE WHEN count(DISTINCT user_id % 3) >= 3 THEN 'courtship' ELSE 'other' END AS condition FROM events GROUP BY CAST(ts AS DATE)""")
def modelling_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The list of sessions in a seeded order, with the condition that their animals tell; one row a session."""
    e = A.table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("session_id")).agg(F.countDistinct(F.col("user_id") % 3).alias("k"))
    return e.select("session_id", (F.row_number().over(Window.orderBy(Z.seeded_hash(21, F.col("session_id")))) - 1).alias("place"), F.when(F.col("k") >= 3, "courtship").otherwise("other").alias("condition"))


@query(FRAMES + """, p AS (SELECT session_id, corr(speed, distance) AS sd, corr(speed, yaw) AS sy, corr(distance, yaw) AS dy FROM frames GROUP BY session_id),
    l AS (SELECT session_id, unnest(['speed-distance', 'speed-yaw', 'distance-yaw']) AS pair, unnest([sd, sy, dy]) AS r FROM p)
    SELECT session_id, pair, round(r, 6) AS r, round(1 / (1 - r * r), 6) AS inflation, CASE WHEN abs(r) >= 0.9 THEN 'exclude' WHEN abs(r) >= 0.5 THEN 'concern' ELSE 'fine' END AS tier FROM l""")
def predictor_audits(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation, inflation and tier of each pair of predictors, by session."""
    pairs = [("speed", "distance"), ("speed", "yaw"), ("distance", "yaw")]
    c = A.frames(spark, sf).groupBy("session_id").agg(*[F.corr(a, b).alias(f"{a}-{b}") for a, b in pairs])
    long = c.unpivot(["session_id"], [f"`{a}-{b}`" for a, b in pairs], "pair", "r")
    tier = F.when(F.abs("r") >= 0.9, "exclude").when(F.abs("r") >= 0.5, "concern").otherwise("fine")
    return long.select("session_id", "pair", r6("r").alias("r"), r6(1 / (1 - F.col("r") ** 2)).alias("inflation"), tier.alias("tier"))


@query("""WITH b AS (SELECT o_orderstatus AS block, count(*) AS n_files, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_settings FROM orders GROUP BY o_orderstatus)
    SELECT block, n_files, strftime(first_at, '%Y-%m-%d') AS first_day, strftime(last_at, '%Y-%m-%d') AS last_day, n_settings, md5(block || ':' || n_files || ':' || n_settings) AS digest FROM b""")
def provenance_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A record for each block of merged inputs: files, their first and last day, settings, and a digest of these."""
    b = A.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("block")).agg(F.count(F.lit(1)).alias("n_files"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"), F.countDistinct("o_orderpriority").alias("n_settings"))
    return b.select("block", "n_files", F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("z", "yyyy-MM-dd").alias("last_day"), "n_settings", F.md5(F.concat_ws(":", "block", "n_files", "n_settings")).alias("digest"))


# smoothing and speed that had functions only


@query(FRAMES + """, d AS (SELECT session_id, frame_index, sqrt((space_x - lag(space_x) OVER w) ** 2 + (space_y - lag(space_y) OVER w) ** 2) * 100 * 150 AS v FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame_index))
    SELECT session_id, count(v) AS n, round(avg(v), 4) AS mean_speed, round(max(v), 4) AS top_speed FROM d GROUP BY session_id""")
def frame_speeds(spark: SparkSession, sf: str) -> DataFrame:
    """Speed between frames, in cm/s; the first frame has none."""
    w = Window.partitionBy("session_id").orderBy("frame_index")
    step = F.sqrt((F.col("space_x") - F.lag("space_x").over(w)) ** 2 + (F.col("space_y") - F.lag("space_y").over(w)) ** 2)
    v = A.frames(spark, sf).select("session_id", (step * 100 * 150).alias("v"))
    return v.groupBy("session_id").agg(F.count("v").alias("n"), r6(F.avg("v"), 4).alias("mean_speed"), r6(F.max("v"), 4).alias("top_speed"))


@query(FRAMES + """, o AS (SELECT session_id, CAST((space_x + 32) / 4 AS INTEGER) AS i, CAST((space_y + 32) / 4 AS INTEGER) AS j, count(*) AS n FROM frames GROUP BY ALL),
    k AS (SELECT a, exp(-0.5 * a * a) / sum(exp(-0.5 * a * a)) OVER () AS w FROM range(-4, 5) r(a)),
    g AS (SELECT s.session_id, i, j FROM (SELECT DISTINCT session_id FROM frames) s, range(17) x(i), range(17) y(j))
    SELECT g.session_id, CAST(g.i AS INTEGER) AS i, CAST(g.j AS INTEGER) AS j, round(coalesce(sum(ka.w * kb.w * o.n), 0), 6) AS smoothed
    FROM g, k ka, k kb LEFT JOIN o ON o.session_id = g.session_id AND o.i = least(16, greatest(0, g.i + ka.a)) AND o.j = least(16, greatest(0, g.j + kb.a)) GROUP BY ALL""")
def smoothed_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Occupancy maps smoothed along both axes, edges repeated; each session's map goes to numpy."""
    from sonolith.functions.numeric import smooth_2d
    from sonolith.operators.kernels import per_group

    cell = lambda c: F.rint((F.col(c) + 32) / 4).cast("int")
    o = A.frames(spark, sf).groupBy("session_id", cell("space_x").alias("i"), cell("space_y").alias("j")).agg(F.count(F.lit(1)).alias("n"))

    def work(p):
        import numpy as np

        m = np.zeros((17, 17))
        m[p["i"], p["j"]] = p["n"]
        s = smooth_2d(m, 1.0)
        return [(int(i), int(j), round(float(s[i, j]), 6)) for i in range(17) for j in range(17)]

    return per_group(o, ["session_id"], work, "i int, j int, smoothed double")
