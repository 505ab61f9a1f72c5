"""Queries for the session dimension, roles, columns, model inputs, splits and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.operators import normalise as Z
from sonolith.operators import sessions as S
from sonolith.plans.registry import query

CALLS, FRAMES, POINTS, EVENTS = (A.with_sql(x) for x in ("calls", "frames", "points", "events_m"))
STEPS, MINUTES = 10, 1440


def r6(x, n: int = 6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


# the session dimension


@query("""WITH t AS (SELECT s_nationkey AS session_id, list(s_name ORDER BY s_suppkey) AS names FROM supplier GROUP BY s_nationkey)
    SELECT session_id, names[1] AS male, names[2] AS female, len(names) AS n_tracks FROM t""")
def session_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as the tracks of a nation's session."""
    return S.identities(A.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("session_id"), "s_suppkey", "s_name"), "session_id", "s_suppkey", "s_name")


@query(FRAMES + """, n AS (SELECT session_id, count(*) AS n_frames, round(avg(speed), 6) AS mean_speed FROM frames GROUP BY session_id)
    SELECT n_nationkey AS session_id, coalesce(n_frames, 0) AS n_frames, mean_speed, CASE WHEN n_frames IS NULL THEN 'skipped' ELSE 'loaded' END AS status FROM nation LEFT JOIN n ON n.session_id = n_nationkey""")
def scanned_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the listed sessions, and the listed ones that have none."""
    listed = A.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("session_id"))
    found, skipped = S.scan_listed(listed, A.frames(spark, sf), "session_id")
    loaded = found.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_frames"), r6(F.avg("speed")).alias("mean_speed"), F.lit("loaded").alias("status"))
    out = loaded.unionByName(skipped.select("session_id", F.lit(0).cast("long").alias("n_frames"), F.lit(None).cast("double").alias("mean_speed"), F.lit("skipped").alias("status")))
    return out.withColumn("session_id", F.col("session_id").cast("int"))


@query("""WITH t AS (SELECT s_nationkey AS session_id, list(s_name ORDER BY s_suppkey) AS names FROM supplier GROUP BY s_nationkey)
    SELECT session_id, names[1 + abs(session_id % 2 - 1)] AS target, names[1 + session_id % 2] AS predictor FROM t WHERE len(names) > 1""")
def emitter_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Target and predictor of each session, the predictor being the male in even ones."""
    t = session_identities(spark, sf).where("n_tracks > 1")
    target, predictor = S.roles(F.col("male"), F.col("female"), F.pmod("session_id", F.lit(2)))
    return t.select("session_id", target.alias("target"), predictor.alias("predictor"))


@query(EVENTS + """, m AS (SELECT session_id, sex, min(user_id) AS emitter FROM events_m WHERE sex <> 'unassigned' GROUP BY ALL)
    SELECT session_id, max(emitter) FILTER (sex = 'male') AS male, max(emitter) FILTER (sex = 'female') AS female, count(*) AS n_roles FROM m GROUP BY session_id""")
def role_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Emitter and role of each session as a map, read by role."""
    m = A.events(spark, sf).where("sex <> 'unassigned'").groupBy("session_id", "sex").agg(F.min("user_id").alias("emitter"))
    maps = m.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sex", "emitter")))).alias("roles"))
    return maps.select("session_id", F.try_element_at("roles", F.lit("male")).alias("male"), F.try_element_at("roles", F.lit("female")).alias("female"), F.size("roles").cast("long").alias("n_roles"))


_COLUMNS = [f"{a}.{f}{d}" for a in ("m1", "m2") for f in ("speed", "tail_curvature", "neck_elevation") for d in ("", "_1st_der", "_2nd_der")]
_COLUMNS += [f"m1-m2.{f}{d}" for f in ("nose-nose", "allo_yaw-nose", "nose-allo_yaw", "TTI-nose", "nose-TTI") for d in ("", "_1st_der")] + ["m1-m2.orofacial-sei", "m2-m1.orofacial-sei", "m1.other"]
_OWN, _POSE, _ENGAGED = ["speed", "tail_curvature"], ["nose-nose", "allo_yaw-nose", "nose-allo_yaw", "TTI-nose", "nose-TTI"], ["orofacial-sei"]


@query(f"""WITH c AS (SELECT unnest({_COLUMNS}) AS c), p AS (SELECT c, regexp_replace(c, '_(1st|2nd)_der$', '') AS base, regexp_extract(c, '_(1st|2nd)_der$', 1) AS der FROM c),
    f AS (SELECT c, der, string_split(base, '.')[1] AS owner, string_split(base, '.')[-1] AS feature, i FROM p, range(2) r(i)),
    k AS (SELECT i, c FROM f WHERE der <> '2nd' AND NOT (der <> '' AND feature = 'speed')
          AND ((feature IN {tuple(_OWN)} AND owner IN ('m1', 'm2'))
            OR (feature IN {tuple(_POSE)} AND NOT (i = 0 AND (feature LIKE 'allo_yaw-%' OR feature LIKE '%-TTI')) AND NOT (i = 1 AND (feature LIKE '%-allo_yaw' OR feature LIKE 'TTI-%')))
            OR (feature = 'orofacial-sei' AND owner = CASE WHEN i = 0 THEN 'm2-m1' ELSE 'm1-m2' END)))
    SELECT CAST(i AS INTEGER) AS predictor, CAST(row_number() OVER (PARTITION BY i ORDER BY encode(c)) - 1 AS INTEGER) AS place, c AS column_name FROM k""")
def kinematic_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns chosen for either animal as the predictor."""
    names = ("m1", "m2")
    rows = [(i, k, c) for i in (0, 1) for k, c in enumerate(S.kinematic_columns(_COLUMNS, names[1 - i], names[i], i, _OWN, _POSE, _ENGAGED, False, True, False))]
    return spark.createDataFrame(rows, "predictor int, place int, column_name string")


@query(CALLS + """, s AS (SELECT session_id, sex, 'usv_rate' AS signal, count(*) AS n FROM calls WHERE sex <> 'unassigned' GROUP BY ALL
        UNION ALL SELECT session_id, sex, 'usv_cat_' || category, count(*) FROM calls WHERE sex <> 'unassigned' GROUP BY ALL)
    SELECT session_id, sex || '.' || signal AS column_name, n FROM s WHERE sex = 'female' OR signal <> 'usv_rate'""")
def vocal_signal_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The vocal columns of a model of the male, whose own rate stays out."""
    c = A.calls(spark, sf).where("sex <> 'unassigned'")
    rate = c.groupBy("session_id", "sex").agg(F.lit("usv_rate").alias("signal"), F.count(F.lit(1)).alias("n"))
    by = c.groupBy("session_id", "sex", F.concat(F.lit("usv_cat_"), "category").alias("signal")).agg(F.count(F.lit(1)).alias("n"))
    traces = rate.unionByName(by).withColumnRenamed("sex", "emitter")
    return S.vocal_columns(traces, "male", "female", False).select("session_id", F.col("column").alias("column_name"), "n")


@query(EVENTS + """, c AS (SELECT * FROM events_m WHERE category <> 'error' AND start > 3600 AND sex <> 'unassigned')
    SELECT session_id, sex, count(*) FILTER (category = 'purchase') AS n_target, count(*) FILTER (category <> 'purchase') AS n_other, round(min(start) FILTER (category = 'purchase'), 6) AS first_target,
           round(max(start) FILTER (category <> 'purchase'), 6) AS last_other, CAST(count(DISTINCT category) AS BIGINT) AS n_categories, round(max(start) FILTER (category = 'click'), 6) AS last_click FROM c GROUP BY ALL""")
def emitter_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of each emitter after the first hour, in the target category, in others, and by category."""
    c = S.categories_by_emitter(A.events(spark, sf).where("sex <> 'unassigned'"), ("session_id", "sex"), ("error",), 3600.0, "purchase")
    return c.select(
        "session_id", "sex", F.size("target_events").cast("long").alias("n_target"), F.size("other_events").cast("long").alias("n_other"),
        r6(F.get("target_events", F.lit(0))).alias("first_target"), r6(F.array_max("other_events")).alias("last_other"),
        F.size("by_category").cast("long").alias("n_categories"), r6(F.array_max(F.try_element_at("by_category", F.lit("click")))).alias("last_click"),
    )


@query("SELECT r_regionkey AS region, count(n_nationkey) AS n, CASE WHEN count(n_nationkey) > 0 THEN round(greatest(0.1, 1.0::DOUBLE / count(n_nationkey)), 9) ELSE 0.1 END AS share FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def bounded_proportions(spark: SparkSession, sf: str) -> DataFrame:
    n = A.table(spark, sf, "region").join(A.table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_regionkey").alias("region")).agg(F.count("n_nationkey").alias("n"))
    return n.withColumn("share", F.round(S.bounded_share(0.1, F.col("n")), 9))


@query(FRAMES + " SELECT session_id, max(space_x) - min(space_x) AS width, max(space_y) - min(space_y) AS depth FROM frames GROUP BY session_id")
def arena_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return A.frames(spark, sf).groupBy("session_id").agg((F.max("space_x") - F.min("space_x")).alias("width"), (F.max("space_y") - F.min("space_y")).alias("depth"))


_LABELS = {"view": "looking at {other}", "click": "touch", "purchase": "gain of {self} from {other}"}


@query("""WITH k AS (SELECT DISTINCT event_type AS t FROM events), v AS (SELECT p || t || d AS key, p, t, d FROM k, (VALUES (''), ('self.'), ('other.')) a(p), (VALUES (''), ('_1st_der'), ('_2nd_der')) b(d))
    SELECT key, CASE t WHEN 'view' THEN w || 'looking at female' || s WHEN 'click' THEN w || 'touch' || s WHEN 'purchase' THEN w || 'gain of male from female' || s ELSE key END AS label
    FROM (SELECT *, CASE p WHEN 'self.' THEN 'male ' WHEN 'other.' THEN 'female ' ELSE '' END AS w, CASE d WHEN '_1st_der' THEN ' (1st derivative)' WHEN '_2nd_der' THEN ' (2nd derivative)' ELSE '' END AS s FROM v)""")
def feature_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = A.table(spark, sf, "events").select(F.col("event_type").alias("t")).distinct()
    keys = t.select(F.explode(F.array(*[F.concat(F.lit(p), "t", F.lit(d)) for p in ("", "self.", "other.") for d in ("", "_1st_der", "_2nd_der")])).alias("key"))
    return keys.select("key", S.feature_label(F.col("key"), _LABELS, "male", "female").alias("label"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END AS emitter FROM events")
def assigned_emitters(spark: SparkSession, sf: str) -> DataFrame:
    """Emitters by the assignment in each event's row; those of value 4 have no assignment at all."""
    e = A.table(spark, sf, "events").select("event_id")
    told = e.where("event_id % 5 <> 4").select("event_id", (F.col("event_id") % 5).alias("assignment"))
    return S.assigned(e, told, "event_id", {0: "m1", 1: "m2"})


@query(CALLS + ", " + A.SQL["frames"] + """, e AS (SELECT event_id, (CAST(strftime(session_id, '%d') AS INTEGER) - 1) % 10 AS s, CAST(floor(start / 20) AS BIGINT) AS f FROM calls)
    SELECT e.event_id, e.f AS frame, round(space_x, 6) AS x, round(space_y, 6) AS y FROM e JOIN frames ON frames.session_id = s AND frame_index = f""")
def event_track_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The tracked position at each event's frame."""
    e = A.calls(spark, sf).select("event_id", ((F.dayofmonth("session_id") - 1) % 10).cast("long").alias("session_id"), F.floor(F.col("start") / 20).cast("long").alias("frame_index"))
    return e.join(A.frames(spark, sf), ["session_id", "frame_index"]).select("event_id", F.col("frame_index").alias("frame"), r6("space_x").alias("x"), r6("space_y").alias("y"))


# model inputs


_TRACES = EVENTS + f""", g AS (SELECT session_id, m AS frame, feature FROM (SELECT DISTINCT session_id FROM events_m) s, range({MINUTES}) r(m), (VALUES ('amount'), ('rate')) f(feature)),
    b AS (SELECT session_id, CAST(floor(start / 60) AS BIGINT) AS frame, count(*) AS n, sum(duration) AS v FROM events_m WHERE category <> 'error' GROUP BY ALL),
    raw AS (SELECT g.session_id, g.frame, feature, coalesce(CASE feature WHEN 'rate' THEN CAST(n AS DOUBLE) ELSE v END, 0) AS x FROM g LEFT JOIN b ON b.session_id = g.session_id AND b.frame = g.frame),
    z AS (SELECT session_id, frame, feature, (x - avg(x) OVER f) / stddev_pop(x) OVER f AS x FROM raw WINDOW f AS (PARTITION BY feature)),
    h AS (SELECT session_id, frame, feature, sum(x) OVER w AS total, last_value(x) OVER w AS newest, count(*) OVER w AS k FROM z WINDOW w AS (PARTITION BY session_id, feature ORDER BY frame ROWS BETWEEN {STEPS} PRECEDING AND 1 PRECEDING))"""


def _inputs_sql(anchors: str, columns: str) -> str:
    return _TRACES + f", a AS ({anchors}) SELECT {columns}, feature, round(total, 6) AS total, round(newest, 6) AS newest FROM a JOIN h USING (session_id, frame) WHERE k = {STEPS}"


def _inputs(spark: SparkSession, sf: str, anchors: DataFrame) -> DataFrame:
    """Pooled z-scores of two binned features, and the ten minutes of each before every anchor."""
    e = A.calls(spark, sf).select("session_id", F.floor(F.col("start") / 60).cast("long").alias("frame"), "duration")
    binned = e.groupBy("session_id", "frame").agg(F.count(F.lit(1)).cast("double").alias("rate"), F.sum("duration").alias("amount"))
    grid = A.events(spark, sf).select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MINUTES - 1).cast("long"))).alias("frame"))
    wide = grid.join(binned, ["session_id", "frame"], "left").na.fill(0.0, ["rate", "amount"])
    traces = S.pooled_scores(wide.unpivot(["session_id", "frame"], ["rate", "amount"], "feature", "value"))
    h = S.history_inputs(traces, anchors, ("session_id",), STEPS)
    return h.withColumns({"total": r6(F.aggregate("history", F.lit(0.0), lambda s, v: s + v)), "newest": r6(F.element_at("history", -1))}).drop("history", "frame")


def _frame(name: str = "start") -> str:
    return f"CAST(floor({name} / 60) AS BIGINT) AS frame"


@query(_inputs_sql(f"SELECT session_id, event_id, {_frame()}, CAST(category = 'purchase' AS INTEGER) AS label FROM events_m WHERE category IN ('purchase', 'error')", "session_id, event_id, label"))
def onset_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Histories before onsets (1) and before negatives (0)."""
    a = A.events(spark, sf).where("category in ('purchase', 'error')")
    return _inputs(spark, sf, a.select("session_id", "event_id", F.floor(F.col("start") / 60).cast("long").alias("frame"), (F.col("category") == "purchase").cast("int").alias("label")))


@query(_inputs_sql(f"SELECT session_id, event_id, {_frame()}, CAST(category = 'click' AS INTEGER) AS label FROM events_m WHERE category <> 'error' AND sex = 'male' AND start > 600", "session_id, event_id, label"))
def category_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Histories before one emitter's calls of the target category (1) and of others (0)."""
    a = A.calls(spark, sf).where("sex = 'male' and start > 600")
    return _inputs(spark, sf, a.select("session_id", "event_id", F.floor(F.col("start") / 60).cast("long").alias("frame"), (F.col("category") == "click").cast("int").alias("label")))


@query(_inputs_sql(f"SELECT session_id, event_id, {_frame()}, CAST(list_position(['click', 'purchase', 'signup', 'view'], category) - 1 AS INTEGER) AS label FROM events_m WHERE category <> 'error' AND sex = 'female'", "session_id, event_id, label"))
def multinomial_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Histories before one emitter's calls, with the class of each."""
    a = A.calls(spark, sf).where("sex = 'female'")
    classes = F.array(*map(F.lit, ("click", "purchase", "signup", "view")))
    return _inputs(spark, sf, a.select("session_id", "event_id", F.floor(F.col("start") / 60).cast("long").alias("frame"), (F.array_position(classes, F.col("category")) - 1).cast("int").alias("label")))


@query(_inputs_sql(f"SELECT session_id, event_id, {_frame()}, round(duration, 6) AS y0, round(start / 86400, 6) AS y1 FROM events_m WHERE category = 'signup'", "session_id, event_id, y0, y1"))
def continuous_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Histories before calls, with a position of two dimensions."""
    a = A.calls(spark, sf).where("category = 'signup'")
    return _inputs(spark, sf, a.select("session_id", "event_id", F.floor(F.col("start") / 60).cast("long").alias("frame"), r6("duration").alias("y0"), r6(F.col("start") / 86400).alias("y1")))


@query(_TRACES + f""", o AS (SELECT *, start - lag(stop) OVER (PARTITION BY session_id ORDER BY start, event_id) AS gap FROM events_m WHERE category <> 'error' AND sex = 'male'),
    n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start, event_id) AS bout FROM o),
    a AS (SELECT session_id, bout, CAST(floor(min(start) / 60) AS BIGINT) AS frame, count(*) AS n_calls, round(max(stop) - min(start), 6) AS length FROM n GROUP BY ALL)
    SELECT session_id, CAST(bout AS BIGINT) AS bout, n_calls, length, feature, round(total, 6) AS total, round(newest, 6) AS newest FROM a JOIN h USING (session_id, frame) WHERE k = {STEPS}""")
def bout_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Histories before bouts, with the calls and the length of each."""
    w = Window.partitionBy("session_id").orderBy("start", "event_id")
    c = A.calls(spark, sf).where("sex = 'male'").withColumn("gap", F.col("start") - F.lag("stop").over(w))
    c = c.withColumn("bout", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 300), 1).otherwise(0)).over(w).cast("long"))
    a = c.groupBy("session_id", "bout").agg(F.floor(F.min("start") / 60).cast("long").alias("frame"), F.count(F.lit(1)).alias("n_calls"), r6(F.max("stop") - F.min("start")).alias("length"))
    return _inputs(spark, sf, a)


# splits, samples and augmentation


_HASH = "md5('{seed}:' || strftime(session_id, '%Y-%m-%d'))"


@query(CALLS + """, b AS (SELECT session_id FROM calls WHERE sex = 'male' GROUP BY session_id HAVING count(*) FILTER (category = 'purchase') > 0 AND count(*) FILTER (category <> 'purchase') > 0),
    p AS (SELECT session_id, row_number() OVER (ORDER BY """ + _HASH.format(seed=3) + """, session_id) <= greatest(1, CAST(round_even(0.2 * (SELECT count(*) FROM b), 0) AS BIGINT)) AS test FROM b),
    r AS (SELECT c.session_id, event_id, test, category = 'purchase' AS y FROM calls c JOIN p USING (session_id) WHERE sex = 'male'),
    k AS (SELECT *, row_number() OVER (PARTITION BY test, y ORDER BY md5('4:' || event_id), event_id) AS nth, (SELECT min(n) FROM (SELECT count(*) AS n FROM r WHERE NOT test GROUP BY y)) AS least FROM r)
    SELECT event_id, test, y FROM k WHERE test OR nth <= least""")
def category_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with both classes, a fifth of them held out; only the training rows are balanced."""
    c = A.calls(spark, sf).where("sex = 'male'").select("session_id", "event_id", (F.col("category") == "purchase").alias("y"))
    both = c.groupBy("session_id").agg(F.count_if("y").alias("a"), F.count_if(~F.col("y")).alias("b")).where("a > 0 and b > 0").select("session_id")
    rows = c.join(Z.held_out(both, "session_id", 0.2, 3).withColumnRenamed("held_out", "test"), "session_id")
    train = S.balanced(rows.where("not test"), "y", [Z.seeded_hash(4, F.col("event_id")), F.col("event_id")])
    return rows.where("test").unionByName(train).select("event_id", "test", "y")


def _lloyd_sql(k: int, rounds: int) -> str:
    out = f"""WITH p AS (SELECT l_suppkey AS id, avg(l_quantity) AS x, avg(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY l_suppkey),
    c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS s, x, y FROM (SELECT * FROM p ORDER BY id LIMIT {k}))"""
    for i in range(rounds + 1):
        out += f", a{i} AS (SELECT id, any_value(p.x) AS x, any_value(p.y) AS y, arg_min(s, (round((p.x - c.x) ** 2 + (p.y - c.y) ** 2, 9), s)) AS s FROM p, c{i} c GROUP BY id)"
        if i < rounds:
            out += f", c{i + 1} AS (SELECT s, avg(x) AS x, avg(y) AS y FROM a{i} GROUP BY s)"
    return out + f" SELECT id, CAST(s AS INTEGER) AS stratum, row_number() OVER (PARTITION BY s ORDER BY md5('8:' || id), id) <= greatest(1, CAST(round_even(0.2 * count(*) OVER (PARTITION BY s), 0) AS BIGINT)) AS held_out FROM a{rounds}"


@query(_lloyd_sql(4, 5))
def spatial_splits(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth held out of each stratum; strata are clusters of the sessions' mean positions."""
    p = A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.avg("l_quantity").alias("x"), (F.avg("l_extendedprice") / 1000).alias("y"))
    return Z.held_out(S.strata_by_centres(p, "id", "x", "y", 4, 5), "id", 0.2, 8, ("stratum",)).withColumn("stratum", F.col("stratum").cast("int"))


@query(POINTS + """, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
    c AS (SELECT vec_id, CAST(least(floor((x - x0) / ((x1 - x0) / 7)) + 1, 8) AS BIGINT) AS cx, CAST(least(floor((y - y0) / ((y1 - y0) / 7)) + 1, 8) AS BIGINT) AS cy FROM points, e),
    o AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY vec_id) - 1 AS nth, count(*) OVER (PARTITION BY cx, cy) AS n FROM c),
    d AS (SELECT DISTINCT cx, cy, n, unnest(range(CAST(greatest(1, ceil(10 * pow(n / 10.0::DOUBLE, 0.5) - 1e-9)) AS BIGINT))) AS draw FROM o),
    k AS (SELECT cx, cy, draw, ('0x' || substr(md5('5:' || cx || ':' || cy || ':' || draw), 1, 8))::BIGINT % n AS nth FROM d)
    SELECT vec_id, draw FROM k JOIN o USING (cx, cy, nth)""")
def grid_balanced_draws(spark: SparkSession, sf: str) -> DataFrame:
    return S.grid_draws(A.points(spark, sf), "vec_id", "x", "y", 8, 10, 0.5, 5)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, ('0x' || substr(md5('6:mask:' || vec_id), 1, 8))::BIGINT AS m, ('0x' || substr(md5('6:begin:' || vec_id), 1, 8))::BIGINT % 52 AS b FROM embeddings WHERE len(embedding) = 64)
    SELECT vec_id, CAST(CASE WHEN m / 4294967296.0::DOUBLE < 0.3 THEN b ELSE -1 END AS BIGINT) AS begin_at, round(list_sum(list_transform(x, lambda v, i: CASE WHEN m / 4294967296.0::DOUBLE < 0.3 AND i > b AND i <= b + 12 THEN 0 ELSE v END)), 6) AS total FROM e""")
def masked_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Histories with a stretch of twelve steps zeroed in three of ten."""
    e = A.table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    m = e.withColumn("y", S.masked(F.col("x"), F.col("vec_id"), 6, 0.3, 12, 64))
    first = F.get(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.get("y", i) == 0) & (F.get("x", i) != 0)), F.lit(0))
    return m.select("vec_id", F.coalesce(first, F.lit(-1)).cast("long").alias("begin_at"), r6(F.aggregate("y", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, 0.9 + 0.05 * (vec_id % 5) AS f FROM embeddings WHERE len(embedding) = 64),
    q AS (SELECT vec_id, x, i, greatest(0, least(63, 31.5 + (i - 31.5) * f)) AS q FROM e, range(64) r(i))
    SELECT vec_id, CAST(i AS INTEGER) AS step, round(x[CAST(floor(q) AS INTEGER) + 1] * (1 - (q - floor(q))) + x[CAST(least(floor(q) + 1, 63) AS INTEGER) + 1] * (q - floor(q)), 6) AS value FROM q""")
def warped_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Histories stretched about their middle by a tenth less to a tenth more."""
    e = A.table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    y = e.select("vec_id", F.posexplode(S.warped(F.col("x"), F.lit(0.9) + F.lit(0.05) * (F.col("vec_id") % 5), 64)).alias("step", "value"))
    return y.select("vec_id", "step", r6("value").alias("value"))


@query("""WITH e AS (SELECT vec_id, label, vec_id % 9 AS y, list_concat(embedding[13:16], embedding[29:32]) AS x FROM embeddings WHERE len(embedding) >= 32 AND vec_id % 9 <> 0)
    SELECT label AS session_id, count(*) AS n_events, CAST(string_agg(CAST(y AS VARCHAR), '' ORDER BY vec_id) AS VARCHAR) AS targets, round(sum(list_sum(list_transform(x, lambda v, i: CAST(v AS DOUBLE) * i))), 5) AS mass FROM e GROUP BY label""")
def session_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Each session's events in order: of two features the four newest steps side by side, and the target; unlabelled events go."""
    e = A.table(spark, sf, "embeddings").where("size(embedding) >= 32").select("vec_id", "label", F.when(F.col("vec_id") % 9 != 0, F.col("vec_id") % 9).alias("y"), F.concat(F.slice(F.slice("embedding", 1, 16), -4, 4), F.slice(F.slice("embedding", 17, 16), -4, 4)).alias("x"))
    seq = e.where("y is not null").groupBy(F.col("label").alias("session_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "y", "x"))).alias("events"))
    mass = F.aggregate("events", F.lit(0.0), lambda s, v: s + F.aggregate(F.transform(v["x"], lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b))
    return seq.select("session_id", F.size("events").cast("long").alias("n_events"), F.array_join(F.transform("events", lambda v: v["y"].cast("string")), "").alias("targets"), r6(mass, 5).alias("mass"))
