"""Queries on ordered events: intervals, bouts, merged spans, as-of lookups, runs, edges, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.operators import intervals as I
from sonolith.operators import points as P
from sonolith.plans.registry import query

EV, CALLS, SPIKES, TURNS, FRAMES = (A.with_sql(x) for x in ("events_m", "calls", "spikes", "turns", "frames"))
DAY = 86400.0


def r6(x, n: int = 6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


def _intervals_sql(before: str) -> str:
    return CALLS + f""", l AS (
        SELECT session_id, sex, start, lag(sex) OVER w AS sex0, lag({before}) OVER w AS from_s FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY row_idx)
    ), d AS (SELECT session_id, sex, start - from_s AS i FROM l WHERE sex = sex0 AND sex IN ('male', 'female'))
    SELECT session_id, sex, count(*) FILTER (i > 0) AS n, count(*) FILTER (i <= 0) AS n_dropped,
           round(quantile_cont(i, 0.5) FILTER (i > 0), 7) AS median_s, round(avg(ln(CASE WHEN i > 0 THEN i END)), 6) AS mean_log
    FROM d GROUP BY ALL"""


def _intervals(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    d = I.same_emitter_intervals(A.calls(spark, sf), mode)
    kept = F.when(~F.col("dropped"), F.col("interval_s"))
    return d.groupBy("session_id", "sex").agg(
        F.count(kept).alias("n"), F.count_if("dropped").alias("n_dropped"), r6(F.median(kept), 7).alias("median_s"), r6(F.avg("log_interval")).alias("mean_log")
    )


@query(_intervals_sql("stop"))
def same_emitter_intervals_e2s(spark: SparkSession, sf: str) -> DataFrame:
    return _intervals(spark, sf, "e2s")


@query(_intervals_sql("start"))
def same_emitter_intervals_s2s(spark: SparkSession, sf: str) -> DataFrame:
    return _intervals(spark, sf, "s2s")


@query(CALLS + """, a AS (SELECT session_id, 's2s' AS interval_type, sex, start - lag(start) OVER w AS i, sex = lag(sex) OVER w AS same FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY row_idx)),
    b AS (SELECT session_id, 'e2s' AS interval_type, sex, start - lag(stop) OVER w AS i, sex = lag(sex) OVER w AS same FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY row_idx))
    SELECT interval_type, sex, round(i, 6) AS interval_s, round(ln(i), 6) AS log_interval, session_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE same AND sex <> 'unassigned' AND i > 0""")
def interval_master_table(spark: SparkSession, sf: str) -> DataFrame:
    calls = A.calls(spark, sf)
    both = [I.same_emitter_intervals(calls, m).where("not dropped").select(F.lit(m).alias("interval_type"), "sex", r6("interval_s").alias("interval_s"), r6("log_interval").alias("log_interval"), "session_id") for m in ("s2s", "e2s")]
    return both[0].unionByName(both[1])


def _bouts_sql(op: str, gap: float, having: str = "") -> str:
    return CALLS + f""", g AS (
        SELECT *, CASE WHEN start - lag(stop) OVER w {op} {gap} THEN 1 ELSE 0 END AS n FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY start, row_idx)
    ), b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY session_id ORDER BY start, row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bout FROM g)
    SELECT session_id, bout, round(min(start), 6) AS onset, round(max(stop), 6) AS offset_s, count(*) AS n_calls, round(avg(duration), 6) AS mean_call_s
    FROM b GROUP BY session_id, bout {having}"""


def _bouts(spark: SparkSession, sf: str, gap: float, strict: bool) -> DataFrame:
    s = I.bout_summary(I.detect_bouts(A.calls(spark, sf), gap, strict))
    return s.select("session_id", "bout", r6("onset").alias("onset"), r6("offset").alias("offset_s"), "n_calls", r6("mean_call_s").alias("mean_call_s"))


@query(_bouts_sql(">", 60.0))
def bouts_strict_gap(spark: SparkSession, sf: str) -> DataFrame:
    return _bouts(spark, sf, 60.0, True)


@query(_bouts_sql(">=", 60.0))
def bouts_inclusive_gap(spark: SparkSession, sf: str) -> DataFrame:
    return _bouts(spark, sf, 60.0, False)


@query(_bouts_sql(">=", 90.0, "HAVING count(*) >= 3 AND min(duration) >= 0.5 AND max(duration) <= 300"))
def bouts_of_repository(spark: SparkSession, sf: str) -> DataFrame:
    """Complete bouts with enough calls, all within a range of durations."""
    b = I.detect_bouts(A.calls(spark, sf), 90.0, False)
    ok = b.groupBy("session_id", "bout").agg(F.count(F.lit(1)).alias("n"), F.min("duration").alias("lo"), F.max("duration").alias("hi")).where("n >= 3 and lo >= 0.5 and hi <= 300")
    s = I.bout_summary(b.join(ok.select("session_id", "bout"), ["session_id", "bout"], "left_semi"))
    return s.select("session_id", "bout", r6("onset").alias("onset"), r6("offset").alias("offset_s"), "n_calls", r6("mean_call_s").alias("mean_call_s"))


@query(CALLS + f""", m AS (SELECT * FROM calls WHERE sex = 'male'), g AS (
        SELECT *, CASE WHEN start - lag(stop) OVER w >= {I.ibi_threshold(-2.76955, 0.24298, 2.58) * 1000} THEN 1 ELSE 0 END AS n FROM m WINDOW w AS (PARTITION BY session_id ORDER BY start, row_idx)
    ), b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY session_id ORDER BY start, row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bout FROM g)
    SELECT session_id, bout, round(min(start), 6) AS onset, round(max(stop) - min(start), 6) AS bout_s, count(*) AS n_calls FROM b GROUP BY session_id, bout HAVING count(*) >= 2 AND min(start) > 4""")
def variable_length_bouts(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts of one sex by the log-normal gap threshold (here in thousandths), of two calls or more, after the first history."""
    b = I.bout_summary(I.detect_bouts(A.calls(spark, sf).where("sex = 'male'"), I.ibi_threshold(-2.76955, 0.24298, 2.58) * 1000, False))
    return b.where("n_calls >= 2 and onset > 4").select("session_id", "bout", r6("onset").alias("onset"), r6("bout_s").alias("bout_s"), "n_calls")


MERGE = """, p AS (SELECT *, max({stop}) OVER (PARTITION BY session_id ORDER BY start, {stop} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {src}),
    i AS (SELECT *, sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start, {stop} ROWS UNBOUNDED PRECEDING) AS isl FROM p),
    merged AS (SELECT session_id, min(start) AS start, max({stop}) AS stop, count(*) AS n_merged FROM i GROUP BY session_id, isl)"""


@query(CALLS + MERGE.format(stop="stop", src="calls") + " SELECT session_id, round(start, 6) AS start, round(stop, 6) AS stop, n_merged FROM merged")
def merged_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return I.merge_intervals(A.calls(spark, sf)).select("session_id", r6("start").alias("start"), r6("stop").alias("stop"), "n_merged")


_FREE = CALLS + """, f0 AS (SELECT session_id, start, stop + 40 AS stop FROM calls)""" + MERGE.format(stop="stop", src="f0") + f""",
    gaps AS (
        SELECT session_id, greatest(stop, 40) AS a, least(coalesce(lead(start) OVER (PARTITION BY session_id ORDER BY start), {DAY}), {DAY}) AS b FROM merged
        UNION ALL SELECT session_id, 40 AS a, least(min(start), {DAY}) AS b FROM merged GROUP BY session_id
    ), free AS (SELECT session_id, CAST(a AS DOUBLE) AS a, b FROM gaps WHERE b > a)"""


@query(_FREE + " SELECT session_id, count(*) AS n, round(sum(b - a), 4) AS free_s, round(max(b - a), 6) AS longest FROM free GROUP BY session_id")
def clean_gaps(spark: SparkSession, sf: str) -> DataFrame:
    m = I.merge_intervals(A.calls(spark, sf).select("session_id", "start", (F.col("stop") + 40).alias("stop")))
    g = I.clean_gaps(m, 40.0, DAY)
    d = F.col("free_to") - F.col("free_from")
    return g.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(d), 4).alias("free_s"), r6(F.max(d)).alias("longest"))


@query(_FREE + ", t AS (SELECT session_id, a, unnest(range(1, CAST(floor((b - a) / 40) AS BIGINT) + 1)) AS k FROM free) SELECT session_id, round(a + k * 40.0, 6) AS tile FROM t")
def clean_tiled_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return I.clean_tiles(A.calls(spark, sf), 40.0, DAY).select("session_id", r6("tile").alias("tile"))


@query(CALLS + """, t AS (SELECT session_id, start AS tile FROM calls WHERE sex = 'female')
    SELECT t.session_id, round(t.tile, 6) AS tile FROM t WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.session_id = t.session_id AND c.sex = 'male' AND c.start >= t.tile AND c.start < t.tile + 120)""")
def clean_negative_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors without a start of the other sex in [t, t + 120), by counting and not by pairs."""
    calls = A.calls(spark, sf)
    tiles = calls.where("sex = 'female'").select("session_id", F.col("event_id").alias("window_id"), F.col("start").alias("low"), (F.col("start") + 120).alias("high"))
    n = P.count_in_windows(calls.where("sex = 'male'").withColumnRenamed("start", "t"), tiles, ("session_id",))
    return tiles.join(n.where("n = 0"), ["session_id", "window_id"], "left_semi").select("session_id", r6("low").alias("tile"))


@query(CALLS + """ SELECT a.event_id, round((SELECT max(b.stop) FROM calls b WHERE b.session_id = a.session_id AND b.start < a.start), 6) AS latest_stop FROM calls a""")
def latest_other_stop(spark: SparkSession, sf: str) -> DataFrame:
    return I.latest_other_stop(A.calls(spark, sf)).select("event_id", r6("latest_stop").alias("latest_stop"))


@query(CALLS + """ SELECT a.event_id, NOT EXISTS (SELECT 1 FROM calls b WHERE b.session_id = a.session_id AND b.event_id <> a.event_id AND b.start < a.stop AND b.stop > a.start) AS is_isolated FROM calls a""")
def isolated_events(spark: SparkSession, sf: str) -> DataFrame:
    return I.isolated(A.calls(spark, sf)).select("event_id", "is_isolated")


@query(CALLS + """, a AS (SELECT event_id, start, (SELECT max(b.stop) FROM calls b WHERE b.session_id = calls.session_id AND b.start < calls.start) AS ls FROM calls),
    g AS (SELECT a.*, k, start - 200 + 50 * k AS lo, start - 150 + 50 * k AS hi FROM a, range(4) r(k))
    SELECT CAST(k AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (lo >= 0 AND hi <= 86400) AS n_in, count(*) FILTER (coalesce(lo > ls, true)) AS n_clean FROM g GROUP BY k""")
def anchor_bin_validity(spark: SparkSession, sf: str) -> DataFrame:
    edges = [(-200.0 + 50 * k, -150.0 + 50 * k) for k in range(4)]
    g = I.anchor_bins(I.latest_other_stop(A.calls(spark, sf)), edges, DAY)
    return g.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_recording").alias("n_in"), F.count_if("clean_post").alias("n_clean"))


@query(CALLS + " SELECT event_id, session_id, round(start, 6) AS start, round(stop, 6) AS stop FROM calls WHERE start < 50000 AND stop > 40000")
def events_overlapping_window(spark: SparkSession, sf: str) -> DataFrame:
    return I.overlapping_window(A.calls(spark, sf), 40000, 50000).select("event_id", "session_id", r6("start").alias("start"), r6("stop").alias("stop"))


@query(TURNS + """, f AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM f)
    SELECT conv_id, role, min(turn) AS run_from, max(turn) + 1 AS run_to FROM g GROUP BY conv_id, role, r""")
def label_runs(spark: SparkSession, sf: str) -> DataFrame:
    return I.run_lengths(A.turns(spark, sf), "role", ("conv_id",), "turn")


@query(TURNS + """, l AS (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM turns)
    SELECT conv_id, role, count(*) AS n, max(turn - before) AS widest FROM l WHERE before IS NOT NULL GROUP BY ALL""")
def gaps_between_turns_of_a_role(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    t = A.turns(spark, sf).withColumn("before", F.lag("turn").over(w)).where("before is not null")
    return t.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("turn") - F.col("before")).alias("widest"))


@query(CALLS + """, f AS (SELECT session_id, unnest(range(greatest(CAST(floor(start * 0.1) AS BIGINT), 0), least(greatest(CAST(ceil(stop * 0.1) AS BIGINT), CAST(floor(start * 0.1) AS BIGINT) + 1), 8640))) AS frame FROM calls WHERE category = 'click')
    SELECT session_id, count(DISTINCT frame) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame FROM f GROUP BY session_id""")
def occupancy_trace(spark: SparkSession, sf: str) -> DataFrame:
    f = I.occupied_frames(A.calls(spark, sf).where("category = 'click'"), 0.1, 8640)
    return f.groupBy("session_id").agg(F.count("frame_index").alias("n_frames"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


@query(CALLS + """, f AS (SELECT DISTINCT session_id, CAST(floor(start * 0.1) AS BIGINT) AS frame FROM calls WHERE start * 0.1 < 8640)
    SELECT session_id, count(*) AS n_on, round(count(*) / 8640.0, 8) AS rate FROM f GROUP BY session_id""")
def binary_event_trace(spark: SparkSession, sf: str) -> DataFrame:
    f = A.calls(spark, sf).select("session_id", F.floor(F.col("start") * 0.1).alias("frame")).where("frame < 8640").distinct()
    return f.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_on"), F.round(F.count(F.lit(1)) / F.lit(8640.0), 8).alias("rate"))


_EDGES = FRAMES + """, d AS (SELECT session_id, frame_index, speed - lag(speed) OVER w AS d FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame_index)),
    n AS (SELECT *, lead(d) OVER (PARTITION BY session_id ORDER BY frame_index) AS nx FROM d WHERE d IS NOT NULL),
    e AS (SELECT session_id, CASE WHEN nx > 0 THEN frame_index ELSE frame_index + 1 END AS pos, CASE WHEN nx > 0 THEN 1 ELSE -1 END AS sign FROM n WHERE abs(d) < 12 AND abs(nx) > 12)"""


@query(_EDGES + " SELECT session_id, sign, count(*) AS n, min(pos) AS first_at, CAST(sum(pos) AS BIGINT) AS total FROM e GROUP BY ALL")
def step_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = I.step_edges(A.frames(spark, sf), "speed", 12.0, order="frame_index")
    return e.groupBy("session_id", "sign").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.sum("at").alias("total"))


@query(_EDGES + """, s AS (SELECT *, coalesce(lead(pos) OVER w - pos < 4, false) AS s FROM e WINDOW w AS (PARTITION BY session_id ORDER BY pos, sign)),
    b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY session_id ORDER BY pos, sign), false) AS b FROM s)
    SELECT session_id, pos, sign FROM b WHERE NOT s AND NOT b""")
def debounced_edges(spark: SparkSession, sf: str) -> DataFrame:
    return I.drop_short_flips(I.step_edges(A.frames(spark, sf), "speed", 12.0, order="frame_index"), 4).withColumnRenamed("at", "pos")


@query(_EDGES + """, p AS (SELECT *, lag(sign) OVER (PARTITION BY session_id ORDER BY pos, sign) AS p FROM e) SELECT session_id, pos, sign FROM p WHERE p IS NULL OR p <> sign""")
def alternating_edges(spark: SparkSession, sf: str) -> DataFrame:
    return I.alternating(I.step_edges(A.frames(spark, sf), "speed", 12.0, order="frame_index")).withColumnRenamed("at", "pos")


@query(FRAMES + """, b AS (SELECT session_id, frame_index, CAST(speed AS BIGINT) & 1 AS b, lag(CAST(speed AS BIGINT) & 1) OVER w AS p FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame_index)),
    g AS (SELECT session_id, frame_index AS pos, lead(frame_index) OVER (PARTITION BY session_id ORDER BY frame_index) - frame_index AS gap FROM b WHERE b = 1 AND p = 0)
    SELECT session_id, count(*) AS n, max(gap) AS widest, arg_max(pos, struct_pack(a := gap, b := -pos)) AS widest_at FROM g WHERE gap IS NOT NULL GROUP BY session_id""")
def rising_bit_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = I.rising_edges(A.frames(spark, sf), F.col("speed").cast("long").bitwiseAND(F.lit(1)), order="frame_index").where("gap is not null")
    return e.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("widest"), F.max_by("at", F.struct("gap", -F.col("at"))).alias("widest_at"))


@query(FRAMES + """, b AS (SELECT session_id, frame_index, CAST(speed AS BIGINT) & 1 AS b, lag(CAST(speed AS BIGINT) & 1) OVER w AS p FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame_index)),
    e AS (SELECT session_id, frame_index, b, lead(frame_index) OVER (PARTITION BY session_id ORDER BY frame_index) AS nx FROM b WHERE b <> p)
    SELECT session_id, count(*) AS n, round(avg((nx - frame_index) * 1000 / 150.0), 6) AS mean_ms FROM e WHERE b = 0 AND nx IS NOT NULL GROUP BY session_id""")
def interpulse_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Time from each falling edge of the lowest bit to the rising edge after it."""
    w = Window.partitionBy("session_id").orderBy("frame_index")
    b = A.frames(spark, sf).select("session_id", "frame_index", F.col("speed").cast("long").bitwiseAND(F.lit(1)).alias("b")).withColumn("p", F.lag("b").over(w))
    e = b.where("b <> p").withColumn("nx", F.lead("frame_index").over(w)).where("b = 0 and nx is not null")
    return e.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("nx") - F.col("frame_index")) * 1000 / F.lit(150.0))).alias("mean_ms"))


@query(FRAMES + """, v AS (SELECT session_id, speed AS s, frame_index FROM frames), q AS (SELECT list(s ORDER BY frame_index) AS l FROM v WHERE session_id = 3 AND frame_index BETWEEN 100 AND 104),
    p AS (SELECT session_id, v.frame_index - i AS pos, i, abs(v.s - l[i + 1]) AS d FROM v, q, range(5) r(i))
    SELECT session_id, pos, count(*) AS n, round(max(d), 6) AS worst FROM p GROUP BY session_id, pos HAVING count(*) = 5 AND max(d) <= 12""")
def subsequence_match(spark: SparkSession, sf: str) -> DataFrame:
    """Places of any session where five values follow one another as in a query, within a tolerance; the query is five frames of session 3."""
    v = A.frames(spark, sf).select("session_id", "frame_index", F.col("speed").alias("s"))
    wanted = v.where("session_id = 3 and frame_index between 100 and 104").select((F.col("frame_index") - 100).alias("i"), F.col("s").alias("x"))
    p = v.join(F.broadcast(wanted)).select("session_id", (F.col("frame_index") - F.col("i")).alias("pos"), F.abs(F.col("s") - F.col("x")).alias("d"))  # five rows
    near = p.where("d <= 12").groupBy("session_id", "pos").agg(F.count(F.lit(1)).alias("n"), r6(F.max("d")).alias("worst"))
    return near.where("n = 5")


def _diff_sql(angle: bool) -> str:
    d = "lead(yaw, 3) OVER w - lag(yaw, 3) OVER w" if angle else "lead(speed, 3) OVER w - lag(speed, 3) OVER w"
    x = "CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END" if angle else "d"
    return FRAMES + f""", x AS (SELECT session_id, frame_index, {d} AS d FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame_index)),
    y AS (SELECT session_id, ({x}) / (6 / 150.0) AS v FROM x)
    SELECT session_id, count(v) AS n, round(avg(v), 6) AS mean_v, round(max(v), 6) AS max_v, round(min(v), 6) AS min_v FROM y GROUP BY session_id"""


def _diff(spark: SparkSession, sf: str, column: str, angle: bool) -> DataFrame:
    f = A.frames(spark, sf)
    v = f.select("session_id", I.central_difference(f, column, 3, 150.0, angle).alias("v"))
    return v.groupBy("session_id").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean_v"), r6(F.max("v")).alias("max_v"), r6(F.min("v")).alias("min_v"))


@query(_diff_sql(False))
def central_derivative(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf, "speed", False)


@query(_diff_sql(True))
def central_derivative_of_angle(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf, "yaw", True)


_WIN = SPIKES + ", a AS (SELECT session_id, event_id, start FROM events_m WHERE category = 'signup')"


@query(_WIN + """ SELECT a.event_id, count(s.t) AS n FROM a LEFT JOIN spikes s ON s.session_id = a.session_id AND s.t >= a.start AND s.t <= a.start + 300 GROUP BY a.event_id""")
def spikes_in_closed_window(spark: SparkSession, sf: str) -> DataFrame:
    a = A.events(spark, sf).where("category = 'signup'").select("session_id", F.col("event_id").alias("window_id"), F.col("start").alias("low"), (F.col("start") + 300).alias("high"))
    return P.count_in_windows(A.spikes(spark, sf), a, ("session_id",), closed=True).select(F.col("window_id").alias("event_id"), "n")


@query(_WIN + """ SELECT a.event_id, count(s.t) AS n FROM a LEFT JOIN spikes s ON s.session_id = a.session_id AND s.t >= a.start - 300 AND s.t < a.start GROUP BY a.event_id""")
def spikes_in_half_open_window(spark: SparkSession, sf: str) -> DataFrame:
    a = A.events(spark, sf).where("category = 'signup'").select("session_id", F.col("event_id").alias("window_id"), (F.col("start") - 300).alias("low"), F.col("start").alias("high"))
    return P.count_in_windows(A.spikes(spark, sf), a, ("session_id",)).select(F.col("window_id").alias("event_id"), "n")


@query(_WIN + """ SELECT k.k, count(s.t) AS n FROM a CROSS JOIN range(4) k(k) LEFT JOIN spikes s ON s.session_id = a.session_id AND s.t >= a.start + k.k * 100.0 AND s.t <= a.start + k.k * 100.0 + 150.0 GROUP BY k.k""")
def hopping_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    a = P.hopping_windows(A.events(spark, sf).where("category = 'signup'").select("session_id", "event_id", "start"), 150.0, 100.0, 4)
    w = a.select("session_id", (F.col("event_id") * 4 + F.col("k")).alias("window_id"), "low", "high")
    n = P.count_in_windows(A.spikes(spark, sf), w, ("session_id",), closed=True)
    return n.groupBy((F.col("window_id") % 4).alias("k")).agg(F.sum("n").alias("n"))


@query(_WIN + """, e AS (SELECT s.unit_id, CAST(floor((s.t - a.start + 2000) / 100) AS INTEGER) AS bin FROM a JOIN spikes s ON s.session_id = a.session_id AND s.t >= a.start - 2000 AND s.t < a.start)
    SELECT unit_id, bin, count(*) AS n FROM e WHERE bin BETWEEN 0 AND 19 GROUP BY ALL""")
def peri_event_histogram(spark: SparkSession, sf: str) -> DataFrame:
    a = A.events(spark, sf).where("category = 'signup'").select("session_id", F.col("event_id").alias("anchor_id"), "start")
    return P.peri_event_histogram(A.spikes(spark, sf), a, ("session_id",), -2000.0, 0.0, 100.0).groupBy("unit_id", "bin").agg(F.sum("n").alias("n"))


@query(SPIKES + """, s AS (SELECT session_id, t + 30000 - 86400 * floor((t + 30000) / 86400) AS t FROM spikes)
    SELECT session_id, count(*) AS n, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, round(avg(t), 6) AS mean_t FROM s GROUP BY session_id""")
def circular_shift(spark: SparkSession, sf: str) -> DataFrame:
    s = A.spikes(spark, sf).select("session_id", P.circular_shift(F.col("t"), 30000.0, DAY).alias("t"))
    return s.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), r6(F.min("t")).alias("first_t"), r6(F.max("t")).alias("last_t"), r6(F.avg("t")).alias("mean_t"))


_CHANGE = """, days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), n AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM days),
    sess AS (SELECT i AS session_no, i * 86400.0 + (i % 3) * 600 AS b, (i + 1) * 86400.0 - (i % 4) * 900 AS e, CAST(80000 * 15 + i AS BIGINT) AS n_frames FROM n),
    sp AS (SELECT unit_id, t + date_diff('day', (SELECT min(d) FROM days), session_id) * 86400.0 AS t FROM spikes)"""


@query(SPIKES + _CHANGE + """, j AS (SELECT sess.session_no, unit_id, t - b AS sec, least(CAST(round_even((t - b) * 15, 0) AS BIGINT), n_frames - 1) AS frame FROM sp JOIN sess ON t >= b AND t < e)
    SELECT CAST(session_no AS BIGINT) AS session_no, unit_id, count(*) AS n, max(frame) AS last_frame, round(min(sec), 6) AS first_s FROM j GROUP BY ALL HAVING count(*) > 3""")
def split_spikes_to_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Spikes on one clock to half-open sessions, seconds and frames, units with more than three spikes."""
    days = A.table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    low = days.agg(F.min("d")).first()[0]
    i = F.row_number().over(Window.orderBy("d")) - 1  # one row a day
    sess = days.withColumn("i", i).select(
        F.col("i").cast("long").alias("session_id"), (F.col("i") * F.lit(DAY) + (F.col("i") % 3) * 600).alias("begin"), ((F.col("i") + 1) * F.lit(DAY) - (F.col("i") % 4) * 900).alias("end"), (F.lit(1200000) + F.col("i")).cast("long").alias("n_frames")
    )
    sp = A.spikes(spark, sf).select("unit_id", (F.col("t") + F.date_diff("session_id", F.lit(low)) * F.lit(DAY)).alias("t"))
    out = P.assign_to_sessions(sp, sess, 15.0, DAY)
    return out.groupBy(F.col("session_id").alias("session_no"), "unit_id").agg(F.count(F.lit(1)).alias("n"), F.max("frame").alias("last_frame"), r6(F.min("seconds")).alias("first_s")).where("n > 3")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS session_id, count(*) AS n_samples FROM events GROUP BY ALL)
    SELECT session_id, n_samples, CAST(coalesce(sum(n_samples) OVER (ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_sample FROM d""")
def changepoint_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each session begins when all are laid end to end; one row a session."""
    d = A.table(spark, sf, "events").groupBy(F.to_date("ts").alias("session_id")).agg(F.count(F.lit(1)).alias("n_samples"))
    w = Window.orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("first_sample", F.coalesce(F.sum("n_samples").over(w), F.lit(0).cast("long")))


@query(SPIKES + """, g AS (SELECT session_id, unit_id, t, t - lag(t) OVER (PARTITION BY session_id, unit_id ORDER BY t) AS gap FROM spikes)
    SELECT unit_id, count(*) AS n_all, count(*) FILTER (gap IS NULL OR gap >= 120) AS n_kept FROM g GROUP BY unit_id""")
def refractory_censoring(spark: SparkSession, sf: str) -> DataFrame:
    s = A.spikes(spark, sf)
    kept = P.drop_refractory(s, ("session_id", "unit_id"), 120.0).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_kept"))
    return s.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_all")).join(kept, "unit_id")


@query(FRAMES + """ SELECT session_id, frame_index, round(avg(speed) OVER (PARTITION BY session_id ORDER BY frame_index ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 6) AS mean_history FROM frames""")
def history_means(spark: SparkSession, sf: str) -> DataFrame:
    from sonolith.operators.normalise import history_mean

    f = A.frames(spark, sf)
    return f.select("session_id", "frame_index", r6(history_mean(f, "speed", 30)).alias("mean_history"))


@query(CALLS + """, f AS (SELECT session_id, CAST(round_even(start * 0.05, 0) AS BIGINT) AS frame FROM calls WHERE category = 'purchase'),
    """ + A.SQL["frames"] + """, h AS (SELECT session_id, frame_index, list(speed) OVER w AS x FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY frame_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    j AS (SELECT f.session_id, f.frame, h.x FROM f JOIN h ON h.session_id = (CAST(strftime(f.session_id, '%d') AS INTEGER) - 1) % 10 AND h.frame_index = f.frame WHERE len(h.x) = 20)
    SELECT session_id, frame, count(*) AS n, round(avg(list_sum(x)), 6) AS total FROM j GROUP BY ALL""")
def event_history_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty values before each event's frame, of events whose window is whole."""
    from sonolith.operators.normalise import history_window

    f = A.frames(spark, sf)
    h = f.select(F.col("session_id").alias("s"), F.col("frame_index").alias("frame"), history_window(f, "speed", 20).alias("x"))
    e = A.calls(spark, sf).where("category = 'purchase'").select("session_id", ((F.dayofmonth("session_id") - 1) % 10).cast("long").alias("s"), F.rint(F.col("start") * 0.05).cast("long").alias("frame"))
    j = e.join(h, ["s", "frame"]).where("x is not null")
    return j.groupBy("session_id", "frame").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v))).alias("total"))
