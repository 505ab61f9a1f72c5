"""Queries for tuning curves, triage roll-ups, scores of predictions, and points on a torus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.functions import scalars as S
from sonolith.operators import intervals as I
from sonolith.operators import manifold as M
from sonolith.operators import metrics as K
from sonolith.operators import triage as G
from sonolith.operators import tuning as U
from sonolith.plans.registry import query

FRAMES, SPIKES, TRIAGE, PRED, POINTS, EV, CALLS = (A.with_sql(x) for x in ("frames", "spikes", "triage", "predictions", "points", "events_m", "calls"))
_SPF = SPIKES + "," + A.SQL["frames"]
PERIOD = 6.0


def r6(x, n: int = 6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


def _edges(low: float, high: float, n: int) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in np.linspace(low, high, n + 1)) + "]"


def _bin(x: str, low: float, high: float, n: int) -> str:
    return f"CASE WHEN {x} > {low} AND {x} <= {high} THEN CAST(len(list_filter({_edges(low, high, n)}, lambda e: e < {x})) - 1 AS INTEGER) END"


@query(FRAMES + f", b AS (SELECT session_id, {_bin('speed', 1, 50, 36)} AS bin FROM frames) SELECT session_id, bin, round(count(*) / 150.0, 6) AS seconds FROM b WHERE bin IS NOT NULL GROUP BY ALL")
def occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return U.occupancy(A.frames(spark, sf), "speed", 1, 50, 36, 150.0, ("session_id",)).withColumn("seconds", r6("seconds"))


@query(FRAMES + f", b AS (SELECT session_id, CASE WHEN speed = 1 THEN 0 ELSE {_bin('speed', 1, 50, 36)} END AS bin FROM frames) SELECT session_id, bin, round(count(*) / 150.0, 6) AS seconds FROM b WHERE bin IS NOT NULL GROUP BY ALL")
def feature_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return U.occupancy(A.frames(spark, sf), "speed", 1, 50, 36, 150.0, ("session_id",), first_closed=True).withColumn("seconds", r6("seconds"))


@query(FRAMES + f", b AS (SELECT session_id, {_bin('space_x', -32, 32, 14)} AS gx, {_bin('space_y', -32, 32, 14)} AS gy FROM frames) SELECT session_id, gx, gy, round(count(*) / 150.0, 6) AS seconds FROM b WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY ALL")
def spatial_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return U.occupancy_2d(A.frames(spark, sf), "space_x", "space_y", -32, 32, 14, 150.0, ("session_id",)).withColumn("seconds", r6("seconds"))


@query(FRAMES + " SELECT session_id, CASE WHEN distance >= 5 AND distance < 95 THEN least(CAST(floor((distance - 5) / 7.5) AS INTEGER), 11) ELSE -1 END AS bin, count(*) AS n FROM frames GROUP BY ALL")
def property_bins(spark: SparkSession, sf: str) -> DataFrame:
    return A.frames(spark, sf).groupBy("session_id", S.closed_open_bin(F.col("distance"), 5, 95, 12).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _spk(spark: SparkSession, sf: str) -> DataFrame:
    s = A.spikes(spark, sf)
    return s.select((F.dayofmonth(F.date_sub("session_id", (F.col("block") * 31).cast("int"))) % 10 + F.col("block") * 10).cast("long").alias("session_id"), "unit_id", F.floor(F.col("t") / 20).cast("long").alias("frame"))


_RATE = _SPF + f""", s AS (SELECT CAST(day(session_id - CAST(31 * block AS INTEGER)) % 10 + 10 * block AS BIGINT) AS session_id, unit_id, CAST(floor(t / 20) AS BIGINT) AS frame FROM spikes),
    b AS (SELECT session_id, frame_index, {_bin('speed', 0, 50, 10)} AS bin FROM frames), o AS (SELECT session_id, bin, count(*) / 150.0::DOUBLE AS seconds FROM b WHERE bin IS NOT NULL GROUP BY ALL),
    c AS (SELECT s.session_id, unit_id, bin, count(*) AS spikes FROM s JOIN b ON s.session_id = b.session_id AND s.frame = b.frame_index WHERE bin IS NOT NULL GROUP BY ALL),
    r AS (SELECT session_id, bin, unit_id, spikes, seconds, spikes / seconds AS rate FROM c JOIN o USING (session_id, bin))"""


@query(_RATE + " SELECT session_id, unit_id, bin, spikes, round(seconds, 6) AS seconds, round(rate, 6) AS rate FROM r")
def rate_map(spark: SparkSession, sf: str) -> DataFrame:
    r = U.rate_map(A.frames(spark, sf), _spk(spark, sf), "speed", 0, 50, 10, 150.0, ("session_id",))
    return r.withColumns({"spikes": F.col("spikes").cast("long"), "seconds": r6("seconds"), "rate": r6("rate")})


_NULL = _SPF + f""", s AS (SELECT CAST(day(session_id - CAST(31 * block AS INTEGER)) % 10 + 10 * block AS BIGINT) AS session_id, unit_id, CAST(floor(t / 20) AS BIGINT) AS frame FROM spikes),
    b AS (SELECT session_id, frame_index, {_bin('speed', 0, 50, 10)} AS bin FROM frames), o AS (SELECT session_id, bin, count(*) / 150.0::DOUBLE AS seconds FROM b WHERE bin IS NOT NULL GROUP BY ALL),
    m AS (SELECT s.session_id, unit_id, k AS shuffle, (frame + 300 + 97 * k) % 4320 AS frame FROM s, range(20) t(k)),
    c AS (SELECT m.session_id, unit_id, bin, shuffle, count(*) AS spikes FROM m JOIN b ON m.session_id = b.session_id AND m.frame = b.frame_index WHERE bin IS NOT NULL GROUP BY ALL),
    r AS (SELECT session_id, unit_id, bin, shuffle, spikes / seconds AS rate FROM c JOIN o USING (session_id, bin))"""


def _null_rates(spark: SparkSession, sf: str) -> DataFrame:
    shifts = spark.createDataFrame([(k, 300 + 97 * k) for k in range(20)], "shuffle int, shift int")
    return U.rate_map(A.frames(spark, sf), _spk(spark, sf), "speed", 0, 50, 10, 150.0, ("session_id",), shuffles=shifts, n_frames=4320)


@query(_NULL + """ SELECT session_id, unit_id, bin, round(avg(rate), 9) AS null_mean, round(stddev_pop(rate), 9) AS null_std, round(quantile_cont(rate, 0.005), 9) AS p_low, round(quantile_cont(rate, 0.995), 9) AS p_high FROM r GROUP BY ALL""")
def shuffled_null(spark: SparkSession, sf: str) -> DataFrame:
    b = U.null_block(_null_rates(spark, sf), ("session_id", "unit_id", "bin"))
    return b.select("session_id", "unit_id", "bin", *[r6(c, 9).alias(c) for c in ("null_mean", "null_std", "p_low", "p_high")])


def _against_null(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["session_id", "unit_id", "bin"]
    own = U.rate_map(A.frames(spark, sf), _spk(spark, sf), "speed", 0, 50, 10, 150.0, ("session_id",)).select(*keys, "rate")
    return own.join(U.null_block(_null_rates(spark, sf), tuple(keys)), keys)


_AGAINST = _NULL + f""", nb AS (SELECT session_id, unit_id, bin, avg(rate) AS null_mean, stddev_pop(rate) AS null_std, quantile_cont(rate, 0.005) AS p_low, quantile_cont(rate, 0.995) AS p_high FROM r GROUP BY ALL),
    c1 AS (SELECT s.session_id, unit_id, bin, count(*) AS spikes FROM s JOIN b ON s.session_id = b.session_id AND s.frame = b.frame_index WHERE bin IS NOT NULL GROUP BY ALL),
    a AS (SELECT c1.session_id, c1.unit_id, c1.bin, spikes / seconds AS rate, null_mean, null_std, p_low, p_high FROM c1 JOIN o USING (session_id, bin) JOIN nb USING (session_id, unit_id, bin))"""


@query(_AGAINST + """, z AS (SELECT *, round((rate - null_mean) / null_std, 9) AS z FROM a WHERE null_std > 1e-9)
    SELECT session_id, unit_id, arg_max(bin, struct_pack(v := abs(z), b := -bin)) AS peak_bin, round(arg_max(z, struct_pack(v := abs(z), b := -bin)), 5) AS peak_z FROM z GROUP BY ALL""")
def peak_z(spark: SparkSession, sf: str) -> DataFrame:
    a = _against_null(spark, sf).where("null_std > 1e-9")
    z = a.withColumns({"rate": F.round((F.col("rate") - F.col("null_mean")) / F.col("null_std"), 9), "null_mean": F.lit(0.0), "null_std": F.lit(1.0)})
    return U.peak_z(z, ("session_id", "unit_id")).withColumn("peak_z", r6("peak_z", 5))


@query(_AGAINST + ", f AS (SELECT session_id, unit_id, round(rate, 6) > round(p_high, 6) AS excited, round(rate, 6) < round(p_low, 6) AS suppressed FROM a) SELECT session_id, count(*) AS n, count(*) FILTER (excited) AS n_excited, count(*) FILTER (suppressed) AS n_suppressed FROM f GROUP BY session_id")
def outside_null(spark: SparkSession, sf: str) -> DataFrame:
    a = _against_null(spark, sf).withColumns({c: r6(c) for c in ("rate", "p_high", "p_low")})
    return U.outside_null(a).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("excited").alias("n_excited"), F.count_if("suppressed").alias("n_suppressed"))


_CURVE = _RATE + ", full_ AS (SELECT o.session_id, u.unit_id, o.bin, o.seconds, coalesce(r.rate, 0) AS rate FROM o JOIN (SELECT DISTINCT session_id, unit_id FROM r) u USING (session_id) LEFT JOIN r ON r.session_id = o.session_id AND r.bin = o.bin AND r.unit_id = u.unit_id)"


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    """Rates over all occupied bins, those without spikes included."""
    f, s = A.frames(spark, sf), _spk(spark, sf)
    occ = U.occupancy(f, "speed", 0, 50, 10, 150.0, ("session_id",))
    r = U.rate_map(f, s, "speed", 0, 50, 10, 150.0, ("session_id",)).select("session_id", "unit_id", "bin", "rate")
    grid = occ.join(r.select("session_id", "unit_id").distinct(), "session_id")
    return grid.join(r, ["session_id", "unit_id", "bin"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


@query(_CURVE + """, t AS (SELECT *, seconds / sum(seconds) OVER w AS p, sum(rate * seconds) OVER w / sum(seconds) OVER w AS m FROM full_ WINDOW w AS (PARTITION BY session_id, unit_id))
    SELECT session_id, unit_id, round(sum(CASE WHEN rate > 0 AND m > 0 THEN p * rate * log2(rate / m) ELSE 0 END), 9) AS info_rate, round(sum(p * rate) * sum(p * rate) / CASE WHEN sum(p * rate * rate) = 0 THEN NULL ELSE sum(p * rate * rate) END, 9) AS sparsity FROM t GROUP BY ALL""")
def skaggs_information(spark: SparkSession, sf: str) -> DataFrame:
    i = U.information(_curve(spark, sf), ("session_id", "unit_id"))
    return i.withColumns({"info_rate": r6("info_rate", 9), "sparsity": r6("sparsity", 9)})


@query(_CURVE + " SELECT session_id, unit_id, round((max(rate) - min(rate)) / CASE WHEN max(rate) + min(rate) = 0 THEN NULL ELSE max(rate) + min(rate) END, 6) AS selectivity FROM full_ GROUP BY ALL")
def selectivity_index(spark: SparkSession, sf: str) -> DataFrame:
    return U.selectivity(_curve(spark, sf), ("session_id", "unit_id")).withColumn("selectivity", r6("selectivity"))


@query(_CURVE + """, rr AS (SELECT *, round(rate, 9) AS v FROM full_), k AS (SELECT session_id, unit_id, bin, rank() OVER (PARTITION BY session_id, unit_id ORDER BY v) + (count(*) OVER (PARTITION BY session_id, unit_id, v) - 1) / 2.0 AS rk FROM rr)
    SELECT session_id, unit_id, CASE WHEN count(*) >= 3 AND stddev_pop(rk) > 0 THEN round(corr(bin, rk), 6) END AS monotonicity FROM k GROUP BY ALL""")
def monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    c = _curve(spark, sf).withColumn("rate", F.round("rate", 9))
    return U.monotonicity(c, ("session_id", "unit_id")).withColumn("monotonicity", r6("monotonicity"))


@query(_CURVE + """, cc AS (SELECT *, bin * 0.15 - 1.5 AS centre FROM full_), ab AS (SELECT session_id, unit_id, arg_min(rate, struct_pack(d := round(abs(centre + 0.1), 9), c := centre)) AS a, arg_min(rate, struct_pack(d := round(abs(centre + 1.5), 9), c := centre)) AS b FROM cc GROUP BY ALL)
    SELECT session_id, unit_id, round((a - b) / CASE WHEN a + b = 0 THEN NULL ELSE a + b END, 6) AS ramp FROM ab""")
def ramp_index(spark: SparkSession, sf: str) -> DataFrame:
    c = _curve(spark, sf).withColumn("centre", F.col("bin") * 0.15 - 1.5)
    return U.ramp_index(c, ("session_id", "unit_id")).withColumn("ramp", r6("ramp"))


_GRID = FRAMES + f", b AS (SELECT session_id, {_bin('space_x', -32, 32, 14)} AS gx, {_bin('space_y', -32, 32, 14)} AS gy, speed FROM frames), g AS (SELECT session_id, gx, gy, avg(speed) AS rate FROM b WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY ALL)"


@query(_GRID + """, n AS (SELECT g.session_id, g.gx, g.gy, any_value(g.rate) AS rate, avg(h.rate) AS around FROM g JOIN g h ON g.session_id = h.session_id AND abs(g.gx - h.gx) <= 1 AND abs(g.gy - h.gy) <= 1 AND NOT (g.gx = h.gx AND g.gy = h.gy) GROUP BY ALL)
    SELECT session_id, round(corr(rate, around), 6) AS coherence FROM n GROUP BY session_id""")
def spatial_coherence(spark: SparkSession, sf: str) -> DataFrame:
    e = S.linear_edges(-32, 32, 14)
    g = A.frames(spark, sf).withColumns({"gx": S.open_closed_bin(F.col("space_x"), e), "gy": S.open_closed_bin(F.col("space_y"), e)}).where("gx is not null and gy is not null")
    g = g.groupBy("session_id", "gx", "gy").agg(F.avg("speed").alias("rate"))
    return U.coherence(g, ("session_id",)).withColumn("coherence", r6("coherence"))


def _run_sql(circular: bool) -> str:
    doubled = "SELECT session_id, bin, v FROM m UNION ALL SELECT session_id, bin + 36, v FROM m" if circular else "SELECT session_id, bin, v FROM m"
    return FRAMES + f""", b AS (SELECT session_id, {_bin('speed', 1, 50, 36)} AS bin, distance FROM frames), m AS (SELECT session_id, bin, avg(distance) > 52 AS v FROM b WHERE bin IS NOT NULL GROUP BY ALL),
    d AS ({doubled}), i AS (SELECT *, sum(CASE WHEN v THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS isl FROM d),
    r AS (SELECT session_id, isl, least(count(*), 36) AS n, min(bin) AS f FROM i WHERE v GROUP BY ALL), x AS (SELECT session_id, max(n) AS max_run, CAST(arg_max(f, struct_pack(n := n, f := -f)) % 36 AS BIGINT) AS run_from FROM r GROUP BY session_id)
    SELECT s.session_id, coalesce(max_run, 0) AS max_run, run_from FROM (SELECT DISTINCT session_id FROM m) s LEFT JOIN x USING (session_id)"""


def _run(spark: SparkSession, sf: str, circular: bool) -> DataFrame:
    b = A.frames(spark, sf).withColumn("bin", S.open_closed_bin(F.col("speed"), S.linear_edges(1, 50, 36))).where("bin is not null")
    m = b.groupBy("session_id", "bin").agg((F.avg("distance") > 52).alias("v"))
    return I.longest_true_run(m, "v", "bin", 36, ("session_id",), circular).withColumn("run_from", F.col("run_from").cast("long"))


@query(_run_sql(False))
def longest_run(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, False)


@query(_run_sql(True))
def longest_circular_run(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, True)


_VMI = _SPF + f""", g AS (SELECT *, CASE WHEN start - lag(stop) OVER w > 2 THEN 1 ELSE 0 END AS n FROM events_m WHERE category <> 'error' AND sex = 'male' WINDOW w AS (PARTITION BY session_id ORDER BY start, row_idx)),
    b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY session_id ORDER BY start, row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bout FROM g),
    s AS (SELECT session_id, bout, min(start) AS onset, max(stop) AS off_ FROM b GROUP BY ALL)"""


@query(_VMI + """, r AS (SELECT s.session_id, s.bout, count(*) FILTER (k.t >= onset - 2000 AND k.t < onset) / 2000.0 AS base, count(*) FILTER (k.t >= onset AND k.t <= off_) / (any_value(off_) - any_value(onset)) AS inside
        FROM s LEFT JOIN spikes k ON k.session_id = s.session_id AND k.t >= onset - 2000 AND k.t <= off_ GROUP BY s.session_id, s.bout)
    SELECT session_id, count(*) AS n_bouts, round(avg(base), 6) AS base, round(avg(inside), 6) AS inside, round((avg(inside) - avg(base)) / CASE WHEN avg(inside) + avg(base) = 0 THEN NULL ELSE avg(inside) + avg(base) END, 6) AS vmi FROM r GROUP BY session_id""")
def vocal_modulation_index(spark: SparkSession, sf: str) -> DataFrame:
    """Rates before and inside bouts, by counting both windows in one pass of order."""
    from sonolith.operators import points as P

    b = I.bout_summary(I.detect_bouts(A.calls(spark, sf).where("sex = 'male'"), 2.0)).select("session_id", "bout", "onset", "offset")
    w = b.select("session_id", (F.col("bout") * 2).alias("window_id"), (F.col("onset") - 2000).alias("low"), F.col("onset").alias("high"))
    v = b.select("session_id", (F.col("bout") * 2 + 1).alias("window_id"), F.col("onset").alias("low"), F.col("offset").alias("high"))
    sp = A.spikes(spark, sf)
    before = P.count_in_windows(sp, w, ("session_id",)).select("session_id", F.floor(F.col("window_id") / 2).alias("bout"), (F.col("n") / F.lit(2000.0)).alias("base"))
    inside = P.count_in_windows(sp, v, ("session_id",), closed=True).select("session_id", F.floor(F.col("window_id") / 2).alias("bout"), F.col("n").alias("n_in"))
    r = b.join(before, ["session_id", "bout"]).join(inside, ["session_id", "bout"]).withColumn("inside", S.float_ratio(F.col("n_in"), F.col("offset") - F.col("onset")))  # a bout may last no time
    agg = r.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_bouts"), F.avg("base").alias("base"), F.avg("inside").alias("inside"))
    return agg.select("session_id", "n_bouts", r6("base").alias("base"), r6("inside").alias("inside"), r6(S.ratio(F.col("inside") - F.col("base"), F.col("inside") + F.col("base"))).alias("vmi"))


# triage

_VALID = TRIAGE + ", v AS (SELECT * FROM triage WHERE n_bouts >= 10 AND p IS NOT NULL)"


@query(TRIAGE + " SELECT session_id, CASE WHEN n_bouts >= 10 AND p < 0.01 THEN CASE WHEN vmi > 0 THEN 'excited' WHEN vmi < 0 THEN 'suppressed' END END AS flag, count(*) AS n FROM triage GROUP BY ALL")
def modulation_flags(spark: SparkSession, sf: str) -> DataFrame:
    flag = G.modulation_flag(F.col("vmi"), F.col("p"), F.col("n_bouts"))
    return A.triage(spark, sf).groupBy("session_id", flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(_VALID + """, r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY abs(vmi) DESC, test_id, line, vmi DESC, session_id DESC) AS k FROM v)
    SELECT unit_id, round(vmi, 6) AS vmi, session_id, p < 0.01 AS significant FROM r WHERE k = 1""")
def best_session_per_unit(spark: SparkSession, sf: str) -> DataFrame:
    return G.best_session(A.triage(spark, sf)).withColumn("vmi", r6("vmi"))


@query(_VALID + """ SELECT unit_id, round(median(vmi) FILTER (condition = 'A'), 6) AS median_a, round(median(vmi) FILTER (condition = 'R'), 6) AS median_b, bool_or(p < 0.01) AS any_significant, round(median(rate), 6) AS median_rate
    FROM v WHERE condition IN ('A', 'R') GROUP BY unit_id HAVING count(*) FILTER (condition = 'A') > 0 AND count(*) FILTER (condition = 'R') > 0""")
def condition_medians(spark: SparkSession, sf: str) -> DataFrame:
    c = G.condition_medians(A.triage(spark, sf), "A", "R")
    return c.withColumns({x: r6(x) for x in ("median_a", "median_b", "median_rate")})


@query(_VALID + """, s AS (SELECT unit_id, session_id, max(abs(vmi)) AS top, bool_or(p < 0.01) AS sig FROM v GROUP BY ALL)
    SELECT unit_id, count(*) AS n_tested, count(*) FILTER (sig) AS n_sig, round(avg(top), 6) AS mean_top, round(count(*) FILTER (sig) / count(*)::DOUBLE, 6) AS share FROM s GROUP BY unit_id HAVING count(*) >= 3""")
def modulation_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return G.consistency(A.triage(spark, sf), 3).withColumns({"mean_top": r6("mean_top"), "share": r6("share")})


@query(_VALID + """, u AS (SELECT unit_id, count(DISTINCT session_id) AS n, coalesce(bool_or(p < 0.01 AND vmi > 0), false) AS pos, coalesce(bool_or(p < 0.01 AND vmi < 0), false) AS neg FROM v GROUP BY unit_id)
    SELECT CASE WHEN pos AND neg THEN 'both' WHEN pos THEN 'positive_only' WHEN neg THEN 'negative_only' ELSE 'never' END AS kind, count(*) AS n FROM u WHERE n >= 2 GROUP BY ALL""")
def sign_flip_tally(spark: SparkSession, sf: str) -> DataFrame:
    return G.sign_flips(A.triage(spark, sf), 2).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_VALID + """, u AS (SELECT unit_id, max(vmi) FILTER (p < 0.01 AND vmi > 0) AS top, min(vmi) FILTER (p < 0.01 AND vmi < 0) AS low, median(vmi) AS mid FROM v GROUP BY unit_id)
    SELECT unit_id, round(CASE WHEN top IS NOT NULL AND low IS NOT NULL THEN CASE WHEN top >= -low THEN top ELSE low END ELSE coalesce(top, low, mid) END, 6) AS vmi FROM u""")
def index_per_unit(spark: SparkSession, sf: str) -> DataFrame:
    return G.unit_index(A.triage(spark, sf)).withColumn("vmi", r6("vmi"))


@query(TRIAGE + """, s AS (SELECT unit_id, rate / 1000 AS peak FROM triage WHERE p < 0.03), k AS (SELECT unit_id, peak, count(*) OVER (PARTITION BY unit_id ORDER BY peak RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS k FROM s)
    SELECT unit_id, max(k) AS k, count(*) AS n_sig, round(median(peak), 6) AS median_peak FROM k GROUP BY unit_id HAVING count(*) >= 2 AND max(k) >= 2 AND max(k) / count(*)::DOUBLE > 0.5""")
def consistent_peaks(spark: SparkSession, sf: str) -> DataFrame:
    t = A.triage(spark, sf).where("p < 0.03").select("unit_id", (F.col("rate") / 1000).alias("peak"))
    return G.consistent_peak(t, 15.0, 2).withColumn("median_peak", r6("median_peak"))


@query(TRIAGE + """, f AS (SELECT unit_id, bool_or(condition = 'A' AND p < 0.01) AS pose, bool_or(condition = 'N' AND p < 0.01) AS movement, bool_or(condition = 'R' AND p < 0.01) AS dyadic FROM triage GROUP BY unit_id)
    SELECT CASE WHEN NOT pose AND NOT movement AND NOT dyadic THEN 'none' ELSE array_to_string(list_filter([CASE WHEN pose THEN 'pose' END, CASE WHEN movement THEN 'movement' END, CASE WHEN dyadic THEN 'dyadic' END], lambda x: x IS NOT NULL), '+') END AS tier, count(*) AS n FROM f GROUP BY ALL""")
def behavioural_tiers(spark: SparkSession, sf: str) -> DataFrame:
    sig = F.col("p") < 0.01
    f = A.triage(spark, sf).groupBy("unit_id").agg(*[F.bool_or((F.col("condition") == c) & sig).alias(n) for c, n in (("A", "pose"), ("N", "movement"), ("R", "dyadic"))])
    return f.groupBy(G.tier(F.col("pose"), F.col("movement"), F.col("dyadic")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(TRIAGE + """, u AS (SELECT unit_id, condition, max(abs(vmi)) AS top, median(rate) AS mid, min(p) AS low FROM triage GROUP BY ALL)
    SELECT condition, count(*) AS n_units, round(avg(top), 6) AS top, round(median(mid), 6) AS mid, round(min(low), 6) AS low FROM u GROUP BY condition""")
def modality_rollup(spark: SparkSession, sf: str) -> DataFrame:
    u = A.triage(spark, sf).groupBy("unit_id", "condition").agg(F.max(F.abs("vmi")).alias("top"), F.median("rate").alias("mid"), F.min("p").alias("low"))
    return u.groupBy("condition").agg(F.count(F.lit(1)).alias("n_units"), r6(F.avg("top")).alias("top"), r6(F.median("mid")).alias("mid"), r6(F.min("low")).alias("low"))


@query(TRIAGE + """, d AS (SELECT unit_id, session_id, count(*) AS n_units FROM triage WHERE n_bouts >= 10 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n_units DESC, session_id) AS k FROM d)
    SELECT unit_id, session_id, n_units FROM r WHERE k = 1""")
def best_recording_day(spark: SparkSession, sf: str) -> DataFrame:
    d = A.triage(spark, sf).where("n_bouts >= 10").groupBy("unit_id", "session_id").agg(F.count(F.lit(1)).alias("n_units"))
    b = d.groupBy("unit_id").agg(F.max(F.struct("n_units", (-F.col("session_id")).alias("s"))).alias("b"))
    return b.select("unit_id", (-F.col("b.s")).alias("session_id"), F.col("b.n_units").alias("n_units"))


@query("""WITH r AS (SELECT l_partkey, l_suppkey % 7 AS s, round(count(*) / 13.7, 3) AS rate, 'probe' || (l_partkey % 2) AS stage FROM lineitem GROUP BY ALL)
    SELECT l_partkey AS unit_id, round(median(rate), 6) AS rate, count(*) AS n_sessions, array_to_string(list_sort(list(CAST(s AS VARCHAR))), ',') AS sessions, CASE WHEN count(DISTINCT stage) = 1 THEN min(stage) END AS stage FROM r GROUP BY l_partkey""")
def cross_session_rates(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("unit_id"), (F.col("l_suppkey") % 7).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    r = li.withColumns({"rate": F.round(F.col("n") / F.lit(13.7), 3), "stage": F.concat(F.lit("probe"), (F.col("unit_id") % 2).cast("string"))})
    return r.groupBy("unit_id").agg(
        r6(F.median("rate")).alias("rate"), F.count(F.lit(1)).alias("n_sessions"), F.array_join(F.sort_array(F.collect_list(F.col("s").cast("string"))), ",").alias("sessions"), F.when(F.count_distinct("stage") == 1, F.min("stage")).alias("stage")
    )


# scores

_TOP = PRED + ", t AS (SELECT *, greatest(p0, p1, p2) AS confidence, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS y_hat FROM predictions)"
P3 = ["p0", "p1", "p2"]


@query(PRED + " SELECT fold, round(avg((p0 - (y = 0)::INT) ** 2 + (p1 - (y = 1)::INT) ** 2 + (p2 - (y = 2)::INT) ** 2), 6) AS brier FROM predictions GROUP BY fold")
def brier_score(spark: SparkSession, sf: str) -> DataFrame:
    return K.brier(A.predictions(spark, sf), P3, "y", ("fold",)).withColumn("brier", r6("brier"))


@query(_TOP + f""", b AS (SELECT *, {_bin('confidence', 0, 1, 10)} AS bin FROM t), n AS (SELECT fold, count(*) AS n FROM t GROUP BY fold),
    g AS (SELECT fold, bin, count(*) AS k, avg((y = y_hat)::INT) AS acc, avg(confidence) AS conf FROM b WHERE bin IS NOT NULL GROUP BY ALL) SELECT fold, round(sum(abs(acc - conf) * k / n), 6) AS ece FROM g JOIN n USING (fold) GROUP BY fold""")
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return K.calibration_error(K.top_label(A.predictions(spark, sf), P3), 10, ("fold",)).withColumn("ece", r6("ece"))


@query(_TOP + ", g AS (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS y_hat FROM range(4) x(a), range(4) z(b)), c AS (SELECT y, y_hat, count(*) AS n FROM t GROUP BY ALL) SELECT y, y_hat, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (y, y_hat)")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return K.confusion(K.top_label(A.predictions(spark, sf), P3), [0, 1, 2, 3])


@query(_TOP + """, c AS (SELECT fold, y, y_hat, count(*)::DOUBLE AS n FROM t GROUP BY ALL), k AS (SELECT fold, k, coalesce(sum(n) FILTER (y = k), 0) AS tk, coalesce(sum(n) FILTER (y_hat = k), 0) AS pk, coalesce(sum(n) FILTER (y = k AND y_hat = k), 0) AS ck FROM c, range(3) r(k) GROUP BY ALL),
    s AS (SELECT fold, sum(ck) AS c, sum(tk) AS s, sum(tk * pk) AS tp, sum(tk * tk) AS tt, sum(pk * pk) AS pp FROM k GROUP BY fold)
    SELECT fold, round(CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0 ELSE (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) END, 6) AS mcc FROM s""")
def matthews_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return K.matthews(K.top_label(A.predictions(spark, sf), P3), ("fold",)).withColumn("mcc", r6("mcc"))


@query(FRAMES + " SELECT session_id, round(corr(speed, distance), 6) AS r FROM frames GROUP BY session_id")
def pearson_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return K.pearson(A.frames(spark, sf), "speed", "distance", ("session_id",)).withColumn("r", r6("r"))


@query(FRAMES + """, k AS (SELECT session_id, rank() OVER (PARTITION BY session_id ORDER BY speed) + (count(*) OVER (PARTITION BY session_id, speed) - 1) / 2.0 AS a, rank() OVER (PARTITION BY session_id ORDER BY distance) + (count(*) OVER (PARTITION BY session_id, distance) - 1) / 2.0 AS b FROM frames)
    SELECT session_id, round(corr(a, b), 6) AS rho FROM k GROUP BY session_id""")
def spearman_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return K.spearman(A.frames(spark, sf), "speed", "distance", ("session_id",)).withColumn("rho", r6("rho"))


@query(FRAMES + " SELECT session_id, round(sqrt(avg((speed - distance) ** 2)), 6) AS rmse, round(avg(abs(speed - distance)), 6) AS mae FROM frames GROUP BY session_id")
def regression_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = K.errors(F.col("speed"), F.col("distance"))
    return A.frames(spark, sf).groupBy("session_id").agg(*[r6(v).alias(k) for k, v in e.items()])


@query(CALLS + """, g AS (SELECT session_id, count(*) FILTER (sex = 'male') AS na, count(*) FILTER (sex = 'female') AS nb, avg(duration) FILTER (sex = 'male') AS ma, avg(duration) FILTER (sex = 'female') AS mb, var_samp(duration) FILTER (sex = 'male') AS va, var_samp(duration) FILTER (sex = 'female') AS vb FROM calls GROUP BY session_id)
    SELECT session_id, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM g""")
def cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    return K.cohens_d(A.calls(spark, sf), "duration", "sex", "male", "female", ("session_id",)).withColumn("d", r6("d"))


@query(CALLS + """, x AS (SELECT session_id, sex, rank() OVER (PARTITION BY session_id ORDER BY duration) + (count(*) OVER (PARTITION BY session_id, duration) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY session_id, duration) AS t FROM calls WHERE sex <> 'unassigned'),
    a AS (SELECT session_id, count(*) FILTER (sex = 'male') AS na, count(*) FILTER (sex <> 'male') AS nb, sum(r) FILTER (sex = 'male') AS ra, sum(t::DOUBLE * t - 1) AS ties FROM x GROUP BY session_id)
    SELECT session_id, na, nb, round(ra - na * (na + 1) / 2, 4) AS u, round((ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 6) AS z FROM a""")
def mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    m = K.mann_whitney(A.calls(spark, sf).where("sex <> 'unassigned'"), "duration", "sex", "male", ("session_id",))
    return m.select("session_id", "na", "nb", r6("u", 4).alias("u"), r6("z").alias("z"))


@query(CALLS + """, g AS (SELECT category, sex, count(*) AS n, avg(duration) AS m, var_pop(duration) AS v FROM calls GROUP BY ALL), t AS (SELECT *, sum(n * m) OVER (PARTITION BY category) / sum(n) OVER (PARTITION BY category) AS gm FROM g),
    s AS (SELECT category, sum(n * (m - gm) ** 2) AS ssb, sum(n * v) AS ssw, count(*) AS k, sum(n) AS n FROM t GROUP BY category)
    SELECT category, k, CAST(n AS BIGINT) AS n, round(ssb / (k - 1) / (ssw / (n - k)), 6) AS f, round((ssb - (k - 1) * (ssw / (n - k))) / (ssb + ssw + ssw / (n - k)), 6) AS omega2 FROM s""")
def one_way_anova(spark: SparkSession, sf: str) -> DataFrame:
    return K.anova(A.calls(spark, sf), "duration", "sex", ("category",)).withColumns({"f": r6("f"), "omega2": r6("omega2"), "n": F.col("n").cast("long")})


@query(PRED + " SELECT vec_id, round(p2, 6) AS q0, 0.0::DOUBLE AS q1, round(p0, 6) AS q2, round(p1, 6) AS q3 FROM predictions")
def aligned_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    a = K.align_probabilities(F.array(F.lit(4), F.lit(9), F.lit(1)), F.array("p0", "p1", "p2"), [1, 3, 4, 9])
    return A.predictions(spark, sf).select("vec_id", a.alias("a")).select("vec_id", *[r6(F.col("a")[i]).alias(f"q{i}") for i in range(4)])


# points on a torus



def _td(a: str, b: str) -> str:
    return f"(({a} - {b}) - 6 * round_even(({a} - {b}) / 6, 0))"


_DIST = f"sqrt({_td('px', 'x')} ** 2 + {_td('py', 'y')} ** 2)"


@query(POINTS + f" SELECT vec_id, round({_DIST}, 6) AS d, round({_td('x', 'px')}, 6) AS dx, sqrt({_td('x', '2.0')} ** 2 + {_td('y', '3.0')} ** 2) <= 1.5 AS inside FROM points")
def torus_distances(spark: SparkSession, sf: str) -> DataFrame:
    c = [F.col(x) for x in ("x", "y", "px", "py")]
    return A.points(spark, sf).select("vec_id", r6(S.torus_distance(*c, PERIOD)).alias("d"), r6(S.torus_difference(c[0], c[2], PERIOD)).alias("dx"), M.in_circle(c[0], c[1], 2.0, 3.0, 1.5, PERIOD).alias("inside"))


_MEAN = "((6 / (2 * pi())) * atan2(sum(sin({x} * 2 * pi() / 6)), sum(cos({x} * 2 * pi() / 6))))"


def _circ(x: str) -> str:
    m = _MEAN.replace("{x}", x)
    return f"({m} - 6 * floor({m} / 6))"


@query(POINTS + f" SELECT label, round({_circ('x')}, 5) AS mx, round({_circ('y')}, 5) AS my FROM points GROUP BY label")
def circular_means(spark: SparkSession, sf: str) -> DataFrame:
    return A.points(spark, sf).groupBy("label").agg(r6(M.circular_mean(F.col("x"), PERIOD), 5).alias("mx"), r6(M.circular_mean(F.col("y"), PERIOD), 5).alias("my"))


@query(POINTS + f""", m AS (SELECT label, {_circ('x')} AS mx, {_circ('y')} AS my FROM points GROUP BY label), d AS (SELECT label, sum({_td('x', 'mx')} ** 2 + {_td('y', 'my')} ** 2) AS dispersion FROM points JOIN m USING (label) GROUP BY label),
    e AS (SELECT label, avg({_DIST}) AS mae, sqrt(avg({_DIST} ** 2)) AS rmse, avg(abs({_td('px', 'x')})) AS mae_x, avg(abs({_td('py', 'y')})) AS mae_y, sum({_DIST} ** 2) AS ss FROM points GROUP BY label)
    SELECT label, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(mae_x, 5) AS mae_x, round(mae_y, 5) AS mae_y, round(CASE WHEN dispersion > 0 THEN 1 - ss / dispersion ELSE 0 END, 5) AS r2 FROM e JOIN d USING (label)""")
def manifold_errors(spark: SparkSession, sf: str) -> DataFrame:
    return M.prediction_errors(A.points(spark, sf), ["label"], PERIOD).withColumns({c: r6(c, 5) for c in ("mae", "rmse", "mae_x", "mae_y", "r2")})


@query(POINTS + f""", l AS (SELECT label, 2.5 * (cos({_td('px', 'x')} * 2 * pi() / 6) + cos({_td('py', 'y')} * 2 * pi() / 6)) - 2 * (ln(2 * pi()) + {S.log_bessel_i0(2.5)!r}) AS ld FROM points), g AS (SELECT label, avg(ld) AS m, count(*) AS n FROM l GROUP BY label)
    SELECT count(*) AS n_regions, round(avg(m), 6) AS macro FROM g WHERE n >= 5""")
def macro_von_mises_score(spark: SparkSession, sf: str) -> DataFrame:
    p = A.points(spark, sf)
    g = p.select("label", M.von_mises_log_density(p, PERIOD, 2.5).alias("ld")).groupBy("label").agg(F.avg("ld").alias("m"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 5").agg(F.count(F.lit(1)).alias("n_regions"), r6(F.avg("m")).alias("macro"))


@query(POINTS + f""", d AS (SELECT a.vec_id, b.vec_id AS other, sqrt({_td('a.x', 'b.x')} ** 2 + {_td('a.y', 'b.y')} ** 2) AS d FROM points a JOIN points b ON a.vec_id <> b.vec_id)
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS INTEGER) AS rank, round(d, 6) AS d FROM d QUALIFY rank <= 5""")
def torus_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return M.nearest_neighbours(A.points(spark, sf), 5, PERIOD).select("vec_id", "rank", r6("d").alias("d"))


@query(POINTS + f""", c AS (SELECT label, avg(x) AS x, avg(y) AS y FROM points GROUP BY label), d AS (SELECT a.label, min(sqrt({_td('a.x', 'b.x')} ** 2 + {_td('a.y', 'b.y')} ** 2)) AS d FROM c a JOIN c b ON a.label <> b.label GROUP BY a.label)
    SELECT label, round(least(d * 0.4, 0.5), 6) AS radius FROM d""")
def cluster_radii(spark: SparkSession, sf: str) -> DataFrame:
    c = A.points(spark, sf).groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return M.centre_radii(c, 0.8, "adaptive", PERIOD, 0.5).withColumn("radius", r6("radius"))


def _snap(v: str) -> str:
    return f"((round_even({v} / 6 * 12 - 0.5, 0) + 12) % 12)"


@query(POINTS + f", s AS (SELECT CAST({_snap('x')} * 12 + {_snap('y')} AS BIGINT) AS cell FROM points) SELECT cell, count(*) AS n FROM s GROUP BY cell")
def snapped_cells(spark: SparkSession, sf: str) -> DataFrame:
    return A.points(spark, sf).groupBy(M.snap(F.col("x"), F.col("y"), 12, PERIOD).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(POINTS + f""", s AS (SELECT label % 4 AS label, CAST({_snap('x')} * 12 + {_snap('y')} AS BIGINT) AS cell FROM points), g0 AS (SELECT label, cell, count(*) AS n FROM s GROUP BY label, cell), g AS (SELECT label, cell, n / sum(n) OVER (PARTITION BY label) AS p FROM g0),
    c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY label ORDER BY p DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT label, cell, round(p, 8) AS p FROM c WHERE round(b, 9) < 0.5""")
def confidence_set(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    s = A.points(spark, sf).groupBy((F.col("label") % 4).alias("label"), M.snap(F.col("x"), F.col("y"), 12, PERIOD).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    g = s.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("label")))
    return M.densest_cells(g, 0.5 - 5e-10, ("label",)).select("label", "cell", F.round("p", 8).alias("p"))


@query("WITH u AS (SELECT l_partkey, l_suppkey % 40 AS y, l_discount * 10 - 0.3 AS w FROM lineitem) SELECT l_partkey AS unit_id, round(sum(y * greatest(w, 0) ** 2) / CASE WHEN sum(greatest(w, 0) ** 2) = 0 THEN NULL ELSE sum(greatest(w, 0) ** 2) END, 6) AS depth FROM u GROUP BY l_partkey")
def spike_depths(spark: SparkSession, sf: str) -> DataFrame:
    u = A.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("unit_id"), (F.col("l_suppkey") % 40).alias("y"), (F.col("l_discount") * 10 - 0.3).alias("w"))
    return M.weighted_depth(u, ["unit_id"], "y", "w").withColumn("depth", r6("depth"))
