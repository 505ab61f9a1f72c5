"""Streaming queries, run to the end of their input, and readers over it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith import adapters as A
from sonolith.operators import relational as R
from sonolith.plans.registry import query
from sonolith.streaming import events as S


def _work_dir(spark: SparkSession) -> str:
    """A folder that all executors reach: that of checkpoints; without one the warehouse, but only where Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once all that is there now has gone through it, from a written table."""
    spark = stream.sparkSession
    base = _work_dir(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    glob = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(glob[0] + "/{events.parquet}").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = drained(S.windowed_counts(_raw(spark, sf), "1 hour"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, CAST(2 * count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_hopping_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every event lies in two windows of an hour that begin each half hour."""
    out = drained(S.windowed_counts(_raw(spark, sf), "1 hour", "30 minutes"), "complete")
    return out.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, count(DISTINCT k) AS n_sessions, count(*) AS n FROM k GROUP BY user_id""")
def stream_gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = drained(S.gap_sessions(_raw(spark, sf), "2 hours"), "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n"))


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    """The calls with their places, written once, as a stream of files."""
    base = _work_dir(spark)
    A.calls(spark, sf).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    return spark.readStream.schema(schema).parquet(f"{base}/in")


@query(A.with_sql("calls") + """, l AS (SELECT session_id, row_idx, sex, lag(sex) OVER w AS s0, start - lag(stop) OVER w AS i FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY row_idx))
    SELECT CAST(session_id AS VARCHAR) AS session, sex, count(*) AS n, round(avg(i), 6) AS mean_s FROM l WHERE sex = s0 AND sex <> 'unassigned' GROUP BY ALL""")
def stream_intervals(spark: SparkSession, sf: str) -> DataFrame:
    out = drained(S.streaming_intervals(_ordered(spark, sf)))
    return out.groupBy("session", "sex").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("interval_s"), 6).alias("mean_s"))


@query(A.with_sql("calls") + """, g AS (SELECT *, CASE WHEN start - lag(stop) OVER w > 60 THEN 1 ELSE 0 END AS n FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY start, row_idx)),
    b AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY start, row_idx ROWS UNBOUNDED PRECEDING) AS bout FROM g), s AS (SELECT session_id, bout, min(start) AS onset, max(stop) AS off_, count(*) AS n_calls FROM b GROUP BY ALL)
    SELECT CAST(session_id AS VARCHAR) AS session, round(onset, 6) AS onset, round(off_, 6) AS offset_s, n_calls FROM s QUALIFY bout < max(bout) OVER (PARTITION BY session_id)""")
def stream_bouts(spark: SparkSession, sf: str) -> DataFrame:
    """All bouts of a session but the last, which is still open."""
    out = drained(S.streaming_bouts(_ordered(spark, sf), 60.0))
    return out.select("session", F.round("onset", 6).alias("onset"), F.round("offset", 6).alias("offset_s"), "n_calls")


@query("SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS version FROM nation")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog replaced slice by slice, as batches of a stream would."""
    base = _work_dir(spark)
    n = A.table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.lit("old").alias("version"))
    run = S.upsert_batches(base, ["n_regionkey"])
    run(n, 0)
    run(n.where("n_regionkey = 1").withColumn("version", F.lit("new")), 1)
    return spark.read.parquet(base).withColumn("n_regionkey", F.col("n_regionkey").cast("int"))


@query(A.with_sql("events_m") + " SELECT CAST(session_id AS VARCHAR) AS session_id, count(*) AS n, max(row_idx) AS last_row FROM events_m GROUP BY session_id")
def csv_file_order(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as a CSV a session and read again with their places in the files."""
    from sonolith.sources import tables as Q

    base = _work_dir(spark)
    e = A.events(spark, sf)
    rows = e.select(F.col("session_id").cast("string").alias("day"), F.col("event_id").cast("string").alias("usv_id"), "start", "stop", "duration", F.lit(None).cast("double").alias("peak_amp_ch"), F.lit(None).cast("double").alias("mean_amp_ch"), F.lit(1.0).alias("chs_count"), F.lit("[]").alias("chs_detected"), "sex", "row_idx")
    rows.repartition("day").sortWithinPartitions("day", "row_idx").drop("row_idx").write.partitionBy("day").option("header", True).csv(f"{base}/csv")
    back = Q.read_events_csv(spark, f"{base}/csv/*")
    day = F.regexp_replace("session_id", "^day=", "")
    return back.groupBy(day.alias("session_id")).agg(F.count(F.lit(1)).alias("n"), F.max("row_idx").alias("last_row"))


@query(A.with_sql("calls") + """, l AS (SELECT session_id, sex, start - lag(start) OVER w AS i, sex = lag(sex) OVER w AS same FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY row_idx))
    SELECT sex, count(*) AS n, round(sum(ln(i)), 4) AS total FROM l WHERE same AND sex <> 'unassigned' AND i > 0 GROUP BY sex""")
def archive_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals written to an archive by mode, one mode read again."""
    from sonolith.operators import intervals as I
    from sonolith.sources import tables as Q

    base = f"{_work_dir(spark)}/ivi_20240101_000000"
    calls = A.calls(spark, sf)
    both = [I.same_emitter_intervals(calls, m).where("not dropped").select("session_id", "sex", "interval_s", "log_interval", F.lit(m).alias("interval_type")) for m in ("s2s", "e2s")]
    Q.write_archive({"intervals": R.stack(*both)}, base, {"K_male": "3"})
    found = Q.latest(spark, base[: -len("20240101_000000")] + "*")
    return Q.read_archive(spark, found, "intervals", "s2s").groupBy("sex").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("log_interval"), 4).alias("total"))
