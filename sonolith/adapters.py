"""The star-schema tables seen as sessions, events, frames, spikes, points and units.

Each adapter has a DuckDB twin in ``SQL`` with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.functions.scalars import sex_of

NOISE = ("error",)
FPS = 150.0
#: Events and orders of a recording: more of them make more recordings, so that none outgrows a task.
EVENTS_EACH, ORDERS_EACH = 10_000, 15_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds_of_day(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.to_date(ts).cast("timestamp_ntz"), ts) / F.lit(1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: session (the day, of a later month for each further EVENTS_EACH events), row_idx, start, stop, emitter, sex, category, value."""
    raw = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    out = raw.select(
        F.date_add(F.to_date("ts"), (F.floor(F.col("event_id") / EVENTS_EACH) * 31).cast("int")).alias("session_id"), "event_id", seconds_of_day(F.col("ts")).alias("start"), F.col("value").alias("duration"),
        "user_id", sex_of(F.col("user_id")).alias("sex"), F.col("event_type").alias("category"), "ts",
    ).withColumn("stop", F.col("start") + F.col("duration"))
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    return out.withColumn("row_idx", (F.row_number().over(order) - 1).cast("long")).drop("ts")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without noise, still in file order."""
    return events(spark, sf_dir).where(~F.col("category").isin(*NOISE))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-sampled features: lines of ORDERS_EACH orders and a tenth of the suppliers, in order of order, as the frames of a session."""
    raw = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10 + F.floor(F.col("l_orderkey") / ORDERS_EACH) * 10).cast("long").alias("session_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("speed"), (F.col("l_discount") * 3600 - 180).alias("yaw"), (F.col("l_extendedprice") / 1000).alias("distance"),
        ((F.col("l_partkey") % 65) - 32).cast("double").alias("space_x"), ((F.col("l_orderkey") % 65) - 32).cast("double").alias("space_y"),
    )
    order = Window.partitionBy("session_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "speed", "distance")
    return raw.withColumn("frame_index", (F.row_number().over(order) - 1).cast("long")).select("session_id", "frame_index", "speed", "yaw", "distance", "space_x", "space_y")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point process: views and clicks of users 0 to 19 of each session, as spikes of units; block numbers the recordings."""
    ev = events(spark, sf_dir).where(F.col("category").isin("view", "click"))
    return ev.select("session_id", (F.col("user_id") % 20).alias("unit_id"), F.col("start").alias("t"), F.floor(F.col("start")).cast("long").alias("frame"), F.floor(F.col("event_id") / EVENTS_EACH).cast("long").alias("block"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a torus of period 6, from the first components of the embeddings."""
    raw = table(spark, sf_dir, "embeddings").where("size(embedding) >= 4")
    x = [F.pmod(F.col("embedding")[i].cast("double") * 3 + 3, F.lit(6.0)) for i in range(4)]
    return raw.select("vec_id", "label", x[0].alias("x"), x[1].alias("y"), x[2].alias("px"), x[3].alias("py"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit catalog: parts as recorded units."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("imec"), (F.col("p_partkey") % 2).cast("string"), F.lit("_cl"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("_ch"), F.lpad((F.col("p_partkey") % 384).cast("string"), 3, "0"), F.when(F.col("p_size") > 25, "_good").otherwise("_mua")).alias("unit_name"),
        F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("mouse_id"), F.col("p_type").alias("area"), F.col("p_size").alias("depth"), F.col("p_retailprice").alias("amplitude"), F.col("p_name").alias("note"),
    )


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested modulation indices: lines as results of a unit (part) in a session (supplier)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("unit_id"), (F.col("l_suppkey") % 7).alias("session_id"), F.col("l_returnflag").alias("condition"),
        (F.col("l_discount") * 20 - 1).alias("vmi"), F.col("l_tax").alias("p"), F.col("l_quantity").cast("long").alias("n_bouts"),
        F.col("l_extendedprice").alias("rate"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_orderkey").alias("test_id"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of three classes with the true class, from the embeddings."""
    raw = table(spark, sf_dir, "embeddings").where("size(embedding) >= 4")
    e = [F.exp(F.col("embedding")[i].cast("double") * 4) for i in range(3)]
    total = e[0] + e[1] + e[2]
    return raw.select("vec_id", F.pmod(F.col("label"), F.lit(3)).cast("int").alias("y"), *[(x / total).alias(f"p{i}") for i, x in enumerate(e)], (F.col("vec_id") % 5).alias("fold"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, without their texts."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))


_SEX = "CASE CAST(user_id % 3 AS INTEGER) WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unassigned' END"
_EVENTS = f"""
events_m AS (
    SELECT CAST(ts AS DATE) + CAST(31 * (event_id // 10000) AS INTEGER) AS session_id, event_id, epoch(ts - date_trunc('day', ts)) AS start, value AS duration, user_id, {_SEX} AS sex,
           event_type AS category, epoch(ts - date_trunc('day', ts)) + value AS stop,
           CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) + CAST(31 * (event_id // 10000) AS INTEGER) ORDER BY ts, event_id) - 1 AS BIGINT) AS row_idx
    FROM events
)"""
SQL = {
    "events_m": _EVENTS,
    "calls": _EVENTS + ", calls AS (SELECT * FROM events_m WHERE category <> 'error')",
    "frames": """
frames AS (
    SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, speed, distance) - 1 AS BIGINT) AS frame_index,
           speed, yaw, distance, space_x, space_y
    FROM (SELECT l_suppkey % 10 + 10 * (l_orderkey // 15000) AS session_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS speed, l_discount * 3600 - 180 AS yaw,
                 l_extendedprice / 1000 AS distance, CAST((l_partkey % 65) - 32 AS DOUBLE) AS space_x, CAST((l_orderkey % 65) - 32 AS DOUBLE) AS space_y FROM lineitem)
)""",
    "spikes": _EVENTS + """, spikes AS (
    SELECT session_id, user_id % 20 AS unit_id, start AS t, CAST(floor(start) AS BIGINT) AS frame, event_id // 10000 AS block FROM events_m WHERE category IN ('view', 'click')
)""",
    "points": """
points AS (
    SELECT vec_id, label, x0 - 6 * floor(x0 / 6) AS x, x1 - 6 * floor(x1 / 6) AS y, x2 - 6 * floor(x2 / 6) AS px, x3 - 6 * floor(x3 / 6) AS py
    FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 3 + 3 AS x0, CAST(embedding[2] AS DOUBLE) * 3 + 3 AS x1,
                 CAST(embedding[3] AS DOUBLE) * 3 + 3 AS x2, CAST(embedding[4] AS DOUBLE) * 3 + 3 AS x3 FROM embeddings WHERE len(embedding) >= 4)
)""",
    "units": """
units AS (
    SELECT 'imec' || (p_partkey % 2) || '_cl' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '_ch' || lpad(CAST(p_partkey % 384 AS VARCHAR), 3, '0')
           || CASE WHEN p_size > 25 THEN '_good' ELSE '_mua' END AS unit_name,
           p_partkey AS unit_id, p_brand AS mouse_id, p_type AS area, p_size AS depth, p_retailprice AS amplitude, p_name AS note FROM part
)""",
    "triage": """
triage AS (
    SELECT l_partkey AS unit_id, l_suppkey % 7 AS session_id, l_returnflag AS condition, l_discount * 20 - 1 AS vmi, l_tax AS p,
           CAST(l_quantity AS BIGINT) AS n_bouts, l_extendedprice AS rate, CAST(l_linenumber AS BIGINT) AS line, l_orderkey AS test_id FROM lineitem
)""",
    "predictions": """
predictions AS (
    SELECT vec_id, CAST(((label % 3) + 3) % 3 AS INTEGER) AS y, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2, vec_id % 5 AS fold
    FROM (SELECT vec_id, label, exp(CAST(embedding[1] AS DOUBLE) * 4) AS e0, exp(CAST(embedding[2] AS DOUBLE) * 4) AS e1, exp(CAST(embedding[3] AS DOUBLE) * 4) AS e2
          FROM embeddings WHERE len(embedding) >= 4)
)""",
    "turns": "turns AS (SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS size FROM conversations)",
}


def with_sql(*names: str) -> str:
    """A WITH clause with the DuckDB twins of these adapters."""
    out: list[str] = []
    for name in names:
        for part in [_EVENTS, SQL[name].removeprefix(_EVENTS + ", ")] if SQL[name].startswith(_EVENTS) and SQL[name] != _EVENTS else [SQL[name]]:
            if part not in out:
                out.append(part)
    return "WITH " + ",".join(out)
