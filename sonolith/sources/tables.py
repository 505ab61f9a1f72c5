"""Readers and writers: session CSVs with file order, detections, catalogs, archives, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.functions.strings import zero_padded

EVENT_SCHEMA = "usv_id string, start double, stop double, duration double, peak_amp_ch double, mean_amp_ch double, chs_count double, chs_detected string, emitter string"
INTERVAL_SCHEMA = "session_id string, source_list string, interval_type string, sex string, interval_s double, log_interval double, male_id string, female_id string"


def read_events_csv(spark: SparkSession, paths: str | list[str], schema: str = EVENT_SCHEMA, sep: str = ",") -> DataFrame:
    """Event files with session_id (the folder) and row_idx, the place of a row in its file.

    Spark gives lines of a file in order of its splits, whose starts are in the file's metadata, so
    the ordinal is a count inside the file and not over all of them. Files must not be compressed.
    """
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).csv(paths)
    at = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    at = at.withColumns({"__line": F.monotonically_increasing_id(), "session_id": F.regexp_extract("__file", "([^/]+)/[^/]+$", 1)})
    w = Window.partitionBy("__file").orderBy("__block", "__line")
    return at.withColumn("row_idx", (F.row_number().over(w) - 1).cast("long")).drop("__file", "__block", "__line")


def read_detections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per-channel detections without noise, the channel taken from the file's name (``..._ch07...``)."""
    rows = spark.read.schema("name string, start_seconds double, stop_seconds double").option("header", True).csv(paths)
    channel = F.regexp_extract(F.input_file_name(), r"_ch(\d+)", 1).cast("int")
    return rows.withColumn("channel", channel).where(F.coalesce(F.col("name") != "noise", F.lit(True))).select(F.col("start_seconds").alias("start"), F.col("stop_seconds").alias("stop"), "channel")


def event_summary(merged: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Events with an id of four digits by their order, duration, and no emitter yet."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    return merged.withColumns({"usv_id": zero_padded(F.row_number().over(w) - 1), "duration": F.col("stop") - F.col("start"), "emitter": F.lit(None).cast("string")})


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A unit catalog, all columns as strings."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def has_session(catalog: DataFrame, **key: str) -> bool:
    """Whether the catalog has a row with these values."""
    for k, v in key.items():
        catalog = catalog.where(F.col(k) == v)
    return bool(catalog.limit(1).count())


def read_session_lists(spark: SparkSession, paths: list[str], comments: bool = False) -> DataFrame:
    """(session, source_list) of list files: blank lines go, a session belongs to the first list it is in.

    ``comments``: lines that begin with # go as well.
    """
    order = spark.createDataFrame([(i, p.rsplit("/", 1)[-1]) for i, p in enumerate(paths)], "list_no int, source_list string")
    lines = spark.read.text(paths).select(F.trim("value").alias("session"), F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("source_list"), F.monotonically_increasing_id().alias("line"))
    lines = lines.where(F.length("session") > 0)
    if comments:
        lines = lines.where(~F.col("session").startswith("#"))
    first = lines.join(F.broadcast(order), "source_list").groupBy("session").agg(F.min(F.struct("list_no", "line", "source_list")).alias("f"))  # a row a file
    return first.select("session", F.col("f.source_list").alias("source_list"))


def write_archive(tables: dict[str, DataFrame], folder: str, attributes: dict[str, str], partition: str = "interval_type") -> None:
    """Each table as a Parquet data set, cut by mode where it has one, and the attributes as a table beside them."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition) if partition in df.columns else w).parquet(f"{folder}/{name}")
        spark = df.sparkSession
    spark.createDataFrame(sorted(attributes.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/attributes")


def read_archive(spark: SparkSession, folder: str, name: str, mode: str | None = None) -> DataFrame:
    """A table of the archive, or only its rows of one mode (other modes' files are not read)."""
    df = spark.read.parquet(f"{folder}/{name}")
    return df if mode is None else df.where(F.col("interval_type") == mode)


def selected_k(spark: SparkSession, folder: str, fits: DataFrame, key: str = "sex") -> DataFrame:
    """K of each key from the archive's attributes (``K_<key>``), else the fits' own column."""
    attrs = spark.read.parquet(f"{folder}/attributes").where(F.col("key").startswith("K_")).select(F.substring("key", 3, 64).alias(key), F.col("value").cast("int").alias("__k"))
    own = fits.groupBy(key).agg(F.max("k_selected").alias("__own"))
    return own.join(attrs, key, "left").select(key, F.coalesce("__k", "__own").alias("k_selected"))


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The greatest path of a pattern; names carry their time."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(f.getPath().toString() for f in found) if found else []
    return names[-1] if names else None


def read_sensor_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sensor logs as JSON lines: time, illumination, humidity, temperature."""
    schema = T.StructType([T.StructField("sensor_time", T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in ("lux", "hum", "temp")]])
    return spark.read.schema(schema).json(paths).select(F.col("sensor_time").alias("t"), F.col("lux").alias("illumination"), F.col("hum").alias("humidity"), F.col("temp").alias("temperature"))


def changepoints(samples: DataFrame, order: str, n: str) -> DataFrame:
    """Where each recording begins and ends when all are laid end to end; a row a recording."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("end_sample", F.sum(n).over(w)).withColumn("first_sample", F.col("end_sample") - F.col(n))


def cached_parquet(spark: SparkSession, path: str, required: list[str], build, rebuild: bool = False) -> DataFrame:
    """The table at the path if it has the required columns, else it is built and written there first."""
    if not rebuild:
        try:
            df = spark.read.parquet(path)
            if set(required) <= set(df.columns):
                return df
        except Exception as e:  # no table there
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_provenance(rows: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows with a hash of their provenance without the ignored top-level keys; equal hashes mean equal blocks."""
    kept = F.map_filter("provenance", lambda k, _: ~k.isin(*ignore))
    return rows.withColumn("provenance_hash", F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256))
