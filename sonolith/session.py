"""Spark sessions with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed partitions and picks broadcast sides by measured size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(app: str = "sonolith", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; further ones by name, dots as ``__``."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()
