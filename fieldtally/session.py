"""The Spark session this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on (time zone) or that plans rely on (adaptive execution).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[8]", app: str = "fieldtally", **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` overrides them (dots written as ``__``)."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
