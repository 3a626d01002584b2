"""Session factory with settings that hold from one machine to a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cadenza", **settings: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; ``settings`` override, with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
