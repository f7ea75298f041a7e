"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "plumeline", **more: str) -> SparkSession:
    """The current session, or a new one; master and sizes come from spark-submit."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()
