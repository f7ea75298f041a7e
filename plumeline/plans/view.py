"""The observation view over the event table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import choice

METRICS = {"click": "pm25", "view": "pm10", "error": "ozone", "signup": "no2", "purchase": "so2"}
SOURCES = ("epa_airnow", "openaq", "purpleair", "openweather", "nasa_firms")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    place = lambda centre, by: F.lit(centre) + ((F.col("user_id") * by) % 201 - 100) * F.lit(0.008)
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        place(34.0515, 37).alias("lat"),
        place(-84.0713, 53).alias("lon"),
        choice(F.col("event_type"), METRICS).alias("metric"),
        "value",
        F.lit("ug/m3").alias("unit"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("user_id") % 5 + 1).cast("int")).alias("source"),
        F.col("user_id").cast("string").alias("source_entity_id"),
        F.col("props").alias("raw_json"),
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, placed by their keys."""
    place = lambda centre, by: F.lit(centre) + ((F.col("s_suppkey") * by) % 301 - 150) * F.lit(0.01)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("facility"), F.col("s_nationkey").alias("nation"), place(34.0515, 41).alias("lat"), place(-84.0713, 67).alias("lon"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each event; errors are failures."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("user_id") % 5 + 1).cast("int")).alias("source"),
        (~failed).alias("success"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.when(failed, 0).otherwise(F.col("event_id") % 50).cast("long").alias("record_count"),
        F.col("value").alias("duration_ms"),
        F.when(failed, F.array(F.lit("timeout"), F.col("props"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


def _source(by: str) -> str:
    return f"CASE {by} % 5 WHEN 0 THEN 'epa_airnow' WHEN 1 THEN 'openaq' WHEN 2 THEN 'purpleair' WHEN 3 THEN 'openweather' ELSE 'nasa_firms' END"


OBS = f"""obs AS (
    SELECT event_id AS id, ts AS timestamp, 34.0515::DOUBLE + ((user_id * 37) % 201 - 100) * 0.008::DOUBLE AS lat, (-84.0713)::DOUBLE + ((user_id * 53) % 201 - 100) * 0.008::DOUBLE AS lon,
        CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'pm10' WHEN 'error' THEN 'ozone' WHEN 'signup' THEN 'no2' WHEN 'purchase' THEN 'so2' END AS metric,
        value, 'ug/m3' AS unit, {_source("user_id")} AS source, user_id::VARCHAR AS source_entity_id, props AS raw_json
    FROM events
)"""
PLACES = """places AS (
    SELECT s_suppkey AS facility, s_nationkey AS nation, 34.0515::DOUBLE + ((s_suppkey * 41) % 301 - 150) * 0.01::DOUBLE AS lat, (-84.0713)::DOUBLE + ((s_suppkey * 67) % 301 - 150) * 0.01::DOUBLE AS lon FROM supplier
)"""
RUNS = f"""runs AS (
    SELECT {_source("user_id")} AS source, event_type <> 'error' AS success, ts AS run_at, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 50 END AS record_count, value AS duration_ms,
        CASE WHEN event_type = 'error' THEN ['timeout', props] ELSE []::VARCHAR[] END AS errors
    FROM events
)"""


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2), 2)"
    return f"2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {a})))"
