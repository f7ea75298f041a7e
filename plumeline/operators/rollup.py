"""Rollups for dashboards and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily(rows: DataFrame) -> DataFrame:
    """Points, last time and mean of each source, metric, unit and day. Units stay apart: one metric may come in several."""
    return rows.groupBy("source", "metric", "unit", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_at"), F.avg("value").alias("mean_value"))


def source_health(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source").agg(F.max("at").alias("last_at"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.count(F.lit(1)).alias("n_runs"))


def cube(anomalies: DataFrame) -> DataFrame:
    """Counts by metric and severity, each and together, with totals (null)."""
    return anomalies.cube("metric", "severity").agg(F.count(F.lit(1)).alias("n"))


def cells(rows: DataFrame, degrees: float) -> DataFrame:
    return rows.withColumn("cell_lat", F.floor(F.col("lat") / degrees)).withColumn("cell_lon", F.floor(F.col("lon") / degrees))


def grid_means(rows: DataFrame, degrees: float) -> DataFrame:
    return cells(rows, degrees).groupBy("cell_lat", "cell_lon", "metric", "unit").agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))


def top_cells(rows: DataFrame, degrees: float, k: int) -> DataFrame:
    """The k cells of most rows, ties by place."""
    return cells(rows, degrees).groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cell_lat", "cell_lon").limit(k)


def latest(rows: DataFrame, tie: str) -> DataFrame:
    """The last reading of each entity and metric; no sort, so it combines before the shuffle."""
    return rows.groupBy("source", "source_entity_id", "metric").agg(F.max_by(F.struct("timestamp", "value", "unit", "lat", "lon"), F.struct("timestamp", tie)).alias("r")).select("source", "source_entity_id", "metric", "r.*")


def day_over_day(rows: DataFrame) -> DataFrame:
    """Rows of each metric and day, and the change from the metric's day before that has any."""
    counts = rows.groupBy("metric", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("metric").orderBy("day")))


def series_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_entity_id", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean_value"), F.max_by("value", "timestamp").alias("last_value"), F.count(F.lit(1)).alias("n"))


def top_causes(explanations: DataFrame, k: int, cause: str = "cause", confidence: str = "confidence") -> DataFrame:
    """The k causes named most often, ties by name, with the mean confidence; explanations without a cause do not count."""
    named = explanations.where(F.col(cause).isNotNull()).groupBy(cause).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"))
    return named.orderBy(F.desc("n"), cause).limit(k)
