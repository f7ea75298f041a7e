"""Quality rules of observations, and stale sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BOUNDS, COLLECT_MINUTES, KEY
from ..functions.parse import choice


def with_violations(rows: DataFrame, order: list[str], now=None, minutes: dict[str, int] | None = None) -> DataFrame:
    """Adds violations: schema (a needed field is missing), range (implausible for its metric and unit), duplicate (not the first of its
    key) and stale (older than twice its source's interval; a warning)."""
    place = F.concat_ws("|", "metric", "unit")
    low, high = ({f"{m}|{u}": v[i] for (m, u), v in BOUNDS.items()} for i in (0, 1))
    missing = F.greatest(*[F.col(c).isNull() for c in ("timestamp", "lat", "lon", "metric", "value", "source")])
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    age = F.lit(now).cast("timestamp").cast("long") - F.col("timestamp").cast("timestamp").cast("long") if now is not None else F.lit(None).cast("long")
    rules = {
        "schema": missing,
        "range": ~F.col("value").between(choice(place, low), choice(place, high)),
        "duplicate": at > 1,
        "stale": age > 120 * choice(F.col("source"), minutes or COLLECT_MINUTES),
    }
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])))


def split(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and quarantined rows with their reasons."""
    checked = with_violations(rows, order)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def stale_sources(rows: DataFrame, now, minutes: dict[str, int] | None = None) -> DataFrame:
    """Sources without a row in twice their interval."""
    last = rows.groupBy("source").agg(F.max("timestamp").alias("last_at"))
    age = F.lit(now).cast("timestamp").cast("long") - F.col("last_at").cast("timestamp").cast("long")
    return last.withColumn("age_s", age).where(age > 120 * choice(F.col("source"), minutes or COLLECT_MINUTES))
