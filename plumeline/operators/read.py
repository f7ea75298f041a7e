"""The read interface: filters, pages, totals, status, feed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .store import source_status

MOST_ROWS = 1000


def select_observations(rows: DataFrame, source: str | None, metric: str | None = None, start=None, end=None, lat: float | None = None, lon: float | None = None, radius_km: float | None = None) -> DataFrame:
    """Rows of a source (None: of all); an empty metric is none, both times are inclusive, and the square needs all three of its numbers."""
    out = rows if source is None else rows.where(F.col("source") == source)
    if metric:
        out = out.where(F.col("metric") == metric)
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("timestamp") <= F.lit(end))
    if None not in (lat, lon, radius_km):
        out = out.where(geo.in_square(F.col("lat"), F.col("lon"), lat, lon, radius_km))
    return out


def page(rows: DataFrame, limit: int = 100, offset: int = 0, tie: str = "id") -> DataFrame:
    """Newest first; `tie` orders rows of one time."""
    if not 0 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit must be 0 to {MOST_ROWS}, offset 0 or more")
    return rows.orderBy(F.desc("timestamp"), tie).offset(offset).limit(limit)


@dataclass
class Page:
    """A page; its total is counted when it is asked for."""

    items: DataFrame
    found: DataFrame
    limit: int
    offset: int

    @cached_property
    def total(self) -> int:
        return self.found.count()


def query_observations(rows: DataFrame, source: str, limit: int = 100, offset: int = 0, tie: str = "id", **filters) -> Page:
    """A page and the total under the same filters; an unknown source has an empty page."""
    found = select_observations(rows, source, **filters)
    return Page(page(found, limit, offset, tie), found, limit, offset)


def totals(rows: DataFrame, **filters) -> DataFrame:
    """The total of each source under the same filters, in one pass."""
    return select_observations(rows, None, **filters).groupBy("source").agg(F.count(F.lit(1)).alias("total"))


def list_sources(runs: DataFrame) -> DataFrame:
    """Name, status, last collection and error count of every source that ever ran, by name."""
    return source_status(runs)


#: The same under the interface's other name.
sources = list_sources


def health(spark: SparkSession, env: str = "development", version: str = "0.1.0") -> dict[str, str]:
    try:
        spark.sql("SELECT 1").collect()
        database = "connected"
    except Exception:  # noqa: BLE001  any failure means the engine does not answer
        database = "disconnected"
    return {"status": "ok" if database == "connected" else "degraded", "database": database, "env": env, "version": version}


def feed(anomalies: DataFrame, severity: str | None = None, metric: str | None = None, start=None, end=None, lat: float | None = None, lon: float | None = None, radius_km: float | None = None) -> DataFrame:
    """Anomalies, newest first, under the filters given."""
    out = anomalies
    for name, value in (("severity", severity), ("metric", metric)):
        out = out.where(F.col(name) == value) if value else out
    out = out.where(F.col("timestamp") >= F.lit(start)) if start is not None else out
    out = out.where(F.col("timestamp") <= F.lit(end)) if end is not None else out
    if None not in (lat, lon, radius_km):
        out = out.where(geo.within_radius(F.col("lat"), F.col("lon"), lat, lon, radius_km))
    return out.orderBy(F.desc("timestamp"))
