"""Normalizers by source name. Those of scans with several points or datasets leave out what failed, and fail if all did."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs
from . import feeds, planned

NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "epa_airnow": feeds.airnow,
    "openaq": feeds.openaq,
    "purpleair": feeds.purpleair,
    "openweather": lambda landed: feeds.openweather(runs.some(landed, F.get_json_object("payload", "$.payload.coord").isNotNull(), "openweather")),
    "nasa_firms": lambda landed: feeds.fires(feeds.fire_rows(runs.some(landed, ~feeds.refused(), "nasa_firms"))),
    "traffic": planned.traffic,
    "water_gauges": planned.water,
    "energy": planned.energy,
}


def register(name: str, normalize: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a source: a function from landed payloads to observations."""
    NORMALIZERS[name] = normalize


def names() -> list[str]:
    return sorted(NORMALIZERS)


def normalizer(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in NORMALIZERS:
        raise ValueError(f"unknown source {name!r}; known are {', '.join(names())}")
    return NORMALIZERS[name]


def normalize_all(landed: dict[str, DataFrame]) -> DataFrame:
    """The observations of all given sources together."""
    return reduce(DataFrame.unionByName, [normalizer(name)(rows) for name, rows in landed.items()])
