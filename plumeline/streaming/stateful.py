"""Rolling z-scores of a stream by state: a micro-batch meets what the days before it have left, not the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import DAY, WHERE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATS = "n_before long, mean_before double, sd_before double, z double, flagged boolean"


class Series(StatefulProcessor):
    """One series: its values of the last days with their times, packed, so that a batch costs a series one read and one write of state. A timer
    clears a series of which nothing came for so long that no window reaches it any more."""

    def __init__(self, days: int, limit: float, min_samples: int, by: tuple[str, ...]):
        self.span, self.limit, self.min_samples, self.by = days * DAY, limit, min_samples, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "times binary, past binary, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frames = list(rows)
        frame = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        at, value = frame["at_us"].to_numpy(np.int64), frame["value"].to_numpy(float)
        held = self.recent.get() or (b"", b"", -1)  # None if there is none; each call of the state is a round trip
        given = ~np.isnan(value)
        times, past = np.r_[np.frombuffer(bytes(held[0]), "i8"), at[given]], np.r_[np.frombuffer(bytes(held[1]), "f8"), value[given]]
        order = np.argsort(times, kind="stable")
        times, past = times[order], past[order]
        n, mean, sd = before(at, times, past, self.span)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where((n >= self.min_samples) & (sd > 0), (value - mean) / sd, np.nan)
        if len(times):
            kept = times >= timerValues.getCurrentWatermarkInMs() * 1000 - self.span  # what a row above the watermark can see
            timer = (int(times[-1]) + self.span) // 1000 + 1
            if held[2] not in (-1, timer):
                self.handle.deleteTimer(held[2])
            self.handle.registerTimer(timer)
            self.recent.update((times[kept].tobytes(), past[kept].tobytes(), timer))
        yield pd.DataFrame({**{c: frame[c].array for c in (*self.by, "timestamp", "value")}, "n_before": n, "mean_before": mean, "sd_before": sd, "z": z, "flagged": np.abs(np.nan_to_num(z)) > self.limit}, copy=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.recent.clear()
        yield from ()


def before(at: np.ndarray, times: np.ndarray, past: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and deviation of the values in [t - span, t) for each t of `at`; times are sorted. Sums are around the mean, which keeps them small."""
    low, high = np.searchsorted(times, at - span), np.searchsorted(times, at)
    centre = past.mean() if len(past) else 0.0
    sums, squares = (np.r_[0.0, np.cumsum((past - centre) ** p)] for p in (1, 2))
    n = (high - low).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        s, q = sums[high] - sums[low], squares[high] - squares[low]
        mean = np.where(n > 0, centre + s / n, np.nan)
        sd = np.where(n > 1, np.sqrt(np.maximum(q - s * s / n, 0) / (n - 1)), np.nan)
    return n, mean, sd


def rolling_zscore(readings: DataFrame, days: int = 7, limit: float = 3.0, min_samples: int = 10, by: tuple[str, ...] = WHERE, delay: str = "1 hour") -> DataFrame:
    """by, timestamp, value, and what `detect.zscore` says of rows that come in the order of their times. `readings` is a stream; rows later than the
    delay are dropped, others are held against what is known of the time before them, and rows judged already stay as they were judged.
    A row with a null key or value is judged like others (a value that is not a number counts as null); one without a time is left out. A series'
    state holds its values of those days. State is kept by RocksDB, which is set if the session has Spark's default."""
    spark = readings.sparkSession
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    kinds = readings.schema
    rows = readings.select(*by, F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("value").cast("double").alias("value")).where("timestamp IS NOT NULL")
    rows = rows.withWatermark("timestamp", delay).withColumn("at_us", F.unix_micros("timestamp"))
    out = T.StructType([*[T.StructField(c, kinds[c].dataType) for c in by], T.StructField("timestamp", T.TimestampType()), T.StructField("value", T.DoubleType()), *T._parse_datatype_string(STATS).fields])
    found = rows.groupBy(*by).transformWithStateInPandas(Series(days, limit, min_samples, tuple(by)), out, "append", "eventTime")
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("value", "mean_before", "sd_before", "z")})
