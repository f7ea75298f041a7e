"""Seasonal-trend decomposition by LOESS (Cleveland and others, 1990), with robustness weights, one series of hourly means in a task.

Inner loop: cycle subseries of the detrended values are smoothed and extended by one cycle at both ends, a low-pass filter (moving averages of a cycle, a
cycle and three, then LOESS) takes what is trend out of them, the rest is the season; the deseasonalized values are smoothed to the trend. Outer loop:
values far from their fit get less weight, by the bisquare of six median residuals, so that an outlier moves neither season nor trend.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that a window of neighbours holds at once.
WINDOW = 4_000_000


def loess(y: np.ndarray, weights: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Local linear fits with tricube weights of values at 0, 1, 2, ... at the places `at` (by default their own), each from its `width` nearest
    values. A place whose neighbours all have no weight gets what lies between the places beside it."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else at
    near = min(width, n)
    out = np.empty(len(at))
    step = max(1, WINDOW // near)
    for begin in range(0, len(at), step):
        x = at[begin : begin + step]
        first = np.clip(np.ceil(x - (near - 1) / 2 - 1e-9).astype(np.int64), 0, n - near)
        window = first[:, None] + np.arange(near)
        far = np.abs(window - x[:, None])
        reach = far.max(axis=1, keepdims=True) + max(0, (width - n) // 2)
        w = np.where(far <= 0.999 * reach, (1 - (far / np.maximum(reach, 1e-12)) ** 3) ** 3, 0.0)
        w = np.where(far <= 0.001 * reach, 1.0, w) * weights[window]
        total = w.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            w /= total[:, None]
            mean = (w * window).sum(axis=1)
            spread = (w * (window - mean[:, None]) ** 2).sum(axis=1)
            tilt = np.where(np.sqrt(spread) > 0.001 * max(n - 1, 1), (x - mean) / np.where(spread > 0, spread, 1), 0.0)
            fit = (w * (1 + tilt[:, None] * (window - mean[:, None])) * y[window]).sum(axis=1)
        out[begin : begin + step] = np.where(total > 0, fit, np.nan)
    known = ~np.isnan(out)
    if not known.all() and known.any():
        out = np.interp(at, at[known], out[known])
    return np.where(np.isnan(out), 0.0, out)


def moving(y: np.ndarray, width: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(y)])
    return (sums[width:] - sums[:-width]) / width


def odd(n: float) -> int:
    n = int(np.ceil(n))
    return n + 1 - n % 2


def decompose(y: np.ndarray, known: np.ndarray, period: int, seasonal: int, trend: int, low: int, inner: int, outer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and robustness weights of values at equal steps; where `known` is false the value does not count."""
    n, given = len(y), known.astype(float)
    t, s, robust = np.zeros(n), np.zeros(n), np.ones(n)
    for turn in range(outer + 1):
        w = given * robust
        for _ in range(inner):
            cycles = np.zeros(n + 2 * period)
            for phase in range(min(period, n)):
                own = (y - t)[phase::period]
                places = np.arange(-1, len(own) + 1, dtype=float)
                cycles[phase::period][: len(places)] = loess(own, w[phase::period], seasonal, places)
            smooth = loess(moving(moving(moving(cycles, period), period), 3), np.ones(n), low)
            s = cycles[period : period + n] - smooth
            t = loess(y - s, w, trend)
        if turn < outer:
            away = np.abs(y - t - s)
            h = 6 * np.median(away[known])
            with np.errstate(divide="ignore", invalid="ignore"):
                u = np.where(h > 0, away / h, np.where(away > 0, 1.0, 0.0))
            robust = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u * u) ** 2, 0.0))
    return t, s, robust


def robust_residuals(rows: DataFrame, period: int = 24, seasonal: int = 7, trend: int | None = None, inner: int = 1, outer: int = 15, limit: float = 2.5, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """by, hour, value (the hour's mean), trend, season, residual, weight, and flagged: the residual is beyond so many deviations of the residuals that have
    weight. Hours without a value count for nothing and give no row; rows without a time or value are left out. A series shorter than two cycles has
    no season. A task holds one series of hourly means, which is as long as its hours, not as its rows."""
    width = trend or odd(1.5 * period / (1 - 1.5 / seasonal))
    hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp"))
    hourly = rows.where("timestamp IS NOT NULL AND value IS NOT NULL").groupBy(*by, hour.alias("hour")).agg(F.avg("value").alias("value"))
    kinds = T.StructType([*hourly.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("trend", "season", "residual", "weight")], T.StructField("flagged", T.BooleanType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("hour", ignore_index=True)
        at = frame["hour"].to_numpy().astype("datetime64[h]").astype(np.int64)
        at -= at[0]
        y, known = np.zeros(at[-1] + 1), np.zeros(at[-1] + 1, bool)
        y[at], known[at] = frame["value"], True
        if len(y) >= 2 * period:
            t, s, w = decompose(y, known, period, seasonal, width, odd(period), inner, outer)
        else:
            t, s, w = loess(y, known.astype(float), width), np.zeros(len(y)), np.ones(len(y))
        residual = (y - t - s)[at]
        own = residual[w[at] > 0]
        sd = own.std(ddof=1) if len(own) > 1 else np.nan
        return frame.assign(trend=t[at], season=s[at], residual=residual, weight=w[at], flagged=(np.abs(residual) > limit * sd) & (sd > 1e-12 * np.abs(y).max()))

    return hourly.groupBy(*by).applyInPandas(run, kinds)
