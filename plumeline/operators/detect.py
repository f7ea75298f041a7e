"""Anomaly detectors, consensus and merging."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions.parse import choice
from ..schema import HAZARDOUS
from . import pairs, proximity
from .graph import written

DAY = 86_400_000_000
WHERE = ("source", "source_entity_id", "metric", "unit")


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def zscore(rows: DataFrame, days: int = 7, limit: float = 3.0, min_samples: int = 10, by: tuple[str, ...] = WHERE, slice_hours: int = 6) -> DataFrame:
    """Adds mean, deviation and number of the days before each reading (without it), its z and whether |z| exceeds the limit.

    Time is cut into slices. What comes before a reading are the readings of its own slice before it, the whole slices between, and the end
    of the slice that many days ago, which is sent to the same task. So each row is read twice whatever the days hold, and a key with a
    third of all rows is spread over its slices. Rows without a time have nothing before them. Columns that are added replace those of their names."""
    span, step = days * DAY, slice_hours * 3_600_000_000
    if span % step:
        raise ValueError("slice_hours must divide the days")
    rows = rows.drop("n_before", "mean_before", "sd_before", "z", "flagged")
    at = micros(F.col("timestamp"))

    def moments(of: str, over=lambda x: x) -> list[Column]:
        """Number, mean and sum of squared deviations."""
        n = over(F.count(of))
        return [n.alias("n"), F.coalesce(over(F.avg(of)), F.lit(0.0)).alias("m"), F.coalesce(over(F.var_pop(of)) * n, F.lit(0.0)).alias("q")]

    now = rows.withColumn("_at", at).withColumn("_row", F.lit(True))
    past = rows.select(*by, (at + span).alias("_at"), F.col("value").alias("_past"))
    slices = rows.groupBy(*by, F.floor(at / step).alias("_slice")).agg(*moments("value"))
    # Between: sums around the mean of the key's slices, which keeps them small.
    slices = slices.withColumn("_c", F.avg("m").over(Window.partitionBy(*by)))
    between = Window.partitionBy(*by).orderBy("_slice").rangeBetween(-(span // step) + 1, -1)
    d = F.col("m") - F.col("_c")
    sums = [F.coalesce(F.sum(x).over(between), F.lit(0)) for x in (F.col("n"), F.col("n") * d, F.col("q") + F.col("n") * d * d)]
    middle = slices.select(*by, "_slice", F.struct(sums[0].alias("n"), F.when(sums[0] > 0, F.col("_c") + sums[1] / sums[0]).otherwise(0.0).alias("m"), F.when(sums[0] > 0, sums[2] - sums[1] * sums[1] / sums[0]).otherwise(0.0).alias("q")).alias("_middle"))
    both = now.unionByName(past, allowMissingColumns=True).withColumn("_slice", F.floor(F.col("_at") / step)).unionByName(middle, allowMissingColumns=True)
    part = Window.partitionBy(*by, "_slice")
    before = part.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    after = part.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    own, old = moments("value", lambda x: x.over(before)), moments("_past", lambda x: x.over(after))
    met = both.select("*", F.struct(*own).alias("_own"), F.struct(*old).alias("_old"), F.max("_middle").over(part).alias("_between")).where("_row")
    parts = [F.col(c) for c in ("_old", "_between", "_own")]
    total = lambda f: f(parts[0]) + f(parts[1]) + f(parts[2])
    n_before = F.when(F.col("_at").isNull(), 0).otherwise(total(lambda p: p["n"])).cast("long")
    out = met.withColumn("n_before", n_before).withColumn("mean_before", F.when(F.col("n_before") > 0, total(lambda p: p["n"] * p["m"]) / F.col("n_before")))
    spread = total(lambda p: p["q"] + p["n"] * (p["m"] - F.col("mean_before")) * (p["m"] - F.col("mean_before")))
    out = out.withColumn("sd_before", F.when(F.col("n_before") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("n_before") - 1))))
    z = F.when((F.col("n_before") >= min_samples) & (F.col("sd_before") > 0), (F.col("value") - F.col("mean_before")) / F.col("sd_before"))
    out = out.select(*rows.columns, "n_before", "mean_before", "sd_before", z.alias("z"))
    return out.withColumn("flagged", F.coalesce(F.abs("z") > limit, F.lit(False)))


def seasonal_residual(rows: DataFrame, limit: float = 2.5, half_window_h: int = 12, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Classical decomposition of hourly means: trend (centred mean), season (mean of what is left, by hour of the day), residual, and whether
    the residual is beyond so many of its deviations."""
    hourly = rows.groupBy(*by, F.date_trunc("hour", F.col("timestamp").cast("timestamp")).alias("hour")).agg(F.avg("value").alias("value"))
    w = Window.partitionBy(*by).orderBy(F.unix_seconds("hour")).rangeBetween(-half_window_h * 3600, half_window_h * 3600)
    out = hourly.withColumn("trend", F.avg("value").over(w)).withColumn("hour_of_day", F.hour("hour"))
    out = out.withColumn("season", F.avg(F.col("value") - F.col("trend")).over(Window.partitionBy(*by, "hour_of_day")))
    out = out.withColumn("residual", F.col("value") - F.col("trend") - F.col("season"))
    out = out.withColumn("sd", F.stddev_samp("residual").over(Window.partitionBy(*by)))
    return out.withColumn("flagged", F.coalesce((F.col("sd") > 0) & (F.abs("residual") > limit * F.col("sd")), F.lit(False)))


def loess_residuals(rows: DataFrame, period: int = 24, span: int = 49, passes: int = 2, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """STL-like decomposition by local linear fits with tricube weights, one series of hourly means in a task: by, hour, value, trend, season, residual."""
    hourly = rows.groupBy(*by, F.date_trunc("hour", F.col("timestamp").cast("timestamp")).alias("hour")).agg(F.avg("value").alias("value"))

    def smooth(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
        """Each point from the line fitted to its `width` neighbours, all points at once."""
        width = min(width, len(x))
        first = np.clip(np.arange(len(x)) - width // 2, 0, len(x) - width)
        near = first[:, None] + np.arange(width)
        u, v = x[near] - x[:, None], y[near]
        w = (1 - np.minimum(1, np.abs(u) / (np.abs(u).max(axis=1, keepdims=True) + 1)) ** 3) ** 3
        w /= w.sum(axis=1, keepdims=True)
        mu, mv = (w * u).sum(axis=1), (w * v).sum(axis=1)
        du = u - mu[:, None]
        var, both = (w * du * du).sum(axis=1), (w * du * (v - mv[:, None])).sum(axis=1)
        return mv - np.divide(both, var, out=np.zeros(len(x)), where=var > 0) * mu

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("hour")
        x, y = frame["hour"].to_numpy().astype("datetime64[h]").astype(np.int64).astype(float), frame["value"].to_numpy(float)
        season, phase = np.zeros(len(y)), x.astype(np.int64) % period
        trend = np.zeros(len(y))
        for _ in range(passes):
            trend = smooth(x, y - season, span)
            for p in np.unique(phase):
                at = phase == p
                season[at] = smooth(x[at], (y - trend)[at], 7)
            season -= season.mean()
        return frame.assign(trend=trend, season=season, residual=y - trend - season)

    kinds = ", ".join(f"{c} string" for c in by)
    return hourly.groupBy(*by).applyInPandas(run, f"{kinds}, hour timestamp, value double, trend double, season double, residual double")


# Isolation forest: trees are fitted on a bounded sample, all rows are scored.
TREES, SUBSAMPLE, FOREST_LIMIT, SEED = 100, 256, 0.6, 17


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """A tree as (feature, cut, left, right, depth) rows; feature -1 is a leaf, its depth includes what its size stands for."""
    most, nodes, todo = int(np.ceil(np.log2(max(len(x), 2)))), [None], [(0, np.arange(len(x)), 0)]
    while todo:
        k, rows, depth = todo.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        split = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(split):
            nodes[k] = (-1, 0.0, 0, 0, depth + float(path_length(len(rows))))
            continue
        f = int(rng.choice(split))
        cut = float(rng.uniform(low[f], high[f]))
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[k] = (f, cut, left, right, 0.0)
        below = x[rows, f] < cut
        todo += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return nodes


FOREST_FEATURES = ("value", "temperature", "humidity", "wind_speed", "traffic_density", "hour_of_day", "day_of_week")


def training_weeks(rows: DataFrame, week: str | None = None, days: int = 30) -> DataFrame:
    """Rows of the `days` before the week (its Monday, YYYY-MM-DD; None: the week of the last row), from which its forest is fitted."""
    start = F.date_trunc("week", F.lit(week).cast("timestamp") if week else F.lit(rows.agg(F.max("timestamp")).first()[0]).cast("timestamp"))
    at = F.col("timestamp").cast("timestamp")
    return rows.where((at < start) & (at >= start - F.expr(f"INTERVAL {days} DAYS")))


def isolation_forest(rows: DataFrame, features: list[str], trees: int = TREES, subsample: int = SUBSAMPLE, limit: float = FOREST_LIMIT, training: DataFrame | None = None) -> DataFrame:
    """Adds score (0 to 1) and flagged. The forest is fitted on `trees * subsample` rows of `training` (or of rows) at most, the least by a
    hash: a documented bound. A missing feature counts as the sample's median, so that gaps are not taken for extremes."""
    numbers = lambda df: [F.col(f).cast("double").alias(f) for f in features]
    given = rows if training is None else training
    sample = given.select(*numbers(given), F.xxhash64(*features, F.lit(SEED)).alias("_order")).orderBy("_order", *features).limit(trees * subsample).drop("_order").toPandas().to_numpy(float)
    known = [column[~np.isnan(column)] for column in sample.T]
    medians = np.array([np.median(x) if len(x) else 0.0 for x in known]) if len(sample) else np.zeros(len(features))
    sample = np.where(np.isnan(sample), medians, sample)
    rng = np.random.default_rng(SEED)
    forest = [np.array(grow(sample[rng.choice(len(sample), min(subsample, len(sample)), replace=False)], rng)) for _ in range(trees)] if len(sample) else []
    sent = rows.sparkSession.sparkContext.broadcast((forest, medians))  # at most `trees` trees of `subsample` leaves
    scale = float(path_length(min(subsample, max(len(sample), 2)))) or 1.0

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest, medians = sent.value
        for columns in parts:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            yield pd.Series(scores(np.where(np.isnan(x), medians, x), forest, scale))

    out = rows.withColumn("score", score(*numbers(rows)))
    return out.withColumn("flagged", F.col("score") > limit)


#: A week's forest learns from the `EACH` rows of least hash in each of `BUCKETS` buckets: 25,600 at most, a documented bound. Rows that one task scores, about.
EACH, BUCKETS, SCORED = 400, 64, 200_000
MODEL = "week timestamp, n_trained long, sizes array<int>, medians array<double>, nodes binary"


def week_of(time: Column) -> Column:
    """Its Monday."""
    return F.date_trunc("week", time.cast("timestamp"))


def training_sets(rows: DataFrame, weeks: DataFrame | None = None, days: int = 30) -> DataFrame:
    """rows, each once for every week (column week) whose forest may learn from it: those that begin after the row and within so many days.
    `weeks` (column week) are the weeks that want a forest, by default all that have rows."""
    at, day = F.col("timestamp").cast("timestamp"), F.expr("INTERVAL 7 DAYS")
    first, last = week_of(F.col("timestamp")) + day, at + F.make_dt_interval(F.lit(days))
    wanted = rows.select(week_of(F.col("timestamp")).alias("week")).distinct() if weeks is None else weeks.select("week").distinct()
    learned = rows.drop("week").withColumn("week", F.explode(F.when(first <= last, F.sequence(first, last, day))))
    return learned.join(F.broadcast(wanted), "week", "left_semi")  # 52 rows a year


def weekly_forests(rows: DataFrame, features: list[str], weeks: DataFrame | None = None, days: int = 30, trees: int = TREES, subsample: int = SUBSAMPLE, key: str = "id") -> DataFrame:
    """The table of models: for each week the forest of a bounded sample of the `days` before it, fitted by a task of its own. Weeks with nothing
    before them have no model. The sample is cut before rows are shuffled, as each task hands on its least rows only."""
    numbers = [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    sets = training_sets(rows, weeks, days).select("week", *numbers, F.xxhash64(F.col(key).cast("string"), F.lit(SEED)).alias("_order"))
    bucket = Window.partitionBy("week", F.pmod("_order", F.lit(BUCKETS))).orderBy("_order", *[f"_f{i}" for i in range(len(features))])
    sample = sets.withColumn("_n", F.row_number().over(bucket)).where(F.col("_n") <= EACH).drop("_n")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(frame.columns[::-1]), kind="stable")
        x = frame[[f"_f{i}" for i in range(len(features))]].to_numpy(float)
        week = frame["week"].iloc[0]
        forest, medians = forest_of(x, trees, subsample, week.toordinal())
        return pd.DataFrame({"week": [week], "n_trained": [len(x)], "sizes": [[len(t) for t in forest]], "medians": [medians.tolist()], "nodes": [np.concatenate(forest).tobytes()]})

    return sample.groupBy("week").applyInPandas(fit, MODEL)


def forest_of(x: np.ndarray, trees: int, subsample: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Trees over subsamples of x, whose gaps are filled by the medians."""
    known = [column[~np.isnan(column)] for column in x.T]
    medians = np.array([np.median(c) if len(c) else 0.0 for c in known])
    x = np.where(np.isnan(x), medians, x)
    rng = np.random.default_rng([SEED, seed])
    return [np.array(grow(x[rng.choice(len(x), min(subsample, len(x)), replace=False)], rng)) for _ in range(trees)], medians


def retrain(path: str, rows: DataFrame, features: list[str], **settings) -> DataFrame:
    """Adds the models of weeks that the table at `path` has none of, and gives the table. Doing it twice is as doing it once: a week's
    model is never replaced, also if late rows come."""
    spark = rows.sparkSession
    weeks = rows.select(week_of(F.col("timestamp")).alias("week")).distinct()
    try:
        stored = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = None
    if stored is not None:
        weeks = weeks.join(F.broadcast(stored.select("week")), "week", "left_anti")
    if not weeks.isEmpty():
        weekly_forests(rows, features, weeks, **settings).coalesce(8).write.mode("append").parquet(path)
    return spark.read.schema(MODEL).parquet(path)


def weekly_scores(rows: DataFrame, models: DataFrame, features: list[str], limit: float = FOREST_LIMIT, subsample: int = SUBSAMPLE, key: str = "id") -> DataFrame:
    """rows with score (0 to 1; null in weeks without a model) and flagged, each scored by its own week's forest, which saw nothing of that week.
    A week's rows meet its model in as many tasks as they need."""
    rows = rows.drop("score", "flagged")
    week = week_of(F.col("timestamp"))
    parts = rows.groupBy(week.alias("_of")).agg(F.ceil(F.count(F.lit(1)) / SCORED).cast("int").alias("_parts"))  # a row for each week
    numbers = [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    sent = rows.withColumn("_week", week).join(F.broadcast(parts), F.col("_week").eqNullSafe(F.col("_of")))
    sent = sent.withColumn("_part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.col("_parts")).cast("int")).drop("_parts", "_of").select("*", *numbers)
    copies = models.select(F.col("week").alias("_week"), "n_trained", "sizes", "medians", "nodes").join(F.broadcast(parts), F.col("_week") == F.col("_of")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_of")
    names = rows.columns

    def run(own: pa.Table, model: pa.Table) -> pa.Table:
        if own.num_rows and model.num_rows:
            sizes, nodes = model.column("sizes")[0].as_py(), np.frombuffer(model.column("nodes")[0].as_py(), float).reshape(-1, 5)
            forest = np.split(nodes, np.cumsum(sizes)[:-1])
            x = np.column_stack([own.column(f"_f{i}").to_numpy().astype(float) for i in range(len(features))])
            medians = np.array(model.column("medians")[0].as_py())
            scale = float(path_length(min(subsample, max(model.column("n_trained")[0].as_py(), 2)))) or 1.0
            found = pa.array(scores(np.where(np.isnan(x), medians, x), forest, scale))
        else:
            found = pa.nulls(own.num_rows, pa.float64())
        return own.select(names).append_column("score", found)

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    out = sent.groupBy("_week", "_part").cogroup(copies.groupBy("_week", "_part")).applyInArrow(run, schema)
    return out.withColumn("flagged", F.coalesce(F.col("score") > limit, F.lit(False)))


def scores(x: np.ndarray, forest: list[np.ndarray], scale: float) -> np.ndarray:
    depth = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(tree[at, 0] >= 0)).size:
            node = tree[at[inner]]
            at[inner] = np.where(x[inner, node[:, 0].astype(int)] < node[:, 1], node[:, 2], node[:, 3]).astype(np.int64)
        depth += tree[at, 4]
    return 2.0 ** (-depth / max(1, len(forest)) / scale)


def consensus(flags: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """flags (key, method) of all detectors and the points themselves: methods and severity of each flagged point. One method is minor, two
    are moderate, three or a hazardous value severe."""
    counted = flags.groupBy(key).agg(F.count_distinct("method").alias("n_methods"), F.array_sort(F.collect_set("method")).alias("methods"))
    hazard = choice(F.concat_ws("|", "metric", "unit"), {f"{m}|{u}": v for (m, u), v in HAZARDOUS.items()})
    severe = (F.col("n_methods") >= 3) | F.coalesce(F.col("value") >= hazard, F.lit(False))
    return counted.join(points, key).withColumn("severity", F.when(severe, "severe").when(F.col("n_methods") == 2, "moderate").otherwise("minor"))


def merge_gaps(anomalies: DataFrame, minutes: int = 30, by: tuple[str, ...] = ("metric", "cell_lat", "cell_lon"), tie: str = "id") -> DataFrame:
    """Runs of anomalies without a gap beyond so many minutes: first and last time, number, and the representative (the largest
    |score|, then the earliest, then the least id)."""
    w = Window.partitionBy(*by).orderBy("at", tie)
    rows = anomalies.withColumn("at", micros(F.col("timestamp")))
    rows = rows.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(w) > minutes * 60_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("event", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct((-F.abs("score")).alias("a"), F.col("at").alias("b"), F.col(tie).alias("c"))
    return rows.groupBy(*by, "event").agg(F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count(F.lit(1)).alias("n"), F.min_by(tie, best).alias("representative"))


def near_pairs(anomalies: DataFrame, minutes: int = 30, km: float = 10.0, key: str = "id") -> DataFrame:
    """Pairs of one metric within so many minutes and km, at all latitudes; cells of time and place, and their neighbours, are the equi-join, in blocks where a cell
    holds many rows."""
    step = minutes * 60
    rows = written(anomalies.select(key, "metric", "lat", "lon", (micros(F.col("timestamp")) / 1_000_000).alias("s")), "pairs").withColumn("t", F.floor(F.col("s") / step))
    rows = rows.withColumn("place", geo.cell(F.col("lat"), F.col("lon"), km))
    other = rows.select(*[F.col(c).alias(f"{c}_b") for c in (key, "lat", "lon", "s")], "metric", F.explode(F.array(*[F.col("t") + i for i in (-1, 0, 1)])).alias("t"), geo.cells_around(F.col("lat"), F.col("lon"), km).alias("around"))
    other = other.withColumn("place", F.explode("around")).drop("around")
    met = pairs.met(rows, other, ["metric", "t", "place"], key, f"{key}_b").where((F.col(key) < F.col(f"{key}_b")) & (F.abs(F.col("s") - F.col("s_b")) <= step))
    met = met.where(F.abs(F.col("lat") - F.col("lat_b")) <= math.degrees(km / geo.EARTH_KM) * 1.000001)  # before the distance, which costs more
    return met.where(geo.distance_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")) <= km).select("metric", key, f"{key}_b")


def merge_near(anomalies: DataFrame, minutes: int = 30, km: float = 10.0, key: str = "id") -> DataFrame:
    """anomalies with event: the least key that links (one metric, so many minutes and km) reach, directly or over others; an anomaly without
    neighbours is its own event. Dense places and times are one node of the graph each, so that no pairs of theirs are made."""
    return proximity.grouped(anomalies, minutes, km, key, ["metric"])


def events(merged: DataFrame, key: str = "id") -> DataFrame:
    """One row for each event: metric, first and last time, number, and the representative (the largest |score|, then the earliest, then the least key)."""
    best = F.struct((-F.abs("score")).alias("a"), micros(F.col("timestamp")).alias("b"), F.col(key).alias("c"))
    return merged.groupBy("event").agg(F.first("metric").alias("metric"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count(F.lit(1)).alias("n"), F.min_by(key, best).alias("representative"))
