"""Forests by week against a plain walk over the weeks, and the table of models."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import detect, enrich

FEATURES = ["value", "temperature"]
TYPES = "id long, timestamp timestamp, value double, temperature double, note string"


def readings(n=400, days=70, seed=3):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 3)
    rows = [(i, start + dt.timedelta(minutes=rng.randrange(days * 1440)), rng.gauss(10, 3) if i % 37 else 90.0, rng.gauss(20, 5) if i % 5 else None, "x") for i in range(n)]
    return rows + [(n, dt.datetime(2024, 2, 5), 1.0, None, None), (n + 1, dt.datetime(2024, 2, 4, 23, 59, 59), None, 2.0, "x"), (n + 2, None, 5.0, 5.0, "x")]


def monday(t):
    return (t - dt.timedelta(days=t.weekday())).replace(hour=0, minute=0, second=0, microsecond=0)


def walk(spark, rows, trees, subsample, days=30):
    """Each week's forest from the rows of the days before it, in the order of the documented hash."""
    order = {r.id: r.h for r in spark.createDataFrame([(r[0],) for r in rows], "id long").select("id", F.xxhash64(F.col("id").cast("string"), F.lit(detect.SEED)).alias("h")).collect()}
    number = lambda x: np.nan if x is None else x
    out = {}
    for week in {monday(r[1]) for r in rows if r[1]}:
        known = sorted((r for r in rows if r[1] and week - dt.timedelta(days=days) <= r[1] < week), key=lambda r: order[r[0]])
        if not known:
            continue
        forest, medians = detect.forest_of(np.array([[number(r[2]), number(r[3])] for r in known]), trees, subsample, week.toordinal())
        own = [r for r in rows if r[1] and monday(r[1]) == week]
        x = np.array([[number(r[2]), number(r[3])] for r in own])
        found = detect.scores(np.where(np.isnan(x), medians, x), forest, float(detect.path_length(min(subsample, max(len(known), 2)))))
        out |= {r[0]: s for r, s in zip(own, found)}
    return {r[0]: out.get(r[0]) for r in rows}


def test_rows_are_scored_by_what_came_before_their_week(spark):
    rows = readings()
    df = spark.createDataFrame(rows, TYPES).withColumn("score", F.lit("mine"))
    models = detect.weekly_forests(df, FEATURES, trees=20, subsample=64)
    found = detect.weekly_scores(df, models, FEATURES, subsample=64)
    assert set(found.columns) == set(df.columns) | {"flagged"}
    got, want = {r.id: r.score for r in found.collect()}, walk(spark, rows, 20, 64)
    assert len(got) == len(rows) and set(got) == set(want)
    assert all((got[i] is None) == (want[i] is None) and (got[i] is None or got[i] == pytest.approx(want[i])) for i in want)
    assert any(v is None for v in got.values())  # the first week has nothing before it
    high = [r.flagged for r in found.where("value = 90.0 AND score IS NOT NULL").collect()]
    assert high and sum(high) > len(high) / 2


def test_late_and_future_rows_do_not_change_a_week(spark):
    rows = [r for r in readings() if r[1]]
    cut = dt.datetime(2024, 2, 5)

    def score(some):
        df = spark.createDataFrame(some, TYPES)
        return {r.id: r.score for r in detect.weekly_scores(df, detect.weekly_forests(df, FEATURES, trees=10, subsample=32), FEATURES, subsample=32).collect()}

    whole, early = score(rows), score([r for r in rows if r[1] < cut + dt.timedelta(days=7)])
    assert all(early[i] == whole[i] for i in early)


def test_rows_of_a_week_meet_its_model_in_parts(spark, monkeypatch):
    df = spark.createDataFrame(readings(), TYPES)
    models = detect.weekly_forests(df, FEATURES, trees=5, subsample=32)
    one = {r.id: r.score for r in detect.weekly_scores(df, models, FEATURES, subsample=32).collect()}
    monkeypatch.setattr(detect, "SCORED", 7)
    assert {r.id: r.score for r in detect.weekly_scores(df, models, FEATURES, subsample=32).collect()} == one


def test_samples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(detect, "EACH", 2)
    monkeypatch.setattr(detect, "BUCKETS", 4)
    df = spark.createDataFrame(readings(), TYPES)
    assert {r.n_trained <= 8 for r in detect.weekly_forests(df, FEATURES, trees=3, subsample=4).collect()} == {True}


def test_retrain_adds_missing_weeks_only(spark, tmp_path):
    path = f"file://{tmp_path}/models"
    rows = [r for r in readings() if r[1]]
    first = spark.createDataFrame([r for r in rows if r[1] < dt.datetime(2024, 2, 12)], TYPES)
    settings = {"trees": 3, "subsample": 16}
    before = {r.week: bytes(r.nodes) for r in detect.retrain(path, first, FEATURES, **settings).collect()}
    whole = spark.createDataFrame(rows, TYPES)
    after = {r.week: bytes(r.nodes) for r in detect.retrain(path, whole, FEATURES, **settings).collect()}
    assert set(before) < set(after) and all(after[w] == before[w] for w in before)
    assert {r.week: bytes(r.nodes) for r in detect.retrain(path, whole, FEATURES, **settings).collect()} == after


def test_empty_tables(spark):
    none = spark.createDataFrame([], TYPES)
    models = detect.weekly_forests(none, FEATURES)
    assert models.isEmpty() and detect.weekly_scores(none, models, FEATURES).isEmpty()


def test_weather_of_the_own_cell(spark):
    at = dt.datetime(2024, 1, 1, 5, 30)
    rows = spark.createDataFrame([(1, at, 34.01, -84.01, "pm25", 5.0), (2, at, 40.0, -84.01, "pm25", 6.0)], "id long, timestamp timestamp, lat double, lon double, metric string, value double")
    weather = spark.createDataFrame([(3, at, 34.02, -84.02, "temperature", 10.0), (4, at, 34.03, -84.03, "temperature", 20.0), (5, at, 34.4, -84.01, "temperature", 90.0)], rows.schema)
    found = {r.id: r.temperature for r in enrich.forest_features(rows, weather, {"temperature": "temperature"}, degrees=0.25).collect()}
    assert found == {1: 15.0, 2: None}
    assert {r.temperature for r in enrich.forest_features(rows, weather, {"temperature": "temperature"}).collect()} == {40.0}
