"""Merging by cubes against merging by pairs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from plumeline.operators import detect, proximity

TYPES = "id long, timestamp timestamp, lat double, lon double, metric string, score double"
START = dt.datetime(2024, 1, 1)


def km(a, b):
    p, q = (math.radians(x) for x in (a[2], b[2]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def by_pairs(rows, minutes, radius):
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(rows):
        for b in rows[:n]:
            if None not in (*a[1:5], *b[1:5]) and a[4] == b[4] and abs((a[1] - b[1]).total_seconds()) <= minutes * 60 and km(a, b) <= radius:
                x, y = root(a[0]), root(b[0])
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def scattered(n, lat, lon, spread, minutes, seed):
    rng = random.Random(seed)
    wrap = lambda x: (x + 180) % 360 - 180
    return [(i, START + dt.timedelta(seconds=rng.randrange(minutes * 60)), max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), wrap(lon + rng.uniform(-spread, spread) / max(0.02, math.cos(math.radians(lat)))), rng.choice(["pm25", "no2"]), 1.0) for i in range(n)]


@pytest.mark.parametrize("lat,lon,spread,minutes", [(34.0, -84.0, 0.6, 300), (70.0, 180.0, 0.5, 200), (89.7, 0.0, 0.3, 500), (-60.0, 179.9, 0.4, 300)])
def test_equals_merging_by_pairs(spark, lat, lon, spread, minutes):
    rows = scattered(220, lat, lon, spread, minutes, 7)
    rows += [(900, None, lat, lon, "pm25", 1.0), (901, START, None, lon, "pm25", 1.0), (902, START, lat, lon, None, 1.0), (903, START, lat, lon, None, 1.0)]
    df = spark.createDataFrame(rows, TYPES)
    found = {r.id: r.event for r in detect.merge_near(df).collect()}
    assert found == by_pairs(rows, 30, 10.0)
    assert len(set(found.values())) > 6


def test_limits_are_inclusive_and_ties_hold(spark):
    place = lambda north_km: 10.0 + math.degrees(north_km / 6371.0)
    rows = [
        (1, START, 10.0, 20.0, "a", 1.0), (2, START + dt.timedelta(minutes=30), 10.0, 20.0, "a", 1.0),  # at the limit of time
        (3, START, 10.0, 30.0, "a", 1.0), (4, START + dt.timedelta(minutes=30, microseconds=1), 10.0, 30.0, "a", 1.0),
        (5, START, 10.0, 40.0, "a", 1.0), (6, START, place(9.9999), 40.0, "a", 1.0),
        (7, START, 10.0, 50.0, "a", 1.0), (8, START, place(10.0001), 50.0, "a", 1.0),
        (9, START, 10.0, 60.0, "a", 1.0), (10, START, 10.0, 60.0, "a", 1.0), (11, START, 10.0, 60.0, "b", 1.0),
    ]
    found = {r.id: r.event for r in detect.merge_near(spark.createDataFrame(rows, TYPES)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9, 10: 9, 11: 11}


def test_dense_cells_near_the_limit_are_told_apart_without_pairs(spark):
    """Two crowds whose nearest members are 10.2 km, and two whose nearest are 9.8 km apart: no two boxes of the first level tell."""
    crowd = lambda start, n, lat, lon: spark.range(n).select((F.col("id") + start).alias("id"), (F.lit(START) + F.make_dt_interval(secs=F.rand(start) * 300)).alias("timestamp"), (F.lit(lat) + F.rand(start + 1) * 0.02).alias("lat"), (F.lit(lon) + F.rand(start + 2) * 0.0001).alias("lon"), F.lit("a").alias("metric"), F.lit(1.0).alias("score"))
    gap = lambda km: math.degrees(km / 6371.0) + 0.02
    df = crowd(0, 5000, 10.0, 20.0).unionByName(crowd(5000, 5000, 10.0 + gap(10.2), 20.0)).unionByName(crowd(10_000, 5000, 10.0, 30.0)).unionByName(crowd(15_000, 5000, 10.0 + gap(9.8), 30.0))
    path = proximity.written(df, "crowds")
    tally = []
    found = proximity.grouped(path, 30, 10.0, "id", ["metric"], tally)
    assert {r.event: r["count"] for r in found.groupBy("event").count().collect()} == {0: 5000, 5000: 5000, 10_000: 10_000}
    assert sum(tally) < 100_000


def test_a_hundred_thousand_in_one_cell(spark):
    df = spark.range(100_000).select("id", (F.lit(START) + F.make_dt_interval(secs=F.col("id") % 1200)).alias("timestamp"), (F.lit(34.0) + F.col("id") % 499 * 0.0001).alias("lat"), (F.lit(-84.0) + F.col("id") % 503 * 0.0001).alias("lon"), F.lit("a").alias("metric"), F.lit(1.0).alias("score"))
    tally = []
    found = proximity.grouped(df, 30, 10.0, "id", ["metric"], tally)
    assert found.select("event").distinct().collect() == [(0,)] and found.count() == 100_000
    assert sum(tally) < 1_000_000


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], TYPES)
    assert detect.merge_near(none).isEmpty()
    one = spark.createDataFrame([(1, START, 1.0, 1.0, "a", 1.0)], TYPES).withColumn("event", F.lit("mine")).withColumn("node", F.lit(1))
    assert [r.event for r in detect.merge_near(one).collect()] == [1]
