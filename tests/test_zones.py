"""Zones of all sizes and lengths against a walk over all pairs; alert messages."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from plumeline.operators import zones
from plumeline.sources import reference

START = dt.datetime(2024, 1, 1)
POINTS = "id long, timestamp timestamp, lat double, lon double, radius_km double"
ZONES = "alert string, starts timestamp, ends timestamp, lat double, lon double, radius_km double, ring array<struct<lat: double, lon: double>>"


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def within(point, ring):
    turn = lambda x: ring[0][1] + (x - ring[0][1] + 180) % 360 - 180
    y, x, odd = point[0], turn(point[1]), False
    for (ay, ax), (by, bx) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (turn(bx) - turn(ax)) * (y - ay) / (by - ay) + turn(ax):
            odd = not odd
    return odd


def walk(points, given):
    out = set()
    for i, at, lat, lon, _ in points:
        for name, starts, ends, y, x, radius, ring in given:
            if None in (at, lat, lon, starts, name) or at < starts or (ends is not None and at > ends):
                continue
            if within((lat, lon), ring) if ring and len(ring) >= 3 else None not in (y, x, radius) and km((lat, lon), (y, x)) <= radius:
                out.add((i, name))
    return out


def cases(lat, lon, seed, n=150):
    rng = random.Random(seed)
    wrap = lambda x: (x + 180) % 360 - 180
    spot = lambda: (max(-90.0, min(90.0, lat + rng.gauss(0, 1.5))), wrap(lon + rng.gauss(0, 1.5) / max(0.05, math.cos(math.radians(lat)))))
    time = lambda: START + dt.timedelta(seconds=rng.randrange(60 * 86400))
    points = [(i, time(), *spot(), 1.0) for i in range(n)] + [(n, None, lat, lon, 1.0), (n + 1, START, None, lon, 1.0)]
    given = []
    for i in range(60):
        y, x = spot()
        starts = time()
        ends = None if i % 5 == 0 else starts + dt.timedelta(seconds=rng.choice([0, 60, 3600, 86400 * 3, 86400 * 40]))
        if i % 2:
            given.append((f"z{i}", starts, ends, y, x, rng.choice([0.0, 5.0, 80.0, 300.0, 3000.0]), None))
        else:
            size = rng.choice([0.3, 2.0, 4.0])
            turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.choice([3, 6, 9])))
            given.append((f"z{i}", starts, ends, None, None, None, [(max(-89.9, min(89.9, y + size * math.sin(t))), wrap(x + size * math.cos(t))) for t in turns]))
    given += [("at", points[0][1], points[0][1], points[0][2], points[0][3], 0.0, None), ("z1", START, None, lat, lon, 50.0, None), (None, START, None, lat, lon, 500.0, None), ("none", None, None, lat, lon, 500.0, None), ("back", time(), START, lat, lon, 500.0, None), ("two", START, None, None, None, None, [(1.0, 1.0), (2.0, 2.0)])]
    return points, given


@pytest.mark.parametrize("lat,lon", [(34.0, -84.0), (10.0, 180.0), (88.0, 0.0), (-0.5, 0.2)])
def test_equals_a_walk_over_all_pairs(spark, monkeypatch, lat, lon):
    points, given = cases(lat, lon, 3)
    p, z = spark.createDataFrame(points, POINTS), spark.createDataFrame(given, ZONES)
    want = walk(points, given)
    assert {tuple(r) for r in zones.holding(p, z, "id", "alert").collect()} == want and len(want) > 100
    monkeypatch.setattr(zones, "BROADCAST_KEYS", 0)
    found = zones.holding(p, z.drop("ring").where("radius_km IS NOT NULL"), "id", "alert").collect()
    assert {tuple(r) for r in found} == walk(points, [g for g in given if g[5] is not None]) and len(found) == len(set(found))


def test_long_zones_make_few_keys(spark):
    spans = [(0, 10), (5, 86_400), (100, 86_400 * 365 * 30), (-5_000_000_000, 5_000_000_000)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in spans], "a double, b double").withColumn("k", zones.buckets(F.col("a"), F.col("b")))
    for (a, b), row in zip(spans, df.collect()):
        covered = sorted((x.bucket * 8**x.size, (x.bucket + 1) * 8**x.size) for x in row.k)
        assert covered[0][0] == a // 900 and covered[-1][1] == b // 900 + 1
        assert all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
        assert len(covered) <= 14 * 11


def test_empty(spark):
    points, given = cases(34.0, -84.0, 5, 5)
    p, z = spark.createDataFrame(points, POINTS), spark.createDataFrame(given, ZONES)
    assert zones.holding(p, z.limit(0), "id", "alert").isEmpty() and zones.holding(p.limit(0), z, "id", "alert").isEmpty()


MESSAGE = """<?xml version="1.0"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>{id}</identifier><sent>2025-11-01T06:00:00-05:00</sent><status>{status}</status><msgType>{kind}</msgType>
<info><event>Dense Smoke</event><severity>Moderate</severity>{times}<area><areaDesc>here</areaDesc>{area}</area></info></alert>"""


def test_alert_messages(spark):
    times = "<effective>2025-11-01T07:00:00-05:00</effective><onset>2025-11-01T13:30:00Z</onset><expires>2025-11-02T00:00:00Z</expires>"
    area = "<polygon>34.0,-84.0 34.2,-84.0\n 34.2,-83.8 34.0,-84.0</polygon><circle>33.5,-84.5 12.5</circle>"
    of = lambda **more: MESSAGE.format(**{"id": "a", "status": "Actual", "kind": "Alert", "times": times, "area": area} | more)
    texts = [of(), of(id="open", times=""), of(id="c", kind="Cancel"), of(id="t", status="Test"), of(id="bad", times=times.replace("2025-11-02T00", "soon")), of(id="odd", area="<polygon>1,2 x,3 4,5</polygon><circle>1,2</circle>"), "no xml <", ""]
    found = sorted(reference.alerts(spark.createDataFrame([(t,) for t in texts] + [(None,)], "payload string")).collect(), key=lambda r: (r.alert, r.ring is None))
    assert [(r.alert, r.radius_km, len(r.ring or [])) for r in found] == [("a", None, 4), ("a", 12.5, 0), ("open", None, 4), ("open", 12.5, 0)]
    assert (str(found[0].starts), str(found[0].ends)) == ("2025-11-01 13:30:00", "2025-11-02 00:00:00")
    assert (str(found[2].starts), found[2].ends) == ("2025-11-01 11:00:00", None)


def test_facilities_and_violations(spark):
    payload = lambda body: spark.createDataFrame([(body,), ("{",)], "payload string")
    places = reference.facilities(payload('{"facilities": [{"id": 1, "name": "Mill", "kind": "paper", "latitude": "34.1", "longitude": -84.2, "releases_kg": "7.5"}, {"id": 2, "latitude": "x", "longitude": 1}, {"id": 3, "latitude": 1, "longitude": 2}]}'))
    found = reference.violations(payload('{"violations": [{"facility_id": 1, "date": "2025-06-01", "rule": "air"}, {"facility_id": 1, "date": "2023-06-01"}, {"facility_id": 1, "date": "never"}, {"facility_id": 9, "date": "2025-06-01"}]}'))
    assert {(r.facility, r.releases_kg, r.violations) for r in reference.with_violations(places, found, "2025-12-31").collect()} == {("1", 7.5, 1), ("3", None, 0)}


def test_many_keys_of_little_size_are_not_broadcast(spark):
    """Thousands of alike alerts are a small file, but hundreds of thousands of keys."""
    time = lambda hours: F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.lit(3600) * hours)
    given = spark.range(2500).select(F.col("id").alias("alert"), time(F.col("id") % 5).alias("starts"), time(F.col("id") % 5 + 30).alias("ends"), F.lit(34.0).alias("lat"), F.lit(-84.0).alias("lon"), F.lit(30.0).alias("radius_km"))
    points = spark.range(6).select("id", time(F.col("id") * 7).alias("timestamp"), F.lit(34.1).alias("lat"), (F.lit(-84.0) - F.col("id") % 2).alias("lon"))
    found = zones.holding(points, given, "id", "alert")
    rows = found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sorted((r.id, r.alert) for r in rows) == sorted((i, a) for i in (0, 2, 4) for a in range(2500) if a % 5 <= i * 7 <= a % 5 + 30)


def test_many_zones_of_one_place_are_few_rows(spark):
    """Thousands of alerts over one place, of the same hours or of others, cost a point a few rows; its list is whole, sorted and without repeats."""
    day = dt.datetime(2024, 1, 1)
    points = spark.createDataFrame([(i, 34.0, -84.0, day + dt.timedelta(minutes=7 * i)) for i in range(60)], "id int, lat double, lon double, timestamp timestamp_ntz")
    given = [(n % 2900, 34.1, -84.0, 30.0, day + dt.timedelta(hours=n % 5, minutes=n % 2), day + dt.timedelta(hours=n % 5 + 2)) for n in range(3000)]
    alerts = spark.createDataFrame(given, "alert int, lat double, lon double, radius_km double, starts timestamp_ntz, ends timestamp_ntz")
    want = {i: sorted({a for a, *_, begin, end in given if begin <= day + dt.timedelta(minutes=7 * i) <= end}) for i in range(60)}
    found = {r.id: r.alerts for r in zones.lists(points, alerts, "id", "alert", "alerts").collect()}
    assert found == {i: names for i, names in want.items() if names}
    assert zones.meetings(points, alerts, "id", "alert").count() < sum(map(len, want.values())) / 100
    assert {tuple(r) for r in zones.holding(points, alerts, "id", "alert").collect()} == {(i, a) for i, names in want.items() for a in names}
