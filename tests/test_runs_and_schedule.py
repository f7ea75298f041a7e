"""Scans of which parts fail, what is due, the log of streams, circles across 180 degrees, clashing columns."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumeline.functions import geo
from plumeline.operators import detect, graph, runs
from plumeline.sources import registry
from plumeline.streaming import ingest

FIRES = "latitude,longitude,brightness,acq_date,acq_time,satellite,confidence,frp\n34.2,-84.3,318.4,2025-11-19,1610,Terra,71,7.2\n"


def test_a_scan_leaves_out_what_failed_and_fails_if_all_did(spark):
    landed = lambda *texts: spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "dataset string, payload string")
    fires = registry.normalizer("nasa_firms")
    assert fires(landed(FIRES, "<html>busy</html>", None)).count() == 3
    with pytest.raises(Exception, match="nothing succeeded: nasa_firms"):
        fires(landed("<html>busy</html>", "Invalid MAP_KEY.")).collect()
    assert fires(landed()).isEmpty()
    point = lambda **more: json.dumps({"point_id": "north", "payload": {"coord": {"lon": 1, "lat": 2}, "main": {"temp": 3}, "dt": 1763467200} | more})
    weather = registry.normalizer("openweather")
    assert weather(landed(point(), point(coord=None), "no json")).count() == 2
    with pytest.raises(Exception, match="nothing succeeded: openweather"):
        weather(landed(point(coord=None), "")).collect()


def test_due(spark):
    at = lambda text: datetime.fromisoformat(text)
    log = spark.createDataFrame([("a", at("2025-07-01 10:00")), ("a", at("2025-07-01 09:00")), ("b", at("2025-07-01 10:00")), ("d", at("2025-07-01 10:30")), ("e", at("2025-07-01 09:59"))], "source string, at timestamp")
    turn = lambda now: {r.source for r in runs.due(log, at(now), {"a": 60, "b": 90, "new": 5}, {"d": 6, "e": 6}).collect()}
    # Six in New York is ten in summer: e ran before, d after it.
    assert turn("2025-07-01 10:59") == {"new", "e"}
    assert turn("2025-07-01 11:00") == {"new", "e", "a"}
    assert turn("2025-07-02 09:59") == {"new", "e", "a", "b"}
    assert turn("2025-07-02 10:00") == {"new", "e", "a", "b", "d"}


def test_a_failed_batch_is_logged_and_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("x")
    stream = spark.readStream.text(f"file://{tmp_path}/in")

    def broken(rows):
        raise RuntimeError("cannot be read")

    with pytest.raises(Exception, match="cannot be read"):
        ingest.ingest(stream, broken, f"{tmp_path}/table", f"{tmp_path}/state", ["value"], log=("s", f"{tmp_path}/log")).awaitTermination()
    row = spark.read.parquet(f"{tmp_path}/log").first()
    assert (row.source, row.success) == ("s", False) and "cannot be read" in row.errors[0]


def test_pushed_batches_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "id long, z double")
    for batch, some in ((0, rows), (1, rows.where("id = 2")), (1, rows.where("id = 2")), (2, rows.limit(0))):
        ingest.push(some, f"{tmp_path}/events", batch)
    assert sorted((r.batch, r.key) for r in spark.read.json(f"{tmp_path}/events").collect()) == [(0, "1"), (0, "2"), (1, "2")]


@pytest.mark.parametrize("lat,lon", [(0.0, 179.95), (10.0, -179.9), (89.9, 5.0), (-89.95, 100.0), (34.0, -84.0), (70.0, 179.0)])
def test_circles_are_whole(spark, lat, lon):
    places = spark.range(4000).select((F.lit(lat) + (F.col("id") % 63 - 31) * 0.03).alias("y"), (F.pmod(F.lit(lon) + 180 + (F.col("id") % 89 - 44) * (0.04 if abs(lat) < 80 else 4.0), F.lit(360.0)) - 180).alias("x")).where("y BETWEEN -90 AND 90")
    near = geo.distance_km(F.lit(lat), F.lit(lon), F.col("y"), F.col("x")) <= 60
    assert places.where(near).count() == places.where(geo.within_radius(F.col("y"), F.col("x"), lat, lon, 60.0)).count() > 20
    assert places.where(near & ~geo.within_radius(F.col("y"), F.col("x"), lat, lon, 60.0)).isEmpty()


def test_zscore_replaces_its_columns(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(hours=i), float(i % 5), "m", "mine") for i in range(40)], "timestamp timestamp, value double, metric string, z string")
    once = detect.zscore(df, by=("metric",))
    assert once.where("z IS NOT NULL").count() == 30 and detect.zscore(once, by=("metric",)).columns == once.columns


def test_no_silent_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        graph.shared_dir(Session())
