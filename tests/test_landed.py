"""The data source of landed files: leniency, conditions that reach it, and its stream."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from plumeline.sources import landed

START = "2025-11-01T00:00:00"


@pytest.fixture
def folder(spark, tmp_path):
    landed.register(spark)
    return tmp_path


def put(folder, source, name, rows, age=0):
    path = folder / f"source={source}"
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    at = 1_800_000_000 - age
    os.utime(path / name, (at, at))


def row(i, **more):
    return {"timestamp": f"2025-11-0{1 + i % 9}T06:30:00Z", "lat": 30 + i, "lon": -84.5, "metric": "pm25", "value": i / 4, "unit": "ug/m3", "source_entity_id": str(i)} | more


def read(spark, folder):
    return spark.read.format(landed.FORMAT).load(f"file://{folder}")


def test_fields_are_lenient(spark, folder):
    put(folder, "a b", "x.json", [row(1), row(2, lat="31.5", value=" 7 "), row(3, lat="north", timestamp="someday"), {"metric": "no2"}, row(4, timestamp="2025-11-05 01:02:03.000004+02:00", extra={"deep": [1]}), row(5, timestamp="2025-11-05T01:02:03"), row(6, timestamp=None)])
    put(folder, "b", "_SUCCESS", ["not read"])
    put(folder, "b", "empty.json", [])
    put(folder, "b", "y.json", ["", '{"raw_json": "{\\"k\\": 1}", "value": 1e3}', ""])
    found = {r.source_entity_id or r.metric or r.raw_json: r for r in read(spark, folder).collect()}
    assert len(found) == 8
    assert (found["1"].lat, found["1"].source, found["1"].timestamp) == (31.0, "a b", dt.datetime(2025, 11, 2, 6, 30))
    assert (found["2"].lat, found["2"].value) == (31.5, 7.0) and (found["3"].lat, found["3"].timestamp) == (None, None)
    assert found["4"].timestamp == dt.datetime(2025, 11, 4, 23, 2, 3, 4) and found["5"].timestamp == dt.datetime(2025, 11, 5, 1, 2, 3) and found["6"].timestamp is None
    assert (found["no2"].value, found["no2"].source) == (None, "a b") and found['{"k": 1}'].value == 1000.0
    put(folder, "b", "bad.json", ["{no json"])
    with pytest.raises(Exception, match="JSONDecodeError"):
        read(spark, folder).collect()


def test_conditions_reach_the_source(spark, folder, capfd):
    for source in ("a", "b", "c"):
        put(folder, source, "x.json", [row(i, value=None if i == 4 else i) for i in range(9)])
    at = F.lit("2025-11-03T06:30:00Z").cast("timestamp")
    df = read(spark, folder).where((F.col("source") == "b") & (F.col("timestamp") >= at) & (F.col("lat") < 38) & F.col("lon").between(-85, -84) & F.col("value").isNotNull() & F.col("metric").isin("pm25", "no2"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)
    assert sorted(r.source_entity_id for r in df.collect()) == ["2", "3", "5", "6", "7"]
    reader = landed.Reader(f"file://{folder}", ["value"])
    left = list(reader.pushFilters([landed.D.EqualTo(("source",), "b"), landed.D.In(("source",), ("a", "b")), landed.D.StringContains(("unit",), "g"), landed.D.GreaterThan(("other",), 1)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "GreaterThan"]
    assert [p.source for p in reader.partitions()] == ["b"]
    assert read(spark, folder).where("source = 'b' OR value = 1").count() == 11  # what is not taken Spark does
    assert read(spark, folder).where("contains(unit, 'g') AND source <> 'a'").count() == 18
    assert read(spark, folder).select("value").where("source = 'c'").agg(F.sum("value")).first()[0] == 32.0


def test_blocks_and_empty_folders(spark, folder, monkeypatch):
    assert read(spark, folder).isEmpty()
    put(folder, "a", "x.json", [row(i, raw_json="é" * 50) for i in range(200)])
    monkeypatch.setattr(landed, "BLOCK", 100)
    some = [b for f in landed.files(f"file://{folder}") for b in landed.batches(f"file://{folder}", f, [], landed.ORDER)]
    assert sum(b.num_rows for b in some) == 200 and len(some) > 20


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    put(data, "a", "1.json", [row(1)], age=30)
    put(data, "b", "2.json", [row(2), row(3)], age=20)

    def run():
        stream = spark.readStream.format(landed.FORMAT).load(f"file://{data}")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r.source_entity_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [1, 2, 3]
    put(data, "a", "0.json", [row(4)], age=10)  # an earlier name, finished later
    assert run() == [1, 2, 3, 4]
    assert run() == [1, 2, 3, 4]
