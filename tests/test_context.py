"""Documents within their budget, filled in the order of worth."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumeline.operators import context, enrich
from plumeline.operators.graph import written

AT = datetime(2025, 11, 18, 12)
ROWS = "id long, timestamp timestamp_ntz, lat double, lon double, metric string, value double, unit string, source string, source_entity_id string"


def count(text):
    return len(re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", text))


def enriched(spark, n_readings, n_places):
    anomalies = spark.createDataFrame([(1, AT, 34.0, -84.0, "pm25", 80.0, "ug/m3", "openaq", "s")], ROWS).withColumn("z", F.lit(4.2))
    readings = spark.createDataFrame([(10 + i, AT - timedelta(minutes=3 * i), 34.0, -84.0, "pm25", i / 7, "ug/m3", "openaq", "s") for i in range(n_readings)] + [(90_000, AT, 34.0, -84.0, "temperature", 5.0, "degC", "other", "t"), (90_001, AT, 34.0, -84.0, "pm10", 6.0, "ug/m3", "other", "t")], ROWS)
    places = spark.createDataFrame([(f"plant-{i}", 34.0 + i / 1000, -84.0, "chemical works", i) for i in range(n_places)], "facility string, lat double, lon double, kind string, violations int")
    fires = spark.createDataFrame([("f", 34.5, -84.0, 12.0)], "fire string, lat double, lon double, value double")
    alerts = spark.createDataFrame([("smoke", 34.0, -84.0, 20.0, AT - timedelta(days=2), None)], "alert string, lat double, lon double, radius_km double, starts timestamp_ntz, ends timestamp_ntz")
    return enrich.enriched(anomalies, readings, places, fires, alerts).join(context.series(anomalies, readings), "id", "left")


def test_a_rich_anomaly_fills_the_budget(spark):
    row = context.documents(enriched(spark, 1400, 30)).first()
    assert row.n_tokens == count(row.document) and 1500 <= row.n_tokens <= 3000
    lines = row.document.split("\n")
    assert lines[0].startswith("Anomaly: pm25 = 80.00 ug/m3 at 34.0000, -84.0000, z-score 4.20, 2025-11-18 12:00:00, openaq/s")
    assert "Alerts: smoke" in lines and "Fires: f 55.6 km N, 12.0" in lines and "Weather: other temperature 5.00" in lines and "Water: none known" in lines
    assert lines[4].count("plant-") == 10 and "plant-3 chemical works 0.3 km N violations 3" in lines[4]
    assert re.search(r"Readings before, minutes and value: 3 0\.14; 6 0\.29; .*; and \d+ more$", lines[-1])


def test_small_budgets_leave_out_the_least(spark):
    rows = written(enriched(spark, 200, 30), "enriched")
    for most in (200, 260, 400):
        row = context.documents(rows, most=most).first()
        lines = row.document.split("\n")
        assert row.n_tokens == count(row.document) <= most
        assert len(lines) == 12 and lines[0].startswith("Anomaly: pm25")
    assert any(re.search(r"^Facilities: plant-0 .*; and \d+ more$", x) for x in context.documents(rows, most=300).first().document.split("\n"))


def test_sums_and_left_out_items(spark):
    items = spark.createDataFrame([("d", 0, "A", 0, "x " * 50), ("d", 1, "B", 0, "one two"), ("d", 1, "B", 1, "three"), ("d", 2, "C", 0, "four"), ("e", 0, "A", 0, "")], "doc string, rank int, section string, place int, item string")
    # Three titles of one token with a colon and eight for what is left out: 30.
    kept = {(r.doc, r.rank, r.place): (r.kept, r.n_tokens) for r in context.fitted(items, "doc", 30 + 56).collect()}
    assert kept == {("d", 0, 0): (True, 51), ("d", 1, 0): (True, 3), ("d", 1, 1): (True, 2), ("d", 2, 0): (False, 2), ("e", 0, 0): (True, 1)}
    text = context.assembled(context.fitted(items, "doc", 30 + 54), "doc").where("doc = 'd'").first().document
    assert text.split("\n")[1:] == ["B: one two; and 1 more", "C: 1 known"]


def test_bare_and_empty(spark):
    bare = enriched(spark, 0, 0).drop("readings", "z")
    row = context.documents(bare).first()
    assert "History of 72 hours: none known" in row.document and "Facilities: none known" in row.document
    assert context.documents(bare.limit(0)).isEmpty()


def test_a_document_is_filled_inside_its_row(spark):
    """Twenty thousand alerts of an anomaly do not become rows, and all that are left out are counted."""
    rows = written(enriched(spark, 200, 3).withColumn("alerts", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("string"))), "enriched")
    found = context.documents(rows)
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Window" not in plan
    row = found.first()
    lines = row.document.split("\n")
    kept, more = re.match(r"Alerts: (.*); and (\d+) more$", lines[2]).groups()
    kept = kept.split("; ")
    assert kept == [str(i + 1) for i in range(len(kept))] and len(kept) + int(more) == 20_000 and len(kept) > 1_000
    assert lines[3] == "Fires: 1 known" and lines[4] == "Facilities: 3 known" and lines[-1].endswith(": 199 known")
    assert row.n_tokens == count(row.document) <= 3000
