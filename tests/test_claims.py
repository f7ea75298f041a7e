"""Claims in free text and what supports them, against a walk over all evidence."""

import datetime as dt
import random

import pytest

from plumeline.operators import evaluate

DAY = dt.datetime(2025, 11, 18, 9, 30)
EVIDENCE = "site string, metric string, unit string, value double, timestamp timestamp"


def stated(spark, *texts):
    df = spark.createDataFrame([(f"t{i}", t, "s") for i, t in enumerate(texts)], "doc string, body string, site string")
    return df, evaluate.claims(df, "doc", "body")


def test_claims_are_found(spark):
    _, found = stated(spark, "PM2.5 reached 41.5 µg/m³ on 2025-11-18, while the temperature fell to -3 °C. Humidity: 80%; wind speed of 2.50 m/s", "Nothing was measured; pm10 is bad. It is 7 ppm.", None, "", "Ozone was 0.061 ppm at noon and NO2 30ppb on 2025-02-31")
    rows = sorted((r.doc, r.n, r.metric, r.value, r.unit, str(r.day)) for r in found.collect())
    assert rows == [
        ("t0", 0, "pm25", 41.5, "ug/m3", "2025-11-18"), ("t0", 1, "temperature", -3.0, "degC", "None"), ("t0", 2, "humidity", 80.0, "percent", "None"), ("t0", 3, "wind_speed", 2.5, "m/s", "None"),
        ("t4", 0, "ozone", 0.061, "ppm", "None"), ("t4", 1, "no2", 30.0, "ppb", "None"),
    ]


def test_one_percent_off_is_verified_and_twenty_is_marked(spark):
    evidence = spark.createDataFrame([("s", "pm25", "ug/m3", 40.0, DAY), ("s", "pm25", "ug/m3", 90.0, DAY - dt.timedelta(days=1)), ("other", "pm25", "ug/m3", 48.0, DAY)], EVIDENCE)
    texts, found = stated(spark, "PM2.5 was 40.4 ug/m3 on 2025-11-18.", "PM2.5 was 48 ug/m3 on 2025-11-18.", "PM2.5 was 90 ug/m3 on 2025-11-18 and PM2.5 was 90 ug/m3.", "Calm.")
    judged = evaluate.supported(found.join(texts.select("doc", "site"), "doc"), evidence, ["site"])
    out = {r.doc: (r.n_claims, r.n_verified, r.marked) for r in evaluate.annotated(texts, judged, "doc", "body").collect()}
    assert out["t0"] == (1, 1, "PM2.5 was 40.4 ug/m3 on 2025-11-18.")
    assert out["t1"] == (1, 0, "PM2.5 was 48 ug/m3 on 2025-11-18 [unverified].")
    assert out["t2"] == (2, 1, "PM2.5 was 90 ug/m3 on 2025-11-18 [unverified] and PM2.5 was 90 ug/m3.")
    assert out["t3"] == (0, 0, "Calm.")


@pytest.mark.parametrize("tolerance", [0.01, 0.1, 0.5, 0.9])
def test_equals_a_walk(spark, tolerance):
    rng = random.Random(7)
    number = lambda: rng.choice([0.0, round(rng.uniform(-3, 3), 2), round(rng.lognormvariate(0, 3), 4)])
    evidence = [(rng.choice("ab"), rng.choice(["pm25", "no2"]), "ppb", number(), DAY + dt.timedelta(days=rng.randrange(4))) for _ in range(120)] + [("a", "pm25", "ppb", None, DAY), ("a", "pm25", "ppb", 5.0, None)]
    claims = [(i, rng.choice("ab"), rng.choice(["pm25", "no2"]), "ppb", number() if i % 3 else rng.choice(evidence[:120])[3] * rng.choice([1, 1 + tolerance * 0.99, 1 - tolerance * 0.99, 1 + tolerance * 1.01, 1 - tolerance * 1.01]), rng.choice([None, (DAY + dt.timedelta(days=rng.randrange(4))).date()])) for i in range(300)]
    df = spark.createDataFrame(claims, "id int, site string, metric string, unit string, value double, day date")
    got = {r.id: r.verified for r in evaluate.supported(df, spark.createDataFrame(evidence, EVIDENCE), ["site"], tolerance).collect()}
    want = {i: any(e[:3] == (site, metric, unit) and e[3] is not None and (day is None or (e[4] is not None and e[4].date() == day)) and abs(v - e[3]) <= abs(e[3]) * tolerance for e in evidence) for i, site, metric, unit, v, day in claims}
    assert got == want and len(set(got.values())) == 2


def test_empty(spark):
    texts, found = stated(spark)
    none = spark.createDataFrame([], EVIDENCE)
    assert evaluate.annotated(texts, evaluate.supported(found.join(texts.select("doc", "site"), "doc"), none, ["site"]), "doc", "body").isEmpty()
    with pytest.raises(ValueError):
        evaluate.supported(found, none, [], 1.5)
