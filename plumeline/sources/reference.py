"""Reference data: alerts in the Common Alerting Protocol, facilities and their violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse

_AREA = "struct<areaDesc: string, polygon: array<string>, circle: array<string>>"
_INFO = f"struct<event: string, severity: string, effective: string, onset: string, expires: string, area: array<{_AREA}>>"
CAP = f"struct<identifier: string, sent: string, status: string, msgType: string, info: array<{_INFO}>>"
FACILITIES = "struct<facilities: array<struct<id: string, name: string, kind: string, latitude: string, longitude: string, releases_kg: string>>>"
VIOLATIONS = "struct<violations: array<struct<facility_id: string, date: string, rule: string>>>"


def pair(text: Column) -> Column:
    """(lat, lon) of "lat,lon"."""
    at = F.split(text, ",")
    return F.struct(parse.to_double(at[0]).alias("lat"), parse.to_double(F.try_element_at(at, F.lit(2))).alias("lon"))


def alerts(landed: DataFrame) -> DataFrame:
    """One alert message (XML) in a row of `payload` to a row for each of its polygons and circles: alert, event, severity, starts, ends, lat, lon,
    radius_km, ring. An alert starts at its onset, else when it takes effect, else when it was sent; without `expires` it has no end. Cancelled
    messages, tests, and shapes that cannot be read are left out."""
    m = landed.select(F.from_xml("payload", CAP).alias("m")).select("m.*").where("coalesce(msgType, 'Alert') <> 'Cancel' AND coalesce(status, 'Actual') = 'Actual'")
    i = m.select("identifier", "sent", F.explode("info").alias("i")).select("identifier", "sent", *[F.col(f"i.{c}") for c in ("event", "severity", "effective", "onset", "expires")], F.explode("i.area").alias("area"))
    place = lambda kind, c: F.transform(F.coalesce(c, F.array()), lambda x: F.struct(F.lit(kind).alias("kind"), parse.stripped(x).alias("text")))
    s = i.withColumn("shape", F.explode(F.concat(place("polygon", F.col("area.polygon")), place("circle", F.col("area.circle")))))
    words = F.split("shape.text", r"\s+")
    polygon = F.col("shape.kind") == "polygon"
    time = lambda c: parse.iso_timestamp(F.col(c))
    out = s.select(
        F.col("identifier").alias("alert"), "event", "severity",
        F.coalesce(time("onset"), time("effective"), time("sent")).alias("starts"), time("expires").alias("ends"), F.col("expires").isNotNull().alias("_ends"),
        F.when(~polygon, pair(words[0])["lat"]).alias("lat"), F.when(~polygon, pair(words[0])["lon"]).alias("lon"), F.when(~polygon, parse.to_double(F.try_element_at(words, F.lit(2)))).alias("radius_km"),
        F.when(polygon, F.transform(words, pair)).alias("ring"),
    )
    good = F.forall("ring", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()) & (F.size("ring") >= 3)
    return out.where(F.coalesce(good, (F.col("lat") + F.col("lon") + F.col("radius_km")).isNotNull()) & F.col("starts").isNotNull() & (~F.col("_ends") | F.col("ends").isNotNull())).drop("_ends")


def facilities(landed: DataFrame) -> DataFrame:
    """facility, name, kind, lat, lon, releases_kg; those without an id or place are left out."""
    f = landed.select(F.explode(F.from_json("payload", FACILITIES)["facilities"]).alias("f")).select("f.*")
    out = f.select(F.col("id").alias("facility"), "name", "kind", parse.to_double(F.col("latitude")).alias("lat"), parse.to_double(F.col("longitude")).alias("lon"), parse.to_double(F.col("releases_kg")).alias("releases_kg"))
    return out.dropna(subset=["facility", "lat", "lon"])


def violations(landed: DataFrame) -> DataFrame:
    """facility, day, rule."""
    v = landed.select(F.explode(F.from_json("payload", VIOLATIONS)["violations"]).alias("v")).select("v.*")
    return v.select(F.col("facility_id").alias("facility"), F.col("date").try_cast("date").alias("day"), "rule").dropna(subset=["facility", "day"])


def with_violations(places: DataFrame, found: DataFrame, today, days: int = 365) -> DataFrame:
    """places with violations: how many each facility had in so many days up to the day `today`, inclusive."""
    last = F.lit(today).cast("date")
    recent = found.where(F.col("day").between(F.date_sub(last, days), last)).groupBy("facility").agg(F.count(F.lit(1)).alias("violations"))
    return places.drop("violations").join(recent, "facility", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
