"""Registered queries: each applies library operators to the driver's tables. SQL holds the same in DuckDB's dialect, where it can."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import geo, parse, text, units
from ..operators import context, detect, enrich, evaluate, read, retrieval, rollup, runs, stl, store, validate, zones
from ..operators.graph import shared_dir, written
from ..sources import feeds, landed, planned, reference, registry
from .view import OBS, PLACES, RUNS, facilities, km_sql, observations, table
from .view import runs as run_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r4(of: str | F.Column) -> F.Column:
    """Four decimals; the shift keeps sums that differ in their last bits from falling on two sides of a tie, and no zero is negative. SQL gets the same."""
    return F.round((F.col(of) if isinstance(of, str) else of) + 1e-9, 4) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r4(n) for n in names})


LAT, LON = S.TARGET_LAT, S.TARGET_LON

# Scans, filters, pages


@query(f"WITH {OBS} SELECT * FROM obs")
def obs_scan(spark, d):
    return observations(spark, d)


@query(f"WITH {OBS} SELECT id, timestamp, value FROM obs WHERE source = 'openaq'")
def obs_by_source(spark, d):
    return read.select_observations(observations(spark, d), "openaq").select("id", "timestamp", "value")


@query(f"WITH {OBS} SELECT id, timestamp, value FROM obs WHERE source = 'openaq' AND metric = 'pm25' AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'")
def obs_filter_metric_time(spark, d):
    found = read.select_observations(observations(spark, d), "openaq", metric="pm25", start=F.lit("2024-01-05").cast("timestamp_ntz"), end=F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    return found.select("id", "timestamp", "value")


@query(f"WITH {OBS} SELECT id, lat, lon FROM obs WHERE source = 'purpleair' AND lat BETWEEN {LAT} - 30.0::DOUBLE / 111.0 AND {LAT} + 30.0::DOUBLE / 111.0 AND lon BETWEEN {LON} - 30.0::DOUBLE / 111.0 AND {LON} + 30.0::DOUBLE / 111.0")
def obs_filter_box(spark, d):
    return read.select_observations(observations(spark, d), "purpleair", lat=LAT, lon=LON, radius_km=30.0).select("id", "lat", "lon")


@query(f"WITH {OBS} SELECT id, timestamp, metric, value FROM obs WHERE source = 'openaq' ORDER BY timestamp DESC, id LIMIT 100 OFFSET 50")
def obs_page_newest(spark, d):
    return read.query_observations(observations(spark, d), "openaq", limit=100, offset=50).items.select("id", "timestamp", "metric", "value")


@query(f"WITH {OBS} SELECT source, count(*) AS total FROM obs WHERE metric = 'pm10' GROUP BY source")
def obs_page_total(spark, d):
    return read.totals(observations(spark, d), metric="pm10")


@query(f"WITH {OBS} SELECT id, round({km_sql(str(LAT), str(LON), 'lat', 'lon')} + 1e-9, 4) + 0.0::DOUBLE AS km FROM obs WHERE {km_sql(str(LAT), str(LON), 'lat', 'lon')} <= 50")
def obs_within_radius(spark, d):
    o = observations(spark, d)
    lat, lon = F.col("lat"), F.col("lon")
    return o.where(geo.within_radius(lat, lon, LAT, LON, 50.0)).select("id", r4(geo.distance_km(F.lit(LAT), F.lit(LON), lat, lon)).alias("km"))


# Scalar functions


@query(
    f"""WITH {OBS}, p(point_id, north, east) AS (VALUES ('center', 0.0, 0.0), ('north', 25.0, 0.0), ('east', 0.0, 25.0), ('south', -25.0, 0.0), ('west', 0.0, -25.0)),
    s AS (SELECT DISTINCT source_entity_id, lat, lon FROM obs)
    SELECT source_entity_id, point_id, round(lat + north::DOUBLE / 111.32, 6) AS point_lat, round(lon + east::DOUBLE / (111.32 * greatest(cos(radians(lat)), 0.01)), 6) AS point_lon FROM s, p"""
)
def geo_offset_grid(spark, d):
    sites = observations(spark, d).select("source_entity_id", "lat", "lon").distinct()
    points = [F.struct(F.lit(n).alias("point_id"), F.lit(a).alias("north"), F.lit(b).alias("east")) for n, a, b in geo.query_points(LAT, LON, 50.0)]
    grid = sites.withColumn("p", F.explode(F.array(*points)))
    lat, lon = geo.offset(F.col("lat"), F.col("lon"), F.col("p.north"), F.col("p.east"))
    return grid.select("source_entity_id", "p.point_id", F.round(lat, 6).alias("point_lat"), F.round(lon, 6).alias("point_lon"))


@query(
    f"""WITH {OBS}, s AS (SELECT DISTINCT source_entity_id, lat, lon, 50.0::DOUBLE / 111.32 AS up, 50.0::DOUBLE / (111.32 * greatest(cos(radians(lat)), 0.01)) AS side FROM obs)
    SELECT source_entity_id, printf('%.4f,%.4f,%.4f,%.4f', lon - side, lat - up, lon + side, lat + up) AS box, (50 * 0.621371)::INTEGER AS miles FROM s"""
)
def geo_bbox_csv(spark, d):
    sites = observations(spark, d).select("source_entity_id", "lat", "lon").distinct()
    return sites.select("source_entity_id", geo.box_text(F.col("lat"), F.col("lon"), 50.0).alias("box"), geo.whole_miles(50.0).alias("miles"))


@query(
    """WITH u AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN ' ug/m3 ' WHEN 1 THEN 'UG/M^3' WHEN 2 THEN 'µg/m³' WHEN 3 THEN 'μg / m3' WHEN 4 THEN 'PPM' WHEN 5 THEN '' WHEN 6 THEN 'Mg/M3' END AS unit FROM part)
    SELECT p_partkey,
        CASE WHEN coalesce(unit, '') = '' THEN 'unknown' WHEN upper(trim(unit)) IN ('UG/M3', 'UG/M^3') THEN 'ug/m3' ELSE translate(lower(upper(trim(unit))), 'µ', 'μ') END AS airnow,
        CASE WHEN coalesce(unit, '') = '' THEN 'unknown' WHEN replace(translate(lower(trim(unit)), 'µμ³', 'uu3'), ' ', '') IN ('ug/m3', 'ug/m^3') THEN 'ug/m3' ELSE replace(translate(lower(trim(unit)), 'µμ³', 'uu3'), ' ', '') END AS openaq
    FROM u"""
)
def unit_normalize(spark, d):
    labels = ["' ug/m3 '", "'UG/M^3'", "'µg/m³'", "'μg / m3'", "'PPM'", "''", "'Mg/M3'"]
    unit = F.expr("CASE p_size % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(labels)) + " END")
    return table(spark, d, "part").select("p_partkey", unit.alias("unit")).select("p_partkey", units.airnow_unit(F.col("unit")).alias("airnow"), units.openaq_unit(F.col("unit")).alias("openaq"))


@query(
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_iso, CASE WHEN event_id > 0 THEN strftime(make_timestamp(event_id * 60000000), '%Y-%m-%d %H:%M:%S') END AS from_epoch,
        strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS from_acquisition, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS from_hour FROM events"""
)
def time_parse(spark, d):
    e = table(spark, d, "events")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    date = F.date_format("ts", "yyyy-M-d")
    return e.select(
        "event_id",
        shown(parse.iso_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("from_iso"),
        shown(parse.epoch_seconds((F.col("event_id") * 60).cast("string"))).alias("from_epoch"),
        shown(parse.acquisition_time(date, F.date_format("ts", "Hmm"))).alias("from_acquisition"),
        shown(parse.hour_of_date(date, F.hour("ts").cast("string"))).alias("from_hour"),
    )


@query(
    """WITH c AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'l' WHEN 1 THEN ' Nominal' WHEN 2 THEN 'HIGH' WHEN 3 THEN value::VARCHAR WHEN 4 THEN 'bad' WHEN 5 THEN '1.5d' END AS given FROM events)
    SELECT event_id, round(CASE lower(trim(given)) WHEN 'l' THEN 33 WHEN 'low' THEN 33 WHEN 'n' THEN 66 WHEN 'nominal' THEN 66 WHEN 'h' THEN 100 WHEN 'high' THEN 100 ELSE try_cast(given AS DOUBLE) END + 1e-9, 4) + 0.0::DOUBLE AS confidence FROM c"""
)
def confidence_map(spark, d):
    given = F.expr("CASE event_id % 7 WHEN 0 THEN 'l' WHEN 1 THEN ' Nominal' WHEN 2 THEN 'HIGH' WHEN 3 THEN cast(value AS STRING) WHEN 4 THEN 'bad' WHEN 5 THEN '1.5d' END")
    return table(spark, d, "events").select("event_id", r4(parse.fire_confidence(given)).alias("confidence"))


@query(f"WITH {OBS} SELECT id, concat_ws(':', 'VIIRS', coalesce(CASE WHEN id % 3 > 0 THEN metric END, 'unknown'), printf('%.5f', lat), printf('%.5f', lon), strftime(timestamp, '%Y%m%d%H%M')) AS entity FROM obs")
def entity_id_format(spark, d):
    return observations(spark, d).select("id", text.fire_entity(F.lit("VIIRS"), F.when(F.col("id") % 3 > 0, F.col("metric")), F.col("lat"), F.col("lon"), F.col("timestamp")).alias("entity"))


@query("""SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END + CASE WHEN event_id % 4 = 0 THEN 0 ELSE value / 2 END + 1e-9, 4) + 0.0::DOUBLE AS mm FROM events""")
def precip_sum(spark, d):
    rain = F.when(F.col("event_id") % 3 != 0, F.col("value").cast("string"))
    snow = F.when(F.col("event_id") % 4 == 0, "none").otherwise((F.col("value") / 2).cast("string"))
    return table(spark, d, "events").select("event_id", r4(parse.precipitation(rain, snow)).alias("mm"))


@query("SELECT event_id FROM events WHERE event_id % 5 IN (0, 1, 4)")
def outdoor_filter(spark, d):
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN NULL WHEN 2 THEN '1' WHEN 3 THEN 'inside' ELSE 'false' END")
    return table(spark, d, "events").where(parse.is_outdoor(kind)).select("event_id")


@query(f"WITH {RUNS} SELECT seq, concat(source, ' | ', CASE WHEN success THEN 'ok' ELSE 'failed' END, ' | records=', record_count, ' | duration_ms=', round(duration_ms, 1), CASE WHEN len(errors) > 0 THEN concat(' | errors=', array_to_string(errors, '; ')) ELSE '' END) AS line FROM runs")
def run_report(spark, d):
    return runs.report(run_log(spark, d)).select("seq", "line")


@query("SELECT event_id, 30 * (2 ** (event_id % 4))::BIGINT AS wait_s FROM events")
def retry_backoff(spark, d):
    return table(spark, d, "events").select("event_id", runs.backoff_of(F.col("event_id") % 4 + 1).alias("wait_s"))


@query(
    f"""WITH {OBS}, c AS (SELECT id, floor(value * 10) / 10 AS c FROM obs WHERE metric = 'pm25')
    SELECT id, CASE WHEN c <= 9.0 THEN round(50 / 9.0 * c) WHEN c <= 35.4 THEN round(49 / 26.3 * (greatest(c, 9.1) - 9.1) + 51) WHEN c <= 55.4 THEN round(49 / 19.9 * (greatest(c, 35.5) - 35.5) + 101)
        WHEN c <= 125.4 THEN round(49 / 69.9 * (greatest(c, 55.5) - 55.5) + 151) WHEN c <= 225.4 THEN round(99 / 99.9 * (greatest(c, 125.5) - 125.5) + 201) WHEN c <= 325.4 THEN round(199 / 99.9 * (greatest(c, 225.5) - 225.5) + 301) ELSE 500 END::INTEGER AS aqi FROM c"""
)
def aqi_from_conc(spark, d):
    return observations(spark, d).where("metric = 'pm25'").select("id", units.aqi_pm25(F.col("value")).alias("aqi"))


@query(f"WITH {OBS} SELECT id, round(greatest(0.0, value * 0.7 - 1.5) + 1e-9, 4) + 0.0::DOUBLE AS corrected FROM obs WHERE metric = 'pm25'")
def pm_correction(spark, d):
    return observations(spark, d).where("metric = 'pm25'").select("id", r4(units.corrected(F.col("value"), 0.7, -1.5)).alias("corrected"))


@query(f"WITH {OBS} SELECT id, extract(hour FROM timestamp)::INTEGER AS hour_of_day, (extract(dow FROM timestamp) + 1)::INTEGER AS day_of_week FROM obs")
def calendar_features(spark, d):
    return observations(spark, d).select("id", F.hour("timestamp").alias("hour_of_day"), F.dayofweek("timestamp").alias("day_of_week"))


@query(
    r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS y FROM documents WHERE lang = 'en')
    SELECT doc_id, round(CASE WHEN w > 0 THEN 0.39 * w / s + 11.8 * greatest(y, w) / w - 15.59 END + 1e-9, 4) + 0.0::DOUBLE AS grade FROM n"""
)
def readability(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", r4(text.grade(F.col("text"))).alias("grade"))


# Normalizers over payloads made of the event table


def payloads(spark, d, body: F.Column) -> DataFrame:
    return table(spark, d, "events").select(F.to_json(body).alias("payload"))


def shown(found: DataFrame) -> DataFrame:
    return found.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), r4("lat").alias("lat"), r4("lon").alias("lon"), "metric", r4("value").alias("value"), "unit", "source", "source_entity_id")


def text_of(name: str) -> F.Column:
    return F.col(name).cast("string")


@query(
    f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN event_id % 4 = 0 THEN {LAT} ELSE 33.61 END::DOUBLE AS lat, CASE WHEN event_id % 4 = 0 THEN {LON} ELSE -84.52 END::DOUBLE AS lon,
        CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'pm10' ELSE 'ozone' END AS metric, round(value + 1e-9, 4) + 0.0::DOUBLE AS value, CASE event_type WHEN 'error' THEN 'ppm' ELSE 'ug/m3' END AS unit, 'epa_airnow' AS source,
        CASE WHEN event_id % 6 = 0 THEN 'unknown' ELSE user_id::VARCHAR END AS source_entity_id
    FROM events WHERE event_type IN ('click', 'view', 'error') AND event_id % 9 <> 0"""
)
def normalize_airnow(spark, d):
    o = F.struct(
        F.date_format("ts", "yyyy-MM-dd").alias("DateObserved"),
        F.hour("ts").alias("HourObserved"),
        F.when(F.col("event_id") % 6 != 0, text_of("user_id")).alias("ReportingArea"),
        F.when(F.col("event_id") % 4 != 0, 33.61).alias("Latitude"),
        F.when(F.col("event_id") % 4 != 0, -84.52).alias("Longitude"),
        F.expr("CASE event_type WHEN 'click' THEN 'PM2.5' WHEN 'view' THEN 'PM10' WHEN 'error' THEN 'OZONE' ELSE 'CO2' END").alias("ParameterName"),
        F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("Value"),
        F.expr("CASE event_type WHEN 'error' THEN 'PPM' ELSE 'UG/M3' END").alias("Unit"),
    )
    return shown(feeds.airnow(payloads(spark, d, F.struct(F.array(o).alias("observations")))))


@query(
    f"""SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN event_id % 2 = 0 THEN 34.1 ELSE {LAT} END::DOUBLE AS lat, CASE WHEN event_id % 2 = 0 THEN -84.2 ELSE {LON} END::DOUBLE AS lon,
        CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'ozone' ELSE 'bc' END AS metric, round(value + 1e-9, 4) + 0.0::DOUBLE AS value, CASE event_type WHEN 'view' THEN 'ppm' ELSE 'ug/m3' END AS unit, 'openaq' AS source, event_id::VARCHAR AS source_entity_id
    FROM events WHERE event_type IN ('click', 'view', 'error') AND event_id % 7 <> 0"""
)
def normalize_openaq(spark, d):
    place = F.struct(F.lit(LAT).alias("latitude"), F.lit(LON).alias("longitude"))
    own = F.when(F.col("event_id") % 2 == 0, F.struct(F.lit(34.1).alias("latitude"), F.lit(-84.2).alias("longitude")))
    latest = F.struct(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("datetime"), F.col("value"), own.alias("coordinates"))
    parameter = F.struct(F.expr("CASE event_type WHEN 'click' THEN 'PM25' WHEN 'view' THEN 'o3' WHEN 'error' THEN 'bc' ELSE 'pm4' END").alias("name"), F.expr("CASE event_type WHEN 'view' THEN 'ppm' ELSE 'µg/m³' END").alias("units"))
    sensor = F.struct(text_of("event_id").alias("id"), parameter.alias("parameter"), F.when(F.col("event_id") % 7 != 0, latest).alias("latest"))
    body = F.struct(F.array(F.struct(text_of("user_id").alias("id"), place.alias("coordinates"))).alias("locations"), F.create_map(text_of("user_id"), F.array(sensor)).alias("sensors_by_location_id"))
    return shown(feeds.openaq(payloads(spark, d, body)))


@query(
    f"""WITH e AS (SELECT *, 34.0515::DOUBLE + ((user_id * 37) % 201 - 100) * 0.008::DOUBLE AS lat, (-84.0713)::DOUBLE + ((user_id * 53) % 201 - 100) * 0.008::DOUBLE AS lon FROM events WHERE event_id % 3 <> 0 AND event_id % 11 <> 0),
    r AS (SELECT *, 'pm25' AS metric, 'ug/m3' AS unit, value AS v FROM e UNION ALL SELECT *, 'pm10', 'ug/m3', value * 2 FROM e WHERE event_id % 5 <> 0 UNION ALL SELECT *, 'humidity', 'percent', 44 FROM e)
    SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, round(lat + 1e-9, 4) + 0.0::DOUBLE AS lat, round(lon + 1e-9, 4) + 0.0::DOUBLE AS lon, metric, round(v + 1e-9, 4) + 0.0::DOUBLE AS value, unit, 'purpleair' AS source, user_id::VARCHAR AS source_entity_id
    FROM r WHERE {km_sql(str(LAT), str(LON), 'lat', 'lon')} <= 50"""
)
def normalize_purpleair(spark, d):
    names = ["sensor_index", "last_seen", "latitude", "longitude", "location_type", "pm2.5_atm", "pm10.0_atm", "humidity", "temperature"]
    place = lambda centre, by: F.lit(centre) + ((F.col("user_id") * by) % 201 - 100) * F.lit(0.008)
    seen = F.when(F.col("event_id") % 11 == 0, "not-a-time").otherwise(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    row = [text_of("user_id"), seen, place(34.0515, 37), place(-84.0713, 53), F.when(F.col("event_id") % 3 == 0, "1").otherwise("0"), F.col("value"), F.when(F.col("event_id") % 5 != 0, F.col("value") * 2), F.lit("44"), F.lit("warm")]
    return shown(feeds.purpleair(payloads(spark, d, F.struct(F.array(*map(F.lit, names)).alias("fields"), F.array(F.array(*[x.cast("string") for x in row])).alias("data")))))


@query(
    """WITH e AS (SELECT *, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events),
    r AS (SELECT *, 'temperature' AS metric, 'degC' AS unit, value AS v FROM e WHERE event_id % 4 <> 0 UNION ALL SELECT *, 'humidity', 'percent', 63 FROM e UNION ALL SELECT *, 'pressure', 'hPa', 1021 FROM e UNION ALL SELECT *, 'wind_speed', 'm/s', 5.1 FROM e
        UNION ALL SELECT *, 'precipitation', 'mm/h', CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END + 0.25 FROM e)
    SELECT r.at, 34.05::DOUBLE AS lat, (-84.07)::DOUBLE AS lon, metric, round(v::DOUBLE + 1e-9, 4) + 0.0::DOUBLE AS value, unit, 'openweather' AS source, 'grid:p' || user_id AS source_entity_id FROM r"""
)
def normalize_openweather(spark, d):
    number = lambda x, name: F.lit(x).alias(name)
    main = F.struct(F.when(F.col("event_id") % 4 == 0, "bad").otherwise(text_of("value")).alias("temp"), number("1021", "pressure"), number("63", "humidity"))
    body = F.struct(
        F.struct(number(-84.07, "lon"), number(34.05, "lat")).alias("coord"),
        main.alias("main"),
        F.struct(number("5.1", "speed")).alias("wind"),
        F.when(F.col("event_id") % 2 == 0, F.struct(number("0.5", "1h"))).alias("rain"),
        F.struct(number("0.25", "1h")).alias("snow"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
    )
    return shown(feeds.openweather(payloads(spark, d, F.struct(F.concat(F.lit("p"), "user_id").alias("point_id"), body.alias("payload")))))


@query(
    """WITH e AS (SELECT *, date_trunc('minute', ts) AS m, CASE WHEN user_id % 2 = 0 THEN 'VIIRS_SNPP_NRT' ELSE 'MODIS_NRT' END AS dataset FROM events),
    r AS (SELECT *, 'fire_radiative_power' AS metric, 'MW' AS unit, value AS v FROM e UNION ALL SELECT *, 'fire_confidence', 'percent', CASE WHEN user_id % 2 = 0 THEN 66 ELSE 87 END FROM e
        UNION ALL SELECT *, 'fire_brightness', 'K', 300 + value FROM e WHERE event_id % 5 <> 0)
    SELECT strftime(m, '%Y-%m-%d %H:%M:%S') AS at, 34.1::DOUBLE AS lat, (-84.2)::DOUBLE AS lon, metric, round(v::DOUBLE + 1e-9, 4) + 0.0::DOUBLE AS value, unit, 'nasa_firms' AS source, dataset || ':N20:34.10000:-84.20000:' || strftime(m, '%Y%m%d%H%M') AS source_entity_id FROM r"""
)
def normalize_firms(spark, d):
    e = table(spark, d, "events")
    viirs = F.col("user_id") % 2 == 0
    heat = F.when(F.col("event_id") % 5 != 0, (F.col("value") + 300).cast("string")).otherwise("")
    head = F.when(viirs, "latitude,longitude,bright_ti4,acq_date,acq_time,satellite,confidence,frp").otherwise("latitude,longitude,brightness,acq_date,acq_time,satellite,confidence,frp")
    line = F.concat_ws(",", F.lit("34.1"), F.lit("-84.2"), heat, F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "Hmm"), F.lit("N20"), F.when(viirs, "n").otherwise("87"), text_of("value"))
    return shown(feeds.fires(feeds.fire_rows(e.select(F.when(viirs, "VIIRS_SNPP_NRT").otherwise("MODIS_NRT").alias("dataset"), F.concat(head, F.lit("\n"), line, F.lit("\n")).alias("payload")))))


def placed_row(d: dict[str, F.Column]) -> F.Column:
    given = {"id": text_of("user_id"), "lat": F.lit("34.1"), "lon": F.lit("-84.2"), "time": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")} | d
    return F.struct(*[c.alias(n) for n, c in given.items()])


AT = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, 34.1::DOUBLE AS lat, (-84.2)::DOUBLE AS lon"


@query(
    f"""WITH e AS (SELECT *, {AT} FROM events), r AS (SELECT *, 'traffic_speed' AS metric, 'km/h' AS unit, value AS v FROM e UNION ALL SELECT *, 'traffic_freeflow', 'km/h', event_id % 3 * 50 FROM e
        UNION ALL SELECT *, 'traffic_congestion', 'ratio', 1 - value / (event_id % 3 * 50) FROM e WHERE event_id % 3 > 0)
    SELECT r.at, lat, lon, metric, round(v::DOUBLE + 1e-9, 4) + 0.0::DOUBLE AS value, unit, 'traffic' AS source, user_id::VARCHAR AS source_entity_id FROM r"""
)
def normalize_traffic(spark, d):
    row = placed_row({"current_speed": text_of("value"), "free_flow_speed": (F.col("event_id") % 3 * 50).cast("string")})
    return shown(planned.traffic(payloads(spark, d, F.struct(F.array(row).alias("segments")))))


@query(
    f"""SELECT {AT}, CASE event_type WHEN 'click' THEN 'streamflow' WHEN 'view' THEN 'ph' ELSE 'turbidity' END AS metric, round(value + 1e-9, 4) + 0.0::DOUBLE AS value, CASE event_type WHEN 'click' THEN 'ft3/s' WHEN 'view' THEN 'pH' ELSE 'FNU' END AS unit,
        'water_gauges' AS source, user_id::VARCHAR AS source_entity_id FROM events WHERE event_type IN ('click', 'view', 'error')"""
)
def normalize_water(spark, d):
    code = F.expr("CASE event_type WHEN 'click' THEN '00060' WHEN 'view' THEN '00400' WHEN 'error' THEN '63680' ELSE '99999' END")
    named = lambda c, n="value": F.array(F.struct(c.alias(n)))
    where = F.struct(F.struct(F.lit("34.1").alias("latitude"), F.lit("-84.2").alias("longitude")).alias("geogLocation"))
    reading = F.struct(text_of("value").alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime"))
    series = F.struct(
        F.struct(named(text_of("user_id")).alias("siteCode"), where.alias("geoLocation")).alias("sourceInfo"),
        F.struct(named(code).alias("variableCode")).alias("variable"),
        F.array(F.struct(F.array(reading).alias("value"))).alias("values"),
    )
    return shown(planned.water(payloads(spark, d, F.struct(F.struct(F.array(series).alias("timeSeries")).alias("value")))))


@query(
    f"""WITH e AS (SELECT *, {AT} FROM events), r AS (SELECT *, 'generation_mwh' AS metric, 'MWh' AS unit, value AS v FROM e UNION ALL SELECT *, 'co2_emissions', 't', value / 2 FROM e WHERE event_id % 2 = 0
        UNION ALL SELECT *, 'grid_carbon_intensity', 'g/kWh', 400 FROM e UNION ALL SELECT *, 'fuel_type', 'code', CASE event_id % 3 WHEN 0 THEN 1 ELSE 6 END FROM e WHERE event_id % 3 < 2)
    SELECT r.at, lat, lon, metric, round(v::DOUBLE + 1e-9, 4) + 0.0::DOUBLE AS value, unit, 'energy' AS source, user_id::VARCHAR AS source_entity_id FROM r"""
)
def normalize_energy(spark, d):
    row = placed_row({"generation_mwh": text_of("value"), "co2_emissions": F.when(F.col("event_id") % 2 == 0, (F.col("value") / 2).cast("string")).otherwise("n/a"), "grid_carbon_intensity": F.lit("400"), "fuel_type": F.expr("CASE event_id % 3 WHEN 0 THEN 'Coal' WHEN 1 THEN 'solar' ELSE 'peat' END")})
    return shown(planned.energy(payloads(spark, d, F.struct(F.array(row).alias("plants")))))


@query(
    f"""WITH {OBS} SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS at, round((floor(lat / 0.25) + 0.5) * 0.25 + 1e-9, 4) + 0.0::DOUBLE AS lat, round((floor(lon / 0.25) + 0.5) * 0.25 + 1e-9, 4) + 0.0::DOUBLE AS lon, 'no2_column' AS metric, round(avg(value) + 1e-9, 4) + 0.0::DOUBLE AS value,
        'mol/m2' AS unit, 'satellite' AS source, concat('cell:', floor(lat / 0.25)::BIGINT, ':', floor(lon / 0.25)::BIGINT) AS source_entity_id FROM obs GROUP BY date_trunc('hour', timestamp), floor(lat / 0.25), floor(lon / 0.25)"""
)
def satellite_grid(spark, d):
    pixels = observations(spark, d).select("timestamp", "lat", "lon", F.col("value").alias("no2_column"))
    return shown(planned.satellite_cells(pixels, "no2_column", 0.25, "mol/m2"))


@query("SELECT 'epa_airnow' AS source, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'nasa_firms', 2 * count(*) FROM events")
def union_sources(spark, d):
    """Two feeds through the registry into one table."""
    e = table(spark, d, "events")
    o = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("DateObserved"), F.hour("ts").alias("HourObserved"), F.when(F.col("event_id") % 2 == 0, "PM10").otherwise("pm10").alias("ParameterName"), F.col("value").alias("Value"))
    air = e.select(F.to_json(F.struct(F.array(o).alias("observations"))).alias("payload"))
    line = F.concat_ws(",", F.lit("34.1"), F.lit("-84.2"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "Hmm"), F.lit("high"), text_of("value"))
    fire = e.select(F.lit("MODIS_NRT").alias("dataset"), F.concat(F.lit("latitude,longitude,acq_date,acq_time,confidence,frp\n"), line).alias("payload"))
    return registry.normalize_all({"epa_airnow": air, "nasa_firms": fire}).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OBS} SELECT id FROM obs WHERE timestamp >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7200 SECONDS")
def fresh_readings(spark, d):
    return feeds.fresh(observations(spark, d), "2024-01-20 12:00:00", S.PURPLEAIR_MAX_AGE_S).select("id")


@query("SELECT count(DISTINCT user_id) AS n_locations, 2 * count(*) AS n_sensors, false AS truncated FROM events WHERE user_id % 3 > 0")
def openaq_sensors(spark, d):
    """Locations in the radius and their sensors; every third has coordinates outside."""
    place = F.struct(F.when(F.col("user_id") % 3 == 0, 10.0).otherwise(LAT).alias("latitude"), F.lit(LON).alias("longitude"))
    sensors = F.array(*[F.struct(F.concat(F.lit(x), text_of("event_id")).alias("id")) for x in "ab"])
    body = F.struct(F.array(F.struct(text_of("user_id").alias("id"), place.alias("coordinates"))).alias("locations"), F.create_map(text_of("user_id"), sensors).alias("sensors_by_location_id"))
    return feeds.openaq_tally(payloads(spark, d, body), S.RADIUS_KM)


# Store and status


@query(
    f"""WITH {OBS}, b AS (SELECT *, date_trunc('hour', timestamp) AS h FROM obs WHERE id % 3 > 0), s AS (SELECT DISTINCT source, metric, source_entity_id, date_trunc('hour', timestamp) AS h FROM obs WHERE id % 3 = 0)
    SELECT min(id) AS id, source, metric, source_entity_id, h AS timestamp FROM b ANTI JOIN s USING (source, metric, source_entity_id, h) GROUP BY ALL"""
)
def insert_ignore(spark, d):
    """Of hourly keys two thirds of the rows come in, one third is stored."""
    o = observations(spark, d).withColumn("timestamp", F.date_trunc("hour", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz"))
    return store.new_rows(o.where("id % 3 = 0"), o.where("id % 3 > 0"), ["id"]).select("id", *S.KEY)


@query(
    "SELECT min(l_linenumber) AS l_linenumber, l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 2 AND (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_linenumber <= 2) GROUP BY l_orderkey, l_partkey"
)
def insert_ignore_volume(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return store.new_rows(rows.where("l_linenumber <= 2"), rows.where("l_linenumber > 2"), ["l_linenumber"], key=("l_orderkey", "l_partkey"))


@query(
    f"""WITH {RUNS}, l AS (SELECT source, arg_max(success, (run_at, seq)) AS ok, max(run_at) FILTER (success) AS last_collected_at, max((run_at, seq)) FILTER (success) AS last FROM runs GROUP BY source)
    SELECT l.source AS name, CASE WHEN ok THEN 'active' ELSE 'error' END AS status, last_collected_at, (SELECT count(*) FROM runs AS r WHERE r.source = l.source AND NOT success AND (last IS NULL OR (run_at, seq) > last)) AS error_count FROM l"""
)
def source_status(spark, d):
    return store.source_status(run_log(spark, d))


@query(f"WITH {RUNS} SELECT source, count(*) FILTER (success) AS n_ok, count(*) FILTER (NOT success) AS n_failed, count(*) FILTER (success) = 0 AS all_failed FROM runs GROUP BY source")
def dataset_tally(spark, d):
    return runs.tally(run_log(spark, d))


@query(f"WITH {RUNS} SELECT CASE WHEN bool_and(success) THEN 0 ELSE 1 END AS exit_code FROM runs")
def exit_code(spark, d):
    return runs.exit_code(run_log(spark, d))


@query(f"WITH {RUNS} SELECT source, max(run_at) AS last_at, round(avg(success::INTEGER) + 1e-9, 4) + 0.0::DOUBLE AS success_rate, count(*) AS n_runs FROM runs GROUP BY source")
def source_health(spark, d):
    return rounded(rollup.source_health(run_log(spark, d)), "success_rate")


@query(f"WITH {RUNS} SELECT source, round(quantile_cont(duration_ms, 0.5) + 1e-9, 4) + 0.0::DOUBLE AS p50, round(quantile_cont(duration_ms, 0.95) + 1e-9, 4) + 0.0::DOUBLE AS p95, round(quantile_cont(duration_ms, 0.99) + 1e-9, 4) + 0.0::DOUBLE AS p99 FROM runs GROUP BY source")
def latency_pctl(spark, d):
    return rounded(runs.latency(run_log(spark, d)), "p50", "p95", "p99")


@query(f"WITH {RUNS} SELECT DISTINCT source FROM runs WHERE source <> 'purpleair'")
def sources_list(spark, d):
    """The interface's list of sources that ever ran."""
    return read.list_sources(run_log(spark, d).where("source <> 'purpleair'")).select(F.col("name").alias("source"))


@query(
    f"""WITH {RUNS}, l AS (SELECT source, max(run_at) AS last_at FROM runs WHERE run_at < TIMESTAMP '2024-01-19 12:00:00' OR (source IN ('openaq', 'purpleair') AND run_at < TIMESTAMP '2024-01-20 05:30:00') GROUP BY source)
    SELECT source, last_at FROM l WHERE CASE WHEN source IN ('openweather', 'nasa_firms', 'purpleair') THEN date_trunc('day', last_at - INTERVAL 6 HOURS) + INTERVAL 30 HOURS ELSE last_at + INTERVAL 60 MINUTES END <= TIMESTAMP '2024-01-20 05:59:00' UNION ALL SELECT 'traffic', NULL"""
)
def sources_due(spark, d):
    """Sources whose turn has come by the run log, some by the hour and some once a day."""
    log = run_log(spark, d)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    log = log.where((F.col("at") < at("2024-01-19 12:00:00")) | (F.col("source").isin("openaq", "purpleair") & (F.col("at") < at("2024-01-20 05:30:00"))))
    return runs.due(log, "2024-01-20 05:59:00", {"epa_airnow": 60, "openaq": 60, "traffic": 15}, {"openweather": 6, "nasa_firms": 6, "purpleair": 6}, zone="UTC")


# Validation


@query(
    f"""WITH {OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY source, metric, source_entity_id, date_trunc('day', timestamp) ORDER BY id) AS n FROM obs)
    SELECT id, array_to_string(list_filter([CASE WHEN id % 50 = 0 THEN 'schema' END, CASE WHEN id % 20 = 0 AND id % 50 <> 0 THEN 'range' END, CASE WHEN n > 1 THEN 'duplicate' END,
        CASE WHEN epoch(TIMESTAMP '2024-01-30') - epoch(date_trunc('day', timestamp)) > 120 * CASE source WHEN 'purpleair' THEN 15 WHEN 'nasa_firms' THEN 180 ELSE 60 END THEN 'stale' END], lambda x: x IS NOT NULL), ',') AS violations FROM k"""
)
def validate_rules(spark, d):
    o = observations(spark, d).withColumn("timestamp", F.date_trunc("day", F.col("timestamp").cast("timestamp")))
    o = o.withColumn("value", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 20 == 0, -1.0).otherwise(F.col("value")))
    return validate.with_violations(o, ["id"], now="2024-01-30").select("id", F.array_join("violations", ",").alias("violations"))


@query(f"WITH {OBS}, l AS (SELECT source, max(timestamp) AS last_at FROM obs WHERE timestamp < TIMESTAMP '2024-01-20' OR source = 'openaq' GROUP BY source) SELECT source, last_at FROM l WHERE epoch(TIMESTAMP '2024-01-21') - epoch(date_trunc('second', last_at)) > 120 * CASE source WHEN 'purpleair' THEN 15 WHEN 'nasa_firms' THEN 180 ELSE 60 END")
def stale_sources(spark, d):
    o = observations(spark, d).where("timestamp < TIMESTAMP_NTZ '2024-01-20' OR source = 'openaq'")
    return validate.stale_sources(o, "2024-01-21").select("source", "last_at")


# Rollups


@query(f"WITH {OBS} SELECT source, metric, unit, timestamp::DATE AS day, count(*) AS n, max(timestamp) AS last_at, round(avg(value) + 1e-9, 4) + 0.0::DOUBLE AS mean_value FROM obs GROUP BY ALL")
def source_daily_rollup(spark, d):
    return rounded(rollup.daily(observations(spark, d)), "mean_value")


Z = f"""WITH {OBS}, w AS (SELECT *, count(value) OVER b AS n_before, avg(value) OVER b AS mean_before, stddev_samp(value) OVER b AS sd_before FROM obs
    WINDOW b AS (PARTITION BY metric ORDER BY timestamp RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
    z AS (SELECT *, CASE WHEN n_before >= 10 AND sd_before > 0 THEN (value - mean_before) / sd_before END AS z FROM w)"""


def by_metric(spark, d) -> DataFrame:
    return detect.zscore(observations(spark, d), by=("metric",))


def with_severity(spark, d) -> DataFrame:
    z = by_metric(spark, d).where("z IS NOT NULL")
    return z.select("*", F.when(F.abs("z") > 3, "severe").when(F.abs("z") > 2, "moderate").otherwise("minor").alias("severity")).where("abs(z) > 1")


SEVERE = f"{Z}, a AS (SELECT *, CASE WHEN abs(z) > 3 THEN 'severe' WHEN abs(z) > 2 THEN 'moderate' ELSE 'minor' END AS severity FROM z WHERE abs(z) > 1)"


@query(f"{SEVERE} SELECT metric, severity, count(*) AS n FROM a GROUP BY CUBE (metric, severity)")
def anomaly_cube(spark, d):
    return rollup.cube(with_severity(spark, d))


@query(f"{SEVERE} SELECT id, severity FROM a WHERE severity = 'severe' AND metric = 'pm25' AND {km_sql(str(LAT), str(LON), 'lat', 'lon')} <= 60")
def feed_filter(spark, d):
    return read.feed(with_severity(spark, d), severity="severe", metric="pm25", lat=LAT, lon=LON, radius_km=60.0).select("id", "severity")


@query(f"{SEVERE} SELECT floor(lat / 0.1)::BIGINT AS cell_lat, floor(lon / 0.1)::BIGINT AS cell_lon, count(*) AS n FROM a GROUP BY ALL ORDER BY n DESC, cell_lat, cell_lon LIMIT 10")
def top_cells(spark, d):
    """The ten places of most anomalies."""
    return rollup.top_cells(with_severity(spark, d), 0.1, 10)


@query("SELECT event_type AS cause, count(*) AS n, round(avg(value / 100) + 1e-9, 4) + 0.0::DOUBLE AS mean_confidence FROM events WHERE event_id % 4 > 0 GROUP BY event_type ORDER BY n DESC, cause LIMIT 3")
def top_causes(spark, d):
    """The three causes that explanations name most."""
    return rounded(rollup.top_causes(explanations(spark, d), 3), "mean_confidence")


@query(f"WITH {OBS} SELECT floor(lat / 0.1)::BIGINT AS cell_lat, floor(lon / 0.1)::BIGINT AS cell_lon, metric, unit, round(avg(value) + 1e-9, 4) + 0.0::DOUBLE AS mean_value, count(*) AS n FROM obs GROUP BY ALL")
def grid_avg(spark, d):
    return rounded(rollup.grid_means(observations(spark, d), 0.1), "mean_value")


@query(f"WITH {OBS} SELECT source, source_entity_id, metric, timestamp, value, unit, lat, lon FROM obs QUALIFY row_number() OVER (PARTITION BY source, source_entity_id, metric ORDER BY timestamp DESC, id DESC) = 1")
def latest_per_entity(spark, d):
    return rollup.latest(observations(spark, d), "id")


@query(f"WITH {OBS}, c AS (SELECT metric, timestamp::DATE AS day, count(*) AS n FROM obs GROUP BY ALL) SELECT *, n - lag(n) OVER (PARTITION BY metric ORDER BY day) AS change FROM c")
def day_over_day(spark, d):
    return rollup.day_over_day(observations(spark, d))


@query(f"WITH {OBS} SELECT source_entity_id, metric, min(value) AS low, max(value) AS high, round(avg(value) + 1e-9, 4) + 0.0::DOUBLE AS mean_value, arg_max(value, timestamp) AS last_value, count(*) AS n FROM obs GROUP BY ALL")
def series_summary(spark, d):
    return rounded(rollup.series_summary(observations(spark, d)), "mean_value")


# Detectors


@query(f"{Z} SELECT id, n_before, round(mean_before + 1e-9, 4) + 0.0::DOUBLE AS mean_before, round(sd_before + 1e-9, 4) + 0.0::DOUBLE AS sd_before, round(z + 1e-9, 4) + 0.0::DOUBLE AS z, coalesce(abs(z) > 3, false) AS flagged FROM z")
def obs_zscore(spark, d):
    return rounded(by_metric(spark, d), "mean_before", "sd_before", "z").select("id", "n_before", "mean_before", "sd_before", "z", "flagged")


@query(f"{Z.replace('PARTITION BY metric', 'PARTITION BY source, source_entity_id, metric, unit')} SELECT id, round(z + 1e-9, 4) + 0.0::DOUBLE AS z FROM z WHERE abs(z) > 3")
def zscore_flags(spark, d):
    return rounded(detect.zscore(observations(spark, d)).where("flagged"), "z").select("id", "z")


SEASON = f"""WITH {OBS}, h AS (SELECT metric, date_trunc('hour', timestamp) AS hour, avg(value) AS value FROM obs GROUP BY ALL),
    t AS (SELECT *, avg(value) OVER (PARTITION BY metric ORDER BY hour RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND INTERVAL 12 HOURS FOLLOWING) AS trend FROM h),
    s AS (SELECT *, avg(value - trend) OVER (PARTITION BY metric, extract(hour FROM hour)) AS season FROM t), r AS (SELECT *, value - trend - season AS residual FROM s), f AS (SELECT *, stddev_samp(residual) OVER (PARTITION BY metric) AS sd FROM r)"""


@query(f"{SEASON} SELECT metric, strftime(hour, '%Y-%m-%d %H') AS hour, round(trend + 1e-9, 4) + 0.0::DOUBLE AS trend, round(season + 1e-9, 4) + 0.0::DOUBLE AS season, round(residual + 1e-9, 4) + 0.0::DOUBLE AS residual, coalesce(sd > 0 AND abs(residual) > 2.5 * sd, false) AS flagged FROM f")
def seasonal_residual(spark, d):
    found = rounded(detect.seasonal_residual(observations(spark, d)), "trend", "season", "residual")
    return found.select("metric", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "trend", "season", "residual", "flagged")


@query()
def loess_residual(spark, d):
    return rounded(detect.loess_residuals(observations(spark, d)), "trend", "season", "residual")


@query()
def stl_residual(spark, d):
    """Robust decomposition of each metric's hourly means."""
    return rounded(stl.robust_residuals(observations(spark, d)), "trend", "season", "residual", "weight")


#: Metrics of the event table that stand for weather and traffic.
STAND_INS = {"temperature": "pm10", "humidity": "ozone", "wind_speed": "no2", "traffic_density": "so2"}


@query(
    f"""WITH {OBS}, h AS (SELECT date_trunc('hour', timestamp) AS hour, avg(value) FILTER (metric = 'pm10') AS temperature, avg(value) FILTER (metric = 'ozone') AS humidity, avg(value) FILTER (metric = 'no2') AS wind_speed, avg(value) FILTER (metric = 'so2') AS traffic_density FROM obs GROUP BY ALL)
    SELECT id, {', '.join(f"round({c} + 1e-9, 4) + 0.0::DOUBLE AS {c}" for c in STAND_INS)}, extract(hour FROM timestamp)::INTEGER AS hour_of_day, (extract(dow FROM timestamp) + 1)::INTEGER AS day_of_week FROM obs JOIN h ON date_trunc('hour', timestamp) = hour"""
)
def forest_features(spark, d):
    o = observations(spark, d)
    return rounded(enrich.forest_features(o, o, STAND_INS), *STAND_INS).select("id", *STAND_INS, "hour_of_day", "day_of_week")


@query()
def iforest_scores(spark, d):
    """A forest of the 30 days before the last row's week scores all rows."""
    o = observations(spark, d)
    rows = enrich.forest_features(o, o, STAND_INS)
    return detect.isolation_forest(rows, list(detect.FOREST_FEATURES), training=detect.training_weeks(rows)).select("id", "score", "flagged")


@query(
    f"""WITH {OBS}, h AS (SELECT date_trunc('hour', timestamp) AS hour, floor(lat / 0.25) AS y, floor(lon / 0.25) AS x, avg(value) FILTER (metric = 'pm10') AS temperature, avg(value) FILTER (metric = 'ozone') AS humidity, avg(value) FILTER (metric = 'no2') AS wind_speed, avg(value) FILTER (metric = 'so2') AS traffic_density FROM obs GROUP BY ALL)
    SELECT id, {', '.join(f"round({c} + 1e-9, 4) + 0.0::DOUBLE AS {c}" for c in STAND_INS)} FROM obs JOIN h ON date_trunc('hour', timestamp) = hour AND floor(lat / 0.25) = y AND floor(lon / 0.25) = x"""
)
def forest_features_by_cell(spark, d):
    o = observations(spark, d)
    return rounded(enrich.forest_features(o, o, STAND_INS, degrees=0.25), *STAND_INS).select("id", *STAND_INS)


@query(
    f"""WITH {OBS}, w AS (SELECT DISTINCT date_trunc('week', timestamp) AS week FROM obs)
    SELECT strftime(week, '%Y-%m-%d') AS week, count(*) AS n, min(timestamp) AS first_at, max(timestamp) AS last_at FROM w JOIN obs ON timestamp < week AND timestamp >= week - INTERVAL 30 DAYS GROUP BY week"""
)
def weekly_training_sets(spark, d):
    """What each week's forest may learn from."""
    sets = detect.training_sets(observations(spark, d))
    return sets.groupBy(F.date_format("week", "yyyy-MM-dd").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


@query()
def weekly_forest_scores(spark, d):
    """Every row scored by the forest of its own week, which saw the 30 days before it."""
    o = observations(spark, d)
    rows = written(enrich.forest_features(o, o, STAND_INS, degrees=0.25), "features")
    models = written(detect.weekly_forests(rows, list(detect.FOREST_FEATURES)), "forests")
    return detect.weekly_scores(rows, models, list(detect.FOREST_FEATURES)).select("id", "score", "flagged")


@query(f"WITH {OBS}, w AS (SELECT date_trunc('week', max(timestamp)) AS start FROM obs) SELECT id FROM obs, w WHERE timestamp < start AND timestamp >= start - INTERVAL 30 DAYS")
def forest_training(spark, d):
    return detect.training_weeks(observations(spark, d)).select("id")


@query(
    f"""{Z}, h AS (SELECT metric, avg(value) AS m, stddev_samp(value) AS s FROM obs GROUP BY metric),
    f AS (SELECT id, 'zscore' AS method FROM z WHERE abs(z) > 2 UNION ALL SELECT id, 'level' FROM obs JOIN h USING (metric) WHERE value > m + 2 * s UNION ALL SELECT id, 'high' FROM obs WHERE value > 100),
    c AS (SELECT id, count(DISTINCT method) AS n_methods, array_to_string(list_sort(list_distinct(list(method))), ',') AS methods FROM f GROUP BY id)
    SELECT id, n_methods, methods, CASE WHEN n_methods >= 3 OR (metric = 'pm25' AND value >= 225.5) OR (metric = 'pm10' AND value >= 425) THEN 'severe' WHEN n_methods = 2 THEN 'moderate' ELSE 'minor' END AS severity FROM c JOIN obs USING (id)"""
)
def consensus_severity(spark, d):
    o = observations(spark, d)
    level = o.groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    flags = [
        by_metric(spark, d).where("abs(z) > 2").select("id", F.lit("zscore").alias("method")),
        o.join(F.broadcast(level), "metric").where("value > m + 2 * s").select("id", F.lit("level").alias("method")),  # one row for each metric
        o.where("value > 100").select("id", F.lit("high").alias("method")),
    ]
    found = detect.consensus(flags[0].unionByName(flags[1]).unionByName(flags[2]), o, "id")
    return found.select("id", "n_methods", F.array_join("methods", ",").alias("methods"), "severity")


@query(
    f"""{Z}, a AS (SELECT *, floor(lat / 0.1)::BIGINT AS cell_lat, floor(lon / 0.1)::BIGINT AS cell_lon FROM z WHERE abs(z) > 1),
    g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w > INTERVAL 30 MINUTES OR lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY metric, cell_lat, cell_lon ORDER BY timestamp, id)),
    e AS (SELECT *, sum(new) OVER (PARTITION BY metric, cell_lat, cell_lon ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS event FROM g)
    SELECT metric, cell_lat, cell_lon, event::BIGINT AS event, min(timestamp) AS first_at, max(timestamp) AS last_at, count(*) AS n FROM e GROUP BY ALL"""
)
def merge_runs(spark, d):
    a = rollup.cells(by_metric(spark, d).where("abs(z) > 1").withColumn("score", F.col("z")), 0.1)
    return detect.merge_gaps(a).drop("representative")


@query(
    f"""{Z}, a AS (SELECT * FROM z WHERE abs(z) > 1.5)
    SELECT a.metric, a.id, b.id AS id_b FROM a JOIN a AS b ON a.metric = b.metric AND a.id < b.id AND abs(epoch_us(a.timestamp) - epoch_us(b.timestamp)) <= 1800000000 WHERE {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 10"""
)
def merge_pairs(spark, d):
    return detect.near_pairs(by_metric(spark, d).where("abs(z) > 1.5"))


@query(
    f"""{Z.replace('WITH', 'WITH RECURSIVE', 1)}, a AS (SELECT * FROM z WHERE abs(z) > 1.5),
    p AS (SELECT a.id, b.id AS id_b FROM a JOIN a AS b ON a.metric = b.metric AND a.id <> b.id AND abs(epoch_us(a.timestamp) - epoch_us(b.timestamp)) <= 1800000000 WHERE {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 10),
    r(id, c) AS (SELECT id, id FROM a UNION SELECT p.id_b, r.c FROM r JOIN p USING (id)), e AS (SELECT id, min(c) AS event FROM r GROUP BY id)
    SELECT event, metric, min(timestamp) AS first_at, max(timestamp) AS last_at, count(*) AS n, arg_min(id, (-abs(z), timestamp, id)) AS representative FROM e JOIN a USING (id) GROUP BY event, metric"""
)
def merge_events(spark, d):
    """Anomalies within 30 minutes and 10 km of each other, over any number of steps, are one event."""
    a = written(by_metric(spark, d).where("abs(z) > 1.5").withColumn("score", F.col("z")), "anomalies")
    return detect.events(detect.merge_near(a))


PLACED = """places AS (SELECT s_suppkey AS id, s_acctbal AS value, 'pm25' AS metric, TIMESTAMP '2024-01-01' + INTERVAL (s_suppkey * 37 % 240) MINUTE AS timestamp,
    (70 + s_suppkey * 41 % 31 * 0.01::DOUBLE) AS lat, CASE WHEN (179.85::DOUBLE + s_suppkey * 67 % 31 * 0.01::DOUBLE) > 180 THEN (179.85::DOUBLE + s_suppkey * 67 % 31 * 0.01::DOUBLE) - 360 ELSE (179.85::DOUBLE + s_suppkey * 67 % 31 * 0.01::DOUBLE) END::DOUBLE AS lon FROM supplier)"""


@query(
    f"""WITH {PLACED} SELECT a.metric, a.id, b.id AS id_b FROM places AS a JOIN places AS b ON a.id < b.id AND abs(epoch_us(a.timestamp) - epoch_us(b.timestamp)) <= 1800000000 WHERE {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 10"""
)
def merge_pairs_far_north(spark, d):
    """Suppliers placed around 70 degrees north, on both sides of the 180th meridian: cells there are as complete as elsewhere."""
    lon = F.lit(179.85) + F.col("s_suppkey") * 67 % 31 * F.lit(0.01)
    at = (F.lit("2024-01-01").cast("timestamp_ntz").cast("timestamp").cast("long") + F.col("s_suppkey") * 37 % 240 * 60).cast("timestamp")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("pm25").alias("metric"), at.alias("timestamp"), (F.lit(70.0) + F.col("s_suppkey") * 41 % 31 * F.lit(0.01)).alias("lat"), F.when(lon > 180, lon - 360).otherwise(lon).alias("lon"))
    return detect.near_pairs(s)


# Enrichment


def few(spark, d) -> DataFrame:
    return by_metric(spark, d).where("abs(z) > 2.5")


FEW = f"{Z}, a AS (SELECT * FROM z WHERE abs(z) > 2.5)"


@query(
    f"""{FEW}, m AS (SELECT a.id AS anomaly, o.source, o.metric, o.id AS reading, o.value, abs(epoch_us(o.timestamp) - epoch_us(a.timestamp)) AS gap, o.timestamp AS t FROM a JOIN obs AS o ON o.source <> a.source AND abs(epoch_us(o.timestamp) - epoch_us(a.timestamp)) <= 3600000000
        WHERE {km_sql('a.lat', 'a.lon', 'o.lat', 'o.lon')} <= 25)
    SELECT anomaly, source, metric, reading, value FROM m QUALIFY row_number() OVER (PARTITION BY anomaly, source, metric ORDER BY gap, t, reading) = 1"""
)
def concurrent_asof(spark, d):
    return enrich.concurrent(few(spark, d), observations(spark, d))


@query(f"WITH {OBS}, l AS (SELECT * FROM obs WHERE metric = 'ozone'), r AS (SELECT * FROM obs WHERE metric = 'pm25') SELECT l.id, r.value AS as_of_value FROM l ASOF LEFT JOIN r ON l.source = r.source AND l.timestamp >= r.timestamp")
def as_of_reading(spark, d):
    o = observations(spark, d)
    return enrich.as_of(o.where("metric = 'ozone'").select("id", "source", "timestamp"), o.where("metric = 'pm25'"), ["source"], "value").select("id", "as_of_value")


@query(
    f"""{FEW} SELECT a.id AS anomaly, count(*) AS n, min(o.value) AS low, max(o.value) AS high, round(avg(o.value) + 1e-9, 4) + 0.0::DOUBLE AS mean_value, arg_max(o.value, o.timestamp) AS last_value
    FROM a JOIN obs AS o ON a.source_entity_id = o.source_entity_id AND a.metric = o.metric AND o.timestamp BETWEEN a.timestamp - INTERVAL 72 HOURS AND a.timestamp GROUP BY a.id"""
)
def history_72h(spark, d):
    return rounded(enrich.history(few(spark, d), observations(spark, d)), "mean_value")


BEARING = "(degrees(atan2(sin(radians(p.lon - a.lon)) * cos(radians(p.lat)), cos(radians(a.lat)) * sin(radians(p.lat)) - sin(radians(a.lat)) * cos(radians(p.lat)) * cos(radians(p.lon - a.lon)))) + 360) % 360"


@query(f"{FEW}, {PLACES} SELECT a.id, p.facility, round({km_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} + 1e-9, 4) + 0.0::DOUBLE AS km FROM a JOIN places AS p ON true WHERE {km_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} <= 25")
def near_facilities(spark, d):
    return rounded(enrich.within(few(spark, d), facilities(spark, d), 25.0, "id", "facility"), "km").select("id", "facility", "km")


@query(
    f"""{FEW}, p AS (SELECT id AS fire, lat, lon FROM obs WHERE source = 'nasa_firms' AND value > 20), n AS (SELECT a.id, p.fire, {km_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} AS km, {BEARING} AS turn FROM a, p),
    k AS (SELECT * FROM n WHERE km <= 100 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(km, 6), fire) <= 10)
    SELECT id, fire, round(km + 1e-9, 4) + 0.0::DOUBLE AS km, CASE WHEN km > 0 THEN ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][(floor((turn + 22.5) / 45)::INTEGER % 8) + 1] END AS wind FROM k"""
)
def near_fires(spark, d):
    """The ten nearest fires within 100 km; one at the very place has no direction."""
    fires = observations(spark, d).where("source = 'nasa_firms' AND value > 20").withColumnRenamed("id", "fire")
    found = enrich.within(few(spark, d), fires, 100.0, "id", "fire", nearest=10).withColumn("wind", F.when(F.col("km") > 0, F.col("wind")))
    return rounded(found, "km").select("id", "fire", "km", "wind")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def location_lookup(spark, d):
    """Places with their dimensions, which may be missing; Spark broadcasts what its statistics show to be small."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "n_name", "r_name")


@query(
    f"""WITH {OBS} SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H') AS hour, round(avg(value) FILTER (metric = 'pm25') + 1e-9, 4) + 0.0::DOUBLE AS pm25, round(avg(value) FILTER (metric = 'ozone') + 1e-9, 4) + 0.0::DOUBLE AS ozone,
    extract(hour FROM date_trunc('hour', timestamp))::INTEGER AS hour_of_day, (extract(dow FROM date_trunc('hour', timestamp)) + 1)::INTEGER AS day_of_week FROM obs GROUP BY date_trunc('hour', timestamp)"""
)
def feature_pivot(spark, d):
    return rounded(enrich.features(observations(spark, d), ["pm25", "ozone"]), "pm25", "ozone").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


ALERTS = """alerts AS (SELECT c_custkey AS alert, 34.0515::DOUBLE + (c_custkey % 11 - 5) * 0.1::DOUBLE AS lat, (-84.0713)::DOUBLE + (c_custkey % 13 - 6) * 0.1::DOUBLE AS lon, 30 AS radius_km,
    TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 700) HOUR AS starts, TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 700 + 30) HOUR AS ends FROM customer)"""


def alerts(spark, d) -> DataFrame:
    """An alert of 30 hours for each customer."""
    c, day = F.col("c_custkey"), F.lit("2024-01-01").cast("timestamp").cast("long")
    hours = lambda more: (day + (c % 700 + more) * 3600).cast("timestamp").cast("timestamp_ntz")
    return table(spark, d, "customer").select(c.alias("alert"), (F.lit(34.0515) + (c % 11 - 5) * F.lit(0.1)).alias("lat"), (F.lit(-84.0713) + (c % 13 - 6) * F.lit(0.1)).alias("lon"), F.lit(30.0).alias("radius_km"), hours(0).alias("starts"), hours(30).alias("ends"))


@query(f"{FEW}, {ALERTS} SELECT DISTINCT a.id, l.alert FROM a JOIN alerts AS l ON a.timestamp BETWEEN l.starts AND l.ends WHERE {km_sql('a.lat', 'a.lon', 'l.lat', 'l.lon')} <= l.radius_km")
def active_alerts(spark, d):
    return enrich.active_alerts(few(spark, d), alerts(spark, d))


@query(f"{FEW}, u AS (SELECT source_entity_id, metric, extract(hour FROM timestamp) AS h, avg(value) AS usual FROM obs GROUP BY ALL) SELECT a.id, round(usual + 1e-9, 4) + 0.0::DOUBLE AS usual FROM a JOIN u ON a.source_entity_id = u.source_entity_id AND a.metric = u.metric AND extract(hour FROM a.timestamp) = h")
def usual_value(spark, d):
    return rounded(enrich.baseline(few(spark, d), observations(spark, d)), "usual")


@query(
    f"""{FEW}, {PLACES}, {ALERTS}, p AS (SELECT id AS fire, lat, lon FROM obs WHERE source = 'nasa_firms' AND value > 50),
    f AS (SELECT a.id, least(count(*), 10) AS n FROM a JOIN places AS p ON true WHERE {km_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} <= 25 GROUP BY a.id),
    g AS (SELECT a.id, least(count(*), 10) AS n FROM a JOIN p ON true WHERE {km_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} <= 100 GROUP BY a.id),
    c AS (SELECT a.id, count(DISTINCT (o.source, o.metric)) AS n FROM a JOIN obs AS o ON o.source <> a.source AND abs(epoch_us(o.timestamp) - epoch_us(a.timestamp)) <= 3600000000 WHERE {km_sql('a.lat', 'a.lon', 'o.lat', 'o.lon')} <= 25 GROUP BY a.id),
    l AS (SELECT a.id, count(DISTINCT l.alert) AS n FROM a JOIN alerts AS l ON a.timestamp BETWEEN l.starts AND l.ends WHERE {km_sql('a.lat', 'a.lon', 'l.lat', 'l.lon')} <= l.radius_km GROUP BY a.id)
    SELECT a.id, coalesce(f.n, 0)::INTEGER AS n_facilities, coalesce(g.n, 0)::INTEGER AS n_fires, coalesce(c.n, 0)::INTEGER AS n_concurrent, coalesce(l.n, 0)::INTEGER AS n_alerts
    FROM a LEFT JOIN f USING (id) LEFT JOIN g USING (id) LEFT JOIN c USING (id) LEFT JOIN l USING (id)"""
)
def enrich_record(spark, d):
    return records(spark, d, most_alerts=0).select("id", *[F.size(c).alias(f"n_{c}") for c in ("facilities", "fires", "concurrent")], F.col("n_alerts").cast("int").alias("n_alerts"))


def records(spark, d, anomalies: DataFrame | None = None, **settings) -> DataFrame:
    o = observations(spark, d)
    fires = o.where("source = 'nasa_firms' AND value > 50").withColumnRenamed("id", "fire")
    anomalies = written(few(spark, d), "anomalies") if anomalies is None else anomalies
    return enrich.enriched(anomalies, o, facilities(spark, d), fires, alerts(spark, d), **settings)


@query()
def enrich_context(spark, d):
    return enrich.context_document(records(spark, d)).select("id", "document")


@query()
def context_budget(spark, d):
    """Documents of the same records that are held to their budget of tokens."""
    a = written(few(spark, d), "anomalies")
    series = context.series(a, observations(spark, d))
    found = records(spark, d, a, most_alerts=context.MOST, besides=(series,))
    return context.documents(found).select("id", "document", "n_tokens", (F.col("n_tokens") <= context.MOST).alias("fits"))


@query(
    r"""WITH i AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS place, ascii(o_orderpriority) - 48 AS rank, o_orderpriority AS section, printf('%d %s %.2f', o_orderkey, o_orderstatus, o_totalprice) AS item FROM orders),
    t AS (SELECT *, len(regexp_extract_all(item, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) + 1 AS n_tokens, CASE WHEN place = 0 THEN len(regexp_extract_all(section, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) + 9 ELSE 0 END AS title FROM i),
    k AS (SELECT *, rank = 0 OR sum(title) OVER (PARTITION BY doc) + sum(n_tokens) OVER (PARTITION BY doc ORDER BY rank, place ROWS UNBOUNDED PRECEDING) <= 100 AS kept FROM t)
    SELECT doc, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_left_out, sum(n_tokens) FILTER (kept)::BIGINT AS n_tokens FROM k GROUP BY doc"""
)
def token_budget(spark, d):
    """Customers' orders as the items of documents of a hundred tokens, by priority."""
    o = table(spark, d, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")) - 1
    items = o.select(F.col("o_custkey").alias("doc"), (F.ascii("o_orderpriority") - 48).alias("rank"), F.col("o_orderpriority").alias("section"), place.alias("place"), F.format_string("%d %s %.2f", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double")).alias("item"))
    judged = context.fitted(items, "doc", 100)
    return judged.groupBy("doc").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_left_out"), F.sum(F.when(F.col("kept"), F.col("n_tokens").cast("long"))).alias("n_tokens"))


# Retrieval and evaluation


@query(
    """WITH n AS (SELECT q.vec_id AS query, e.vec_id AS chunk, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS near FROM embeddings AS q, embeddings AS e WHERE q.vec_id % 20 = 0)
    SELECT query, chunk, round(near + 1e-9, 4) + 0.0::DOUBLE AS similarity FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY near DESC, chunk) <= 5"""
)
def retrieve_top5(spark, d):
    """The five nearest of all vectors for every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return rounded(evaluate.top_chunks(queries, e.withColumnRenamed("vec_id", "chunk"), 5), "similarity").select("query", "chunk", "similarity")


@query(
    f"""WITH {OBS}, t AS (SELECT id, source_entity_id, CASE metric WHEN 'pm25' THEN 'PM2.5' ELSE metric END AS named, metric, printf('%.2f', value * (CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.01 WHEN 2 THEN 1.2 ELSE 0.97 END)::DOUBLE)::DOUBLE AS v, CASE WHEN id % 5 > 0 THEN timestamp::DATE END AS day FROM obs WHERE id % 2 = 0 OR metric = 'pm25'),
    j AS (SELECT t.id, t.metric, bool_or(coalesce(abs(t.v - o.value) <= abs(o.value) * 0.1, false)) AS verified FROM t LEFT JOIN obs AS o ON o.source_entity_id = t.source_entity_id AND o.metric = t.metric AND (t.day IS NULL OR o.timestamp::DATE = t.day) GROUP BY ALL)
    SELECT metric, count(*) AS n_claims, count(*) FILTER (verified) AS n_verified, count(*) FILTER (NOT verified) AS n_marked FROM j GROUP BY metric"""
)
def claims_in_text(spark, d):
    """A sentence about each reading, some off by a few percent and some by twenty, held against all readings of its place."""
    o = observations(spark, d)
    value = F.format_string("%.2f", F.col("value") * F.expr("cast(CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.01 WHEN 2 THEN 1.2 ELSE 0.97 END AS double)"))
    body = F.concat(F.lit("The level of "), F.when(F.col("metric") == "pm25", "PM2.5").otherwise(F.col("metric")), F.lit(" was "), value, F.lit(" ug/m3"), F.when(F.col("id") % 5 > 0, F.concat(F.lit(" on "), F.date_format("timestamp", "yyyy-MM-dd"))).otherwise(""), F.lit("."))
    texts = o.where("id % 2 = 0 OR metric = 'pm25'").select("id", "source_entity_id", body.alias("body"), F.col("metric").alias("about"))
    stated = evaluate.claims(texts, "id", "body").join(texts.select("id", "source_entity_id"), "id")
    judged = evaluate.annotated(texts, evaluate.supported(stated, o, ["source_entity_id"]), "id", "body")
    return judged.groupBy(F.col("about").alias("metric")).agg(F.sum("n_claims").alias("n_claims"), F.sum("n_verified").alias("n_verified"), F.count_if(F.contains("marked", F.lit("[unverified]"))).alias("n_marked"))


#: The four corpora of the knowledge store.
CORPORA = ("guidelines", "science", "patterns", "geography")


def knowledge(spark, d) -> DataFrame:
    """The vectors as chunks of four corpora."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk"), "embedding", F.element_at(F.array(*map(F.lit, CORPORA)), (F.col("vec_id") % 4 + 1).cast("int")).alias("corpus"))


def asked(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")


@query(
    """WITH n AS (SELECT q.vec_id AS query, e.vec_id AS chunk, CASE e.vec_id % 4 WHEN 0 THEN 'guidelines' WHEN 1 THEN 'science' WHEN 2 THEN 'patterns' ELSE 'geography' END AS corpus, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS near FROM embeddings AS q, embeddings AS e WHERE q.vec_id % 20 = 0)
    SELECT query, corpus, chunk, round(near + 1e-9, 4) + 0.0::DOUBLE AS similarity FROM n QUALIFY row_number() OVER (PARTITION BY query, corpus ORDER BY near DESC, chunk) <= 2"""
)
def retrieve_by_corpus(spark, d):
    """The two nearest chunks of each corpus by the index's exact search."""
    index = retrieval.build(knowledge(spark, d))
    found = [retrieval.search(asked(spark, d), index, 2, where=f"corpus = '{c}'").withColumn("corpus", F.lit(c)) for c in CORPORA]
    return rounded(functools.reduce(DataFrame.unionByName, found), "similarity").select("query", "corpus", "chunk", "similarity")


@query()
def retrieve_indexed(spark, d):
    """The five nearest chunks by as many lists of the index as nine tenths of them need."""
    index = retrieval.build(knowledge(spark, d))
    index.lists = written(index.lists, "lists")
    queries = asked(spark, d)
    return rounded(retrieval.search(queries, index, 5, retrieval.calibrate(queries, index, 5, 0.95)), "similarity")


@query(
    f"""WITH {OBS}, claims AS (SELECT DISTINCT source, metric, timestamp::DATE AS day FROM obs), evidence AS (SELECT DISTINCT source, metric, timestamp::DATE AS day FROM obs WHERE value > 15), v AS (SELECT c.*, e.day IS NOT NULL AS verified FROM claims AS c LEFT JOIN evidence AS e USING (source, metric, day))
    SELECT source, round(avg(verified::INTEGER) + 1e-9, 4) + 0.0::DOUBLE AS share, count(*) AS n, count(DISTINCT metric) AS n_metrics FROM v GROUP BY source"""
)
def claim_grounding(spark, d):
    o = observations(spark, d).withColumn("day", F.to_date("timestamp"))
    claims = o.select("source", "metric", "day").distinct().withColumn("claim", F.concat_ws(" ", "source", "metric", "day"))
    found = evaluate.grounded(claims, o.where("value > 15"), ["source", "metric", "day"])
    return rounded(found.groupBy("source").agg(F.avg(F.col("verified").cast("int")).alias("share"), F.count(F.lit(1)).alias("n"), F.count_distinct("metric").alias("n_metrics")), "share")


@query(
    """WITH n AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n)::BIGINT AS total, sum(n) FILTER (a = b) AS same FROM n),
    c AS (SELECT sum(x.n * y.n)::DOUBLE AS chance FROM (SELECT a AS v, sum(n) AS n FROM n GROUP BY a) AS x JOIN (SELECT b AS v, sum(n) AS n FROM n GROUP BY b) AS y USING (v))
    SELECT total, round(same / total + 1e-9, 4) + 0.0::DOUBLE AS observed, round(chance / (total * total) + 1e-9, 4) + 0.0::DOUBLE AS expected, round((same / total - chance / (total * total)) / (1 - chance / (total * total)) + 1e-9, 4) + 0.0::DOUBLE AS kappa FROM t, c"""
)
def kappa(spark, d):
    return rounded(evaluate.kappa(table(spark, d, "labels"), "quality", "toxic"), "observed", "expected", "kappa")


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS cause, round(value / 100 + 1e-9, 4) + 0.0::DOUBLE AS confidence FROM events")
def explanation_metadata(spark, d):
    return rounded(explanations(spark, d), "confidence").select("event_id", "cause", "confidence")


def explanations(spark, d) -> DataFrame:
    meta = F.to_json(F.struct(F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("cause"), (F.col("value") / 100).alias("confidence")))
    return evaluate.metadata(table(spark, d, "events").select("event_id", meta.alias("metadata")))


@query("SELECT event_type, count(*) FILTER (user_id % 7 BETWEEN 1 AND 5) AS n, round(avg(user_id % 7) FILTER (user_id % 7 BETWEEN 1 AND 5) + 1e-9, 4) + 0.0::DOUBLE AS mean_rating, round(stddev_samp(user_id % 7) FILTER (user_id % 7 BETWEEN 1 AND 5) + 1e-9, 4) + 0.0::DOUBLE AS sd_rating FROM events GROUP BY event_type")
def likert(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 7).alias("rating"))
    return rounded(evaluate.likert(e, ["event_type"]), "mean_rating", "sd_rating")


@query(
    """WITH s AS (SELECT CASE event_type WHEN 'click' THEN 'full' ELSE event_type END AS variant, user_id AS item, value AS score FROM events), f AS (SELECT item, avg(score) AS f FROM s WHERE variant = 'full' GROUP BY item), p AS (SELECT variant, item, avg(score) AS p FROM s WHERE variant <> 'full' GROUP BY ALL)
    SELECT variant, count(*) AS n, round(avg(p) + 1e-9, 4) + 0.0::DOUBLE AS mean_score, round(avg(f) + 1e-9, 4) + 0.0::DOUBLE AS mean_full, round(avg(f) - avg(p) + 1e-9, 4) + 0.0::DOUBLE AS lost FROM p JOIN f USING (item) GROUP BY variant"""
)
def ablation(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "click", "full").otherwise(F.col("event_type")).alias("variant"), F.col("user_id").alias("item"), F.col("value").alias("score"))
    return rounded(evaluate.ablation(e), "mean_score", "mean_full", "lost")


# Landed files


@query(f"WITH {OBS} SELECT metric, count(*) AS n, round(sum(value) + 1e-9, 4) + 0.0::DOUBLE AS total, min(timestamp) AS first_at, max(source_entity_id) AS last_entity FROM obs WHERE source IN ('openaq', 'purpleair') AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20' AND lat > 33.9 AND lon <= -84.0 GROUP BY metric")
def landed_observations(spark, d):
    """Observations landed as files, read by the data source with conditions on source, time and box."""
    import uuid

    base = f"{shared_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    rows = observations(spark, d).drop("id").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows.write.partitionBy("source").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(base)
    found = landed.register(spark).read.format(landed.FORMAT).load(base)
    at = lambda text: F.lit(text).cast("timestamp_ntz").cast("timestamp")
    kept = found.where(F.col("source").isin("openaq", "purpleair") & (F.col("timestamp") >= at("2024-01-05")) & (F.col("timestamp") < at("2024-01-20")) & (F.col("lat") > 33.9) & (F.col("lon") <= -84.0))
    out = kept.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("timestamp").cast("timestamp_ntz").alias("first_at"), F.max("source_entity_id").alias("last_entity"))
    return rounded(out, "total")


# Alerts


#: Corners of an alert's area around its supplier, in degrees north and east.
CORNERS = ((-0.1003, -0.1009), (-0.1003, 0.1507), (0.0511, 0.2003), (0.2009, 0.0007), (0.0307, -0.0203))


def edges_sql() -> str:
    """Edges that a line to the east of a place crosses."""
    at = lambda i: (f"printf('%.4f', p.lat + {CORNERS[i % 5][0]})::DOUBLE", f"printf('%.4f', p.lon + {CORNERS[i % 5][1]})::DOUBLE")
    cross = [f"(CASE WHEN (({a[0]}) > o.lat) <> (({b[0]}) > o.lat) AND o.lon < ({b[1]} - {a[1]}) * (o.lat - {a[0]}) / ({b[0]} - {a[0]}) + {a[1]} THEN 1 ELSE 0 END)" for a, b in ((at(i), at(i + 1)) for i in range(5))]
    return " + ".join(cross)


@query(
    f"""WITH {OBS}, {PLACES}, a AS (SELECT facility, lat, lon, TIMESTAMP '2024-01-01' + INTERVAL (facility * 7 % 700) HOUR AS starts, CASE WHEN facility % 3 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (facility * 7 % 700 + facility * 11 % 240) HOUR END AS ends FROM places WHERE facility % 7 > 0)
    SELECT 'alert-' || facility AS alert, count(*) AS n, min(timestamp) AS first_at, max(timestamp) AS last_at FROM a AS p JOIN obs AS o ON o.timestamp >= starts AND (ends IS NULL OR o.timestamp <= ends)
    WHERE CASE WHEN facility % 4 = 0 THEN {km_sql("printf('%.4f', p.lat)::DOUBLE", "printf('%.4f', p.lon)::DOUBLE", 'o.lat', 'o.lon')} <= 12 ELSE ({edges_sql()}) % 2 = 1 END GROUP BY facility"""
)
def alert_zones(spark, d):
    """Alert messages around the suppliers, areas and circles, every third without an end and every seventh cancelled, with the readings that each holds."""
    number = lambda c: F.format_string("%.4f", c)
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    hours = lambda n: F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=n.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.col("facility")
    corners = F.array_join(F.array(*[F.concat(number(F.col("lat") + y), F.lit(","), number(F.col("lon") + x)) for y, x in (*CORNERS, CORNERS[0])]), " ")
    area = F.when(k % 4 == 0, tag("circle", F.concat(number(F.col("lat")), F.lit(","), number(F.col("lon")), F.lit(" 12")))).otherwise(tag("polygon", corners))
    info = F.concat(tag("event", F.lit("Air Stagnation")), tag("onset", hours(k * 7 % 700)), F.when(k % 3 > 0, tag("expires", hours(k * 7 % 700 + k * 11 % 240))).otherwise(""), tag("area", F.concat(tag("areaDesc", F.lit("around a supplier")), area)))
    message = F.concat(F.lit('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'), tag("identifier", F.concat(F.lit("alert-"), k)), tag("msgType", F.when(k % 7 == 0, "Cancel").otherwise("Alert")), tag("info", info), F.lit("</alert>"))
    found = written(reference.alerts(facilities(spark, d).select(message.alias("payload"))), "alerts")
    return zones.tallied(observations(spark, d), found, "alert")


@query(
    """WITH v AS (SELECT l_suppkey AS facility, l_shipdate::DATE AS day FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT facility, count(*) AS n FROM v WHERE day BETWEEN DATE '1995-01-01' - INTERVAL 365 DAYS AND DATE '1995-01-01' GROUP BY facility)
    SELECT s_suppkey::VARCHAR AS facility, s_name AS name, coalesce(n, 0) AS violations FROM supplier LEFT JOIN n ON facility = s_suppkey"""
)
def facility_violations(spark, d):
    """Facilities and violations as landed JSON, counted over a year."""
    f = F.struct(text_of("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("34.1").alias("latitude"), F.lit("-84.2").alias("longitude"))
    places = reference.facilities(table(spark, d, "supplier").select(F.to_json(F.struct(F.array(f).alias("facilities"))).alias("payload")))
    v = F.struct(text_of("l_suppkey").alias("facility_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("rule"))
    found = reference.violations(table(spark, d, "lineitem").select(F.to_json(F.struct(F.array(v).alias("violations"))).alias("payload"))).where("rule = 'R'")
    return reference.with_violations(places, found, "1995-01-01").select("facility", "name", "violations")


# Streams


@query(f"WITH {OBS} SELECT source, count(*) AS n FROM (SELECT DISTINCT source, metric, source_entity_id, timestamp FROM obs) GROUP BY source")
def stream_ingest(spark, d):
    """The event table as a stream through insert-or-ignore, twice: the second pass adds nothing."""
    import uuid

    from ..streaming import ingest

    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = observations(spark, d)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{base}/landed")
    parsed = lambda found: found.select(F.from_json("value", rows.schema).alias("o")).select("o.*")
    for turn in ("first", "second"):
        ingest.ingest(spark.readStream.text(f"{base}/landed"), lambda found: parsed(found).drop("id"), f"{base}/table", f"{base}/{turn}", ["value"]).awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


#: Detections of a landed file, about; a feed's payload is read whole, so that more detections land in more files, not in longer ones.
LANDED = 5_000


@query("SELECT dataset, count(*) AS n, round(sum(v) + 1e-9, 4) + 0.0::DOUBLE AS total FROM (SELECT 'nasa_firms' AS dataset, value AS v FROM events UNION ALL SELECT 'nasa_firms', 66 FROM events) GROUP BY dataset")
def schedule_once(spark, d):
    """A landed source through the scheduler, with every batch in the run log and pushed once."""
    import uuid

    from ..streaming import ingest

    base = f"{shared_dir(spark).rstrip('/')}/schedule-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    line = F.concat_ws(",", F.format_string("%.5f", F.lit(30) + F.col("event_id") * 0.00001), F.lit("-84.2"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "Hmm"), F.lit("nominal"), text_of("value"))
    files = max(16, -(-e.count() // LANDED))
    texts = e.groupBy(F.pmod(F.xxhash64("event_id"), F.lit(files)).alias("deal")).agg(F.concat(F.lit("latitude,longitude,acq_date,acq_time,confidence,frp\n"), F.array_join(F.collect_list(line), "\n")).alias("value"))
    texts.select("value").write.option("maxRecordsPerFile", 1).text(f"{base}/landed/nasa_firms")
    push = lambda found, n: ingest.push(found.withColumn("key_of", F.concat_ws("|", *S.KEY)), f"{base}/events", n, "key_of")
    for stream in ingest.schedule(spark, f"{base}/landed", f"{base}/table", f"{base}/state", ["nasa_firms"], once=True, after=push, log=f"{base}/runs").values():
        stream.awaitTermination()
    pushed = spark.read.json(f"{base}/events").select(F.from_json("event", "source string, value double").alias("e")).select("e.*")
    return rounded(pushed.groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


@query("SELECT source_dataset, count(*) AS n, count(brightness) AS n_brightness, count(bright_ti4) AS n_bright_ti4 FROM (SELECT 'MODIS' AS source_dataset, '300' AS brightness, NULL AS bright_ti4 FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'VIIRS', NULL, '310' FROM events WHERE event_id % 2 = 1) GROUP BY source_dataset")
def fires_union(spark, d):
    """Two datasets of files whose columns differ, as one."""
    import uuid

    base = f"{shared_dir(spark).rstrip('/')}/fires-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    for name, odd, column, heat in (("MODIS", 0, "brightness", "300"), ("VIIRS", 1, "bright_ti4", "310")):
        e.where(F.col("event_id") % 2 == odd).select(F.lit("34.1").alias("latitude"), F.lit(heat).alias(column)).write.csv(f"{base}/{name}", header=True)
    found = feeds.read_fires(spark, {name: f"{base}/{name}" for name in ("MODIS", "VIIRS")})
    return found.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.count("brightness").alias("n_brightness"), F.count("bright_ti4").alias("n_bright_ti4"))


@query(f"{Z.replace('PARTITION BY metric', 'PARTITION BY source, source_entity_id, metric, unit')} SELECT source, source_entity_id, metric, timestamp, value, n_before, round(mean_before + 1e-9, 4) + 0.0::DOUBLE AS mean_before, round(z + 1e-9, 4) + 0.0::DOUBLE AS z, coalesce(abs(z) > 3, false) AS flagged FROM z")
def stream_zscore(spark, d):
    """The event table as a stream through the stateful detector."""
    import uuid

    from ..streaming import stateful

    base = f"{shared_dir(spark).rstrip('/')}/stateful-{uuid.uuid4().hex}"
    rows = observations(spark, d).select(*S.KEY, "unit", "value")
    rows.write.parquet(f"{base}/landed")
    found = stateful.rolling_zscore(spark.readStream.schema(rows.schema).parquet(f"{base}/landed"))
    found.writeStream.format("parquet").option("path", f"{base}/found").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = rounded(spark.read.parquet(f"{base}/found"), "mean_before", "z").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return out.select("source", "source_entity_id", "metric", "timestamp", "value", "n_before", "mean_before", "z", "flagged")
