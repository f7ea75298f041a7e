"""The observation model and its fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

OBSERVATION = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("lat", T.DoubleType(), False),
        T.StructField("lon", T.DoubleType(), False),
        T.StructField("metric", T.StringType(), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("unit", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_entity_id", T.StringType(), False),
        T.StructField("raw_json", T.StringType(), True),
    ]
)
#: Unique key of an observation; of rows that share it the first to arrive stays.
KEY = ("source", "metric", "source_entity_id", "timestamp")

#: Centre and radius of the area served.
TARGET_LAT, TARGET_LON, RADIUS_KM = 34.0515, -84.0713, 50.0

# Parameter and unit names of the public feeds, and the metric or unit that each stands for.
AIRNOW_METRICS = {"PM2.5": "pm25", "PM10": "pm10", "OZONE": "ozone", "O3": "ozone", "NO2": "no2", "SO2": "so2", "CO": "co"}
AIRNOW_UNITS = {"UG/M3": "ug/m3", "UG/M^3": "ug/m3", "PPM": "ppm", "PPB": "ppb"}
OPENAQ_METRICS = {"pm25": "pm25", "pm2.5": "pm25", "pm10": "pm10", "o3": "ozone", "ozone": "ozone", "no2": "no2", "so2": "so2", "co": "co", "bc": "bc"}
OPENAQ_UNITS = {"ug/m3": "ug/m3", "ug/m^3": "ug/m3", "ppm": "ppm", "ppb": "ppb"}
PURPLEAIR_FIELDS = {"pm2.5_atm": ("pm25", "ug/m3"), "pm10.0_atm": ("pm10", "ug/m3"), "humidity": ("humidity", "percent"), "temperature": ("temperature", "degF")}
OPENWEATHER_FIELDS = {
    "main.temp": ("temperature", "degC"),
    "main.humidity": ("humidity", "percent"),
    "main.pressure": ("pressure", "hPa"),
    "wind.speed": ("wind_speed", "m/s"),
    "wind.deg": ("wind_direction", "degree"),
    "clouds.all": ("cloud_cover", "percent"),
}
FIRE_CONFIDENCE = {"l": 33.0, "low": 33.0, "n": 66.0, "nominal": 66.0, "h": 100.0, "high": 100.0}
FIRE_METRICS = {"fire_radiative_power": "MW", "fire_confidence": "percent", "fire_brightness": "K"}
#: What the feeds are asked for: readings of at most this age, and detections of so many days.
PURPLEAIR_MAX_AGE_S, FIRE_DAYS = 7200, 1
COLLECT_MINUTES = {"epa_airnow": 60, "openaq": 60, "purpleair": 15, "openweather": 60, "nasa_firms": 180, "traffic": 15, "water_gauges": 15}
#: Hour of the day, in New York, of sources that are collected once a day.
COLLECT_DAILY = {"satellite": 6, "energy": 6}

# EPA breakpoints for 24-hour PM2.5 (ug/m3): lower and upper concentration, lower and upper index.
PM25_BREAKPOINTS = ((0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500))
#: Concentrations from which on a reading is severe by itself, by metric and unit.
HAZARDOUS = {("pm25", "ug/m3"): 225.5, ("pm10", "ug/m3"): 425.0}
#: Plausible values of a metric, by metric and unit.
BOUNDS = {
    ("pm25", "ug/m3"): (0.0, 1000.0),
    ("pm10", "ug/m3"): (0.0, 2000.0),
    **{(m, "ug/m3"): (0.0, 1000.0) for m in ("ozone", "no2", "so2")},
    **{(m, "ppm"): (0.0, 10.0) for m in ("ozone", "no2", "so2")},
    **{(m, "ppb"): (0.0, 10_000.0) for m in ("ozone", "no2", "so2")},
    ("co", "ppm"): (0.0, 500.0),
    ("bc", "ug/m3"): (0.0, 500.0),
    ("temperature", "degC"): (-90.0, 60.0),
    ("temperature", "degF"): (-130.0, 140.0),
    ("humidity", "percent"): (0.0, 100.0),
    ("cloud_cover", "percent"): (0.0, 100.0),
    ("pressure", "hPa"): (850.0, 1100.0),
    ("wind_speed", "m/s"): (0.0, 115.0),
    ("wind_direction", "degree"): (0.0, 360.0),
    ("precipitation", "mm/h"): (0.0, 500.0),
    ("fire_confidence", "percent"): (0.0, 100.0),
    ("fire_radiative_power", "MW"): (0.0, 50_000.0),
    ("fire_brightness", "K"): (200.0, 600.0),
    ("traffic_speed", "km/h"): (0.0, 300.0),
    ("traffic_congestion", "ratio"): (-1.0, 1.0),
    ("ph", "pH"): (0.0, 14.0),
}
