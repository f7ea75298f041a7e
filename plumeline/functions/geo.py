"""Distances, boxes and directions as Column expressions.

Three predicates bound an area, and are not the same: `in_square` (111.0 km to a degree on both axes), `Box` (111.32 km, narrowed by the
latitude) and `within_radius` (great circle).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM, SQUARE_DEGREE_KM, MILES = 6371.0, 111.32, 111.0, 0.621371
WINDS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


@dataclass(frozen=True)
class Box:
    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float

    @classmethod
    def around(cls, lat: float, lon: float, radius_km: float) -> Box:
        up, right = radius_km / DEGREE_KM, radius_km / (DEGREE_KM * max(math.cos(math.radians(lat)), 0.01))
        return cls(lat - up, lat + up, lon - right, lon + right)

    def holds(self, lat: Column, lon: Column) -> Column:
        return lat.between(self.min_lat, self.max_lat) & lon.between(self.min_lon, self.max_lon)

    @property
    def text(self) -> str:
        """West, south, east, north."""
        return ",".join(f"{x:.4f}" for x in (self.min_lon, self.min_lat, self.max_lon, self.max_lat))


def box_text(lat: Column, lon: Column, radius_km: float) -> Column:
    """Box.text for each row's own centre."""
    up = F.lit(radius_km) / DEGREE_KM
    right = F.lit(radius_km) / (DEGREE_KM * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return F.format_string("%.4f,%.4f,%.4f,%.4f", lon - right, lat - up, lon + right, lat + up)


def offset(lat: Column, lon: Column, north_km: Column | float, east_km: Column | float) -> tuple[Column, Column]:
    return lat + F.lit(north_km) / DEGREE_KM, lon + F.lit(east_km) / (DEGREE_KM * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))


def in_square(lat: Column, lon: Column, centre_lat: float, centre_lon: float, radius_km: float) -> Column:
    d = radius_km / SQUARE_DEGREE_KM
    return lat.between(centre_lat - d, centre_lat + d) & lon.between(centre_lon - d, centre_lon + d)


def within_radius(lat: Column, lon: Column, centre_lat: float, centre_lon: float, radius_km: float) -> Column:
    """A box that holds the circle, at all latitudes and across 180 degrees, goes first: it reaches the scan, the distance does not. A missing coordinate is outside."""
    near = distance_km(F.lit(centre_lat), F.lit(centre_lon), lat, lon) <= radius_km
    up = math.degrees(radius_km / EARTH_KM) * 1.000001
    wide = math.sin(min(radius_km / EARTH_KM, math.pi / 2))
    around = math.cos(math.radians(centre_lat))
    near = lat.between(centre_lat - up, centre_lat + up) & near
    if wide < around and up < 90:
        side = math.degrees(math.asin(wide / around)) * 1.000001
        west, east = centre_lon - side, centre_lon + side
        if west < -180:
            near = ((lon <= east) | (lon >= west + 360)) & near
        elif east > 180:
            near = ((lon >= west) | (lon <= east - 360)) & near
        else:
            near = lon.between(west, east) & near
    return F.coalesce(near, F.lit(False))


def _band_cells(band: Column, km: float | Column) -> Column:
    """Cells of a band of latitude, each wider than km reaches from the band or a neighbour; 1 where meridians meet."""
    degree = km / SQUARE_DEGREE_KM
    far = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(degree), F.lit(90.0))
    reach = F.sin(F.lit(km / EARTH_KM / 2)) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9))
    return F.when(reach >= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(360 / (F.degrees(2 * F.asin(F.least(reach, F.lit(1.0)))) * 1.001)))).cast("long")


def _cell(band: Column, lon: Column, km: float | Column, step: int) -> Column:
    n = _band_cells(band, km)
    return F.struct(band.alias("y"), F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n) + step, n).alias("x"))


def cell(lat: Column, lon: Column, km: float | Column) -> Column:
    """The cell (y, x) of a place: two places within km are in one cell or in neighbours, at all latitudes and across 180 degrees."""
    return _cell(F.floor(lat / (km / SQUARE_DEGREE_KM)), lon, km, 0)


def cells_around(lat: Column, lon: Column, km: float | Column) -> Column:
    """The cells, each once, in which all places within km of this one lie."""
    band = F.floor(lat / (km / SQUARE_DEGREE_KM))
    return F.array_distinct(F.array(*[_cell(band + up, lon, km, step) for up in (-1, 0, 1) for step in (-1, 0, 1)]))


def bands_touched(lat: Column, km: Column, width: float) -> Column:
    """The bands `y` of cells of this width (no less than km) in which places within km of this one lie."""
    degree, up = width / SQUARE_DEGREE_KM, F.degrees(km / EARTH_KM) * 1.000001 + 1e-9
    return F.sequence(F.floor((lat - up) / degree), F.floor((lat + up) / degree))


def cells_touched(lat: Column, lon: Column, km: Column, width: float, band: Column) -> Column:
    """The cells `x` of such a band in which places within km of this one lie, less or more whole turns of `cells_of`: each once."""
    n = _band_cells(band, width)
    up = F.degrees(km / EARTH_KM) * 1.000001 + 1e-9
    wide = F.sin(F.least(km / EARTH_KM, F.lit(math.pi / 2))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    side = F.when((F.abs(lat) + up >= 90) | (wide >= 1), 360.0).otherwise(F.degrees(F.asin(F.least(wide, F.lit(1.0)))) * 1.000001 + 1e-9)
    west, east = (F.floor((F.pmod(lon + 180, F.lit(360.0)) + s) / 360 * n) for s in (-side, side))
    all_around = east - west >= n
    return F.sequence(F.when(all_around, F.lit(0).cast("long")).otherwise(west), F.when(all_around, n - 1).otherwise(east))


def cells_of(x: Column, band: Column, width: float) -> Column:
    return F.pmod(x, _band_cells(band, width))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, from the first point to the second."""
    east = F.radians(lon2 - lon1)
    y = F.sin(east) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(east)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def wind(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WINDS)), (F.floor((degrees + 22.5) / 45) % 8 + 1).cast("int"))


def whole_miles(km: Column | float) -> Column:
    return (F.lit(km) * MILES).cast("int")


def query_points(lat: float, lon: float, radius_km: float) -> list[tuple[str, float, float]]:
    """Centre and four points at 25 km or the radius, whichever is less: name, km north, km east."""
    d = min(25.0, radius_km)
    return [("center", 0.0, 0.0), ("north", d, 0.0), ("east", 0.0, d), ("south", -d, 0.0), ("west", 0.0, -d)]
