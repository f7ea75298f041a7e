"""Gridded files of the classic NetCDF layout (versions 1 and 2) as pixels, a file in a task, a block of pixels at a time.

A variable's last two dimensions are those of the coordinate variables; a dimension before them may be time. Packed values are unpacked by
scale_factor and add_offset; fill values, missing values and values that are not finite give no pixel. A file that has no such variable, or is of another
layout, fails the job. Files are read whole, so a file is as large as a binary column can be (2 GB).
"""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Box

#: Fixed values of the layout: tags of its lists, and its types' sizes.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
#: Pixels that are handed on at once.
BLOCK = 200_000
STEPS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


@dataclass
class Variable:
    dimensions: list[str]
    shape: tuple[int, ...]
    kind: str
    begin: int
    size: int
    record: bool
    attributes: dict = field(default_factory=dict)


class Header:
    """Names, sizes and places of what a file holds."""

    def __init__(self, content: bytes):
        self.content, self.at = content, 4
        if content[:3] != b"CDF" or content[3] not in (1, 2):
            raise ValueError("no file of the classic NetCDF layout")
        wide = content[3] == 2
        self.records = self.number()
        dims = self.entries(DIMENSIONS, lambda: (self.text(), self.number()))
        self.entries(ATTRIBUTES, self.attribute)

        def variable() -> tuple[str, Variable]:
            name, ids = self.text(), [self.number() for _ in range(self.number())]
            attributes = dict(self.entries(ATTRIBUTES, self.attribute))
            kind, size, begin = TYPES[self.number()], self.number(), self.number(wide)
            record = bool(ids) and dims[ids[0]][1] == 0
            shape = tuple(self.records if dims[i][1] == 0 else dims[i][1] for i in ids)
            return name, Variable([dims[i][0] for i in ids], shape, kind, begin, size, record, attributes)

        self.variables = dict(self.entries(VARIABLES, variable))
        own = [v for v in self.variables.values() if v.record]
        # Records of all such variables alternate; one alone is not padded.
        self.stride = sum(v.size for v in own) if len(own) > 1 else sum(int(np.prod(v.shape[1:])) * np.dtype(v.kind).itemsize for v in own)

    def number(self, wide: bool = False) -> int:
        value = struct.unpack_from(">q" if wide else ">i", self.content, self.at)[0]
        self.at += 8 if wide else 4
        return value

    def padded(self, n: int) -> bytes:
        out = self.content[self.at : self.at + n]
        self.at += n + -n % 4
        return out

    def text(self) -> str:
        return self.padded(self.number()).decode()

    def entries(self, tag: int, one) -> list:
        found, n = self.number(), self.number()
        if found not in (0, tag):
            raise ValueError("a damaged header")
        return [one() for _ in range(n)] if found else []

    def attribute(self) -> tuple[str, object]:
        name, kind = self.text(), TYPES[self.number()]
        n = self.number()
        raw = self.padded(n * np.dtype(kind).itemsize)
        return name, raw.decode(errors="replace") if kind == "S1" else np.frombuffer(raw, kind)

    def values(self, v: Variable, first: int | None = None, index: slice = slice(None)) -> np.ndarray:
        """Unpacked values, nan where there are none; of the first dimension only one place, and of the next one a range."""
        kind, whole = np.dtype(v.kind), v.shape[1:] if v.record else v.shape
        if v.record:
            raw = np.stack([np.frombuffer(self.content, kind, int(np.prod(whole)), v.begin + i * self.stride).reshape(whole) for i in (range(v.shape[0]) if first is None else [first])])
            raw = raw if first is None else raw[0]
        else:
            raw = np.frombuffer(self.content, kind, int(np.prod(whole)), v.begin).reshape(whole)
            raw = raw if first is None else raw[first]
        raw = raw[index]
        out = raw.astype(float)
        for name in ("_FillValue", "missing_value"):
            if name in v.attributes:
                out[raw == v.attributes[name][0]] = np.nan
        out[~np.isfinite(out)] = np.nan
        return out * float(np.ravel(v.attributes.get("scale_factor", 1.0))[0]) + float(np.ravel(v.attributes.get("add_offset", 0.0))[0])


def times(header: Header, name: str) -> list[dt.datetime]:
    """The times of a variable in units of "<seconds, minutes, hours or days> since <date and time>", which is UTC."""
    v = header.variables[name]
    found = re.match(r"\s*(second|minute|hour|day)s?\s+since\s+(\d{4}-\d{1,2}-\d{1,2})(?:[T ](\d{1,2}:\d{2}(?::\d{2})?))?", str(v.attributes.get("units", "")))
    if not found:
        raise ValueError(f"no units of time in {name}")
    day = dt.datetime(*map(int, found[2].split("-")), *map(int, (found[3] or "0:0").split(":")))
    return [day + dt.timedelta(seconds=float(x) * STEPS[found[1]]) for x in header.values(v)]


def pixels_of(content: bytes, variable: str, lat: str, lon: str, time: str, box: Box | None) -> Iterator[pd.DataFrame]:
    header = Header(content)
    if variable not in header.variables or not {lat, lon} <= set(header.variables):
        raise ValueError(f"a file without {variable}, {lat} or {lon}")
    v = header.variables[variable]
    y, x = header.values(header.variables[lat]), header.values(header.variables[lon])
    if v.shape[-2:] != (len(y), len(x)) or len(v.shape) > 3:
        raise ValueError(f"{variable} is not a grid of {lat} and {lon}")
    rows = np.flatnonzero((y >= box.min_lat) & (y <= box.max_lat)) if box else np.arange(len(y))
    columns = np.flatnonzero((x >= box.min_lon) & (x <= box.max_lon)) if box else np.arange(len(x))
    if not len(rows) or not len(columns):
        return
    known = times(header, time) if time in header.variables else [None]
    step = max(1, BLOCK // len(columns))
    for turn in range(v.shape[0] if len(v.shape) == 3 else 1):
        for begin in range(int(rows[0]), int(rows[-1]) + 1, step):
            part = rows[(rows >= begin) & (rows < begin + step)]
            if not len(part):
                continue
            block = header.values(v, turn if len(v.shape) == 3 else None, slice(begin, begin + step))[part - begin][:, columns]
            i, j = np.nonzero(~np.isnan(block))
            at = known[turn] if turn < len(known) else None
            yield pd.DataFrame({"timestamp": pd.Series([at] * len(i), dtype="datetime64[us]"), "lat": y[part[i]], "lon": x[columns[j]], "value": block[i, j]})


def read_pixels(spark: SparkSession, path: str, variable: str, lat: str = "latitude", lon: str = "longitude", time: str = "time", box: Box | None = None) -> DataFrame:
    """timestamp (null without a time), lat, lon and `variable` of all pixels of the files at `path`, or of those in the box."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield from pixels_of(bytes(content), variable, lat, lon, time, box)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "timestamp timestamp_ntz, lat double, lon double, value double").select(F.col("timestamp").cast("timestamp").alias("timestamp"), "lat", "lon", F.col("value").alias(variable))
