"""Files of the classic layout, written here byte by byte, as pixels and cells."""

import struct

import numpy as np
import pytest

from plumeline.functions.geo import Box
from plumeline.sources import netcdf, planned

CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


def pad(raw):
    return raw + b"\0" * (-len(raw) % 4)


def named(name):
    return struct.pack(">i", len(name)) + pad(name.encode())


def attributes(given):
    out = struct.pack(">ii", 12 if given else 0, len(given))
    for name, value in given.items():
        raw, code = (value.encode(), 2) if isinstance(value, str) else (np.asarray(value).astype(np.asarray(value).dtype.newbyteorder(">")).tobytes(), CODES[np.asarray(value).dtype.str[1:]])
        out += named(name) + struct.pack(">ii", code, len(value) if isinstance(value, str) else np.asarray(value).size) + pad(raw)
    return out


def written(dims, variables, version=1):
    """dims: name to size (0: records); variables: name to (dims, array, attributes)."""
    names = list(dims)
    records = max([len(a) for d, a, _ in variables.values() if d and dims[d[0]] == 0], default=0)
    size = lambda d, a: len(pad(np.asarray(a[0] if d and dims[d[0]] == 0 else a).tobytes()))
    begins = dict.fromkeys(variables, 0)
    for _ in range(2):
        head = b"CDF" + bytes([version]) + struct.pack(">i", records) + struct.pack(">ii", 10, len(dims)) + b"".join(named(n) + struct.pack(">i", s) for n, s in dims.items()) + attributes({"title": "a test"})
        head += struct.pack(">ii", 11, len(variables))
        for name, (d, a, own) in variables.items():
            head += named(name) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", names.index(x)) for x in d) + attributes(own)
            head += struct.pack(">ii", CODES[a.dtype.str[1:]], size(d, a)) + struct.pack(">q" if version == 2 else ">i", begins[name])
        at = len(head)
        for record in (False, True):
            for name, (d, a, _) in variables.items():
                if bool(d and dims[d[0]] == 0) == record:
                    begins[name] = at
                    at += size(d, a)
    big = lambda a: np.asarray(a).astype(a.dtype.newbyteorder(">")).tobytes()
    body = b"".join(pad(big(a)) for d, a, _ in variables.values() if not (d and dims[d[0]] == 0))
    own = [(d, a) for d, a, _ in variables.values() if d and dims[d[0]] == 0]
    for i in range(records):
        body += b"".join(pad(big(a[i])) if len(own) > 1 else big(a[i]) for _, a in own)
    return head + body


LAT, LON = np.linspace(33.0, 35.0, 9).astype("f4"), np.linspace(-85.0, -83.0, 11).astype("f8")


def grid(version=1, record=True):
    rng = np.random.default_rng(3)
    packed = rng.integers(-100, 100, (2, 9, 11)).astype("i2")
    packed[0, 0, 0] = packed[1, 8, 10] = -999
    time = (["time"], np.array([0.0, 1.5]), {"units": "hours since 2025-11-18 06:00:00"})
    dims = {"time": 0 if record else 2, "latitude": 9, "longitude": 11}
    return packed, written(dims, {"latitude": (["latitude"], LAT, {}), "time": time, "longitude": (["longitude"], LON, {}), "no2_column": (["time", "latitude", "longitude"], packed, {"_FillValue": np.array([-999], "i2"), "scale_factor": np.array([0.25]), "add_offset": np.array([10.0]), "units": "mol/m2"})}, version)


@pytest.mark.parametrize("version,record", [(1, True), (2, True), (1, False), (2, False)])
def test_pixels(spark, tmp_path, monkeypatch, version, record):
    packed, content = grid(version, record)
    (tmp_path / "a.nc").write_bytes(content)
    want = {(str(t), float(LAT[i]), float(LON[j])): packed[k, i, j] * 0.25 + 10 for k, t in enumerate(("2025-11-18 06:00:00", "2025-11-18 07:30:00")) for i in range(9) for j in range(11) if packed[k, i, j] != -999}
    found = lambda **more: {(str(r.timestamp), r.lat, r.lon): r.no2_column for r in netcdf.read_pixels(spark, f"file://{tmp_path}", "no2_column", **more).collect()}
    assert found() == want and len(want) == 196
    monkeypatch.setattr(netcdf, "BLOCK", 25)
    blocks = list(netcdf.pixels_of(content, "no2_column", "latitude", "longitude", "time", None))
    assert sum(map(len, blocks)) == 196 and len(blocks) == 10
    box = Box(33.3, 34.1, -84.5, -83.5)
    assert found(box=box) == {k: v for k, v in want.items() if 33.3 <= k[1] <= 34.1 and -84.5 <= k[2] <= -83.5}
    assert found(box=Box(0, 1, 0, 1)) == {}


def test_cells_of_a_file(spark, tmp_path):
    packed, content = grid()
    (tmp_path / "a.nc").write_bytes(content)
    (tmp_path / "b.nc").write_bytes(content)
    pixels = netcdf.read_pixels(spark, f"file://{tmp_path}", "no2_column")
    sums = {}
    for k, hour in enumerate((6, 7)):
        for i in range(9):
            for j in range(11):
                if packed[k, i, j] != -999:
                    sums.setdefault((hour, int(np.floor(LAT[i] / 0.5)), int(np.floor(LON[j] / 0.5))), []).append(packed[k, i, j] * 0.25 + 10)
    found = {(r.timestamp.hour, *map(int, r.source_entity_id.split(":")[1:])): r.value for r in planned.satellite_cells(pixels, "no2_column", 0.5, "mol/m2").collect()}
    assert set(found) == set(sums) and all(found[k] == pytest.approx(np.mean(v)) for k, v in sums.items())


def test_one_record_variable_is_not_padded_and_grids_without_time(spark, tmp_path):
    flags = np.arange(6).reshape(2, 1, 3).astype("i1")
    (tmp_path / "a.nc").write_bytes(written({"t": 0, "lat": 1, "lon": 3}, {"lat": (["lat"], np.array([1.0]), {}), "lon": (["lon"], np.array([1.0, 2.0, 3.0]), {}), "flag": (["t", "lat", "lon"], flags, {})}))
    (tmp_path / "b.nc").write_bytes(written({"lat": 1, "lon": 2}, {"lat": (["lat"], np.array([5.0]), {}), "lon": (["lon"], np.array([1.0, 2.0]), {}), "flag": (["lat", "lon"], np.array([[np.nan, 7.0]], "f4"), {})}))
    found = netcdf.read_pixels(spark, f"file://{tmp_path}", "flag", "lat", "lon").collect()
    assert sorted((r.lat, r.lon, r.flag) for r in found) == [(1.0, 1.0, 0.0), (1.0, 1.0, 3.0), (1.0, 2.0, 1.0), (1.0, 2.0, 4.0), (1.0, 3.0, 2.0), (1.0, 3.0, 5.0), (5.0, 2.0, 7.0)]
    assert {r.timestamp for r in found} == {None}


@pytest.mark.parametrize("content,name", [(b"\x89HDF", "v"), (b"CDF\x05", "v"), (written({"lat": 1}, {"lat": (["lat"], np.array([1.0]), {})}), "v"), (grid()[1], "latitude")])
def test_other_files_fail(content, name):
    with pytest.raises(ValueError):
        list(netcdf.pixels_of(content, name, "latitude", "longitude", "time", None))
