"""Cubes and GRIB fields as files: pushdown, what is read, commits, and the formats octet by octet."""

import datetime as dt
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from phaseline.sources import cube, grib, netcdf, store

UTC = dt.timezone.utc


def _nc(times=1000, lats=40, lons=30, record=False):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(times, lats, lons)).astype("f4")
    x[0, 0, 0] = np.nan
    stored = np.where(np.isnan(x), np.float32(netcdf.FILL["f4"]), x)
    axes = {"time": np.arange(times) * 6.0, "lat": np.linspace(60, 10, lats), "lon": np.linspace(100, 150, lons)}
    own = {"time": {"units": "hours since 1990-01-01 00:00:00"}, "lat": {}, "lon": {}}
    variables = {n: ((n,), a, own[n]) for n, a in axes.items()} | {v: (("time", "lat", "lon"), stored if v == "tp" else stored * 2, {"_FillValue": np.float32(netcdf.FILL["f4"])}) for v in ("tp", "other")}
    return netcdf.encoded({"time": times, "lat": lats, "lon": lons}, variables, {"Conventions": "CF-1.8"}), axes, x


def test_a_box_reads_its_slices_only(spark, tmp_path, monkeypatch):
    """Times, latitudes and variables that are not asked for are not read."""
    data, axes, x = _nc()
    (tmp_path / "c.nc").write_bytes(data)
    opened = []
    plain = store.Ranges

    class Counted(plain):
        def __init__(self, uri):
            super().__init__(uri)
            opened.append(self)

    monkeypatch.setattr(store, "Ranges", Counted)
    reader = cube.PushedCubeReader(StructType.fromDDL("ts timestamp, lat double, lon double, tp double"), {"path": str(tmp_path / "c.nc"), "splitBytes": str(len(data) // 3)})
    start = dt.datetime(1990, 2, 1, tzinfo=UTC)
    filters = [GreaterThanOrEqual(("ts",), start), LessThan(("ts",), start + dt.timedelta(days=2)), GreaterThanOrEqual(("lat",), 55.0), EqualTo(("lon",), axes["lon"][3]), In(("lat",), (axes["lat"][1], axes["lat"][2]))]
    assert list(reader.pushFilters(filters)) == filters
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    at = 31 * 4
    want = {(start + dt.timedelta(hours=6 * k), axes["lat"][i], axes["lon"][3]): float(x[at + k, i, 3]) for k in range(9) for i in (1, 2)}
    assert {(r["ts"], r["lat"], r["lon"]): r["tp"] for r in rows} == want  # the ninth time is Spark's to drop
    assert 3 <= len(opened) <= 4 and sum(f.taken for f in opened) < len(data) / 20


def test_shares_of_a_file_make_it_whole(spark, tmp_path):
    data, axes, x = _nc(101, 4, 3)
    (tmp_path / "a.nc").write_bytes(data)
    np.savez_compressed(tmp_path / "b.npz", time=np.arange(101) * 21600.0, lat=axes["lat"], lon=axes["lon"], tp=x, other=x)
    for name in ("a.nc", "b.npz"):
        for split in ("500", "100000000"):
            got = cube.read(spark, [str(tmp_path / name)], ["tp"], splitBytes=split).collect()
            assert len(got) == x.size and sum(r.tp is None for r in got) == 1
            assert abs(sum(r.tp or 0 for r in got) - float(np.nansum(x, dtype=float))) < 1e-3
    both = cube.read(spark, [str(tmp_path / n) for n in ("a.nc", "b.npz")], ["tp", "other"]).where("lat > 50 and ts < timestamp'1990-01-02'")
    assert both.count() == 4 * 3 + 101 * 3


def test_classic_files_octet_by_octet():
    """A CDF-1 file with two record variables, one of them packed, as the format's description lays it out."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    attribute = lambda n, v: text(n) + struct.pack(">ii", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)
    dims = struct.pack(">ii", 10, 2) + text("time") + struct.pack(">i", 0) + text("lat") + struct.pack(">i", 3)
    packed = struct.pack(">ii", 12, 3) + text("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + text("add_offset") + struct.pack(">iid", 6, 1, 10.0) + text("_FillValue") + struct.pack(">iih", 3, 1, -1) + b"\0\0"
    unit = struct.pack(">ii", 12, 1) + attribute("units", "days since 2000-01-01")

    def head(a, b):
        one = text("time") + struct.pack(">ii", 1, 0) + unit + struct.pack(">iii", 6, 8, a)
        two = text("v") + struct.pack(">iii", 2, 0, 1) + packed + struct.pack(">iii", 3, 8, b)
        return b"CDF\x01" + struct.pack(">i", 2) + dims + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2) + one + two

    n = len(head(0, 0))
    records = b"".join(struct.pack(">d", t) + struct.pack(">3h", *v) + b"\0\0" for t, v in ((0.0, (1, 2, -1)), (1.5, (4, 5, 6))))
    data = head(n, n + 8) + records
    c = netcdf.Classic(lambda start, length: data[start : start + length])
    assert c.variables["v"]["shape"] == (2, 3) and c.stride == 16
    assert c.times().tolist() == [946684800.0, 946684800.0 + 1.5 * 86400]
    assert np.array_equal(c.values("v"), [[10.5, 11.0, np.nan], [12.0, 12.5, 13.0]], equal_nan=True)
    assert c.values("v", 1, 2, 1, 2).tolist() == [[12.5]] and c.values("v", 0, 2, 0, 1).tolist() == [[10.5], [12.0]]
    with pytest.raises(ValueError, match="HDF5"):
        netcdf.Classic(lambda start, length: b"\x89HDF\r\n\x1a\n"[start : start + length])


def _rows(spark, extra=()):
    base = [(dt.datetime(2000, 1, 1 + i % 20), 10 + (i // 20 % 5) * 0.25, 100 + (i // 100) * 0.25, float(i) if i % 7 else None, i % 2) for i in range(600)]
    return base, spark.createDataFrame([*base, *extra], "ts timestamp, lat double, lon double, v double, ar int").repartition(5)


@pytest.mark.parametrize("level", [0, 4])
def test_cube_round_trip(spark, tmp_path, level):
    base, df = _rows(spark)
    path = f"{tmp_path}/c"
    meta = {"": {"title": "t"}, "v": {"units": "mm", "valid_max": 3.5}, "lat": {"long_name": "breadth"}}
    cube.write(df, path, ["v", "ar"], meta, level, hours=24 * 7, degrees=0.5)
    back = cube.read(spark, [path], ["ar", "v"])
    assert sorted(map(repr, ((r.ts, r.lat, r.lon, r.v, int(r.ar)) for r in back.where("ar is not null").collect()))) == sorted(map(repr, base))
    got = cube.attributes(path)
    assert got[""] == {"Conventions": "CF-1.8", "title": "t"} and got["v"]["units"] == "mm" and got["v"]["valid_max"] == 3.5
    assert got["lat"]["long_name"] == "breadth" and got["time"]["units"].startswith("seconds since 1970")
    index = store.indexed(path)
    assert index.num_rows == 4 * 3 * 3 and all(os.path.getsize(f"{path}/{f}") == n for f, n in zip(index["file"].to_pylist(), index["bytes"].to_pylist()))
    cube.write(df.where("ar = 1"), path, ["v", "ar"], mode="overwrite", hours=24 * 7, degrees=0.5)
    assert cube.read(spark, [path], ["ar"]).where("ar is not null").count() == 300
    assert len(os.listdir(path)) == 2  # the older index and files are gone
    cube.write(df.where("ar = 0"), path, ["v", "ar"], hours=24 * 7, degrees=0.5)
    assert cube.read(spark, [path], ["ar"]).where("ar is not null").count() == 600
    one = cube.read(spark, [path], ["v"]).where("lat = 10.25 and lon >= 101 and ts = timestamp'2000-01-03'")
    assert one.count() == sum(r[0] == dt.datetime(2000, 1, 3) and r[1] == 10.25 and r[2] >= 101 for r in base) == 2


def test_folder_chunks_are_chosen_by_the_index(spark, tmp_path):
    _, df = _rows(spark)
    cube.write(df, f"{tmp_path}/c", ["v"], hours=24 * 7, degrees=0.5)
    reader = cube.PushedCubeReader(StructType.fromDDL("ts timestamp, lat double, lon double, v double"), {"path": f"{tmp_path}/c"})
    assert len(reader.partitions()) == 36
    reader.pushFilters([LessThanOrEqual(("lat",), 10.25), EqualTo(("lon",), 100.5)])
    assert len(reader.partitions()) == 4


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_a_failed_write_leaves_no_file(spark, tmp_path, mode):
    """A point with two rows fails its task after others have written; nothing of the job is left, what was there stays."""
    base, df = _rows(spark)
    path = f"{tmp_path}/c"
    cube.write(df, path, ["v"], hours=24 * 7, degrees=0.5)
    before = {(d, tuple(sorted(f))) for d, _, f in os.walk(path)}
    _, twice = _rows(spark, extra=[(dt.datetime(2000, 1, 20), 11.0, 101.25, 1.0, 1)])
    with pytest.raises(Exception, match="several rows"):
        cube.write(twice, path, ["v"], hours=24 * 7, degrees=0.5, mode=mode)
    assert {(d, tuple(sorted(f))) for d, _, f in os.walk(path)} == before
    _, nowhere = _rows(spark, extra=[(None, 11.0, 101.25, 1.0, 1)])
    with pytest.raises(Exception, match="needs ts, lat and lon"):
        cube.write(nowhere, path, ["v"], mode=mode)
    assert {(d, tuple(sorted(f))) for d, _, f in os.walk(path)} == before


def test_files_of_lost_attempts_are_taken_away(tmp_path):
    w = grib.GribWriter({"path": str(tmp_path / "g")}, False)
    w.files = lambda _: iter([(b"abc", {"messages": 1})])
    lost, kept = w.write([]), w.write([])
    w.commit([kept, None])
    assert store.indexed(str(tmp_path / "g"))["file"].to_pylist() == [kept.entries[0]["file"]]
    assert not os.path.exists(tmp_path / "g" / lost.entries[0]["file"])
    w.abort([])
    assert os.listdir(tmp_path / "g")[0].startswith("index-")


def test_empty_cube_and_fields(spark, tmp_path):
    _, df = _rows(spark)
    cube.write(df.limit(0), f"{tmp_path}/c", ["v"])
    os.makedirs(f"{tmp_path}/none")
    assert cube.read(spark, [f"{tmp_path}/none"], ["v"]).count() == 0 and grib.read(spark, [f"{tmp_path}/none"]).count() == 0
    assert grib.headers(spark, [f"{tmp_path}/none"]).count() == 0


def test_grib_fields_round_trip(spark, tmp_path):
    """Written fields come back, with masked points, negative and constant values; every split finds each message once."""
    rows = [(dt.datetime(1999 + i // 12, 1 + i % 12, 3, 6), 20 - j / 4, 100 + k / 4, 228 if i % 2 else 167, 1, i, None if (i + j + k) % 5 == 0 else float((i - 6) * j * k if i % 3 else 7)) for i in range(14) for j in range(4) for k in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp, lat double, lon double, param int, level_type int, level int, value double").repartition(3)
    path = f"{tmp_path}/g"
    grib.write(df, path)
    want = sorted(map(repr, rows))
    shape = lambda d: sorted(repr((r.ts, r.lat, r.lon, r.param, r.level_type, r.level, r.value)) for r in d.collect())
    for split in (64, 777, 1 << 20):
        assert shape(grib.read(spark, [path], splitBytes=str(split))) == want
        index = grib.headers(spark, [path], split)
        assert index.count() == 14 and shape(grib.points(index)) == want
    some = grib.read(spark, [path]).where("param = 228 and ts > timestamp'2000-01-01' and level in (13, 5)")
    assert some.count() == 20 and {r.level for r in some.collect()} == {13}
    tenths = df.withColumn("value", F.col("value") / 10 + 0.1)
    grib.write(tenths, f"{tmp_path}/t", decimal=1)
    assert sorted(round(r.value, 6) for r in grib.read(spark, [f"{tmp_path}/t"]).where("value is not null").collect()) == sorted(round(r[-1] / 10 + 0.1, 6) for r in rows if r[-1] is not None)


def test_passed_over_messages_are_not_read(tmp_path):
    at = np.arange(2500)
    lats, lons = 10 + at // 50 / 4, 100 + at % 50 / 4
    data = b"".join(grib.encode(86400.0 * i, 228 if i % 10 else 167, 1, 0, lats, lons, np.arange(2500) % 97 + i) for i in range(200))
    (tmp_path / "x.grib").write_bytes(data)
    read = store.Ranges(str(tmp_path / "x.grib"))
    found = list(grib.messages_in(read, 0, read.size, lambda m: m.param == 167))
    assert len(found) == 20 and read.taken < len(data) / 50 + (1 << 17)
    assert grib.decode(read(found[3].at, found[3].size), found[3])[2].tolist()[:3] == [55.0, 56.0, 57.0]  # north first: the last row of the input
