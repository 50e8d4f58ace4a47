"""Readers, writers and the cube source."""

import numpy as np

from phaseline.sources import files
from phaseline.sources.cube import CubeSource


def test_cube_source(spark, tmp_path):
    ar = np.arange(24, dtype=float).reshape(6, 2, 2)
    ar[0, 0, 0] = np.nan
    np.savez(tmp_path / "c.npz", time=np.arange(6) * 21600.0, lat=np.array([10.0, 10.25]), lon=np.array([100.0, 100.25]), ar=ar)
    spark.dataSource.register(CubeSource)
    df = spark.read.format("cube").option("path", str(tmp_path / "c.npz")).option("variables", "ar").option("times", "4").load()
    rows = df.collect()
    assert len(rows) == 24 and sum(r.ar is None for r in rows) == 1
    assert {r.ar for r in rows if r.lat == 10.25 and r.lon == 100.0} == set(ar[:, 1, 0])


def test_dates(spark):
    d = spark.createDataFrame([("1999-02-03",), ("02/03/1999",), ("19990203",), ("no date",), ("1999-13-40",)], "t string")
    assert [str(r[0]) for r in d.select(files.any_date(d.t)).collect()] == ["1999-02-03"] * 3 + ["None"] * 2


def test_panel_attributes_and_pruning(spark, tmp_path):
    d = spark.range(10).selectExpr("id cell_id", "id * 2 v", "1990 + id % 3 year")
    files.write_panel(d, f"{tmp_path}/p", ["year"], {"v": {"units": "mm"}})
    back = files.read_panel(spark, f"{tmp_path}/p")
    assert back.schema["v"].metadata == {"units": "mm"}
    assert "PartitionFilters: [isnotnull(year" in back.where("year = 1991")._jdf.queryExecution().executedPlan().toString()


def test_report_and_cached_stage(spark, tmp_path):
    names = files.write_report({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path))
    assert names == ["a", "b"] and spark.read.option("header", True).csv(f"{tmp_path}/a").count() == 3
    calls = []
    make = lambda: calls.append(1) or spark.range(4)
    assert files.cached_stage(spark, f"{tmp_path}/s", make).count() == 4 and files.cached_stage(spark, f"{tmp_path}/s", make).count() == 4
    assert len(calls) == 1


def test_cube_reads_only_its_times(spark, tmp_path, monkeypatch):
    """A chunk holds its own rows, of stored and of compressed archives."""
    from phaseline.sources import cube

    x = np.arange(5000 * 6, dtype=np.float32).reshape(5000, 2, 3)
    for save in (np.savez, np.savez_compressed):
        save(tmp_path / "c.npz", time=np.arange(5000.0), lat=np.arange(2.0), lon=np.arange(3.0), ar=x)
        monkeypatch.setattr(np, "load", None)
        time, _, _, get = cube._open(str(tmp_path / "c.npz"))
        assert len(time) == 5000 and (get("ar", 4990, 5000) == x[4990:]).all() and (get("ar", 7, 9) == x[7:9]).all()
        monkeypatch.undo()


def test_rain_is_seasonal(spark):
    from pyspark.sql import functions as F

    from phaseline.sources import synthetic

    r = synthetic.seasonal_rain(spark, 30, peaks=())
    assert r.count() == 30 * 365 and sorted(r.collect()) == sorted(synthetic.seasonal_rain(spark, 30, peaks=()).repartition(3).collect())
    by = {x.s: x for x in r.withColumn("s", (F.abs(F.col("day") - 200) < 30).cast("int")).groupBy("s").agg(F.avg((F.col("precip") > 0).cast("int")).alias("wet"), F.avg(F.when(F.col("precip") > 0, F.col("precip"))).alias("mean")).collect()}
    assert 0.7 < by[1].wet < 0.85 and 0.4 < by[0].wet < 0.6 and 36 < by[1]["mean"] < 48 and by[0]["mean"] < 25
    d = synthetic.exposure_design(spark, 20_000)
    m = {x.r: x for x in d.withColumn("r", (F.col("month").between(6, 8) & (F.col("grid") > 7)).cast("int")).groupBy("r").agg(F.avg("ar").alias("ar"), F.avg("ep").alias("ep")).collect()}
    assert abs(m[1].ar - 0.66) < 0.04 and m[0].ar < 0.3 and m[1].ep > 2 * m[0].ep


def test_samples_have_their_size(spark):
    import hashlib

    from phaseline.operators import panel

    d = spark.range(5003)
    order = sorted(range(5003), key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
    assert sorted(r.id for r in panel.row_sample(d, "id").collect()) == sorted(order[:500])
    assert sorted(r.id for r in panel.row_sample(d, "id", most=37).collect()) == sorted(order[:37])
    assert panel.row_sample(d, "id", per=1).count() == 5003 and panel.row_sample(d.limit(0), "id").count() == 0


def grib_message(values, bits, hour, param=228, known=None, span=(0, 1, 0)):
    """An edition 1 message of a 2-D field on a grid of a quarter degree from 20 N 100 E, written octet by octet."""
    rows, columns = values.shape
    flat = values.reshape(-1) if known is None else values.reshape(-1)[known.reshape(-1)]
    number = lambda v, n: int(v).to_bytes(n, "big")
    signed = lambda v, n: number(abs(v) + (1 << (8 * n - 1) if v < 0 else 0), n)
    p1, unit, kind = span
    pds = number(28, 3) + bytes([128, 98, 1, 255, 0x80 | (0x40 if known is not None else 0), param, 1, 0, 0, 99, 12, 31, hour, 0, unit, p1, 0, kind, 0, 0, 0, 20, 0]) + signed(1, 2)
    gds = number(32, 3) + bytes([0, 255, 0]) + number(columns, 2) + number(rows, 2) + signed(20000, 3) + signed(100000, 3) + b"\x80"
    gds += signed(20000 - 250 * (rows - 1), 3) + signed(100000 + 250 * (columns - 1), 3) + number(250, 2) * 2 + b"\0" * 5
    bms = b""
    if known is not None:
        mask = np.packbits(known.reshape(-1)).tobytes()
        bms = number(6 + len(mask), 3) + bytes([8 * len(mask) - known.size]) + b"\0\0" + mask
    # reference -4.0 in base 16 is 0xC1400000; binary scale -1, decimal scale 1: value = (-4 + steps / 2) / 10
    body = "".join(format(round((v * 10 + 4) * 2), f"0{bits}b") for v in flat)
    body += "0" * (-len(body) % 16)
    packed = bytes(int(body[i : i + 8], 2) for i in range(0, len(body), 8))
    bds = number(11 + len(packed), 3) + b"\0" + signed(-1, 2) + b"\xc1\x40\0\0" + bytes([bits]) + packed
    rest = pds + gds + bms + bds + b"7777"
    return b"GRIB" + number(8 + len(rest), 3) + b"\x01" + rest


def test_grib_source(spark, tmp_path):
    """Fields of several widths, a mask, another parameter, padding between messages and steps ahead come back."""
    from phaseline.sources.grib import GribSource

    field = np.arange(6).reshape(2, 3) / 20 - 0.4
    known = np.array([[1, 0, 1], [1, 1, 0]], bool)
    made = [grib_message(field, 16, 0), grib_message(field + 1, 11, 6), b"\0" * 70_001, grib_message(field, 8, 6, param=167), grib_message(field + 2, 13, 12, known=known, span=(6, 1, 0))]
    (tmp_path / "g.grib").write_bytes(b"".join(made))
    spark.dataSource.register(GribSource)
    read = lambda **o: spark.read.format("grib").option("path", str(tmp_path / "g.grib")).options(messages="1", **o).load()
    assert read().count() == 24 and read(param="999").count() == 0
    rows = read(param="228", level_type="1").selectExpr("unix_timestamp(ts) AS t", "lat", "lon", "value").collect()
    base = 946598400  # 1999-12-31
    want = {}
    for hour, add, mask in ((0, 0, None), (6, 1, None), (18, 2, known)):
        for i in range(2):
            for j in range(3):
                want[base + 3600 * hour, 20 - i / 4, 100 + j / 4] = None if mask is not None and not mask[i, j] else round(field[i, j] + add, 9)
    assert {(r.t, r.lat, r.lon): None if r.value is None else round(r.value, 9) for r in rows} == want and len(rows) == 18


def test_grib_refuses_what_it_does_not_read(tmp_path):
    import pytest

    from phaseline.sources import grib

    raw = bytearray(grib_message(np.zeros((2, 2)), 8, 0))
    raw[7] = 2
    (tmp_path / "two.grib").write_bytes(bytes(raw))
    with pytest.raises(ValueError, match="edition 2"):
        list(grib.messages(str(tmp_path / "two.grib")))
    raw = bytearray(grib_message(np.zeros((2, 2)), 8, 0))
    (tmp_path / "one.grib").write_bytes(bytes(raw))
    (m,) = grib.messages(str(tmp_path / "one.grib"))
    raw[8 + 28 + 5] = 50
    with pytest.raises(ValueError, match="grid 50"):
        grib.decode(bytes(raw), m)
