"""A Spark data source for GRIB edition 1: regular latitude-longitude grids, simple packing.

``read(spark, paths)``, or ``spark.read.format("grib").option("path", ...)``, gives a row a grid point:
(ts, lat, lon, param, level_type, level, value).  ``ts`` is the valid time, a
masked point is NULL.  The path names files, or folders that ``write`` made.

* The driver asks for files' sizes only.  A task takes a range of bytes, finds the first
  message that begins in it, and goes on from header to header; messages that the filters
  on param, level type, level and ts (pushed down), or the options ``param`` and
  ``level_type``, rule out are passed over by their 36 leading bytes.
* ``headers`` gives the index of all messages as a table, made the same way, and
  ``points`` decodes the messages of such a table, chosen by any DataFrame operation.
* ``write`` packs fields into messages, those of a task into one file, published together
  (``store.FolderWriter``).

Other editions, grids or packings raise an error that names what was met.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Fixed values of the format: seconds in a unit of the forecast's time.
UNIT_SECONDS = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200, 254: 1}
#: Fixed values of the format: time range codes, by which period ends the valid time.
AT_FIRST, AT_SECOND, AT_WIDE, AT_START = {0}, {2, 3, 4, 5}, {10}, {1}


class Message(NamedTuple):
    """Where a message stands, and its product section."""

    at: int
    size: int
    param: int
    level_type: int
    level: int
    ts: float
    sections: int
    decimal: int


@dataclass
class _Range(InputPartition):
    """The messages that begin in a range of bytes of a file."""

    path: str
    start: int
    stop: int


def _signed(raw: bytes) -> int:
    """A whole number whose highest bit is its sign."""
    top = 1 << (8 * len(raw) - 1)
    n = int.from_bytes(raw, "big")
    return -(n - top) if n & top else n


def _valid_time(pds: bytes) -> float:
    """Epoch seconds at which a product holds: its reference time and the period its time range names."""
    start = dt.datetime((pds[24] - 1) * 100 + pds[12], pds[13], pds[14], pds[15], pds[16], tzinfo=dt.timezone.utc)
    kind = pds[20]
    if kind in AT_FIRST:
        ahead = pds[18]
    elif kind in AT_SECOND:
        ahead = pds[19]
    elif kind in AT_WIDE:
        ahead = int.from_bytes(pds[18:20], "big")
    elif kind in AT_START:
        ahead = 0
    else:
        raise ValueError(f"GRIB time range {kind} is not read")
    if ahead and pds[17] not in UNIT_SECONDS:
        raise ValueError(f"GRIB time unit {pds[17]} is not read")
    return start.timestamp() + ahead * UNIT_SECONDS.get(pds[17], 0)


#: Bytes of a file whose headers one task reads, and bytes looked through at once for a message's start.
SPLIT, LOOK = 256 << 20, 1 << 16


def _begins(read: store.Ranges, at: int, stop: int) -> int | None:
    """Where the first message from ``at`` on begins, before ``stop``: a start whose length leads to an end mark."""
    while at < min(stop, read.size):
        data = read(at, min(LOOK + 8, read.size - at))
        found = data.find(b"GRIB")
        while found >= 0:
            head = data[found : found + 8]
            if len(head) == 8:
                size = int.from_bytes(head[4:7], "big")
                if head[7] != 1 or size & 0x800000 or (at + found + size <= read.size and size > 40 and read(at + found + size - 4, 4) == b"7777"):
                    return at + found if at + found < stop else None
            found = data.find(b"GRIB", found + 1)
        at += max(1, min(LOOK, len(data)))
    return None


def messages_in(read: store.Ranges, start: int, stop: int, wanted=lambda m: True) -> Iterator[Message]:
    """The messages that begin in a range of bytes, by their headers alone; what stands between messages is passed over."""
    at = _begins(read, start, stop)
    while at is not None and at < stop:
        head = read(at, 36)
        if head[:4] != b"GRIB":
            at = _begins(read, at, stop)
            continue
        if len(head) < 36 or head[7] != 1:
            raise ValueError(f"this is a message of GRIB edition {head[7] if len(head) > 7 else 'unknown'} at byte {at}; edition 1 is read")
        size, pds = int.from_bytes(head[4:7], "big"), head[8:]
        if size < 8 or size & 0x800000:
            raise ValueError(f"a GRIB message has a length of another form at byte {at}")
        m = Message(at, size, pds[8], pds[9], int.from_bytes(pds[10:12], "big"), _valid_time(pds), pds[7], _signed(pds[26:28]))
        if wanted(m):
            yield m
        at += size


def messages(path: str, param: int | None = None, level_type: int | None = None) -> Iterator[Message]:
    """The messages of one file."""
    read = store.Ranges(path)
    return messages_in(read, 0, read.size, lambda m: param in (None, m.param) and level_type in (None, m.level_type))


def _unpacked(data: bytes, bits: int, n: int):
    """``n`` whole numbers of ``bits`` bits each."""
    import numpy as np

    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(float)
    if bits == 24:
        high, middle, low = np.frombuffer(data, np.uint8, 3 * n).reshape(n, 3).astype(float).T
        return (high * 256 + middle) * 256 + low
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    out = np.zeros(n)
    for column in each.T:
        out = out * 2 + column
    return out


def decode(raw: bytes, m: Message):
    """(lats, lons, values) of one message, a number a grid point, NaN where masked."""
    import numpy as np

    if raw[-4:] != b"7777":
        raise ValueError(f"the GRIB message at byte {m.at} does not end as it should")
    if not m.sections & 0x80:
        raise ValueError("a GRIB message without its grid is not read")
    at = 8 + int.from_bytes(raw[8:11], "big")
    grid = raw[at : at + int.from_bytes(raw[at : at + 3], "big")]
    if grid[5] != 0:
        raise ValueError(f"GRIB grid {grid[5]} is not read")
    columns, rows = (int.from_bytes(grid[i : i + 2], "big") for i in (6, 8))
    if 0xFFFF in (columns, rows):
        raise ValueError("a reduced GRIB grid is not read")
    north, west, south, east = (_signed(grid[i : i + 3]) / 1000 for i in (10, 13, 17, 20))
    at, scan, points = at + len(grid), grid[27], columns * rows
    known = np.ones(points, bool)
    if m.sections & 0x40:
        length = int.from_bytes(raw[at : at + 3], "big")
        if raw[at + 4 : at + 6] != b"\0\0":
            raise ValueError("a GRIB message with a bitmap from elsewhere is not read")
        known = np.unpackbits(np.frombuffer(raw[at + 6 : at + length], np.uint8), count=points).astype(bool)
        at += length
    packed = raw[at : at + int.from_bytes(raw[at : at + 3], "big")]
    if packed[3] & 0xF0:
        raise ValueError(f"GRIB packing {packed[3] >> 4} is not read")
    # a base-16 float: sign, exponent from 64, 24 bits of fraction
    least = (-1 if packed[6] & 0x80 else 1) * int.from_bytes(packed[7:10], "big") / 2**24 * 16.0 ** ((packed[6] & 0x7F) - 64)
    n, bits = int(known.sum()), packed[10]
    steps = _unpacked(packed[11:], bits, n) if bits else np.zeros(n)
    values = np.full(points, np.nan)
    values[known] = (least + steps * 2.0 ** _signed(packed[4:6])) / 10.0**m.decimal
    if east < west and not scan & 0x80:
        east += 360
    lats, lons = np.linspace(north, south, rows), np.linspace(west, east, columns)
    if scan & 0x20:  # neighbours run along a meridian
        return np.tile(lats, columns), np.repeat(lons, rows), values
    return np.repeat(lats, columns), np.tile(lons, rows), values


def _points(m: Message, raw: bytes, present: bool = False):
    """A message's rows as one Arrow batch; ``present`` leaves masked points out."""
    import numpy as np
    import pyarrow as pa

    lats, lons, values = decode(raw, m)
    if present:
        known = ~np.isnan(values)
        lats, lons, values = lats[known], lons[known], values[known]
    n = len(values)
    same = lambda v: pa.array(np.full(n, v, np.int32))
    ts = pa.array(np.full(n, round(m.ts * 1e6), "datetime64[us]"), pa.timestamp("us", "UTC"))
    cols = [ts, pa.array(lats), pa.array(lons), same(m.param), same(m.level_type), same(m.level), pa.array(values, from_pandas=True)]
    return pa.RecordBatch.from_arrays(cols, ["ts", "lat", "lon", "param", "level_type", "level", "value"])


SCHEMA = "ts timestamp, lat double, lon double, param int, level_type int, level int, value double"


def _ranges(paths: Iterable[str], split: int) -> list[_Range]:
    """Byte ranges of files and of the files that folders publish."""
    out = []
    for p in paths:
        if store.is_folder(p):
            t = store.indexed(p)
            own = [] if t is None else [(f"{p.rstrip('/')}/{f}", n) for f, n in zip(t["file"].to_pylist(), t["bytes"].to_pylist())]
        else:
            own = [(p, store.sizes([p])[0])]
        out += [_Range(f, a, min(a + split, n)) for f, n in own for a in range(0, n, split)]
    return out


class GribReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.split = options["path"].split(","), int(options.get("splitBytes", SPLIT))
        self.bounds, self.present = store.Bounds(("ts", "param", "level_type", "level")), False
        for k in ("param", "level_type"):
            if options.get(k):
                self.bounds[k] = [float(options[k])] * 2

    def partitions(self):
        return _ranges(self.paths, self.split) or [_Range("", 0, 0)]

    def _wanted(self, m: Message) -> bool:
        return all(self.bounds.hold(k, getattr(m, k)) for k in self.bounds)

    def read(self, part):
        if part.path:
            read = store.Ranges(part.path)
            for m in messages_in(read, part.start, part.stop, self._wanted):
                yield _points(m, read(m.at, m.size), self.present)


class PushedGribReader(GribReader):
    """The same with comparisons of what headers say, and ``value is not null``, pushed down; Spark asks for its own setting then."""

    def pushFilters(self, filters):
        filters = list(filters)
        self.bounds.narrow(filters)
        self.present |= "value" in store.present(filters)
        return filters  # Spark still judges each row exactly


def headers(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    """(path, at, size, param, level_type, level, ts, sections, decimal): the index of all messages, one task a range of bytes.

    Worth writing once: later reads choose messages from the table and touch no other header.
    """
    import pyarrow as pa

    ranges = _ranges(paths, split)
    src = spark.createDataFrame([(r.path, r.start, r.stop) for r in ranges], "path string, start long, stop long").repartition(max(1, len(ranges)), "path", "start")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, stop in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = list(messages_in(store.Ranges(path), start, stop))
                cols = list(zip(*found)) if found else [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *arrays], ["path", *Message._fields])

    d = src.mapInArrow(run, "path string, at long, size long, param int, level_type int, level int, ts double, sections int, decimal int")
    return d.withColumn("ts", F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("long")))


def points(index: DataFrame) -> DataFrame:
    """(ts, lat, lon, param, level_type, level, value) of the messages that ``index`` (rows of ``headers``) names, a byte range each."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, read = None, None
        for b in batches:
            for path, *own in zip(*(b.column(i).to_pylist() for i in range(9))):
                if path != last:
                    last, read = path, store.Ranges(path)
                m = Message(*own)
                yield _points(m, read(m.at, m.size))

    d = index.select("path", "at", "size", "param", "level_type", "level", (F.unix_micros("ts") / 1_000_000).alias("ts"), "sections", "decimal")
    # messages are dealt out evenly, wherever their headers were read
    return d.repartition("path", "at").sortWithinPartitions("path", "at").mapInArrow(run, SCHEMA)


# --------------------------------------------------------------------------
# writing


def _sign(v: int, n: int) -> bytes:
    """A whole number in ``n`` bytes, its highest bit the sign."""
    return (abs(v) | (1 << (8 * n - 1) if v < 0 else 0)).to_bytes(n, "big")


def _base16(x: float) -> tuple[bytes, float]:
    """The largest base-16 float of 24 bits that is not over ``x``, and its value."""
    import math

    if x == 0:
        return b"\0\0\0\0", 0.0
    power = max(-64, math.floor(math.log(abs(x), 16)) + 1)
    fraction = math.floor(x / 16.0**power * 2**24)
    if abs(fraction) >= 1 << 24:
        power, fraction = power + 1, math.floor(x / 16.0 ** (power + 1) * 2**24)
    return bytes([(0x80 if fraction < 0 else 0) | (power + 64)]) + abs(fraction).to_bytes(3, "big"), fraction / 2**24 * 16.0**power


def encode(ts: float, param: int, level_type: int, level: int, lats, lons, values, bits: int = 24, decimal: int = 0) -> bytes:
    """One message of a field on a regular grid; points that are not there, or NaN, are masked."""
    import numpy as np

    def axis(places, back: bool):
        """(values in thousandths of a degree, evenly spaced, and each point's place among them)."""
        own, at = np.unique(np.rint(np.asarray(places) * 1000).astype(np.int64), return_inverse=True)
        step = int(np.gcd.reduce(np.diff(own))) if len(own) > 1 else 1
        count = int(own[-1] - own[0]) // step + 1
        if count > 65_534:
            raise ValueError("the points of a field do not lie on a regular grid")
        at = (own[at] - own[0]) // step
        return (own[0] + step * np.arange(count))[:: -1 if back else 1], count - 1 - at if back else at

    (y, row), (x, column) = axis(lats, True), axis(lons, False)  # north first
    field = np.full((len(y), len(x)), np.nan)
    field[row, column] = values
    flat = field.reshape(-1)
    known = ~np.isnan(flat)
    v = flat[known] * 10.0**decimal
    least, low = _base16(float(v.min()) if len(v) else 0.0)
    spread = float(v.max() - low) if len(v) else 0.0
    scale = 0
    while round(spread / 2.0**scale) >= 1 << bits:
        scale += 1
    steps = np.round((v - low) / 2.0**scale).astype(np.uint64)
    when = dt.datetime.fromtimestamp(ts, dt.timezone.utc)
    number = lambda n, size: int(n).to_bytes(size, "big")
    masked = not known.all()
    year = when.year % 100 or 100
    pds = number(28, 3) + bytes([128, 255, 1, 255, 0x80 | 0x40 * masked, param, level_type]) + number(level, 2) + bytes([year, when.month, when.day, when.hour, when.minute, 1, 0, 0, 10, 0, 0, 0, (when.year - year) // 100 + 1, 0]) + _sign(decimal, 2)
    place = lambda d: _sign(int(d), 3)
    gap = lambda a: number(abs(a[1] - a[0]), 2) if len(a) > 1 else b"\xff\xff"
    gds = number(32, 3) + bytes([0, 255, 0]) + number(len(x), 2) + number(len(y), 2) + place(y[0]) + place(x[0]) + b"\x80" + place(y[-1]) + place(x[-1]) + gap(x) + gap(y) + b"\0" * 5
    bms = b""
    if masked:
        mask = np.packbits(known).tobytes()
        mask += b"\0" * (len(mask) % 2)
        bms = number(6 + len(mask), 3) + bytes([8 * len(mask) - len(flat)]) + b"\0\0" + mask
    if bits in (8, 16, 24, 32):  # whole bytes
        packed = steps.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - bits // 8 :].tobytes()
    else:
        packed = np.packbits(((steps[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)).tobytes()
    unused = 8 * len(packed) - bits * len(v)
    if (11 + len(packed)) % 2:
        packed, unused = packed + b"\0", unused + 8
    bds = number(11 + len(packed), 3) + bytes([unused]) + _sign(scale, 2) + least + bytes([bits]) + packed
    rest = pds + gds + bms + bds + b"7777"
    return b"GRIB" + number(8 + len(rest), 3) + b"\x01" + rest


class GribWriter(store.FolderWriter):
    """A message a run of rows with one (ts, param, level_type, level); a file a task, or more once it is large."""

    suffix, most = ".grib", 256 << 20

    def __init__(self, options, overwrite):
        super().__init__(options["path"], overwrite)
        self.bits, self.decimal = int(options.get("bits", 24)), int(options.get("decimal", 0))

    def files(self, batches) -> Iterator[tuple[bytes, dict]]:
        import pyarrow as pa

        names = ["ts", "param", "level_type", "level"]
        held, key, data, n = [], None, bytearray(), 0

        def message() -> bytes:
            t = pa.Table.from_batches(held)
            ts = t.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64())[0].as_py() / 1e6
            lats, lons = (t.column(c).to_numpy() for c in ("lat", "lon"))
            return encode(ts, *key[1:], lats, lons, t.column("value").to_numpy(), self.bits, self.decimal)

        for b in batches:
            for at, end in store.stretches([b.column(b.schema.get_field_index(c)) for c in names]):
                own = tuple(b.column(c)[at].as_py() for c in names)
                if own != key and held:
                    data += message()
                    held, n = [], n + 1
                    if len(data) >= self.most:
                        yield bytes(data), {"messages": n}
                        data, n = bytearray(), 0
                held.append(b.slice(at, end - at))
                key = own
        if held:
            data += message()
            n += 1
        if n:
            yield bytes(data), {"messages": n}


class GribSource(DataSource):
    @classmethod
    def name(cls):
        return "grib"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushedGribReader if self.options.get("pushdown") == "true" else GribReader)(self.options)

    def writer(self, schema, overwrite):
        return GribWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GribSource)


def read(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """The points of all messages of GRIB files and folders."""
    register(spark)
    return spark.read.format("grib").option("pushdown", "true").option("path", ",".join(paths)).options(**options).load()


def write(df: DataFrame, path: str, bits: int = 24, decimal: int = 0, mode: str = "append") -> None:
    """``df``'s (ts, lat, lon, param, level_type, level, value) as a folder of GRIB files, a message a field.

    Times are written to the minute, places to a thousandth of a degree, values to
    ``decimal`` decimal places and at most ``bits`` bits over a field's least.
    """
    register(df.sparkSession)
    key = ["ts", "param", "level_type", "level"]
    d = df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), *(F.col(c).cast("int").alias(c) for c in key[1:]), F.col("value").cast("double").alias("value"))
    d.repartition(*key).sortWithinPartitions(*key).write.format("grib").option("path", path).option("bits", bits).option("decimal", decimal).mode(mode).save()
