"""A Spark data source for gridded cubes: rows are (ts, lat, lon, variables), NaN is NULL.

``read(spark, paths, variables)``, or ``spark.read.format("cube").option("path", ...).option("variables", "ar,ep")``,
reads NetCDF classic files (``.nc``), NumPy archives (``.npz`` with ``time`` in epoch seconds,
``lat``, ``lon`` and one ``[time, lat, lon]`` array a variable), NetCDF-4 where its codec is
installed, or a folder that ``write`` made.  The path may name several, by commas.

* ``read`` pushes comparisons of ts, lat and lon down: chunks of a folder are chosen by its
  index, and of a file only the times and the band of latitudes asked for are read.
  ``variables`` prunes columns: others are not read.
* ``v is not null`` is pushed down too: points without a value are left out where they are read.
* The driver knows files by their sizes and a folder by its index.  Headers and axes
  are read in tasks: a file is shared out by its size, and each task takes its share of
  the times; of the chunks of a folder a task takes one, or several once there are many.
* ``write`` deals rows out to chunks by ranges of the axes, one task a chunk; a chunk is a
  NetCDF file with CF attributes of its own, compressed whole if asked for.  Files are
  published by one index at the end (``store.FolderWriter``).
"""

from __future__ import annotations

import gzip
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import netcdf, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

AXES = ("ts", "lat", "lon")
#: CF attributes of the axes (fixed values).
CF = {
    "time": {"units": "seconds since 1970-01-01 00:00:00", "calendar": "standard", "standard_name": "time", "axis": "T"},
    "lat": {"units": "degrees_north", "standard_name": "latitude", "axis": "Y"},
    "lon": {"units": "degrees_east", "standard_name": "longitude", "axis": "X"},
}
#: Bytes of a file that one task reads, and values that it holds at once.
SPLIT, HELD = 128 << 20, 1 << 21
#: Chunks of a folder up to which each has a task of its own, and rows that are put together from small ones.
TASKS, ROWS = 256, 1 << 15


@dataclass
class _Share(InputPartition):
    """Part ``number`` of ``parts`` equal parts of a file's times."""

    path: str
    number: int
    parts: int


@dataclass
class _Chunks(InputPartition):
    """Some of a folder's files, each read whole."""

    paths: list[str]


# --------------------------------------------------------------------------
# one file


class _Archive:
    """A NumPy archive: plain members are read by ranges, deflated ones from their start."""

    def __init__(self, path: str):
        import zipfile

        system, inner = store.located(path)
        self.zip = zipfile.ZipFile(system.open_input_file(inner))
        self.deflated = any(i.compress_type != zipfile.ZIP_STORED for i in self.zip.infolist())

    def rows(self, name: str, start: int = 0, stop: int | None = None):
        import numpy as np

        with self.zip.open(f"{name}.npy") as f:
            major, _ = np.lib.format.read_magic(f)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)
            if fortran and len(shape) > 1:
                raise ValueError(f"{name} must be in row order, times first")
            stop = min(shape[0], shape[0] if stop is None else stop)
            row = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
            f.seek(f.tell() + start * row)
            return np.frombuffer(f.read((stop - start) * row), kind).reshape(stop - start, *shape[1:])


def _open(path: str):
    """(times, lats, lons, getter of a variable's rows) of a file."""
    import numpy as np

    if path.endswith(".npz"):
        a = _Archive(path)
        return a.rows("time"), a.rows("lat"), a.rows("lon"), lambda name, i, j, low=0, high=None: a.rows(name, i, j)[:, low:high]
    read = store.Ranges(path)
    if path.endswith(".gz"):
        whole = gzip.decompress(read(0, read.size))
        read = lambda start, length: whole[start : start + length]
    elif read(0, 4)[1:4] == b"HDF":
        try:
            import netCDF4
        except ImportError as e:
            raise ImportError("reading NetCDF-4 needs the netCDF4 package; classic NetCDF does not") from e
        n = netCDF4.Dataset(store.located(path)[1])
        when = netCDF4.num2date(n["time"][:], n["time"].units, only_use_cftime_datetimes=False)
        lat, lon = (n[a] if a in n.variables else n[b] for a, b in (("lat", "latitude"), ("lon", "longitude")))
        return np.array([t.timestamp() for t in when]), lat[:], lon[:], lambda name, i, j, low=0, high=None: n[name][i:j, low:high].filled(np.nan)
    c = netcdf.Classic(read)
    lat, lon = (a if a in c.variables else b for a, b in (("lat", "latitude"), ("lon", "longitude")))
    return c.times(), c.values(lat), c.values(lon), lambda name, i, j, low=0, high=None: c.values(name, i, j, low, high)


# --------------------------------------------------------------------------
# reading


class CubeReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields[3:]]
        self.paths, self.split = options["path"].split(","), int(options.get("splitBytes", SPLIT))
        self.times = int(options.get("times", 0))
        self.bounds = store.Bounds(AXES)
        self.present: set[str] = set()  # variables that rows must have

    def partitions(self):
        out = []
        for p in self.paths:
            if store.is_folder(p):
                out += self._dealt(p, self._chosen(p))
            else:
                (size,) = store.sizes([p])
                parts = max(1, -(-size // self.split))
                out += [_Share(p, i, parts) for i in range(parts)]
        return out or [_Share("", 0, 1)]

    def _dealt(self, folder: str, chunks: list[dict]) -> list[_Chunks]:
        """Chunks in the index's order, shared out by their bytes."""
        total = sum(e["bytes"] for e in chunks)
        parts = max(min(len(chunks), TASKS), -(-total // self.split))
        out, before = {}, 0
        for i, e in enumerate(chunks):
            own = i if len(chunks) <= parts else before * parts // total
            out.setdefault(own, []).append(f"{folder.rstrip('/')}/{e['file']}")
            before += e["bytes"]
        return [_Chunks(paths) for paths in out.values()]

    def _chosen(self, folder: str) -> list[dict]:
        """Index rows of the chunks that meet the bounds."""
        import pyarrow.compute as pc

        t = store.indexed(folder)
        if t is None:
            return []
        for a, (low, high) in self.bounds.items():
            t = t.filter(pc.and_(pc.less_equal(t[f"{a}_low"], high), pc.greater_equal(t[f"{a}_high"], low)))
        return t.select(["file", "bytes"]).to_pylist()

    def read(self, part):
        import pyarrow as pa

        if isinstance(part, _Share):
            yield from self._rows(part)
            return
        held, n = [], 0
        for path in part.paths:
            for b in self._rows(_Share(path, 0, 1)):
                held, n = [*held, b], n + len(b)
                if n >= ROWS:
                    yield pa.concat_batches(held)
                    held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    def _rows(self, part: _Share):
        import numpy as np
        import pyarrow as pa

        if not part.path:
            return
        time, lat, lon, get = _open(part.path)
        time, lat, lon = (np.asarray(x, float) for x in (time, lat, lon))
        first, last = (len(time) * (part.number + k) // part.parts for k in (0, 1))
        if part.path.endswith(".npz") and _Archive(part.path).deflated:  # each share would inflate all that lies before it, so one takes all
            first, last = (0, len(time)) if part.number == 0 else (0, 0)
        wanted = lambda x, a: np.flatnonzero((x >= self.bounds[a][0]) & (x <= self.bounds[a][1]))
        at = wanted(time, "ts")
        at = at[(at >= first) & (at < last)]
        rows, columns = wanted(lat, "lat"), wanted(lon, "lon")
        if not len(at) or not len(rows) or not len(columns):
            return
        low, high = int(rows[0]), int(rows[-1]) + 1
        step = self.times or max(1, HELD // max(1, len(lat) * len(lon)))
        for a in range(int(at[0]), int(at[-1]) + 1, step):
            own = at[(at >= a) & (at < a + step)]
            if not len(own):
                continue
            i, j = int(own[0]), int(own[-1]) + 1
            t, y, x = time[own], lat[rows], lon[columns]
            shape = (len(t), len(y), len(x))
            axes = [np.broadcast_to(v, shape).reshape(-1) for v in (t[:, None, None], y[None, :, None], x[None, None, :])]
            cols = [pa.array((axes[0] * 1e6).round().astype("datetime64[us]"), pa.timestamp("us", "UTC")), pa.array(axes[1]), pa.array(axes[2])]
            there = np.ones(len(axes[0]), bool)
            for v in self.names:
                got = np.asarray(get(v, i, j, low, high), float)[np.ix_(own - i, rows - low, columns)].reshape(-1)
                cols.append(pa.array(got, from_pandas=True))
                if v in self.present:
                    there &= ~np.isnan(got)
            b = pa.RecordBatch.from_arrays(cols, [*AXES, *self.names])
            yield b if there.all() else b.filter(pa.array(there))


class PushedCubeReader(CubeReader):
    """The same with comparisons of the axes, and variables that must be there, pushed down; Spark asks for its own setting then."""

    def pushFilters(self, filters):
        filters = list(filters)
        self.bounds.narrow(filters)
        self.present |= store.present(filters)
        return filters  # Spark still judges each row exactly


# --------------------------------------------------------------------------
# writing


class CubeWriter(store.FolderWriter):
    """A chunk a run of rows with one value of the first column; the others are ts, lat, lon and variables."""

    def __init__(self, schema, options, overwrite):
        super().__init__(options["path"], overwrite)
        self.level, self.suffix = int(options.get("level", 0)), ".nc.gz" if int(options.get("level", 0)) else ".nc"
        self.attributes = json.loads(options.get("attributes", "{}"))
        self.kinds = {f.name: {"byte": "i1", "short": "i2", "integer": "i4", "float": "f4"}.get(f.dataType.typeName(), "f8") for f in schema.fields[4:]}

    def files(self, batches) -> Iterator[tuple[bytes, dict]]:
        import pyarrow as pa

        held, key = [], None
        for b in batches:
            for at, end in store.stretches(b.columns[:1]):
                own = b.column(0)[at].as_py()
                if own != key and held:
                    yield self._chunk(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(at, end - at))
                key = own
        if held:
            yield self._chunk(pa.Table.from_batches(held))

    def _chunk(self, t) -> tuple[bytes, dict]:
        import numpy as np
        import pyarrow as pa

        ts = t.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy() / 1e6
        axes = [np.unique(v, return_inverse=True) for v in (ts, t.column("lat").to_numpy(), t.column("lon").to_numpy())]
        shape = tuple(len(a) for a, _ in axes)
        points = int(np.prod(shape, dtype=np.int64))
        if points > max(1 << 20, 256 * len(t)):
            raise ValueError("the points of a chunk do not lie on a grid")
        place = np.ravel_multi_index([i for _, i in axes], shape)
        if len(np.unique(place)) < len(place):
            raise ValueError("a point of the cube has several rows")
        variables = {n: ((n,), a, CF[n] | self.attributes.get(n, {})) for n, (a, _) in zip(CF, axes)}
        for n, kind in self.kinds.items():
            fill = netcdf.FILL[kind]
            x = np.full(points, fill, kind)
            col = t.column(n).combine_chunks()
            there = ~np.asarray(col.is_null(nan_is_null=True))
            x[place[there]] = col.to_numpy(zero_copy_only=False)[there].astype(kind)
            variables[n] = (("time", "lat", "lon"), x.reshape(shape), self.attributes.get(n, {}) | {"_FillValue": np.array(fill, kind)})
        data = netcdf.encoded(dict(zip(CF, shape)), variables, {"Conventions": "CF-1.8"} | self.attributes.get("", {}))
        ends = {f"{n}_{side}": float(a[i]) for n, (a, _) in zip(AXES, axes) for side, i in (("low", 0), ("high", -1))}
        return (gzip.compress(data, self.level, mtime=0) if self.level else data), ends | {"points": points}


class CubeSource(DataSource):
    @classmethod
    def name(cls):
        return "cube"

    def schema(self):
        names = [v for v in self.options.get("variables", "").split(",") if v]
        return ", ".join(["ts timestamp", "lat double", "lon double", *(f"`{v}` double" for v in names)])

    def reader(self, schema):
        return (PushedCubeReader if self.options.get("pushdown") == "true" else CubeReader)(schema, self.options)

    def writer(self, schema, overwrite):
        return CubeWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CubeSource)


def read(spark: SparkSession, paths: list[str], variables: list[str], **options) -> DataFrame:
    """(ts, lat, lon, variables) of cube files and folders."""
    register(spark)
    r = spark.read.format("cube").option("pushdown", "true").option("path", ",".join(paths)).option("variables", ",".join(variables))
    return r.options(**options).load()


def write(df: DataFrame, path: str, variables: list[str], attributes: dict | None = None, level: int = 0, hours: int = 24 * 90, degrees: float = 10.0, mode: str = "append") -> None:
    """``df``'s (ts, lat, lon, variables) as a folder of chunks of ``hours`` times ``degrees`` times ``degrees``.

    ``attributes`` has those of each variable or axis by name, and the file's under ``""``;
    ``level`` over 0 compresses each chunk.  A point must have one row, or the job fails
    and leaves no file.  Rows without a place or time are not part of a cube and are refused.
    """
    register(df.sparkSession)
    ts = F.col("ts").cast("timestamp")
    key = F.concat_ws("/", *(F.floor(x).cast("string") for x in (F.unix_micros(ts) / F.lit(3600_000_000 * hours), F.col("lat") / F.lit(degrees), F.col("lon") / F.lit(degrees))))
    placed = F.when(ts.isNull() | F.col("lat").isNull() | F.col("lon").isNull(), F.raise_error(F.lit("a cube's row needs ts, lat and lon"))).otherwise(key)
    d = df.select(placed.alias("chunk"), ts.alias("ts"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), *variables)
    d = d.repartition("chunk").sortWithinPartitions("chunk")
    d.write.format("cube").option("path", path).option("level", level).option("attributes", json.dumps(attributes or {})).mode(mode).save()


def attributes(path: str) -> dict[str, dict]:
    """Attributes of the axes and variables of a cube, and the file's under ``""``: those of its first chunk."""
    if store.is_folder(path):
        path = f"{path.rstrip('/')}/{store.indexed(path)['file'][0].as_py()}"
    ranges = store.Ranges(path)
    whole = gzip.decompress(ranges(0, ranges.size)) if path.endswith(".gz") else None
    c = netcdf.Classic(ranges if whole is None else lambda start, length: whole[start : start + length])
    return {"": c.attributes} | {n: v["attributes"] for n, v in c.variables.items()}
