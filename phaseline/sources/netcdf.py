"""NetCDF classic files (CDF-1, CDF-2 and CDF-5), read by byte ranges, and written whole for one chunk of a cube.

Fixed values and layout are those of the public format description.  NetCDF-4 files
are HDF5 and need a codec; they are refused by name.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Fixed values of the format: type codes, and the tags of its lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {"i1": 1, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Values that stand for nothing where a variable names none.
FILL = {"i1": -127, "i2": -32767, "i4": -2147483647, "f4": 9.969209968386869e36, "f8": 9.969209968386869e36}
SECONDS = {"second": 1, "seconds": 1, "s": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600, "h": 3600, "day": 86400, "days": 86400, "d": 86400}


class Classic:
    """A classic file: its header is read once, values by byte ranges of ``read(start, length)``."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, self.data, self.at = read, b"", 0
        magic = self._take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("this is an HDF5 file; NetCDF-4 needs its codec" if magic[1:4] == b"HDF" else "this is no NetCDF classic file")
        self.count, self.offset = (">q" if magic[3] == 5 else ">i"), (">i" if magic[3] == 1 else ">q")
        self.records = self._number()
        self.dimensions = [(self._name(), self._number()) for _ in range(self._list(DIMENSIONS))]
        self.attributes = self._attributes()
        self.variables: dict[str, dict] = {}
        for _ in range(self._list(VARIABLES)):
            name = self._name()
            dims = [self._number() for _ in range(self._number())]
            own = {"dims": [self.dimensions[d][0] for d in dims], "attributes": self._attributes()}
            own["type"] = np.dtype(TYPES[self._number(">i")])
            own["size"], own["begin"] = self._number(), self._number(self.offset)
            own["record"] = bool(dims) and self.dimensions[dims[0]][1] == 0
            own["shape"] = tuple(self.records if self.dimensions[d][1] == 0 else self.dimensions[d][1] for d in dims)
            self.variables[name] = own
        of_records = [v for v in self.variables.values() if v["record"]]
        row = lambda v: v["type"].itemsize * int(np.prod(v["shape"][1:], dtype=np.int64))
        self.stride = row(of_records[0]) if len(of_records) == 1 else sum(-(-row(v) // 4) * 4 for v in of_records)

    def _take(self, n: int) -> bytes:
        while len(self.data) < self.at + n:
            more = self.read(len(self.data), max(8192, n))
            if not more:
                raise ValueError("the header ends early")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def _number(self, kind: str | None = None) -> int:
        kind = kind or self.count
        return struct.unpack(kind, self._take(struct.calcsize(kind)))[0]

    def _padded(self, n: int) -> bytes:
        return self._take(-(-n // 4) * 4)[:n]

    def _name(self) -> str:
        return self._padded(self._number()).decode()

    def _list(self, tag: int) -> int:
        found, n = self._number(">i"), self._number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("the header's lists are out of order")
        return n

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTES)):
            name, kind = self._name(), np.dtype(TYPES[self._number(">i")])
            n = self._number()
            raw = self._padded(n * kind.itemsize)
            out[name] = raw.decode() if kind.kind == "S" else np.frombuffer(raw, kind)[0].item() if n == 1 else np.frombuffer(raw, kind).tolist()
        return out

    def raw(self, name: str, start: int = 0, stop: int | None = None, low: int = 0, high: int | None = None) -> np.ndarray:
        """Stored values of rows ``start`` to ``stop`` of the first axis, and of ``low`` to ``high`` of the second."""
        v = self.variables[name]
        shape, kind = v["shape"] or (1,), v["type"]
        stop = shape[0] if stop is None else min(stop, shape[0])
        n, row = max(0, stop - start), kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        step = self.stride if v["record"] else row
        high = shape[1] if high is None and len(shape) > 1 else high
        if not n or not row:
            return np.zeros((n, *shape[1:]), kind)
        if len(shape) > 1 and 4 * (high - low) <= shape[1]:  # a narrow band: a range a row
            inner = row // shape[1]
            bands = [self.read(v["begin"] + (start + i) * step + low * inner, (high - low) * inner) for i in range(n)]
            return np.frombuffer(b"".join(bands), kind).reshape(n, high - low, *shape[2:])
        data = self.read(v["begin"] + start * step, (n - 1) * step + row)
        out = np.ndarray((n, row // kind.itemsize), kind, data, 0, (step, kind.itemsize)).reshape(n, *shape[1:])
        return out[:, low:high] if len(shape) > 1 else out

    def values(self, name: str, *where) -> np.ndarray:
        """Values as floats: unpacked by scale and offset, NaN where missing."""
        v, x = self.variables[name]["attributes"], self.raw(name, *where)
        missing = [v[k] for k in ("_FillValue", "missing_value") if k in v] or [FILL.get(x.dtype.str[1:])]
        gone = np.isin(x, np.array([m for m in missing if m is not None], x.dtype)) if any(m is not None for m in missing) else np.zeros(x.shape, bool)
        out = x.astype(float) * v.get("scale_factor", 1.0) + v.get("add_offset", 0.0)
        out[gone] = np.nan
        return out

    def times(self, name: str = "time") -> np.ndarray:
        """Epoch seconds of a CF time axis."""
        v = self.variables[name]["attributes"]
        m = re.match(r"\s*(\w+)\s+since\s+(\d+)-(\d+)-(\d+)(?:[ T](\d+):(\d+)(?::(\d+(?:\.\d+)?))?)?", v.get("units", ""))
        if not m or m[1].lower() not in SECONDS or v.get("calendar", "standard") not in ("standard", "gregorian", "proleptic_gregorian"):
            raise ValueError(f"time in {v.get('units')!r}, calendar {v.get('calendar')!r}, is not read")
        start = dt.datetime(*(int(m[i]) for i in (2, 3, 4)), int(m[5] or 0), int(m[6] or 0), tzinfo=dt.timezone.utc).timestamp() + float(m[7] or 0)
        return start + self.raw(name).astype(float) * SECONDS[m[1].lower()]


def _text(name: str) -> bytes:
    b = name.encode()
    return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)


def _listed(tag: int, items: list[bytes]) -> bytes:
    return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)


def _attribute(name: str, value) -> bytes:
    if isinstance(value, str):
        b = value.encode()
        return _text(name) + struct.pack(">ii", 2, len(b)) + b + b"\0" * (-len(b) % 4)
    x = np.atleast_1d(np.asarray(value))
    x = x.astype(">f8" if x.dtype.kind == "f" and x.dtype.itemsize == 8 else x.dtype.newbyteorder(">") if x.dtype.str[1:] in CODES else ">i4")
    b = x.tobytes()
    return _text(name) + struct.pack(">ii", CODES[x.dtype.str[1:]], len(x)) + b + b"\0" * (-len(b) % 4)


def encoded(dimensions: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict) -> bytes:
    """A CDF-2 file of fixed axes: name -> (dimensions, values, attributes)."""
    names = list(dimensions)
    arrays = {n: np.ascontiguousarray(x, x.dtype.newbyteorder(">")) for n, (_, x, _) in variables.items()}

    def head(begins: dict[str, int]) -> bytes:
        dims = [_text(n) + struct.pack(">i", k) for n, k in dimensions.items()]
        each = []
        for n, (on, _, own) in variables.items():
            size = arrays[n].nbytes + -arrays[n].nbytes % 4
            each.append(_text(n) + struct.pack(f">{1 + len(on)}i", len(on), *(names.index(d) for d in on)) + _listed(ATTRIBUTES, [_attribute(*a) for a in own.items()]) + struct.pack(">iiq", CODES[arrays[n].dtype.str[1:]], min(size, (1 << 31) - 4), begins[n]))
        return b"CDF\x02" + struct.pack(">i", 0) + _listed(DIMENSIONS, dims) + _listed(ATTRIBUTES, [_attribute(*a) for a in attributes.items()]) + _listed(VARIABLES, each)

    at, begins = len(head(dict.fromkeys(variables, 0))), {}
    for n, x in arrays.items():
        begins[n] = at
        at += x.nbytes + -x.nbytes % 4
    return head(begins) + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 4) for x in arrays.values())
