"""Files by URI: read by byte ranges inside tasks, and written so that a job's files appear together or not at all.

Paths go through Arrow's file systems (local, HDFS, S3, GCS), so a task needs no
mounted folder.  A written folder holds ``data-<job>/`` with files and
``index-<job>.parquet`` with a row a file; a file that no index names does not
exist for readers.
"""

from __future__ import annotations

import datetime as dt
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSourceArrowWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package


def located(uri: str):
    """(Arrow file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri[5:]).lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Ranges:
    """A file read by byte ranges; ``taken`` counts the bytes."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self.file, self.taken = system.open_input_file(path), 0
        self.size = self.file.size()

    def __call__(self, start: int, length: int) -> bytes:
        out = self.file.read_at(length, start)
        self.taken += len(out)
        return out

    def close(self) -> None:
        self.file.close()


def sizes(uris: list[str]) -> list[int]:
    """Bytes of each file; all that a driver asks of a file."""
    out = []
    for u in uris:
        system, path = located(u)
        info = system.get_file_info(path)
        if not info.is_file:
            raise FileNotFoundError(u)
        out.append(info.size)
    return out


def is_folder(uri: str) -> bool:
    from pyarrow import fs

    system, path = located(uri)
    return system.get_file_info(path).type == fs.FileType.Directory


def indexed(folder: str):
    """The rows of all indexes of a folder as one Arrow table, ``file`` relative to it; None where there is no index."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = located(folder)
    found = [i.path for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.base_name.startswith("index-") and i.base_name.endswith(".parquet")]
    tables = [pq.read_table(system.open_input_file(p)) for p in sorted(found)]
    return pa.concat_tables(tables, promote_options="default") if tables else None


class Bounds(dict):
    """Column -> [least, largest] value that pushed comparisons leave possible; times in epoch seconds."""

    def __init__(self, columns: Iterable[str]):
        super().__init__({c: [float("-inf"), float("inf")] for c in columns})

    def narrow(self, filters: Iterable) -> None:
        """Takes in the comparisons that it understands; the others change nothing."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                continue
            values = [_number(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
            if values and not isinstance(f, (LessThan, LessThanOrEqual)):
                self[name][0] = max(self[name][0], min(values))
            if values and not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self[name][1] = min(self[name][1], max(values))

    def hold(self, name: str, value: float) -> bool:
        return self[name][0] <= value <= self[name][1]


def present(filters: Iterable) -> set[str]:
    """Columns that pushed filters ask to be there."""
    return {f.attribute[0] for f in filters if isinstance(f, IsNotNull) and len(f.attribute) == 1}


def stretches(columns: Iterable) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of rows that are alike in all ``columns``, Arrow arrays of one length."""
    import numpy as np

    new = None
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        if new is None:
            new = np.arange(len(code)) == 0
        new[1:] |= code[1:] != code[:-1]
    starts = np.flatnonzero(new).tolist()
    yield from zip(starts, [*starts[1:], len(new)])


def _number(v) -> float:
    return (v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)).timestamp() if isinstance(v, dt.datetime) else float(v)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: a row of the index a file."""

    entries: list[dict]


class FolderWriter(DataSourceArrowWriter):
    """Two-phase commit: tasks write files under the job's own name, the driver publishes the index of those that ended well.

    A subclass gives ``suffix`` and ``files(batches)``, an iterator of (bytes, index row).
    A task that fails takes its own files away; ``abort`` takes the job's folder away,
    and ``commit`` whatever lost attempts left in it.
    """

    suffix = ""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    def files(self, batches: Iterable) -> Iterator[tuple[bytes, dict]]:
        raise NotImplementedError

    def write(self, iterator) -> Written:
        system, base = located(self.folder)
        own, entries = uuid.uuid4().hex, []  # an attempt's files have names of their own
        try:
            for data, entry in self.files(iterator):
                name = f"data-{self.job}/{own}-{len(entries):05d}{self.suffix}"
                entries.append(entry | {"file": name, "bytes": len(data)})
                system.create_dir(f"{base}/data-{self.job}", recursive=True)
                with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(data)
        except BaseException:
            for e in entries:
                _remove(system, f"{base}/{e['file']}")
            raise
        return Written(entries)

    def commit(self, messages) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = located(self.folder)
        entries = [e for m in messages if m is not None for e in m.entries]
        kept = {e["file"].rpartition("/")[2] for e in entries}
        for info in system.get_file_info(fs.FileSelector(f"{base}/data-{self.job}", allow_not_found=True)):
            if info.base_name not in kept:
                _remove(system, info.path)
        earlier = [i for i in system.get_file_info(fs.FileSelector(base, allow_not_found=True))] if self.overwrite else []
        if entries:
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/_new-{self.job}") as out:
                pq.write_table(pa.Table.from_pylist(entries), out)
            system.move(f"{base}/_new-{self.job}", f"{base}/index-{self.job}.parquet")  # from here on the files are there
        for i in sorted(earlier, key=lambda i: not i.base_name.startswith("index-")):
            if i.base_name.startswith(("index-", "data-")) and self.job not in i.base_name:
                _remove(system, i.path)

    def abort(self, messages) -> None:
        system, base = located(self.folder)
        _remove(system, f"{base}/data-{self.job}")


def _remove(system, path: str) -> None:
    from pyarrow import fs

    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind == fs.FileType.File:
        system.delete_file(path)
