"""Shared plumbing of the training-data operators.

Everything an executor runs from this subpackage is pickled by value, so a
cluster needs no copy of the package on its workers.  Intermediate tables go
to the folder that the session names in ``spark.checkpoint.dir``; they are
plain Parquet, so losing an executor never loses them.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Bytes that separate words in every contract of this package.
BLANK = b" \t\n\x0b\x0c\r"


# --------------------------------------------------------------------------
# shared folder and staged tables


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that driver and executors share."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # only in tests on one machine
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="phaseline-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/phaseline-{uuid.uuid4().hex}"


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and bytes of a text column, from one JVM-side pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column).cast("long")).alias("b")).first()
    return int(row.n), int(row.b or 0)


def pieces(total_bytes: int, each: int, least: int = 8, most: int = 1 << 20) -> int:
    """How many buckets of about ``each`` bytes hold ``total_bytes``."""
    return max(least, min(most, -(-total_bytes // each)))


def prefix_sums(df: DataFrame, order: str, value: str, fan: int = 4096) -> DataFrame:
    """(order, before): the sum of ``value`` over all smaller integer ``order``.

    ``df`` holds one row a partition of something larger.  Two levels keep each
    window to ``fan`` rows: inside a group of ``fan`` orders, and over groups.
    """
    d = df.select(F.col(order).cast("long").alias("_o"), F.col(value).cast("long").alias("_v"))
    d = d.withColumn("_g", F.floor(F.col("_o") / F.lit(fan)))
    groups = d.groupBy("_g").agg(F.sum("_v").alias("_s"))
    over = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_g", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_g").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return d.join(groups, "_g").select(F.col("_o").alias(order), (F.col("_base") + F.col("_in")).alias("before"))


# --------------------------------------------------------------------------
# blobs: Arrow IPC inside a binary column


def to_blob(level: int = 1, **columns) -> bytes:
    """Columns of one length as one compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def np_col(table: pa.Table, name: str) -> np.ndarray:
    c = table.column(name)
    return c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.combine_chunks().to_numpy(zero_copy_only=False) if c.num_chunks != 1 else c.chunk(0).to_numpy(zero_copy_only=False)


def pack_documents(df: DataFrame, key: str, text: str, block_bytes: int = 4 << 20, level: int = 1) -> DataFrame:
    """(block long, payload binary): documents in blocks.

    A payload is a compressed Arrow stream of (key, text); a block holds at
    least one document and closes once it has ``block_bytes`` of text.
    """
    src = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            nonlocal seq, size
            blob = to_blob(level, k=pa.concat_arrays(keys), x=pa.concat_arrays(texts))
            keys.clear(), texts.clear()
            size, seq = 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([seq - 1], pa.int64()), pa.array([blob], pa.binary())], ["block", "payload"])

        for b in batches:
            k, x = b.column(0), b.column(1).cast(pa.large_binary())
            ends = np.cumsum(byte_lengths(x))
            at = 0
            while at < len(k):
                base = ends[at - 1] if at else 0
                to = min(len(k), int(np.searchsorted(ends, base + block_bytes - size)) + 1)
                keys.append(k.slice(at, to - at)), texts.append(x.slice(at, to - at))
                size += int(ends[to - 1] - base)
                at = to
                if size >= block_bytes:
                    yield flush()
        if keys:
            yield flush()

    return src.mapInArrow(pack, "block long, payload binary")


def byte_lengths(x: pa.Array) -> np.ndarray:
    """Byte lengths of a binary or string array without nulls."""
    import pyarrow.compute as pc

    return pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64)


def unpack(payload: bytes) -> tuple[list, list[bytes]]:
    """Keys (None where null) and texts as UTF-8 bytes of one block."""
    t = from_blob(payload)
    return t.column("k").to_pylist(), t.column("x").to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    ends = np.cumsum(lengths)
    out += np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
    return out


# --------------------------------------------------------------------------
# hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public 64-bit murmur constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hash of each word of a list, remembered from call to call."""

    def __init__(self, most: int = 400_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.seen) > self.most:
            self.seen.clear()
        seen, h = self.seen, xxhash.xxh3_64_intdigest
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in seen:
                    seen[w] = h(w)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


# --------------------------------------------------------------------------
# connected components


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in ``edges(a, b)``.

    Alternating large-star and small-star steps; each round's edges are written
    to the shared folder.  Nothing but two numbers a round reaches the driver.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u links to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours link to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(least, "u")
        e = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = staged(e)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if (now.n, now.h) == before:
            break
        before = (now.n, now.h)
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
