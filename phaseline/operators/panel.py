"""Panels: one row per cell and time, and what is done to their axes.

Cells are whole numbers, times are dates or timestamps.  Every function takes
and returns DataFrames and leaves joins and partitioning to Catalyst, except
that a dimension table (regions, seasons, phases) may be hinted for broadcast by
its caller, who knows its size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws
from ..sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package


def in_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows from low to high, both included; bounds take the column's type, so the filter reaches a Parquet scan."""
    kind = df.schema[column].dataType
    return df.where(F.col(column).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))


def in_box(df: DataFrame, box: dict) -> DataFrame:
    return df.where(F.col("lat").between(box["lat_min"], box["lat_max"]) & F.col("lon").between(box["lon_min"], box["lon_max"]))


def nearest_range(df: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    """Rows between the times nearest to ``low`` and ``high`` (earlier on a tie)."""
    times = df.select(column).distinct()
    near = lambda t: F.min_by(F.col(column), F.struct(F.abs(F.unix_timestamp(F.col(column).cast("timestamp")) - F.unix_timestamp(t.cast("timestamp"))), F.col(column)))
    ends = times.agg(near(low).alias("_lo"), near(high).alias("_hi"))
    return df.join(F.broadcast(ends), F.col(column).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")  # one row


def with_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """A row for each box that holds its point; bounds are included and boxes may overlap."""
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
    return df.join(regions, inside).drop("lat_min", "lat_max", "lon_min", "lon_max")


def season_of(month: Column) -> Column:
    return F.when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isin(9, 10, 11), "SON").otherwise("DJF")


def binary(x: Column, threshold: float = 0.5) -> Column:
    """1 above the threshold, else 0; NULL and NaN stay NULL."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.when(x > threshold, 1).otherwise(0))


def present(x: Column) -> Column:
    """1 where there is a value, 0 where it is NULL or NaN."""
    return (x.isNotNull() & ~F.isnan(F.coalesce(x.cast("double"), F.lit(0.0)))).cast("int")


def either(x: Column, y: Column) -> Column:
    """The larger of two flags, or the one that is there."""
    return F.greatest(x, y)


def keep_one(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a total order."""
    order = [(F.col(o) if isinstance(o, str) else o) for o in order]
    w = Window.partitionBy(*keys).orderBy(*([o.desc() for o in order] if last else order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_first_step(df: DataFrame, file: str, time: str) -> DataFrame:
    """Without the first time of every file after the first file."""
    w = Window.partitionBy(file)
    first = F.min(time).over(w)
    least = df.agg(F.min(file).alias("_first_file"))
    return df.withColumn("_t", first).join(F.broadcast(least)).where((F.col(file) == F.col("_first_file")) | (F.col(time) > F.col("_t"))).drop("_t", "_first_file")  # one row


def daily_max(df: DataFrame, cell: str, ts: str, values: list[str]) -> DataFrame:
    return df.groupBy(cell, F.to_date(ts).alias("d")).agg(*(F.max(v).alias(v) for v in values))


def time_gaps(df: DataFrame, ts: str) -> DataFrame:
    """(gap_hours, n): distinct distances of neighbouring distinct times.

    Windows order the times of one month; a month's first time follows the last
    one of the month before it that has any, from a table of a row a month.
    """
    t = df.select(F.unix_timestamp(F.col(ts).cast("timestamp")).alias("t"), F.trunc(F.col(ts), "MM").alias("m")).distinct()
    ends = t.groupBy("m").agg(F.max("t").alias("last"))
    ends = ends.select("m", F.lag("last").over(Window.orderBy("m")).alias("before"))
    own = F.lag("t").over(Window.partitionBy("m").orderBy("t"))
    gap = (F.col("t") - F.coalesce("own", "before")) / 3600
    d = t.withColumn("own", own).join(ends, "m").select(gap.alias("gap_hours"))
    return d.where("gap_hours is not null").groupBy("gap_hours").agg(F.count(F.lit(1)).alias("n"))


def shifted(value: str, k: int, cell: str = "cell_id", time: str = "d") -> Column:
    """``value`` k rows of the cell earlier (later if k < 0), 0 beyond its ends."""
    w = Window.partitionBy(cell).orderBy(time)
    return F.lag(value, k, 0).over(w) if k >= 0 else F.lead(value, -k, 0).over(w)


def dense(df: DataFrame, start, end, values: list[str], cell: str = "cell_id", time: str = "d") -> DataFrame:
    """A row for every cell and day from start to end, 0 where there was none, with ``t`` from 0."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(time)
    grid = df.select(cell).distinct().select(cell, days)
    full = grid.join(df.where(F.col(time).between(F.lit(start), F.lit(end))), [cell, time], "left")
    return full.select(cell, time, F.datediff(F.col(time), F.lit(start)).alias("t"), *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def runs(df: DataFrame, index: str, by: list[str]) -> DataFrame:
    """(by, first, last, n): stretches of consecutive whole numbers."""
    w = Window.partitionBy(*by).orderBy(index)
    d = df.withColumn("_g", F.col(index) - F.row_number().over(w))
    return d.groupBy(*by, "_g").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def interpolated(df: DataFrame, ts: str, value: str, hours: int, cell: str = "cell_id") -> DataFrame:
    """Linear interpolation of each cell's series to a grid of ``hours`` between its ends."""
    w = Window.partitionBy(cell).orderBy(ts)
    seconds = F.unix_timestamp(ts)
    seg = df.select(cell, seconds.alias("t0"), F.col(value).cast("double").alias("v0"), F.lead(seconds).over(w).alias("t1"), F.lead(F.col(value).cast("double")).over(w).alias("v1"))
    step = hours * 3600
    first = F.ceil(F.col("t0") / step) * step
    last = F.when(F.col("t1").isNull(), F.col("t0")).otherwise(F.col("t1") - 1)
    ticks = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    part = F.when(F.col("t1").isNull(), F.lit(0.0)).otherwise((F.col("g") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    grid = seg.withColumn("g", F.explode(ticks))
    return grid.select(cell, F.timestamp_seconds("g").alias(ts), (F.col("v0") + part * F.coalesce(F.col("v1") - F.col("v0"), F.lit(0.0))).alias(value))


def box_smoothed(df: DataFrame, value: str, size: int, edge: str = "nearest", row: str = "i", column: str = "j") -> DataFrame:
    """Moving average over size x size neighbours of a full grid; ``edge`` nearest or constant (NULL).

    Two passes of sums, along columns and along rows, make 2 x size copies and
    not size x size; windows would hold a whole line of the grid in order.
    """
    h = size // 2

    def summed(d: DataFrame, axis: str, other: str, ends: DataFrame) -> DataFrame:
        """(axis, other, _s, _n): sums and counts over ``size`` neighbours along ``axis``."""
        d = d.withColumn("_o", F.explode(F.sequence(F.lit(-h), F.lit(h)))).withColumn("_at", F.col(axis) + F.col("_o"))
        if edge == "nearest":  # the cells at an end stand in for those beyond it, so each of them counts once more for every target there
            last = F.col("_m")
            d = d.join(F.broadcast(ends.select(F.max(axis).alias("_m"))))  # one row
            copies = lambda at_end, gap: F.when(at_end, F.greatest(F.lit(0), gap)).otherwise(0)
            more = copies(F.col(axis) == 0, h - F.col("_at")) + copies(F.col(axis) == last, h - (last - F.col("_at")))
            inside = d.where((F.col("_at") >= 0) & (F.col("_at") <= last)).withColumn("_w", 1 + more)
        else:
            inside = d.withColumn("_w", F.lit(1))
        return inside.groupBy(F.col("_at").alias(axis), other).agg(F.sum(F.col("_s") * F.col("_w")).alias("_s"), F.sum(F.col("_n") * F.col("_w")).alias("_n"))

    start = df.select(row, column, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_s"), F.col(value).isNotNull().cast("long").alias("_n"))
    both = summed(summed(start, row, column, df), column, row, df)
    enough = F.col("_n") == size * size if edge != "nearest" else F.col("_n") > 0
    return df.select(row, column).join(both, [row, column], "left").select(row, column, F.when(enough, F.col("_s") / F.col("_n")).alias(value))


def stored(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder: what several jobs read, or what must not be dealt out again."""
    path = files.work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``df`` with the place, from 0, of each row in the order of its group; stored.

    The rows of all groups are sorted by ranges of (group, order), so a group of any size
    lies over as many tasks as it fills.  A task numbers its rows as they come; only the
    group that goes on from the task before needs to know how many rows it had there,
    a row a task.  Rows alike in group and order are numbered as they come.
    """
    import numpy as np
    import pyarrow as pa

    keys = [*group, *order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, at, first = TaskContext.get().partitionId(), None, 0, True
        for b in batches:
            n = len(b)
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in group:
                code = b.column(b.schema.get_field_index(g)).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            value = lambda i: tuple(b.column(b.schema.get_field_index(g))[i].as_py() for g in group)  # noqa: B023, E731
            new[0] = value(0) != last
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # where the row's group begins in this batch
            place = np.arange(n) - head + np.where(head < 0, at - 1, 0)
            opening = first & (np.cumsum(new) <= 1 if last is None else ~np.maximum.accumulate(new))  # still the task's first group
            first = bool(opening[-1])
            last, at = value(n - 1), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(np.full(n, part)), pa.array(opening)], [*b.schema.names, name, "_part", "_opening"])

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in (name, "_part")), T.StructField("_opening", T.BooleanType())])
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    ends = rows.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.max("_opening").alias("_first"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a group has a row a task
    carry = ends.withColumn("_before", F.sum("_n").over(before)).where("_first and _before is not null").select("_part", "_before")
    out = rows.join(F.broadcast(stored(carry)), "_part", "left")  # a row a task at most
    return out.select(*df.columns, (F.col(name) + F.when(F.col("_opening"), F.coalesce("_before", F.lit(0))).otherwise(0)).alias(name))


def row_sample(df: DataFrame, key: str, per: int = 10, most: int = 5_000_000, seed: int = 42) -> DataFrame:
    """One row in ``per`` and ``most`` at most, exactly so many, without replacement: the first in the order of an md5 of ``key``.

    Counts by the md5's leading digits tell where the order is cut, so only rows
    that agree in the first six digits with the cut are ordered in one task.
    """
    d = df.withColumn("_h", draws.key(seed, F.col(key)))
    rest = min(d.count() // per, most)
    taken, edge = [], ""
    for at in (1, 4):
        own = d.where(F.col("_h").startswith(edge)) if edge else d
        sizes = sorted(tuple(r) for r in own.groupBy(F.substring("_h", at, 3).alias("b")).agg(F.count(F.lit(1))).collect())  # 4,096 at most
        cut, before = None, 0
        for b, n in sizes:
            if before + n > rest:
                cut = b
                break
            before += n
        taken.append(own if cut is None else own.where(F.substring("_h", at, 3) < cut))
        if cut is None:
            return _together(taken).drop("_h")
        rest, edge = rest - before, edge + cut
    w = Window.partitionBy(F.substring("_h", 1, 6)).orderBy("_h", key)
    last = d.where(F.col("_h").startswith(edge)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rest).drop("_n")
    return _together([*taken, last]).drop("_h")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
