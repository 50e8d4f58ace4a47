"""Percentile thresholds by cell and calendar window, and flags against them."""

from __future__ import annotations

import bisect
import math
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .panel import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package


def window_days(doy: Column, half: int, ring: int) -> Column:
    """Days of the year whose window of +-half days on a ring holds ``doy``."""
    return F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: F.pmod(doy - 1 + o, F.lit(ring)) + 1)


def doy_thresholds(df: DataFrame, value: str, q: float, half: int, ring: int = 366, wet: bool = False, keys: list[str] = ["cell_id"], places: int = 6) -> DataFrame:  # noqa: B006
    """(keys, doy, thr): the q-quantile of values within +-half calendar days.

    ``wet`` takes only positive values and gives 0 where there are none.  No row is
    copied to its windows: the values of a key and calendar day are one run, and a
    window puts its 2 half + 1 runs together; a run is as long as the years that the
    key has.  Without ``keys`` a run may be of any size, and windows are counted from
    runs (``run_quantiles``).
    """
    run = F.pmod(F.dayofyear("d") - 1, F.lit(ring)) + 1
    if not keys and not wet:
        days = df.sparkSession.range(1, ring + 1).select(F.col("id").cast("int").alias("doy"))
        members = days.select("doy", F.explode(window_days(F.col("doy"), half, ring)).alias("run"))
        return run_quantiles(df.select(run.alias("run"), value), value, q, ["run"], members, ["doy"], places)
    x = F.when(F.col("_v") > 0, F.col("_v")) if wet else F.col("_v")
    d = df.select(*keys, run.alias("doy"), F.col(value).alias("_v")).repartition(*keys)  # the one exchange of rows
    runs = d.groupBy(*keys, "doy").agg(F.collect_list(x).alias("_run"), F.count(F.lit(1)).alias("_n")).withColumn("_own", F.lit(False))
    # the calendar's ends meet: the first and last runs stand beyond the other end too
    beyond = runs.where((F.col("doy") <= half) | (F.col("doy") > ring - half)).withColumn("doy", F.col("doy") + F.when(F.col("doy") <= half, ring).otherwise(-ring))
    wanted = d.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(ring))).alias("doy"), F.array().cast(runs.schema["_run"].dataType).alias("_run"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_own"))
    w = Window.partitionBy(*keys).orderBy("doy").rangeBetween(-half, half)
    near = runs.unionByName(beyond).unionByName(wanted).select(*keys, "doy", "_own", F.collect_list("_run").over(w).alias("_runs"), F.sum("_n").over(w).alias("_n")).where("_own and _n > 0")
    # an expression of its own row, so that it is sorted once
    z = near.select(*keys, "doy", F.sort_array(F.flatten("_runs")).alias("_z"))
    at = F.lit(float(q)) * (F.size("_z") - 1)
    low, high = (F.get(F.col("_z"), f(at).cast("int")).cast("double") for f in (F.floor, F.ceil))
    thr = F.round(low + (at - F.floor(at)) * (high - low), places)
    return z.select(*keys, "doy", (F.coalesce(thr, F.lit(0.0)) if wet else thr).alias("thr"))


def flagged(df: DataFrame, thresholds: DataFrame, value: str, strict: bool = True, keys: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """``df`` with ``thr``, ``ep`` (over it; if not strict: at least it, and positive) and ``amount`` where flagged."""
    d = df.withColumn("doy", F.dayofyear("d")).join(thresholds, [*keys, "doy"])
    v = F.col(value)
    hit = v > F.col("thr") if strict else (v >= F.col("thr")) & (v > 0)
    return d.withColumn("ep", hit.cast("int")).withColumn("amount", F.when(hit, v))


#: Values of a group that one task may hold, items of a sketch, how far from the rank its pivots lie as a share, and equal shares at which a sketch is asked.
_HELD, _ITEMS, _MARGIN, _GRID = 100_000, 400, 0.015, 256


def exact_quantile(df: DataFrame, value: str, q: float, by: list[str] = [], places: int | None = None, name: str = "thr") -> DataFrame:  # noqa: B006
    """(by, name): the exact q-quantile of all values of a group, between its two neighbours by linear interpolation.

    For few groups (none, or the days of a year) of any size; see ``run_quantiles``.
    """
    own = by or ["_all"]
    d = df.select(*by, F.col(value).cast("double").alias("_v")) if by else df.select(F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v"))
    return run_quantiles(d, "_v", q, own, None, own, places, name).select(*by, name)


def run_quantiles(df: DataFrame, value: str, q: float, run: list[str], members: DataFrame | None, group: list[str], places: int | None = None, name: str = "thr") -> DataFrame:
    """(group, name): the exact q-quantile of each group's values; a group is made of runs, and runs may be shared.

    ``members(group, run)`` says which (None: each run is a group); groups and runs are
    few, their values any number.  A selection by ranks: mergeable sketches of the runs give each group two
    pivots close about its rank, one pass counts every row once by its place among the
    pivots of its run, and what lies in the part that holds the rank of some group is
    stored and sketched for the next pass.  A pass leaves some hundredth of a group
    whatever its values are, and the next one reads no more; equal values are a pivot's
    own count.  Once what is left of a group fits one task, it is sorted there.  Only
    pivots and counts, a few a group and run, reach the driver.
    Runs and values are stored first, so ``df`` is made once and passes only scan.
    """
    spark = df.sparkSession
    d = stored(df.select(*run, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    sketch = F.expr(f"kll_sketch_agg_double(_v, {_ITEMS})").alias("_s")
    first = stored(d.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"), sketch).withColumn("_p", F.lit(0)))
    n_run = {tuple(r[k] for k in run): r._n for r in first.select(*run, "_n").collect()}
    runs_of: dict[tuple, list[tuple]] = {}
    for g, r in [(r, r) for r in n_run] if members is None else [(tuple(m[c] for c in group), tuple(m[c] for c in run)) for m in members.collect()]:
        if r in n_run:
            runs_of.setdefault(g, []).append(r)
    run_type = [T.StructField(f"_run{i}", d.schema[k].dataType) for i, k in enumerate(run)]
    group_type = [d.schema[k] for k in run] if members is None else [members.schema[k] for k in group]
    at_run = [d[k].eqNullSafe(F.col(f"_run{i}")) for i, k in enumerate(run)]
    table = lambda rows, fields: spark.createDataFrame(rows, T.StructType([*fields]))

    def pivots(sketches: DataFrame, chosen: list[tuple], at: dict[tuple, tuple[float, float]]) -> dict[tuple, tuple[float, float]]:
        """Values at two ranks (shares) of each group's merged sketches; ``chosen`` are (group, run, part)."""
        parts = table([(*g, *r, p) for g, r, p in chosen], [*group_type, *run_type, T.StructField("_p", T.IntegerType())])
        same = [sketches[k].eqNullSafe(parts[f"_run{i}"]) for i, k in enumerate(run)] + [sketches["_p"] == parts["_p"]]
        merged = parts.join(sketches.select(*run, "_p", "_s"), same).groupBy(*(parts[c] for c in group)).agg(F.expr(f"kll_merge_agg_double(_s, {_ITEMS})").alias("_s"))
        grid = ", ".join(f"{i / _GRID}D" for i in range(_GRID + 1))
        got = merged.select(*group, F.expr(f"kll_sketch_get_quantile_double(_s, array({grid}))").alias("_g")).collect()
        pick = lambda values, low, high: (values[math.floor(low * _GRID)], values[math.ceil(high * _GRID)])
        return {g: pick(r._g, *at[g]) for r in got for g in [tuple(r[c] for c in group)]}

    state, found = {}, []
    for g, rs in runs_of.items():
        n = sum(n_run[r] for r in rs)
        at = q * (n - 1)
        state[g] = {"n": n, "at": at, "k": math.floor(at), "low": -math.inf, "high": math.inf, "below": 0, "upto": n}
    sketches, parts, under = first, {g: [(r, 0) for r in rs] for g, rs in runs_of.items()}, {}
    while wide := {g: s for g, s in state.items() if s["upto"] - s["below"] > _HELD}:
        share = lambda s, side: min(1.0, max(0.0, (s["k"] - s["below"]) / (s["upto"] - s["below"]) + side * _MARGIN))
        cut = pivots(sketches, [(g, r, p) for g in wide for r, p in parts[g]], {g: (share(s, -1), share(s, 1)) for g, s in wide.items()})
        marks: dict[tuple, set] = {}
        for g, s in state.items():
            for r in runs_of[g]:
                marks.setdefault(r, set()).update(x for x in (s["low"], s["high"], *cut.get(g, ())) if math.isfinite(x))
        ordered = {r: sorted(m) for r, m in marks.items()}
        asked = table([(*r, i) for i, r in enumerate(ordered)], [*run_type, T.StructField("_at", T.IntegerType())])
        counts: dict[tuple, list] = {}
        for r in _part_counts(d.join(F.broadcast(asked), at_run).select("_v", "_at"), list(ordered.values())).groupBy("_at", "_p").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least")).collect():
            counts.setdefault(list(ordered)[r._at], []).append((r._p, r._n, r._least))
        for r, n in under.items():
            counts.setdefault(r, []).append((0, n, -math.inf))  # values that an earlier pass left behind, all under the marks
        for g, s in wide.items():
            own = [(ordered[r], counts.get(r, [])) for r in runs_of[g]]
            if (value := _narrow(s, cut[g], own)) is not None:
                found.append((*g, value))
                del state[g]
        if not state:
            break
        # what no group asks for any more is left behind, and counted where it lies under what is left
        spans: dict[tuple, tuple[float, float]] = {}
        for g, s in state.items():
            for r in runs_of[g]:
                low, high = spans.get(r, (math.inf, -math.inf))
                spans[r] = min(low, s["low"]), max(high, s["high"])
        kept = table([(*r, *(x if math.isfinite(x) else None for x in ends)) for r, ends in spans.items()], [*run_type, *(T.StructField(c, T.DoubleType()) for c in ("_low", "_high"))])
        inside = F.coalesce(F.col("_v") > F.col("_low"), F.lit(True)) & F.coalesce(F.col("_v") < F.col("_high"), F.lit(True))
        d = stored(d.join(F.broadcast(kept), at_run).where(inside).select(*run, "_v"))
        at_run = [d[k].eqNullSafe(F.col(f"_run{i}")) for i, k in enumerate(run)]
        for r, (low, _) in spans.items():
            if r in ordered and math.isfinite(low):
                i = 2 * bisect.bisect_left(ordered[r], low) + 1
                under[r] = sum(n for p, n, _ in counts.get(r, []) if p <= i)
        parts = {g: [(r, p) for r in runs_of[g] for p, _, _ in counts.get(r, []) if _inside(ordered[r], p, s)] for g, s in state.items() if g in wide}
        if any(s["upto"] - s["below"] > _HELD for s in state.values()):
            placed = _parted(d.join(F.broadcast(asked), at_run).select(*run, "_v", "_at"), list(ordered.values()))
            sketches = stored(placed.groupBy(*run, "_p").agg(sketch))
    ends = table([(*g, *r, s["low"], s["high"], s["k"] - s["below"], s["at"] - s["k"]) for g, s in state.items() for r in runs_of[g]], [*group_type, *run_type, *(T.StructField(c, T.DoubleType()) for c in ("_low", "_high")), T.StructField("_k", T.LongType()), T.StructField("_part", T.DoubleType())])
    left = d.join(F.broadcast(ends), at_run).select(*(ends[c] for c in group), "_v", "_low", "_high", "_k", "_part").where("_v > _low and _v < _high").groupBy(*group, "_high", "_k", "_part").agg(F.sort_array(F.collect_list("_v")).alias("_z"))  # at most _HELD values a group
    z = F.col("_z")
    a = F.get(z, F.col("_k").cast("int"))
    b = F.coalesce(F.get(z, F.col("_k").cast("int") + 1), F.when(F.col("_part") > 0, F.col("_high")), a)  # the mark above is the group's next value
    thr = a + F.col("_part") * (b - a)
    known = table(found, [*group_type, T.StructField("_t", T.DoubleType())])
    out = left.select(*group, thr.alias("_t")).unionByName(known)
    return out.select(*group, (F.col("_t") if places is None else F.round("_t", places)).alias(name))


def _placing(marks: list[list[float]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of values and of ``at`` that gives each value's part among the sorted marks number ``at``: part 2 i lies between two marks, part 2 i - 1 is equal to one."""
    import numpy as np

    every = np.unique(np.concatenate([np.zeros(0), *map(np.asarray, marks)]))
    starts = np.cumsum([0, *map(len, marks)])
    # a mark is its list's number and its rank among all marks, so one search finds the places of values of any list
    own = np.repeat(np.arange(len(marks)), np.diff(starts)) * (len(every) + 1) + np.searchsorted(every, np.concatenate([np.zeros(0), *map(np.asarray, marks)]))

    def places(v: np.ndarray, at: np.ndarray) -> np.ndarray:
        first = at.astype(np.int64) * (len(every) + 1)
        under, upto = (np.searchsorted(own, first + np.searchsorted(every, v, side)) for side in ("left", "right"))
        return (under + upto - 2 * starts[at]).astype(np.int32)

    return places


def _parted(df: DataFrame, marks: list[list[float]]) -> DataFrame:
    """``df(.., _v, _at)`` with ``_p``, the part of each value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        places = _placing(marks)
        for b in batches:
            part = places(b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(part)], [*b.schema.names[:-1], "_p"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("_p", T.IntegerType())]))


def _part_counts(df: DataFrame, marks: list[list[float]]) -> DataFrame:
    """(_at, _p, _n, _least): how many values of ``df(_v, _at)`` each part has and the least of them, a row a part and task."""
    width = 2 * max(map(len, marks), default=0) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        places = _placing(marks)
        counts, least = np.zeros(len(marks) * width, np.int64), np.full(len(marks) * width, np.inf)
        for b in batches:
            v, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            place = at.astype(np.int64) * width + places(v, at)
            counts += np.bincount(place, minlength=len(counts))
            np.minimum.at(least, place, v)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((some // width).astype(np.int32)), pa.array((some % width).astype(np.int32)), pa.array(counts[some]), pa.array(least[some])], ["_at", "_p", "_n", "_least"])

    return df.mapInArrow(run, "_at int, _p int, _n long, _least double")


def _narrow(s: dict, cut: tuple[float, float], runs: list[tuple[list, list]]) -> float | None:
    """Moves a group's open interval to the part that holds its rank; its quantile, if the rank falls on a mark.

    ``runs`` are (marks, [(part, values, least value)]) of each run of the group.
    """
    for x in cut:
        at = [(2 * bisect.bisect_left(marks, x), parts) for marks, parts in runs]  # parts up to this one lie under x, the next is x itself
        under = sum(n for i, parts in at for p, n, _ in parts if p <= i)
        upto = sum(n for i, parts in at for p, n, _ in parts if p <= i + 1)
        if s["k"] < under:
            s["high"], s["upto"] = x, under
            return None
        if s["k"] < upto:
            after = x
            if s["at"] > s["k"] and s["k"] + 1 >= upto:  # the next rank is the least value above the mark
                after = min((least for i, parts in at for p, _, least in parts if p > i + 1), default=s["high"])
                after = min(after, s["high"])  # values from there on may have been left behind
            return x + (s["at"] - s["k"]) * (after - x)
        s["low"], s["below"] = x, upto
    return None


def _inside(marks: list[float], part: int, s: dict) -> bool:
    """Whether a part of a run lies in a group's open interval."""
    if part % 2:
        return s["low"] < marks[part // 2] < s["high"]
    i = part // 2
    return (marks[i - 1] if i else -math.inf) >= s["low"] and (marks[i] if i < len(marks) else math.inf) <= s["high"]


def global_threshold(df: DataFrame, value: str, q: float, places: int = 6) -> DataFrame:
    """(thr): the q-quantile of all positive values; NULL where there are none."""
    one = exact_quantile(df.where(F.col(value) > 0), value, q, places=places)
    return one.agg(F.max("thr").alias("thr"))
