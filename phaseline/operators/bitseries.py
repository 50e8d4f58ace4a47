"""Flags of a cell over the time axis as packed bits: lags, event averages, hits and placebos without copies of rows.

``packed`` turns a panel into one row a cell: words of 64 times for each flag, made
from the rows where it is set, so absent times cost nothing.  The operators unpack a
few cells at a time inside a task and work on whole axes: a lag is a slice, a
shuffle an index, a joint count a sum.  What they need besides is of the time axis
only (strata, permutations), never of the cells.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Values of an unpacked flag that a task holds at once; the operators make some tens of bytes of each, few beside a worker's own imports.
HELD = 1 << 18


def packed(df: DataFrame, flags: list[str], t: str = "t", key: str = "cell_id") -> DataFrame:
    """(key, words): for every key of ``df`` its words, each (word, bits of every flag); bit i of a word is the time 64 word + i, negative times are left out."""
    word, bit = F.expr(f"{t} div 64").cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(t) % 64).cast("int"))
    d = df.select(key, *(F.when(F.col(f) == 1, bit).otherwise(0).cast("long").alias(f) for f in flags), F.when(F.col(t) >= 0, word).alias("word"))
    words = d.groupBy(key, "word").agg(*(F.bit_or(f).alias(f) for f in flags))  # rows that lie by the key already need no exchange
    return words.groupBy(key).agg(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", *flags))).alias("words"))


def unpacked(words, flags: list[str], times: int) -> dict[str, np.ndarray]:
    """Flag -> (cells, times) of truth values, from a list array of words."""
    flat, sizes = words.flatten(), np.diff(words.offsets.to_numpy())
    cell, at = np.repeat(np.arange(len(words)), sizes), flat.field("word").to_numpy()
    width = -(-times // 64)
    inside = at < width
    out = {}
    for f in flags:
        w = np.zeros((len(words), width), np.int64)
        w[cell[inside], at[inside]] = flat.field(f).to_numpy()[inside]
        out[f] = np.unpackbits(w.view(np.uint8), axis=1, bitorder="little")[:, :times].astype(bool)
    return out


def over_cells(series: DataFrame, flags: list[str], times: int, make: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, dict]], schema: str, key: str = "cell_id") -> DataFrame:
    """(key, ..): ``make`` gets the flags of some cells and gives the cell's place of each row, and the other columns."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // max(1, times))
        for b in batches:
            for i in range(0, len(b), step):
                part = b.slice(i, step)
                words = part.column(1)
                own, columns = make(unpacked(words.take(pa.array(range(len(words)))), flags, times))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), *map(pa.array, columns.values())], [key, *columns])

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, "words").mapInArrow(run, f"{key} {kind}, {schema}")


# --------------------------------------------------------------------------
# lags


def _overlap(k: int, n: int) -> tuple[slice, slice]:
    """Where x[t + k] and y[t] both are times."""
    return slice(max(0, k), n + min(0, k)), slice(max(0, -k), n - max(0, k))


def cross_correlation(series: DataFrame, lags: int, times: int, x: str = "ar", y: str = "ep", key: str = "cell_id") -> DataFrame:
    """(key, lag, r, varies): r(k) = sum over t of (x[t+k] - mx)(y[t] - my) / (n sx sy), the divisor n at every lag.

    Positive lag: x follows y.  A constant series has r = 0, and does not vary.  Times without a row count as 0.
    """

    def make(flags):
        a, b, n = flags[x], flags[y], times
        ma, mb = (v.sum(axis=1) / n for v in (a, b))
        scale = n * np.sqrt(ma * (1 - ma)) * np.sqrt(mb * (1 - mb))
        out = np.zeros((len(a), 2 * lags + 1))
        for k in range(-lags, lags + 1):
            if abs(k) < n:
                i, j = _overlap(k, n)
                p, q = a[:, i], b[:, j]
                out[:, k + lags] = (p & q).sum(axis=1) - mb * p.sum(axis=1) - ma * q.sum(axis=1) + (n - abs(k)) * ma * mb
        r = np.divide(out, scale[:, None], out=np.zeros_like(out), where=scale[:, None] != 0)
        return np.repeat(np.arange(len(a)), 2 * lags + 1), {"lag": np.tile(np.arange(-lags, lags + 1, dtype=np.int32), len(a)), "r": r.reshape(-1), "varies": np.repeat(scale != 0, 2 * lags + 1)}

    return over_cells(series, [x, y], times, make, "lag int, r double, varies boolean", key)


def event_average(series: DataFrame, lags: int, times: int, key: str = "cell_id") -> DataFrame:
    """(key, tau, eta, baseline): mean of ar at t - tau over events t, where t - tau is a time; no row where no event has one."""

    def make(flags):
        a, e = flags["ar"], flags["ep"]
        taus = np.arange(-lags, lags + 1)
        hits, events = (np.zeros((len(a), len(taus)), np.int64) for _ in range(2))
        for c, k in enumerate(taus.tolist()):
            if abs(k) < times:
                i, j = _overlap(-k, times)
                hits[:, c], events[:, c] = (a[:, i] & e[:, j]).sum(axis=1), e[:, j].sum(axis=1)
        own, c = np.nonzero(events)
        return own, {"tau": taus[c].astype(np.int32), "eta": hits[own, c] / events[own, c], "baseline": a.mean(axis=1)[own]}

    return over_cells(series, ["ar", "ep"], times, make, "tau int, eta double, baseline double", key)


def hit_share(series: DataFrame, lags: int, times: int, key: str = "cell_id") -> DataFrame:
    """(key, lag, share): share of events with an exposure within +-lag times; exposures are widened by a time on each side per lag."""

    def make(flags):
        near, e = flags["ar"].copy(), flags["ep"]
        events = e.sum(axis=1)
        hits = np.zeros((len(e), lags + 1), np.int64)
        for k in range(lags + 1):
            if k:
                wider = near.copy()
                wider[:, 1:] |= near[:, :-1]
                wider[:, :-1] |= near[:, 1:]
                near = wider
            hits[:, k] = (near & e).sum(axis=1)
        own = np.flatnonzero(events)
        return np.repeat(own, lags + 1), {"lag": np.tile(np.arange(lags + 1, dtype=np.int32), len(own)), "share": (hits[own] / events[own, None]).reshape(-1)}

    return over_cells(series, ["ar", "ep"], times, make, "lag int, share double", key)


# --------------------------------------------------------------------------
# placebos


def placebo_counts(series: DataFrame, sources: dict[int, np.ndarray], strata: np.ndarray, key: str = "cell_id", name: str = "k") -> DataFrame:
    """(key, name, n10, n01): discordant counts of each design of ``sources``, matched within strata against every control.

    A design names, for each time, the time whose exposure it takes (-1: none).  ``strata``
    is each time's stratum.  Rows count where the flag ``there`` is set.
    """
    times, order = len(strata), np.argsort(strata, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(strata[order]) != 0])) if times else np.zeros(0, np.int64)
    designs = {k: np.where(s < 0, times, s)[order] for k, s in sources.items()}  # one more time, without exposure

    def make(flags):
        per = lambda v: np.add.reduceat(v, heads, axis=1, dtype=np.int64)
        e, there = flags["ep"][:, order], flags["there"][:, order]
        exposed = np.concatenate([flags["ar"], np.zeros((len(e), 1), bool)], axis=1)
        cases, rows = per(e), per(there)
        n10, n01 = [], []
        for s in designs.values():
            x = exposed[:, s] & there
            c1, x1 = per(x & e), per(x)
            c0, k1 = cases - c1, x1 - c1
            n10.append((c1 * (rows - cases - k1)).sum(axis=1)), n01.append((c0 * k1).sum(axis=1))
        ks = np.array(list(designs), np.int32)
        return np.repeat(np.arange(len(e)), len(ks)), {name: np.tile(ks, len(e)), "n10": np.stack(n10, axis=1).reshape(-1), "n01": np.stack(n01, axis=1).reshape(-1)}

    return over_cells(series, ["ar", "ep", "there"], times, make, f"{name} int, n10 long, n01 long", key)
