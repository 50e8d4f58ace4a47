"""Lag diagnostics of two series of each cell: cross-correlation, event averages, Monte-Carlo p.

``t`` numbers the times of a dense panel from 0, so lags are equality joins.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import hypergeometric_cdf

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package


def cross_correlation(df: DataFrame, lags: int, keys: list[str] = ["cell_id"], x: str = "ar", y: str = "ep") -> DataFrame:  # noqa: B006
    """(keys, lag, r): r(k) = sum over t of (x[t+k] - mx)(y[t] - my) / (n sx sy), the divisor n at every lag.

    Positive lag: x follows y.  A constant series has r = 0.  Only rows with x or
    y are joined; sums over the overlap come from prefix counts at the ends.
    """
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    k = F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag")
    ys = df.where(F.col(y) != 0).select(*keys, F.col("t"), F.col(y).alias("_y"), k).withColumn("t", F.col("t") + F.col("lag"))
    xs = df.where(F.col(x) != 0).select(*keys, "t", F.col(x).alias("_x"))
    xy = ys.join(xs, [*keys, "t"]).groupBy(*keys, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("xy"))
    # sums of x over [max(0,k), n-1+min(0,k)] and of y over [max(0,-k), n-1-max(0,k)]
    size = s.select(*keys, "n")
    ends = df.join(size, keys).where((F.col("t") < lags) | (F.col("t") >= F.col("n") - lags)).select(*keys, "n", "t", F.col(x).alias("_x"), F.col(y).alias("_y"), k)
    cut = lambda v, kk: F.sum(F.when(((kk > 0) & (F.col("t") < kk)) | ((kk < 0) & (F.col("t") >= F.col("n") + kk)), F.col(v)).otherwise(0))
    lost = ends.groupBy(*keys, "lag").agg(cut("_x", F.col("lag")).alias("lx"), cut("_y", -F.col("lag")).alias("ly"))
    d = s.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).join(lost, [*keys, "lag"], "left").join(xy, [*keys, "lag"], "left")
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    sx, sy = n * mx - F.coalesce("lx", F.lit(0)), n * my - F.coalesce("ly", F.lit(0))
    cov = F.coalesce("xy", F.lit(0)) - my * sx - mx * sy + (n - F.abs("lag")) * mx * my
    scale = F.col("sx") * F.col("sy") * n
    return d.select(*keys, "lag", F.when(scale == 0, F.lit(0.0)).otherwise(cov / F.when(scale != 0, scale)).alias("r"))


def strongest(r: DataFrame, keys: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """The lag of the largest absolute correlation, the smallest lag on a tie (to 1e-9)."""
    w = Window.partitionBy(*keys).orderBy(F.round(F.abs("r"), 9).desc(), "lag")
    return r.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def directionality(r: DataFrame, keys: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """(keys, lag, s): (r(L) - r(-L)) / max(|r(L)|, |r(-L)|, 1e-12) for L > 0."""
    plus = r.where("lag > 0").select(*keys, "lag", F.col("r").alias("p"))
    minus = r.where("lag < 0").select(*keys, (-F.col("lag")).alias("lag"), F.col("r").alias("m"))
    return plus.join(minus, [*keys, "lag"]).select(*keys, "lag", ((F.col("p") - F.col("m")) / F.greatest(F.abs("p"), F.abs("m"), F.lit(1e-12))).alias("s"))


def event_average(df: DataFrame, lags: int, keys: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """(keys, tau, eta, baseline): mean of ar at t - tau over events t, where t - tau is a time."""
    base = df.groupBy(*keys).agg(F.avg("ar").alias("baseline"))
    e = df.where("ep = 1").select(*keys, F.col("t"), F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("tau")).withColumn("t", F.col("t") - F.col("tau"))
    return e.join(df.select(*keys, "t", "ar"), [*keys, "t"]).groupBy(*keys, "tau").agg(F.avg("ar").alias("eta")).join(base, keys)


def hit_share(df: DataFrame, lags: int, keys: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """(keys, lag, share): share of events with an exposure within +-lag times; distances are found once."""
    back = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("ar") == 1, F.col("t"))
    d = df.withColumn("_d", F.least(F.col("t") - F.last(at, True).over(back), F.first(at, True).over(ahead) - F.col("t"))).where("ep = 1")
    d = d.select(*keys, "_d", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"))
    return d.groupBy(*keys, "lag").agg(F.avg(F.when(F.col("_d") <= F.col("lag"), 1.0).otherwise(0.0)).alias("share"))


#: Draws that one md5 gives, and md5s of a month made at once.
_EACH, _AT_ONCE = 4, 16


def _joint_counts(heads: list[bytes], lows: np.ndarray, cdfs: list[np.ndarray], groups: range) -> np.ndarray:
    """Summed joint counts of a cell's months, a number a draw; the four numbers of a month's ``g``-th md5 are four draws."""
    md5 = b"".join(hashlib.md5(b"%s|%d" % (h, g)).digest() for h in heads for g in groups)
    u = (np.frombuffer(md5, ">u4") / float(1 << 32)).reshape(len(heads), _EACH * len(groups))
    sizes = np.array([len(c) for c in cdfs], np.int64)
    width = int(sizes.max(initial=0))
    padded = np.full((len(heads), width), np.inf)
    padded[np.arange(width) < sizes[:, None]] = np.concatenate([*cdfs, np.zeros(0)])
    passed = np.zeros(u.shape, np.int64)
    for k in range(width):
        passed += padded[:, k, None] <= u
    return (lows[:, None] + np.minimum(passed, sizes[:, None] - 1)).sum(axis=0)


def _judged(real: int, months: tuple, iterations: int, least: int, absolute: float, relative: float) -> tuple[int, int, bool]:
    """(hits, draws, stopped) of one cell: the rule is judged after every draw, and nothing is drawn after the lot in which it stops."""
    hits = n = 0
    for first in range(0, -(-iterations // _EACH), _AT_ONCE):
        stats = _joint_counts(*months, range(first, min(first + _AT_ONCE, -(-iterations // _EACH))))[: iterations - n]
        h, made = hits + np.cumsum(stats >= real), n + 1 + np.arange(len(stats))
        p = (h + 1) / (made + 1)
        half = 1.96 * np.sqrt(p * (1 - p) / (made + 1))
        stop = np.flatnonzero((made >= least) & ((half <= absolute) | (half / p <= relative)))
        if len(stop):
            return int(h[stop[0]]), int(made[stop[0]]), True
        hits, n = int(h[-1]), int(made[-1])
    return hits, n, False


def monte_carlo(df: DataFrame, iterations: int = 500, seed: int = 42, days: Column | None = None, least: int = 10, absolute: float = 0.01, relative: float = 0.1, keys: list[str] = ["cell_id"]) -> DataFrame:  # noqa: B006
    """(keys, p, n, converged): sequential permutation test of the joint count sum(ar ep).

    Exposure is shuffled within the year-months of each cell.  The joint count of
    a month of n days with x exposures and y outcomes is then hypergeometric, so
    it is drawn from the counts, and no day is moved.  Months without an outcome or
    without an exposure add nothing.  A cell is one row with an array of its
    months: draws are made from it some tens at a time, the rule is judged after every
    draw, and nothing is drawn after the lot in which it stops.

    ``df`` has a row a day.  With ``days``, how many days the series has in the month
    that begins at ``_ym``, days without exposure and outcome need no row.
    """
    d = df.groupBy(*keys, F.trunc("d", "MM").alias("_ym")).agg(F.count(F.lit(1)).alias("_rows"), F.sum("ar").cast("long").alias("_x"), F.sum("ep").cast("long").alias("_y"), F.sum(F.col("ar") * F.col("ep")).cast("long").alias("_j"))
    n = F.col("_rows") if days is None else days.cast("long")
    live = (F.col("_x") > 0) & (F.col("_y") > 0)
    # an ordered array, so that every run makes the same row
    months = F.sort_array(F.collect_list(F.when(live, F.struct("_ym", n.alias("n"), F.col("_x").alias("x"), F.col("_y").alias("y")))))
    real = d.groupBy(*keys).agg(F.sum("_j").alias("_real"), F.sum("_x").alias("_sx"), F.sum("_y").alias("_sy"), months.alias("_months"))
    cdf = lambda m: hypergeometric_cdf(m["n"], m["x"], m["y"])
    head = lambda m: F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys), F.date_format(m["_ym"], "yyyy-MM"))
    ready = F.transform("_months", lambda m: F.struct(head(m).alias("head"), F.greatest(F.lit(0).cast("long"), m["x"] + m["y"] - m["n"]).alias("lo"), cdf(m).alias("cdf")))
    asked = (F.col("_sx") > 0) & (F.col("_sy") > 0)
    real = real.select(*keys, F.when(asked, F.col("_real")).alias("_real"), F.when(asked, ready).alias("_months"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            out = []
            for r, held in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1)):
                if r is None or not held.is_valid:
                    out.append((None, 0, False))
                    continue
                m = held.values
                at, values = m.field("cdf").offsets.to_numpy(), m.field("cdf").values.to_numpy()
                months = [h.encode() for h in m.field("head").to_pylist()], m.field("lo").to_numpy(), [values[i:j] for i, j in zip(at[:-1], at[1:])]
                hits, n, stop = _judged(r, months, iterations, least, absolute, relative)
                out.append(((hits + 1) / (n + 1), n, stop))
            p, n, stop = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(p, pa.float64()), pa.array(n, pa.int32()), pa.array(stop, pa.bool_())], [*keys, "p", "n", "converged"])

    kinds = ", ".join(f"`{k}` {real.schema[k].dataType.simpleString()}" for k in keys)
    return real.mapInArrow(run, f"{kinds}, p double, n int, converged boolean")
