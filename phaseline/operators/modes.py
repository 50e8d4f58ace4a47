"""Index phases: labels, joins of labels to times, lag scans and phase contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import metrics as M
from ..functions.exact import fisher
from ..functions.metrics import delta_intervals
from . import fdr
from .counts import count_columns
from .panel import stored

#: Fixed order of phases within each mode, in which they are compared (first minus second).
PHASE_ORDER = ["ElNino", "LaNina", "Positive", "Negative", "Neutral", *(f"Phase_{i}" for i in range(1, 9)), "Active_1to4", "Active_5to8", "Inactive"]


def phase_of(value: Column, high: str = "Positive", low: str = "Negative", at: float = 0.5) -> Column:
    """high above at, low below -at, Neutral between (both ends), NULL for NULL."""
    return F.when(value > at, high).when(value < -at, low).when(value.isNotNull(), "Neutral")


def coarse_phase(amplitude: Column, phase: Column) -> Column:
    on = amplitude >= 1
    return F.when(amplitude < 1, "Inactive").when(on & phase.between(1, 4), "Active_1to4").when(on & phase.between(5, 8), "Active_5to8")


def detailed_phase(amplitude: Column, phase: Column) -> Column:
    return F.when(amplitude < 1, "Inactive").when((amplitude >= 1) & phase.between(1, 8), F.concat(F.lit("Phase_"), phase.cast("int").cast("string")))


def phase_rank(phase: Column) -> Column:
    """Place of a phase in the fixed order; unknown ones last."""
    out = F.lit(len(PHASE_ORDER))
    for i, p in reversed(list(enumerate(PHASE_ORDER))):
        out = F.when(phase == p, i).otherwise(out)
    return out


def wide_to_long(df: DataFrame, year: str, months: list[str], value: str) -> DataFrame:
    """(ym, value) of a table with a column a month."""
    long = df.unpivot([year], months, "_m", value)
    number = F.array_position(F.array(*map(F.lit, months)), F.col("_m"))
    return long.select(F.make_date(F.col(year).cast("int"), number.cast("int"), F.lit(1)).alias("ym"), value)


def month_labels(df: DataFrame, labels: DataFrame, lag: int = 0, time: str = "d") -> DataFrame:
    """Label of the calendar month ``lag`` months before; NULL where there is none."""
    l = labels.select(F.add_months("ym", lag).alias("_ym"), "phase")  # noqa: E741
    return df.join(l, F.trunc(F.col(time), "MM") == F.col("_ym"), "left").drop("_ym")


def day_labels(df: DataFrame, labels: DataFrame, lag: int = 0, time: str = "d") -> DataFrame:
    l = labels.select(F.date_add("day", lag).alias("_day"), "phase")  # noqa: E741
    return df.join(l, F.to_date(F.col(time)) == F.col("_day"), "left").drop("_day")


def nearest_labels(df: DataFrame, labels: DataFrame, time: str = "d", at: str = "day", tolerance: int | None = None) -> DataFrame:
    """Label of the nearest index date (the later one on a tie), looked up once a distinct time.

    Times and index dates are sorted together by ranges, so no task holds the axis; each
    range looks inside itself, and beyond its ends to the last label before and the first
    one after it, of which there are two a range.
    """
    spark = df.sparkSession
    times = df.select(F.col(time).alias("_t")).distinct().withColumn("_l", F.lit(None).cast("date"))
    both = times.unionByName(labels.select(F.col(at).cast("date").alias("_t"), F.col(at).cast("date").alias("_l")))
    both = stored(both.repartitionByRange("_t").withColumn("_p", F.spark_partition_id()))
    ends = both.groupBy("_p").agg(F.min("_l").alias("a"), F.max("_l").alias("b")).orderBy("_p").collect()  # a row a range
    known = [r.b for r in ends]
    later = [r.a for r in ends]
    for i in range(1, len(ends)):  # the last label up to each range, and the first one from it on
        known[i] = known[i] or known[i - 1]
        later[-i - 1] = later[-i - 1] or later[-i]
    outer = [(r._p, known[i - 1] if i else None, later[i + 1] if i + 1 < len(ends) else None) for i, r in enumerate(ends)]
    both = both.join(F.broadcast(spark.createDataFrame(outer, "_p int, _before date, _after date")), "_p")
    back = Window.partitionBy("_p").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_p").orderBy("_t").rangeBetween(0, Window.unboundedFollowing)
    inner = both.withColumn("_b", F.coalesce(F.max("_l").over(back), "_before")).withColumn("_a", F.coalesce(F.min("_l").over(ahead), "_after"))
    both = inner.where("_l is null").select("_t", "_b", "_a").distinct()
    before, after = F.datediff("_t", "_b"), F.datediff("_a", "_t")
    pick = F.when(F.col("_b").isNull() | (after <= before), F.col("_a")).otherwise(F.col("_b"))
    near = both.select("_t", pick.alias("_at"))
    if tolerance is not None:
        near = near.where(F.abs(F.datediff("_t", "_at")) <= tolerance)
    named = near.join(labels.select(F.col(at).cast("date").alias("_at"), "phase"), "_at").drop("_at")
    return df.join(named, F.col(time) == F.col("_t"), "left").drop("_t")


def lagged_labels(labels: DataFrame, lags: DataFrame) -> DataFrame:
    """(mode, lag, key, phase): labels moved ahead by each lag of their mode; unit 'month' or 'day'."""
    d = labels.join(lags, "mode")
    key = F.when(F.col("unit") == "month", F.add_months("key", F.col("lag"))).otherwise(F.date_add("key", F.col("lag")))
    return d.select("mode", "unit", "lag", key.alias("key"), "phase")


def scan_counts(times: DataFrame, labels: DataFrame, lags: DataFrame, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """(mode, lag, phase, extra, a..d, n_time) of per-time counts ``times(d, a, b, c, d_)``: all lags in one job."""
    l = lagged_labels(labels, lags)  # noqa: E741
    t = times.withColumn("ym", F.trunc("day", "MM"))
    month = t.join(l.where("unit = 'month'"), F.col("ym") == F.col("key"))
    day = t.join(l.where("unit = 'day'"), F.col("day") == F.col("key"))
    cols = ["mode", "lag", "phase", *extra, "a", "b", "c", "d"]
    both = month.select(*cols).unionByName(day.select(*cols)).where("phase is not null")
    return both.groupBy("mode", "lag", "phase", *extra).agg(*(F.sum(x).alias(x) for x in "abcd"), F.count(F.lit(1)).alias("n_time"))


#: Measures of a cell that a phase's row averages.
FIELDS = {"p1": M.risk_exposed, "p0": M.risk_unexposed, "rd": M.risk_difference, "rr": M.risk_ratio, "af": M.attributable_fraction, "paf": M.population_attributable_fraction}


def phase_rows(df: DataFrame, keys: list[str], alpha: float = 0.05, cell: str = "cell_id", time: str = "d") -> DataFrame:
    """One wide row a phase of the panel ``df(keys, cell, lat, time, ar, ep)``: 29 columns of its cells and 21 pooled ones, in this order.

    Times; cells whose one-sided exact test is under ``alpha``, and those that pass the
    phase's false-discovery control; means of six measures over all cells and over the
    significant ones, plain and weighted by the cosine of latitude; then pooled
    measures with delta-method intervals, shares and totals.  A measure that a cell
    lacks is no part of a mean; a mean of nothing is NULL.
    """
    k = df.groupBy(*keys, cell, "lat").agg(*count_columns())
    k = k.select("*", fisher(*map(F.col, "abcd"), "greater").alias("_p"), F.cos(F.radians("lat")).alias("_w"), *(f().alias(f"_{m}") for m, f in FIELDS.items()))
    k = fdr.significant(k, "_p", alpha, keys)
    low = F.col("_p") < alpha
    out = [F.count_if(low).alias("sig_p"), F.count_if("sig").alias("sig_fdr")]
    for weighted in (False, True):
        for chosen, suffix in ((F.lit(True), "all"), (low, "sig")):
            for m in FIELDS:
                x = F.when(chosen, F.col(f"_{m}"))
                w = F.when(x.isNotNull(), F.col("_w"))
                mean = M.ratio(F.sum(x * w), F.sum(w)) if weighted else F.avg(x)
                out.append(mean.alias(f"{'aw_' if weighted else ''}mean_{m}_{suffix}"))
    sums = k.groupBy(*keys).agg(*out, *(F.sum(x).alias(x) for x in "abcd"))
    times = df.groupBy(*keys).agg(F.count_distinct(time).alias("n_time"))
    d, a = delta_intervals(), {x: F.when(F.col(x) == 0, F.lit(0.5)).otherwise(F.col(x).cast("double")) for x in "abcd"}
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    pooled = {"pooled_p1": F.when(d["rr"].isNotNull(), a["a"] / (a["a"] + a["b"])), "pooled_p0": F.when(d["rr"].isNotNull(), a["c"] / (a["c"] + a["d"]))}
    pooled |= {f"pooled_{m}{end}": d[f"{m}{end}"] for m in ("rd", "rr", "af", "paf") for end in ("", "_low", "_high")}
    pooled |= {"pooled_ar_share": M.ratio(F.col("a") + F.col("b"), n), "pooled_ep_share": M.ratio(F.col("a") + F.col("c"), n)}
    same = sums.join(times, keys)
    return same.select(*keys, "n_time", *(c for c in sums.columns if c.startswith(("sig_", "mean_", "aw_"))), *(v.alias(c) for c, v in pooled.items()), *(F.col(x).alias(f"{x}_total") for x in "abcd"), n.alias("n_total"))


def contrasts(summary: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Differences of every two phases of a key that both exist, first minus second in the fixed order."""
    r = phase_rank(F.col("phase"))
    one = summary.select(*keys, F.col("phase").alias("phase1"), r.alias("_r1"), *(F.col(m).alias(f"{m}_1") for m in metrics))
    two = summary.select(*keys, F.col("phase").alias("phase2"), r.alias("_r2"), *(F.col(m).alias(f"{m}_2") for m in metrics))
    return one.join(two, keys).where("_r1 < _r2").select(*keys, "phase1", "phase2", *((F.col(f"{m}_1") - F.col(f"{m}_2")).alias(f"d_{m}") for m in metrics))


def bootstrap_contrasts(blocks: DataFrame, keys: list[str], repetitions: int, seed: int, metrics: list[str], least: int = 3) -> DataFrame:
    """Block-bootstrap contrasts of phases.

    ``blocks(keys, phase, ym, a..d)`` are year-month blocks; each repetition draws
    as many blocks of a phase as it has, with replacement.  Gives mean, 2.5 and
    97.5 percentiles, p = min(1, 2 min(P(d <= 0), P(d >= 0))) and significance.
    """
    own = [*keys, "phase"]
    # a phase's blocks, a row a month, as one array; a repetition adds up what it draws from it
    b = blocks.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("ym", *"abcd"))).alias("_b")).where(F.size("_b") >= least)
    # the arrays are few and small but the draws many: shares of the repetitions are dealt out, not coalesced
    shares = min(repetitions, 20)
    b = b.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    b = b.repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), *own, "_c")
    b = b.withColumn("rep", F.explode(F.sequence(F.col("_c"), F.lit(repetitions - 1), F.lit(shares)))).drop("_c")
    n = F.size("_b")
    pick = lambda i: F.get(F.col("_b"), draws.integer(n, seed, *(F.col(k) for k in own), F.col("rep"), i).cast("int"))
    zero = F.struct(*(F.lit(0).cast("long").alias(x) for x in "abcd"))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), pick), zero, lambda t, v: F.struct(*((t[x] + v[x]).alias(x) for x in "abcd")))
    sums = b.select(*own, "rep", total.alias("_s")).select(*own, "rep", *(f"_s.{x}" for x in "abcd"))
    d = delta_intervals()
    values = sums.select(*own, "rep", *(d[m].alias(m) for m in metrics))
    diff = contrasts(values, [*keys, "rep"], metrics)
    long = diff.unpivot([*keys, "rep", "phase1", "phase2"], [f"d_{m}" for m in metrics], "metric", "x").where("x is not null")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    x = F.col("x")
    out = long.groupBy(*keys, "phase1", "phase2", "metric").agg(
        F.avg(x).alias("mean"), F.percentile(x, F.lit(0.025)).alias("low"), F.percentile(x, F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2 * F.least(share(x <= 0), share(x >= 0))).alias("p")
    )
    return out.withColumn("sig", (F.col("low") > 0) | (F.col("high") < 0))


#: Fixed value: what a comparison without a bootstrap says.
FEW_BLOCKS = "Not enough blocks or missing phase"


def pair_rows(blocks: DataFrame, keys: list[str], repetitions: int, seed: int, metrics: list[str], least: int = 3) -> DataFrame:
    """One row a comparison: its label, pooled differences, blocks and bootstrap side by side.

    Where either phase has fewer than ``least`` blocks the bootstrap's columns are
    NULL and ``note`` says so.
    """
    blocks = stored(blocks)  # a row a month and phase, read by every part
    d = delta_intervals()
    pooled = blocks.groupBy(*keys, "phase").agg(*(F.sum(x).alias(x) for x in "abcd"), F.count_distinct("ym").alias("blocks"))
    diff = contrasts(pooled.select(*keys, "phase", *(d[m].alias(m) for m in metrics)), keys, metrics)
    for i in "12":
        diff = diff.join(pooled.select(*keys, F.col("phase").alias(f"phase{i}"), F.col("blocks").alias(f"blocks{i}")), [*keys, f"phase{i}"])
    drawn = bootstrap_contrasts(blocks, keys, repetitions, seed, metrics, least)
    at = [*keys, "phase1", "phase2"]
    wide = drawn.groupBy(*at).agg(*(F.max(F.when(F.col("metric") == f"d_{m}", F.col(x))).alias(f"{m}_{x}") for m in metrics for x in ("mean", "low", "high", "p", "sig")))
    out = diff.join(wide, at, "left")
    label = F.concat(F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)), F.lit(": "), "phase1", F.lit(" - "), "phase2")
    return out.withColumn("comparison", label).withColumn("note", F.when(F.least("blocks1", "blocks2") < least, FEW_BLOCKS))
