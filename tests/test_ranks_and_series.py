"""Selections, numbering, windows over runs, as-of labels and bit series: exact, and spread over tasks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseline.operators import bitseries, counts, lagdiag, match, modes, panel, thresholds
from phaseline.sources import files


@pytest.fixture(scope="module", autouse=True)
def many_tasks(spark):
    """Small tables stay over as many tasks as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_quantile(v, q):
    v = np.sort(np.asarray(v, float))
    at = q * (len(v) - 1)
    return v[int(np.floor(at))] + (at - np.floor(at)) * (v[int(np.ceil(at))] - v[int(np.floor(at))])


@pytest.mark.parametrize("q", [0.0, 0.31, 0.5, 0.95, 0.9999, 1.0])
def test_quantiles_of_hard_values(spark, monkeypatch, q):
    """Outliers of two sizes, ties, heavy tails and constants: a few narrow passes, at most so many values to a task."""
    monkeypatch.setattr(thresholds, "_HELD", 500)
    rng = np.random.default_rng(1)
    groups = {0: np.concatenate([rng.gamma(0.5, size=20_000), [1e12, 1e8]]), 1: rng.lognormal(0, 5, 9_000), 2: np.repeat([1.0, 2.0, 7.0], [5_000, 3, 4_000]), 3: np.full(3_000, 4.5), 4: np.array([3.5]), 5: rng.integers(-3, 3, 2_000).astype(float)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [(1, None), (7, None), (2, float("nan"))], "g int, v double").repartition(4)
    got = {r.g: r.thr for r in thresholds.exact_quantile(df, "v", q, ["g"]).collect()}
    assert got.keys() == groups.keys() and all(abs(got[g] - plain_quantile(v, q)) <= 1e-9 * max(1, abs(got[g])) for g, v in groups.items())
    every = np.concatenate(list(groups.values()))
    assert abs(thresholds.exact_quantile(df, "v", q).first().thr - plain_quantile(every, q)) <= 1e-9 * max(1, abs(plain_quantile(every, q)))


def test_what_is_left_of_a_quantile_fits_a_task(spark, monkeypatch):
    """After the passes no group has more values than the bound, whatever the outliers."""
    monkeypatch.setattr(thresholds, "_HELD", 1_000)
    df = spark.range(200_000).selectExpr("case when id = 1 then 1e12D when id < 9 then 1e8D * id else rand(2) end v")
    state = []
    real = thresholds._narrow

    def narrow(s, cut, runs):
        out = real(s, cut, runs)
        state.append(s["upto"] - s["below"])
        return out

    monkeypatch.setattr(thresholds, "_narrow", narrow)
    assert thresholds.exact_quantile(df, "v", 0.95).count() == 1
    assert len(state) <= 4 and state[-1] <= 1_000 and all(b < a / 10 for a, b in zip([200_000, *state], state))


@pytest.mark.parametrize("wet,ring,half", [(False, 366, 7), (True, 366, 3), (False, 365, 15)])
def test_calendar_windows_over_runs(spark, wet, ring, half):
    rng = np.random.default_rng(3)
    rows = [(c, dt.date(1999, 12, 20) + dt.timedelta(days=int(i)), float(max(0, rng.normal(0, 5)) if wet else rng.normal())) for c in range(3) for i in rng.choice(1600, 90 if c else 900, replace=False)]
    df = spark.createDataFrame([*rows, (1, dt.date(2000, 2, 29), None)], "cell_id long, d date, v double")
    got = {(r.cell_id, r.doy): r.thr for r in thresholds.doy_thresholds(df, "v", 0.9, half, ring, wet).collect()}
    want = {}
    for c, d, v in [*rows, (1, dt.date(2000, 2, 29), None)]:
        for o in range(-half, half + 1):
            want.setdefault((c, (d.timetuple().tm_yday - 1 + o) % ring + 1), []).append(v)
    want = {k: [x for x in v if x is not None and (x > 0 or not wet)] for k, v in want.items()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (round(plain_quantile(v, 0.9), 6) if v else 0.0 if wet else None) or abs(got[k] - plain_quantile(v, 0.9)) < 1.1e-6
    plan = thresholds.doy_thresholds(df, "v", 0.9, half, ring, wet)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan[plan.index("Generate explode") :].lstrip().splitlines()[1].lstrip(" +-:").startswith("Aggregate [cell_id")  # the days of each cell, never rows


def test_pooled_windows_count_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(thresholds, "_HELD", 300)
    rng = np.random.default_rng(5)
    rows = [(int(i % 7), dt.date(2001, 1, 1) + dt.timedelta(days=int(i % 700)), float(x)) for i, x in enumerate(rng.lognormal(0, 3, 12_000).round(1))]
    df = spark.createDataFrame(rows, "cell_id long, d date, v double").repartition(4)
    got = {r.doy: r.thr for r in thresholds.doy_thresholds(df, "v", 0.95, 15, 365, keys=[]).collect()}
    want = {}
    for _, d, v in rows:
        for o in range(-15, 16):
            want.setdefault((d.timetuple().tm_yday - 1 + o) % 365 + 1, []).append(v)
    assert got.keys() == want.keys() and all(abs(got[k] - plain_quantile(v, 0.95)) < 1e-5 for k, v in want.items())


def test_numbers_of_a_large_group_come_from_many_tasks(spark):
    """Two groups, one of nearly all rows, and none: numbers are the order's, and no window holds the group."""
    df = spark.range(5_000).selectExpr("if(id < 4900, null, id % 2) g", "cast(hash(id) as long) o", "id").repartition(5)
    out = panel.numbered(df, ["g"], ["o", "id"])
    rows = sorted((r.g is not None, r.g or 0, r.o, r.id, r.n) for r in out.collect())
    seen = {}
    for *g, _, _, n in rows:
        assert n == seen.get(tuple(g), 0)
        seen[tuple(g)] = n + 1
    assert sorted(seen.values()) == [50, 50, 4900]
    assert sorted(r.n for r in panel.numbered(df, [], ["id"]).collect()) == list(range(5_000)) and panel.numbered(df.limit(0), ["g"], ["o"]).count() == 0
    assert len(out.inputFiles()) >= 5  # a file a task that had rows, and the sums carried over


def test_controls_of_one_stratum(spark):
    case = spark.range(40).selectExpr("cast(0 as int) s", "concat('c', id) cid", "cast(id % 2 as int) case_ar")
    ctrl = spark.range(3_000).selectExpr("cast(0 as int) s", "concat('k', id) kid", "cast(id % 3 as int) ctrl_ar").repartition(4)
    rows = match.drawn_controls(case, ctrl, ["s"], 5, 42).collect()
    assert len(rows) == 200 and all(len({r.kid for r in rows if r.cid == c}) == 5 for c in {r.cid for r in rows})


def test_nearest_labels_over_ranges(spark):
    """Ties go to the later label, whichever ranges the two lie in; no window orders the whole axis."""
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)
    at = [3, 9, 11, 400, 401, 900]
    labels = spark.createDataFrame([(day(i), f"p{i}") for i in at], "day date, phase string")
    df = spark.createDataFrame([(i, day(i)) for i in range(0, 1000, 3)] + [(-1, None)], "i int, d date")
    out = modes.nearest_labels(df, labels)
    want = {i: f"p{min(at, key=lambda a: (abs(a - i), -a))}" for i in range(0, 1000, 3)} | {-1: None}
    assert {r.i: r.phase for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("BroadcastExchange", "")
    near = modes.nearest_labels(df, labels, tolerance=10)
    assert {r.i: r.phase for r in near.collect()} == {i: p if p and min(abs(a - i) for a in at) <= 10 else None for i, p in want.items()}


def _flags(spark, n=150, cells=7):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 3, (cells, n)) == 0, rng.integers(0, 4, (cells, n)) == 0
    x[3], y[4], x[5] = False, False, True
    dense = spark.createDataFrame([(c, t, int(x[c, t]), int(y[c, t])) for c in range(cells) for t in range(n)], "cell_id long, t int, ar int, ep int")
    return x, y, dense


@pytest.mark.parametrize("n", [150, 64, 1, 5])
def test_bit_series_equal_rows(spark, n, monkeypatch):
    """Lags, event averages and hits of packed bits are those of dense rows, some cells at a time."""
    monkeypatch.setattr(bitseries, "HELD", 300)
    _, _, dense = _flags(spark, n)
    sparse = dense.where("ar = 1 or ep = 1 or t = 0")
    series = bitseries.packed(sparse, ["ar", "ep"])
    lags = 6
    row = lambda d, *c: {(r.cell_id, r[c[0]]): tuple(round(r[x], 9) for x in c[1:]) for r in d.collect()}
    want = row(lagdiag.cross_correlation(dense, lags), "lag", "r")
    got = row(bitseries.cross_correlation(series, lags, n), "lag", "r")
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want if abs(k[1]) < n)
    assert row(bitseries.event_average(series, 4, n), "tau", "eta", "baseline") == row(lagdiag.event_average(dense, 4), "tau", "eta", "baseline")
    assert row(bitseries.hit_share(series, 3, n), "lag", "share") == row(lagdiag.hit_share(dense, 3), "lag", "share")


def test_placebo_counts_equal_rows(spark):
    n = 150
    x, y, dense = _flags(spark, n)
    rng = np.random.default_rng(2)
    kept = dense.where("hash(cell_id, t) % 3 <> 0").withColumn("there", F.lit(1))
    there = np.zeros_like(x)
    for r in kept.collect():
        there[r.cell_id, r.t] = True
    strata, perm = np.arange(n) // 20 % 4, rng.permutation(n)
    sources = {0: np.arange(n), 5: np.where(np.arange(n) >= 5, np.arange(n) - 5, -1), 9: perm}
    got = {(r.cell_id, r.k): (r.n10, r.n01) for r in bitseries.placebo_counts(bitseries.packed(kept, ["ar", "ep", "there"]), sources, strata).collect()}
    for k, s in sources.items():
        for c in range(len(x)):
            a = np.array([bool(i >= 0 and x[c, i] and there[c, i]) for i in s])
            n10 = n01 = 0
            for m in range(4):
                at = there[c] & (strata == m)
                e = y[c] & at
                n10 += (a & e).sum() * (~a & ~e & at).sum()
                n01 += (~a & e).sum() * (a & ~e & at).sum()
            assert got[c, k] == (n10, n01)


def test_counted_stage_reads_what_is_new(spark, tmp_path):
    """A new or changed file is read alone, a changed maker makes all anew, a file that is gone doesn't count, a failed job keeps nothing."""
    write = lambda name, lo, hi: spark.range(lo, hi).selectExpr("id % 3 cell_id", "cast(id % 2 as int) ar", "cast(id % 5 = 0 as int) ep").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in {name}+%")
    seen = []

    def partial(df, by, more=0):
        seen.append(sorted(f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()))
        return counts.contingency(df.withColumn("ep", F.col("ep") + more), [*by, "cell_id"])

    merge = lambda rows: rows.groupBy("cell_id").agg(*(F.sum(x).alias(x) for x in "abcd"))
    stage = f"{tmp_path}/stage"
    at = lambda *names: [f"{tmp_path}/in {n}+%" for n in names]

    def call(*names, maker=partial, **o):
        seen.clear()
        out = files.counted_stage(spark, stage, at(*names), maker, merge, **o)
        plain = counts.contingency(spark.read.parquet(*at(*names)), ["cell_id"])
        assert sorted(map(tuple, out.select("cell_id", *"abcd").collect())) == sorted(map(tuple, plain.select("cell_id", *"abcd").collect()))
        return [s for s in seen[1:]]  # the first is the plan over no rows

    write("a", 0, 100), write("b", 100, 250), write("c", 7, 9)
    assert len(call("a", "b")[0]) == 2
    assert call("a", "b") == [] and len(call("a", "b", "c")[0]) == 1 and call("b") == []
    write("b", 300, 500)
    assert len(call("a", "b", "c")[0]) == 1 and call("a", "b", "c") == []
    assert len(call("a", "c", version="2")[0]) == 2
    with pytest.raises(AssertionError):
        call("a", maker=lambda df, by: partial(df, by, 1))  # another plan: all anew, and other counts

    def failing(df, by):
        return partial(df, by).withColumn("a", F.when(F.col("cell_id") == 1, F.raise_error(F.lit("stop"))).otherwise(F.col("a")))

    for _ in range(2):
        with pytest.raises(Exception, match="stop"):
            call("a", maker=failing)
