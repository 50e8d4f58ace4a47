"""Figures that must not grow faster than the input: exchanges, passes over the input, tasks, memory of a task."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import IsNotNull
from pyspark.sql.types import StructType

from phaseline.operators import bitseries, lagdiag, match, modes, thresholds
from phaseline.plans import mode_queries, registry
from phaseline.sources import cube, grib

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _counted(df):
    """``df`` and an accumulator of the rows that are made of it, all passes together."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_many_chunks_share_tasks(spark, tmp_path):
    """A folder of a thousand small chunks is read by 256 tasks, each chunk once; a point that is asked to hold something is dropped where it is read."""
    entries = [{"file": f"data-x/{i}.nc", "bytes": 100 + i} | {f"{a}_{s}": 0.0 for a in cube.AXES for s in ("low", "high")} for i in range(1000)]
    pq.write_table(pa.Table.from_pylist(entries), f"{tmp_path}/index-x.parquet")
    reader = cube.CubeReader(StructType.fromDDL("ts timestamp, lat double, lon double, v double"), {"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) <= cube.TASKS and [p for q in parts for p in q.paths] == [f"{tmp_path}/{e['file']}" for e in entries]


def test_points_without_a_value_are_not_sent(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1 + i), 10.0 + j, 100.0, 1.0 if i == j else None) for i in range(3) for j in range(3)], "ts timestamp, lat double, lon double, v double")
    cube.write(df, f"{tmp_path}/c", ["v"])
    reader = cube.PushedCubeReader(StructType.fromDDL("ts timestamp, lat double, lon double, v double"), {"path": f"{tmp_path}/c"})
    reader.pushFilters([IsNotNull(("v",))])
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 3
    assert cube.read(spark, [f"{tmp_path}/c"], ["v"]).count() == 9 and cube.read(spark, [f"{tmp_path}/c"], ["v"]).where("v is not null").count() == 3


def _flags_at_once(spark, cells: int, times: int) -> list[int]:
    """Values of a flag that ``over_cells`` unpacks at once, a number a part."""
    words = [(i, [(0, 1, 1)]) for i in range(cells)]
    series = spark.createDataFrame(words, "cell_id int, words array<struct<word: bigint, ar: bigint, ep: bigint>>").coalesce(1)
    sizes = lambda flags: (np.zeros(1, np.int64), {"n": np.array([flags["ar"].size])})
    return [r.n for r in bitseries.over_cells(series, ["ar", "ep"], times, sizes, "n long").collect()]


def test_a_task_unpacks_few_flags_at_once(spark):
    n = _flags_at_once(spark, 3_000, 2_500)
    assert sum(n) == 3_000 * 2_500 and max(n) <= 1 << 21


def test_unpacked_flags_are_few_beside_a_worker(spark):
    """A task's part is full at a tenth of a GB already, so a task of more cells, or a longer axis, holds no more."""
    for cells, times in ((500, 2_500), (3_000, 2_500), (300, 50_000)):
        n = _flags_at_once(spark, cells, times)
        assert sum(n) == cells * times and max(n) <= 1 << 18


def test_placebos_take_few_bytes_whatever_the_cells(spark):
    """Peak of what a worker makes over 400 and 1,600 cells of 2,500 days and nine designs: some MB, the same for both."""
    import tracemalloc

    times = 2_500
    designs = {k: np.where((s := np.arange(times) - k) < 0, -1, np.minimum(s, times - 1)) for k in range(9)}

    def peak(cells: int) -> int:
        run = []
        word = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda w: F.struct(w.cast("long").alias("word"), *(F.xxhash64("id", w, F.lit(f)).alias(f) for f in ("ar", "ep", "there"))))
        series = spark.range(0, cells, 1, 1).select(F.col("id").alias("cell_id"), word.alias("words"))

        class Frame:  # as ``series``; keeps what workers are given
            schema = series.schema

            def select(self, *_):
                return self

            def mapInArrow(self, f, _):
                run.append(f)

        bitseries.placebo_counts(Frame(), designs, np.arange(times) // 30 % 12)
        batches = series.toArrow().combine_chunks().to_batches()
        tracemalloc.start()
        try:
            assert sum(len(b) for b in run[0](batches)) == cells * len(designs)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    few, many = peak(400), peak(1_600)
    assert many < 8e6 and many < 1.1 * few


def test_placebos_do_not_depend_on_the_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(c, t, int(rng.random() < 0.4), int(rng.random() < 0.2), 1) for c in range(30) for t in range(150) if rng.random() < 0.7]
    series = bitseries.packed(spark.createDataFrame(rows, "cell_id int, t int, ar int, ep int, there int"), ["ar", "ep", "there"])
    designs = {k: np.where((s := np.arange(150) - k) < 0, -1, s) for k in (0, 7, 30)}
    found = []
    for held in (1, 1_000, 1 << 18):  # a cell, six cells, all cells of a batch
        monkeypatch.setattr(bitseries, "HELD", held)
        found.append(sorted(bitseries.placebo_counts(series, designs, np.arange(150) // 30).collect()))
    assert len(found[0]) == 90 and found[0] == found[1] == found[2]


def test_monte_carlo_takes_one_exchange(spark):
    """No dense panel is made and no draw is shuffled: rows are dealt out by cell, and the rest stays in its task."""
    assert _plan(registry.queries()["seq_mc_pvalue"](spark, SF)).count("Exchange hashpartitioning") == 1


def test_monte_carlo_of_sparse_rows_is_that_of_dense_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(c, dt.date(2000, 1, 10) + dt.timedelta(days=t), int(rng.random() < 0.3), int(rng.random() < 0.2)) for c in range(6) for t in range(100)]
    dense = spark.createDataFrame(rows, "cell_id int, d date, ar int, ep int")
    last = F.lit(dt.date(2000, 1, 10) + dt.timedelta(days=99))
    days = F.datediff(F.least(F.last_day("_ym"), last), F.greatest("_ym", F.lit(dt.date(2000, 1, 10)))) + 1
    sparse = lagdiag.monte_carlo(dense.where("ar + ep > 0"), 50, 7, days)
    assert sorted(sparse.collect()) == sorted(lagdiag.monte_carlo(dense, 50, 7).collect())


def test_long_axes_are_unpacked_by_fewer_cells(spark):
    n = _flags_at_once(spark, 300, 50_000)
    assert sum(n) == 300 * 50_000 and max(n) <= 1 << 21


def test_permutation_joins_no_copies(spark):
    """Iterations are made inside a stratum's row: no iteration is sorted, exchanged or joined."""
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 4)], "s string, u int, v int")
    plan = _plan(match.permuted(df, "v", ["s"], "u", 3, 1))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_point_diagnostics_make_no_dense_rows(spark):
    assert "explode" not in _plan(registry.queries()["point_diagnostics"](spark, SF))


def test_point_diagnostics_make_the_panel_twice(spark):
    """For lags and for draws; whether a series varies is told with its lags."""
    assert _plan(registry.queries()["point_diagnostics"](spark, SF)).count("percentile(") == 2


def test_draws_are_made_outside_expressions(spark):
    """Draws of a cell are arrays in its task: no md5 is turned into a number value by value in the plan."""
    assert "conv(" not in _plan(registry.queries()["seq_mc_pvalue"](spark, SF))


def test_no_draw_after_the_lot_that_stops(monkeypatch):
    made, counts = [], lagdiag._joint_counts
    monkeypatch.setattr(lagdiag, "_joint_counts", lambda h, lows, cdfs, groups: made.extend(groups) or counts(h, lows, cdfs, groups))
    month = [b"1|1|2000-01"], np.array([0]), [np.array([0.5, 1.0])]
    assert lagdiag._judged(0, month, 500, 10, 0.01, 0.1) == (10, 10, True) and len(made) == 16  # always reached: p = 1
    assert lagdiag._judged(2, month, 50, 10, 0.0, 0.0) == (0, 50, False)  # never reached


def test_masked_points_are_not_sent(tmp_path):
    at = np.arange(12)
    values = np.where(at % 3 == 0, np.nan, at * 70_001.0)
    (tmp_path / "x.grib").write_bytes(grib.encode(86400.0, 228, 1, 0, 10 + at // 4 / 4, 100 + at % 4 / 4, values))
    reader = grib.PushedGribReader({"path": str(tmp_path / "x.grib")})
    reader.pushFilters([IsNotNull(("value",))])
    got = [v for p in reader.partitions() for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert sorted(got) == [v for v in values.tolist() if v == v]


def test_quantile_makes_its_input_once(spark):
    df, seen = _counted(spark.range(150_000).select((F.col("id") * 7919 % 150_000).alias("v")))
    assert thresholds.exact_quantile(df, "v", 0.95).first().thr == pytest.approx(0.95 * 149_999)
    assert seen.value == 150_000


def test_calendar_windows_make_their_input_once(spark):
    df, seen = _counted(spark.range(200_000).select(F.date_add(F.lit(dt.date(2001, 1, 1)), (F.col("id") % 4).cast("int")).alias("d"), F.col("id").alias("v")))
    got = {r.doy: r.thr for r in thresholds.doy_thresholds(df, "v", 0.5, 1, 365, keys=[]).collect()}
    assert got[2] == pytest.approx(np.median([i for i in range(200_000) if i % 4 < 3])) and seen.value == 200_000


def test_parts_of_marks(spark):
    df = spark.createDataFrame([(0, 5.0, 0), (0, 2.0, 0), (1, 3.0, 1), (0, 1.0, 0), (1, 9.0, 1)], "run int, _v double, _at int")
    got = {(r.run, r._v): r._p for r in thresholds._parted(df, [[2.0, 4.0], [3.0]]).collect()}
    assert got == {(0, 1.0): 0, (0, 2.0): 1, (0, 5.0): 4, (1, 3.0): 1, (1, 9.0): 2}


def test_later_passes_read_what_is_left(spark, monkeypatch):
    """After a pass only values near the rank are stored; quantiles stay exact with runs that groups share, equal values and bounds that meet."""
    rng, sizes, keep = np.random.default_rng(3), [], thresholds.stored
    monkeypatch.setattr(thresholds, "_HELD", 300)
    monkeypatch.setattr(thresholds, "stored", lambda df: (sizes.append(out.count()) if "_v" in (out := keep(df)).columns else None, out)[1])
    values = {r: np.round(rng.normal(r / 50, 1, 8_000), 1 + r % 3) for r in range(4)}
    df = spark.createDataFrame([(r, float(v)) for r, vs in values.items() for v in vs], "run int, v double")
    near = {g: [g, (g + 1) % 4] for g in range(4)}
    members = spark.createDataFrame([(g, r) for g, rs in near.items() for r in rs], "g int, run int")
    for q in (0.0, 0.31, 0.95, 1.0):
        sizes.clear()
        got = {r.g: r.thr for r in thresholds.run_quantiles(df, "v", q, ["run"], members, ["g"]).collect()}
        assert got == pytest.approx({g: np.quantile(np.concatenate([values[r] for r in rs]), q) for g, rs in near.items()})
        assert sizes[0] == 32_000 and all(b < a / 4 for a, b in zip(sizes[:1], sizes[1:]))


def test_flag_overlap_makes_days_once(spark):
    """Flags are read off the stored days, not made again from lines."""
    assert "l_shipdate" not in _plan(registry.queries()["flag_overlap"](spark, SF))


def test_pair_rows_make_blocks_once(spark):
    rows = [("M", p, m, 5 + m + i, 9, 4, 30) for i, p in enumerate(("Positive", "Negative", "Neutral")) for m in range(6)]
    blocks, seen = _counted(spark.createDataFrame(rows, "mode string, phase string, ym int, a long, b long, c long, d long"))
    assert modes.pair_rows(blocks, ["mode"], 10, 1, ["rd"]).count() == 3 and seen.value == len(rows)


def test_strict_pairs_are_made_once(spark):
    assert _plan(registry.queries()["cc_strict_k"](spark, SF)).count("Generate explode") == 1


def test_phases_take_one_panel(spark):
    """Labels of months and of days meet the panel in one join."""
    assert _plan(mode_queries._phased(spark, SF)).count("FileScan parquet [l_suppkey") == 1
