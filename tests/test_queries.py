"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from phaseline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plain(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "hour") and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
        v = v.date()
    if type(v).__name__ in ("float", "Decimal"):
        return f"{float(v) + 0.0:.5f}"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.5f}" if isinstance(v, int) else str(v)[:19]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    want = [tuple(_plain(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_streams_equal_batch(spark):
    """A finished stream gives just the windows and episodes that the watermark has closed, with the batch's counts."""
    import datetime as dt

    from pyspark.sql import functions as F

    from phaseline.plans import streaming_queries
    from phaseline.streaming import incremental

    e = spark.read.parquet(f"{SF}/events.parquet")
    e = e.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("cell_id"), (F.col("event_type") == "error").cast("int").alias("ar"), (F.col("value") > 20).cast("int").alias("ep"))
    last, last_ar = e.agg(F.max("ts"), F.max(F.when(F.col("ar") == 1, F.col("ts")))).first()
    batch = incremental.windowed_contingency(e, "ts", "1 day", "2 hours", ["cell_id"]).collect()
    want = {tuple(r) for r in batch if r.start + dt.timedelta(days=1) <= last - dt.timedelta(hours=2)}
    assert want and {tuple(r) for r in streaming_queries.stream_windowed_contingency(spark, SF).collect()} == want
    batch = incremental.exposure_episodes(e, "ts", "6 hours", "12 hours", ["cell_id"]).collect()
    want = {tuple(r) for r in batch if r.stop <= last_ar - dt.timedelta(hours=12)}
    assert want and {tuple(r) for r in streaming_queries.stream_exposure_episodes(spark, SF).collect()} == want


def test_scan_is_pruned_and_pushed_down(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = registry.queries()["message_scan_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_quantity" not in plan


def test_lag_scan_has_one_panel_aggregate(spark):
    """All lags are read off per-day counts; the panel is never joined with the lags."""
    plan = registry.queries()["lag_scan"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan
