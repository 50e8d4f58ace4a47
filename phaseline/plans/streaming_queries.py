"""The streaming extension over the events table, run as a finished stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import work_folder
from ..streaming import incremental
from . import standins as S
from .registry import query


def _stream(spark, sf_dir):
    t = S.table(spark, sf_dir, "events")
    e = spark.readStream.schema(t.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("cell_id"), (F.col("event_type") == "error").cast("int").alias("ar"), (F.col("value") > 20).cast("int").alias("ep"))


def _finish(df, spark):
    """Rows of a query that has read all there is, from a table in the shared folder."""
    out = work_folder(spark)
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{out}/log").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


_EVENTS = "e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, user_id % 10 AS cell_id, CAST(event_type = 'error' AS INTEGER) AS ar, CAST(value > 20 AS INTEGER) AS ep FROM events)"


@query(f"WITH {_EVENTS}, g AS (SELECT date_trunc('day', ts) AS start, cell_id, {S.ABCD} FROM e GROUP BY 1, 2) SELECT CAST(start AS TIMESTAMP) AS start, cell_id, a, b, c, d FROM g WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 2 HOURS")
def stream_windowed_contingency(spark, sf_dir):
    return _finish(incremental.windowed_contingency(_stream(spark, sf_dir), "ts", "1 day", "2 hours", ["cell_id"]), spark)


@query(f"""WITH {_EVENTS}, x AS (SELECT * FROM e WHERE ar = 1), f AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY cell_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM x),
k AS (SELECT *, sum(new) OVER (PARTITION BY cell_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f), g AS (SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS stop, cell_id, count(*) AS n FROM k GROUP BY cell_id, k)
SELECT start, stop, cell_id, n FROM g WHERE stop <= (SELECT max(ts) FROM x) - INTERVAL 12 HOURS""")
def stream_exposure_episodes(spark, sf_dir):
    return _finish(incremental.exposure_episodes(_stream(spark, sf_dir), "ts", "6 hours", "12 hours", ["cell_id"]), spark)
