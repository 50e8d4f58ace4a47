"""False-discovery-rate control (Benjamini-Hochberg) without a global sort in one task.

Equal p values share their largest rank, so ranks are cumulative counts of
distinct values.  Values are cut into ranges, half of them equal in p and half
equal in its logarithm, for small values pile up: sums over whole ranges form a
small table, and windows only order the values inside a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import stored

SLICES = 8192


def _ranked(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """(by, p, _b, _rank, _n): every distinct p with its largest rank and the number of tests."""
    v = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_c"))
    half, low = SLICES // 2, 1 / 64  # below ``low`` by logarithm, down to the least positive number; 0 is a range of its own
    by_log = F.greatest(F.lit(1), half + F.floor(F.log(F.col(p) / low) * (half / 750.0)))
    by_p = half + F.floor((F.col(p) - low) * (half / (1 - low)))
    v = v.withColumn("_b", F.when(F.col(p) <= 0, F.lit(0)).when(F.col(p) < low, by_log).otherwise(F.least(by_p, F.lit(SLICES))).cast("long"))
    sums = v.groupBy(*by, "_b").agg(F.sum("_c").alias("_s"))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most SLICES + 1 rows
    before = F.coalesce(F.sum("_s").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_b", before.alias("_before"), F.sum("_s").over(own).alias("_n"))
    inside = Window.partitionBy(*by, "_b").orderBy(p)
    v = v.withColumn("_upto", F.sum("_c").over(inside))
    return v.join(sums, [*by, "_b"]).select(*by, p, "_b", (F.col("_before") + F.col("_upto")).alias("_rank"), "_n")


def significant(df: DataFrame, p: str, alpha: float = 0.05, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with boolean ``sig``: p up to the largest one under its critical value."""
    df = stored(df)  # tests are dear, and read twice
    passing = _ranked(df, p, by).where(F.col(p) <= F.col("_rank") / F.col("_n") * alpha)
    star = passing.groupBy(*by).agg(F.max(p).alias("_star"))
    d = df.join(star, by, "left") if by else df.join(F.broadcast(star))  # one row
    return d.withColumn("sig", F.coalesce(F.col(p) <= F.col("_star"), F.lit(False))).drop("_star")


def q_values(df: DataFrame, p: str, name: str = "q", by: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with adjusted p values; NULL where p is NULL."""
    df = stored(df)  # tests are dear, and read twice
    v = _ranked(df, p, by).withColumn("_m", F.col(p) * F.col("_n") / F.col("_rank"))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most SLICES + 1 rows
    above = F.min("_least").over(own.orderBy("_b").rowsBetween(1, Window.unboundedFollowing))
    rest = v.groupBy(*by, "_b").agg(F.min("_m").alias("_least")).select(*by, "_b", above.alias("_above"))
    up = Window.partitionBy(*by, "_b").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v = v.withColumn("_in", F.min("_m").over(up)).join(rest, [*by, "_b"])
    q = v.select(*by, p, F.least(F.lit(1.0), "_in", "_above").alias(name))
    return df.join(q, [*by, p], "left").select(*df.columns, name)
