"""Synthetic panels from hash draws: the same on any cluster, and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws

#: (centre day, height, width) of the peaks added to the example year (fixed values).
PEAKS = ((45, 28, 3), (95, 22, 4), (130, 36, 4), (205, 45, 5), (240, 35, 4), (305, 30, 4))


def _draw(seed: int, name: str, *parts: Column) -> Column:
    """A number in (0, 1)."""
    return draws.uniform(seed, name, *parts) + 0.5 / (1 << 32)


def seasonal_rain(spark: SparkSession, years: int = 30, days: int = 365, seed: int = 42, example_year: int = 0, peaks: tuple = PEAKS) -> DataFrame:
    """(year, day, precip): dry or gamma-distributed days whose chance and scale are highest around day 200.

    A gamma variable of shape two is a sum of two exponential ones.
    """
    t = spark.range(years * days).select((F.col("id") / days).cast("int").alias("year"), (F.col("id") % days + 1).cast("int").alias("day"))
    bell = lambda centre, width: F.exp(-F.pow((F.col("day") - centre) / float(width), F.lit(2.0)))
    u = lambda name: _draw(seed, name, F.col("year"), F.col("day"))
    wet = u("wet") < 0.45 + 0.35 * bell(200, 75)
    rain = F.when(wet, -(F.ln(u("a")) + F.ln(u("b"))) * (5 + 18 * bell(200, 60))).otherwise(0.0)
    more = sum((height * bell(centre, width) for centre, height, width in peaks), F.lit(0.0))
    return t.select("year", "day", (rain + F.when(F.col("year") == example_year, more).otherwise(0.0)).alias("precip"))


def exposure_design(spark: SparkSession, points: int = 6000, seed: int = 42) -> DataFrame:
    """(id, month, grid, region, ar, ep): exposure and outcome that both depend on season and region."""
    u = lambda name: _draw(seed, name, F.col("id"))
    t = spark.range(points).select("id", (1 + F.floor(12 * u("month"))).cast("int").alias("month"), (1 + F.floor(10 * u("grid"))).cast("int").alias("grid"))
    t = t.withColumn("region", F.when(F.col("grid") <= 3, "Dry inland").when(F.col("grid") <= 7, "Transition").otherwise("Coastal humid"))
    summer, coast = F.col("month").between(6, 8).cast("double"), (F.col("region") == "Coastal humid").cast("double")
    t = t.withColumn("ar", (u("ar") < F.greatest(F.lit(0.02), F.least(F.lit(0.85), 0.08 + 0.33 * summer + 0.25 * coast))).cast("int"))
    return t.withColumn("ep", (u("ep") < F.greatest(F.lit(0.005), F.least(F.lit(0.65), 0.015 + 0.09 * F.col("ar") + 0.06 * summer + 0.055 * coast))).cast("int"))
