"""2x2 counts by any keys, from three sums and a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_columns(ar: str = "ar", ep: str = "ep") -> list[Column]:
    """a, b, c, d as aggregates: a = sum(ar ep), the rest from the margins."""
    x, y = F.col(ar).cast("long"), F.col(ep).cast("long")
    both, sx, sy, n = F.sum(x * y), F.sum(x), F.sum(y), F.count(F.lit(1))
    return [both.alias("a"), (sx - both).alias("b"), (sy - both).alias("c"), (n - sx - sy + both).alias("d")]


def contingency(df: DataFrame, keys: list, ar: str = "ar", ep: str = "ep") -> DataFrame:
    return df.groupBy(*keys).agg(*count_columns(ar, ep))


def sparse_contingency(events: DataFrame, keys: list, n: Column | str, ar: str = "ar", ep: str = "ep") -> DataFrame:
    """Counts from only the rows with ar or ep, given how many rows a key has in all."""
    x, y = F.col(ar).cast("long"), F.col(ep).cast("long")
    g = events.groupBy(*keys).agg(F.sum(x * y).alias("a"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.max(n).alias("_n"))
    return g.select(*keys, "a", (F.col("_x") - F.col("a")).alias("b"), (F.col("_y") - F.col("a")).alias("c"), (F.col("_n") - F.col("_x") - F.col("_y") + F.col("a")).alias("d"))


def summed(df: DataFrame, keys: list) -> DataFrame:
    """Counts of finer keys added up: the merge of partial counts."""
    return df.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in "abcd"))


def cube(df: DataFrame, keys: list) -> DataFrame:
    """Counts for every subset of keys; NULL stands for all."""
    return df.cube(*keys).agg(*count_columns())
