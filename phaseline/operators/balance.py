"""Balance of two designs: shares, total variation, perturbation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.exact import hypergeometric_ln, ln_factorial


def shares(df: DataFrame, keys: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, keys, share): composition of each group of ``by``."""
    n = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("_t"))
    d = n.join(total, by) if by else n.join(F.broadcast(total))  # one row
    return d.select(*by, *keys, (F.col("n") / F.col("_t")).alias("share"))


def total_variation(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """(tv): half the sum of absolute differences of two compositions."""
    a, b = p.select(*keys, F.col("share").alias("_p")), q.select(*keys, F.col("share").alias("_q"))
    return a.join(b, keys, "full").agg((0.5 * F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0))))).alias("tv"))


def hypergeometric_draws(margins: DataFrame, times: int, seed: int) -> DataFrame:
    """(iter, n, x, y, a): joint counts of x and y among n, for the one row of ``margins(n, x, y)``.

    What lies over ten deviations from the mean is under the draws' resolution, so
    the table that they are looked up in grows with the root of the counts.
    """
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    mid, far = x * y / n, 10 * F.sqrt(F.least(x, y, n - x, n - y).cast("double")) + 20
    low, high = F.greatest(F.lit(0).cast("long"), x + y - n, F.floor(mid - far)), F.least(x, y, F.ceil(mid + far))
    fixed = ln_factorial(x) + ln_factorial(n - x) + ln_factorial(y) + ln_factorial(n - y) - ln_factorial(n)
    t = margins.select("n", "x", "y", F.explode(F.sequence(low, high)).alias("j")).withColumn("p", F.exp(fixed + hypergeometric_ln(F.col("j"), x, y, n)))
    upto = t.withColumn("c", F.sum("p").over(Window.partitionBy("n", "x", "y").orderBy("j")))
    one = upto.groupBy("n", "x", "y").agg(F.min("j").alias("_lo"), F.max("j").alias("_hi"), F.sort_array(F.collect_list("c")).alias("_c"))
    d = one.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    a = F.least(F.col("_lo") + draws.count_upto(F.col("_c"), draws.uniform(seed, F.col("iter"))), F.col("_hi"))
    return d.select("iter", "n", "x", "y", a.alias("a"))
