"""Case-crossover matching and placebo designs.

A case is an outcome row; its controls are rows without outcome of the same
cell and stratum (by default the calendar month, whatever the year).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.exact import binomial_half
from ..functions.metrics import matched_odds_ratio
from .panel import numbered, stored


def discordant_all(df: DataFrame, keys: list[str], stratum: Column) -> DataFrame:
    """(keys, n10, n01) against every control, from counts alone: no pair is built."""
    d = df.withColumn("_s", stratum)
    n = lambda ep, ar: F.sum(F.when((F.col("ep") == ep) & (F.col("ar") == ar), 1).otherwise(0)).cast("long")
    g = d.groupBy(*keys, "_s").agg(n(1, 1).alias("c1"), n(1, 0).alias("c0"), n(0, 1).alias("k1"), n(0, 0).alias("k0"))
    return g.groupBy(*keys).agg(F.sum(F.col("c1") * F.col("k0")).alias("n10"), F.sum(F.col("c0") * F.col("k1")).alias("n01"))


def sampled_pairs(df: DataFrame, stratum: Column, k: int, seed: int, strict: bool = False, cell: str = "cell_id", time: str = "d") -> DataFrame:
    """(cell, case time, case ar, control time, control ar): up to k controls a case without replacement.

    ``strict`` drops cases with fewer than k.
    """
    d = df.withColumn("_s", stratum).withColumn("_id", F.concat_ws("|", F.col(cell).cast("string"), F.col(time).cast("string")))
    d = stored(d.select(cell, "_s", "_id", time, "ep", "ar"))  # cases, controls and their numbers are read off it
    case = d.where("ep = 1").select(cell, "_s", F.col("_id").alias("cid"), F.col(time).alias("case_d"), F.col("ar").alias("case_ar"))
    ctrl = d.where("ep = 0").select(cell, "_s", F.col("_id").alias("kid"), F.col(time).alias("ctrl_d"), F.col("ar").alias("ctrl_ar"))
    return drawn_controls(case, ctrl, [cell, "_s"], k, seed, strict).select(cell, "case_d", "case_ar", "ctrl_d", "ctrl_ar")


def drawn_controls(case: DataFrame, ctrl: DataFrame, stratum: list[str], k: int, seed: int, strict: bool = True) -> DataFrame:
    """(case(cid, ..), ctrl(kid, ..)): k different controls of its stratum for every case.

    Controls are numbered in the order of an md5 draw (``panel.numbered``: a stratum of any
    size lies over many tasks), and a case draws k of the numbers by Floyd's method, so
    k rows a case are made and no other pair.  ``strict`` drops cases with fewer; else
    they get all there are.
    """
    ranked = numbered(ctrl.withColumn("_h", draws.key(seed, F.col("kid"))), stratum, ["_h", "kid"], "_r").drop("_h")
    size = ctrl.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_n"))
    case = case.join(size, stratum)
    if strict:
        case = case.where(F.col("_n") >= k)
    take = F.least(F.lit(k).cast("long"), F.col("_n"))
    pairs = case.withColumn("_r", F.explode(draws.choose(take, F.col("_n"), seed, F.col("cid")))).drop("_n")
    return pairs.join(ranked, [*stratum, "_r"]).drop("_r")


def discordant(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n10, n01) of sampled pairs."""
    x = lambda a, b: F.sum(F.when((F.col("case_ar") == a) & (F.col("ctrl_ar") == b), 1).otherwise(0)).cast("long")
    return pairs.groupBy(*keys).agg(x(1, 0).alias("n10"), x(0, 1).alias("n01"))


def odds(df: DataFrame) -> DataFrame:
    """``df(n10, n01)`` with the matched odds ratio, its interval and binomial p."""
    value, low, high = matched_odds_ratio(F.col("n10"), F.col("n01"))
    return df.select("*", value.alias("or"), low.alias("or_low"), high.alias("or_high"), binomial_half(F.col("n10"), F.col("n01")).alias("p"))


def pooled(df: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Discordant counts added over cells; the odds ratio is NULL where there are none."""
    g = df.groupBy(*keys).agg(F.sum("n10").alias("n10"), F.sum("n01").alias("n01"))
    value, low, high = matched_odds_ratio(F.col("n10"), F.col("n01"))
    some = F.col("n10") + F.col("n01") > 0
    return g.select(*keys, "n10", "n01", F.when(some, value).alias("or"), F.when(some, low).alias("or_low"), F.when(some, high).alias("or_high"), binomial_half(F.col("n10"), F.col("n01")).alias("p"))


def permuted(df: DataFrame, value: str, stratum: list[str], unit: str, iterations: int, seed: int, first: int = 0) -> DataFrame:
    """(iter, stratum, unit, value): values shuffled among the units of each stratum.

    Units in order are put beside units in the order of a draw, so each iteration is a
    permutation within every stratum.  A stratum is one row with an array of its units,
    which are the days of a month or of a calendar month: iterations take no copy of the
    rows through an exchange, and rows that already lie by a part of the stratum stay.
    """
    rows = df.groupBy(*stratum).agg(F.sort_array(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(value).alias("v")))).alias("_rows"))
    its = rows.withColumn("iter", F.explode(F.sequence(F.lit(first), F.lit(first + iterations - 1))))
    drawn = F.sort_array(F.transform("_rows", lambda r: F.struct(draws.key(seed, F.col("iter"), r["u"]).alias("h"), r["u"].alias("u"), r["v"].alias("v"))))
    pairs = F.explode(F.arrays_zip(F.col("_rows.u").alias("u"), F.col("_of.v").alias("v"))).alias("_p")
    out = its.withColumn("_of", drawn).select("iter", *stratum, pairs)
    return out.select("iter", *stratum, F.col("_p.u").alias(unit), F.col("_p.v").alias(value))
