"""Deterministic draws from md5, equal on any partitioning and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ``|``: a random-like, reproducible sort key."""
    cols = [F.lit(str(p)) if isinstance(p, (str, int)) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def integer(below: Column, *parts: Column | str | int) -> Column:
    """A whole number from 0 up to ``below``, from 32 bits of an md5; from 60 where those leave numbers out.

    The remainder favours small numbers by up to ``below`` / 2^32, which a stratum of millions does not show.
    """
    md5 = key(*parts)
    bits = lambda digits: F.conv(F.substring(md5, 1, digits), 16, 10).cast("long")
    return F.when(below > F.lit(1 << 32), bits(15)).otherwise(bits(8)) % below


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1)."""
    return uniforms(key(*parts), 0)


def uniforms(md5: Column, i: int) -> Column:
    """The ``i``-th of the four numbers in [0, 1) that an md5 holds."""
    return F.conv(F.substring(md5, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def choose(k: Column, below: Column, *parts: Column | str | int) -> Column:
    """``k`` different whole numbers under ``below`` as an array, by Floyd's method; ``k`` is at most ``below``."""

    def add(chosen: Column, j: Column) -> Column:
        top = below - k + j
        r = integer(top + 1, *parts, j)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, r), top).otherwise(r)))

    none = F.array().cast("array<bigint>")
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), k - 1), none, add)).otherwise(none)


def count_upto(sorted_values: Column, value: Column) -> Column:
    """How many of a sorted array's values are at most ``value``, by bisection."""
    ends = F.struct(F.lit(0).alias("l"), F.size(sorted_values).alias("h"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(sorted_values).cast("double") + 1)).cast("int") + 1)

    def halve(e: Column, _: Column) -> Column:
        mid = F.floor((e["l"] + e["h"]) / 2).cast("int")
        low = F.get(sorted_values, mid) <= value
        return F.when(e["l"] >= e["h"], e).when(low, F.struct((mid + 1).alias("l"), e["h"].alias("h"))).otherwise(F.struct(e["l"].alias("l"), mid.alias("h")))

    return F.aggregate(rounds, ends, halve, lambda e: e["l"])
