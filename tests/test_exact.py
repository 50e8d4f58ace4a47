"""Distribution kernels against exact arithmetic."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from phaseline.functions import exact


def _fisher(a, b, c, d, greater):
    r1, c1, n = a + b, a + c, a + b + c + d
    p = {k: Fraction(math.comb(c1, k) * math.comb(n - c1, r1 - k), math.comb(n, r1)) for k in range(max(0, r1 + c1 - n), min(r1, c1) + 1)}
    return float(sum(v for k, v in p.items() if (k >= a if greater else v <= p[a] * (1 + Fraction(1, 10**7)))))


TABLES = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (1, 0, 0, 1), (200, 300, 150, 400), (5, 0, 0, 0), (30, 10, 20, 4000), (7, 7, 7, 7), (3, 1, 4, 1), (0, 9, 9, 81), (1, 0, 700, 900), (400, 100, 100, 400), (150, 350, 300, 200), (2, 2, 3, 3), (1, 2, 1, 2)]


def test_fisher(spark):
    df = spark.createDataFrame(TABLES, "a long, b long, c long, d long")
    cols = [F.col(x) for x in "abcd"]
    for r in df.select("*", exact.fisher(*cols).alias("two"), exact.fisher(*cols, "greater").alias("one")).collect():
        assert abs(r.two - _fisher(r.a, r.b, r.c, r.d, False)) < 1e-9
        assert abs(r.one - _fisher(r.a, r.b, r.c, r.d, True)) < 1e-9
    none = spark.sql("select 0L a, 0L b, 0L c, 0L d").select(exact.fisher(*cols)).first()[0]
    assert none is None


def test_binomial(spark):
    pairs = [(0, 1), (3, 9), (5, 5), (40, 25), (0, 0), (1200, 1100)]
    df = spark.createDataFrame(pairs, "x long, y long").select("*", exact.binomial_half(F.col("x"), F.col("y")).alias("p"))
    for r in df.collect():
        n, m = r.x + r.y, min(r.x, r.y)
        want = None if not n else 1.0 if r.x == r.y else min(1.0, float(2 * Fraction(sum(math.comb(n, k) for k in range(m + 1)), 2**n)))
        assert r.p is None if want is None else abs(r.p - want) < 1e-9


def test_lgamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 15.9, 16.0, 100.5, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", exact.lgamma(F.col("x")).alias("g"))
    assert all(abs(r.g - math.lgamma(r.x)) < 1e-11 * max(1, abs(math.lgamma(r.x))) for r in df.collect())


def test_chi2_even_degrees(spark):
    """For 2k degrees the tail is a finite Poisson sum; for one it is erfc."""
    rows = [(q, df) for q in (0.1, 1.0, 5.5, 20.0, 60.0) for df in (1, 2, 4, 8)]
    d = spark.createDataFrame(rows, "q double, df int").select("*", exact.chi2_upper(F.col("q"), F.col("df")).alias("p"))
    for r in d.collect():
        want = math.erfc(math.sqrt(r.q / 2)) if r.df == 1 else math.exp(-r.q / 2) * sum((r.q / 2) ** i / math.factorial(i) for i in range(r.df // 2))
        assert abs(r.p - want) < 1e-10


@pytest.mark.parametrize("df", [1, 2, 4, 30, 500])
def test_student(spark, df):
    """Against a numerical integral of the density."""
    ts = [0.0, 0.3, 1.0, 2.0, 4.0]
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    d = spark.createDataFrame([(t,) for t in ts], "t double").select("t", exact.student_two_sided(F.col("t"), F.lit(df)).alias("p"))
    for r in d.collect():
        n = 4000
        h = r.t / n
        f = [c * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
        inner = h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2])) if r.t else 0.0
        assert abs(r.p - (1 - 2 * inner)) < 1e-8


def test_tails_far_out(spark):
    """Long series, many degrees of freedom and counts beyond any array."""
    one = spark.range(1).select(
        exact.student_two_sided(F.lit(30.0), F.lit(10**6)).alias("t30"),
        exact.student_two_sided(F.lit(25.0), F.lit(10**6)).alias("t25"),
        exact.student_two_sided(F.lit(20.0), F.lit(10**6)).alias("t20"),
        exact.student_two_sided(F.lit(0.001), F.lit(10**6)).alias("t0"),
        exact.chi2_upper(F.lit(1000.0), F.lit(1000)).alias("chi"),
        exact.chi2_upper(F.lit(800.0), F.lit(1000)).alias("chi_low"),
        exact.chi2_upper(F.lit(5000.0), F.lit(2)).alias("chi_two"),
        exact.normal_two_sided(F.lit(9.0)).alias("z9"),
        exact.normal_two_sided(F.lit(8.0)).alias("z8"),
    ).first()
    # the normal tail with its first corrections for df = 10 ** 6
    for t, got in ((30, one.t30), (25, one.t25), (20, one.t20)):
        want = math.log(math.erfc(t / math.sqrt(2))) + (t**4 + t**2) / 4e6
        assert abs(math.log(got) - want) < 1e-3 * abs(want)
    assert abs(one.t0 - math.erfc(0.001 / math.sqrt(2))) < 1e-9
    even = lambda q, df: sum(math.exp(-q / 2 + i * math.log(q / 2) - math.lgamma(i + 1)) for i in range(df // 2))
    assert abs(one.chi - even(1000, 1000)) < 1e-9 and abs(one.chi - 0.494) < 1e-3 and abs(one.chi_low - even(800, 1000)) < 1e-9
    assert one.chi_two == 0.0 or one.chi_two < 1e-300
    assert abs(one.z9 / math.erfc(9 / math.sqrt(2)) - 1) < 1e-9 and abs(one.z8 / math.erfc(8 / math.sqrt(2)) - 1) < 1e-9


def test_counts_beyond_arrays(spark):
    n = 1_500_000_000
    one = spark.range(1).select(
        exact.binomial_half(F.lit(n + 60_000), F.lit(n - 60_000)).alias("b"),
        exact.binomial_half(F.lit(2 * n), F.lit(n)).alias("b0"),
        exact.binomial_half(F.lit(500_500), F.lit(499_500)).alias("m"),
        exact.fisher(F.lit(50_100_000), F.lit(49_900_000), F.lit(50_000_000), F.lit(50_000_000)).alias("f"),
        exact.fisher(F.lit(50_100), F.lit(49_900), F.lit(50_000), F.lit(50_000), "greater").alias("g"),
    ).first()
    z = (60_000 - 0.5) / math.sqrt(2 * n / 4)
    assert abs(one.b / math.erfc(z / math.sqrt(2)) - 1) < 1e-4 and one.b0 == 0.0
    ln = [math.lgamma(10**6 + 1) - math.lgamma(k + 1) - math.lgamma(10**6 - k + 1) - 10**6 * math.log(2) for k in range(490_000, 499_501)]
    assert abs(one.m / (2 * math.fsum(map(math.exp, ln))) - 1) < 1e-8
    assert abs(one.f / math.erfc(10 * math.sqrt(2) / math.sqrt(2)) - 1) < 0.01 or one.f < 1e-40
    ln_c = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    want = math.fsum(math.exp(ln_c(100_100, k) + ln_c(99_900, 100_000 - k) - ln_c(200_000, 100_000)) for k in range(50_100, 53_000))
    assert abs(one.g / want - 1) < 1e-6
