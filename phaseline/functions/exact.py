"""Exact tests and distribution tails as column expressions.

Spark has no log-gamma, so it is built here from a shifted Stirling series
(relative error under 1e-13).  Tails are series of ratios or continued fractions
in higher-order functions, as many steps as double precision needs, so no test
leaves the JVM or holds a support.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lgamma(z: Column) -> Column:
    """ln Gamma(z), z > 0."""
    z = z.cast("double")
    shift = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7)
    s = F.when(z < 16, z + 8).otherwise(z)
    r = 1 / s
    r2 = r * r
    tail = r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 * (1 / 1680 - r2 * (1 / 1188)))))
    core = (s - 0.5) * F.ln(s) - s + F.lit(0.5 * math.log(2 * math.pi)) + tail
    return core - F.when(z < 16, F.ln(shift)).otherwise(F.lit(0.0))


#: ln n! of the numbers that Stirling's formula is too coarse for.
_SMALL = [math.lgamma(n + 1) for n in range(16)]


def ln_factorial(n: Column) -> Column:
    """ln n! of a whole number: from a list, or by Stirling's series."""
    x = n.cast("double") + 1
    r2 = 1 / (x * x)
    far = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 / 1680))) / x
    return F.when(x > len(_SMALL), far).otherwise(F.get(F.expr(f"array({', '.join(f'{v!r}D' for v in _SMALL)})"), n.cast("int")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _series(ratio, steps: Column) -> Column:
    """1 + r(1) + r(1) r(2) + ...: a tail relative to its first term; ``ratio`` is 0 from the end of the support on."""
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    more = lambda acc, j: let(acc["t"] * F.greatest(ratio(j), F.lit(0.0)), lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s")))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long"))), zero, more, lambda acc: acc["s"])


def _steps(spread: Column) -> Column:
    """Terms after which a tail of a distribution of this variance has vanished in double precision."""
    return (60 + 9 * F.sqrt(spread)).cast("long")


def hypergeometric_ln(k: Column, r1: Column, c1: Column, n: Column) -> Column:
    """ln of the probability of k in a 2x2 table with margins r1, c1 of n, but for the part without k."""
    return -(ln_factorial(k) + ln_factorial(r1 - k) + ln_factorial(c1 - k) + ln_factorial(n - r1 - c1 + k))


def hypergeometric_cdf(n: Column, x: Column, y: Column) -> Column:
    """Cumulative probabilities of the joint count of x and y among n, from its least value on; for small n."""
    low, high = F.greatest(F.lit(0).cast("long"), x + y - n), F.least(x, y)
    fixed = ln_factorial(x) + ln_factorial(n - x) + ln_factorial(y) + ln_factorial(n - y) - ln_factorial(n)
    every = let(fixed, lambda f: F.transform(F.sequence(low, high), lambda k: F.exp(f + hypergeometric_ln(k, x, y, n))))
    return let(every, lambda e: F.transform(e, lambda _, i: F.aggregate(F.slice(e, F.lit(1), i + 1), F.lit(0.0), lambda a, b: a + b)))


def fisher(a: Column, b: Column, c: Column, d: Column, alternative: str = "two-sided") -> Column:
    """Fisher's exact p; NULL for an empty table.  Two-sided sums what is no likelier than observed.

    Tails are summed outward by ratios of neighbours until they vanish, and the
    other side's first value is found by bisection, so the time grows with the
    root of the counts and no support is held.
    """
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    r1, c1, n = a + b, a + c, a + b + c + d
    mode = lambda r, col, size: F.floor((r + 1).cast("double") * (col + 1) / (size + 2))
    # seen from the side on which the observed value lies: above the mode, or the table with its columns swapped
    below = a < mode(r1, c1, n)
    side = F.struct(below.alias("below"), F.when(below, b).otherwise(a).alias("a"), F.when(below, b + d).otherwise(c1).alias("c"), r1.alias("r"), n.alias("n"))

    def placed(m: Column) -> Column:
        r, col, size = m["r"], m["c"], m["n"]
        fixed = ln_factorial(r) + ln_factorial(size - r) + ln_factorial(col) + ln_factorial(size - col) - ln_factorial(size)
        spread = F.least(r, col, size - r, size - col).cast("double")
        return F.struct(m["below"].alias("below"), m["a"].alias("a"), r.alias("r"), col.alias("c"), size.alias("n"), fixed.alias("f"), mode(r, col, size).alias("m"), F.greatest(F.lit(0).cast("long"), r + col - size).alias("lo"), _steps(spread).alias("steps"))

    def summed(m: Column) -> Column:
        r, col, size = m["r"].cast("double"), m["c"].cast("double"), m["n"].cast("double")
        at = lambda k: m["f"] + hypergeometric_ln(k, m["r"], m["c"], m["n"])
        upward = lambda k: _series(lambda j: (r - k - j + 1) * (col - k - j + 1) / ((k + j) * (size - r - col + k + j)), m["steps"])
        down = lambda k: F.exp(at(k)) * _series(lambda j: (k - j + 1) * (size - r - col + k - j + 1) / ((r - k + j) * (col - k + j)), m["steps"])
        if alternative == "greater":
            # swapped, values from the observed one up are values down to it
            return let(m["a"] + m["below"].cast("int"), lambda k: let(F.exp(at(k)) * upward(k), lambda p: F.when(m["below"], 1 - F.coalesce(p, F.lit(0.0))).otherwise(p)))  # beyond the support: nothing

        def other(limit: Column) -> Column:
            """The largest value up to the mode that is no likelier than ``limit``; lo - 1 where there is none."""
            rounds = F.sequence(F.lit(1), F.ceil(F.log2((m["m"] - m["lo"] + 3).cast("double"))).cast("int") + 1)
            ends = F.struct((m["lo"] - 1).alias("l"), (m["m"] + 1).alias("h"))

            def halve(e: Column, _: Column) -> Column:
                mid = F.floor((e["l"] + e["h"]) / 2)
                return F.when(e["h"] - e["l"] < 2, e).otherwise(let(mid, lambda k: F.when(at(k) <= limit, F.struct(k.alias("l"), e["h"].alias("h"))).otherwise(F.struct(e["l"].alias("l"), k.alias("h")))))

            return F.aggregate(rounds, ends, halve, lambda e: e["l"])

        above = let(at(m["a"]), lambda p: F.struct(p.alias("p"), other(p + 1e-7).alias("k")))
        tails = let(above, lambda v: F.when(v["k"] >= m["m"], F.lit(1.0)).otherwise(F.exp(v["p"]) * upward(m["a"]) + F.when(v["k"] >= m["lo"], down(v["k"])).otherwise(0.0)))
        return F.when(m["a"] <= m["m"], F.lit(1.0)).otherwise(tails)

    return F.when(n > 0, F.least(F.lit(1.0), let(let(side, placed), summed)))


def _stirling_error(n: Column) -> Column:
    """ln n! less Stirling's formula, for whole n > 0."""
    n = n.cast("double")
    r2 = 1 / (n * n)
    far = (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 * (1 / 1680 - r2 / 1188)))) / n
    return F.when(n > 15, far).otherwise(ln_factorial(n) - (n + 0.5) * F.ln(n) + n - 0.5 * math.log(2 * math.pi))


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x without loss where the two are close."""
    e = (x - mean) / (x + mean)
    term = lambda k: F.pow(e, F.lit(2 * k)) / (2 * k + 1)
    near = (x - mean) * e + 2 * x * e * sum((term(k) for k in range(1, 9)), F.lit(0.0))
    return F.when(F.abs(e) < 0.1, near).otherwise(x * F.ln(x / mean) + mean - x)


def binomial_half(x: Column, y: Column) -> Column:
    """Two-sided binomial p of x against y at one half; NULL if both are 0.

    The lower tail is its last probability, in saddle-point form, times a series
    of ratios, so any number of pairs keeps its precision and takes little room.
    """
    n, m = x.cast("double") + y.cast("double"), F.least(x, y).cast("double")

    def tail(v: Column) -> Column:
        n, m = v["n"], v["m"]
        ln = _stirling_error(n) - _stirling_error(m) - _stirling_error(n - m) - _deviance(m, n / 2) - _deviance(n - m, n / 2) + 0.5 * F.ln(n / (2 * math.pi * m * (n - m)))
        # ratios only shrink, so the first one bounds how many terms count
        few = (60 + 40 / F.ln((n - m + 1) / m)).cast("long")
        return 2 * F.exp(ln) * _series(lambda j: (m - j + 1) / (n - m + j), F.least(_steps(n), few))

    p = F.when(m == 0, 2 * F.exp(-n * math.log(2))).otherwise(let(F.struct(n.alias("n"), m.alias("m")), tail))
    return F.when(n > 0, F.when(x == y, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p)))


#: Stands for 0 in a continued fraction's denominators.
_TINY = 1e-300


def _fraction(first: Column, term, steps: Column) -> Column:
    """1 / (b0 + a1 / (b1 + a2 / (b2 + ...))) for ``term(i)`` = (a_i, b_i) and b0 = ``first``, by Lentz's method."""
    some = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    start = F.struct((1 / some(first)).alias("d"), F.lit(1 / _TINY).alias("c"), (1 / some(first)).alias("h"))

    def step(s: Column, i: Column) -> Column:
        a, b = term(i.cast("double"))
        return let(F.struct((1 / some(a * s["d"] + b)).alias("d"), some(b + a / s["c"]).alias("c")), lambda v: F.struct(v["d"].alias("d"), v["c"].alias("c"), (s["h"] * v["d"] * v["c"]).alias("h")))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, step, lambda s: s["h"])


def gamma_upper(s: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma Q(s, x): one less a series below s + 1, a continued fraction from there on."""

    def value(v: Column) -> Column:
        s, x = v["s"], v["x"]
        front, steps = s * F.ln(x) - x, _steps(F.greatest(s, x))
        lower = F.exp(front - lgamma(s + 1)) * _series(lambda j: x / (s + j), steps)
        upper = F.exp(front - lgamma(s)) * _fraction(x + 1 - s, lambda i: (-i * (i - s), x + 1 - s + 2 * i), steps)
        return F.when(x < s + 1, 1 - lower).otherwise(upper)

    q = let(F.struct(s.cast("double").alias("s"), x.cast("double").alias("x")), value)
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), q)))


def chi2_upper(q: Column, df: Column) -> Column:
    """P(chi-square with df degrees of freedom > q)."""
    return gamma_upper(df.cast("double") / 2, q.cast("double") / 2)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|)."""
    return chi2_upper(z * z, F.lit(1))


def _beta_tail(ln_x: Column, ln_y: Column, x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) for x up to (a + 1) / (a + b + 2), with ln x and ln(1 - x)."""
    front = F.exp(a * ln_x + b * ln_y + lgamma(a + b) - lgamma(a) - lgamma(b)) / a

    def term(i: Column) -> tuple[Column, Column]:
        k = F.floor(i / 2)
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return F.when(i % 2 == 0, even).otherwise(odd), F.lit(1.0)

    return front * _fraction(F.lit(1.0), term, _steps(F.greatest(a, b)))


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with df degrees of freedom; small tails are computed as such, never as a difference."""

    def value(w: Column) -> Column:
        v, t2, half = w["v"], w["t2"], F.lit(0.5)
        y = t2 / (v + t2)
        ln_x, ln_y = -F.log1p(t2 / v), F.ln(t2) - F.ln(v + t2)
        far = _beta_tail(ln_x, ln_y, 1 - y, v / 2, half)
        near = 1 - _beta_tail(ln_y, ln_x, y, half, v / 2)
        return F.when(y > 1.5 / (v / 2 + 2.5), far).otherwise(near)

    t = t.cast("double")
    p = let(F.struct(df.cast("double").alias("v"), (t * t).alias("t2")), value)
    return F.when(t == 0, F.lit(1.0)).when(t.isNotNull() & df.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
