"""Effect measures as column expressions over a 2x2 table.

Counts: ``a`` exposed with outcome, ``b`` exposed without, ``c`` unexposed with
outcome, ``d`` unexposed without.  Whatever is undefined is NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0 or NULL."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def risk_exposed(a="a", b="b") -> Column:
    a, b = col(a), col(b)
    return ratio(a, a + b)


def risk_unexposed(c="c", d="d") -> Column:
    c, d = col(c), col(d)
    return ratio(c, c + d)


def risk_difference() -> Column:
    return risk_exposed() - risk_unexposed()


def risk_ratio() -> Column:
    return ratio(risk_exposed(), positive(risk_unexposed()))


def lift(cap: float | None = 100.0) -> Column:
    """Risk ratio, capped."""
    r = ratio(risk_exposed(), positive(risk_unexposed()))
    return r if cap is None else F.when(r.isNotNull(), F.least(r, F.lit(float(cap))))


def lift_interval(value: Column) -> tuple[Column, Column]:
    """Log-method interval around an already capped lift; NULL if a or c is 0."""
    a, b, c, d = map(F.col, "abcd")
    se = F.sqrt(ratio(F.lit(1), a) - ratio(F.lit(1), a + b) + ratio(F.lit(1), c) - ratio(F.lit(1), c + d))
    mid = F.ln(positive(value))
    return F.exp(mid - F.lit(Z95) * se), F.exp(mid + F.lit(Z95) * se)


def attributable_fraction() -> Column:
    p1, p0 = risk_exposed(), risk_unexposed()
    return ratio(p1 - p0, positive(p1))


def population_attributable_fraction() -> Column:
    a, b, c, d = map(F.col, "abcd")
    n = a + b + c + d
    share = ratio(a + c, n)
    return ratio(share - ratio(c + d, n) * risk_unexposed(), positive(share))


def odds_ratio_fallback() -> Column:
    """a d / (b c); 0.5 is added to all four if b c is 0."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    h = F.lit(0.5)
    return F.when(b * c == 0, (a + h) * (d + h) / ((b + h) * (c + h))).otherwise(a * d / F.when(b * c != 0, b * c))


def woolf_odds_ratio() -> tuple[Column, Column, Column, Column]:
    """(odds ratio, standard error of its log, low, high); NULL if any count is 0."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    full = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    value = F.when(full, ratio(a * d, b * c))
    se = F.when(full, F.sqrt(ratio(F.lit(1), a) + ratio(F.lit(1), b) + ratio(F.lit(1), c) + ratio(F.lit(1), d)))
    return value, se, F.exp(F.ln(value) - F.lit(1.96) * se), F.exp(F.ln(value) + F.lit(1.96) * se)


def matched_odds_ratio(n10: Column, n01: Column) -> tuple[Column, Column, Column]:
    """(odds ratio, low, high) of discordant pair counts, 0.5 added to each."""
    x, y = n10.cast("double") + 0.5, n01.cast("double") + 0.5
    se = F.sqrt(1 / x + 1 / y)
    return x / y, F.exp(F.ln(x / y) - F.lit(Z95) * se), F.exp(F.ln(x / y) + F.lit(Z95) * se)


def delta_intervals() -> dict[str, Column]:
    """Pooled RR, AF, PAF and RD with delta-method intervals.

    0.5 replaces nothing but is added to each count that is 0; the exposed share
    comes from the raw counts.  All NULL where a margin is empty.
    """
    raw = {x: F.col(x).cast("double") for x in "abcd"}
    a, b, c, d = (F.when(raw[x] == 0, F.lit(0.5)).otherwise(raw[x]) for x in "abcd")
    n1, n0 = a + b, c + d
    ok = (raw["a"] + raw["b"] > 0) & (raw["c"] + raw["d"] > 0)
    p1, p0 = a / n1, c / n0
    share = ratio(raw["a"] + raw["b"], raw["a"] + raw["b"] + raw["c"] + raw["d"])
    rr = p1 / p0
    se_log = F.sqrt(1 / a - 1 / n1 + 1 / c - 1 / n0)
    z = F.lit(Z95)
    af, se_af = 1 - 1 / rr, se_log / rr
    den = 1 + share * (rr - 1)
    paf, se_paf = share * (rr - 1) / den, se_log * share * rr / (den * den)
    rd, se_rd = p1 - p0, F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    out = {"rr": rr, "rr_low": F.exp(F.ln(rr) - z * se_log), "rr_high": F.exp(F.ln(rr) + z * se_log)}
    for name, mid, se in (("af", af, se_af), ("paf", paf, se_paf), ("rd", rd, se_rd)):
        out |= {name: mid, f"{name}_low": mid - z * se, f"{name}_high": mid + z * se}
    return {k: F.when(ok, v) for k, v in out.items()}


def rounded(columns: dict[str, Column], places: int = 6) -> list[Column]:
    return [F.round(v, places).alias(k) for k, v in columns.items()]
