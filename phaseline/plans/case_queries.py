"""Case-crossover designs and their placebos."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from ..operators import bitseries, fdr, match, panel as P
from . import standins as S
from .registry import query

R = lambda x, k=6: F.round(x, k)
def _month():
    return F.month("d")



def _num(x: str, y: str) -> str:
    """Matched odds ratio and interval of SQL counts."""
    a, b = f"({x} + 0.5::DOUBLE)", f"({y} + 0.5::DOUBLE)"
    se = f"sqrt(1 / {a} + 1 / {b})"
    return f'round({a} / {b}, 6) AS "or", round(exp(ln({a} / {b}) - {S.Z} * {se}), 6) AS or_low, round(exp(ln({a} / {b}) + {S.Z} * {se}), 6) AS or_high, round({S.sql_binomial(x, y)}, 6) AS p'


def _odds(df):
    return df.select(*(F.round(F.col(f.name), 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


_STRATA = "st AS (SELECT cell_id, month(panel.d) AS m, sum(ep * ar) AS c1, sum(ep * (1 - ar)) AS c0, sum((1 - ep) * ar) AS k1, sum((1 - ep) * (1 - ar)) AS k0 FROM panel GROUP BY 1, 2)"
_ALL = f"{S.PANEL}, {_STRATA}, dc AS (SELECT cell_id, CAST(sum(c1 * k0) AS BIGINT) AS n10, CAST(sum(c0 * k1) AS BIGINT) AS n01 FROM st GROUP BY 1)"
_DRAWN = f"""{S.PANEL}, ct AS (SELECT cell_id, month(d) AS m, d AS ctrl_d, ar AS ctrl_ar, row_number() OVER (PARTITION BY cell_id, month(d) ORDER BY md5(concat_ws('|', '42', cell_id, d)), concat_ws('|', cell_id, d)) - 1 AS r FROM panel WHERE ep = 0),
cs AS (SELECT p.cell_id, p.d AS case_d, p.ar AS case_ar, m, n FROM panel p JOIN (SELECT cell_id, m, count(*) AS n FROM ct GROUP BY 1, 2) k ON k.cell_id = p.cell_id AND m = month(p.d) WHERE ep = 1)"""


def _pairs_sql(k, strict=False):
    """CTEs ending in sp(cell_id, case_d, case_ar, ctrl_d, ctrl_ar)."""
    return f"""{_DRAWN}, {S.sql_choose('ch', 'cs', 'cell_id, case_d, case_ar, m', 'cell_id, case_d', k, 42, strict)},
sp AS (SELECT ch.cell_id, case_d, case_ar, ctrl_d, ctrl_ar FROM ch JOIN ct USING (cell_id, m, r))"""


_DISCORDANT = "CAST(sum(case_ar * (1 - ctrl_ar)) AS BIGINT) AS n10, CAST(sum((1 - case_ar) * ctrl_ar) AS BIGINT) AS n01"
_SAMPLED = f"{_pairs_sql(5)}, dc AS (SELECT cell_id, {_DISCORDANT} FROM sp GROUP BY 1)"


@query(f"WITH {_ALL} SELECT * FROM dc")
def cc_all_controls(spark, sf_dir):
    return match.discordant_all(S.panel(spark, sf_dir), ["cell_id"], _month())


def _pairs(spark, sf_dir, strict=False, k=5):
    return match.sampled_pairs(S.panel(spark, sf_dir), _month(), k, 42, strict)


@query(f"WITH RECURSIVE {_SAMPLED} SELECT * FROM dc")
def cc_sampled(spark, sf_dir):
    return match.discordant(_pairs(spark, sf_dir), ["cell_id"])


@query(f"WITH RECURSIVE {_pairs_sql(20, True)} SELECT cell_id, count(DISTINCT case_d) AS cases, {_DISCORDANT} FROM sp GROUP BY 1")
def cc_strict_k(spark, sf_dir):
    own = match.discordant(_pairs(spark, sf_dir, True, 20), ["cell_id", "case_d"])  # a row a case; pairs are made once
    return own.groupBy("cell_id").agg(F.sum("n10").alias("n10"), F.sum("n01").alias("n01"), F.count(F.lit(1)).alias("cases"))


@query(f"WITH {_ALL}, o AS (SELECT cell_id, n10, n01, {_num('n10', 'n01')} FROM dc), k AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, cell_id) AS r, count(p) OVER () AS n FROM o) SELECT cell_id, n10, n01, \"or\", or_low, or_high, p, coalesce(p <= (SELECT max(p) FROM k WHERE p <= r / n::DOUBLE * 0.05), false) AS sig FROM k")
def cc_or_grid(spark, sf_dir):
    """Odds ratio, interval, binomial p and FDR mask of every cell."""
    o = _odds(match.odds(match.discordant_all(S.panel(spark, sf_dir), ["cell_id"], _month())))
    return fdr.significant(o, "p", 0.05)


@query(f"WITH RECURSIVE {_SAMPLED}, t AS (SELECT CAST(sum(n10) AS BIGINT) AS n10, CAST(sum(n01) AS BIGINT) AS n01 FROM dc) SELECT n10, n01, {_num('n10', 'n01')} FROM t")
def cc_pooled(spark, sf_dir):
    return _odds(match.pooled(match.discordant(_pairs(spark, sf_dir), ["cell_id"])))


@query(f"WITH {S.PANEL} SELECT c.cell_id, c.d AS case_d FROM panel c WHERE ep = 1 AND NOT EXISTS (SELECT 1 FROM panel k WHERE k.cell_id = c.cell_id AND k.ep = 0 AND year(k.d) = year(c.d) AND month(k.d) = month(c.d))")
def cases_without_controls(spark, sf_dir):
    p = S.panel(spark, sf_dir).withColumn("ym", F.trunc("d", "MM"))
    return p.where("ep = 1").join(p.where("ep = 0").select("cell_id", "ym"), ["cell_id", "ym"], "left_anti").select("cell_id", F.col("d").alias("case_d"))


@query(f"WITH {S.PANEL} SELECT cell_id, panel.d AS day, coalesce(lag(ar, 3) OVER (PARTITION BY cell_id ORDER BY panel.d), 0) AS back, coalesce(lead(ar, 3) OVER (PARTITION BY cell_id ORDER BY panel.d), 0) AS ahead FROM panel")
def shifted_exposure(spark, sf_dir):
    return S.panel(spark, sf_dir).select("cell_id", F.col("d").alias("day"), P.shifted("ar", 3).alias("back"), P.shifted("ar", -3).alias("ahead"))


SHIFTS = (-30, -21, -14, -7, 7, 14, 21, 30)


def _placebo(spark, sf_dir, sources, name: str):
    """Pooled discordant counts of designs that take exposure from other days; ``sources`` makes them from the first day and the number of days."""
    first, last = S.days(spark, sf_dir)
    days = (last - first).days + 1
    months = np.array([(first + dt.timedelta(days=i)).month for i in range(days)])
    p = S.panel(spark, sf_dir).withColumn("t", F.datediff("d", F.lit(first))).withColumn("there", F.lit(1))
    series = bitseries.packed(p, ["ar", "ep", "there"])
    return match.pooled(bitseries.placebo_counts(series, sources(first, days), months, name=name), [name])


def _placebo_shift(spark, sf_dir):
    """Discordant counts with exposure taken k days off, for all k at once; k = 0 is the real design."""

    def shifts(_, days):
        at = {k: np.arange(days) - k for k in (0, *SHIFTS)}
        return {k: np.where((s >= 0) & (s < days), s, -1) for k, s in at.items()}

    return _placebo(spark, sf_dir, shifts, "k")


_PLACEBO = f"""{S.PANEL}, ks(k) AS (VALUES {', '.join(f'({k})' for k in (0, *SHIFTS))}),
x AS (SELECT p.cell_id, p.d, p.ep, k, coalesce(q.ar, 0) AS ar FROM panel p CROSS JOIN ks LEFT JOIN panel q ON q.cell_id = p.cell_id AND q.d = p.d - CAST(k AS INTEGER) AND q.ar = 1),
st AS (SELECT k, cell_id, month(x.d) AS m, sum(ep * ar) AS c1, sum(ep * (1 - ar)) AS c0, sum((1 - ep) * ar) AS k1, sum((1 - ep) * (1 - ar)) AS k0 FROM x GROUP BY 1, 2, 3),
t AS (SELECT k, CAST(sum(c1 * k0) AS BIGINT) AS n10, CAST(sum(c0 * k1) AS BIGINT) AS n01 FROM st GROUP BY 1)"""


@query(f"WITH {_PLACEBO} SELECT k, n10, n01, round((n10 + 0.5::DOUBLE) / (n01 + 0.5::DOUBLE), 6) AS \"or\" FROM t")
def placebo_time_shift(spark, sf_dir):
    return _placebo_shift(spark, sf_dir).select("k", "n10", "n01", R(F.col("or")).alias("or"))


@query(f"WITH {_PLACEBO}, o AS (SELECT k, (n10 + 0.5::DOUBLE) / (n01 + 0.5::DOUBLE) AS o FROM t) SELECT round(median(o) FILTER (WHERE k <> 0), 6) AS median, round((count(*) FILTER (WHERE k <> 0 AND o >= (SELECT o FROM o WHERE k = 0)) + 1) / (count(*) FILTER (WHERE k <> 0) + 1)::DOUBLE, 6) AS p FROM o")
def placebo_summary(spark, sf_dir):
    d = _placebo_shift(spark, sf_dir)
    real = d.where("k = 0").select(F.col("or").alias("real"))
    sham = d.where("k <> 0").join(F.broadcast(real))  # one row
    return sham.agg(R(F.median("or")).alias("median"), R((F.count_if(F.col("or") >= F.col("real")) + 1) / (F.count("or") + 1)).alias("p"))


#: Shuffles of the placebo by calendar month.
SHUFFLES = 20
_PERM = f"""tm AS (SELECT DISTINCT month(panel.d) AS m, panel.d AS day FROM panel),
pa AS (SELECT it, m, day, row_number() OVER (PARTITION BY it, m ORDER BY day) AS r FROM tm, range(0, {SHUFFLES}) q(it)),
pb AS (SELECT it, m, day AS src, row_number() OVER (PARTITION BY it, m ORDER BY md5(concat_ws('|', '42', it, day)), day) AS r FROM tm, range(0, {SHUFFLES}) q(it)),
pm AS (SELECT it, day, src FROM pa JOIN pb USING (it, m, r))"""


def _time_permutation(spark, sf_dir):
    """(iter, d, src): one permutation of days within calendar months, shared by all cells."""
    t = S.panel(spark, sf_dir).select(F.col("d").alias("unit")).distinct().withColumn("m", F.month("unit")).withColumn("src", F.col("unit"))
    return match.permuted(t, "src", ["m"], "unit", SHUFFLES, 42).select("iter", F.col("unit").alias("d"), "src")


@query(f"WITH {S.PANEL}, {_PERM} SELECT it AS iter, day, src FROM pm", ints=("iter",))
def calendar_month_permutation(spark, sf_dir):
    return _time_permutation(spark, sf_dir).select("iter", F.col("d").alias("day"), "src")


@query(f"""WITH {S.PANEL}, {_PERM}, x AS (SELECT it, p.cell_id, p.d, p.ep, coalesce(q.ar, 0) AS ar FROM panel p JOIN pm ON p.d = pm.day LEFT JOIN panel q ON q.cell_id = p.cell_id AND q.d = pm.src AND q.ar = 1),
st AS (SELECT it, cell_id, month(x.d) AS m, sum(ep * ar) AS c1, sum(ep * (1 - ar)) AS c0, sum((1 - ep) * ar) AS k1, sum((1 - ep) * (1 - ar)) AS k0 FROM x GROUP BY 1, 2, 3)
SELECT it AS iter, CAST(sum(c1 * k0) AS BIGINT) AS n10, CAST(sum(c0 * k1) AS BIGINT) AS n01, round((sum(c1 * k0) + 0.5::DOUBLE) / (sum(c0 * k1) + 0.5::DOUBLE), 6) AS "or" FROM st GROUP BY 1""", ints=("iter",))
def placebo_month_shuffle(spark, sf_dir):
    """Twenty shuffles of days within calendar months; each is an index of the time axis, read off a table of a row a day and shuffle."""

    def shuffles(first, days):
        out = {i: np.full(days, -1) for i in range(SHUFFLES)}
        for r in _time_permutation(spark, sf_dir).collect():  # of the time axis, not of cells
            out[r.iter][(r.d - first).days] = (r.src - first).days
        return out

    return _placebo(spark, sf_dir, shuffles, "iter").select("iter", "n10", "n01", R(F.col("or")).alias("or"))


@query(f"""WITH {S.PANEL}, w AS (SELECT cell_id, strftime(panel.d, '%Y-%m') AS ym, panel.d AS day, ar FROM panel),
a AS (SELECT it, cell_id, ym, day, row_number() OVER (PARTITION BY it, cell_id, ym ORDER BY day) AS r FROM w, range(0, 2) q(it)),
b AS (SELECT it, cell_id, ym, ar, row_number() OVER (PARTITION BY it, cell_id, ym ORDER BY md5(concat_ws('|', '9', it, day)), day) AS r FROM w, range(0, 2) q(it))
SELECT it AS iter, cell_id, day, ar FROM a JOIN b USING (it, cell_id, ym, r)""", ints=("iter",))
def within_month_permutation(spark, sf_dir):
    p = S.panel(spark, sf_dir).select("cell_id", F.date_format("d", "yyyy-MM").alias("ym"), F.col("d").alias("day"), "ar")
    return match.permuted(p, "ar", ["cell_id", "ym"], "day", 2, 9).select("iter", "cell_id", "day", "ar")


