"""Lag diagnostics on a dense daily panel, from its first day to its last."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitseries as B, lagdiag as L, panel as P
from . import standins as S
from .registry import query

R = lambda x, k=6: F.round(x, k)
LAGS = 15

_DENSE = S.PANEL + """, days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d, lo FROM (SELECT CAST(min(d) AS DATE) AS lo, CAST(max(d) AS DATE) AS hi FROM panel)),
dn AS (SELECT c.cell_id, g.d, CAST(date_diff('day', lo, g.d) AS INTEGER) AS t, coalesce(ar, 0) AS ar, coalesce(ep, 0) AS ep
FROM (SELECT DISTINCT cell_id FROM panel) c CROSS JOIN days g LEFT JOIN panel p ON p.cell_id = c.cell_id AND p.d = g.d)"""
_XC = _DENSE + f""", st AS (SELECT cell_id, count(*) AS n, avg(ar) AS mx, avg(ep) AS my, stddev_pop(ar) AS sx, stddev_pop(ep) AS sy FROM dn GROUP BY 1),
dx AS MATERIALIZED (SELECT cell_id, t, ar FROM dn), yk AS MATERIALIZED (SELECT cell_id, t + k AS t, k, ep FROM dn, range(-{LAGS}, {LAGS + 1}) q(k)),
xc AS (SELECT y.cell_id, y.k AS lag, CASE WHEN any_value(sx * sy) = 0 THEN 0 ELSE sum((x.ar - mx) * (y.ep - my)) / any_value(n * sx * sy) END AS r FROM yk y JOIN dx x ON x.cell_id = y.cell_id AND x.t = y.t JOIN st ON st.cell_id = y.cell_id GROUP BY 1, 2)"""


def _dense(spark, sf_dir):
    first, last = S.days(spark, sf_dir)
    return P.dense(S.panel(spark, sf_dir), first, last, ["ar", "ep"])


def _series(spark, sf_dir):
    """The panel's flags as packed bits from its first day on, and how many days there are."""
    first, last = S.days(spark, sf_dir)
    p = S.panel(spark, sf_dir).withColumn("t", F.datediff("d", F.lit(first)))
    return B.packed(p, ["ar", "ep"]), (last - first).days + 1


def _monte_carlo(spark, sf_dir):
    """Monte-Carlo p from the rows that the panel has: the calendar tells how many days of a month the dense one has."""
    first, last = S.days(spark, sf_dir)
    days = F.datediff(F.least(F.last_day("_ym"), F.lit(last)), F.greatest("_ym", F.lit(first))) + 1
    return L.monte_carlo(S.panel(spark, sf_dir).where(F.col("d").between(F.lit(first), F.lit(last))), ITERATIONS, 42, days)


def _correlated(spark, sf_dir):
    series, days = _series(spark, sf_dir)
    return B.cross_correlation(series, LAGS, days)


@query(f"WITH {_DENSE} SELECT cell_id, d AS day, t, ar, ep FROM dn")
def densified_panel(spark, sf_dir):
    d = _dense(spark, sf_dir)
    return d.withColumnRenamed("d", "day")


@query(f"WITH {_XC} SELECT cell_id, lag, round(r, 6) AS r FROM xc", ints=("lag",))
def cross_correlation(spark, sf_dir):
    return _correlated(spark, sf_dir).select("cell_id", "lag", R(F.col("r")).alias("r"))


@query(f"WITH {_XC}, z AS (SELECT cell_id, lag, CASE WHEN abs(r) > 1e-9 THEN r ELSE 0 END AS r FROM xc) SELECT a.cell_id, a.lag, round((a.r - b.r) / greatest(abs(a.r), abs(b.r), 1e-12), 8) + 0.0 AS s FROM z a JOIN z b ON a.cell_id = b.cell_id AND a.lag = -b.lag AND a.lag > 0", ints=("lag",))
def directionality(spark, sf_dir):
    r = _correlated(spark, sf_dir).withColumn("r", F.when(F.abs("r") > 1e-9, F.col("r")).otherwise(0.0))
    return L.directionality(r).select("cell_id", "lag", (R(F.col("s"), 8) + 0.0).alias("s"))


@query(f"WITH {_DENSE}, b AS (SELECT cell_id, avg(ar) AS baseline FROM dn GROUP BY 1) SELECT e.cell_id, tau, round(avg(x.ar), 6) AS eta, round(any_value(baseline), 6) AS baseline FROM dn e CROSS JOIN range(-5, 6) q(tau) JOIN dn x ON x.cell_id = e.cell_id AND x.t = e.t - tau JOIN b ON b.cell_id = e.cell_id WHERE e.ep = 1 GROUP BY 1, 2", ints=("tau",))
def eta(spark, sf_dir):
    series, days = _series(spark, sf_dir)
    return B.event_average(series, 5, days).select("cell_id", "tau", R(F.col("eta")).alias("eta"), R(F.col("baseline")).alias("baseline"))


@query(f"WITH {_DENSE} SELECT e.cell_id, k AS lag, round(avg(CASE WHEN near <= k THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT e.cell_id, e.t, min(abs(x.t - e.t)) AS near FROM dn e LEFT JOIN dn x ON x.cell_id = e.cell_id AND x.ar = 1 WHERE e.ep = 1 GROUP BY 1, 2) e CROSS JOIN range(0, 8) q(k) GROUP BY 1, 2", ints=("lag",))
def hit_cdf(spark, sf_dir):
    series, days = _series(spark, sf_dir)
    return B.hit_share(series, 7, days).select("cell_id", "lag", R(F.col("share")).alias("share"))


#: Permutations a cell at most.
ITERATIONS = 500
_PMF = "exp(" + " + ".join(S.lfact(x) for x in ("x", "n - x", "y", "n - y")) + f" - {S.lfact('n')}" + "".join(f" - {S.lfact(v)}" for v in ("j", "x - j", "y - j", "n - x - y + j")) + ")"
_MC = _DENSE + f""", rl AS (SELECT cell_id, sum(ar * ep) AS real, sum(ar) AS sx, sum(ep) AS sy FROM dn GROUP BY 1),
ms AS (SELECT cell_id, strftime(d, '%Y-%m') AS ym, count(*) AS n, CAST(sum(ar) AS BIGINT) AS x, CAST(sum(ep) AS BIGINT) AS y FROM dn GROUP BY 1, 2 HAVING sum(ar) > 0 AND sum(ep) > 0),
kd AS (SELECT DISTINCT n, x, y, greatest(0, x + y - n) AS lo, least(x, y) AS hi FROM ms),
pm AS (SELECT *, list_transform(range(lo, hi + 1), lambda j: {_PMF}) AS pmf FROM kd),
cd AS (SELECT n, x, y, lo, hi, list_transform(range(1, len(pmf) + 1), lambda k: list_sum(pmf[1:k])) AS cdf FROM pm),
dr AS (SELECT cell_id, it, lo, hi, cdf, ('0x' || substr(md5(concat_ws('|', '42', cell_id, ym, it // 4)), CAST(1 + 8 * (it % 4) AS BIGINT), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM ms JOIN cd USING (n, x, y), range(0, {ITERATIONS}) q(it)),
sm AS (SELECT cell_id, it, sum(least(hi, lo + len(list_filter(cdf, lambda c: c <= u)))) AS stat FROM dr GROUP BY 1, 2),
rn AS (SELECT cell_id, q.it + 1 AS n, (sum(CASE WHEN coalesce(stat, 0) >= real THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id ORDER BY q.it) + 1) / (q.it + 2)::DOUBLE AS p FROM rl CROSS JOIN range(0, {ITERATIONS}) q(it) LEFT JOIN sm USING (cell_id, it) WHERE sx > 0 AND sy > 0),
sp AS (SELECT *, n >= 10 AND (1.96 * sqrt(p * (1 - p) / (n + 1)) <= 0.01 OR 1.96 * sqrt(p * (1 - p) / (n + 1)) / p <= 0.1) AS stop FROM rn),
lt AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY stop DESC, CASE WHEN stop THEN n ELSE -n END) AS o FROM sp),
mc AS (SELECT rl.cell_id, p, coalesce(n, 0) AS n, coalesce(stop, false) AS converged FROM rl LEFT JOIN lt ON lt.cell_id = rl.cell_id AND o = 1)"""


@query(f"WITH {_MC} SELECT cell_id, round(p, 6) AS p, n, converged FROM mc", ints=("n",))
def seq_mc_pvalue(spark, sf_dir):
    return _monte_carlo(spark, sf_dir).withColumn("p", R(F.col("p")))


@query(f"WITH {_XC}, top AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(abs(r), 9) DESC, lag) AS o FROM xc) SELECT cell_id, lag, round(r, 6) AS r FROM top WHERE o = 1", ints=("lag",))
def strongest_lag(spark, sf_dir):
    return L.strongest(_correlated(spark, sf_dir)).select("cell_id", "lag", R(F.col("r")).alias("r"))


@query(f"WITH {_XC}, {_MC[len(_DENSE) + 2:]}, top AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(abs(r), 9) DESC, lag) AS o FROM xc), k AS (SELECT cell_id, count(DISTINCT ar) > 1 AND count(DISTINCT ep) > 1 AS ok FROM dn GROUP BY 1) SELECT cell_id, CASE WHEN ok THEN lag END AS lag, CASE WHEN ok THEN round(r, 6) END AS r, CASE WHEN ok THEN round(p, 6) END AS p FROM top JOIN mc USING (cell_id) JOIN k USING (cell_id) WHERE o = 1", ints=("lag",))
def point_diagnostics(spark, sf_dir):
    """Strongest lag and Monte-Carlo p of every cell; NULL where a series is constant."""
    series, days = _series(spark, sf_dir)
    top = L.strongest(B.cross_correlation(series, LAGS, days))
    j = top.join(_monte_carlo(spark, sf_dir).select("cell_id", "p"), "cell_id")
    ok = F.col("varies")
    return j.select("cell_id", F.when(ok, F.col("lag")).alias("lag"), F.when(ok, R(F.col("r"))).alias("r"), F.when(ok, R(F.col("p"))).alias("p"))
