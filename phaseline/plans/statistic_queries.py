"""Exact tests, false-discovery control, heterogeneity, correlation, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.exact import binomial_half, chi2_upper, fisher, normal_two_sided, student_two_sided
from ..operators import balance, counts, fdr, match, panel as P, regress
from . import standins as S
from .registry import query

R = lambda x, k=6: F.round(x, k)
def _abcd():
    return [F.col(x) for x in "abcd"]



def _cells(spark, sf_dir):
    return counts.contingency(S.panel(spark, sf_dir), ["cell_id"])


@query(f"WITH {S.CELLS} SELECT cell_id, round({S.sql_fisher()}, 6) AS p FROM cells")
def fisher_two_sided(spark, sf_dir):
    return _cells(spark, sf_dir).select("cell_id", R(fisher(*_abcd())).alias("p"))


@query(f"WITH {S.CELLS} SELECT cell_id, round({S.sql_fisher('greater')}, 6) AS p FROM cells")
def fisher_greater(spark, sf_dir):
    return _cells(spark, sf_dir).select("cell_id", R(fisher(*_abcd(), "greater")).alias("p"))


@query(f"WITH {S.CELLS} SELECT cell_id, round({S.sql_binomial('b', 'c')}, 6) AS p FROM cells")
def binom_two_sided(spark, sf_dir):
    return _cells(spark, sf_dir).select("cell_id", R(binomial_half(F.col("b"), F.col("c"))).alias("p"))


_P = f"{S.CELLS}, t AS (SELECT cell_id, round({S.sql_fisher()}, 6) AS p FROM cells), k AS (SELECT *, row_number() OVER (ORDER BY p, cell_id) AS r, count(*) OVER () AS n FROM t)"


def _tested(spark, sf_dir):
    return _cells(spark, sf_dir).select("cell_id", R(fisher(*_abcd())).alias("p"))


@query(f"WITH {_P} SELECT cell_id, p, coalesce(p <= (SELECT max(p) FROM k WHERE p <= r / n::DOUBLE * 0.05), false) AS sig FROM k")
def bh_mask(spark, sf_dir):
    return fdr.significant(_tested(spark, sf_dir), "p", 0.05)


@query(f"WITH {_P} SELECT cell_id, p, round(least(1.0, min(p * n / r::DOUBLE) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k")
def bh_qvalues(spark, sf_dir):
    return fdr.q_values(_tested(spark, sf_dir), "p").withColumn("q", R(F.col("q")))


_SEASON = "CASE WHEN month(panel.d) IN (3,4,5) THEN 'MAM' WHEN month(panel.d) IN (6,7,8) THEN 'JJA' WHEN month(panel.d) IN (9,10,11) THEN 'SON' ELSE 'DJF' END"


@query(f"""WITH {S.PANEL}, g AS (SELECT {_SEASON} AS season, {S.ABCD} FROM panel GROUP BY 1),
y AS (SELECT ln(a::DOUBLE * d / (b::DOUBLE * c)) AS y, 1 / (1/a::DOUBLE + 1/b::DOUBLE + 1/c::DOUBLE + 1/d::DOUBLE) AS w FROM g WHERE a > 0 AND b > 0 AND c > 0 AND d > 0),
m AS (SELECT sum(w * y) / sum(w) AS m FROM y), q AS (SELECT sum(w * (y - m) * (y - m)) AS q, count(*) - 1 AS df FROM y, m)
SELECT round(q, 6) AS q, df, round(CASE WHEN q <= df THEN 1.0 ELSE {S.sql_q('(df / 2.0)', '(q / 2.0)')} END, 6) AS p, round(CASE WHEN q <= df THEN 0.0 ELSE (q - df) / q END, 6) AS i2 FROM q WHERE df >= 1""")
def cochran_q(spark, sf_dir):
    """Heterogeneity of log odds ratios over seasons."""
    p = S.panel(spark, sf_dir).withColumn("season", P.season_of(F.month("d")))
    v, se, _, _ = M.woolf_odds_ratio()
    g = counts.contingency(p, ["season"]).select(F.ln(v).alias("y"), (1 / (se * se)).alias("w")).where("y is not null")
    m = g.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    dev = F.col("y") - F.col("m")
    q = g.join(F.broadcast(m)).agg(F.sum(F.col("w") * dev * dev).alias("q"), (F.count(F.lit(1)) - 1).alias("df")).where("df >= 1")  # one row
    low = F.col("q") <= F.col("df")
    return q.select(R(F.col("q")).alias("q"), "df", R(F.when(low, F.lit(1.0)).otherwise(chi2_upper(F.col("q"), F.col("df")))).alias("p"), R(F.when(low, F.lit(0.0)).otherwise((F.col("q") - F.col("df")) / F.col("q"))).alias("i2"))


_IDX = f"{S.PANEL}, {S.MONTHLY}, j AS (SELECT mode, cell_id, lat, lon, value, ar * ep AS joint FROM panel JOIN monthly ON CAST(date_trunc('month', panel.d) AS DATE) = ym)"
_CORR = f"{_IDX}, g AS (SELECT mode, cell_id, any_value(lat) AS lat, any_value(lon) AS lon, count(*) AS n, CAST(sum(joint) AS BIGINT) AS k, corr(joint, value) AS r FROM j GROUP BY 1, 2), gr AS (SELECT mode, cell_id, lat, lon, n, k, CASE WHEN n >= 30 AND k >= 10 AND NOT isnan(r) THEN r END AS r FROM g)"


#: Times and joint events that a correlation needs.
_LEAST, _JOINT = 30, 10


def _correlated(spark, sf_dir, least=_LEAST, joint=_JOINT):
    """Point-biserial r of joint events and each monthly index; NULL under the smallest sample."""
    p = S.panel(spark, sf_dir).withColumn("ym", F.trunc("d", "MM")).withColumn("joint", F.col("ar") * F.col("ep"))
    j = p.join(S.monthly_index(spark, sf_dir), "ym")
    g = j.groupBy("mode", "cell_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.sum("joint").alias("k"), F.corr(F.col("joint").cast("double"), "value").alias("r"))
    return g.withColumn("r", F.when((F.col("n") >= least) & (F.col("k") >= joint) & ~F.isnan("r"), F.col("r")))


@query(f"WITH {_CORR} SELECT mode, cell_id, n, k, round(r, 6) AS r FROM gr")
def point_biserial(spark, sf_dir):
    return _correlated(spark, sf_dir).select("mode", "cell_id", "n", "k", R(F.col("r")).alias("r"))


def _with_p(c):
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return c.withColumn("p", student_two_sided(t, F.col("n") - 2))


_TP = f"{_CORR}, gp AS (SELECT *, CASE WHEN r IS NOT NULL THEN {S.sql_student('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')} END AS p FROM gr)"


@query(f"WITH {_TP} SELECT mode, cell_id, round(r, 6) AS r, round(p, 6) AS p FROM gp")
def point_biserial_p(spark, sf_dir):
    """Two-sided p of each correlation."""
    return _with_p(_correlated(spark, sf_dir)).select("mode", "cell_id", R(F.col("r")).alias("r"), R(F.col("p")).alias("p"))


@query(f"WITH {_TP}, bk AS (SELECT mode, cell_id, p, row_number() OVER (PARTITION BY mode ORDER BY p, cell_id) AS i, count(*) OVER (PARTITION BY mode) AS m FROM gp WHERE p IS NOT NULL), bs AS (SELECT mode, max(p) AS star FROM bk WHERE p <= i / m::DOUBLE * 0.05 GROUP BY 1), gm AS (SELECT gp.mode, cell_id, CASE WHEN p <= star THEN r END AS r FROM gp LEFT JOIN bs USING (mode)), o AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(abs(r), 9) DESC NULLS LAST, CASE mode WHEN 'ENSO' THEN 0 WHEN 'MJO' THEN 1 WHEN 'AO' THEN 2 ELSE 3 END) AS o FROM gm) SELECT cell_id, CASE WHEN r IS NULL OR r = 0 THEN 'no-dominant' ELSE mode END AS mode, round(r, 6) AS r FROM o WHERE o = 1")
def dominant_mode(spark, sf_dir):
    """The mode of the largest absolute correlation among those that pass the FDR mask of their mode; ties go by a fixed order of modes."""
    return _dominant(_masked(_with_p(_correlated(spark, sf_dir))))


def _masked(c, alpha=0.05):
    return fdr.significant(c, "p", alpha, ["mode"]).withColumn("r", F.when(F.col("sig"), F.col("r")))


def _dominant(c):
    place = F.when(F.col("mode") == "ENSO", 0).when(F.col("mode") == "MJO", 1).when(F.col("mode") == "AO", 2).otherwise(3)
    c = P.keep_one(c, ["cell_id"], [F.coalesce(-F.round(F.abs("r"), 9), F.lit(9.0)), place])
    return c.select("cell_id", F.when(F.col("r").isNull() | (F.col("r") == 0), "no-dominant").otherwise(F.col("mode")).alias("mode"), R(F.col("r")).alias("r"))


@query(f"WITH {_CORR}, {S.REGION_TABLE} SELECT mode, region, round(avg(r), 6) AS r, count(r) AS n FROM gr JOIN regions ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY 1, 2")
def region_mean_corr(spark, sf_dir):
    c = P.with_regions(_correlated(spark, sf_dir), S.regions(spark))
    return c.groupBy("mode", "region").agg(R(F.avg("r")).alias("r"), F.count("r").alias("n"))


@query(f"WITH {_CORR} SELECT mode, count(*) AS cells, count(*) FILTER (WHERE n >= 30 AND k >= 10) AS enough FROM gr GROUP BY 1")
def min_sample_filter(spark, sf_dir):
    enough = F.count_if((F.col("n") >= _LEAST) & (F.col("k") >= _JOINT))
    return _correlated(spark, sf_dir).groupBy("mode").agg(F.count(F.lit(1)).alias("cells"), enough.alias("enough"))


def _design(spark, sf_dir):
    """Outcome, exposure, trend, phase dummies (first level dropped), interactions, months."""
    p = S.panel(spark, sf_dir).withColumn("ym", F.trunc("d", "MM"))
    enso = S.month_phases(spark, sf_dir).where("mode = 'ENSO'").select("ym", "phase")
    d = p.join(enso, "ym")
    dummy = lambda c: c.cast("int")
    d = d.select("cell_id", "d", "ep", "ar", F.year("d").alias("year"), F.month("d").alias("month"), *(dummy(F.col("phase") == x).alias(f"is_{x}") for x in ("LaNina", "Neutral")))
    d = d.withColumn("trend", (F.col("year") - 1995) / 10.0)
    return d.withColumns({f"ar_{x}": F.col("ar") * F.col(f"is_{x}") for x in ("LaNina", "Neutral")} | {f"m{m}": dummy(F.col("month") == m) for m in range(2, 13)})


_TERMS = ["ar", "trend", "is_LaNina", "is_Neutral", "ar_LaNina", "ar_Neutral", *(f"m{m}" for m in range(2, 13))]


@query(f"""WITH {S.PANEL}, {S.LABELS} SELECT cell_id, panel.d AS day, ep, ar, CAST(phase = 'LaNina' AS INTEGER) AS is_LaNina, CAST(phase = 'Neutral' AS INTEGER) AS is_Neutral, ar * CAST(phase = 'LaNina' AS INTEGER) AS ar_LaNina, ar * CAST(phase = 'Neutral' AS INTEGER) AS ar_Neutral,
CAST(month(panel.d) = 7 AS INTEGER) AS m7 FROM panel JOIN mphase ON mphase.mode = 'ENSO' AND CAST(date_trunc('month', panel.d) AS DATE) = ym""")
def one_hot_design(spark, sf_dir):
    return _design(spark, sf_dir).select("cell_id", F.col("d").alias("day"), "ep", "ar", "is_LaNina", "is_Neutral", "ar_LaNina", "ar_Neutral", "m7")


@query()
def logit_interactions(spark, sf_dir):
    """Coefficients of the regression; tests hold them against Newton steps on rows."""
    w = regress.logit(_design(spark, sf_dir), "ep", _TERMS)
    return w.select("term", R(F.col("beta")).alias("beta"), R(F.col("se")).alias("se"), R(normal_two_sided(F.col("z"))).alias("p"))


@query()
def marginal_or(spark, sf_dir):
    """exp of the exposure's coefficient plus each phase's interaction; the base phase has none."""
    w = regress.logit(_design(spark, sf_dir), "ep", _TERMS)
    base = w.where("term = 'ar'").select(F.col("beta").alias("b0"))
    phases = w.where(F.col("term").isin("ar_LaNina", "ar_Neutral")).select(F.substring("term", 4, 20).alias("phase"), "beta")
    phases = phases.unionByName(base.select(F.lit("ElNino").alias("phase"), F.lit(0.0).alias("beta")))
    return phases.join(F.broadcast(base)).select("phase", R(F.exp(F.col("b0") + F.col("beta"))).alias("or"))  # one row


# --------------------------------------------------------------------------
# balance of designs, on orders: exposure 'P' or 'F' status, outcome a dear order


_DESIGN = "o AS (SELECT o_orderkey AS id, month(o_orderdate) AS month, o_custkey % 10 + 1 AS grid, CAST(o_orderstatus = 'F' AS INTEGER) AS ar, CAST(o_totalprice > 400000 AS INTEGER) AS ep FROM orders)"


def _orders(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.month("o_orderdate").alias("month"), (F.col("o_custkey") % 10 + 1).alias("grid"), (F.col("o_orderstatus") == "F").cast("int").alias("ar"), (F.col("o_totalprice") > 400000).cast("int").alias("ep"))


@query(f"WITH {_DESIGN} SELECT ep, month, round(count(*) / sum(count(*)) OVER (PARTITION BY ep), 6) AS share FROM o GROUP BY 1, 2", ints=("month",))
def composition_shares(spark, sf_dir):
    return balance.shares(_orders(spark, sf_dir), ["month"], ["ep"]).withColumn("share", R(F.col("share")))


@query(f"""WITH {_DESIGN}, p AS (SELECT month, count(*) / (SELECT count(*) FROM o WHERE ep = 1)::DOUBLE AS p FROM o WHERE ep = 1 GROUP BY 1), q AS (SELECT month, count(*) / (SELECT count(*) FROM o WHERE ep = 0)::DOUBLE AS q FROM o WHERE ep = 0 GROUP BY 1)
SELECT round(0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS tv FROM p FULL JOIN q USING (month)""")
def tv_imbalance(spark, sf_dir):
    s = balance.shares(_orders(spark, sf_dir), ["month"], ["ep"])
    return balance.total_variation(s.where("ep = 1"), s.where("ep = 0"), ["month"]).select(R(F.col("tv")).alias("tv"))


@query(f"WITH {_DESIGN} SELECT round(avg(ep) FILTER (WHERE ar = 1) / avg(ep) FILTER (WHERE ar = 0), 6) AS rr FROM o")
def traditional_rr(spark, sf_dir):
    m = lambda a: F.avg(F.when(F.col("ar") == a, F.col("ep")))
    return _orders(spark, sf_dir).agg(R(m(1) / m(0)).alias("rr"))


_MATCHED = f"""{_DESIGN}, ct AS (SELECT id AS kid, month, grid, ar AS ctrl_ar, row_number() OVER (PARTITION BY month, grid ORDER BY md5(concat_ws('|', '42', id)), id) - 1 AS r FROM o WHERE ep = 0),
cs AS (SELECT id AS cid, month, grid, ar AS case_ar, n FROM o JOIN (SELECT month, grid, count(*) AS n FROM ct GROUP BY 1, 2) USING (month, grid) WHERE ep = 1),
{S.sql_choose('ch', 'cs', 'cid, month, grid, case_ar', 'cid', 5, 42)}, mt AS (SELECT cid, case_ar, kid, ctrl_ar FROM ch JOIN ct USING (month, grid, r))"""


def _matched(spark, sf_dir):
    """Five controls of the same month and grid for every case; cases with fewer are dropped."""
    o = _orders(spark, sf_dir)
    c = o.where("ep = 1").select(F.col("id").alias("cid"), "month", "grid", F.col("ar").alias("case_ar"))
    k = o.where("ep = 0").select(F.col("id").alias("kid"), "month", "grid", F.col("ar").alias("ctrl_ar"))
    return match.drawn_controls(c, k, ["month", "grid"], 5, 42)


@query(f"WITH RECURSIVE {_MATCHED}, u AS (SELECT DISTINCT cid, case_ar FROM mt), t AS (SELECT (SELECT sum(case_ar) FROM u) + 0.5::DOUBLE AS a, (SELECT sum(1 - case_ar) FROM u) + 0.5::DOUBLE AS b, sum(ctrl_ar) + 0.5::DOUBLE AS c, sum(1 - ctrl_ar) + 0.5::DOUBLE AS d FROM mt) SELECT a, b, c, d, round((a / b) / (c / d), 6) AS \"or\" FROM t")
def matched_or(spark, sf_dir):
    m = _matched(spark, sf_dir)
    cases = m.select("cid", "case_ar").distinct().agg((F.sum("case_ar") + 0.5).alias("a"), (F.sum(1 - F.col("case_ar")) + 0.5).alias("b"))
    ctrl = m.agg((F.sum("ctrl_ar") + 0.5).alias("c"), (F.sum(1 - F.col("ctrl_ar")) + 0.5).alias("d"))
    t = cases.crossJoin(ctrl)  # one row each
    return t.select(*(F.col(x).cast("double").alias(x) for x in "abcd"), R((F.col("a") / F.col("b")) / (F.col("c") / F.col("d"))).alias("or"))


#: Permutations of the matched exposure.
PERMUTATIONS = 500


@query(f"""WITH RECURSIVE {_MATCHED}, u AS (SELECT DISTINCT cid AS id, case_ar AS ar, 1 AS is_case FROM mt UNION ALL SELECT kid, max(ctrl_ar), 0 FROM mt GROUP BY kid),
t AS (SELECT count(*) AS n, CAST(sum(ar) AS BIGINT) AS x, CAST(sum(is_case) AS BIGINT) AS y FROM u),
w AS (SELECT *, x * y / n::DOUBLE AS mid, 10 * sqrt(least(x, y, n - x, n - y)::DOUBLE) + 20 AS far FROM t),
k AS (SELECT n, x, y, unnest(range(CAST(greatest(greatest(0, x + y - n), floor(mid - far)) AS BIGINT), CAST(least(least(x, y), ceil(mid + far)) AS BIGINT) + 1)) AS j FROM w),
c AS (SELECT n, x, y, j, sum(exp({" + ".join(S.lfact(v) for v in ("x", "n - x", "y", "n - y"))} - {S.lfact("n")}{"".join(f" - {S.lfact(v)}" for v in ("j", "x - j", "y - j", "n - x - y + j"))})) OVER (ORDER BY j) AS cdf FROM k),
i AS (SELECT it, ('0x' || substr(md5(concat_ws('|', '7', it)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range(0, {PERMUTATIONS}) q(it)),
d AS (SELECT it, any_value(n) AS n, any_value(x) AS x, any_value(y) AS y, least(min(j) + count(*) FILTER (WHERE cdf <= u), max(j)) AS a FROM i CROSS JOIN c GROUP BY it),
s AS (SELECT (a + 0.5) / (y - a + 0.5) / ((x - a + 0.5) / (n - y - x + a + 0.5)) AS o FROM d)
SELECT round(quantile_cont(o::DOUBLE, 0.95), 6) AS p95, round(avg(o::DOUBLE), 6) AS mean, count(*) AS n FROM s""")
def perturbation_test(spark, sf_dir):
    """The odds ratio when exposure is shuffled over the matched rows: the exposed among the cases are hypergeometric, so each repetition is one draw."""
    m = _matched(spark, sf_dir)
    u = m.select(F.col("cid").alias("id"), F.col("case_ar").alias("ar"), F.lit(1).alias("is_case")).distinct()
    u = u.unionByName(m.groupBy(F.col("kid").alias("id")).agg(F.max("ctrl_ar").alias("ar")).withColumn("is_case", F.lit(0)))
    n = u.agg(F.count(F.lit(1)).alias("n"), F.sum("ar").cast("long").alias("x"), F.sum("is_case").cast("long").alias("y")).where("n > 0")
    a, rest = balance.hypergeometric_draws(n, PERMUTATIONS, 7), F.col("n") - F.col("y") - F.col("x")
    odd = (F.col("a") + 0.5) / (F.col("y") - F.col("a") + 0.5) / ((F.col("x") - F.col("a") + 0.5) / (rest + F.col("a") + 0.5))
    return a.select(odd.alias("o")).agg(R(F.percentile("o", F.lit(0.95))).alias("p95"), R(F.avg("o")).alias("mean"), F.count(F.lit(1)).alias("n"))
