"""Counts, effect measures and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.exact import fisher
from ..operators import counts, panel as P, thresholds as T
from . import standins as S
from .registry import query

R = lambda x, k=6: F.round(x, k)


@query(f"WITH {S.CELLS} SELECT cell_id, a, b, c, d, round({S.P1}, 6) AS p1, round({S.P0}, 6) AS p0, round({S.LIFT}, 6) AS lift, round({S.AF}, 6) AS af, round({S.PAF}, 6) AS paf FROM cells")
def cell_contingency_lift(spark, sf_dir):
    c = counts.contingency(S.panel(spark, sf_dir), ["cell_id"])
    return c.select("cell_id", *"abcd", R(M.risk_exposed()).alias("p1"), R(M.risk_unexposed()).alias("p0"), R(M.lift()).alias("lift"), R(M.attributable_fraction()).alias("af"), R(M.population_attributable_fraction()).alias("paf"))


@query(f"WITH {S.PANEL}, n AS (SELECT cell_id, count(*) AS n FROM panel GROUP BY 1), e AS (SELECT cell_id, CAST(sum(ar*ep) AS BIGINT) AS a, CAST(sum(ar) AS BIGINT) AS x, CAST(sum(ep) AS BIGINT) AS y FROM panel WHERE ar = 1 OR ep = 1 GROUP BY 1) SELECT cell_id, a, x - a AS b, y - a AS c, n - x - y + a AS d FROM e JOIN n USING (cell_id)")
def sparse_identity_counts(spark, sf_dir):
    p = S.panel(spark, sf_dir)
    n = p.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.sparse_contingency(p.where("ar = 1 or ep = 1").join(n, "cell_id"), ["cell_id"], "n")


@query(f"WITH {S.CELLS} SELECT CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c, CAST(sum(d) AS BIGINT) AS d FROM cells")
def pooled_contingency(spark, sf_dir):
    return counts.summed(counts.contingency(S.panel(spark, sf_dir), ["cell_id"]), [])


@query(f"WITH {S.TIMES} SELECT * FROM times")
def time_counts(spark, sf_dir):
    return S.time_counts(S.panel(spark, sf_dir))


@query(f"WITH {S.PANEL} SELECT CASE WHEN month(panel.d) IN (3,4,5) THEN 'MAM' WHEN month(panel.d) IN (6,7,8) THEN 'JJA' WHEN month(panel.d) IN (9,10,11) THEN 'SON' ELSE 'DJF' END AS season, {S.ABCD} FROM panel GROUP BY 1")
def season_counts(spark, sf_dir):
    p = S.panel(spark, sf_dir).withColumn("season", P.season_of(F.month("d")))
    return counts.contingency(p, ["season"])


@query(f"WITH {S.PANEL}, {S.REGION_TABLE} SELECT region, {S.ABCD} FROM panel JOIN regions ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY 1")
def region_bbox_counts(spark, sf_dir):
    return counts.contingency(P.with_regions(S.panel(spark, sf_dir), S.regions(spark)), ["region"])


@query(f"WITH {S.PANEL}, {S.REGION_TABLE}, {S.SEASON_TABLE} SELECT region, season, {S.ABCD} FROM panel JOIN regions ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max JOIN seasons ON month(panel.d) = seasons.month GROUP BY CUBE (region, season)")
def counts_cube(spark, sf_dir):
    p = P.with_regions(S.panel(spark, sf_dir), S.regions(spark)).withColumn("month", F.month("d")).join(S.seasons(spark), "month")
    return counts.cube(p, ["region", "season"])


@query(f"WITH {S.PANEL} SELECT round(avg(ar), 6) AS ar_density, round(avg(ep), 6) AS ep_density FROM panel")
def density(spark, sf_dir):
    return S.panel(spark, sf_dir).agg(R(F.avg("ar")).alias("ar_density"), R(F.avg("ep")).alias("ep_density"))


@query(f"WITH {S.CELLS}, m AS (SELECT {S.LIFT} AS lift FROM cells) SELECT round(avg(lift), 6) AS mean, round(min(lift), 6) AS least, round(max(lift), 6) AS most, count(lift) AS n FROM m")
def summary_stats(spark, sf_dir):
    m = counts.contingency(S.panel(spark, sf_dir), ["cell_id"]).select(M.lift().alias("lift"))
    return m.agg(R(F.avg("lift")).alias("mean"), R(F.min("lift")).alias("least"), R(F.max("lift")).alias("most"), F.count("lift").alias("n"))


@query(f"WITH {S.CELLS}, m AS (SELECT 10 + (cell_id // 40) * 0.25::DOUBLE AS lat, {S.LIFT} AS x FROM cells) SELECT round(sum(x * cos(radians(lat))) FILTER (WHERE x IS NOT NULL) / sum(cos(radians(lat))) FILTER (WHERE x IS NOT NULL), 6) AS mean FROM m")
def area_weighted_mean(spark, sf_dir):
    m = S.located(counts.contingency(S.panel(spark, sf_dir), ["cell_id"])).withColumn("x", M.lift())
    w = F.when(F.col("x").isNotNull(), F.cos(F.radians("lat")))
    return m.agg(R(F.sum(F.col("x") * w) / F.sum(w)).alias("mean"))


@query(f"WITH {S.CELLS} SELECT round(avg(a / nullif(a + c, 0)::DOUBLE), 6) AS exposed_share FROM cells")
def outcome_exposed_share(spark, sf_dir):
    c = counts.contingency(S.panel(spark, sf_dir), ["cell_id"])
    return c.agg(R(F.avg(M.ratio(F.col("a"), F.col("a") + F.col("c")))).alias("exposed_share"))


@query(f"WITH {S.CELLS}, m AS (SELECT cell_id, {S.LIFT} AS lift FROM cells) SELECT cell_id, round(least(lift, (SELECT quantile_cont(lift, 0.95) FROM m)), 6) AS lift FROM m")
def lift_percentile_cap(spark, sf_dir):
    m = counts.contingency(S.panel(spark, sf_dir), ["cell_id"]).select("cell_id", M.lift().alias("lift"))
    top = T.exact_quantile(m, "lift", 0.95, name="top").agg(F.max("top").alias("top"))
    return m.join(F.broadcast(top)).select("cell_id", R(F.when(F.col("lift").isNotNull(), F.least("lift", "top"))).alias("lift"))  # one row


@query(f"""WITH {S.CELLS}, m AS (SELECT *, {S.LIFT} AS lift, sqrt(1 / nullif(a, 0)::DOUBLE - 1 / nullif(a + b, 0)::DOUBLE + 1 / nullif(c, 0)::DOUBLE - 1 / nullif(c + d, 0)::DOUBLE) AS se FROM cells)
SELECT cell_id, round(lift, 6) AS lift, round(CASE WHEN lift > 0 THEN exp(ln(lift) - {S.Z} * se) END, 6) AS low, round(CASE WHEN lift > 0 THEN exp(ln(lift) + {S.Z} * se) END, 6) AS high FROM m""")
def lift_ci(spark, sf_dir):
    c = counts.contingency(S.panel(spark, sf_dir), ["cell_id"]).withColumn("lift", M.lift())
    low, high = M.lift_interval(F.col("lift"))
    return c.select("cell_id", R(F.col("lift")).alias("lift"), R(low).alias("low"), R(high).alias("high"))


@query(f"""WITH {S.CELLS}, m AS (SELECT cell_id, a::DOUBLE a, b::DOUBLE b, c::DOUBLE c, d::DOUBLE d, a > 0 AND b > 0 AND c > 0 AND d > 0 AS ok FROM cells),
w AS (SELECT cell_id, CASE WHEN ok THEN a * d / (b * c) END AS o, CASE WHEN ok THEN sqrt(1/a + 1/b + 1/c + 1/d) END AS se FROM m)
SELECT cell_id, round(o, 6) AS "or", round(se, 6) AS se, round(exp(ln(o) - 1.96 * se), 6) AS low, round(exp(ln(o) + 1.96 * se), 6) AS high FROM w""")
def woolf_or(spark, sf_dir):
    v, se, low, high = M.woolf_odds_ratio()
    return counts.contingency(S.panel(spark, sf_dir), ["cell_id"]).select("cell_id", R(v).alias("or"), R(se).alias("se"), R(low).alias("low"), R(high).alias("high"))


@query(f'WITH {S.CELLS} SELECT cell_id, round(CASE WHEN b * c = 0 THEN (a + 0.5::DOUBLE) * (d + 0.5::DOUBLE) / ((b + 0.5::DOUBLE) * (c + 0.5::DOUBLE)) ELSE a::DOUBLE * d / (b::DOUBLE * c) END, 6) AS "or" FROM cells')
def or_fallback(spark, sf_dir):
    return counts.contingency(S.panel(spark, sf_dir), ["cell_id"]).select("cell_id", R(M.odds_ratio_fallback()).alias("or"))


@query(f"WITH {S.PANEL}, {S.REGION_TABLE}, t AS (SELECT region, {S.ABCD} FROM panel JOIN regions ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY 1) SELECT region, a, b, c, d, {S.sql_delta_list()} FROM t")
def delta_ci_pooled(spark, sf_dir):
    c = counts.contingency(P.with_regions(S.panel(spark, sf_dir), S.regions(spark)), ["region"])
    return c.select("region", *"abcd", *M.rounded(M.delta_intervals()))


@query(f"WITH {S.CELLS} SELECT cell_id, round({S.P1} - {S.P0}, 6) AS rd, round(({S.P1}) / nullif({S.P0}, 0), 6) AS rr, round({S.AF}, 6) AS af, round({S.PAF}, 6) AS paf FROM cells")
def guarded_measures(spark, sf_dir):
    c = counts.contingency(S.panel(spark, sf_dir), ["cell_id"])
    return c.select("cell_id", R(M.risk_difference()).alias("rd"), R(M.risk_ratio()).alias("rr"), R(M.attributable_fraction()).alias("af"), R(M.population_attributable_fraction()).alias("paf"))


@query(f"WITH {S.CELLS}, m AS (SELECT cell_id, {S.PAF} AS paf, {S.sql_fisher('greater')} AS p FROM cells) SELECT cell_id, round(p, 6) AS p, CASE WHEN p < 0.05 THEN round(paf, 6) END AS paf FROM m")
def masked_metrics(spark, sf_dir):
    c = counts.contingency(S.panel(spark, sf_dir), ["cell_id"]).withColumn("p", fisher(*map(F.col, "abcd"), "greater"))
    return c.select("cell_id", R(F.col("p")).alias("p"), F.when(F.col("p") < 0.05, R(M.population_attributable_fraction())).alias("paf"))


@query(f"WITH {S.CELLS}, m AS (SELECT {S.PAF} AS paf, {S.sql_fisher('greater')} AS p FROM cells) SELECT round(avg(paf) FILTER (WHERE p < 0.05), 6) AS mean_paf, count(*) FILTER (WHERE p < 0.05) AS n FROM m")
def sig_mean_paf(spark, sf_dir):
    c = counts.contingency(S.panel(spark, sf_dir), ["cell_id"]).select(M.population_attributable_fraction().alias("paf"), fisher(*map(F.col, "abcd"), "greater").alias("p"))
    sig = F.col("p") < 0.05
    return c.agg(R(F.avg(F.when(sig, F.col("paf")))).alias("mean_paf"), F.count(F.when(sig, 1)).alias("n"))


@query(f"WITH {S.CELLS}, m AS (SELECT cell_id, {S.LIFT} AS lift FROM cells), n AS (SELECT cell_id, {S.AF} AS af FROM cells) SELECT cell_id, round(lift, 6) AS lift, round(af, 6) AS af FROM m JOIN n USING (cell_id)")
def metric_fields_join(spark, sf_dir):
    c = counts.contingency(S.panel(spark, sf_dir), ["cell_id"])
    return c.select("cell_id", R(M.lift()).alias("lift")).join(c.select("cell_id", R(M.attributable_fraction()).alias("af")), "cell_id")


@query(f"WITH {S.PANEL}, t AS (SELECT {S.ABCD} FROM panel) SELECT unnest(['cells', 'cell_days', 'exposed', 'outcomes', 'joint']) AS metric, unnest([(SELECT count(DISTINCT cell_id) FROM panel), a + b + c + d, a + b, a + c, a]) AS value FROM t")
def report_summary(spark, sf_dir):
    """A text report as rows of (metric, value)."""
    p = S.panel(spark, sf_dir)
    t = p.agg(F.count_distinct("cell_id").alias("cells"), *counts.count_columns())
    t = t.select("cells", (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("cell_days"), (F.col("a") + F.col("b")).alias("exposed"), (F.col("a") + F.col("c")).alias("outcomes"), F.col("a").alias("joint"))
    return t.unpivot([], t.columns, "metric", "value")


_COVER = """e AS (SELECT date_trunc('hour', ts) AS t, user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS ar FROM events),
s AS (SELECT t, sum(ar) AS flags, count(*) AS n, count(DISTINCT CASE WHEN ar = 1 THEN user_id END) AS objects FROM e GROUP BY t)"""


@query(f"WITH {_COVER} SELECT CAST(sum(flags) AS BIGINT) AS flags, round(100.0 * sum(flags) / sum(n), 6) AS percent, CAST(max(objects) AS BIGINT) AS most_objects, count(*) FILTER (WHERE flags = 0) AS zero_steps, count(*) FILTER (WHERE flags >= 4) AS wide_steps, count(DISTINCT CASE WHEN flags >= 4 THEN CAST(t AS DATE) END) AS wide_days FROM s")
def ar_coverage(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("t"), "user_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("ar"))
    s = e.groupBy("t").agg(F.sum("ar").alias("flags"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("ar") == 1, F.col("user_id"))).alias("objects"))
    wide = F.col("flags") >= 4
    return s.agg(F.sum("flags").alias("flags"), R(100.0 * F.sum("flags") / F.sum("n")).alias("percent"), F.max("objects").alias("most_objects"), F.count_if(F.col("flags") == 0).alias("zero_steps"), F.count_if(wide).alias("wide_steps"), F.count_distinct(F.when(wide, F.to_date("t"))).alias("wide_days"))


@query(f"WITH {S.PANEL} SELECT panel.d AS day, min(ar) AS value, count(*) AS n FROM panel GROUP BY 1 HAVING min(ar) = max(ar)")
def uniform_steps(spark, sf_dir):
    g = S.panel(spark, sf_dir).groupBy(F.col("d").alias("day")).agg(F.min("ar").alias("value"), F.max("ar").alias("_m"), F.count(F.lit(1)).alias("n"))
    return g.where("value = _m").drop("_m")


_WINDOWS = """b AS (SELECT CAST(min(panel.d) AS DATE) AS lo, CAST(max(panel.d) AS DATE) AS hi FROM panel), r AS (SELECT unnest(range(0, date_diff('day', lo, hi) // 91 + 1)) AS i, lo FROM b),
w AS (SELECT i, CAST(lo + to_days(CAST(i * 91 AS INTEGER)) AS DATE) AS start, CAST(lo + to_days(CAST(i * 91 + 90 AS INTEGER)) AS DATE) AS stop FROM r)"""


@query(f"WITH {S.PANEL}, {_WINDOWS}, c AS (SELECT i, start, cell_id, {S.ABCD} FROM panel JOIN w ON panel.d BETWEEN start AND stop GROUP BY 1, 2, 3) SELECT i, start, round(avg({S.LIFT}), 6) AS lift FROM c GROUP BY 1, 2")
def window90_lift(spark, sf_dir):
    return _window90(spark, sf_dir).select("i", "start", R(F.col("lift")).alias("lift"))


def _window90(spark, sf_dir):
    """Mean lift over cells in 90-day windows from the panel's first day on, both ends included, a day apart.

    A window's number follows from the day, so the assignment is no range join.
    """
    first = F.lit(S.days(spark, sf_dir)[0])
    p = S.panel(spark, sf_dir).withColumn("i", F.floor(F.datediff("d", first) / 91))
    c = counts.contingency(p, ["i", "cell_id"]).withColumn("lift", M.lift())
    return c.groupBy("i").agg(F.avg("lift").alias("lift")).withColumn("start", F.date_add(first, (F.col("i") * 91).cast("int")))


@query(f"WITH {S.PANEL}, {_WINDOWS}, c AS (SELECT i, start, cell_id, {S.ABCD} FROM panel JOIN w ON panel.d BETWEEN start AND stop GROUP BY 1, 2, 3), m AS (SELECT start, avg({S.LIFT}) AS lift FROM c GROUP BY 1), x AS (SELECT date_diff('day', (SELECT lo FROM b), start) / 365.25 AS x, lift FROM m WHERE lift IS NOT NULL) SELECT CASE WHEN count(*) >= 2 THEN round(regr_slope(lift, x), 6) END AS slope, CASE WHEN count(*) >= 2 THEN round(regr_intercept(lift, x), 6) END AS intercept, count(*) AS n FROM x")
def lift_trend(spark, sf_dir):
    m = _window90(spark, sf_dir).where("lift is not null").withColumn("x", F.datediff("start", F.lit(S.days(spark, sf_dir)[0])) / 365.25)
    many = F.count(F.lit(1)) >= 2
    return m.agg(F.when(many, R(F.regr_slope("lift", "x"))).alias("slope"), F.when(many, R(F.regr_intercept("lift", "x"))).alias("intercept"), F.count(F.lit(1)).alias("n"))
