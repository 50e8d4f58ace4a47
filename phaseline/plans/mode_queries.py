"""Index phases: labels, summaries, lag scan, bootstrap contrasts, rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.exact import fisher
from ..operators import counts, fdr, modes, panel as P
from . import standins as S
from .registry import query

R = lambda x, k=6: F.round(x, k)


@query(f"WITH {S.MONTHLY} SELECT mode, ym, value, CASE WHEN value > 0.5 THEN 'Positive' WHEN value < -0.5 THEN 'Negative' WHEN value IS NOT NULL THEN 'Neutral' END AS phase FROM monthly")
def bucket_labels(spark, sf_dir):
    return S.monthly_index(spark, sf_dir).withColumn("phase", modes.phase_of(F.col("value")))


@query(f"WITH {S.INDEX_DAYS} SELECT day, CASE WHEN amplitude < 1 THEN 'Inactive' WHEN rmm_phase BETWEEN 1 AND 4 THEN 'Active_1to4' ELSE 'Active_5to8' END AS coarse, CASE WHEN amplitude < 1 THEN 'Inactive' ELSE 'Phase_' || rmm_phase END AS detailed FROM dindex")
def mjo_labels(spark, sf_dir):
    a, p = F.col("amplitude"), F.col("rmm_phase")
    return S.daily_index(spark, sf_dir).select("day", modes.coarse_phase(a, p).alias("coarse"), modes.detailed_phase(a, p).alias("detailed"))


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


@query(f"WITH {S.MONTHLY} SELECT make_date(y, m, 1) AS ym, value FROM (SELECT DISTINCT year(ym) AS y FROM monthly WHERE mode = 'PDO') CROSS JOIN range(1, 13) q(m) LEFT JOIN monthly ON mode = 'PDO' AND ym = make_date(y, m, 1)")
def melt_wide_index(spark, sf_dir):
    """A year x month table turned back into a series."""
    m = S.monthly_index(spark, sf_dir).where("mode = 'PDO'")
    wide = m.withColumn("Year", F.year("ym")).withColumn("_m", F.date_format("ym", "MMM")).groupBy("Year").pivot("_m", MONTHS).agg(F.first("value"))
    return modes.wide_to_long(wide, "Year", MONTHS, "value")


_TIMES = f"{S.PANEL}, {S.LABELS}"


@query(f"WITH {_TIMES}, dm AS (SELECT key AS day, phase FROM labels WHERE mode = 'MJO'), t AS (SELECT DISTINCT panel.d AS day FROM panel), n AS (SELECT t.day, dm.phase, row_number() OVER (PARTITION BY t.day ORDER BY abs(date_diff('day', t.day, dm.day)), dm.day DESC) AS o FROM t CROSS JOIN dm) SELECT day, phase FROM n WHERE o = 1")
def asof_nearest_label(spark, sf_dir):
    labels = S.labels(spark, sf_dir).where("mode = 'MJO'").select(F.col("key").alias("day"), "phase")
    times = S.panel(spark, sf_dir).select(F.col("d")).distinct()
    return modes.nearest_labels(times, labels).select(F.col("d").alias("day"), "phase")


@query(f"WITH {_TIMES} SELECT panel.d AS day, cell_id, phase FROM panel LEFT JOIN mphase ON mphase.mode = 'AO' AND CAST(date_trunc('month', panel.d) AS DATE) = ym")
def month_label_join(spark, sf_dir):
    l = S.month_phases(spark, sf_dir).where("mode = 'AO'").select("ym", "phase")  # noqa: E741
    return modes.month_labels(S.panel(spark, sf_dir), l).select(F.col("d").alias("day"), "cell_id", "phase")


@query(f"WITH {_TIMES} SELECT panel.d AS day, cell_id, phase FROM panel LEFT JOIN labels ON labels.mode = 'MJO' AND key = panel.d")
def day_label_join(spark, sf_dir):
    l = S.labels(spark, sf_dir).where("mode = 'MJO'").select(F.col("key").alias("day"), "phase")  # noqa: E741
    return modes.day_labels(S.panel(spark, sf_dir), l).select(F.col("d").alias("day"), "cell_id", "phase")


@query(f"WITH {S.LAGGED} SELECT mode, unit, lag, key, phase FROM lagged")
def lagged_label_join(spark, sf_dir):
    return modes.lagged_labels(S.labels(spark, sf_dir), S.lags(spark))


_PHASED = f"{_TIMES}, ph AS (SELECT mode, phase, cell_id, ar, ep, panel.d AS day FROM panel JOIN labels ON (labels.mode <> 'MJO' AND key = CAST(date_trunc('month', panel.d) AS DATE)) OR (labels.mode = 'MJO' AND key = panel.d))"


def _phased(spark, sf_dir):
    """The panel once for every mode, with that mode's phase.

    A month's label is first put to each of its days, so the panel is made and joined once.
    """
    p = S.panel(spark, sf_dir).withColumn("ym", F.trunc("d", "MM"))
    end = F.when(F.col("mode") == "MJO", F.col("key")).otherwise(F.last_day("key"))
    l = S.labels(spark, sf_dir).select("mode", "phase", F.explode(F.sequence(F.col("key"), end)).alias("d"))  # noqa: E741
    return p.join(F.broadcast(l), "d").select("mode", "phase", "cell_id", "d", "ym", "ar", "ep", "lat")  # a row a day and mode


@query(f"WITH {_PHASED} SELECT mode, phase, cell_id, {S.ABCD} FROM ph GROUP BY 1, 2, 3")
def phase_cell_counts(spark, sf_dir):
    return counts.contingency(_phased(spark, sf_dir), ["mode", "phase", "cell_id"])


_SUM = f"{_PHASED}, pc AS (SELECT mode, phase, {S.ABCD}, count(DISTINCT day) AS n_time, count(DISTINCT cell_id) AS cells FROM ph GROUP BY 1, 2)"


@query(f"WITH {_SUM} SELECT mode, phase, a, b, c, d, n_time, cells, {S.sql_delta_list()}, round({S.P1}, 6) AS p1, round({S.P0}, 6) AS p0, round({S.LIFT}, 6) AS lift FROM pc")
def phase_summary(spark, sf_dir):
    g = _phased(spark, sf_dir).groupBy("mode", "phase").agg(*counts.count_columns(), F.count_distinct("d").alias("n_time"), F.count_distinct("cell_id").alias("cells"))
    return g.select("mode", "phase", *"abcd", "n_time", "cells", *M.rounded(M.delta_intervals()), R(M.risk_exposed()).alias("p1"), R(M.risk_unexposed()).alias("p0"), R(M.lift()).alias("lift"))


@query(f"WITH {_PHASED}, k AS (SELECT mode, phase, cell_id, {S.ABCD} FROM ph GROUP BY 1, 2, 3), f AS (SELECT mode, phase, cell_id, {S.AF} AS af, {S.PAF} AS paf, {S.LIFT} AS lift FROM k) SELECT mode, phase, round(avg(af), 6) AS mean_af, round(min(af), 6) AS min_af, round(max(af), 6) AS max_af, count(af) AS n_af, round(avg(paf), 6) AS mean_paf, round(avg(lift), 6) AS mean_lift, count(lift) AS n_lift FROM f GROUP BY 1, 2")
def phase_field_summary(spark, sf_dir):
    f = counts.contingency(_phased(spark, sf_dir), ["mode", "phase", "cell_id"]).select("mode", "phase", M.attributable_fraction().alias("af"), M.population_attributable_fraction().alias("paf"), M.lift().alias("lift"))
    return f.groupBy("mode", "phase").agg(R(F.avg("af")).alias("mean_af"), R(F.min("af")).alias("min_af"), R(F.max("af")).alias("max_af"), F.count("af").alias("n_af"), R(F.avg("paf")).alias("mean_paf"), R(F.avg("lift")).alias("mean_lift"), F.count("lift").alias("n_lift"))


_FIELD_SQL = {"p1": S.P1, "p0": S.P0, "rd": f"({S.P1}) - ({S.P0})", "rr": f"({S.P1}) / nullif({S.P0}, 0)", "af": S.AF, "paf": S.PAF}
_HALF = {x: f"(CASE WHEN {x} = 0 THEN 0.5 ELSE {x}::DOUBLE END)" for x in "abcd"}


def _means_sql() -> str:
    out = []
    for prefix, mean in (("", "avg({x})"), ("aw_", "sum({x} * w) / nullif(sum(CASE WHEN {x} IS NOT NULL THEN w END), 0)")):
        for suffix, chosen in (("all", "true"), ("sig", "p < 0.05")):
            out += [f"round({mean.format(x=f'(CASE WHEN {chosen} THEN {m} END)')}, 6) AS {prefix}mean_{m}_{suffix}" for m in _FIELD_SQL]
    return ", ".join(out)


def _pooled_sql() -> str:
    d, ok = S.sql_delta(), "a + b > 0 AND c + d > 0"
    out = [f"CASE WHEN {ok} THEN round({_HALF['a']} / ({_HALF['a']} + {_HALF['b']}), 6) END AS pooled_p1", f"CASE WHEN {ok} THEN round({_HALF['c']} / ({_HALF['c']} + {_HALF['d']}), 6) END AS pooled_p0"]
    out += [f"{d[f'{m}{end}']} AS pooled_{m}{end}" for m in ("rd", "rr", "af", "paf") for end in ("", "_low", "_high")]
    out += ["round((a + b) / nullif(a + b + c + d, 0)::DOUBLE, 6) AS pooled_ar_share", "round((a + c) / nullif(a + b + c + d, 0)::DOUBLE, 6) AS pooled_ep_share"]
    return ", ".join([*out, *(f"{x} AS {x}_total" for x in "abcd"), "a + b + c + d AS n_total"])


@query(f"""WITH {_PHASED}, k AS (SELECT mode, phase, cell_id, {S.ABCD} FROM ph GROUP BY 1, 2, 3),
f AS (SELECT *, {S.sql_fisher('greater')} AS p, cos(radians(10 + (cell_id // {S.COLUMNS}) * CAST(0.25 AS DOUBLE))) AS w, {', '.join(f'{v} AS {m}' for m, v in _FIELD_SQL.items())} FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY mode, phase ORDER BY p, cell_id) AS i, count(p) OVER (PARTITION BY mode, phase) AS tests FROM f),
s AS (SELECT mode, phase, max(p) AS star FROM r WHERE p <= i / tests::DOUBLE * 0.05 GROUP BY 1, 2),
g AS (SELECT mode, phase, count(*) FILTER (WHERE p < 0.05) AS sig_p, count(*) FILTER (WHERE p <= star) AS sig_fdr, {_means_sql()}, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in 'abcd')} FROM f LEFT JOIN s USING (mode, phase) GROUP BY 1, 2),
t AS (SELECT mode, phase, count(DISTINCT day) AS n_time FROM ph GROUP BY 1, 2)
SELECT mode, phase, n_time, g.* EXCLUDE (mode, phase, a, b, c, d), {_pooled_sql()} FROM g JOIN t USING (mode, phase)""")
def phase_rows(spark, sf_dir):
    """The whole row of every phase: 29 columns of its cells and 21 pooled ones."""
    rows = modes.phase_rows(_phased(spark, sf_dir), ["mode", "phase"])
    return rows.select(*(R(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in rows.schema))


@query(f"""WITH {_TIMES}, w AS (SELECT e.phase AS enso, a.phase AS ao, p.phase AS pdo, m.phase AS mjo, ar, ep FROM panel JOIN mphase e ON e.mode = 'ENSO' AND e.ym = CAST(date_trunc('month', panel.d) AS DATE) JOIN mphase a ON a.mode = 'AO' AND a.ym = e.ym JOIN mphase p ON p.mode = 'PDO' AND p.ym = e.ym JOIN labels m ON m.mode = 'MJO' AND m.key = panel.d),
g AS (SELECT enso, ao, pdo, mjo, {S.ABCD} FROM w GROUP BY 1, 2, 3, 4) SELECT 'ENSO=' || enso || ', MJO=' || mjo || ', AO=' || ao || ', PDO=' || pdo AS combo, a, b, c, d, round(CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN a::DOUBLE * d / (b::DOUBLE * c) END, 6) AS "or", round({S.sql_fisher()}, 6) AS p FROM g""")
def phase_combo_or(spark, sf_dir):
    """Odds ratio of every combination of phases that occurs."""
    p = S.panel(spark, sf_dir).withColumn("ym", F.trunc("d", "MM"))
    m = S.month_phases(spark, sf_dir)
    for mode in ("ENSO", "AO", "PDO"):
        p = p.join(m.where(F.col("mode") == mode).select("ym", F.col("phase").alias(mode.lower())), "ym")
    p = p.join(S.labels(spark, sf_dir).where("mode = 'MJO'").select(F.col("key").alias("d"), F.col("phase").alias("mjo")), "d")
    g = counts.contingency(p, ["enso", "ao", "pdo", "mjo"])
    combo = F.concat(F.lit("ENSO="), "enso", F.lit(", MJO="), "mjo", F.lit(", AO="), "ao", F.lit(", PDO="), "pdo")
    return g.select(combo.alias("combo"), *"abcd", R(M.woolf_odds_ratio()[0]).alias("or"), R(fisher(*map(F.col, "abcd"))).alias("p"))


@query(f"WITH {_SUM}, o AS (SELECT mode, phase, CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN round(a::DOUBLE * d / (b::DOUBLE * c), 6) END AS \"or\" FROM pc) SELECT mode, phase, \"or\" FROM o ORDER BY \"or\" DESC")
def or_forest_order(spark, sf_dir):
    g = counts.contingency(_phased(spark, sf_dir), ["mode", "phase"])
    return g.select("mode", "phase", R(M.woolf_odds_ratio()[0]).alias("or")).orderBy(F.desc("or"))


@query(f"WITH {_SUM} SELECT mode, phase, {S.sql_rank()} AS place FROM pc ORDER BY mode, place")
def phase_sort_key(spark, sf_dir):
    g = _phased(spark, sf_dir).select("mode", "phase").distinct()
    return g.withColumn("place", modes.phase_rank(F.col("phase"))).orderBy("mode", "place")


@query(f"WITH {_SUM} SELECT mode, count(*) AS n FROM pc WHERE phase IN ('ElNino', 'Positive', 'Active_1to4') GROUP BY 1")
def label_membership(spark, sf_dir):
    g = _phased(spark, sf_dir).select("mode", "phase").distinct()
    return g.where(F.col("phase").isin("ElNino", "Positive", "Active_1to4")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PHASED}, k AS (SELECT mode, phase, cell_id, {S.ABCD} FROM ph GROUP BY 1, 2, 3), q AS (SELECT mode, phase, cell_id, {S.P1} AS p1, {S.sql_fisher('greater')} AS p FROM k),
o AS (SELECT cell_id, mode, phase, p1, row_number() OVER (PARTITION BY cell_id ORDER BY round(p1, 9) DESC, CASE mode WHEN 'ENSO' THEN 0 WHEN 'MJO' THEN 1 WHEN 'AO' THEN 2 ELSE 3 END, phase) AS o FROM q WHERE p < 0.05 AND p1 IS NOT NULL) SELECT cell_id, mode, phase, round(p1, 6) AS p1 FROM o WHERE o = 1""")
def max_prob_phase(spark, sf_dir):
    """The phase of the largest outcome probability under exposure, among associated ones; the first wins."""
    k = counts.contingency(_phased(spark, sf_dir), ["mode", "phase", "cell_id"])
    q = k.withColumn("p", fisher(*map(F.col, "abcd"), "greater")).withColumn("p1", M.risk_exposed()).where("p < 0.05 and p1 is not null")
    place = F.when(F.col("mode") == "ENSO", 0).when(F.col("mode") == "MJO", 1).when(F.col("mode") == "AO", 2).otherwise(3)
    return P.keep_one(q, ["cell_id"], [-F.round("p1", 9), place, F.col("phase")]).select("cell_id", "mode", "phase", R(F.col("p1")).alias("p1"))


_BLOCKS = f"{_PHASED}, bl AS (SELECT mode, phase, CAST(date_trunc('month', day) AS DATE) AS ym, {S.ABCD}, count(DISTINCT day) AS n_time FROM ph GROUP BY 1, 2, 3)"


@query(f"WITH {_BLOCKS} SELECT * FROM bl")
def month_blocks(spark, sf_dir):
    return _phased(spark, sf_dir).groupBy("mode", "phase", "ym").agg(*counts.count_columns(), F.count_distinct("d").alias("n_time"))


_DIFF = ["rd", "rr", "af", "paf"]
_D = S.sql_delta(None)
_PAIR = lambda cols, src, keys: f"SELECT {keys}, x.phase AS phase1, y.phase AS phase2, {cols} FROM {src} x JOIN {src} y USING ({keys}) WHERE {S.sql_rank('x.phase')} < {S.sql_rank('y.phase')}"


@query(f"WITH {_SUM}, v AS (SELECT mode, phase, {', '.join(f'{_D[m]} AS {m}' for m in _DIFF)} FROM pc) " + _PAIR(", ".join(f"round(x.{m} - y.{m}, 6) AS d_{m}" for m in _DIFF), "v", "mode"))
def phase_pair_diff(spark, sf_dir):
    d = M.delta_intervals()
    v = counts.contingency(_phased(spark, sf_dir), ["mode", "phase"]).select("mode", "phase", *(d[m].alias(m) for m in _DIFF))
    c = modes.contrasts(v, ["mode"], _DIFF)
    return c.select("mode", "phase1", "phase2", *(R(F.col(f"d_{m}")).alias(f"d_{m}") for m in _DIFF))


#: Repetitions of the bootstrap.
_REPS = 500


def _boot_sql(blocks: str, keys: list[str], metrics: list[str]) -> str:
    """CTEs ending in bt(keys, phase1, phase2, metric, mean, low, high, p) over the named block table."""
    k = ", ".join(keys)
    diff = _PAIR(", ".join(f"x.{m} - y.{m} AS d_{m}" for m in metrics), "bv", f"{k}, rep")
    return f"""bi AS (SELECT *, row_number() OVER (PARTITION BY {k}, phase ORDER BY ym) - 1 AS i, count(*) OVER (PARTITION BY {k}, phase) AS n FROM {blocks}),
bd AS (SELECT {k}, phase, rep, {S.sql_draw('n', "'42'", *keys, 'phase', 'rep', 'i')} AS i FROM bi, range(0, {_REPS}) q(rep) WHERE n >= 3),
bs AS (SELECT {k}, phase, rep, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c, CAST(sum(d) AS BIGINT) AS d FROM bd JOIN bi USING ({k}, phase, i) GROUP BY {k}, phase, rep),
bv AS (SELECT {k}, phase, rep, {', '.join(f'{_D[m]} AS {m}' for m in metrics)} FROM bs),
bf AS ({diff}), bl2 AS (UNPIVOT bf ON {', '.join(f'd_{m}' for m in metrics)} INTO NAME metric VALUE x),
bt AS (SELECT {k}, phase1, phase2, metric, avg(x) AS mean, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high, least(1.0, 2 * least(avg(CASE WHEN x <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN x >= 0 THEN 1.0 ELSE 0 END))) AS p FROM bl2 GROUP BY {k}, phase1, phase2, metric)"""


@query(f"WITH {_BLOCKS}, {_boot_sql('bl', ['mode'], _DIFF)} SELECT mode, phase1, phase2, metric, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p FROM bt")
def block_bootstrap_diff(spark, sf_dir):
    b = counts.contingency(_phased(spark, sf_dir), ["mode", "phase", "ym"])
    t = modes.bootstrap_contrasts(b, ["mode"], _REPS, 42, _DIFF)
    return t.select("mode", "phase1", "phase2", "metric", *(R(F.col(x)).alias(x) for x in ("mean", "low", "high", "p")))


_SIDES = ", ".join(f"{s}.blocks AS blocks{i}" for s, i in (("x", 1), ("y", 2)))


@query(f"""WITH {_BLOCKS}, {_boot_sql('bl', ['mode'], _DIFF)}, pb AS (SELECT mode, phase, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c, CAST(sum(d) AS BIGINT) AS d, count(*) AS blocks FROM bl GROUP BY 1, 2),
pv AS (SELECT mode, phase, blocks, {', '.join(f'{_D[m]} AS {m}' for m in _DIFF)} FROM pb), pp AS ({_PAIR(_SIDES + ', ' + ', '.join(f'round(x.{m} - y.{m}, 6) AS d_{m}' for m in _DIFF), 'pv', 'mode')}),
w AS (SELECT mode, phase1, phase2, {', '.join(f"round(max({x}) FILTER (WHERE metric = 'd_{m}'), 6) AS {m}_{x}" for m in _DIFF for x in ('mean', 'low', 'high', 'p'))} FROM bt GROUP BY 1, 2, 3)
SELECT *, mode || ': ' || phase1 || ' - ' || phase2 AS comparison, CASE WHEN least(blocks1, blocks2) < 3 THEN '{modes.FEW_BLOCKS}' END AS note FROM pp LEFT JOIN w USING (mode, phase1, phase2)""")
def phase_pair_rows(spark, sf_dir):
    """The difference rows whole: pooled differences, blocks, bootstrap, and the note of those without one."""
    b = counts.contingency(_phased(spark, sf_dir), ["mode", "phase", "ym"])
    t = modes.pair_rows(b, ["mode"], _REPS, 42, _DIFF)
    drawn = [f"{m}_{x}" for m in _DIFF for x in ("mean", "low", "high", "p")]
    return t.select("mode", "phase1", "phase2", "comparison", "blocks1", "blocks2", "note", *(R(F.col(x)).alias(x) for x in [*(f"d_{m}" for m in _DIFF), *drawn]))


_SCAN = f"{S.TIMES}, {S.LAGGED}, sc AS (SELECT mode, lag, phase, CAST(date_trunc('month', day) AS DATE) AS ym, a, b, c, d, day FROM times JOIN lagged ON (unit = 'month' AND key = CAST(date_trunc('month', day) AS DATE)) OR (unit = 'day' AND key = day))"
_LSUM = "SELECT mode, lag, phase, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c, CAST(sum(d) AS BIGINT) AS d, count(*) AS n_time FROM sc GROUP BY 1, 2, 3"


def _scan(spark, sf_dir, extra=()):
    t = S.time_counts(S.panel(spark, sf_dir))
    return modes.scan_counts(t, S.labels(spark, sf_dir), S.lags(spark), list(extra))


@query(f"WITH {_SCAN} {_LSUM}")
def lag_phase_counts(spark, sf_dir):
    return _scan(spark, sf_dir)


@query(f"WITH {_SCAN}, s AS ({_LSUM}) SELECT mode, lag, phase, a, b, c, d, n_time, {S.sql_delta_list()} FROM s")
def lag_scan(spark, sf_dir):
    return _scan(spark, sf_dir).select("mode", "lag", "phase", *"abcd", "n_time", *M.rounded(M.delta_intervals()))


_RANKM = ["rd", "af", "paf"]
_EFFECT = f"""{_SCAN}, lb AS (SELECT mode, lag, phase, ym, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c, CAST(sum(d) AS BIGINT) AS d FROM sc GROUP BY 1, 2, 3, 4),
{_boot_sql('lb', ['mode', 'lag'], _RANKM)}, rb AS (SELECT mode, lag, phase1, phase2, metric, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p FROM bt),
rk AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p NULLS LAST, mode, lag, phase1, phase2) AS r, count(p) OVER (PARTITION BY metric) AS n FROM rb),
rq AS (SELECT *, round(least(1.0, min(p * n / r::DOUBLE) OVER (PARTITION BY metric ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM rk),
es AS (SELECT *, CASE WHEN q < 0.05 AND low > 0 THEN 1 WHEN q < 0.05 AND high < 0 THEN -1 ELSE 0 END AS s FROM rq),
ef AS (SELECT mode, lag, phase1, phase2, CAST(sum(abs(s)) AS BIGINT) AS score, min(q) AS min_q, CASE WHEN count(*) FILTER (WHERE s > 0) > 0 AND count(*) FILTER (WHERE s < 0) = 0 THEN 'positive' WHEN count(*) FILTER (WHERE s < 0) > 0 AND count(*) FILTER (WHERE s > 0) = 0 THEN 'negative' ELSE 'mixed_or_not_significant' END AS direction,
  max(abs(mean)) FILTER (WHERE metric = 'd_af') AS daf, max(abs(mean)) FILTER (WHERE metric = 'd_rd') AS drd, max(abs(mean)) FILTER (WHERE metric = 'd_paf') AS dpaf FROM es GROUP BY 1, 2, 3, 4),
er AS (SELECT *, row_number() OVER (ORDER BY score DESC, min_q, daf DESC, drd DESC, dpaf DESC, mode, lag, phase1, phase2) AS place FROM ef)"""


def _effects(spark, sf_dir):
    """Contrasts of every lag with q values, as one row a comparison: score, direction, sizes."""
    blocks = _scan(spark, sf_dir, ["ym"]).drop("n_time")
    t = modes.bootstrap_contrasts(blocks, ["mode", "lag"], _REPS, 42, _RANKM)
    t = t.select("mode", "lag", "phase1", "phase2", "metric", *(R(F.col(x)).alias(x) for x in ("mean", "low", "high", "p")))
    t = fdr.q_values(t, "p", by=["metric"]).withColumn("q", R(F.col("q")))
    sure = F.col("q") < 0.05
    t = t.withColumn("s", F.when(sure & (F.col("low") > 0), 1).when(sure & (F.col("high") < 0), -1).otherwise(0))
    up, down = F.count_if(F.col("s") > 0), F.count_if(F.col("s") < 0)
    size = lambda m: F.max(F.when(F.col("metric") == f"d_{m}", F.abs("mean")))
    return t.groupBy("mode", "lag", "phase1", "phase2").agg(
        F.sum(F.abs("s")).alias("score"), F.min("q").alias("min_q"),
        F.when((up > 0) & (down == 0), "positive").when((down > 0) & (up == 0), "negative").otherwise("mixed_or_not_significant").alias("direction"),
        size("af").alias("daf"), size("rd").alias("drd"), size("paf").alias("dpaf"),
    )


def _order():
    return [F.desc("score"), F.asc("min_q"), F.desc("daf"), F.desc("drd"), F.desc("dpaf"), "mode", "lag", "phase1", "phase2"]



@query(f"WITH {_EFFECT} SELECT mode, lag, phase1, phase2, score, min_q, direction, daf, drd, dpaf, place FROM er", ints=("place",))
def effect_ranking(spark, sf_dir):
    """One global order; the table has a row a comparison and lag, so one task orders it."""
    return _effects(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_order())))


@query(f"WITH {_EFFECT} SELECT mode, phase1, phase2, lag, score, direction FROM (SELECT *, row_number() OVER (PARTITION BY mode, phase1, phase2 ORDER BY place) AS o FROM er) WHERE o = 1")
def best_lag(spark, sf_dir):
    e = _effects(spark, sf_dir)
    w = Window.partitionBy("mode", "phase1", "phase2").orderBy(*_order()[:5], "lag")
    return e.withColumn("_o", F.row_number().over(w)).where("_o = 1").select("mode", "phase1", "phase2", "lag", "score", "direction")


@query(f"WITH {_EFFECT} SELECT mode, lag, phase1, phase2, score FROM er WHERE place <= 40")
def ranking_top40(spark, sf_dir):
    """The report's first forty lines: a top-k."""
    return _effects(spark, sf_dir).orderBy(*_order()).limit(40).select("mode", "lag", "phase1", "phase2", "score")
