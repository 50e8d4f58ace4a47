"""The tables at hand as panels, index series and dimensions, in Spark and in SQL.

Cell = supplier, day = ship date, amount in cents; exposure = some returned line
that day; outcome = amount over the cell's own 95th percentile.  Index series
come from orders: three monthly modes and one daily mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import modes

COLUMNS = 40  # cells of a grid row
REGIONS = [("north", 100.0, 110.0, 10.25, 20.0), ("west", 100.0, 104.75, 10.0, 20.0), ("core", 102.0, 107.5, 10.0, 10.5)]
SEASONS = [("DJF", m) for m in (12, 1, 2)] + [("MAM", m) for m in (3, 4, 5)] + [("JJA", m) for m in (6, 7, 8)] + [("SON", m) for m in (9, 10, 11)]
LAGS = [("ENSO", k, "month") for k in range(5)] + [("AO", k, "month") for k in range(3)] + [("PDO", k, "month") for k in (0, 1, 3, 6, 9, 12)] + [("MJO", k, "day") for k in (0, 3, 5, 7, 10, 12, 15, 20)]
MODES = {"ENSO": ("1-URGENT", "ElNino", "LaNina"), "AO": ("2-HIGH", "Positive", "Negative"), "PDO": ("5-LOW", "Positive", "Negative")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, d, v, ar): the daily panel before flags.

    Lines are dealt out by cell, their one exchange: what is grouped or ordered by cell afterwards stays in its task.
    """
    li = table(spark, sf_dir, "lineitem")
    cents, returned = F.round(F.col("l_extendedprice") * 100).cast("long"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    li = li.select(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("d"), cents.alias("v"), returned.alias("ar"))
    shares = _shares(spark, sf_dir)
    li = li.repartition(shares, "cell_id") if shares else li.repartition("cell_id")
    return li.groupBy("cell_id", "d").agg(F.sum("v").alias("v"), F.max("ar").alias("ar"))


#: Lines of a task.
LINES = 1 << 19


def _shares(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the lines fill, where they are more than the session's partitions; else 0.  Counted from the file's footers."""
    fill = -(-table(spark, sf_dir, "lineitem").count() // LINES)
    return fill if fill > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def located(df: DataFrame) -> DataFrame:
    i, j = F.floor(F.col("cell_id") / COLUMNS), F.col("cell_id") % COLUMNS
    return df.withColumns({"lat": 10 + i * 0.25, "lon": 100 + j * 0.25})


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, lat, lon, d, v, ar, ep)."""
    d = daily(spark, sf_dir).where("cell_id is not null")
    thr = F.round(F.percentile("v", F.lit(0.95)).over(Window.partitionBy("cell_id")), 6)
    return located(d.withColumn("thr", thr).withColumn("ep", (F.col("v") > F.col("thr")).cast("int")).drop("thr"))


def days(spark: SparkSession, sf_dir: str) -> tuple:
    """The first and the last day of the panel, read from the date column alone; one day where it is empty."""
    import datetime as dt

    first, last = table(spark, sf_dir, "lineitem").agg(F.min(F.to_date("l_shipdate")), F.max(F.to_date("l_shipdate"))).first()
    return first or dt.date(1995, 1, 1), last or dt.date(1995, 1, 1)


def monthly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, ym, value): standardised monthly mean order price of a priority."""
    o = table(spark, sf_dir, "orders")
    mode = F.create_map(*(F.lit(x) for m, (p, _, _) in MODES.items() for x in (p, m)))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    m = o.select(F.try_element_at(mode, F.col("o_orderpriority")).alias("mode"), F.trunc("o_orderdate", "MM").alias("ym"), cents.alias("c")).where("mode is not null")
    m = m.groupBy("mode", "ym").agg((F.sum("c") / F.count(F.lit(1))).alias("x"))
    w = Window.partitionBy("mode")
    return m.select("mode", "ym", F.round((F.col("x") - F.avg("x").over(w)) / F.stddev_pop("x").over(w), 6).alias("value"))


def daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, amplitude, rmm_phase): a daily two-part index."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    stats = o.agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("s"))
    d = o.join(F.broadcast(stats))  # one row
    return d.select("day", F.round(F.abs(F.col("n") - F.col("m")) / F.col("s") * 1.5, 6).alias("amplitude"), (1 + F.pmod(F.datediff("day", F.lit("1995-01-01").cast("date")), F.lit(8))).alias("rmm_phase"))


def month_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, ym, phase)."""
    name = lambda k: F.create_map(*(F.lit(x) for m, v in MODES.items() for x in (m, v[k])))[F.col("mode")]
    return monthly_index(spark, sf_dir).select("mode", "ym", F.when(F.col("value") > 0.5, name(1)).when(F.col("value") < -0.5, name(2)).otherwise("Neutral").alias("phase"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, key, phase) of all modes; key is a month start or a day."""
    day = daily_index(spark, sf_dir).select(F.lit("MJO").alias("mode"), F.col("day").alias("key"), modes.coarse_phase(F.col("amplitude"), F.col("rmm_phase")).alias("phase"))
    return month_phases(spark, sf_dir).withColumnRenamed("ym", "key").unionByName(day)


def lags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAGS, "mode string, lag int, unit string")


def regions(spark: SparkSession) -> DataFrame:
    """A handful of boxes, small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(REGIONS, "region string, lon_min double, lon_max double, lat_min double, lat_max double"))


def seasons(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(SEASONS, "season string, month int"))


def time_counts(p: DataFrame) -> DataFrame:
    from ..operators.counts import contingency

    return contingency(p.withColumnRenamed("d", "day"), ["day"])


# --------------------------------------------------------------------------
# the same in SQL

DAILY = """daily AS (SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v,
  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ar FROM lineitem GROUP BY 1, 2)"""
PANEL = DAILY + f""", thr AS (SELECT cell_id, round(quantile_cont(CAST(v AS DOUBLE), 0.95), 6) AS thr FROM daily GROUP BY cell_id),
panel AS (SELECT cell_id, 10 + (cell_id // {COLUMNS}) * CAST(0.25 AS DOUBLE) AS lat, 100 + (cell_id % {COLUMNS}) * CAST(0.25 AS DOUBLE) AS lon, d, v, ar,
  CAST(v > thr AS INTEGER) AS ep FROM daily JOIN thr USING (cell_id))"""
ABCD = "CAST(sum(ar * ep) AS BIGINT) AS a, CAST(sum(ar * (1 - ep)) AS BIGINT) AS b, CAST(sum((1 - ar) * ep) AS BIGINT) AS c, CAST(sum((1 - ar) * (1 - ep)) AS BIGINT) AS d"
CELLS = PANEL + f", cells AS (SELECT cell_id, {ABCD} FROM panel GROUP BY cell_id)"
TIMES = PANEL + f", times AS (SELECT d AS day, {ABCD} FROM panel GROUP BY panel.d)"
_MODE = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{m}'" for m, (p, _, _) in MODES.items()) + " END"
_NAME = lambda k: "CASE mode " + " ".join(f"WHEN '{m}' THEN '{v[k]}'" for m, v in MODES.items()) + " END"
MONTHLY = f"""mx AS (SELECT {_MODE} AS mode, CAST(date_trunc('month', o_orderdate) AS DATE) AS ym, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) AS x
  FROM orders WHERE {_MODE} IS NOT NULL GROUP BY 1, 2),
monthly AS (SELECT mode, ym, round((x - avg(x) OVER (PARTITION BY mode)) / stddev_pop(x) OVER (PARTITION BY mode), 6) AS value FROM mx)"""
INDEX_DAYS = """dx AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
dindex AS (SELECT day, round(abs(n - (SELECT avg(n) FROM dx)) / (SELECT stddev_pop(n) FROM dx) * 1.5, 6) AS amplitude,
  1 + date_diff('day', DATE '1995-01-01', day) % 8 AS rmm_phase FROM dx)"""
LABELS = f"""{MONTHLY}, {INDEX_DAYS},
mphase AS (SELECT mode, ym, CASE WHEN value > 0.5 THEN {_NAME(1)} WHEN value < -0.5 THEN {_NAME(2)} ELSE 'Neutral' END AS phase FROM monthly),
labels AS (SELECT mode, ym AS key, phase FROM mphase UNION ALL
  SELECT 'MJO', day, CASE WHEN amplitude < 1 THEN 'Inactive' WHEN rmm_phase BETWEEN 1 AND 4 THEN 'Active_1to4' ELSE 'Active_5to8' END FROM dindex)"""
LAG_TABLE = "lags(mode, lag, unit) AS (VALUES " + ", ".join(f"('{m}', {k}, '{u}')" for m, k, u in LAGS) + ")"
REGION_TABLE = "regions(region, lon_min, lon_max, lat_min, lat_max) AS (VALUES " + ", ".join(f"('{r[0]}', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in r[1:]) + ")" for r in REGIONS) + ")"
SEASON_TABLE = "seasons(season, month) AS (VALUES " + ", ".join(f"('{s}', {m})" for s, m in SEASONS) + ")"
LAGGED = f"""{LABELS}, {LAG_TABLE},
lagged AS (SELECT mode, unit, lag, CAST(CASE WHEN unit = 'month' THEN key + to_months(CAST(lag AS INTEGER)) ELSE key + to_days(CAST(lag AS INTEGER)) END AS DATE) AS key, phase FROM labels JOIN lags USING (mode))"""

# effect measures
P1, P0 = "a / nullif(a + b, 0)::DOUBLE", "c / nullif(c + d, 0)::DOUBLE"
_LIFT = f"({P1}) / nullif({P0}, 0)"
LIFT = f"CASE WHEN {_LIFT} IS NOT NULL THEN least({_LIFT}, 100.0) END"
AF = f"(({P1}) - ({P0})) / nullif({P1}, 0)"
_FE = "((a + c) / nullif(a + b + c + d, 0)::DOUBLE)"
PAF = f"({_FE} - ((c + d) / nullif(a + b + c + d, 0)::DOUBLE) * ({P0})) / nullif({_FE}, 0)"
Z = "1.959963984540054"


def lfact(x: str) -> str:
    return f"lgamma(({x}) + 1)"


def sql_fisher(alternative: str = "two-sided") -> str:
    """Fisher p of columns a, b, c, d."""
    fixed = f"({lfact('a+b')} + {lfact('c+d')} + {lfact('a+c')} + {lfact('b+d')} - {lfact('a+b+c+d')})"
    at = lambda k: f"({fixed} - ({lfact(k)} + {lfact(f'a+b-{k}')} + {lfact(f'a+c-{k}')} + {lfact(f'd-a+{k}')}))"
    if alternative == "greater":
        body = f"list_sum(list_transform(range(a, least(a+b, a+c) + 1), lambda k: exp({at('k')})))"
    else:
        body = f"list_sum(list_transform(range(greatest(0, a-d), least(a+b, a+c) + 1), lambda k: CASE WHEN {at('k')} <= {at('a')} + 1e-7 THEN exp({at('k')}) ELSE 0 END))"
    return f"CASE WHEN a+b+c+d > 0 THEN least(1.0, {body}) END"


def sql_binomial(x: str, y: str) -> str:
    n, m = f"({x} + {y})", f"least({x}, {y})"
    s = f"list_sum(list_transform(range(0, CAST({m} AS BIGINT) + 1), lambda k: exp({lfact(n)} - {lfact('k')} - {lfact(f'{n} - k')} - {n} * ln(2))))"
    return f"CASE WHEN {n} > 0 THEN CASE WHEN {x} = {y} THEN 1.0 ELSE least(1.0, 2 * {s}) END END"


def sql_q(s: str, x: str) -> str:
    """Regularised upper incomplete gamma."""
    terms = f"CAST(greatest({x} - {s}, 0) + 9 * sqrt(greatest({x}, {s})) + 60 AS BIGINT)"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, {terms}), lambda k: exp((k + {s}) * ln({x}) - {x} - lgamma({s} + k + 1))))) END"


def sql_delta(rnd: int | None = 6) -> dict[str, str]:
    """Pooled measures with delta-method intervals from columns a, b, c, d."""
    h = {x: f"(CASE WHEN {x} = 0 THEN 0.5 ELSE {x}::DOUBLE END)" for x in "abcd"}
    n1, n0 = f"({h['a']} + {h['b']})", f"({h['c']} + {h['d']})"
    p1, p0 = f"({h['a']} / {n1})", f"({h['c']} / {n0})"
    rr, e = f"({p1} / {p0})", "((a + b) / (a + b + c + d)::DOUBLE)"
    se = f"sqrt(1 / {h['a']} - 1 / {n1} + 1 / {h['c']} - 1 / {n0})"
    den = f"(1 + {e} * ({rr} - 1))"
    out = {"rr": rr, "rr_low": f"exp(ln({rr}) - {Z} * {se})", "rr_high": f"exp(ln({rr}) + {Z} * {se})"}
    three = (("af", f"(1 - 1 / {rr})", f"({se} / {rr})"), ("paf", f"({e} * ({rr} - 1) / {den})", f"({se} * {e} * {rr} / ({den} * {den}))"), ("rd", f"({p1} - {p0})", f"sqrt({p1} * (1 - {p1}) / {n1} + {p0} * (1 - {p0}) / {n0})"))
    for k, mid, s in three:
        out |= {k: mid, f"{k}_low": f"{mid} - {Z} * {s}", f"{k}_high": f"{mid} + {Z} * {s}"}
    wrap = (lambda v: f"round({v}, {rnd})") if rnd is not None else (lambda v: v)
    return {k: f"CASE WHEN a + b > 0 AND c + d > 0 THEN {wrap(v)} END" for k, v in out.items()}


def sql_delta_list() -> str:
    return ", ".join(f"{v} AS {k}" for k, v in sql_delta().items())


def sql_rank(x: str = "phase") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(modes.PHASE_ORDER)) + f" ELSE {len(modes.PHASE_ORDER)} END"


def sql_draw(n: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT % {n})"


def sql_choose(name: str, source: str, keep: str, identity: str, k: int, seed: int, strict: bool = True) -> str:
    """Recursive CTE ``name``(keep, r): Floyd's draws of k numbers under n for every row of ``source``(keep, n)."""
    draw = f"('0x' || substr(md5(concat_ws('|', '{seed}', {identity}, j)), 1, 8))::BIGINT % (n - kk + j + 1)"
    return f"""{name}_all AS (SELECT {keep}, n, least({k}, n) AS kk, 0::BIGINT AS j, []::BIGINT[] AS ch FROM {source}{f' WHERE n >= {k}' if strict else ''}
UNION ALL SELECT {keep}, n, kk, j + 1, list_append(ch, CASE WHEN list_contains(ch, r) THEN n - kk + j ELSE r END) FROM (SELECT *, {draw} AS r FROM {name}_all WHERE j < kk)),
{name} AS (SELECT {keep}, unnest(ch) AS r FROM {name}_all WHERE j = kk)"""


def sql_student(t: str, v: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom, by the finite series in the angle."""
    c2 = f"({v} / ({v} + {t} * {t}))"
    sine, cosine = f"(abs({t}) / sqrt({v} + {t} * {t}))", f"sqrt({c2})"
    even = f"{sine} * list_sum(list_transform(range(0, CAST({v} // 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + j * ln({c2}))))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({v})) + coalesce({sine} * {cosine} * list_sum(list_transform(range(0, CAST(({v} - 1) // 2 AS BIGINT)), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + j * ln({c2})))), 0))"
    return f"greatest(0.0, 1 - CASE WHEN {v} % 2 = 0 THEN {even} ELSE {odd} END)"
