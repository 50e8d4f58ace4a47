"""Axes of the panel: ranges, gaps, duplicates, thresholds, interpolation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import counts, panel as P, thresholds as T
from . import standins as S
from .registry import query

R = lambda x, k=6: F.round(x, k)
LO, HI = dt.date(1996, 3, 1), dt.date(1997, 8, 31)


@query("SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS tp FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-08-31' AND l_returnflag = 'R' AND l_suppkey BETWEEN 3 AND 40")
def message_scan_filter(spark, sf_dir):
    """A scan of two columns under a pushed-down predicate."""
    li = S.table(spark, sf_dir, "lineitem")
    li = P.in_range(li, "l_shipdate", dt.datetime(1996, 3, 1), dt.datetime(1997, 8, 31)).where("l_returnflag = 'R' and l_suppkey between 3 and 40")
    return li.select(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("tp"))


@query("SELECT count(*) AS n, count(DISTINCT src) AS files FROM (SELECT 1 AS src, l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' UNION ALL SELECT 2, l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')")
def concat_time(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    split = F.lit(dt.datetime(1997, 1, 1)).cast(li.schema["l_shipdate"].dataType)
    early, late = li.where(F.col("l_shipdate") < split), li.where(F.col("l_shipdate") >= split)
    both = early.select(F.lit(1).alias("src"), "l_orderkey").unionByName(late.select(F.lit(2).alias("src"), "l_orderkey"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("files"))


@query("""WITH r AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, l_extendedprice - 30000 AS tp, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS shapemap, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS ocean, CASE WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN 1 ELSE 0 END AS land, l_discount FROM lineitem)
SELECT l_suppkey AS cell_id, 10 + (l_suppkey // 40) * 0.25::DOUBLE AS lat, d, round(sum(greatest(tp * 1000, 0)), 2) AS amount, max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS bin, max(CASE WHEN shapemap IS NULL THEN 0 ELSE 1 END) AS ar, max(greatest(ocean, land)) AS ep, min(year(d) * 12 + month(d)) AS months, min(dayofyear(d)) AS doy FROM r GROUP BY ALL""", ints=("months", "doy"))
def normalise_panel(spark, sf_dir):
    """Raw names, units and flags brought to the panel's form."""
    li = S.table(spark, sf_dir, "lineitem")
    flags = lambda s, more=F.lit(True): F.when((F.col("l_linestatus") == s) & more, 1).otherwise(0)
    raw = li.select(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("d"), (F.col("l_extendedprice") - 30000).alias("tp"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("shapemap"), flags("F").alias("ocean"), flags("O", F.col("l_discount") > 0.05).alias("land"), "l_discount")
    raw = S.located(raw).withColumnsRenamed({"lat": "latitude", "lon": "longitude"}).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    return raw.groupBy("cell_id", "lat", "d").agg(
        R(F.sum(F.greatest(F.col("tp") * 1000, F.lit(0))), 2).alias("amount"),
        F.max(P.binary(F.col("l_discount"), 0.05)).alias("bin"),
        F.max(P.present(F.col("shapemap"))).alias("ar"),
        F.max(P.either(F.col("ocean"), F.col("land"))).alias("ep"),
        F.min(F.year("d") * 12 + F.month("d")).alias("months"),
        F.min(F.dayofyear("d")).alias("doy"),
    )


@query(f"""WITH {S.DAILY}, t AS (SELECT DISTINCT d FROM daily), lo AS (SELECT d FROM t ORDER BY abs(date_diff('day', DATE '1995-01-01', d)), d LIMIT 1), hi AS (SELECT d FROM t ORDER BY abs(date_diff('day', DATE '1995-03-31', d)), d LIMIT 1)
SELECT cell_id, daily.d AS day, v FROM daily WHERE daily.d BETWEEN (SELECT d FROM lo) AND (SELECT d FROM hi)""")
def time_range_nearest(spark, sf_dir):
    d = P.nearest_range(S.daily(spark, sf_dir), "d", F.lit("1995-01-01").cast("date"), F.lit("1995-03-31").cast("date"))
    return d.select("cell_id", F.col("d").alias("day"), "v")


@query("WITH t AS (SELECT DISTINCT CAST(l_shipdate AS TIMESTAMP) AS t FROM lineitem), g AS (SELECT epoch(t - lag(t) OVER (ORDER BY t)) / 3600 AS gap_hours FROM t) SELECT gap_hours, count(*) AS n FROM g WHERE gap_hours IS NOT NULL GROUP BY 1")
def time_gap_check(spark, sf_dir):
    return P.time_gaps(S.table(spark, sf_dir, "lineitem"), "l_shipdate")


@query("SELECT user_id AS cell_id, CAST(ts AS DATE) AS d, max(value) AS value, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS ar FROM events GROUP BY 1, 2")
def resample_daily_max(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").withColumn("ar", F.when(F.col("event_type") == "error", 1).otherwise(0)).withColumnRenamed("user_id", "cell_id")
    return P.daily_max(e, "cell_id", "ts", ["value", "ar"])


_DUP = "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate {0}, l_partkey {0}, l_suppkey {0}, l_extendedprice {0}) AS n FROM lineitem) WHERE n = 1"
_KEY, _ORDER, _OUT = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"]


@query(_DUP.format("ASC"))
def dedupe_first(spark, sf_dir):
    return P.keep_one(S.table(spark, sf_dir, "lineitem"), _KEY, _ORDER).select(*_OUT)


@query(_DUP.format("DESC"))
def dedupe_last(spark, sf_dir):
    return P.keep_one(S.table(spark, sf_dir, "lineitem"), _KEY, _ORDER, last=True).select(*_OUT)


@query("WITH f AS (SELECT *, year(o_orderdate) AS file FROM orders), m AS (SELECT file, min(o_orderdate) AS t FROM f GROUP BY 1) SELECT f.file, count(*) AS n, min(o_orderdate) AS first FROM f JOIN m USING (file) WHERE f.file = (SELECT min(file) FROM f) OR o_orderdate > t GROUP BY 1", ints=("file",))
def drop_first_step(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").withColumn("file", F.year("o_orderdate"))
    return P.drop_first_step(o, "file", "o_orderdate").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem EXCEPT SELECT s_suppkey FROM supplier)) AS missing, (SELECT count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem)) AS extra")
def grid_consistency(spark, sf_dir):
    """Cells of one cube without a partner in the other, both ways; a mismatch would be an error."""
    a = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell_id")).distinct()
    b = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"))
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(a.join(b, "cell_id", "left_anti"), "missing").crossJoin(n(b.join(a, "cell_id", "left_anti"), "extra"))  # one row each


@query("SELECT s_suppkey AS cell_id, s_suppkey // 40 AS i, s_suppkey % 40 AS j, 10 + (s_suppkey // 40) * 0.25::DOUBLE AS lat, 100 + (s_suppkey % 40) * 0.25::DOUBLE AS lon FROM supplier")
def flat_to_grid(spark, sf_dir):
    s = S.located(S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id")))
    return s.select("cell_id", F.floor(F.col("cell_id") / S.COLUMNS).alias("i"), (F.col("cell_id") % S.COLUMNS).alias("j"), "lat", "lon")


@query("SELECT o_orderkey, epoch(o_orderdate) / 3600 AS hours, epoch(o_orderdate)::BIGINT AS seconds, o_orderdate AS back FROM orders")
def cf_time_decode(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    s = F.unix_timestamp("o_orderdate")
    return o.select("o_orderkey", (s / 3600).alias("hours"), s.alias("seconds"), F.timestamp_seconds(s).cast("timestamp_ntz").alias("back"))


@query("SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders")
def common_times(spark, sf_dir):
    a, b = (S.table(spark, sf_dir, t).select(F.to_date(c).alias("d")) for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate")))
    return a.intersect(b)


@query("SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders")
def time_diff(spark, sf_dir):
    a, b = (S.table(spark, sf_dir, t).select(F.to_date(c).alias("d")) for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate")))
    return a.distinct().join(b.distinct(), "d", "left_anti")


@query("SELECT DISTINCT d FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d FROM lineitem UNION ALL SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)")
def time_union(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    return li.select(F.trunc("l_shipdate", "MM").alias("d")).distinct().unionByName(li.agg(F.to_date(F.max("l_shipdate")).alias("d"))).distinct()


@query(f"WITH {S.DAILY}, b AS (SELECT o_custkey % 100 AS cell_id, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2) SELECT cell_id, daily.d AS day, v, n FROM daily JOIN b USING (cell_id, d)")
def aligned_cubes(spark, sf_dir):
    b = S.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("cell_id"), F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return S.daily(spark, sf_dir).join(b, ["cell_id", "d"]).select("cell_id", F.col("d").alias("day"), "v", "n")


def _windows(half: int, ring: int) -> str:
    return f"w AS (SELECT cell_id, v, (dayofyear(daily.d) - 1 + o + {ring}) % {ring} + 1 AS doy FROM daily, range(-{half}, {half + 1}) r(o))"


@query(f"WITH {S.DAILY}, {_windows(7, 366)} SELECT cell_id, doy, round(quantile_cont(v::DOUBLE, 0.95), 6) AS thr FROM w GROUP BY 1, 2", ints=("doy",))
def doy_window_p95_all(spark, sf_dir):
    return T.doy_thresholds(S.daily(spark, sf_dir), "v", 0.95, 7)


_WET = "wet AS (SELECT cell_id, d, greatest(v - 3000000, 0) AS v FROM daily)"


@query(f"WITH {S.DAILY}, {_WET}, {_windows(7, 366).replace('daily', 'wet')} SELECT cell_id, doy, coalesce(round(quantile_cont(v::DOUBLE, 0.9) FILTER (WHERE v > 0), 6), 0) AS thr FROM w GROUP BY 1, 2", ints=("doy",))
def doy_window_p90_wet(spark, sf_dir):
    return T.doy_thresholds(_wet(spark, sf_dir), "v", 0.9, 7, wet=True)


def _wet(spark, sf_dir):
    return S.daily(spark, sf_dir).withColumn("v", F.greatest(F.col("v") - 3000000, F.lit(0)))


@query(f"WITH {S.DAILY}, {_WET}, {_windows(7, 366).replace('daily', 'wet')}, t AS (SELECT cell_id, doy, coalesce(round(quantile_cont(v::DOUBLE, 0.9) FILTER (WHERE v > 0), 6), 0) AS thr FROM w GROUP BY 1, 2) SELECT wet.cell_id, wet.d AS day, CAST(v >= thr AND v > 0 AS INTEGER) AS ep, CASE WHEN v >= thr AND v > 0 THEN v END AS amount, CAST(v < thr AND v > 0 AS INTEGER) AS other FROM wet JOIN t ON wet.cell_id = t.cell_id AND dayofyear(wet.d) = t.doy")
def threshold_flags(spark, sf_dir):
    d = _wet(spark, sf_dir)
    f = T.flagged(d, T.doy_thresholds(d, "v", 0.9, 7, wet=True), "v", strict=False)
    return f.select("cell_id", F.col("d").alias("day"), "ep", "amount", ((F.col("v") < F.col("thr")) & (F.col("v") > 0)).cast("int").alias("other"))


@query(f"WITH {S.DAILY}, {_WET} SELECT round(quantile_cont(v::DOUBLE, 0.95) FILTER (WHERE v > 0), 6) AS thr FROM wet")
def global_p95_wet(spark, sf_dir):
    return T.global_threshold(_wet(spark, sf_dir), "v", 0.95)


@query(f"WITH {S.DAILY}, {_windows(15, 365)} SELECT doy, round(quantile_cont(v::DOUBLE, 0.95), 6) AS thr FROM w GROUP BY 1", ints=("doy",))
def moving_window_p95(spark, sf_dir):
    return T.doy_thresholds(S.daily(spark, sf_dir), "v", 0.95, 15, 365, keys=[])


@query(f"""WITH {S.DAILY}, {_windows(15, 365)}, m AS (SELECT doy, round(quantile_cont(v::DOUBLE, 0.95), 6) AS t2 FROM w GROUP BY 1), g AS (SELECT round(quantile_cont(v::DOUBLE, 0.95), 6) AS t1 FROM daily),
f AS (SELECT v > t1 AS x, v > t2 AS y FROM daily, g, m WHERE (dayofyear(daily.d) - 1) % 365 + 1 = m.doy) SELECT count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS only_global, count(*) FILTER (WHERE y AND NOT x) AS only_window FROM f""")
def flag_overlap(spark, sf_dir):
    d = P.stored(S.daily(spark, sf_dir).select("d", "v"))  # read by both thresholds and by their flags
    m = T.doy_thresholds(d, "v", 0.95, 15, 365, keys=[]).withColumnRenamed("thr", "t2")
    g = T.exact_quantile(d, "v", 0.95, places=6, name="t1")
    f = d.withColumn("doy", (F.dayofyear("d") - 1) % 365 + 1).join(F.broadcast(m), "doy").join(F.broadcast(g))  # a row a day of the year, one row
    x, y = F.col("v") > F.col("t1"), F.col("v") > F.col("t2")
    return f.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_global"), F.count_if(y & ~x).alias("only_window"))


@query(f"WITH {S.PANEL} SELECT panel.d AS day, cell_id, CAST(sum(ep) AS BIGINT) AS extremes, CAST(sum(1 - ep) AS BIGINT) AS others FROM panel GROUP BY GROUPING SETS ((panel.d), (cell_id))")
def extreme_counts_by_time_and_cell(spark, sf_dir):
    p = S.panel(spark, sf_dir)
    g = p.groupingSets([["d"], ["cell_id"]], "d", "cell_id").agg(F.sum("ep").alias("extremes"), F.sum(1 - F.col("ep")).alias("others"))
    return g.withColumnRenamed("d", "day")


@query(f"WITH {S.PANEL}, {S.SEASON_TABLE} SELECT season, CAST(sum(ep) AS BIGINT) AS extremes, CAST(sum(greatest(v - 3000000, 0)) AS BIGINT) AS total, count(*) FILTER (WHERE v > 3000000) AS wet, round(sum(greatest(v - 3000000, 0)) / nullif(count(*) FILTER (WHERE v > 3000000), 0)::DOUBLE, 6) AS mean FROM panel JOIN seasons ON month(panel.d) = seasons.month GROUP BY 1")
def seasonal_precip_stats(spark, sf_dir):
    p = S.panel(spark, sf_dir).withColumn("month", F.month("d")).withColumn("w", F.greatest(F.col("v") - 3000000, F.lit(0))).join(S.seasons(spark), "month")
    wet = F.count_if(F.col("w") > 0)
    return p.groupBy("season").agg(F.sum("ep").alias("extremes"), F.sum("w").alias("total"), wet.alias("wet"), R(F.sum("w") / F.when(wet != 0, wet)).alias("mean"))


@query("""WITH h AS (SELECT user_id AS cell_id, date_trunc('hour', ts) AS ts, round(max(value), 2) AS v FROM events GROUP BY 1, 2),
s AS (SELECT cell_id, epoch(ts)::BIGINT AS t0, v AS v0, lead(epoch(ts)::BIGINT) OVER w AS t1, lead(v) OVER w AS v1 FROM h WINDOW w AS (PARTITION BY cell_id ORDER BY ts)),
g AS (SELECT *, unnest(range(CAST(ceil(t0 / 21600.0) AS BIGINT) * 21600, coalesce(t1, t0 + 1), 21600)) AS g FROM s)
SELECT cell_id, make_timestamp(g * 1000000) AS ts, round(v0 + CASE WHEN t1 IS NULL THEN 0 ELSE (g - t0) / (t1 - t0)::DOUBLE * (v1 - v0) END, 6) AS v FROM g""")
def interp_6h(spark, sf_dir):
    h = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.round(F.max("value"), 2).alias("v"))
    return P.interpolated(h, "ts", "v", 6).select("cell_id", F.col("ts").cast("timestamp_ntz").alias("ts"), R(F.col("v")).alias("v"))


@query(f"WITH {S.PANEL}, x AS (SELECT cell_id, date_diff('day', DATE '1995-01-01', panel.d) AS t FROM panel WHERE ar = 1), g AS (SELECT cell_id, t, t - row_number() OVER (PARTITION BY cell_id ORDER BY t) AS g FROM x) SELECT cell_id, min(t) AS first, max(t) AS last, count(*) AS n FROM g GROUP BY cell_id, g", ints=("first", "last"))
def contiguous_runs(spark, sf_dir):
    x = S.panel(spark, sf_dir).where("ar = 1").select("cell_id", F.datediff("d", F.lit("1995-01-01").cast("date")).alias("t"))
    return P.runs(x, "t", ["cell_id"])


def _smooth_sql(edge: str) -> str:
    ni, nj = ("least(greatest(i + di, 0), mi)", "least(greatest(j + dj, 0), mj)") if edge == "nearest" else ("i + di", "j + dj")
    v = "avg(x)" if edge == "nearest" else "CASE WHEN count(x) = 9 THEN avg(x) END"
    return f"""WITH {S.CELLS}, g AS (SELECT cell_id // 10 AS i, cell_id % 10 AS j, round({S.P1}, 6) AS x FROM cells), m AS (SELECT max(i) AS mi, max(j) AS mj FROM g),
n AS (SELECT i, j, {ni} AS ni, {nj} AS nj FROM g, m, range(-1, 2) r(di), range(-1, 2) q(dj)) SELECT n.i, n.j, round({v}, 6) AS x FROM n LEFT JOIN g ON n.ni = g.i AND n.nj = g.j GROUP BY 1, 2"""


def _smooth(spark, sf_dir, edge):
    from ..functions.metrics import risk_exposed

    c = counts.contingency(S.panel(spark, sf_dir), ["cell_id"])
    g = c.select(F.floor(F.col("cell_id") / 10).alias("i"), (F.col("cell_id") % 10).alias("j"), R(risk_exposed()).alias("x"))
    return P.box_smoothed(g, "x", 3, edge).select("i", "j", R(F.col("x")).alias("x"))


@query(_smooth_sql("nearest"))
def box_smooth(spark, sf_dir):
    return _smooth(spark, sf_dir, "nearest")


@query(_smooth_sql("constant"))
def box_smooth_constant(spark, sf_dir):
    return _smooth(spark, sf_dir, "constant")


@query("SELECT o_orderkey, quarter(o_orderdate) AS quarter, CASE WHEN o_custkey % 10 + 1 <= 3 THEN 'A' WHEN o_custkey % 10 + 1 <= 7 THEN 'B' ELSE 'C' END AS band FROM orders", ints=("quarter",))
def calendar_groups(spark, sf_dir):
    grid = F.col("o_custkey") % 10 + 1
    return S.table(spark, sf_dir, "orders").select("o_orderkey", F.quarter("o_orderdate").alias("quarter"), F.when(grid <= 3, "A").when(grid <= 7, "B").otherwise("C").alias("band"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY o_orderdate, o_orderkey")
def sort_by_time(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", F.to_date("o_orderdate").alias("d"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', '42', o_orderkey)), o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= least(n // 10, 5000000)")
def row_sample_10pct(spark, sf_dir):
    """A tenth of the rows, and five million at most, without replacement: the sampling operator."""
    return P.row_sample(S.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
