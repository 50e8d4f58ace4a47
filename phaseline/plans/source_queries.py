"""Files written and read back: index series, count tables, partitioned panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import counts
from ..sources import cube, files, grib
from . import standins as S
from .registry import query

R = lambda x, k=6: F.round(x, k)


def _text_file(spark, lines, head: list[str]) -> str:
    """A text file with header lines first, in the shared folder."""
    path = files.work_folder(spark)
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.text(path)
    lines.write.mode("append").text(path)
    return path


@query(f"WITH {S.MONTHLY} SELECT ym AS day, value FROM monthly WHERE mode = 'ENSO'")
def read_enso_csv(spark, sf_dir):
    m = S.monthly_index(spark, sf_dir).where("mode = 'ENSO'")
    form = F.when(F.month("ym") % 2 == 0, F.date_format("ym", "yyyy-MM-dd")).otherwise(F.date_format("ym", "MM/dd/yyyy"))
    path = _text_file(spark, m.select(F.concat_ws(",", form, F.col("value").cast("string")).alias("value")), ["Index of a mode", "Date,Value", "1999-99-99,0.5", "1996-01-15,missing"])
    return files.read_dated_index(spark, path)


@query(f"WITH {S.INDEX_DAYS} SELECT day, amplitude, CAST(rmm_phase AS INTEGER) AS rmm_phase FROM dindex")
def read_mjo_csv(spark, sf_dir):
    d = S.daily_index(spark, sf_dir)
    row = F.concat_ws(",", F.year("day").cast("string"), F.month("day").cast("string"), F.dayofmonth("day").cast("string"), F.lit("0.1"), F.lit("0.2"), F.col("rmm_phase").cast("string"), F.col("amplitude").cast("string"), F.lit("w"), F.lit(""), F.lit(""))
    path = _text_file(spark, d.select(row.alias("value")), ["RMM values", "source", "year,month,day,RMM1,RMM2,phase,amplitude,weight,,", "1996,13,1,0,0,1,2.0,w,,"])
    return files.read_daily_two_part_index(spark, path)


@query(f"WITH {S.MONTHLY} SELECT ym, value FROM monthly WHERE mode = 'AO'")
def read_ao_csv(spark, sf_dir):
    m = S.monthly_index(spark, sf_dir).where("mode = 'AO'")
    path = _text_file(spark, m.select(F.concat_ws(", ", F.year("ym").cast("string"), F.month("ym").cast("string"), F.col("value").cast("string")).alias("value")), ["year, month, index"])
    return files.read_monthly_index(spark, path)


@query(f"WITH {S.MONTHLY} SELECT ym, value FROM monthly WHERE mode = 'PDO'")
def read_pdo_wide(spark, sf_dir):
    m = S.monthly_index(spark, sf_dir).where("mode = 'PDO'").withColumn("y", F.year("ym")).withColumn("m", F.date_format("ym", "MMM"))
    wide = m.groupBy("y").pivot("m", files.MONTHS).agg(F.first("value"))
    path = _text_file(spark, wide.select(F.concat_ws(",", F.col("y").cast("string"), *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in files.MONTHS)).alias("value")), ["Year," + ",".join(files.MONTHS)])
    return files.read_wide_index(spark, path)


@query(f"WITH {S.CELLS} SELECT cell_id, a, b, c, d, round({S.AF}, 6) AS af, round({S.PAF}, 6) AS paf FROM cells")
def read_abcd(spark, sf_dir):
    """Counts saved as CSV, read back, and measured again."""
    path = files.work_folder(spark)
    files.write_csv(counts.contingency(S.panel(spark, sf_dir), ["cell_id"]), path)
    return files.read_counts(spark, path).select("cell_id", *"abcd", R(M.attributable_fraction()).alias("af"), R(M.population_attributable_fraction()).alias("paf"))


@query(f"WITH {S.DAILY} SELECT year(daily.d) AS year, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM daily WHERE year(daily.d) BETWEEN 1997 AND 1999 GROUP BY 1", ints=("year",))
def partitioned_panel(spark, sf_dir):
    """A panel written by year and read with only the years asked for."""
    path = files.work_folder(spark)
    files.write_panel(S.daily(spark, sf_dir).withColumn("year", F.year("d")), path, ["year"], {"v": {"units": "cents", "long_name": "amount"}})
    return files.read_panel(spark, path).where("year between 1997 and 1999").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query(f"WITH {S.DAILY} SELECT cell_id, round(quantile_cont(v::DOUBLE, 0.95), 6) AS thr FROM daily GROUP BY 1")
def threshold_cache(spark, sf_dir):
    """A stage table that is made once and found the second time."""
    path = files.work_folder(spark)
    make = lambda: S.daily(spark, sf_dir).groupBy("cell_id").agg(R(F.percentile("v", F.lit(0.95))).alias("thr"))
    files.cached_stage(spark, path, make)
    return files.cached_stage(spark, path, make)


@query(f"WITH {S.CELLS} SELECT cell_id, a, b, c, d FROM cells")
def staged_counts(spark, sf_dir):
    """Counts a cell kept by input file: the panel's first years are counted, then the last ones are added, and only they are read."""
    base, stage = files.work_folder(spark), files.work_folder(spark)
    p = S.panel(spark, sf_dir).select("cell_id", "ar", "ep", (F.year("d") > 1996).alias("late"))
    files.write_panel(p, base, ["late"])
    partial = lambda df, by: counts.contingency(df, [*by, "cell_id"])
    merge = lambda rows: rows.groupBy("cell_id").agg(*(F.sum(x).alias(x) for x in "abcd"))
    files.counted_stage(spark, stage, [f"{base}/late=false"], partial, merge)
    return files.counted_stage(spark, stage, [f"{base}/late=false", f"{base}/late=true"], partial, merge)


@query(f"WITH {S.MONTHLY}, n AS (SELECT mode, count(*) AS n FROM monthly GROUP BY 1) SELECT mode, n FROM n")
def multi_file_panel(spark, sf_dir):
    """Several folders read as one table."""
    m, base = S.monthly_index(spark, sf_dir), files.work_folder(spark)
    for mode in S.MODES:
        files.write_panel(m.where(F.col("mode") == mode), f"{base}/{mode}")
    return files.read_panel(spark, *(f"{base}/{mode}" for mode in S.MODES), glob="*.parquet").groupBy("mode").agg(F.count(F.lit(1)).alias("n"))



_FIELDS = ["v", "ar"]
_META = {"": {"title": "daily amounts"}, "v": {"units": "cents", "long_name": "amount"}, "ar": {"units": "1", "long_name": "exposure"}}


def _cube(spark, sf_dir, level: int) -> str:
    """The panel written as a cube of chunks."""
    path = files.work_folder(spark)
    d = S.located(S.daily(spark, sf_dir)).select(F.col("d").cast("timestamp").alias("ts"), "lat", "lon", F.col("v").cast("double").alias("v"), "ar")
    cube.write(d, path, _FIELDS, _META, level, hours=24 * 30, degrees=2.0)
    return path


def _panel_rows(c):
    """A cube's points that hold something, as the panel's rows."""
    return c.where("v is not null").select(F.to_date("ts").alias("day"), "lat", "lon", F.col("v").cast("long").alias("v"), F.col("ar").cast("int").alias("ar"))


_PLACED = f"{S.DAILY}, placed AS (SELECT daily.d AS day, 10 + (cell_id // {S.COLUMNS}) * CAST(0.25 AS DOUBLE) AS lat, 100 + (cell_id % {S.COLUMNS}) * CAST(0.25 AS DOUBLE) AS lon, v, ar FROM daily)"


@query(f"WITH {_PLACED} SELECT * FROM placed", ints=("ar",))
def cube_round_trip(spark, sf_dir):
    """The whole panel written as compressed NetCDF chunks with attributes, and read back."""
    return _panel_rows(cube.read(spark, [_cube(spark, sf_dir, 4)], _FIELDS))


@query(f"WITH {_PLACED} SELECT * FROM placed WHERE day BETWEEN DATE '1996-03-01' AND DATE '1996-09-30' AND lat BETWEEN 10.0 AND 10.25 AND lon BETWEEN 102.0 AND 107.5", ints=("ar",))
def cube_box(spark, sf_dir):
    """A box and a range of times of a cube: only chunks that meet it are opened, only its times and latitudes are read."""
    c = cube.read(spark, [_cube(spark, sf_dir, 0)], _FIELDS)
    box = (F.col("lat").between(10.0, 10.25)) & F.col("lon").between(102.0, 107.5) & F.col("ts").between(F.lit("1996-03-01").cast("timestamp"), F.lit("1996-09-30").cast("timestamp"))
    return _panel_rows(c.where(box))


def _fields(spark, sf_dir) -> str:
    """The panel's amounts (228) and exposures (167), a GRIB message a day each."""
    path = files.work_folder(spark)
    d = S.located(S.daily(spark, sf_dir))
    both = F.explode(F.array(*(F.struct(F.lit(p).alias("param"), x.cast("double").alias("value")) for p, x in ((228, F.floor(F.col("v") / 100)), (167, F.col("ar")))))).alias("f")
    d = d.select(F.col("d").cast("timestamp").alias("ts"), "lat", "lon", both).select("ts", "lat", "lon", "f.*", F.lit(1).alias("level_type"), F.lit(0).alias("level"))
    grib.write(d, path)
    return path


@query(f"WITH {_PLACED} SELECT day, lat, lon, v // 100 AS value FROM placed WHERE day >= DATE '1996-06-01'")
def grib_messages(spark, sf_dir):
    """One parameter's fields from a date on: the other's messages are passed over by their headers."""
    g = grib.read(spark, [_fields(spark, sf_dir)]).where("param = 228 and ts >= timestamp'1996-06-01' and value is not null")
    return g.select(F.to_date("ts").alias("day"), "lat", "lon", F.col("value").cast("long").alias("value"))


@query(f"WITH {_PLACED}, f AS (SELECT date_trunc('month', day)::DATE AS month, day, lat, lon, ar FROM placed WHERE dayofmonth(day) = 1) SELECT month, count(*) AS points, CAST(sum(ar) AS BIGINT) AS exposed FROM f GROUP BY 1")
def grib_first_of_month(spark, sf_dir):
    """An index of all messages as a table; the messages chosen from it are decoded, a byte range each."""
    path = files.work_folder(spark)
    grib.headers(spark, [_fields(spark, sf_dir)]).write.parquet(path)
    chosen = spark.read.parquet(path).where("param = 167 and dayofmonth(ts) = 1")
    return grib.points(chosen).where("value is not null").groupBy(F.trunc("ts", "MM").alias("month")).agg(F.count(F.lit(1)).alias("points"), F.sum("value").cast("long").alias("exposed"))


@query(f"WITH {S.CELLS} SELECT 'counts' AS sheet, cell_id, CAST(a AS DOUBLE) AS value FROM cells UNION ALL SELECT 'shares', cell_id, round(a / nullif(a + b, 0)::DOUBLE, 6) FROM cells")
def report_sheets(spark, sf_dir):
    """Several tables written under one report, and read back by name."""
    c = counts.contingency(S.panel(spark, sf_dir), ["cell_id"])
    folder = files.work_folder(spark)
    names = files.write_report({"counts": c.select("cell_id", F.col("a").cast("double").alias("value")), "shares": c.select("cell_id", R(M.risk_exposed()).alias("value"))}, folder)
    read = lambda n: spark.read.schema("cell_id long, value double").option("header", True).csv(f"{folder}/{n}").select(F.lit(n).alias("sheet"), "cell_id", "value")
    first, *rest = map(read, names)
    for other in rest:
        first = first.unionByName(other)
    return first
