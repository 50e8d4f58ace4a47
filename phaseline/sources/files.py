"""Readers and writers of the files that panels and index series come in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Date forms tried in turn (fixed values).
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd", "yyyy-MM")
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def work_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")  # one machine
    return f"{base.rstrip('/')}/panel-{uuid.uuid4().hex}"


def any_date(text: Column) -> Column:
    """The first date form that fits, NULL if none does."""
    return F.to_date(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMS)))


def _data_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of a CSV file below its header lines, named by position.

    Header lines are told by their content, which starts with no digit, so the
    file stays splittable.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d"))
    schema = ", ".join(f"{c} string" for c in columns)
    parsed = F.from_csv("value", schema, {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return lines.select(parsed.alias("r")).select("r.*")


def read_dated_index(spark: SparkSession, path: str) -> DataFrame:
    """(day, value): date and value in the first two columns after a two-line header; bad rows are dropped."""
    d = _data_lines(spark, path, ["day", "value"])
    return d.select(any_date(F.col("day")).alias("day"), F.expr("try_cast(value AS double)").alias("value")).dropna()


def read_daily_two_part_index(spark: SparkSession, path: str) -> DataFrame:
    """(day, amplitude, phase) of the ten positional columns after a three-line header; bad dates are dropped."""
    names = ["year", "month", "dom", "rmm1", "rmm2", "phase", "amplitude", "weight", "c9", "c10"]
    d = _data_lines(spark, path, names)
    n = lambda c, t="int": F.expr(f"try_cast({c} AS {t})")
    day = F.try_make_timestamp(n("year"), n("month"), n("dom"), F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
    return d.select(day.alias("day"), n("amplitude", "double").alias("amplitude"), n("phase").alias("rmm_phase")).where("day is not null")


def read_monthly_index(spark: SparkSession, path: str) -> DataFrame:
    """(ym, value) of (year, month, value)."""
    d = _data_lines(spark, path, ["year", "month", "value"])
    return d.selectExpr("make_date(try_cast(year AS int), try_cast(month AS int), 1) AS ym", "try_cast(value AS double) AS value").dropna()


def read_wide_index(spark: SparkSession, path: str) -> DataFrame:
    """(ym, value) of a year column and twelve month columns."""
    from ..operators.modes import wide_to_long

    d = _data_lines(spark, path, ["Year", *MONTHS])
    d = d.selectExpr("try_cast(Year AS int) AS Year", *(f"try_cast({m} AS double) AS {m}" for m in MONTHS))
    return wide_to_long(d, "Year", MONTHS, "value").dropna()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, a, b, c, d) of a saved table; cells are named, never counted by line."""
    return spark.read.schema("cell_id long, a long, b long, c long, d long").option("header", True).csv(path)


def read_panel(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """One panel of several Parquet files or folders; columns a file lacks are NULL."""
    r = spark.read.option("mergeSchema", True)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(*paths)


def write_panel(df: DataFrame, path: str, by: list[str] | None = None, attributes: dict[str, dict] | None = None, codec: str = "zstd") -> None:
    """Parquet, partitioned by year or the like, with each column's attributes as metadata."""
    for c, meta in (attributes or {}).items():
        df = df.withMetadata(c, meta)
    w = df.write.option("compression", codec)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV folder a table, as the sheets of a workbook; returns the names written."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
    return list(tables)


def cached_stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written first if it is not there yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def counted_stage(spark: SparkSession, path: str, inputs: list[str], partial, merge, version: str = "") -> DataFrame:
    """``merge`` of the partial results of each input file, which are kept at ``path`` from call to call.

    ``partial(df, by)`` makes mergeable rows (counts, sums, extremes) of ``df``, grouped by
    the columns ``by`` besides its own; ``merge(rows)`` puts those of all files together.
    Results are kept by what made them (the plan of ``partial`` over the files' schema, and
    ``version``, which must change with what a plan doesn't show, as a Python function) and by
    each file's path, length and time: a new or changed file is read alone, a changed
    maker makes all anew, files that are gone don't count, and a job that
    failed has kept nothing.
    """
    import hashlib
    import re

    whole = spark.read.parquet(*inputs)
    digest = lambda p, n, t: F.sha2(F.concat_ws("|", p, n.cast("string"), F.unix_micros(t).cast("string")), 256)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(inputs)
    # a row a file, without its contents; the name here is plain, in a row's metadata it is encoded
    listed = there.select("path", digest(F.regexp_replace("path", "^file:/+", "file:/"), F.col("length"), F.col("modificationTime")).alias("source")).collect()
    made = partial(whole.limit(0).withColumn("source", F.lit("")), ["source"])
    plan = re.sub(r"#\d+L?", "", made._jdf.queryExecution().analyzed().canonicalized().toString())
    plan = re.sub(r"Relation \[[^\]]*\] parquet", "Relation", plan)
    base = f"{path.rstrip('/')}/maker={hashlib.sha256(f'{version}|{whole.schema.json()}|{plan}'.encode()).hexdigest()[:32]}"
    kept: dict[str, str] = {}
    for batch in _folders(spark, base):
        if any(f.endswith("/_SUCCESS") for f in _names(spark, batch)):
            for f in _folders(spark, batch):
                kept.setdefault(f.rpartition("source=")[2], f)
    if new := [r.path for r in listed if r.source not in kept]:
        plain = F.regexp_replace(F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
        d = spark.read.parquet(*new).withColumn("source", digest(plain, F.col("_metadata.file_size"), F.col("_metadata.file_modification_time")))
        batch = f"{base}/batch={uuid.uuid4().hex}"
        partial(d, ["source"]).repartition("source").write.partitionBy("source").parquet(batch)
        for f in _folders(spark, batch):
            kept.setdefault(f.rpartition("source=")[2], f)
    own = [kept[r.source] for r in listed if r.source in kept]  # a file without rows leaves none
    rows = spark.read.schema(made.drop("source").schema).parquet(*own) if own else made.drop("source")
    return merge(rows)


def _listing(spark: SparkSession, folder: str) -> list:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _folders(spark: SparkSession, folder: str) -> list[str]:
    return sorted(s.getPath().toString() for s in _listing(spark, folder) if s.isDirectory())


def _names(spark: SparkSession, folder: str) -> list[str]:
    return [s.getPath().toString() for s in _listing(spark, folder) if s.isFile()]
