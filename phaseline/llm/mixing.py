"""Mixing sources to target weights by hash-random keys and prefix sums.

Every row gets a hash-random key, 60 bits of an md5 that any SQL engine has.  Within a source the rows are ordered by key;
key ranges cut that order into buckets small enough for one task, so the prefix
sum of sizes is a sum over whole buckets plus a running sum inside the one
bucket where a source's budget ends.  Only that bucket is sorted.  A budget over
the source's size takes all rows for whole epochs first.

Targets: weights share the total; no target exceeds ``cap`` times its source's
size, and what is above is shared out again by weight until none is.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null
source is a source; a very long text is one row like others; rows of one key and
size are alike, and a budget that ends among them cuts one of them; other columns
are ignored by ``mixture`` and kept, whatever their names, by ``apply_mixture``;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Rows that a bucket holds on average.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 if null."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cycled_weights(sources: DataFrame, source: str, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` with a column ``weight``: the weights in turn, by code point, null last.

    Ranks are positions in a range-partitioned order, so no task holds all sources.
    """

    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = pa.array(np.arange(at, at + len(b), dtype=np.int64))
            at += len(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), part, np.int64)), ids], ["source", "part", "at"])

    one = sources.select(F.col(source).alias("source"))
    parts = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = C.staged(one.repartitionByRange(parts, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).mapInArrow(number, "source string, part long, at long"))
    before = C.prefix_sums(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "n")
    turn = F.pmod(F.col("before") + F.col("at"), F.lit(len(weights)))
    ranked = placed.join(before, "part").select("source", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double").alias("weight"))
    return sources.join(ranked, sources[source].eqNullSafe(ranked["source"])).select(sources["*"], "weight")


def fill_targets(sources: DataFrame, cap: float, share: float) -> DataFrame:
    """``sources(size, weight)`` with ``target``: water filled up to ``cap`` times each size."""
    limit = F.lit(float(cap)) * F.col("size")
    total = float(sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) * share
    level = 0.0
    while True:  # a scalar a round; the set of full sources only grows
        full = limit < F.lit(level) * F.col("weight")
        r = sources.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not r.w:
            break
        rise = (total - r.full) / r.w
        if rise <= level:
            break
        level = rise
    return sources.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def mix(df: DataFrame, source: str, size: str, key: str, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0, seed: int = 42) -> DataFrame:
    """``df`` with ``source_size``, ``target`` (its source's) and ``taken`` (of its size, repeats counted).

    ``df`` is read several times, so it should be a stored table.
    """
    n = df.count()
    bits = min(40, max(6, (n // BUCKET_ROWS).bit_length()))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    rows = df.withColumn("_order", order).withColumn("_bucket", F.shiftright("_order", 60 - bits))
    buckets = C.staged(rows.groupBy(F.col(source).alias("_source"), "_bucket").agg(F.sum(size).alias("n")))
    sizes = C.staged(buckets.groupBy("_source").agg(F.sum("n").alias("size")))
    targets = fill_targets(cycled_weights(sizes, "_source", weights), cap, share)
    budget = F.least(F.floor(F.col("target") + 0.5), F.lit(cap) * F.col("size")).cast("long")
    epochs = F.when(F.col("size") > 0, F.expr("budget div size")).otherwise(F.lit(0).cast("long"))
    targets = targets.withColumn("budget", budget).withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = buckets.withColumn("before", before).withColumnRenamed("_source", "_s")
    cut = targets.join(prefix, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")) & (F.col("rest") > 0), "left")
    plan = C.staged(cut.select("_source", F.col("size").alias("source_size"), "target", "epochs", "rest", F.coalesce("_bucket", F.lit(-1)).alias("_cut"), F.coalesce("before", F.lit(0)).alias("_before")))
    rows = rows.join(plan, F.col(source).eqNullSafe(F.col("_source")))
    whole = rows.where("_bucket <> _cut").withColumn("_extra", F.when(F.col("_bucket") < F.col("_cut"), F.col(size)).otherwise(0))
    inside = Window.partitionBy("_source").orderBy("_order", key, size).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("_bucket = _cut").withColumn("_left", F.col("rest") - F.col("_before") - F.coalesce(F.sum(size).over(inside), F.lit(0)))
    edge = edge.withColumn("_extra", F.least(F.greatest("_left", F.lit(0)), F.col(size))).drop("_left")
    taken = (F.col("epochs") * F.col(size) + F.col("_extra")).cast("long").alias("taken")
    return whole.unionByName(edge).select(*df.columns, "source_size", "target", taken)


def mixture(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``df``."""
    sized = C.staged(df.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("_from"), word_count(F.col(text)).alias("size")))
    return mix(sized, "_from", "size", "doc_id", **how).drop("_from")


def mixture_sql(weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 42) -> str:
    """The same query in DuckDB's SQL; the level comes in closed form from the order in which sources fill."""
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws('|', '{seed}', doc_id)), 1, 15) AS BIGINT) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT source, size, CAST({list(weights)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS DOUBLE) AS weight FROM s),
k AS (SELECT *, CAST({cap} AS DOUBLE) * size AS lim, (SELECT CAST(sum(size) AS DOUBLE) FROM s) AS total FROM w),
f AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
  sum(weight) OVER (ORDER BY lim / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM k),
v AS (SELECT (total - lower) / above AS level FROM f WHERE (total - lower) / above <= lim / weight ORDER BY lim / weight, source LIMIT 1),
t AS (SELECT source, size AS source_size, least(lim, level * weight) AS target FROM f, v),
b AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), {cap} * source_size) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT d.*, source_size, target, epochs, budget - epochs * source_size AS rest,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(rest - before, 0), size) AS BIGINT) AS taken FROM p"""


def apply_mixture(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``df`` as the mixture takes them, whole and with repeats.

    A row comes ``taken / size`` times, rounded to whole copies, so at most one
    row a source differs from its exact share.
    """
    plain = [f"c{i}" for i in range(len(df.columns))]
    at = {c: p for c, p in zip(df.columns, plain)}
    d = df.toDF(*plain).withColumn("size", word_count(F.col(at[text])))
    taken = mix(C.staged(d), at[source], "size", at[key], **how)
    copies = F.when(F.col("size") > 0, F.expr("(2 * taken + size) div (2 * size)")).otherwise(F.lit(0)).cast("int")
    return taken.withColumn("copies", copies).where("copies > 0").select(*plain, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select(*(F.col(p).alias(c) for c, p in at.items()))
