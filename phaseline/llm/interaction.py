"""How filters share the work: every order of them, visited by single swaps.

Each document is reduced to a mask of the filters that it fails, and masks are
counted per part: at most 32 cells a part for five filters, whatever the corpus.
The orders are then walked so that one follows from the last by a swap of two
neighbours (plain changes).  A swap leaves what every other step removes as it
was, so only two steps are counted anew from the cells; what each filter removes
adds up to its Shapley value along the walk.  One walk serves all parts of a batch.

The duplicate filter looks at the whole table: a document fails it if a smaller
key has the same text.  Rows meet as digests, counted before they are sent, so a
text with many copies is a few rows.

Defined cases: a null text is empty, a null part the empty string; a null key is
no copy of a smaller one, has no labels, and no other key is larger than it; rows
of one key count each time and are not copies of each other; a key with several
labels is good, or toxic, if any says so; very long texts are judged whole; other
columns are ignored, whatever their names; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose walks are made together.
PARTS_AT_ONCE = 64


def text_filters(text: Column) -> dict[str, Column]:
    """Letter -> whether a text fails that filter; these look at nothing but the text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": F.lit(100) * different.cast("long") < F.lit(50) * n.cast("long"),
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > F.lit(3) * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail, bit 0 for A."""
    d = documents.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    fails = list(text_filters(F.col("t")).values())
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    slim = d.select("k", "part", mask.alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest"))
    rows = slim.groupBy("k", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    says = labels.select(F.col(key).cast("long").alias("k"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("x"))
    says = says.where("k is not null").groupBy("k").agg(F.coalesce(F.max("q"), F.lit(False)).alias("good"), F.coalesce(F.max("x"), F.lit(False)).alias("toxic"))
    rows = rows.join(says, "k", "left").fillna(False, ["good", "toxic"])
    first = F.min(F.when(F.col("k").isNotNull(), F.struct("k", "n")))  # rows of one key, text and part are one row here
    same = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(first.alias("first"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    same = same.withColumn("least", F.min("first.k").over(Window.partitionBy("digest")))  # a row for each part and label at most
    passing = F.col("unnamed") + F.when(F.col("first.k") == F.col("least"), F.col("first.n")).otherwise(0)
    same = same.withColumn("passing", passing)
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("passing").alias("c")), F.struct((F.col("mask") + (1 << len(fails))).alias("m"), (F.col("n") - F.col("passing")).alias("c"))))
    each = same.select("part", "good", "toxic", both.alias("b")).select("part", F.col("b.m").alias("mask"), F.col("b.c").alias("c"), "good", "toxic")
    some = lambda x: F.sum(F.when(F.col(x), F.col("c")).otherwise(0))
    return each.groupBy("part", "mask").agg(F.sum("c").alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places i whose neighbours i, i + 1 are swapped in turn, so that n things go through all their orders once."""
    if n < 2:
        return
    inner = plain_changes(n - 1)  # the last thing runs to and fro through each order of the others
    while True:
        yield from range(n - 2, -1, -1)
        at = next(inner, None)
        if at is None:
            return
        yield at + 1
        yield from range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at


def walk(table: np.ndarray, names: str) -> tuple[list[str], np.ndarray]:
    """Orders as strings, and their counts as (parts, orders, steps, COUNTS), from mask cells (parts, masks, [n, good, toxic])."""
    k = len(names)
    masks = np.arange(1 << k)
    total = table[:, :, 0].sum(axis=1)
    fails = np.stack([table[:, masks >> f & 1 == 1, 0].sum(axis=1) for f in range(k)], axis=1)
    alone = np.stack([table[:, 1 << f, 0] for f in range(k)], axis=1)
    shapley = np.zeros((len(table), k), np.int64)
    order = list(range(k))
    steps = np.zeros((len(table), k, 3), np.int64)  # what each step of the order removes: documents, good ones, toxic ones

    def count(step: int) -> None:
        earlier = sum(1 << f for f in order[:step])
        steps[:, step] = table[:, (masks >> order[step] & 1 == 1) & (masks & earlier == 0)].sum(axis=1)

    def visit() -> None:
        removed = steps[:, :, 0]
        shapley[:, order] += removed
        orders.append("".join(names[f] for f in order))
        filters.append(list(order))
        seen.append(np.stack([total[:, None] - np.cumsum(removed, axis=1), removed, fails[:, order] - removed, alone[:, order], steps[:, :, 1], steps[:, :, 2]], axis=2))

    orders, filters, seen = [], [], []
    for step in range(k):
        count(step)
    visit()
    for i in plain_changes(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        count(i), count(i + 1)
        visit()
    return orders, np.concatenate([np.stack(seen, axis=1), shapley[:, np.array(filters)][..., None]], axis=3)


def audit(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of ``cells``' rows, for every order of the filters."""
    size = 1 << len(names)
    rows = counted.groupBy("part").agg(*(F.collect_list(c).alias(c) for c in ("mask", "n", "good", "toxic")))  # a row a mask at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), PARTS_AT_ONCE):
                some = b.slice(at, PARTS_AT_ONCE)
                parts = some.column(0)
                table = np.zeros((len(some), size, 3), np.int64)
                for i, (m, *values) in enumerate(zip(*(some.column(c).to_pylist() for c in range(1, 5)))):
                    for j, v in enumerate(values):
                        table[i, m, j] = v
                orders, counts = walk(table, names)
                k, n = len(names), len(orders)
                own = pa.array(np.repeat(np.arange(len(some)), n * k))
                order = pa.array(np.tile(np.repeat(np.arange(n), k), len(some)))
                step = np.tile(np.arange(1, k + 1, dtype=np.int32), len(some) * n)
                flat = counts.reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([parts.take(own), pa.array(orders).take(order), pa.array(step), *(pa.array(flat[:, j]) for j in range(len(COUNTS)))], ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five standard filters, per language."""
    return audit(C.staged(cells(documents, labels)))


def filter_audit_sql() -> str:
    """The same in DuckDB's SQL, every order judged from the start."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    bit = lambda i: f"(1 << (ascii(substr(o, {i}, 1)) - 65))"
    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
             + 4 * CAST(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) AS INT)
             + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
f(f) AS {letters},
p AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, CAST(i AS INT) AS step, substr(o, i, 1) AS letter, {bit("i")} AS own,
             CAST(coalesce(list_sum(list_transform(range(1, i), lambda j: {bit("j")})), 0) AS INT) AS earlier FROM (SELECT o, unnest(range(1, 6)) AS i FROM p)),
r AS (SELECT part, o, step, letter, coalesce(sum(n) FILTER (WHERE mask & (own | earlier) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & earlier = 0), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & earlier > 0), 0) AS redundant,
             coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & earlier = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & earlier = 0), 0) AS toxic_lost
      FROM c, s GROUP BY part, o, step, letter)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r"""
