"""Near-duplicate documents: an LSH forest of min-hash signatures, confirmed on full sets.

* A document's set is its distinct 5-word shingles as 64-bit fingerprints.
  Documents with equal sets are one class; only its smallest key goes on.
* A signature of 128 min-hashes is read in 16 orders of eight labels.  Sorted in
  an order, documents that share at least three leading labels stand side by
  side and form a region.  A region too large for one task is taken deeper, label
  by label, as far as it must; what parts from the rest there stays in the parent
  region, in slices, and the region's hubs (its largest class, and the member with
  the most neighbours over all orders) go along with every slice.
* The members of regions that were parted so, and are not one component by then, are
  joined exactly, once for all orders: their shingles are put in one order, rare
  ones first, and two sets that are alike enough share one of their first quarter.
  A shingle there that members of two components have is a meeting; meetings of the
  same members are one.  Only a meeting too large for a task, of members that
  rare shingles cannot tell apart, is compared block by block.
* A task sorts its members by their labels in the order and goes up from the
  longest common prefix: neighbours first, then all that share just so many labels
  and are not yet connected.  It emits no pairs: it confirms candidates on full
  sets, the most alike first, and sends each member one link to the smallest key
  it reached.
* Components of the links are found by distributed star contractions.

A link of similarity 0.75 is met in some order with probability 0.9998, one of
0.8 with 0.99997; links inside a component have many chances more.

Defined cases: null or blank texts have no shingles and link with nothing;
fewer than five words are one shingle; a very long text is one set, read whole; a
null key has a null component and is kept; rows of one key are one document; of
equally alike candidates the smallest keys come first, which changes no
component; other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDERS, LABELS, LEAST_DEPTH = 16, 8, 3
#: A region of more members, or more shingles, is taken deeper or sliced.
MOST_MEMBERS, MOST_SHINGLES = 1024, 4_000_000
#: Share of equal min-hashes under which a pair is not confirmed: 4.4 deviations below 0.75.
SKETCH_LEAST = 0.58
_rng = np.random.default_rng(20_240_601)
_HASHES = _rng.integers(1, 1 << 63, ORDERS * LABELS, dtype=np.uint64) | np.uint64(1)
_PLACES = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes, hashes: C.WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle fingerprints of a UTF-8 text."""
    words = text.lower().split()  # bytes: only A-Z change, only the six blanks split
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        total += h[i : i + n] * _PLACES[i]
    return np.unique(C.mix64(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 128) min-hashes of non-empty sets."""
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(_HASHES)), np.uint32)
    for j, a in enumerate(_HASHES):
        out[:, j] = np.minimum.reduceat(every * a, starts) >> np.uint64(32)
    return out


def regions(sig: np.ndarray, depth: int) -> np.ndarray:
    """(documents, orders) fingerprint of the first ``depth`` labels in each order."""
    labels = sig.reshape(len(sig), ORDERS, LABELS).astype(np.uint64)
    h = np.arange(1, ORDERS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for d in range(depth):
        h = C.mix64(h ^ (labels[:, :, d] + np.uint64(d + 1)))
    return (h >> np.uint64(1)).astype(np.int64)


def _sets_table(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n, class binary, sig binary) of every row."""
    import hashlib

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for b in batches:
            at, size, lengths = 0, 0, C.byte_lengths(b.column(1).cast(pa.large_binary()))
            for i in range(len(b)):
                size += int(lengths[i])
                if size < 4 << 20 and i + 1 < len(b):
                    continue
                part = b.slice(at, i + 1 - at)
                at, size = i + 1, 0
                sets = [shingle_set(x, hashes, width) for x in part.column(1).cast(pa.binary()).to_pylist()]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["key", "n", "class", "sig"],
                )

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    return C.staged(src.mapInArrow(run, "key long, n long, class binary, sig binary"), "none")


def _regions_at(reps: DataFrame, depth: int) -> DataFrame:
    """(key, n, copies, order, region) of each representative in each order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(len(b), -1)
            r = regions(sig, depth)
            wide = [np.repeat(b.column(i).to_numpy(zero_copy_only=False), ORDERS) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, wide), pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), len(b))), pa.array(r.reshape(-1))], ["key", "n", "copies", "order", "region"])

    return reps.select("key", "n", "copies", "sig").mapInArrow(run, "key long, n long, copies long, order int, region long")


def _tasks(reps: DataFrame, most: int, weight: int) -> tuple[DataFrame, DataFrame | None]:
    """(task long, key long, order int): which representatives are compared together; (region, key, n, order) of regions whose members are parted, if any."""
    rows = _regions_at(reps, LEAST_DEPTH)
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1")
    rows = C.staged(rows.join(sizes, "region"))
    large = (F.col("size") > most) | (F.col("weight") > weight)
    out = rows.where(~large).select(F.col("region").alias("task"), "key", "order")
    open_rows = rows.where(large)
    if open_rows.isEmpty():
        return out, None
    # what a region's slices share: its largest class and its most connected member
    degree = rows.groupBy("key").agg(F.sum("size").alias("degree"))
    tops = open_rows.join(degree, "key").groupBy("region").agg(F.max_by("key", F.struct("copies", -F.col("key"))).alias("a"), F.max_by("key", F.struct("degree", -F.col("key"))).alias("b"))
    hubs = tops.select("region", F.explode(F.array_distinct(F.array("a", "b"))).alias("key"))

    def sliced(parts: DataFrame) -> DataFrame:
        slices = F.greatest(F.ceil(F.col("size") / most), F.ceil(F.col("weight") / weight))
        return parts.select("root", F.xxhash64("region", F.lit("slice"), F.pmod(F.xxhash64("region", "key"), slices)).alias("task"), "key", "order")

    deep = []
    live = open_rows.select("key", "n", "copies", "order", F.col("region").alias("root"), "region", "size", "weight")
    for depth in range(LEAST_DEPTH + 1, LABELS + 1):
        below = _regions_at(reps.join(live.select("key").distinct(), "key", "left_semi"), depth).select("key", "order", F.col("region").alias("below"))
        split = live.join(below, ["key", "order"])
        inner = split.groupBy("below").agg(F.count(F.lit(1)).alias("size2"), F.sum("n").alias("weight2"))
        split = C.staged(split.join(inner, "below"))
        alone = split.where("size2 = 1")
        left = alone.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
        deep.append(sliced(alone.drop("size", "weight").join(left, "region")))
        wide = (F.col("size2") > most) | (F.col("weight2") > weight)
        deep.append(split.where((F.col("size2") > 1) & ~wide).select("root", F.col("below").alias("task"), "key", "order"))
        live = split.where(wide).select("key", "n", "copies", "order", "root", F.col("below").alias("region"), F.col("size2").alias("size"), F.col("weight2").alias("weight"))
        if live.isEmpty():
            live = None
            break
    if live is not None:
        deep.append(sliced(live))
    tasks = deep[0]
    for d in deep[1:]:
        tasks = tasks.unionByName(d)
    tasks = C.staged(tasks)
    visits = tasks.select("root", "task", "order").distinct().join(hubs.withColumnRenamed("region", "root"), "root").select("task", "key", "order")
    return out.unionByName(tasks.select("task", "key", "order")).unionByName(visits).distinct(), open_rows.select("region", "key", "n", "order")


def _cross_tasks(meeting: DataFrame, most: int, weight: int) -> DataFrame:
    """(task, key, component): blocks of each large meeting (region, key, n, component, short), every two in one task that may hold a link.

    Members of the largest component are connected already, and a link has a ``short``
    member: those of one of these kinds, whichever are more, are the inner blocks, which
    are not paired with each other.  A block has half of a task's bounds.
    """
    d = C.staged(meeting)
    per = d.groupBy("region", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.count_if(~F.col("short")).alias("long"), F.sum(F.when(~F.col("short"), F.col("n")).otherwise(0)).alias("long_weight"))
    top = F.max_by(F.struct("component", "size", "weight"), F.struct("size", -F.col("component"))).alias("top")
    sums = per.groupBy("region").agg(top, *(F.sum(c).alias(c) for c in ("size", "weight", "long", "long_weight")))
    sums = sums.withColumn("by_short", F.col("long") >= F.col("top.size"))
    inner_size, inner_weight = (F.when(F.col("by_short"), F.col(x)).otherwise(F.col(f"top.{y}")) for x, y in (("long", "size"), ("long_weight", "weight")))
    blocks = lambda size, w: F.greatest(F.ceil(2 * size / most), F.ceil(2 * w / weight), F.lit(1))
    sums = sums.select("region", F.col("top.component").alias("top"), "by_short", blocks(inner_size, inner_weight).alias("inner"), blocks(F.col("size") - inner_size, F.col("weight") - inner_weight).alias("rest"))
    d = d.join(sums, "region").withColumn("is_inner", F.when(F.col("by_short"), ~F.col("short")).otherwise(F.col("component") == F.col("top")))
    draw = F.xxhash64("region", "key")
    d = d.withColumn("own", F.when(F.col("is_inner"), F.col("rest") + F.pmod(draw, F.col("inner"))).otherwise(F.pmod(draw, F.col("rest"))))
    # the others' blocks meet all blocks but themselves: inside, they are compared in each of their tasks
    d = d.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1 + F.when(F.col("is_inner"), 0).otherwise(F.col("inner"))))).where("with <> own")
    return d.select(F.xxhash64("region", F.lit("blocks"), F.least("own", "with"), F.greatest("own", "with")).alias("task"), "key", "component")


#: A shingle that more members have is placed by how many; all others come before it.
RARE = 32


def _rare_tasks(members: DataFrame, texts: DataFrame, width: int, percent: int, most: int, weight: int) -> DataFrame:
    """(task, key, component): meetings of ``members(key, component)`` by the rare shingles that they share, a prefix filter.

    Every two members of different components with at least ``percent`` of their
    shingles in common are in some task: the first shingle that both have is near the
    front of each, and nearer (``short``) in the smaller one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for b in batches:
            for key, component, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = shingle_set(text.as_py().encode(), hashes, width)
                whole = int(np.bitwise_xor.reduce(C.mix64(s)).view(np.int64)) if len(s) else 0  # tells different texts of one key apart
                same = lambda v: pa.array(np.full(len(s), v, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(key), same(component), same(len(s)), same(whole), pa.array(s.view(np.int64))], ["key", "component", "n", "whole", "shingle"])

    rows = C.staged(members.join(texts, "key").select("key", "component", "x").mapInArrow(run, "key long, component long, n long, whole long, shingle long"))
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > RARE)
    placed = rows.join(common, "shingle", "left").groupBy("key", "component", "n", "whole").agg(F.sort_array(F.collect_set(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "shingle"))).alias("s"))
    far, near = (F.col("n") - F.ceil(F.col("n") * (x * percent) / y) + 1 for x, y in ((1, 100), (2, 100 + percent)))
    first = F.transform(F.slice("s", 1, far.cast("int")), lambda x, i: F.struct(x["shingle"].alias("shingle"), (i < near).alias("short")))
    prefix = C.staged(placed.select("key", "component", "n", F.explode(first).alias("f")).select("key", "component", "n", "f.*").distinct())
    met = prefix.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or("short").alias("any"), F.bit_xor(F.xxhash64("key", "short")).alias("h1"), F.bit_xor(F.xxhash64("short", "key")).alias("h2"))
    one = C.staged(met.where("low <> high and any").groupBy("size", "weight", "h1", "h2").agg(F.min("shingle").alias("shingle")).select("shingle", "size", "weight"))
    meeting = prefix.join(one, "shingle").withColumnRenamed("shingle", "region")
    large = (F.col("size") > most) | (F.col("weight") > weight)
    small = meeting.where(~large).select(F.col("region").alias("task"), "key", "component")
    return small.unionByName(_cross_tasks(meeting.where(large).select("region", "key", "n", "component", "short"), most, weight))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least ``percent`` of their union in common."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_region(keys: np.ndarray, sets: list[np.ndarray], percent: int, order: int = 0) -> np.ndarray:
    """The smallest key that each member reaches by confirmed links inside the region.

    Members are sorted by their signatures in the region's order of labels.  From
    the deepest common prefix up, those that share just so many labels are
    candidates: first neighbours in the order, then, as long as they are not in
    one component, all others, the most alike first.  Every two members become
    candidates at the depth of their common prefix, unless they are connected by
    then, which those that part late mostly are.
    """
    n = len(keys)
    by_key = np.argsort(keys, kind="stable")
    keys, sets = keys[by_key], [sets[i] for i in by_key]
    label = np.arange(n)
    size = np.array([len(s) for s in sets])

    def confirm(i: int, j: int) -> None:
        a, b = sorted((int(label[i]), int(label[j])))
        if a != b and alike(sets[i], sets[j], percent):
            label[label == b] = a

    if n == 2:
        confirm(0, 1)
    else:
        sig = signatures(sets)
        labels = sig.reshape(n, ORDERS, LABELS)[:, order]
        sort = np.lexsort(labels.T[::-1])
        equal = labels[sort][1:] == labels[sort][:-1]
        lcp = np.concatenate([[-1], np.logical_and.accumulate(equal, axis=1).sum(axis=1)])  # with the one before
        for depth in sorted(set(lcp[1:].tolist()), reverse=True):
            heads = np.flatnonzero(lcp < depth)
            for a, b in zip(heads.tolist(), np.append(heads[1:], n).tolist()):
                if b - a > 1:
                    _link_run(sort[a:b], lcp[a:b] == depth, label, sig, size, percent, confirm)
    out = np.empty(n, np.int64)
    out[by_key] = keys[label]
    return out


def _link_run(run: np.ndarray, parts: np.ndarray, label: np.ndarray, sig: np.ndarray, size: np.ndarray, percent: int, confirm) -> None:
    """Candidates among members that share a prefix, and part at its end wherever ``parts`` is set."""
    seam = np.flatnonzero(parts[1:])
    if not len(seam) or (label[run] == label[run[0]]).all():
        return
    for i in seam.tolist():
        confirm(run[i], run[i + 1])
    sub = np.cumsum(np.concatenate([[False], parts[1:]]))
    own = label[run]
    values, count = np.unique(own, return_counts=True)
    if len(values) == 1:
        return
    # those outside the run's largest component against all, which leaves that one's members uncompared
    outer = np.flatnonzero(own != values[count.argmax()])
    least = int(np.ceil(SKETCH_LEAST * sig.shape[1]))
    first, second, score = [], [], []
    mine, wide = sig[run], size[run]
    for i in outer.tolist():
        small, large = np.minimum(wide[i], wide), np.maximum(wide[i], wide)
        may = np.flatnonzero((100 * small >= percent * large) & (own != own[i]) & (sub != sub[i]))
        same = np.count_nonzero(mine[may] == mine[i], axis=1)
        hit = same >= least
        first.append(np.full(int(hit.sum()), i)), second.append(may[hit]), score.append(same[hit])
    a, b, s = map(np.concatenate, (first, second, score))
    once = (a < b) | (own[b] == values[count.argmax()])  # a pair of outer members was met from both sides
    a, b, s = a[once], b[once], s[once]
    best = np.argsort(-s, kind="stable")
    a, b = run[a[best]], run[b[best]]
    while len(a):
        for i, j in zip(a[:512].tolist(), b[:512].tolist()):
            confirm(i, j)
        apart = label[a[512:]] != label[b[512:]]
        a, b = a[512:][apart], b[512:][apart]


def link_exactly(keys: np.ndarray, sets: list[np.ndarray], known: np.ndarray, percent: int) -> np.ndarray:
    """The smallest component of ``known`` that each member reaches by links between members of different components.

    A member's overlaps with all others are counted at once, from the members of each of
    its shingles, so every pair is judged on its full sets.  Members of the largest
    component are not compared with each other.
    """
    n, size = len(keys), np.array([len(s) for s in sets])
    own, label = np.unique(known, return_inverse=True)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    shingle = np.unique(every, return_inverse=True)[1]
    order = np.argsort(shingle, kind="stable")
    holders, each = owner[order], np.bincount(shingle)
    start = np.cumsum(each) - each
    ends = np.cumsum(size)
    largest = np.bincount(label).argmax()
    for i in np.flatnonzero(label != largest).tolist():
        mine = shingle[ends[i] - size[i] : ends[i]]
        both = np.bincount(holders[C.ragged(start[mine], each[mine])], minlength=n)
        hit = (100 * both >= percent * (size[i] + size - both)) & (both > 0)
        met = np.unique(label[hit])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return own[label]


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, most_members: int = MOST_MEMBERS, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``."""
    table = _sets_table(df, key, text, width)
    known = table.where("key is not null and n > 0")
    classes = known.groupBy("class").agg(F.min(F.struct("key", "n", "sig")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = C.staged(classes.select("class", "r.key", "r.n", "r.sig", "copies"), "none")
    tasks, parted = _tasks(reps, most_members, most_shingles)
    tasks = C.staged(tasks)

    def compare(t: pa.Table) -> pa.Table:
        hashes = C.WordHashes()
        keys = t.column("key").to_numpy()
        keys, first = np.unique(keys, return_index=True)
        texts = t.column("x").cast(pa.large_binary())
        reached = link_region(keys, [shingle_set(texts[i].as_py(), hashes, width) for i in first.tolist()], percent, t.column("order")[0].as_py()) if len(keys) > 1 else keys
        own = reached != keys
        return pa.table({"a": pa.array(keys[own]), "b": pa.array(reached[own])})

    def compare_across(t: pa.Table) -> pa.Table:
        hashes = C.WordHashes()
        keys, first = np.unique(t.column("key").to_numpy(), return_index=True)
        texts, known = t.column("x").cast(pa.large_binary()), t.column("component").to_numpy()[first]
        to = link_exactly(keys, [shingle_set(texts[i].as_py(), hashes, width) for i in first.tolist()], known, percent)
        a, b = np.unique(np.stack([known, to])[:, known != to], axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("x")).where("key is not null and x is not null")
    links = tasks.join(texts, "key").groupBy("task").applyInArrow(compare, "a long, b long")
    same_key = known.join(reps.select("class", F.col("key").alias("rep")), "class").where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    multi = known.groupBy("key").agg(F.countDistinct("class").alias("sets")).where("sets > 1").select("key")  # rows of one key with different texts
    links = links.unionByName(same_key.join(multi.withColumnRenamed("key", "a"), "a", "left_semi"))
    found = C.components(links)
    member = reps.select("class", F.col("key").alias("rep")).join(found.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    across = None
    if parted is not None:
        own = parted.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        apart = own.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        members = C.staged(own.join(apart.select("region"), "region", "left_semi").select("key", "component").distinct())
        if not members.isEmpty():
            across = C.staged(_rare_tasks(members, texts, width, percent, most_members, most_shingles))
    if across is not None and not across.isEmpty():
        more = across.join(texts, "key").groupBy("task").applyInArrow(compare_across, "a long, b long")
        merged = C.components(more).select(F.col("node").alias("component_id"), F.col("component").alias("merged"))
        member = member.join(merged, "component_id", "left").select("class", F.coalesce("merged", "component_id").alias("component_id"))
    rows = table.drop("sig").join(member, "class", "left")
    own = F.coalesce("component_id", "key")
    return rows.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), own).alias("component_id"), F.coalesce(F.col("key") == own, F.lit(True)).alias("kept"))


def near_duplicates_sql(width: int = 5, percent: int = 75) -> str:
    """The same in DuckDB's SQL: all pairs that share a shingle, and a closure of their links."""
    last = width - 1
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {last}, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {last}], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= {percent} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""
