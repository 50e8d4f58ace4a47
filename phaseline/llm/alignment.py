"""Which tokens of two tokenizers end together, and how often each pair does so.

Both tokenizers read a text; their tokens' byte ends are compared, and a pair of
tokens that end at one byte is a link.

* A link is one whole number, the second tokenizer's id in the high 32 bits and the
  first's in the low ones.  Each task sums its links to partial counts (sorted,
  distinct), which are dealt out by key ranges, sorted and summed run by run: the
  shards of the corpus-wide counts, in the order of keys.
* Shards are files of two sorted columns.  Spark ships them to its executors, where they
  are mapped into memory and searched; nothing of them is loaded as a whole.  Their
  rows are bounded by the product of the two vocabularies, not by the corpus.

A text stays out, with zeros and no groups, if a tokenizer's bytes do not add up to
a space and the text: a tokenizer that normalises loses the places.

Defined cases: a null or empty text has no tokens; a null key keeps its row; rows
of one key are rows of their own and count each time; a very long text is encoded
whole; pairs of one count are all the best of their id; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Links of documents that are counted or looked up at once.
LINKS_AT_ONCE = 1 << 21
#: A task's partial counts leave it once it holds so many different pairs.
MOST_PAIRS = 1 << 22


# --------------------------------------------------------------------------
# the two tokenizers: ids of a text, and the bytes of each id


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_level(definition: str) -> tuple[list[bytes], dict[bytes, int]]:
    """(bytes of each id, ranks) of a byte-level tokenizer given as JSON; its merges must be in the order of ids."""
    model = json.loads(definition)["model"]
    of = _byte_alphabet()
    vocabulary = {bytes(of[c] for c in w): i for w, i in model["vocab"].items() if all(c in of for c in w)}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError("merges are not in the order of their ids")
    table = [b""] * (max(model["vocab"].values()) + 1)
    for w, i in vocabulary.items():
        table[i] = w
    keep = set(made)
    return table, {w: i for w, i in vocabulary.items() if len(w) == 1 or i in keep}


def encoder_a(ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    """Ids of a text, its special strings as plain text."""
    import regex
    import tiktoken

    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    one = tiktoken.Encoding("one", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    find, blank = regex.compile(pattern).findall, regex.compile(r"\s{5000}")

    def encode(text: str) -> list[int]:
        if blank.search(text):  # the library's own splitter gives up on very long runs of blanks
            return [i for w in find(text) for i in one(w)]
        return whole(text)

    return encode


def encoder_b(model: bytes):
    """(ids of a text, bytes of each id) of a sentence-piece model."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    table = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
    return (lambda text: p.encode(text, num_threads=1)), table


# --------------------------------------------------------------------------
# one text


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, a, b): byte ends that both have, and the places of tokens that end together, for every such pair."""
    cuts = np.intersect1d(ends_a, ends_b)
    la, ra = np.searchsorted(ends_a, cuts, "left"), np.searchsorted(ends_a, cuts, "right")
    lb, rb = np.searchsorted(ends_b, cuts, "left"), np.searchsorted(ends_b, cuts, "right")
    na, nb = ra - la, rb - lb
    if (na == 1).all() and (nb == 1).all():
        return cuts, la, lb
    each = na * nb  # tokens without bytes end where the one before does
    at = np.repeat(np.arange(len(cuts)), each)
    k = C.ragged(np.zeros(len(cuts), np.int64), each)
    return cuts, la[at] + k // nb[at], lb[at] + k % nb[at]


class GroupText:
    """``a1,a2|b1;a3|b2`` of two rows of ids and the ends that both have."""

    def __init__(self, size_a: int, size_b: int):
        written = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.a, self.a_last = written(size_a, ","), written(size_a, "|")
        self.b, self.b_last = written(size_b, ","), written(size_b, ";")

    def __call__(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> str:
        last_a, last_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
        na, nb = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        out = np.empty(len(a) + len(b), object)
        at_a = np.arange(len(a)) + np.repeat(last_b - nb, na)
        at_b = np.arange(len(b)) + np.repeat(last_a, nb)
        out[at_a], out[at_b] = self.a[a], self.b[b]
        out[at_a[last_a - 1]], out[at_b[last_b - 1]] = self.a_last[a[last_a - 1]], self.b_last[b[last_b - 1]]
        return "".join(out.tolist())[:-1]


_ALIGNED = [("key", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair_a", pa.binary()), ("pair_b", pa.binary()), ("pair_n", pa.binary())]


def aligned(df: DataFrame, definition: str, pattern: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, pair_a, pair_b, pair_n) of every row.

    The last three are a text's different links, ordered by packed key, as little-endian
    32-bit ids and counts.
    """
    bytes_a, ranks = byte_level(definition)
    shared = df.sparkSession.sparkContext.broadcast((bytes_a, ranks, model))  # bounded by the vocabularies

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_a, ranks, model = shared.value
        one = encoder_a(ranks, pattern)
        two, table_b = encoder_b(model)
        size_a, size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (table_a, table_b))
        written = GroupText(len(table_a), len(table_b))

        def read(x: str | None) -> tuple:
            if not x:
                return (0, 0, 0, 0, "", b"", b"", b"")
            want, a, b = (" " + x).encode(), one(" " + x), two(x)
            if b"".join(map(table_b.__getitem__, b)) != want or b"".join(map(table_a.__getitem__, a)) != want:
                return (0, 0, 0, 0, "", b"", b"", b"")
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
            cuts, i, j = align(ends_a, ends_b)
            digest = hashlib.sha256(written(a, b, ends_a, ends_b, cuts).encode()).hexdigest()
            pairs, n = np.unique(b[j] << 32 | a[i], return_counts=True)
            return (len(a), len(b), len(cuts), len(i), digest, (pairs & 0xFFFFFFFF).astype("<u4").tobytes(), (pairs >> 32).astype("<u4").tobytes(), n.astype("<u4").tobytes())

        for batch in batches:
            keys, texts, rows, size, at = batch.column(0), batch.column(1), [], 0, 0
            for i, x in enumerate(texts):
                rows.append(read(x.as_py()))
                size += rows[-1][3]
                if size >= LINKS_AT_ONCE or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([keys.slice(at, len(rows)), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), _ALIGNED[1:]))], [n for n, _ in _ALIGNED])
                    rows, size, at = [], 0, i + 1

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("x"))
    return src.mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in _ALIGNED))


# --------------------------------------------------------------------------
# corpus-wide counts


def _pairs(batch: pa.RecordBatch, first: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row after, links a row, packed keys, counts) of runs of rows with about ``LINKS_AT_ONCE`` links; the columns from ``first`` on are pair_a, pair_b, pair_n."""
    each = C.byte_lengths(batch.column(first)) // 4
    ends = np.cumsum(each)
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + LINKS_AT_ONCE, "right")))
        a, b, n = (np.frombuffer(b"".join(batch.column(first + k).slice(at, to - at).to_pylist()), "<u4").astype(np.int64) for k in range(3))
        yield at, to, each[at:to], b << 32 | a, n
        at = to


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and their counts summed, of several (keys, counts)."""
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n) of ``aligned``'s rows, corpus-wide, in partitions of ascending key ranges, sorted, written to the shared folder."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["pair", "n"])
        for batch in batches:
            for _, _, _, k, n in _pairs(batch, 0):
                fresh.append((k, n))
                waiting += len(k)
                if waiting >= max(LINKS_AT_ONCE, len(held[0])):
                    held, fresh, waiting = summed([held, *fresh]), [], 0
                    if len(held[0]) >= MOST_PAIRS:
                        yield out()
                        held = held[0][:0], held[1][:0]
        held = summed([held, *fresh])
        if len(held[0]):
            yield out()

    def run_lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0  # the run that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            keys, counts = C.np_col(pa.Table.from_batches([batch]), "pair"), C.np_col(pa.Table.from_batches([batch]), "n")
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            own, total = keys[heads], np.add.reduceat(counts, heads)
            if last is not None and own[0] == last:
                total[0] += held
            elif last is not None:
                own, total = np.concatenate([[last], own]), np.concatenate([[held], total])
            last, held = int(own[-1]), int(total[-1])
            yield pa.RecordBatch.from_arrays([pa.array(own[:-1]), pa.array(total[:-1])], ["pair", "n"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([held], pa.int64())], ["pair", "n"])

    parts = C.staged(links.select("pair_a", "pair_b", "pair_n").mapInArrow(partial, "pair long, n long"))  # read twice: once for the ranges
    return C.staged(parts.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(run_lengths, "pair long, n long"))


class Shards:
    """Sorted count files, mapped into memory where a task runs."""

    def __init__(self, counts: DataFrame):
        """``counts``: what ``pair_counts`` wrote; only a row a file reaches the driver."""
        context = counts.sparkSession.sparkContext
        ends = counts.groupBy(F.input_file_name().alias("file")).agg(F.min("pair").alias("first")).orderBy("first").collect()
        for r in ends:
            context.addFile(r.file)
        self.names = [r.file.rpartition("/")[2] for r in ends]
        self.firsts = np.array([r["first"] for r in ends], np.int64)
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] | None = None

    def __getstate__(self):
        return {"names": self.names, "firsts": self.firsts, "_open": None}

    def _shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of a shard; written out plainly beside the file that Spark fetched, once an executor, and mapped."""
        import os
        import uuid

        import pyarrow.parquet as pq
        from pyspark import SparkFiles

        self._open = self._open or {}
        if i not in self._open:
            path = SparkFiles.get(self.names[i])
            columns = []
            for name in ("pair", "n"):
                plain = f"{path}.{name}.npy"
                if not os.path.exists(plain):
                    own = f"{plain}.{uuid.uuid4().hex}"
                    with open(own, "wb") as f:
                        np.save(f, C.np_col(pq.read_table(path, columns=[name]), name))
                    os.replace(own, plain)  # whole, whoever is first
                columns.append(np.load(plain, mmap_mode="r"))
            self._open[i] = tuple(columns)
        return self._open[i]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted different keys, all of which occur."""
        out = np.zeros(len(keys), np.int64)
        cut = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for i in range(len(self.firsts)):
            if cut[i] < cut[i + 1]:
                pairs, n = self._shard(i)
                out[cut[i] : cut[i + 1]] = n[np.searchsorted(pairs, keys[cut[i] : cut[i + 1]])]
        return out


def alignment(df: DataFrame, definition: str, pattern: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``definition`` and ``pattern`` are the first tokenizer (byte-level, as JSON), ``model``
    the second (a sentence-piece model); the texts of both are parameters, not files.
    """
    links = C.staged(aligned(df, definition, pattern, model, key, text))
    counts = pair_counts(links)
    shards = Shards(counts)
    top = counts.groupBy(F.shiftright("pair", 32).cast("int").alias("b")).agg(F.max("n").alias("n")).collect()  # a row an id of the second vocabulary at most
    best = np.zeros(max((r.b for r in top), default=-1) + 1, np.int64)
    for r in top:
        best[r.b] = r.n

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_best, count_sum = [], []
            for _, _, each, keys, n in _pairs(batch, 6):
                own, back = np.unique(keys, return_inverse=True)
                found = shards(own)
                is_best = (found == best[own >> 32])[back]
                ends = np.cumsum(each)
                for values, per in ((n_best, n * is_best), (count_sum, n * found[back])):
                    total = np.concatenate([[0], np.cumsum(per)])
                    values.append(total[ends] - total[ends - each])
            more = [pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in (n_best, count_sum)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more, batch.column(5)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return links.mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def read_definition(path: str) -> str:
    """A tokenizer's JSON text."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
