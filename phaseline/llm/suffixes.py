"""Exact removal of long repeats by range-partitioned suffixes, confirmed byte by byte.

A byte goes if some ``length``-byte string that covers it also starts anywhere
else in the corpus.  Beside that, passages of ``words`` words that another
document also has are counted, however their words are spaced.  Matches never
cross documents.

* Exact copies first: texts are grouped by digest with a combine on the map
  side, so a group of copies costs one text a task and is processed once.
* Only suffixes that can start a repeat are sorted.  Winnowing picks anchors so
  that every string holds one with its whole gram, at a place that depends on
  the string alone; a string can repeat only if its anchor does.  Anchors go to
  owners by hash, once a block, and one bit each comes back.
* A string's place around its anchor tells which strings it may equal, so text
  is sent for each anchor that occurs again: the anchor's suffix with the bytes
  before it that its strings reach, each distinct text once a block.  Suffixes
  are range-partitioned by their leading four bytes, and where these tie by the
  anchor's fingerprint, with sampled splitters.  A splitter lies between two
  values of the whole key, so strings that agree never stand on two sides of a
  boundary, and each bucket compares its ends with the splitters beside it.
* A bucket sorts all strings of its texts by multikey quicksort: by their leading
  bytes, ties by a fingerprint that sees every byte, ties of unequal strings by
  their bytes.  Neighbours are compared byte by byte, so no false match is
  possible.  One bit for each string goes back to its block.
* An anchor with more than ``HOT`` occurrences stands in texts that differ around
  it, whose copies would meet in one bucket.  Its strings are told apart first:
  blocks send their distinct fingerprints to owners by hash, and only strings
  whose fingerprint occurs again are sent as text, which are the same few in
  every block.
* Blocks turn the bits into covered bytes and words.

No step holds more than a block of texts or a bucket of suffixes, and a string
that occurs everywhere costs one row a block.

Defined cases: null and empty texts lose nothing (``kept_sha256`` is the digest
of no bytes); null and repeated keys keep their rows, each judged by its text;
a very long text is a block of its own and is cut at no place; of equal texts
each loses all its bytes if it has ``length`` of them; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Text of a block, of a working chunk, and sizes of buckets in bytes.
BLOCK_BYTES, CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 1 << 18, 8 << 20
#: Text of a bucket that is sorted at a time, cut between anchors.
RUN_BYTES = 1 << 19
#: Occurrences from which an anchor's strings are told apart by fingerprint before their text is sent.
HOT = 4096
#: Suffixes sampled for each splitter, and at least; splitters that the driver picks at most.
SAMPLED_EACH, SAMPLED, SPLITTERS = 8, 65_536, 1 << 20
_M = 0x9E3779B97F4A7C15
_M_INVERSE = pow(_M, -1, 1 << 64)
#: Keeps keys of strings of words apart from those of strings of bytes.
_WORDS = np.uint64(0xA0761D6478BD642F)
BYTES, WORDS = 0, 1


class Rolling:
    """Fingerprints of all windows of one byte string; each sees every byte."""

    powers = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    table = C.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M))

    def __init__(self, t: np.ndarray):
        n = len(t) + 1
        if len(Rolling.powers[0]) < n:
            m = np.full(n, _M, np.uint64), np.full(n, _M_INVERSE, np.uint64)
            m[0][0] = m[1][0] = 1
            Rolling.powers = tuple(map(np.cumprod, m))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(Rolling.table[t] * Rolling.powers[0][: n - 1], out=self.sums[1:])

    def at(self, p: np.ndarray | slice, size) -> np.ndarray:
        """Fingerprints of the windows of ``size`` bytes (one number or one a window) starting at ``p``."""
        if isinstance(p, slice):
            n = len(self.sums) - size
            return C.mix64((self.sums[size:] - self.sums[:n]) * Rolling.powers[1][:n])
        return C.mix64((self.sums[p + size] - self.sums[p]) * Rolling.powers[1][p])


def valid_starts(ends: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether a window of ``size`` units from each unit stays in its document."""
    ok = np.zeros(n, bool)
    begin = 0
    for e in ends.tolist():
        if e - size >= begin:
            ok[begin : e - size + 1] = True
        begin = e
    return ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[p : p + w] for every p; past the end counts as the largest."""
    n = len(x)
    padded = np.full(-(-(n + w) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : n + w - 1])


def word_bounds(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of a string whose words stand one blank apart."""
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(t == 32)
    return np.concatenate([[0], gaps + 1]), np.append(gaps, len(t))


def leading_bytes(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Four bytes from each position as one number that sorts as they do."""
    lead = np.zeros(len(p), np.uint32)
    for d in range(4):
        lead = (lead << np.uint32(8)) | t[np.minimum(p + d, len(t) - 1)]
    return lead


class Chunk:
    """Anchors and strings of some concatenated documents: ``size`` bytes from every byte, or ``size`` words from every word."""

    def __init__(self, texts: list[bytes], kind: int, size: int):
        self.kind, self.size, gram = kind, size, size // 2
        if kind == WORDS:
            texts = [b" ".join(x.split()) for x in texts]
            self.joined = b" ".join(x for x in texts if x)
            t = np.frombuffer(self.joined, np.uint8)
            self.first, self.last = word_bounds(t)
            self.ends = np.cumsum([x.count(b" ") + 1 if x else 0 for x in texts])
            n = len(self.first)
        else:
            self.joined = b"".join(texts)
            t = np.frombuffer(self.joined, np.uint8)
            self.ends = np.cumsum([len(x) for x in texts])
            n = len(t)
        self.roll = Rolling(t)
        self.starts = np.flatnonzero(valid_starts(self.ends, n, size)).astype(np.int32)
        anchors, self.anchor_of = self._anchors(n, gram)
        self.keys = self.prints(anchors, gram)
        self.roll = None  # eight times the text; made again where hot strings need it
        #: Places of the anchors in the order of suffixes, as far as they decide the bucket.
        self.places = (self._leads(anchors).astype(np.uint64) << np.uint64(32)) | (self.keys >> np.uint64(32))

    def prints(self, units: np.ndarray | slice, size: int) -> np.ndarray:
        """Fingerprints of the strings of ``size`` units from ``units``."""
        if self.kind == BYTES:
            return self.roll.at(units, size)
        p = self.first[units]
        return C.mix64(self.roll.at(p, self.last[units + size - 1] - p) ^ _WORDS)

    def span(self, unit, last) -> tuple:
        """Bytes from the first of ``unit`` to the end of the string that starts at ``last``."""
        if self.kind == BYTES:
            return unit, last + self.size
        return self.first[unit], self.last[last + self.size - 1]

    def _anchors(self, n: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Units of the anchors, and the anchor of the string at each of ``starts``."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = (np.uint64(1) << np.uint64(n.bit_length())) - np.uint64(1)
        h = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        grams = self.prints(slice(None) if self.kind == BYTES else np.arange(n - gram + 1), gram)
        h[: len(grams)] = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = (sliding_min(h, self.size - gram + 1)[self.starts] & low).astype(np.int64)
        hit = np.zeros(n, bool)
        hit[least] = True
        return np.flatnonzero(hit), (np.cumsum(hit) - 1)[least].astype(np.int32)

    def _leads(self, units: np.ndarray) -> np.ndarray:
        """The leading four bytes of the text from each unit."""
        return leading_bytes(np.frombuffer(self.joined, np.uint8), units.astype(np.int64) if self.kind == BYTES else self.first[units])

    def strings(self, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of the whole strings at ``starts``."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        self.roll = Rolling(np.frombuffer(self.joined, np.uint8))
        out, self.roll = self.prints(starts.astype(np.int64), self.size), None
        return out


def chunks(texts: list[bytes], length: int, words: int) -> Iterator[tuple[int, Chunk]]:
    """(number of the first text, chunk) in both kinds."""
    begin, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield begin, Chunk(texts[begin : i + 1], BYTES, length)
            yield begin, Chunk(texts[begin : i + 1], WORDS, words)
            begin, size = i + 1, 0


def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """Order of the columns of ``tokens`` (depth, n), leading token first.

    Quicksort on two tokens at a time, read as one 64-bit key; only columns that
    tie there, and differ further on, are sorted again within their ties.
    """
    depth, n = tokens.shape
    order, run = np.arange(n), np.zeros(n, np.int64)
    for d in range(0, depth, 2):
        key = tokens[d].astype(np.uint64) << np.uint64(32) if d + 1 < depth else tokens[d].astype(np.uint64)
        if d + 1 < depth:
            key |= tokens[d + 1]
        if d == 0:
            order = np.argsort(key)
            k = key[order]
        else:
            k = key[order]
            differs = np.zeros(int(run[-1]) + 1 if n else 1, bool)
            differs[run[1:][(k[1:] != k[:-1]) & (run[1:] == run[:-1])]] = True
            own = np.flatnonzero(differs[run])
            order[own] = order[own][np.lexsort((k[own], run[own]))]
            k = key[order]
        if d + 2 < depth and n:
            new = np.ones(n, bool)
            new[1:] = (k[1:] != k[:-1]) | (run[1:] != run[:-1])
            run = np.cumsum(new) - 1
    return order


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask.astype(bool)).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _runs(of: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    if not len(of):
        return []
    at = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]).tolist()
    return list(zip(at[:-1], at[1:]))


def same_strings(t: bytes, p: np.ndarray, q: np.ndarray, size: np.ndarray, size_q: np.ndarray) -> np.ndarray:
    """Whether the bytes of the string at ``p`` are those of the string at ``q``."""
    same = size == size_q
    if len(p) and same.all() and (size == size[0]).all():
        rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(t, np.uint8), int(size[0]))
        for a in range(0, len(p), 8192):
            same[a : a + 8192] = (rows[p[a : a + 8192]] == rows[q[a : a + 8192]]).all(axis=1)
        return same
    at = np.flatnonzero(same)
    same[at] = [t[a : a + n] == t[b : b + n] for a, b, n in zip(p[at].tolist(), q[at].tolist(), size[at].tolist())]
    return same


def confirmed(t: bytes, p: np.ndarray, size: np.ndarray, who: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which strings stand at two or more of ``who``, or at one that holds them for two; by their bytes."""
    hit = np.zeros(len(p), bool)
    if not len(p):
        return hit
    a = np.frombuffer(t, np.uint8)
    key = Rolling(a).at(p, size)
    tokens = np.stack([leading_bytes(a, p), (key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint32)])
    order = multikey_quicksort(tokens)
    k = tokens[:, order]
    agree = (k[:, 1:] == k[:, :-1]).all(axis=0)
    new = np.ones(len(p), bool)
    tie = np.flatnonzero(agree)
    same = same_strings(t, p[order[tie]], p[order[tie + 1]], size[order[tie]], size[order[tie + 1]])
    new[tie[same] + 1] = False
    if not same.all():  # unequal strings of one fingerprint: the deeper text decides
        heads = np.flatnonzero(np.concatenate([[True], ~agree]))
        for h in np.unique(np.searchsorted(heads, tie[~same], side="right") - 1).tolist():
            a, b = int(heads[h]), int(heads[h + 1]) if h + 1 < len(heads) else len(p)
            text = lambda i: t[p[i] : p[i] + size[i]]
            own = sorted(order[a:b].tolist(), key=text)
            order[a:b] = own
            new[a:b] = [True] + [text(x) != text(y) for x, y in zip(own[:-1], own[1:])]
    first = np.flatnonzero(new)
    w = who[order]
    good = (np.minimum.reduceat(w, first) != np.maximum.reduceat(w, first)) | np.logical_or.reduceat(twice[order], first)
    hit[order] = good[np.cumsum(new) - 1]
    return hit


def mark_repeats(df: DataFrame, text: str = "text", length: int = 400, words: int = 50) -> DataFrame:
    """(digest binary, n_removed, n_spans, kept binary, n_passage_words) of each distinct text that shares something."""
    spark = df.sparkSession
    src = df.select(F.col(text).cast("string").alias("x")).where(F.octet_length("x") >= min(length, 2 * words - 1))
    total = C.text_bytes(src, "x")[1]
    blocks_n = C.pieces(total, BLOCK_BYTES, most=1 << 26)
    owners = C.pieces(total // 2, BUCKET_BYTES, most=1 << 26)
    homes = C.pieces(2 * total, BUCKET_BYTES, most=1 << 26)
    ranges = min(homes, SPLITTERS)
    fine = -(-homes // ranges)  # equal parts of each range between two splitters

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            by: dict[int, list[bytes]] = {}
            for d in held:
                by.setdefault(int.from_bytes(d[:8], "big") % blocks_n, []).append(d)
            blobs = [C.to_blob(3, x=pa.array([held[d][0] for d in own], pa.large_binary()), c=np.array([held[d][1] for d in own], np.int64)) for own in by.values()]
            out = pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array(blobs, pa.binary())], ["block", "payload"])
            held.clear()
            return out

        for b in batches:
            for x in b.column(0).cast(pa.binary()).to_pylist():
                d = hashlib.sha256(x).digest()
                if d in held:
                    held[d][1] += 1
                    continue
                held[d] = [x, 1]
                size += len(x)
                if size >= 4 * BLOCK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    packed = src.mapInArrow(pack, "block long, payload binary").repartition("block")

    def open_block(table: pa.Table) -> tuple[list[bytes], list[bytes], list[int]]:
        """Digests, texts and copies of the distinct texts, in order of digest."""
        found: dict[bytes, list] = {}
        for payload in table.column("payload").to_pylist():
            t = C.from_blob(payload)
            for x, c in zip(t.column("x").to_pylist(), t.column("c").to_pylist()):
                found.setdefault(hashlib.sha256(x).digest(), [x, 0])[1] += c
        digests = sorted(found)
        return digests, [found[d][0] for d in digests], [found[d][1] for d in digests]

    def among(keys: np.ndarray, n: int) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)

    def rows_of(rows: list[tuple], schema: list[tuple]) -> pa.Table:
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(schema)})

    def anchors(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        keys = [c.keys for _, c in chunks(open_block(table)[1], length, words)]
        u, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
        owner = among(u, owners)
        rows = [(int(owner[a]), block, u[a:b].tobytes(), np.minimum(n[a:b], 65535).astype(np.uint16).tobytes()) for a, b in _runs(owner)]
        return rows_of(rows, [("owner", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])

    def repeated(table: pa.Table) -> pa.Table:
        """Of each anchor 0 if it occurs once, 2 if it is hot, else 1."""
        keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        times = np.concatenate([np.frombuffer(m, np.uint16) for m in table.column("times").to_pylist()])
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=times, minlength=len(u))
        level = ((total > 1).astype(np.uint8) + (total > HOT))[inverse]
        ends = np.cumsum([len(k) for k in keys])
        return pa.table({"block": table.column("block"), "kind": pa.array(np.zeros(len(keys), np.int32)), "part": table.column("owner"), "mask": pa.array([_bits(level[e - len(k) : e] > 0) + _bits(level[e - len(k) : e] > 1) for e, k in zip(ends, keys)], pa.binary())})

    def levels(keys: list[np.ndarray], masks: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's distinct anchors, and whether each is repeated and hot."""
        u = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64))
        sizes = np.bincount(among(u, owners).astype(np.int64), minlength=1)
        got = [(masks[o], int(sizes[o])) for o in np.flatnonzero(sizes).tolist()]
        both = [[_unbits(m[: -(-n // 8)], n) for m, n in got], [_unbits(m[-(-n // 8) :], n) for m, n in got]]
        return u, *(np.concatenate([np.zeros(0, bool), *b]) for b in both)

    def hot_strings(parts: list, u: np.ndarray, hot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(indices into the starts, fingerprints, holders) of the strings with hot anchors in each chunk."""
        out, at = [], 0
        for a, c in parts:
            own = np.flatnonzero(hot[np.searchsorted(u, c.keys)][c.anchor_of]) if len(c.starts) else np.zeros(0, np.int64)
            doc = a + np.searchsorted(c.ends, c.starts[own], side="right")
            # strings of bytes may repeat in their own text, those of words only in another
            out.append((own, c.strings(c.starts[own]), np.arange(at, at + len(own)) if c.kind == BYTES else doc))
            at += len(own)
        return out

    def distinct_strings(found: list) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct fingerprints, and whether two or more hold each."""
        key = np.concatenate([np.zeros(0, np.uint64), *(f for _, f, _ in found)])
        who = np.concatenate([np.zeros(0, np.int64), *(w for _, _, w in found)])
        order = np.argsort(key)
        key, who = key[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        return key[first], np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first) if len(first) else np.zeros(0, bool)

    def ask_hot(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        masks = dict(zip(right.column("part").to_pylist(), right.column("mask").to_pylist()))
        if any(m[len(m) // 2 :].strip(b"\0") for m in masks.values()):
            block = left.column("block")[0].as_py()
            parts = list(chunks(open_block(left)[1], length, words))
            u, _, hot = levels([c.keys for _, c in parts], masks)
            key, twice = distinct_strings(hot_strings(parts, u, hot))
            owner = among(key, homes)
            rows = [(int(owner[a]), block, C.to_blob(1, k=np.diff(key[a:b], prepend=np.uint64(0))), _bits(twice[a:b])) for a, b in _runs(owner)]
        return rows_of(rows, [("home", pa.int64()), ("block", pa.int64()), ("blob", pa.binary()), ("twice", pa.binary())])

    def count_hot(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(C.np_col(C.from_blob(x), "k"), dtype=np.uint64) for x in table.column("blob").to_pylist()]
        twice = np.concatenate([_unbits(m, len(k)) for m, k in zip(table.column("twice").to_pylist(), keys)])
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        hit = (np.bincount(inverse, weights=1 + twice, minlength=len(u)) > 1)[inverse]
        ends = np.cumsum([len(k) for k in keys])
        return pa.table({"block": table.column("block"), "kind": pa.array(np.ones(len(keys), np.int32)), "part": table.column("home"), "mask": pa.array([_bits(hit[e - len(k) : e]) for e, k in zip(ends, keys)], pa.binary())})

    def bounds(key: np.ndarray) -> np.ndarray:
        """Bucket of each place in the order of suffixes, ascending."""
        cut = splitters.value
        at = np.searchsorted(cut, key, side="right")
        if fine == 1:
            return at
        low = np.concatenate([[np.uint64(0)], cut])[at]
        high = np.append(cut, np.iinfo(np.uint64).max)[at]
        share = (key - low).astype(np.float64) / np.maximum((high - low).astype(np.float64), 1.0)
        return at * fine + np.minimum((share * fine).astype(np.int64), fine - 1)

    answer = [("route", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())]

    def ask_text(left: pa.Table, right: pa.Table) -> pa.Table:
        """Runs of strings that may repeat: their texts for the buckets, their places for the block itself."""
        block = left.column("block")[0].as_py() if len(left) else -1
        masks: tuple[dict, dict] = ({}, {})
        for kind, part, mask in zip(*(right.column(c).to_pylist() for c in ("kind", "part", "mask"))):
            masks[kind][part] = mask
        _, texts, copies = open_block(left)
        parts = list(chunks(texts, length, words))
        u, again, hot = levels([c.keys for _, c in parts], masks[0])
        cold = again & ~hot
        found, again_hot, hot_keys = [], np.zeros(0, bool), np.zeros(0, np.uint64)
        if hot.any():
            found = hot_strings(parts, u, hot)
            hot_keys, twice = distinct_strings(found)
            owner = among(hot_keys, homes)
            again_hot = twice | np.concatenate([np.zeros(0, bool), *(_unbits(masks[1][int(owner[a])], b - a) for a, b in _runs(owner))])
        known: dict[tuple, list] = {}  # (kind, text) -> [bucket, strings, document, whether two hold it, its number, its anchor's place]
        places = []
        for number, (at, c) in enumerate(parts):
            if not len(c.starts):
                continue
            take = cold[np.searchsorted(u, c.keys)][c.anchor_of]
            if found:
                own, key, _ = found[number]
                take[own] = again_hot[np.searchsorted(hot_keys, key)]
            own = np.flatnonzero(take)
            if not len(own):
                continue
            s, a = c.starts[own].astype(np.int64), c.anchor_of[own]
            cut = np.concatenate([[0], np.flatnonzero((s[1:] != s[:-1] + 1) | (a[1:] != a[:-1])) + 1])
            n = np.diff(np.append(cut, len(s)))
            begin, end = c.span(s[cut], s[cut] + n - 1)
            bucket = bounds(c.places[a[cut]])
            doc = np.searchsorted(c.ends, s[cut], side="right")
            first = s[cut] - np.concatenate([[0], c.ends])[doc]
            for p, q, m, o, x, k, g in zip(begin.tolist(), end.tolist(), n.tolist(), bucket.tolist(), (at + doc).tolist(), first.tolist(), c.places[a[cut]].tolist()):
                t = c.joined[p:q]
                e = known.get((c.kind, t))
                if e is None:
                    e = known[c.kind, t] = [o, m, x, copies[x] > 1, len(known), g]
                elif c.kind == BYTES or e[2] != x:
                    e[3] = True
                places.append((c.kind, x, k, m, e[4]))
        order = sorted(known.items(), key=lambda e: (e[0][0], e[1][0], e[1][4]))
        rank = np.empty(len(order), np.int64)
        rank[[e[4] for _, e in order]] = np.arange(len(order))
        rows = []
        key = np.array([(kind, e[0]) for (kind, _), e in order], np.int64).reshape(-1, 2)
        for a, b in _runs(key[:, 0] * np.int64(2 * homes + 2) + key[:, 1]):
            own = order[a:b]
            blob = C.to_blob(1, x=pa.array([t for (_, t), _ in own], pa.large_binary()), d=np.array([e[2] for _, e in own], np.int32), m=np.array([e[3] for _, e in own], bool), g=np.array([e[5] for _, e in own], np.uint64))
            rows.append((int(key[a, 1]), block, int(key[a, 0]), blob))
        if places:
            kind, x, k, m, number = (np.array(v, np.int64) for v in zip(*places))
            own = C.to_blob(1, kind=kind.astype(np.int8), doc=x.astype(np.int32), first=k, n=m, run=rank[number])
            listed = C.to_blob(1, kind=key[:, 0].astype(np.int8), owner=key[:, 1], n=np.array([e[1] for _, e in order], np.int64))
            rows += [(-1 - block, block, 2, own), (-1 - block, block, 3, listed)]
        return rows_of(rows, answer)

    def confirm(table: pa.Table) -> pa.Table:
        """Bits of the strings of all texts of a bucket; a block's own rows pass as they are."""
        if table.column("route")[0].as_py() < 0:
            return pa.table({"block": table.column("block"), "kind": table.column("kind"), "part": pa.array(np.zeros(len(table), np.int64)), "mask": table.column("blob")})
        rows, owner = [], table.column("route")[0].as_py()
        kinds, blocks = table.column("kind").to_numpy(), table.column("block").to_pylist()
        for kind in (BYTES, WORDS):
            at = np.flatnonzero(kinds == kind).tolist()
            if not at:
                continue
            parts = [C.from_blob(table.column("blob")[i].as_py()) for i in at]
            place = np.concatenate([C.np_col(p, "g") for p in parts])
            # the least and the greatest suffix against the splitters beside them: nothing that agrees stands across a boundary
            if (bounds(np.array([place.min(), place.max()], np.uint64)) != owner).any():
                raise ValueError("a suffix stands outside its bucket")
            texts = [x for p in parts for x in p.column("x").to_pylist()]
            row = np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])
            holder = (row.astype(np.int64) << 32) | np.concatenate([C.np_col(p, "d") for p in parts])
            twice = np.concatenate([C.np_col(p, "m") for p in parts]).astype(bool)
            sizes = np.array([len(x) for x in texts])
            n = sizes - length + 1 if kind == BYTES else np.array([x.count(b" ") + 2 for x in texts]) - words
            at_hit = np.cumsum(n) - n
            hit = np.zeros(int(n.sum()), bool)
            # strings of different anchors never agree, so the bucket is sorted run by run of anchors
            order = np.argsort(place, kind="stable")
            upto, new = np.cumsum(sizes[order]) // RUN_BYTES, place[order][1:] != place[order][:-1]
            some = np.concatenate([[0], np.flatnonzero(new) + 1])
            some = some[np.concatenate([[True], upto[some[1:]] != upto[some[:-1]]])]
            for a, b in zip(some.tolist(), [*some[1:].tolist(), len(order)]):
                own = order[a:b]
                joined = b" ".join(texts[i] for i in own.tolist())
                begin = np.cumsum(sizes[own] + 1) - sizes[own] - 1
                if kind == BYTES:
                    p = C.ragged(begin, n[own])
                    size, who = np.full(len(p), length), np.arange(len(p))
                else:
                    first, last = word_bounds(np.frombuffer(joined, np.uint8))
                    unit = C.ragged(np.searchsorted(first, begin), n[own])
                    p, size = first[unit], last[unit + words - 1] - first[unit]
                    who = np.repeat(holder[own], n[own])
                hit[C.ragged(at_hit[own], n[own])] = confirmed(joined, p, size, who, np.repeat(twice[own], n[own]))
            ends = np.cumsum(np.bincount(row, weights=n, minlength=len(parts)).astype(np.int64))
            rows += [(blocks[i], 4 + kind, owner, _bits(hit[a:b])) for i, a, b in zip(at, [0, *ends[:-1].tolist()], ends.tolist())]
        return rows_of(rows, [("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("mask", pa.binary())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        digests, texts, copies = open_block(left)
        masks: dict[tuple, bytes] = dict(zip(zip(right.column("kind").to_pylist(), right.column("part").to_pylist()), right.column("mask").to_pylist()))
        ends = np.cumsum([len(x) for x in texts])
        edge = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
        passage = np.zeros(len(texts), np.int64)
        if (2, 0) in masks:
            runs, listed = C.from_blob(masks[2, 0]), C.from_blob(masks[3, 0])
            kind, owner, n = (C.np_col(listed, c).astype(np.int64) for c in ("kind", "owner", "n"))
            bits = [np.zeros(0, bool)]
            for a, b in _runs(kind * np.int64(2 * homes + 2) + owner):
                bits.append(_unbits(masks[4 + int(kind[a]), int(owner[a])], int(n[a:b].sum())))
            bits, begin = np.concatenate(bits), np.cumsum(n) - n
            kind, doc, first, m, run = (C.np_col(runs, c).astype(np.int64) for c in ("kind", "doc", "first", "n", "run"))
            good = bits[C.ragged(begin[run], m)]
            kind, doc, at = np.repeat(kind, m)[good], np.repeat(doc, m)[good], C.ragged(first, m)[good]
            own = np.concatenate([[0], ends])[doc[kind == BYTES]] + at[kind == BYTES]
            edge[own] += 1  # each start comes once
            edge[own + length] -= 1
            doc, at = doc[kind == WORDS], at[kind == WORDS]
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            new = np.full(len(at), words)
            new[:-1] = np.where(doc[1:] == doc[:-1], np.minimum(at[1:] - at[:-1], words), words)
            passage = np.bincount(doc, weights=new, minlength=len(texts)).astype(np.int64)
        gone = np.cumsum(edge)[:-1] > 0
        rows, begin = [], 0
        for i, e in enumerate(ends.tolist()):
            g = gone[begin:e]
            begin = e
            if copies[i] > 1:
                n = len(texts[i].split())
                passage[i] = n if n >= words else 0
                g = np.full(len(texts[i]), len(texts[i]) >= length)
            if passage[i] or g.any():
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                rows.append((digests[i], int(g.sum()), spans, np.frombuffer(texts[i], np.uint8)[~g].tobytes(), int(passage[i])))
        return rows_of(rows, [("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("n_passage_words", pa.int64())])

    def leading(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, c in chunks(b.column(0).cast(pa.binary()).to_pylist(), length, words):
                yield pa.RecordBatch.from_arrays([pa.array(c.places.view(np.int64))], ["t"])

    every = max(1, total // (max(SAMPLED, SAMPLED_EACH * ranges) * 50))  # an anchor a 50 bytes; so the sample grows with the splitters, and no further
    sample = np.sort(src.where(F.pmod(F.xxhash64("x"), F.lit(every)) == 0).mapInArrow(leading, "t long").toPandas().t.to_numpy().astype(np.int64).view(np.uint64))
    picked = sample[np.linspace(0, len(sample) - 1, ranges + 1).astype(int)[1:-1]] if len(sample) else sample
    splitters = spark.sparkContext.broadcast(np.unique(picked))  # one value a range

    asked = packed.groupBy("block").applyInArrow(anchors, "owner long, block long, keys binary, times binary")
    back = "block long, kind int, part long, mask binary"
    one = asked.groupBy("owner").applyInArrow(repeated, back)
    asked_hot = packed.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(ask_hot, "home long, block long, blob binary, twice binary")
    two = asked_hot.groupBy("home").applyInArrow(count_hot, back)
    runs = packed.groupBy("block").cogroup(one.unionByName(two).groupBy("block")).applyInArrow(ask_text, "route long, block long, kind int, blob binary")
    sure = runs.groupBy("route").applyInArrow(confirm, back)
    return packed.groupBy("block").cogroup(sure.groupBy("block")).applyInArrow(cut, "digest binary, n_removed long, n_spans long, kept binary, n_passage_words long")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, words: int = 50) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words) for every row of ``df``.

    ``n_passage_words`` counts the words of passages of at least ``words`` words that another row's text also has.
    """
    marked = mark_repeats(df, text, length, words).select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), F.octet_length(x).cast("long").alias("n_bytes"), F.sha2(x, 256).alias("own"))
    rows = rows.withColumn("digest", F.unhex("own")).join(marked, "digest", "left")
    counted = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.select("doc_id", "n_bytes", counted("n_removed"), counted("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"), counted("n_passage_words"))
