"""Language-model scores by a weighted backoff automaton of order three.

The model is interpolated: ``P(w | u v) = q c(u v w) / c(u v) + (1 - q) P(w | v)``
where the pair u v is a state, ``P(w | v) = q c(v w) / c(v) + (1 - q) P(w)`` where
v was seen in training, and ``P(w)`` is an add-0.1 unigram.  As an automaton: the
root has an arc for every word; every word seen has a state with an arc for each
seen pair; every pair seen at least ``LEAST_STATE`` times is a state with an arc
for each seen triple.  An arc leads to the longest state that ends with its word.
A failure arc leads from a pair to its second word and from a word to the root,
and costs ``log10(1 - q)``.  A text is one left-to-right traversal from the start
state: where a state has no arc for the next word, failure arcs are followed down
until one has, and the weights of all arcs taken add up.

Counts are exact and never gathered in one place.  Each block of documents sends
its distinct words, counted over its training documents, to owners by hash; the
owners return each word's total, whether other blocks have it too, and a number,
small for frequent words.  Pairs of numbers take the same way, then triples, by a
64-bit fingerprint of their numbers.  What no other block can have needs no owner:
a pair with a word, or a triple with a pair, that occurs in one block alone.  So
each block builds the part of the automaton that its documents visit, in bounded
memory, and a frequent word, pair or triple costs one entry a block.

Defined cases: a null or empty text is one end token; a null key reads as no text,
whose checksum is 0, so it is held out; repeated rows count each time; equally
frequent words are numbered by their fingerprints, which changes no score; a very
long text is a block of its own; with no training documents every token is
unknown; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
ADD, WEIGHT = 0.1, 0.3
#: Occurrences in training from which a pair of words is a state.
LEAST_STATE = 4
#: Tokens of a block that are walked as plain Python numbers at a time; the state goes on from slice to slice.
STEPS = 1 << 16
#: Fingerprints of the end of a text and of the start state.
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)


def held_out(key: int | None) -> bool:
    """Whether a document is kept from training: crc32 of its key as text, modulo 10, is 0."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays of non-negative numbers, byte by byte of their places, which compresses small numbers well."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x).astype(np.uint64)
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        data = pa.Codec("zstd", level).compress(planes, asbytes=True) if planes else b""
        out += [struct.pack("<QBQ", len(x), width, len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, as unsigned 64-bit numbers."""
    out, at = [], 0
    while at < len(data):
        n, width, size = struct.unpack_from("<QBQ", data, at)
        at += 17
        x = np.zeros((n, 8), np.uint8)
        if n:
            planes = pa.Codec("zstd").decompress(data[at : at + size], n * width, asbytes=True)
            x[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
        out.append(x.reshape(-1).view(np.uint64))
        at += size
    return out


def cuts(owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, from, to) of each run of equal owners."""
    if not len(owner):
        return []
    c = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]).tolist()
    return [(int(owner[i]), i, j) for i, j in zip(c[:-1], c[1:])]


def numbered_pairs(h: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray]:
    """(distinct pairs, the number of each pair) of any two columns of 64-bit numbers."""
    order = np.lexsort((w, h))
    a, b = h[order], w[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return int(new.sum()), place


def tokenised(keys: list, texts: list[bytes]) -> dict[str, bytes]:
    """A block: its documents, its distinct words with their counts in training, and its tokens as numbers into them."""
    hashes, parts, n = C.WordHashes(), [], []
    end = np.array([END])
    for x in texts:
        words = x.lower().split()  # bytes: only A-Z change, only the six blanks split
        parts += [hashes(words), end]
        n.append(len(words) + 1)
    held = np.array([held_out(k) for k in keys], bool)
    words, token = np.unique(np.concatenate([*parts, np.array([END, START])]).astype(np.uint64), return_inverse=True)
    token = token[:-2]
    times = np.bincount(token[np.repeat(~held, n)], minlength=len(words))
    times[np.searchsorted(words, START)] = int((~held).sum())  # how often training texts start
    place = np.empty(len(words), np.int64)
    place[by_count(times)] = np.arange(len(words))
    token, ends = place[token], np.searchsorted(words, [START, END])
    return {
        "words": words.tobytes(),
        "docs": C.to_blob(k=pa.array(keys, pa.int64()), n=np.array(n, np.int64)),
        "times": pack(times, ends),
        "tokens": pack(token, level=5),
    }


def by_count(times: np.ndarray) -> np.ndarray:
    """A block's words by their counts; tokens are written as places in it, which are small numbers mostly."""
    return np.argsort(-times, kind="stable")


class Block:
    """A block's tokens, numbers into its sorted list of words, and its pairs and triples of them."""

    def __init__(self, docs: bytes, times: bytes, tokens: bytes):
        d, (times, ends), (token,) = C.from_blob(docs), unpack(times), unpack(tokens)
        self.keys, self.n = d.column("k").to_pylist(), C.np_col(d, "n")
        self.times, self.width = times.astype(np.int64), len(times)
        self.start, self.end = ends.tolist()
        self.token = by_count(self.times)[token.astype(np.int64)]
        self.first = np.cumsum(self.n) - self.n
        self.held = np.array([held_out(k) for k in self.keys], bool)
        self.train = np.repeat(~self.held, self.n)
        self.history = np.concatenate([[0], self.token[:-1]])[: len(self.token)]
        self.history[self.first] = self.start

    def learn_words(self, total: np.ndarray, number: np.ndarray, shared: np.ndarray) -> None:
        if len(total) != self.width:
            raise ValueError("answers do not fit their block")
        self.total, self.number, width = total, number, self.width
        u, self.pair = np.unique(self.history * width + self.token, return_inverse=True)
        self.pair_h, self.pair_w = u // width, u % width
        self.pair_total = np.bincount(self.pair[self.train], minlength=len(u))
        self.pair_shared = shared[self.pair_h] & shared[self.pair_w]  # as far as words tell
        self.pair_asked = np.flatnonzero(self.pair_shared)

    def asked_pairs(self, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, number of the first word, of the second) of the pairs to ask for, which ``pair_asked`` is put in the order of."""
        hn, wn = self.number[self.pair_h[self.pair_asked]], self.number[self.pair_w[self.pair_asked]]
        owner = among(C.mix64(hn * np.uint64(0x9E3779B97F4A7C15) + wn), owners)
        order = np.lexsort((wn, hn, owner))
        self.pair_asked = self.pair_asked[order]
        return owner[order], hn[order], wn[order]

    def learn_pairs(self, total: np.ndarray, shared: np.ndarray) -> None:
        if len(total) != len(self.pair_asked):
            raise ValueError("answers do not fit their block")
        self.pair_total[self.pair_asked] = total
        self.pair_shared[self.pair_asked] = shared
        # a triple is the pair before a token, where that is a state, and the token
        self.is_state = (self.pair_total >= LEAST_STATE) & (self.pair_w != self.end)
        inner = np.ones(len(self.token), bool)
        inner[self.first] = False
        self.place = np.flatnonzero(inner)
        before = self.pair[self.place - 1]
        self.place = self.place[self.is_state[before]]
        before = self.pair[self.place - 1]
        width = self.width
        u, self.triple = np.unique(before * width + self.token[self.place], return_inverse=True)
        self.triple_state, self.triple_w = u // width, u % width
        self.triple_pair = np.zeros(len(u), np.int64)  # its last two words
        self.triple_pair[self.triple] = self.pair[self.place]
        self.triple_total = np.bincount(self.triple[self.train[self.place]], minlength=len(u))
        asked = np.flatnonzero(self.pair_shared[self.triple_state] & self.pair_shared[self.triple_pair])
        n = [self.number[x[asked]] for x in (self.pair_h[self.triple_state], self.pair_w[self.triple_state], self.triple_w)]
        key = C.mix64(n[0] * np.uint64(0x9E3779B97F4A7C15) + C.mix64(n[1] * np.uint64(0xC2B2AE3D27D4EB4F) + C.mix64(n[2])))
        order = np.argsort(key, kind="stable")
        self.triple_asked, self.triple_key = asked[order], key[order]

    def learn_triples(self, total: np.ndarray) -> None:
        if len(total) != len(self.triple_asked):
            raise ValueError("answers do not fit their block")
        self.triple_total[self.triple_asked] = total


class Automaton:
    """The states and arcs that one block visits.

    States are numbered: 0 the root, then one a word, then one a pair.  ``fail``
    and ``fail_weight`` are the failure arc of each; arcs are kept by what they
    read: the root's by word, a word's by pair, a pair's by triple.
    """

    def __init__(self, b: Block, n_train: int, distinct: int, weight: float):
        self.block, self.weight, width, pairs = b, weight, b.width, len(b.pair_h)
        seen_word, seen_pair = b.total > 0, b.pair_total > 0
        self.of_word, self.of_pair = 1 + np.arange(width), 1 + width + np.arange(pairs)
        self.fail = np.concatenate([[0], np.zeros(width, np.int64), self.of_word[b.pair_w]])
        self.fail_weight = np.concatenate([[0.0], np.full(width + pairs, np.log10(1 - weight))])
        # the longest state that ends with a word, and with a pair
        self.after_word = np.where(seen_word & (np.arange(width) != b.end), self.of_word, 0)
        self.after_pair = np.where(b.is_state, self.of_pair, self.after_word[b.pair_w])
        # weights of arcs; minus infinity where there is none
        with np.errstate(divide="ignore", invalid="ignore"):
            one = (b.total + ADD) / (n_train + ADD * (distinct + 1))
            two = weight * b.pair_total / b.total[b.pair_h] + (1 - weight) * one[b.pair_w]
            three = weight * b.triple_total / b.pair_total[b.triple_state] + (1 - weight) * two[b.triple_pair]
            self.arc_word = np.log10(one)
            self.arc_pair = np.where(seen_pair & seen_word[b.pair_h], np.log10(two), -np.inf)
            self.arc_triple = np.where(b.triple_total > 0, np.log10(three), -np.inf)

    def arcs(self) -> Iterator[tuple[int, int, float, int]]:
        """(state, word, weight, next state) of every arc that is there."""
        b = self.block
        for w, x in enumerate(self.arc_word.tolist()):
            yield 0, w, x, int(self.after_word[w])
        for p in np.flatnonzero(self.arc_pair > -np.inf).tolist():
            yield int(self.of_word[b.pair_h[p]]), int(b.pair_w[p]), float(self.arc_pair[p]), int(self.after_pair[p])
        for t in np.flatnonzero(self.arc_triple > -np.inf).tolist():
            yield int(self.of_pair[b.triple_state[t]]), int(b.triple_w[t]), float(self.arc_triple[t]), int(self.after_pair[b.triple_pair[t]])

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """(root weight, weight of the arcs taken) of every token, from left to right.

        The state is carried from token to token: the arc taken names the next one.
        Where a state's arc for a token lies among all arcs was numbered with the
        block (``pair``, ``triple``), so a step compares no words.
        """
        b, words = self.block, self.block.width
        triple = np.full(len(b.token), -1)
        triple[b.place] = b.triple
        missing, fail_weight = -np.inf, float(np.log10(1 - self.weight))
        first = self.of_word[b.start] if b.total[b.start] else 0
        starts, root = np.zeros(len(b.token), bool), self.arc_word[b.token]
        starts[b.first] = True
        taken, state = np.empty(len(b.token)), 0
        for at in range(0, len(b.token), STEPS):
            here = slice(at, at + STEPS)
            t, p, w = triple[here], b.pair[here], b.token[here]
            three = np.where(t >= 0, self.arc_triple[t], missing) if len(self.arc_triple) else np.full(len(t), missing)
            before = b.pair[np.maximum(np.arange(at, at + len(t)) - 1, 0)]
            columns = (starts[here], three, self.arc_pair[p], root[here], self.after_pair[p], self.after_word[w], self.fail[self.of_pair[before]])
            out = []
            for new, x3, x2, x1, to_pair, to_word, failed in zip(*(c.tolist() for c in columns)):
                if new:
                    state = first
                weight = 0.0
                if state > words:  # a pair, whose failure arc leads to its second word
                    if x3 > missing:
                        out.append(x3)
                        state = to_pair
                        continue
                    weight, state = fail_weight, failed
                if state:  # a word, whose failure arc leads to the root
                    if x2 > missing:
                        out.append(weight + x2)
                        state = to_pair
                        continue
                    weight += fail_weight
                out.append(weight + x1)
                state = to_word
            taken[here] = out
        return root, taken


def among(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges of 64-bit numbers each key lies in."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def score(df: DataFrame, key: str = "doc_id", text: str = "text", weight: float = WEIGHT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, gain) for every row of ``df``.

    ``gain`` is how far the model's log10 probability of a token lies over the root's, on average over the text.
    """
    total = C.text_bytes(df, text)[1]
    owners = C.pieces(2 * total, BUCKET_BYTES)
    src = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))

    def tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            nonlocal seq
            row = {"block": seq} | tokenised(keys, texts)
            seq += 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("words", "docs", "times", "tokens"))]))

        for b in batches:
            for i in range(0, len(b), 256):
                for k, x in zip(b.column(0).slice(i, 256).to_pylist(), b.column(1).slice(i, 256).cast(pa.binary()).to_pylist()):
                    keys.append(k), texts.append(x)
                    size += len(x)
                    if size >= BLOCK_BYTES:
                        yield flush()
                        keys, texts, size = [], [], 0
        if keys:
            yield flush()

    blocks = C.staged(src.mapInArrow(tokenise, "block long, words binary, docs binary, times binary, tokens binary"), "none")

    def rows_of(rows: list[tuple]) -> list[pa.Array]:
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return [pa.array([r[i] for r in rows], kinds[i]) for i in range(3)]

    def ask_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, w, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words, times = np.frombuffer(w.as_py(), np.uint64), unpack(c.as_py())[0]
                rows = [(o, block, pack(np.diff(words[i:j], prepend=np.uint64(0)), times[i:j])) for o, i, j in cuts(among(words, owners))]
                yield pa.RecordBatch.from_arrays(rows_of(rows), ["owner", "block", "blob"])

    def count_words(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table.column("blob").to_pylist()]
        keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts])
        times = np.concatenate([c for _, c in parts]).astype(np.int64)
        u, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=times, minlength=len(u)).astype(np.int64)  # exact below 2**53
        rank = np.empty(len(u), np.int64)
        rank[np.lexsort((u, -total))] = np.arange(len(u))
        number = (rank * owners + table.column("owner")[0].as_py()).astype(np.uint64)
        shared = (np.bincount(inverse, minlength=len(u)) > 1).astype(np.uint8)  # an entry a block
        answers, at = [], 0
        for k, _ in parts:
            own = inverse[at : at + len(k)]
            at += len(k)
            answers.append(pack(total[own], number[own], shared[own]))
        real = u != START
        stats = np.zeros((2, len(parts)), np.int64)
        stats[:, 0] = total[real].sum(), (total[real] > 0).sum()
        return pa.table({"block": table.column("block"), "kind": pa.array(np.zeros(len(parts), np.int32)), "part": table.column("owner"), "answer": pa.array(answers, pa.binary()), "n": stats[0], "v": stats[1]})

    def opened(left: pa.Table, right: pa.Table) -> Block:
        """The block with all that the answers so far tell."""
        b = Block(*(left.column(c)[0].as_py() for c in ("docs", "times", "tokens")))
        answers: tuple[list, list, list] = ([], [], [])
        for kind, part, answer in zip(*(right.column(c).to_pylist() for c in ("kind", "part", "answer"))):
            answers[kind].append((part, answer))
        words, pairs, triples = ([unpack(a) for _, a in sorted(own)] for own in answers)
        joined = lambda own, i, kind: np.concatenate([np.zeros(0, np.uint64), *(t[i] for t in own)]).astype(kind)
        b.learn_words(joined(words, 0, np.int64), joined(words, 1, np.uint64), joined(words, 2, bool))
        b.asked = b.asked_pairs(owners)
        if stage(right) > 0:
            b.learn_pairs(joined(pairs, 0, np.int64), joined(pairs, 1, bool))
        if stage(right) > 1:
            b.learn_triples(joined(triples, 0, np.int64))
        return b

    def stage(right: pa.Table) -> int:
        """How many rounds of questions have been answered after the words' one; each round's rows say so."""
        return right.column("round")[0].as_py()

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        b = opened(left, right)
        (owner, hn, wn), c, block = b.asked, b.pair_total[b.pair_asked], left.column("block")[0].as_py()
        rows = [(o, block, pack(np.diff(hn[i:j], prepend=np.uint64(0)), wn[i:j], c[i:j])) for o, i, j in cuts(owner)]
        return pa.table(dict(zip(("owner", "block", "blob"), rows_of(rows))))

    def count_pairs(table: pa.Table) -> pa.Table:
        heads, words, times, size = [], [], [], []
        for x in table.column("blob").to_pylist():
            h, w, c = unpack(x)
            heads.append(np.cumsum(h, dtype=np.uint64))
            words.append(w)
            times.append(c.astype(np.int64))
            size.append(len(c))
        n, inverse = numbered_pairs(np.concatenate(heads), np.concatenate(words))
        total = np.bincount(inverse, weights=np.concatenate(times), minlength=n).astype(np.int64)[inverse]
        shared = (np.bincount(inverse, minlength=n) > 1).astype(np.uint8)[inverse]
        ends = np.cumsum(size)
        answers = [pack(total[e - n : e], shared[e - n : e]) for e, n in zip(ends, size)]
        return pa.table({"block": table.column("block"), "kind": pa.array(np.ones(len(size), np.int32)), "part": table.column("owner"), "answer": pa.array(answers, pa.binary())})

    def ask_triples(left: pa.Table, right: pa.Table) -> pa.Table:
        b = opened(left, right)
        k, c, block = b.triple_key, b.triple_total[b.triple_asked], left.column("block")[0].as_py()
        rows = [(o, block, pack(np.diff(k[i:j], prepend=np.uint64(0)), c[i:j], level=1)) for o, i, j in cuts(among(k, owners))]
        return pa.table(dict(zip(("owner", "block", "blob"), rows_of(rows))))

    def count_triples(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table.column("blob").to_pylist()]
        u, inverse = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(u)).astype(np.int64)[inverse]
        ends = np.cumsum([len(k) for k, _ in parts])
        answers = [pack(total[e - len(k) : e]) for e, (k, _) in zip(ends, parts)]
        return pa.table({"block": table.column("block"), "kind": pa.array(np.full(len(parts), 2, np.int32)), "part": table.column("owner"), "answer": pa.array(answers, pa.binary())})

    words = C.staged(blocks.select("block", "words", "times").mapInArrow(ask_words, "owner long, block long, blob binary").groupBy("owner").applyInArrow(count_words, "block long, kind int, part long, answer binary, n long, v long"), "none")
    stats = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_train, distinct = int(stats.n), int(stats.v)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = opened(left, right)
        root, taken = Automaton(b, n_train, distinct, weight).traverse()
        add = lambda x: np.add.reduceat(x, b.first)
        return pa.table(
            {
                "doc_id": pa.array(b.keys, pa.int64()),
                "held_out": b.held,
                "n_tokens": b.n,
                "n_known": add((b.total[b.token] > 0).astype(np.int64)),
                "train_tokens": np.full(len(b.n), n_train, np.int64),
                "base_score": add(root),
                "score": add(taken),
                "gain": add(taken - root) / b.n,
            }
        )

    answer, ask = "block long, kind int, part long, answer binary", "owner long, block long, blob binary"
    back = words.drop("n", "v")
    texts = blocks.drop("words").repartition("block").groupBy("block")  # one exchange for all uses
    told = lambda answers, n: answers.withColumn("round", F.lit(n)).groupBy("block")
    pairs = texts.cogroup(told(back, 0)).applyInArrow(ask_pairs, ask).groupBy("owner").applyInArrow(count_pairs, answer)
    known = back.unionByName(pairs)
    triples = texts.cogroup(told(known, 1)).applyInArrow(ask_triples, ask).groupBy("owner").applyInArrow(count_triples, answer)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, gain double"
    return texts.cogroup(told(known.unionByName(triples), 2)).applyInArrow(finish, out)
