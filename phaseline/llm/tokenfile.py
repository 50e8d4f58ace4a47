"""Token ids in files: canonical length-limited Huffman codes, table-driven decoding.

Writing: documents are range-partitioned and sorted by id, tokenised, and
staged as block dictionaries (each distinct piece of text of a block once, with
its ids, and the sequence of pieces).  The pieces' counts give exact global id
counts; package-merge turns them into code lengths of at most ``max_length``
bits, and canonical codes follow from the lengths alone.

A written folder has two Parquet tables.  ``codes`` holds (id, length).
``blocks`` holds one row a block: its place (part, seq), its documents' keys
and token counts, the bits, and the bit offset of every 128th token.  A block
needs no other block, and each checkpoint starts a lane of its own, so a block
is decoded in 128 steps over all lanes at once.

Strings of added tokens in a text are read as the library reads them by default.

Defined cases: a null or empty text has only the end id; a very long text is a
block of its own; null keys sort first; rows of one key sort by text; ids of equal
counts get codes in order of id; an empty table gives two empty tables; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Text of a block, and tokens between checkpoints.
BLOCK_BYTES, EVERY = 2 << 20, 128
#: Text of a sorted partition.
PART_BYTES = 32 << 20
#: Text that pieces side by side may have, and such texts in one call.
RUN_BYTES, CALL = 2048, 16


# --------------------------------------------------------------------------
# codes


def code_lengths(counts: np.ndarray, max_length: int) -> np.ndarray:
    """Optimal code lengths up to ``max_length`` by package-merge; 0 where a count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_length:
        raise ValueError(f"{n} ids do not fit codes of {max_length} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.float64)  # exact below 2**53
    # each level: leaves and pairs of the level below, merged in order of weight
    is_leaf, weights = [np.ones(n, bool)], leaf
    for _ in range(max_length - 1):
        m = len(weights) // 2
        pairs = weights[: 2 * m : 2] + weights[1 : 2 * m : 2]
        both = np.concatenate([leaf, pairs])
        order = np.argsort(both, kind="stable")
        is_leaf.append(order < n)
        weights = both[order]
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        out[:leaves] += 1  # the cheapest leaves come first at each level
        take = 2 * (take - leaves)
    lengths[used] = out
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), from lengths alone."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack_codes(codes: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, first bit of each) of codes of 1 to 57 bits, one after another."""
    if not len(codes):
        return b"", np.zeros(0, np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word, shift = at >> 6, 64 - (at & 63) - n
    over = np.flatnonzero(shift < 0)
    hi = codes << np.maximum(shift, 0).astype(np.uint64)
    hi[over] = codes[over] >> (-shift[over]).astype(np.uint64)
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out[word[first]] = np.bitwise_or.reduceat(hi, first)
    out[word[over] + 1] |= codes[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at


def pack_pieces(which: np.ndarray, size: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, first bit of every 128th id) of the ids of pieces in the order ``which``.

    Each piece's codes are joined once, into strings of at most 57 bits.
    """
    start, n = np.cumsum(size) - size, lengths[ids]
    upto = np.concatenate([[0], np.cumsum(n)])
    inside = upto[:-1] - np.repeat(upto[start], size)  # first bit of each id in its piece
    part = np.concatenate([[True], (inside[1:] >> 5 != inside[:-1] >> 5) | (inside[1:] == 0)]) if len(ids) else np.zeros(0, bool)
    first = np.flatnonzero(part)
    bits = np.add.reduceat(n, first) if len(first) else first
    of = np.cumsum(part) - 1
    left = (upto[first] + bits)[of] - upto[1:]  # bits that follow in the same string
    joined = np.bitwise_or.reduceat(codes[ids] << left.astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
    parts = np.bincount(np.repeat(np.arange(len(size)), size)[first], minlength=len(size)) if len(ids) else np.zeros(len(size), np.int64)
    at_part = np.cumsum(parts) - parts
    flow = C.ragged(at_part[which], parts[which])
    data, _ = pack_codes(joined[flow], bits[flow])
    tokens, width = size[which], (upto[start + size] - upto[start])[which]
    token_at, bit_at = np.cumsum(tokens) - tokens, np.cumsum(width) - width
    total = int(tokens.sum())
    marks = np.arange(0, total, EVERY)
    j = np.searchsorted(token_at + tokens, marks, side="right")
    return data, bit_at[j] + inside[start[which[j]] + marks - token_at[j]] if total else np.zeros(0, np.int64)


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, first bit of every 128th id) of ids, each a piece of its own."""
    return pack_pieces(ids, np.ones(len(lengths), np.int64) * (lengths > 0), np.flatnonzero(lengths), codes, lengths)


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray]:
    """(bits, id and length by prefix in one number: the length in the low five bits)."""
    used = np.flatnonzero(lengths)
    bits = int(lengths.max(initial=0))
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (bits - lengths[order])
    both = np.ones(1 << bits, np.uint32 if len(lengths) < 1 << 27 else np.uint64)
    both[: int(span.sum())] = np.repeat((order << 5) | lengths[order], span)
    return bits, both


def unpack_bits(data: bytes, offsets: np.ndarray, n: int, table: tuple) -> np.ndarray:
    """The ``n`` ids of a block, one lane a checkpoint."""
    bits, both = table
    out = np.zeros((EVERY, len(offsets)), both.dtype)
    if not n:
        return np.zeros(0, np.int64)
    b = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    at, mask, end = offsets.astype(np.int64), np.uint32((1 << bits) - 1), len(window) - 1
    for step in range(min(EVERY, n)):
        prefix = (window[np.minimum(at >> 3, end)] >> (32 - bits - (at & 7)).astype(np.uint32)) & mask
        out[step] = got = both[prefix]
        at += got & 31
    return (out >> 5).T.reshape(-1)[:n].astype(np.int64)


# --------------------------------------------------------------------------
# tokenising by pieces


#: A single space between characters that are not white space: no token spans it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]


def _plain(text: str) -> bool:
    """Whether every space stands between characters that are not white space."""
    if text[0] == " " or text[-1] == " ":
        return False
    return not any(c + " " in text or " " + c in text for c in _WHITE if c in text)


#: Marks the first piece of a text, which has no space before it (a noncharacter).
FIRST = "\uffff"


def split_pieces(text: str) -> list[str]:
    """Pieces that a byte-level tokenizer encodes independently, without the space before each."""
    parts = text.split(" ") if not text or _plain(text) else _CUT.split(text)
    return [FIRST + parts[0], *parts[1:]]


def number_pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, number of each piece of all texts, pieces of each text)."""
    import pyarrow.compute as pc

    if all(not x or (_plain(x) and FIRST not in x) for x in texts):
        lists = pc.split_pattern(pa.array([FIRST + x for x in texts], pa.large_string()), " ")
    else:  # a text that holds the mark itself is one piece
        lists = pa.array([[FIRST + x] if FIRST in x else split_pieces(x) for x in texts], pa.large_list(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def unified(lists: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """(distinct pieces of all lists, the number of each piece of each list)."""
    coded = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(np.arange(len(x), dtype=np.int32)), x) for x in lists]).unify_dictionaries()
    return coded.chunk(0).dictionary, [c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]


class Pieces:
    """Encodes distinct pieces, many side by side in one call of the library."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.t.get_vocab(with_added_tokens=True)
        # a byte-level token has one character a byte, an added one the characters of its text
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        for i, token in self.t.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
            if token.lstrip or token.rstrip or token.single_word or " " in token.content:
                raise ValueError(f"the added token {token.content!r} looks beyond its piece")

    def encode(self, listed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first id, number of ids) of each piece, and the ids."""
        import pyarrow.compute as pc

        length = C.byte_lengths(listed)
        single = (length == 0) | (length != C.byte_lengths(pc.utf8_rtrim_whitespace(listed))) | pc.starts_with(listed, FIRST).to_numpy(zero_copy_only=False)
        alone, order = np.flatnonzero(single), np.flatnonzero(~single)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        texts = [x[1:] if x[:1] == FIRST else " " + x for x in listed.take(pa.array(alone)).to_pylist()]
        for at in range(0, len(texts), CALL):
            for e in self.t.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                sizes.append([len(ids[-1])])
        # the others stand side by side, and are told apart by their bytes
        ends = np.cumsum(length[order] + 1)
        cuts = np.append(np.flatnonzero(np.diff(ends // RUN_BYTES, prepend=-1)), len(order))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), listed.take(pa.array(order))), pa.scalar(" ", listed.type))
        for at in range(0, len(joined), CALL):
            for n, e in enumerate(self.t.encode_batch_fast([" " + x for x in joined[at : at + CALL].to_pylist()], add_special_tokens=False), at):
                i, j = cuts[n], cuts[n + 1]
                ids.append(np.array(e.ids, np.uint32))
                sizes.append(np.diff(np.searchsorted(np.cumsum(self.width[ids[-1]]), ends[i:j] - (ends[i - 1] if i else 0)) + 1, prepend=0).astype(np.uint32))
        got = np.concatenate(sizes).astype(np.int64)
        place = np.concatenate([alone, order])
        start, size = np.empty(len(got), np.int64), np.empty(len(got), np.int64)
        start[place], size[place] = np.cumsum(got) - got, got
        return start, size, np.concatenate(ids)


def encode_blocks(pieces: Pieces, blocks: list[tuple], end_id: int) -> Iterator[dict]:
    """Blocks (keys, distinct pieces, piece numbers, pieces of each text) as their pieces' numbers, the pieces' ids, and counts of ids.

    A piece that several of the blocks hold is encoded once.
    """
    every, numbers = unified([b[1] for b in blocks])
    start, number_of, all_ids = pieces.encode(every)
    for (keys, _, flat, per), here in zip(blocks, numbers):
        times = np.bincount(flat, minlength=len(here))
        rank = np.argsort(-times, kind="stable")  # frequent pieces get small numbers, which compress well
        place = np.empty(len(rank), np.uint32)
        place[rank] = np.arange(len(rank), dtype=np.uint32)
        sizes = number_of[here]
        size = sizes[rank]
        ordered = all_ids[C.ragged(start[here[rank]], size)]
        counts = np.bincount(ordered, weights=np.repeat(times[rank], size), minlength=end_id + 1).astype(np.int64)
        counts[end_id] += len(keys)
        used = np.flatnonzero(counts)
        token_ends = np.concatenate([[0], np.cumsum(sizes[flat])])
        n_tokens = np.diff(token_ends[np.concatenate([[0], np.cumsum(per)])]) + 1
        yield {
            "n": int(n_tokens.sum()),
            "docs": C.to_blob(k=pa.array(keys, pa.int64()), words=per, tokens=n_tokens),
            "which": C.to_blob(w=place[flat]),
            "sizes": C.to_blob(s=size.astype(np.uint32)),
            "ids": C.to_blob(i=ordered if end_id > 65535 or (len(ordered) and ordered.max() > 65535) else ordered.astype(np.uint16)),
            "counts": C.to_blob(i=used.astype(np.uint32), c=counts[used]),
        }


def _staged_blocks(df: DataFrame, tokenizer_json: str, end_id: int, key: str, text: str) -> DataFrame:
    spark = df.sparkSession
    parts = C.pieces(C.text_bytes(df, text)[1], PART_BYTES, 1)
    shared = spark.sparkContext.broadcast(tokenizer_json)  # bounded by the vocabulary
    src = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    src = src.repartitionByRange(parts, "k").sortWithinPartitions("k", "x")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, part, seq = Pieces(shared.value), TaskContext.get().partitionId(), 0

        def group(blocks):
            nonlocal seq
            for row in encode_blocks(pieces, blocks, end_id):
                yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq} | row], schema=arrow)
                seq += 1

        arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("which", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
        held, blocks, keys, texts, size = 0, [], [], [], 0
        for b in batches:
            # some rows at a time, for a batch of texts takes several times its size as Python's
            for k, x in (r for i in range(0, len(b), 256) for r in zip(b.column(0).slice(i, 256).to_pylist(), b.column(1).slice(i, 256).to_pylist())):
                keys.append(k), texts.append(x)
                size += len(x)
                if size >= BLOCK_BYTES:
                    blocks.append((keys, *number_pieces(texts)))
                    pa.default_memory_pool().release_unused()
                    held += size
                    keys, texts, size = [], [], 0
                if held >= PART_BYTES:
                    yield from group(blocks)
                    held, blocks = 0, []
        if keys:
            blocks.append((keys, *number_pieces(texts)))
        if blocks:
            yield from group(blocks)

    return C.staged(src.mapInArrow(run, "part int, seq int, n long, docs binary, which binary, sizes binary, ids binary, counts binary"), "none")


def _global_counts(blocks: DataFrame) -> np.ndarray:
    """Counts by id; what reaches the driver has at most one row an id."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for blob in b.column(0):
                t = C.from_blob(blob.as_py())
                i, c = C.np_col(t, "i").astype(np.int64), C.np_col(t, "c")
                if len(i) and i[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(i[-1]) + 1 - len(total), np.int64)])
                total[i] += c
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "c"])

    rows = blocks.select("counts").mapInArrow(add, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(int(rows.id.max()) + 1 if len(rows) else 0, np.int64)
    out[rows.id.to_numpy()] = rows.c.to_numpy()
    return out


def write(df: DataFrame, path: str, tokenizer_json: str, end_id: int, key: str = "doc_id", text: str = "text", max_length: int | None = None) -> None:
    """Tokenise ``df`` and write its ids below ``path`` in ascending key order."""
    spark = df.sparkSession
    blocks = _staged_blocks(df, tokenizer_json, end_id, key, text)
    counts = _global_counts(blocks)
    n_used = int((counts > 0).sum())
    lengths = code_lengths(counts, max_length or min(25, max(16, n_used.bit_length() + 2)))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((canonical(lengths), lengths))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value
        for b in batches:
            for row in b.to_pylist():
                docs = C.from_blob(row["docs"])
                which = C.np_col(C.from_blob(row["which"]), "w").astype(np.int64)
                size = C.np_col(C.from_blob(row["sizes"]), "s").astype(np.int64)
                ids = C.np_col(C.from_blob(row["ids"]), "i").astype(np.int64)
                tokens, words = C.np_col(docs, "tokens"), C.np_col(docs, "words")
                # the end id is one piece more, after each document's own
                flow = np.insert(which, np.cumsum(words), len(size))
                data, offsets = pack_pieces(flow, np.append(size, 1), np.append(ids, end_id), codes, lengths)
                steps = np.diff(offsets, prepend=0).astype(np.uint16)
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "seq": row["seq"], "n": row["n"], "docs": C.to_blob(k=docs.column("k").combine_chunks(), tokens=tokens.astype(np.uint32)), "bits": data, "steps": steps.tobytes()}], schema=arrow)

    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("bits", pa.binary()), ("steps", pa.binary())])
    blocks.drop("counts").mapInArrow(run, "part int, seq int, n long, docs binary, bits binary, steps binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, finish=None, schema: str = "key long, place int, ids array<int>") -> DataFrame:
    """Rows of a written folder: (part, seq) of the block and (key, place in the block, ids).

    ``finish(keys, ids, lengths)`` may turn a block's ids into other columns.
    """
    codes = spark.read.schema("id long, length int").parquet(f"{path}/codes").toPandas()  # bounded by the vocabulary
    lengths = np.zeros(int(codes.id.max()) + 1 if len(codes) else 1, np.int64)
    lengths[codes.id.to_numpy()] = codes.length.to_numpy()
    shared = spark.sparkContext.broadcast(lengths)

    def as_lists(keys, ids, n):
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return {"key": keys, "place": pa.array(np.arange(len(n), dtype=np.int32)), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value)
        for b in batches:
            for row in b.to_pylist():
                docs = C.from_blob(row["docs"])
                offsets = np.cumsum(np.frombuffer(row["steps"], np.uint16).astype(np.int64))
                ids = unpack_bits(row["bits"], offsets, row["n"], table)
                n = C.np_col(docs, "tokens").astype(np.int64)
                cols = (finish or as_lists)(docs.column("k").combine_chunks(), ids, n)
                place = [pa.array(np.full(len(n), row[c], np.int32)) for c in ("part", "seq")]
                yield pa.RecordBatch.from_arrays([*place, *cols.values()], ["part", "seq", *cols])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, f"part int, seq int, {schema}")


def checksums(df: DataFrame, path: str, tokenizer_json: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``df``, read the files, and return (doc_id, start, n_tokens, ids_crc32)."""
    spark = df.sparkSession
    write(df, path, tokenizer_json, end_id, key, text)

    def finish(keys, ids, n):
        raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n)
        crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist())]
        return {"doc_id": keys, "before": pa.array(ends - n), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}

    rows = read(spark, path, finish, "doc_id long, before long, n_tokens long, ids_crc32 long")
    place = (F.col("part").cast("long") * (1 << 20) + F.col("seq")).alias("place")
    blocks = spark.read.parquet(f"{path}/blocks").select(place, "n")
    starts = C.prefix_sums(blocks, "place", "n").withColumnRenamed("before", "base")
    return rows.withColumn("place", place).join(starts, "place").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
