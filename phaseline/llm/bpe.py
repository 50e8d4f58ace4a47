"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens are exploded with their positions inside a block of documents; each
block sends every distinct pre-token once to the task that owns it by hash.
That task encodes each distinct pre-token of the whole corpus exactly once,
however many blocks asked for it, and sends the ids back; the block reassembles
its documents by position.  A frequent word costs one row a block, so no key
is hot, and the owner streams its rows with a dictionary of its own words only.

Decoding joins ids with the table of token bytes.  That table is broadcast: it
has one row an id of the vocabulary, whatever the corpus.

Defined cases: a null or empty text has no tokens and decodes to no bytes; a
null id is kept and null; a very long text is a block of its own, cut at no place;
of two equally ranked pairs the first is merged first; repeated rows stay
repeated; other columns are ignored whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Text of a block; a block's dictionary travels once.
BLOCK_BYTES = 8 << 20
#: Distinct pre-tokens of about this much text belong to one owner.
OWNER_BYTES = 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, bytes) by id: the token-byte table as three arrays."""
    length = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    parts = [b""] * len(length)
    for token, i in ranks.items():
        parts[i], length[i] = token, len(token)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
    return start, length, np.frombuffer(b"".join(parts), np.uint8)


def decode_ids(ids: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each token's bytes) of an array of ids."""
    start, length, data = table
    if len(ids) and (ids.max() >= len(length) or ids.min() < 0):
        raise ValueError("an id is outside the vocabulary")
    n = length[ids]
    return data[C.ragged(start[ids], n)], n


def _by_owner(words: Iterable[str], owners: int) -> dict[int, list[str]]:
    """The words of each owner, in order, so that both ends agree on it."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    out: dict[int, list[str]] = {}
    for w in sorted(words):
        out.setdefault(h(w.encode()) % owners, []).append(w)
    return out


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", finish=None, schema: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row of ``df``.

    ``ranks`` and ``pattern`` are a tokenizer's vocabulary and its splitting
    pattern.  ``finish(keys, ids, lengths)`` may turn a block's ids into other
    columns, named by ``schema``, before they leave the worker.
    """
    spark = df.sparkSession
    total = C.text_bytes(df, text)[1]
    owners = C.pieces(total, OWNER_BYTES)
    # one exchange, which both uses of the blocks read
    blocks = C.pack_documents(df, key, text, BLOCK_BYTES, 5).repartition("block")
    shared = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary

    def split(payload: bytes, seen: dict[str, int]) -> tuple[list, list[np.ndarray]]:
        """Keys, and each text's pre-tokens as numbers by ``seen``, which learns new ones; no text's strings are kept."""
        import regex

        keys, texts = C.unpack(payload)
        find, number = regex.compile(pattern).findall, seen.setdefault
        return keys, [np.array([number(w, len(seen)) for w in find(x.decode())], np.int32) for x in texts]

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                seen: dict[str, int] = {}
                split(payload.as_py(), seen)
                groups = _by_owner(seen, owners)
                blobs = [C.to_blob(3, w=pa.array(g, pa.string())) for g in groups.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int64()), pa.array([block] * len(groups), pa.int64()), pa.array(list(map(check, groups.values())), pa.int64()), pa.array(blobs, pa.binary())], ["owner", "block", "words_hash", "words"])

    def check(words: list[str]) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest("\n".join(words).encode()) >> 1

    def one_piece():
        import tiktoken

        # the pattern takes a whole pre-token as one piece, so only merges act
        return tiktoken.Encoding("one", pat_str=r"(?s:.+)", mergeable_ranks=shared.value, special_tokens={}).encode_ordinary

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = one_piece()
        known: dict[str, list[int]] = {}
        for b in batches:
            out = []
            for blob in b.column(3):
                ids = []
                for w in C.from_blob(blob.as_py()).column("w").to_pylist():
                    got = known.get(w)
                    if got is None:
                        known[w] = got = one(w)
                    ids.append(got)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for own in ids for i in own), np.uint32, int(size.sum()))
                out.append(pack_ids(size, flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["owner", "block", "words_hash", "answer"])

    def pack_ids(size, flat):
        small = size.astype(np.uint8) if size.max(initial=0) < 256 else size.astype(np.uint32)
        ids = flat.astype(np.uint16) if flat.max(initial=0) < 65536 else flat
        return b"".join([small.dtype.str[-1:].encode(), ids.dtype.str[-1:].encode(), len(size).to_bytes(4, "little"), small.tobytes(), ids.tobytes()])

    def unpack_ids(blob):
        kinds, n = blob[:2].decode(), int.from_bytes(blob[2:6], "little")
        size = np.frombuffer(blob, f"<u{kinds[0]}", n, 6).astype(np.int64)
        return size, np.frombuffer(blob, f"<u{kinds[1]}", -1, 6 + n * int(kinds[0])).astype(np.uint32)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        seen: dict[str, int] = {}
        split_docs = [split(p, seen) for p in left.column("payload").to_pylist()]
        groups = _by_owner(seen, owners)
        answers = {(o, h): unpack_ids(a) for o, h, a in zip(*(right.column(c).to_pylist() for c in ("owner", "words_hash", "answer")))}
        place, known = np.empty(len(seen), np.int64), 0  # of each number in the order of the answers
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for owner, words in groups.items():
            size, ids = answers.get((owner, check(words)), (None, None))
            if size is None:  # the block was made anew, with other rows, after an executor was lost
                one = one_piece()
                own = [one(w) for w in words]
                size, ids = np.fromiter(map(len, own), np.int64, len(own)), np.array([i for x in own for i in x], np.uint32)
            place[[seen[w] for w in words]] = np.arange(known, known + len(words))
            known += len(words)
            flat.append(ids), sizes.append(size)
        flat, size = np.concatenate(flat), np.concatenate(sizes)
        start = np.cumsum(size) - size
        tables = []
        for keys, docs in split_docs:
            per = np.fromiter(map(len, docs), np.int64, len(docs))
            at = place[np.concatenate([np.zeros(0, np.int32), *docs])]
            ids = flat[C.ragged(start[at], size[at])]
            ends = np.concatenate([[0], np.cumsum(size[at])])[np.concatenate([[0], np.cumsum(per)])]
            tables.append((finish or as_lists)(keys, ids, np.diff(ends)))
        return pa.concat_tables(tables)

    def as_lists(keys, ids, lengths):
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.table({"key": pa.array(keys, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))})

    asked = blocks.mapInArrow(ask, "owner long, block long, words_hash long, words binary").repartition(owners, "owner")
    answers = asked.mapInArrow(answer, "owner long, block long, words_hash long, answer binary")
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, schema or "key long, ids array<int>")
    return out if schema else out.withColumnRenamed("key", key)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded`` (binary): the bytes of its ``ids``, null where they are null."""
    from pyspark.sql import types as T

    shared = df.sparkSession.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    names = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(shared.value)
        for b in batches:
            out = []
            for row in b.column(names.index(ids)):
                out.append(None if not row.is_valid else decode_ids(np.asarray(row.values.to_numpy(zero_copy_only=False), np.int64), table)[0].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return df.select(*names).mapInArrow(run, schema)


def digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), decoded from the ids alone."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def finish(keys, ids, lengths):
        table = token_table(shared.value)
        n_tokens, a, b, at = [], [], [], 0
        for n in lengths.tolist():
            own = ids[at : at + n]
            at += n
            n_tokens.append(n)
            a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            b.append(hashlib.sha256(decode_ids(own.astype(np.int64), table)[0].tobytes()).hexdigest())
        return pa.table({"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return encode(df, ranks, pattern, key, text, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


__all__ = ["decode", "decode_ids", "digests", "encode", "load_ranks", "token_table"]
