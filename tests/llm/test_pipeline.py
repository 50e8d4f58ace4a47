"""The five stages against plain versions of each, on a small table."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from phaseline.llm import mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_lines_over_a_twentieth_go(spark):
    """A line of 8 in 100 documents of a source goes; one of 5 stays."""
    made = [(i, f"own {i}\n" + ("eight" if i < 8 else "five" if i < 13 else f"other {i}"), "s", 0) for i in range(100)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, n_chars long")
    out = " ".join(r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect())
    assert "eight" not in out and out.count("five") == 5


def mixing_copies(docs):
    """How often the mixture takes each row whole: its words taken over its size, rounded."""
    out = Counter()
    size = {(r.doc_id, len((r.text or "").encode().split())): r.text for r in docs.collect()}
    for r in mixing.mixture(docs).collect():
        if r.size and (2 * r.taken + r.size) // (2 * r.size):
            out[repr((r.doc_id, size[r.doc_id, r.size]))] += (2 * r.taken + r.size) // (2 * r.size)
    return out


def test_pipeline_of_no_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").columns == empty.columns


def test_stages_on_nulls_alone(spark, docs):
    """Every stage takes rows without any value."""
    none = docs.limit(2).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, none, "").count()
        assert n == (0 if name in ("quality rules", "mixing") else 2)


def test_pipeline(spark, docs, tmp_path):
    import tiktoken

    from phaseline.llm import bpe, neardup, quality
    from .test_operators import line_want, near_want

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (at, spark.read.parquet(f"{tmp_path}/{name}"))
        at = seen[name][1]
    before, after = seen["quality rules"]
    good = quality.rules(before).where("kept")
    assert sorted(map(repr, (r.doc_id for r in after.collect()))) == sorted(map(repr, (r.doc_id for r in good.collect())))
    before, after = seen["line dedup"]
    want = line_want([(r.doc_id, r.text, r.source) for r in before.collect()], 10, 5)
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["near dedup"]
    kept = [i for i, _, _, k in near_want([(r.doc_id, r.text) for r in before.collect()]) if k]
    assert sorted(map(repr, kept)) == sorted(repr(r.doc_id) for r in after.collect())
    assert neardup.near_duplicates(after).where("doc_id is not null").selectExpr("doc_id <> component_id c").where("c").count() == 0
    before, after = seen["mixing"]
    taken = mixing_copies(before)
    assert sorted(Counter(repr((r.doc_id, r.text)) for r in after.collect()).items()) == sorted(taken.items())
    assert before.columns == after.columns == docs.columns
    before, after = seen["byte-level BPE"]
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in before.collect():
        ids = enc.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, after.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
