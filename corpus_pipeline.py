"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseline.llm import bpe, common, linededup, mixing, neardup, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source.

    Rejected documents go, with every repeated row of theirs; a null or empty text
    goes; a null language or source is a group of its own; very long texts are
    judged whole; all columns are kept, whatever their names; no documents give none.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over a twentieth of their source's documents, and at least five, share.

    Documents stay, also those left empty; a null text stays null; a null source is
    a source; repeated rows count each time; a line just at the share stays; very
    long texts are split whole; ``n_chars`` is counted anew, other columns are kept.
    """
    out = linededup.drop_boilerplate(docs, "text", "source", 5)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Texts without words and rows without an id all stay; rows of one id are one
    document and stay or go together; very long texts are compared whole; all
    columns are kept, whatever their names; no documents give none.
    """
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(common.staged(gone), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, whole and in copies.

    A document comes its words taken over its size times, rounded, so one that the
    mixture leaves out goes; null, empty and blank texts have no words and go; a
    null source is a source; of alike rows that a budget ends among, any is cut;
    all columns are kept, whatever their names; no documents give none.
    """
    return mixing.apply_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, decoded from its ids.

    A null or empty text has no tokens; null ids and repeated rows keep their rows;
    very long texts are encoded whole; no documents give none.
    """
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: SQL cannot express the encoding; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
