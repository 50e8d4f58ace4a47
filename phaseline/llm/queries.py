"""The training-data operators as registered queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digest(secrets.scan(_documents(spark, sf_dir)))


def op2_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.digest(media.media_table(_documents(spark, sf_dir)))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from . import bpe

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(_documents(spark, sf_dir), ranks, P.PATTERN)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    return linededup.clean_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mixture(_documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.rules(_documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.remove_repeats(_documents(spark, sf_dir))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from . import common, tokenfile

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return tokenfile.checksums(_documents(spark, sf_dir), common.shared_dir(spark), tokenizer, 2)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(_documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from . import bpe, chat

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    control = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    windows = chat.windows(turns.unionByName(control), bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    return chat.digests(windows)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import interaction

    return interaction.filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from . import alignment

    definition, model = alignment.read_definition(P.path("byte_bpe_50k.json")), alignment.read_model(P.path("piece_bpe_32k.model"))
    return alignment.alignment(_documents(spark, sf_dir), definition, P.PATTERN, model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import interaction, linededup, mixing, neardup, quality

    return {"op4_near_duplicates": neardup.near_duplicates_sql(), "op5_line_dedup": linededup.clean_pages_sql(), "op6_mixing": mixing.mixture_sql(), "op7_quality_rules": quality.rules_sql(), "op12_filter_audit": interaction.filter_audit_sql()}
