"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loanloom.llm import fim, oracles
from loanloom.llm.ann import nearest_vectors
from loanloom.llm.bpe import round_trip_digests
from loanloom.llm.common import finished, small_batches, table, taken
from loanloom.llm.dialogues import repair_digests
from loanloom.llm.embeddings import link_vectors
from loanloom.llm.licenses import scan_licenses
from loanloom.llm.lm import score_texts
from loanloom.llm.neardup import link_near_duplicates
from loanloom.llm.packing import pack
from loanloom.llm.quality import apply_quality
from loanloom.llm.secrets import scan_secrets
from loanloom.llm.substrings import removal_digests
from loanloom.llm.toxicity import score_toxicity

#: The same vocabulary as byte_bpe_50k.json, as ranks.
PACKING_RANKS = "byte_bpe_50k.tiktoken"
ENCODING_RANKS = "byte_bpe_multi_50k.tiktoken"


def _clean(query):
    """``query``, whose result needs none of its working tables, which go."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        taken()  # tables of others stay
        with small_batches(spark):
            return finished(query(spark, sf_dir))

    return run


@_clean
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_clean
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_clean
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_duplicates(table(spark, sf_dir, "documents"))


@_clean
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_RANKS))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


@_clean
def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


@_clean
def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(ENCODING_RANKS))


@_clean
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@_clean
def op11_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformation_digests(table(spark, sf_dir, "documents"))


@_clean
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality": op2_quality,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_packing": op4_packing,
        "op5_licenses": op5_licenses,
        "op6_embeddings": op6_embeddings,
        "op7_lm": op7_lm,
        "op8_bpe": op8_bpe,
        "op9_substrings": op9_substrings,
        "op10_secrets": op10_secrets,
        "op11_neighbors": op11_neighbors,
        "op12_fim": op12_fim,
        "op13_conversations": op13_conversations,
        "pipeline": pipeline,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op2_quality": oracles.QUALITY,
        "op3_near_duplicates": oracles.NEAR_DUPLICATES,
        "op6_embeddings": oracles.EMBEDDING_LINKS,
        "op12_fim": fim.SQL,
        "op13_conversations": oracles.CONVERSATIONS,
    }
