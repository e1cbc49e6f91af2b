"""Stages that turn ``documents`` into a clean training corpus."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxweave.llm import bpe, decontaminate, language, pii, simhash
from boxweave.llm.common import crc32_mod, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Least probability of the language that a document is taken to be in; short clean texts are seldom surer.
LEAST_SCORE = 0.35
VOCABULARY = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; texts without letters and doubtful ones go."""
    net = language.learned(docs, F.coalesce(crc32_mod("doc_id", 5) != 0, F.lit(False)))
    return language.in_a_language(docs, net, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies by SimHash, as in op1; the one with the smallest id."""
    return simhash.fingerprint_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it replaced; ``n_chars`` follows the text."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: The stages hold a trained model, xxHash fingerprints and byte-pair merges, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
