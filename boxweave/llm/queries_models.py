"""Queries that train a model on labelled rows and apply it to all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxweave.llm import language, quality
from boxweave.llm.common import crc32_mod, table
from boxweave.llm.registry import query


def held_out(n: int, part: int):
    """Whether a document is kept from learning."""
    return F.coalesce(crc32_mod("doc_id", n) == part, F.lit(False))


@query("op5_quality_attention")
def op5_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.learned(docs, labels.where(~held_out(4, 2)))
    return quality.quality_scores(docs, net).withColumn("held_out", held_out(4, 2))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = language.learned(docs, ~held_out(5, 0))
    return language.languages(docs, net).withColumn("held_out", held_out(5, 0))
