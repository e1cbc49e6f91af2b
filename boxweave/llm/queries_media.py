"""Queries on media columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxweave.llm.common import table
from boxweave.llm.media import media_digests, text_media
from boxweave.llm.registry import query


@query("op6_media_clips")
def op6_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an AVI file of motion JPEG, read back, with its shots."""
    return media_digests(text_media(table(spark, sf_dir, "documents")))
