"""Queries on token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boxweave.llm.bpe import bpe_digests
from boxweave.llm.common import table
from boxweave.llm.registry import query
from boxweave.llm.token_counts import section_tokens
from boxweave.llm.token_store import read_tokens, write_tokens

VOCABULARY = "byte_bpe_50k.json"


@query("op2_token_store")
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as directly addressable codes and read back."""
    segments = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=2)
    return read_tokens(segments)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op9_bpe_round_trip")
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
