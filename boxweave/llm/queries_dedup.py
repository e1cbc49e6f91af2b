"""Queries on near copies and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxweave.llm.common import table
from boxweave.llm.registry import query
from boxweave.llm.sharding import assign_shards
from boxweave.llm.simhash import near_duplicates

#: Bytes of text that a shard may hold.
SHARD = 1 << 20


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of near copies of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


@query(
    "op10_extendible_shards",
    f"""
    WITH d AS (
        SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) * 268435456
            + CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 7) AS BIGINT) AS h
        FROM documents),
    p AS (
        SELECT k.bits, d.h >> (60 - k.bits) AS prefix, sum(d.n_bytes) AS size
        FROM d, (SELECT CAST(range AS BIGINT) AS bits FROM range(0, 61)) k GROUP BY ALL)
    SELECT d.doc_id, d.n_bytes, CASE WHEN b.bits = 0 THEN '' ELSE lpad(bin(d.h >> (60 - b.bits)), CAST(b.bits AS INT), '0') END AS shard, b.bits, CAST(0 AS BIGINT) AS page
    FROM d JOIN (
        SELECT d.doc_id, min(p.bits) AS bits FROM d JOIN p ON d.h >> (60 - p.bits) = p.prefix WHERE p.size <= {SHARD} GROUP BY d.doc_id) b ON b.doc_id = d.doc_id
    """,
)
def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return assign_shards(table(spark, sf_dir, "documents"), SHARD)
