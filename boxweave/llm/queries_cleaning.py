"""Queries on leaked benchmarks and personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxweave.llm.common import table
from boxweave.llm.decontaminate import contaminated
from boxweave.llm.pii import personal_data
from boxweave.llm.registry import query


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the best window of each."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op4_pii_disclosure")
def op4_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in every document."""
    return personal_data(table(spark, sf_dir, "documents"))
