"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxweave.session import reach_workers, run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows reads files every executor can reach, so a lost
    executor costs the tasks at hand only.
    """
    path = run_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable on the workers."""
    reach_workers(df.sparkSession)
    return df.mapInArrow(fn, schema)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that no other column can clash."""
    return df.select(*[df[c].alias(name) for name, c in columns.items()])


def packed(df: DataFrame, **columns: str) -> DataFrame:
    """The whole row as ``row`` beside the named columns; ``select("row.*")`` gives the row back, whatever its names."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[df[c].alias(name) for name, c in columns.items()])


def crc32_mod(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % n
