"""Stage boundaries for costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results are computed once per row.

    The optimizer copies a column's definition into later filters that use it, often
    dozens of times. It does not look through a generator, so the values go through one
    that yields exactly one row.
    """
    taken = [c for c in df.columns if c not in columns]
    return df.select(*taken, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
