"""Connected components of a graph given by its links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxweave.llm.common import stored


def _stars(links: DataFrame) -> DataFrame:
    """One large-star step and one small-star step on links ``(a, b)`` with ``a > b``."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
    return small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(a, b)``: each linked node that is not the smallest of its component, and that smallest.

    ``links`` holds pairs ``a``, ``b`` of comparable values. Each round is written to the shared
    folder. Rounds end when the links no longer change; their number grows with the
    logarithm of the number of nodes. Minima are taken with map-side combine, so a hub is no
    large group, and the joins leave hubs to the adaptive split of skewed partitions.
    """
    known = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    state = None
    while True:
        known = stored(known, "links")
        row = known.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row[0] == 0 or tuple(row) == state:
            return known
        state = tuple(row)
        known = _stars(known)
