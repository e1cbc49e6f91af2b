"""Pairs of intersecting rectangles by grid cell, each pair once.

A theta join on a frame key compares all boxes of a frame. Here each rectangle is
listed under the grid cells it covers and boxes meet only inside a cell, so a
crowded frame is spread over its cells and distant boxes never meet. A pair is
emitted in one cell only: the one that holds the top-left corner of its overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame, rect: list[Column], cell: float) -> DataFrame:
    cx1, cy1, cx2, cy2 = (F.floor(c / F.lit(float(cell))).cast("int") for c in rect)
    return (
        df.withColumn("__cx1", cx1)
        .withColumn("__cy1", cy1)
        .withColumn("__cx2", F.greatest(cx2, F.col("__cx1")))
        .withColumn("__cy2", F.greatest(cy2, F.col("__cy1")))
        .withColumn("__cx", F.explode(F.sequence("__cx1", "__cx2")))
        .withColumn("__cy", F.explode(F.sequence("__cy1", "__cy2")))
        .drop("__cx2", "__cy2")
    )


def rect_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_rect: list[Column],
    right_rect: list[Column],
    cell: float = 512.0,
    extra: Column | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Inner join of rectangles with equal ``keys`` that touch or overlap.

    Columns other than ``keys`` must differ between the sides. ``extra`` is a cheap
    further condition evaluated inside the join. ``hashed`` sorts both sides by a hash of
    keys and cell first, which is faster where few keys hold the rows; key types must be equal.
    """
    a = _cells(left, left_rect, cell).withColumnsRenamed({"__cx1": "__ax", "__cy1": "__ay"})
    b = _cells(right, right_rect, cell).withColumnsRenamed({"__cx1": "__bx", "__cy1": "__by"})
    on = [*keys, "__cx", "__cy"]
    if hashed:
        a, b = (side.withColumn("__at", F.xxhash64(*on)) for side in (a, b))
        on = ["__at", *on]
    joined = a.join(b, on, "inner")
    first_cell = (F.col("__cx") == F.greatest("__ax", "__bx")) & (F.col("__cy") == F.greatest("__ay", "__by"))
    joined = joined.where(first_cell if extra is None else first_cell & extra)
    return joined.drop("__at", "__cx", "__cy", "__ax", "__ay", "__bx", "__by")
