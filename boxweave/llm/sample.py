"""Bounded samples of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many times the wanted number is let through by hash before the sample is cut to it.
MARGIN = 1.5


def by_label(rows: DataFrame, label: str, key: str, per_label: int, most_labels: int = 500) -> Column:
    """Condition that holds for about ``per_label`` rows of each label, chosen by the hash of ``key``.

    One count per label comes to the driver; labels beyond the ``most_labels`` most frequent
    are not learned. Rare labels are taken whole.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, MARGIN * per_label / n))).otherwise(share)
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000
