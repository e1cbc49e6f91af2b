"""Hook for a user's model and batch pseudo-labelling with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxweave.operators.dataset import stem
from boxweave.operators.filters import to_norm
from boxweave.session import reach_workers
from boxweave.sources.sinks import label_rows

SCORES = "image_name string, det_ord int, class_id int, label string, score double, x1 double, y1 double, x2 double, y2 double"


def score(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of frames. It may load its model on the first call of a task."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            if len(pdf):
                yield fn(pdf)

    reach_workers(df.sparkSession)
    return df.mapInPandas(run, schema)


def pseudo_label(images: DataFrame, files: DataFrame, fn: Callable, overwrite: bool = False, write_empty: bool = False,
                 style: str = "pseudo") -> tuple[DataFrame, DataFrame]:
    """(manifest, label rows) for images scored by ``fn``; existing labels are kept.

    ``images`` has image_name, width, height and ``readable``. style ``pseudo`` names the
    outcomes written / no_detection_unwritten, ``draft`` names them draft / draft_empty
    and always writes.
    """
    has = files.select("image_stem").distinct().withColumn("__has", F.lit(True))
    known = images.withColumn("image_stem", stem()).join(has, "image_stem", "left")
    skip = F.coalesce(F.col("__has"), F.lit(False)) & F.lit(not overwrite)
    todo = known.where(~skip & F.col("readable"))
    found = score(todo.drop("image_stem", "__has", "readable"), fn, SCORES)
    text = F.concat_ws(":", "label", F.format_string("%.3f", "score"))
    listed = found.groupBy("image_name").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("det_ord", text.alias("t")))), lambda x: x["t"]), ";").alias("labels")
    )
    n = F.coalesce("n", F.lit(0))
    if style == "draft":
        done = F.when(n > 0, "draft").otherwise("draft_empty")
    else:
        done = F.when((n > 0) | F.lit(write_empty), "written").otherwise("no_detection_unwritten")
    status = F.when(skip, "skipped_existing").when(~F.col("readable"), "missing_image").otherwise(done)
    manifest = known.join(listed, "image_name", "left").select(
        "image_name", status.alias("status"), n.alias("detections"), F.coalesce("labels", F.lit("")).alias("labels")
    )
    sized = found.join(todo.select("image_name", "image_stem", "width", "height"), "image_name")
    boxes = to_norm(sized, F.col("width"), F.col("height"))
    return manifest, label_rows(boxes)
