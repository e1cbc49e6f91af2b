"""Precision, recall and average precision from matched boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxweave.operators.windows import pr_curve, precision_envelope
from boxweave.session import checkpointed


def label_pair_metrics(outcomes: DataFrame, by: str = "class_id") -> DataFrame:
    """TP, FP, FN, precision, recall, F1 and mean IoU per class and overall (class -1)."""

    def n(kind: str) -> Column:
        return F.count_if(F.col("outcome") == kind)

    counted = outcomes.rollup(by).agg(
        n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"),
        F.coalesce(F.avg(F.when(F.col("outcome") == "tp", F.col("iou"))), F.lit(0.0)).alias("mean_iou"),
        F.grouping(by).alias("__all"),
    )
    one = F.lit(1)
    precision = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))
    rated = counted.withColumns({"precision": precision, "recall": recall})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-12), F.col("precision") + F.col("recall"))
    return rated.select(
        F.when(F.col("__all") == 1, -1).otherwise(F.col(by)).alias(by), "tp", "fp", "fn", "precision", "recall", f1.alias("f1"), "mean_iou"
    )


def average_precision(matches: DataFrame, gt: DataFrame, by: list[str], classes: list[int] | None = None, image: str = "frame_id",
                      style: str = "detector") -> DataFrame:
    """AP (all-point), final precision and recall of each class; ``by`` ends with ``class_id``.

    AP adds, at each true positive, one over the ground-truth count times the best
    precision from there on. Matches and curve are written once, as each is scanned
    several times.
    """
    n_gt = gt.groupBy(*by).agg(F.count("*").alias("n_gt"))
    narrow = checkpointed(matches.select(*by, image, "pred_ord", "score", "tp"))
    curve = precision_envelope(checkpointed(pr_curve(narrow, n_gt, by, image, style)), by, image)
    scored = curve.groupBy(*by).agg(
        F.sum(F.when(F.col("tp"), F.col("envelope")).otherwise(0.0)).alias("__area"),
        F.max("cum_tp").alias("tp"),
        F.count("*").alias("n_pred"),
        F.max("n_gt").alias("__n"),
    )
    out = n_gt.join(scored, by, "full")
    if classes is not None and by == ["class_id"]:
        # Classes seen nowhere still have a row; the class list is a literal.
        absent = gt.sparkSession.createDataFrame([(c,) for c in classes], "class_id int")
        out = absent.join(out, "class_id", "left")
    n = F.coalesce(F.col("n_gt"), F.lit(0))
    tp, seen = F.coalesce(F.col("tp"), F.lit(0)), F.coalesce(F.col("n_pred"), F.lit(0))
    precision = tp / (seen + 1e-6) if style == "detector" else tp / F.greatest(seen.cast("double"), F.lit(1e-9))
    some = n > 0
    return out.select(
        *by,
        n.alias("gt_count"),
        seen.alias("pred_count"),
        F.when(some & (seen > 0), F.col("__area") / n).otherwise(0.0).alias("ap"),
        F.when(some if style == "detector" else F.lit(True), precision).otherwise(0.0).alias("precision"),
        F.when(some, tp / F.greatest(n, F.lit(1))).otherwise(0.0).alias("recall"),
    )


def mean_average_precision(per_class: DataFrame, by: list[str] | None = None, missing_class: str = "skip") -> DataFrame:
    """Mean over classes: ``skip`` leaves out classes without ground truth, ``zero`` counts them as 0."""
    used = per_class.where(F.col("gt_count") > 0) if missing_class == "skip" else per_class
    return used.groupBy(*(by or [])).agg(F.avg("ap").alias("map"), F.count("*").alias("classes"))


def prediction_totals(images: DataFrame, predictions: DataFrame, key: str = "frame_id") -> DataFrame:
    """Images, predictions, and images without any."""
    per_image = images.join(predictions.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    return per_image.agg(
        F.count("*").alias("images"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("predictions"),
        F.count_if(F.col("n").isNull()).alias("empty_images"),
    )
