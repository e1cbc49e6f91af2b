"""Model head cells to boxes, and the geometry between frame and model input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxweave.functions import scalars as S
from boxweave.session import broadcast_if_small

# Fixed values of the quantised head: branches, tensors per branch, longest DFL
# vector, and the class counts a score tensor may have.
HEAD_BRANCHES = 3
HEAD_TENSORS = ("box", "score", "sum")
MAX_DFL_VALUES = 64
CLASS_COUNTS = (6, 80)


def label_of(class_id: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), class_id + 1)


def decode_center(cells: DataFrame, labels: list[str], model_size: int, width: int, height: int,
                  threshold: float, keep_labels: list[str] | None = None) -> DataFrame:
    """Centre-format cells with probabilities; the picture was stretched to the model size.

    The first of equal best classes wins and the threshold is inclusive.
    """
    best = F.array_max("scores")
    out = cells.where(best >= threshold).withColumn("score", best)
    out = out.withColumn("class_id", F.array_position("scores", F.col("score")).cast("int") - 1)
    out = out.withColumn("label", label_of(F.col("class_id"), labels))
    if keep_labels:
        out = out.where(F.col("label").isin(keep_labels))
    sx, sy = width / model_size, height / model_size
    half_w, half_h = F.col("w") * 0.5, F.col("h") * 0.5
    corners = {
        "x1": (F.col("cx") - half_w) * sx,
        "y1": (F.col("cy") - half_h) * sy,
        "x2": (F.col("cx") + half_w) * sx,
        "y2": (F.col("cy") + half_h) * sy,
    }
    return out.withColumns(corners).drop("cx", "cy", "w", "h", "scores")


def best_class(cells: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Best class per cell, decided on int8 codes.

    The threshold is quantised once per branch. A cell counts if its sum code reaches
    the threshold and its best score code exceeds it; the lowest class index wins ties.
    The sum test comes first and can be pushed to the scan.
    """
    codes = heads.select(
        "branch",
        S.quant(F.lit(threshold), F.col("score_zp"), F.col("score_scale")).alias("score_cut"),
        S.quant(F.lit(threshold), F.col("sum_zp"), F.col("sum_scale")).alias("sum_cut"),
        "score_zp",
        "score_scale",
    )
    passed = cells.join(broadcast_if_small(codes), "branch").where(F.col("sum_code") >= F.col("sum_cut"))
    best = F.array_max("scores")
    return (
        passed.where(best > F.col("score_cut"))
        .withColumn("class_id", F.array_position("scores", best).cast("int") - 1)
        .withColumn("score", S.dequant(best, F.col("score_zp"), F.col("score_scale")))
        .drop("score_cut", "sum_cut", "score_zp", "score_scale")
    )


def expected_distance(codes: Column, side: int, length: Column, scale: Column) -> Column:
    """Softmax expectation over one side's bins. The zero point cancels in the softmax."""
    bins = F.slice(codes, F.lit(side) * length + 1, length)
    weights = F.transform(bins, lambda v: F.exp((v - F.array_max(bins)) * scale))
    plus = lambda acc, v: acc + v
    total = F.aggregate(weights, F.lit(0.0), plus)
    moment = F.aggregate(F.transform(weights, lambda v, i: v * i), F.lit(0.0), plus)
    return moment / total


def decode_dfl(cells: DataFrame, heads: DataFrame, model_width: int, model_height: int,
               width: int, height: int) -> DataFrame:
    """Distances to the four sides, grid to model input to frame, clamped to the frame."""
    scale = min(model_width / width, model_height / height)
    pad_x = (model_width - int(width * scale + 0.5)) // 2
    pad_y = (model_height - int(height * scale + 0.5)) // 2
    dims = heads.select("branch", "stride", "dfl_len", "box_scale")
    joined = cells.join(broadcast_if_small(dims), "branch")
    d = [expected_distance(F.col("box"), s, F.col("dfl_len"), F.col("box_scale")) for s in range(4)]
    col_mid, row_mid = F.col("grid_col") + 0.5, F.col("grid_row") + 0.5

    def to_frame(grid: Column, pad: int, limit: int) -> Column:
        return S.clamp((grid * F.col("stride") - pad) / scale, 0.0, float(limit))

    corners = {
        "x1": to_frame(col_mid - d[0], pad_x, width),
        "y1": to_frame(row_mid - d[1], pad_y, height),
        "x2": to_frame(col_mid + d[2], pad_x, width),
        "y2": to_frame(row_mid + d[3], pad_y, height),
    }
    return joined.withColumns(corners).drop("box", "scores", "sum_code", "stride", "dfl_len", "box_scale")


def decode(df: DataFrame, layout: str, **options) -> DataFrame:
    """One switch over both head layouts."""
    if layout == "decoded":
        return decode_center(df, **options)
    if layout != "dfl":
        raise ValueError(f"unknown head layout {layout!r}")
    heads, labels = options.pop("heads"), options.pop("labels")
    keep_labels = options.pop("keep_labels", None)
    picked = best_class(df, heads, options.pop("threshold"))
    picked = picked.withColumn("label", label_of(F.col("class_id"), labels))
    if keep_labels:
        picked = picked.where(F.col("label").isin(keep_labels))
    return decode_dfl(picked, heads, **options)


def validate_heads(tensors: DataFrame, model_width: int, model_height: int) -> DataFrame:
    """Broken rules of a model's output tensors.

    ``tensors``: model_id, branch, tensor, dtype, quantisation, n_dims, channels, grid_h, grid_w.
    """
    whole = tensors.groupBy("model_id").agg(F.count("*").alias("n"))
    wrong_count = whole.where(F.col("n") != HEAD_BRANCHES * len(HEAD_TENSORS)).select(
        "model_id", F.lit(None).cast("int").alias("branch"), F.lit("output count").alias("violation")
    )

    def of(tensor: str, column: str) -> Column:
        return F.max(F.when(F.col("tensor") == tensor, F.col(column))).alias(f"{tensor}_{column}")

    per_branch = tensors.groupBy("model_id", "branch").agg(
        F.min((F.col("dtype") == "int8") & (F.col("quantisation") == "affine")).alias("affine"),
        F.min(F.col("n_dims") == 4).alias("four"),
        *[of(t, c) for t in HEAD_TENSORS for c in ("channels", "grid_h", "grid_w")],
    )
    gh, gw, values = F.col("box_grid_h"), F.col("box_grid_w"), F.col("box_channels")
    shape_ok = (gh > 0) & (gw > 0) & (values > 0) & (values % 4 == 0) & (values <= MAX_DFL_VALUES)
    match_ok = F.col("score_channels").isin(*CLASS_COUNTS) & (F.col("sum_channels") == 1)
    for t in ("score", "sum"):
        match_ok = match_ok & (F.col(f"{t}_grid_h") == gh) & (F.col(f"{t}_grid_w") == gw)
    stride_ok = (
        (F.pmod(F.lit(model_height), gh) == 0)
        & (F.pmod(F.lit(model_width), gw) == 0)
        & (F.lit(model_height) / gh == F.lit(model_width) / gw)
    )
    rules = F.array_compact(
        F.array(
            F.when(~F.col("affine"), "not affine int8"),
            F.when(~F.col("four"), "not four-dimensional"),
            F.when(~F.coalesce(shape_ok, F.lit(False)), "DFL shape"),
            F.when(~F.coalesce(match_ok, F.lit(False)), "shapes differ"),
            F.when(shape_ok & ~F.coalesce(stride_ok, F.lit(False)), "stride"),
        )
    )
    broken = per_branch.select("model_id", "branch", F.explode(rules).alias("violation"))
    return wrong_count.unionByName(broken)


def letterbox(df: DataFrame, model_width: int, model_height: int, even: bool = True) -> DataFrame:
    """Scale, inner size and padding for fitting a frame into the model input.

    ``even`` rounds the inner size down to even numbers (the forward path);
    the inverse mapping does not.
    """
    scale = F.least(F.lit(float(model_width)) / F.col("width"), F.lit(float(model_height)) / F.col("height"))
    inner = [F.floor(F.col(c) * scale + 0.5).cast("int") for c in ("width", "height")]
    if even:
        inner = [F.greatest(F.lit(2), S.even_floor(c).cast("int")) for c in inner]
    return df.withColumns(
        {
            "scale": scale,
            "inner_w": inner[0],
            "inner_h": inner[1],
            "pad_x": F.floor((model_width - inner[0]) / 2).cast("int"),
            "pad_y": F.floor((model_height - inner[1]) / 2).cast("int"),
        }
    )


def unletterbox(df: DataFrame, model_width: int, model_height: int, even: bool = False) -> DataFrame:
    """Boxes from model input back to the frame, clamped to it."""
    boxed = letterbox(df, model_width, model_height, even)

    def back(c: str, pad: str, limit: str) -> Column:
        return S.clamp((F.col(c) - F.col(pad)) / F.col("scale"), 0.0, F.col(limit).cast("double"))

    return boxed.withColumns(
        {
            "x1": back("x1", "pad_x", "width"),
            "y1": back("y1", "pad_y", "height"),
            "x2": back("x2", "pad_x", "width"),
            "y2": back("y2", "pad_y", "height"),
        }
    ).drop("scale", "inner_w", "inner_h", "pad_x", "pad_y")
