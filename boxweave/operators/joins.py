"""Joins: as-of alignment, box pairs, labels, splits, frame matching, sweeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxweave.functions import geometry as G
from boxweave.functions.staged import staged
from boxweave.operators.filters import tile_of
from boxweave.operators.scan import Step, ordered_scan, time_block
from boxweave.operators.spatial import rect_pairs
from boxweave.session import broadcast_if_small, reach_workers

BOX_COLUMNS = ["x1", "y1", "x2", "y2"]


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """Columns other than ``keys`` get a prefix, so that two sides can meet."""
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def asof_snapshot(video: DataFrame, snapshots: DataFrame, values: list[str], keys: list[str] | None = None,
                  block_ms: int = 3_600_000) -> DataFrame:
    """Newest snapshot at or before each video frame, and how old it is.

    Both sides are merged into one ordered scan per channel (and connection), so
    nothing is paired. Frames before the first snapshot get nulls.
    """
    keys = keys or ["channel_id"]
    picked = F.struct(F.col("pts_ms").alias("snapshot_pts_ms"), F.col("frame_id").alias("snapshot_frame_id"), *values)
    right = snapshots.select(
        *keys, "pts_ms", "frame_id", F.lit(0).alias("__side"), picked.alias("__snap"),
        *[F.lit(None).cast(video.schema[c].dataType).alias(c) for c in video.columns if c not in (*keys, "pts_ms", "frame_id")],
    )
    left = video.withColumn("__side", F.lit(1)).withColumn("__snap", F.lit(None).cast(right.schema["__snap"].dataType))
    merged = left.unionByName(right)
    scanned = ordered_scan(
        merged,
        keys,
        [time_block("pts_ms", block_ms)],
        [F.col("pts_ms"), F.col("__side"), F.col("frame_id")],
        [Step("__seen", "last", F.col("__snap"))],
    )
    return scanned.where(F.col("__side") == 1).select(
        *video.columns, "__seen.*", (F.col("pts_ms") - F.col("__seen.snapshot_pts_ms")).alias("pts_delta_ms")
    )


def labels_with_detections(video: DataFrame, snapshots: DataFrame, detections: DataFrame) -> DataFrame:
    """Boxes to draw on each video frame: those of its as-of snapshot.

    The live system holds frames back so that their snapshot has arrived; in batch all
    have. The streaming form, with the bounded delay, is ``streaming.align``.
    """
    aligned = asof_snapshot(video, snapshots, [])
    boxes = detections.withColumnRenamed("frame_id", "snapshot_frame_id").drop("pts_ms", "ts_ms")
    return aligned.join(boxes, ["channel_id", "snapshot_frame_id"])


def track_candidates(previous: DataFrame, current: DataFrame, keys: list[str], frame_width: float,
                     frame_height: float, match_iou: float = 0.20, center_ratio: float = 0.12) -> DataFrame:
    """Scored pairs of a track box and a detection that may be the same object.

    ``previous`` carries ``active``. A pair passes by overlap, by distance with similar
    size, or by containment when classes agree, and as a competitor when they differ.
    """
    reach = max(48.0, (frame_width**2 + frame_height**2) ** 0.5 * center_ratio)
    left = prefixed(previous, "t_", keys)
    right = prefixed(current, "d_", keys)
    t, d = G.box("t_"), G.box("d_")
    # Every rule needs an overlap or a centre distance within reach, so the track's
    # rectangle grown to both finds every candidate.
    grown = [
        F.least(t.x1, G.center_x(t) - reach),
        F.least(t.y1, G.center_y(t) - reach),
        F.greatest(t.x2, G.center_x(t) + reach),
        F.greatest(t.y2, G.center_y(t) + reach),
    ]
    pairs = rect_pairs(left, right, keys, grown, d.corners)
    # Each stage is computed once per pair; the rules then only compare numbers.
    col = F.col
    pairs = staged(pairs, {
        "same": t.class_id == d.class_id, "shared": G.intersection(t, d), "t_area": G.area(t), "d_area": G.area(d), "distance": G.center_distance(t, d),
        "t_w": G.width(t), "t_h": G.height(t), "d_w": G.width(d), "d_h": G.height(d), "centred": G.center_inside(t, d),
    })
    small = F.least("t_area", "d_area")
    t_size, d_size = col("t_w") * col("t_h"), col("d_w") * col("d_h")
    longest = F.greatest(F.hypot("t_w", "t_h"), F.hypot("d_w", "d_h"))
    measured = staged(pairs, {
        "overlap": col("shared") / F.greatest(col("t_area") + col("d_area") - col("shared"), F.lit(1.0)),
        "inside": F.when(small > 0, col("shared") / small).otherwise(0.0),
        "similarity": F.least(t_size, d_size) / F.greatest(t_size, d_size),
        "local_reach": F.greatest(F.lit(48.0), F.least(F.lit(reach), longest * 1.25)),
    })
    near = (col("distance") <= col("local_reach")) & (col("similarity") >= 0.40)
    nested = (col("inside") >= G.SAME_CLASS_CONTAINMENT) & col("centred")
    rival = (col("overlap") >= G.CROSS_CLASS_IOU) | ((col("inside") >= G.CROSS_CLASS_CONTAINMENT) & col("centred"))
    passed = measured.where((col("same") & ((col("overlap") >= match_iou) | near | nested)) | (~col("same") & rival))
    score = (
        col("overlap")
        + col("similarity") * 0.10
        + F.when(col("same"), col("inside") * 0.10).otherwise(0.05)
        - col("distance") / reach * 0.05
        + F.when(col("t_active"), 0.05).otherwise(0.0)
    )
    helpers = ["shared", "t_area", "d_area", "t_w", "t_h", "d_w", "d_h", "centred", "local_reach"]
    return passed.withColumns({"competitor": ~col("same"), "match_score": score}).drop("same", *helpers)


def overlap_pairs(detections: DataFrame, keys: list[str], min_area: float = 0.0) -> DataFrame:
    """Pairs of boxes of one frame that share more than ``min_area`` square pixels."""
    slim = detections.select(*keys, "det_ord", "class_id", "score", *BOX_COLUMNS)
    a, b = G.box("a_"), G.box("b_")
    pairs = rect_pairs(
        prefixed(slim, "a_", keys), prefixed(slim, "b_", keys), keys, a.corners, b.corners,
        extra=F.col("a_det_ord") < F.col("b_det_ord"),
    )
    shared = G.intersection(a, b)
    union = G.area(a) + G.area(b) - shared
    return (
        pairs.withColumn("intersection_area", shared)
        .where(F.col("intersection_area") > max(0.0, min_area))
        .withColumn("iou", F.when(union > 0, shared / union).otherwise(F.lit(0.0)))
        .withColumn("ios", G.containment(a, b))
    )


def first_displays(display: DataFrame, block_ms: int = 3_600_000) -> DataFrame:
    """Video frames that show another snapshot than the frame before, if it has two boxes or more."""
    crowded = display.where(F.col("n_boxes") >= 2)
    shown = F.struct("snapshot_frame_id", "snapshot_pts_ms")
    scanned = ordered_scan(
        crowded, ["channel_id"], [time_block("pts_ms", block_ms)], [F.col("pts_ms"), F.col("frame_id")],
        [Step("__before", "lag", shown)],
    )
    return scanned.where(F.col("__before").isNull() | (F.col("__before") != shown)).drop("__before")


def overlap_audit(display: DataFrame, detections: DataFrame, min_area: float = 0.0) -> DataFrame:
    """Overlapping pairs about to be drawn, each snapshot audited once."""
    keys = ["channel_id", "snapshot_frame_id"]
    boxes = detections.withColumnRenamed("frame_id", "snapshot_frame_id")
    return overlap_pairs(boxes, keys, min_area).join(first_displays(display).drop("n_boxes"), keys)


def suppress_tile_duplicates(tiled: DataFrame, joint: DataFrame, keys: list[str]) -> DataFrame:
    """Tile boxes that no rechecked box of their class covers.

    A tile box goes if half of either box is shared, or 0.35 of the smaller.
    """
    on = [*keys, "class_id"]
    t, j = G.box("t_"), G.box("j_")
    pairs = rect_pairs(
        prefixed(tiled.select(*on, "det_ord", *BOX_COLUMNS), "t_", on),
        prefixed(joint.select(*on, *BOX_COLUMNS), "j_", on),
        on,
        [F.col(f"t_{c}") for c in BOX_COLUMNS],
        [F.col(f"j_{c}") for c in BOX_COLUMNS],
        cell=2048.0,
    )
    t = G.Box(*[F.col(f"t_{c}") for c in BOX_COLUMNS])
    j = G.Box(*[F.col(f"j_{c}") for c in BOX_COLUMNS])
    shared, own, other = G.intersection(t, j), G.area(t), G.area(j)
    covered = (own > 0) & (
        (shared / own >= 0.50)
        | (shared / F.greatest(other, F.lit(1.0)) >= 0.50)
        | (shared / F.greatest(F.least(own, other), F.lit(1.0)) >= 0.35)
    )
    hit = pairs.where(covered).select(*keys, F.col("t_det_ord").alias("det_ord")).distinct()
    return tiled.join(hit, [*keys, "det_ord"], "left_anti")


def joint_recheck_pairs(tiled: DataFrame, keys: list[str], frame_width: int, frame_height: int) -> DataFrame:
    """Half boxes of one object across a tile seam, with the padded region to look at again."""
    on = [*keys, "class_id"]
    slim = tiled.select(*on, "det_ord", *BOX_COLUMNS, "tile_x", "tile_y", "tile_w", "tile_h")
    left, right = prefixed(slim, "a_", on), prefixed(slim, "b_", on)

    def of(p: str) -> tuple[G.Box, G.Box]:
        box = G.Box(*[F.col(f"{p}{c}") for c in BOX_COLUMNS])
        x, y = F.col(f"{p}tile_x"), F.col(f"{p}tile_y")
        return box, G.Box(x, y, x + F.col(f"{p}tile_w"), y + F.col(f"{p}tile_h"))

    (a, ta), (b, tb) = of("a_"), of("b_")
    # Both boxes reach into the band their tiles share and lie at most 384 apart, so the
    # left rectangle grown by that much meets the right one.
    reach = 384.0
    grown = [a.x1 - reach, a.y1 - reach, a.x2 + reach, a.y2 + reach]
    pairs = rect_pairs(left, right, on, grown, b.corners, cell=2048.0, extra=F.col("a_det_ord") < F.col("b_det_ord"))
    band = G.shared_rect(ta, tb)
    sideways = (band.x2 - band.x1) < (band.y2 - band.y1)
    across = F.when(sideways, G.overlap_ratio_1d(a.y1, a.y2, b.y1, b.y2)).otherwise(G.overlap_ratio_1d(a.x1, a.x2, b.x1, b.x2))
    gap = F.when(sideways, G.interval_gap(a.x1, a.x2, b.x1, b.x2)).otherwise(G.interval_gap(a.y1, a.y2, b.y1, b.y2))
    kept = pairs.where(
        G.rects_overlap(ta, tb) & G.rects_overlap(a, band) & G.rects_overlap(b, band) & (across >= 0.30) & (gap <= reach)
    )
    # Padding 256 by 160, left edge and width on 16 pixels, rows even.
    x1 = F.greatest(F.lit(0), F.floor(F.least(a.x1, b.x1)) - 256)
    y1 = F.greatest(F.lit(0), F.floor(F.least(a.y1, b.y1)) - 160)
    x2 = F.least(F.lit(frame_width), F.ceil(F.greatest(a.x2, b.x2)) + 256)
    y2 = F.least(F.lit(frame_height), F.ceil(F.greatest(a.y2, b.y2)) + 160)
    x1, y1 = x1 - F.pmod(x1, F.lit(16)), y1 - F.pmod(y1, F.lit(2))
    x2 = F.least(F.lit(frame_width), x2 + F.pmod(-x2, F.lit(16)))
    y2 = y2 - F.pmod(y2, F.lit(2))
    return kept.select(
        *on,
        F.col("a_det_ord").alias("a_ord"),
        F.col("b_det_ord").alias("b_ord"),
        x1.cast("int").alias("region_x"),
        y1.cast("int").alias("region_y"),
        F.greatest(F.lit(2), x2 - x1).cast("int").alias("region_w"),
        F.greatest(F.lit(2), y2 - y1).cast("int").alias("region_h"),
    )


def gt_candidates(gt: DataFrame, pred: DataFrame, keys: list[str], denominator: str = "detector",
                  min_iou: float = 0.0) -> DataFrame:
    """Overlapping ground-truth and predicted boxes of one image and class, with their IoU.

    ``gt`` has ``gt_ord``; ``pred`` has ``pred_ord`` and ``score``.
    """
    left = prefixed(gt.select(*keys, "gt_ord", *BOX_COLUMNS), "g_", keys).withColumnRenamed("g_gt_ord", "gt_ord")
    right = prefixed(pred.select(*keys, "pred_ord", "score", *BOX_COLUMNS), "p_", keys)
    right = right.withColumnsRenamed({"p_pred_ord": "pred_ord", "p_score": "score"})
    g = G.Box(*[F.col(f"g_{c}") for c in BOX_COLUMNS])
    p = G.Box(*[F.col(f"p_{c}") for c in BOX_COLUMNS])
    pairs = rect_pairs(left, right, keys, g.corners, p.corners)
    scored = pairs.withColumn("iou", G.iou(p, g, denominator)).where((F.col("iou") > 0) & (F.col("iou") >= min_iou))
    return scored.select(*keys, "gt_ord", "pred_ord", "score", "iou")


def best_gt(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Best ground truth of each prediction, the first of equals; not one-to-one."""
    best = candidates.groupBy(*keys, "pred_ord").agg(
        F.min_by(F.struct("gt_ord", "iou"), F.struct(-F.col("iou"), F.col("gt_ord"))).alias("b")
    )
    return best.select(*keys, "pred_ord", "b.gt_ord", "b.iou")


def sweep(samples: DataFrame, params: list[dict]) -> DataFrame:
    """Every sample once per parameter set. The sets are a literal list in the plan."""
    names = list(params[0])
    sets = F.array(*[F.struct(F.lit(i).alias("param_id"), *[F.lit(p[n]).alias(n) for n in names]) for i, p in enumerate(params)])
    return samples.withColumn("__p", F.explode(sets)).select(*samples.columns, "__p.*")


def best_frame_match(target: DataFrame, reference: DataFrame, keys: list[str], window: int, step: int = 1) -> DataFrame:
    """Reference frame with the least pixel error within ``window`` frame numbers; the first of equals.

    A target is compared with the frame numbers ``window`` before it, ``step`` further and so on. Frames meet in blocks of eight windows:
    a target goes to its block, a reference frame to its own and, near an edge, to the neighbour as well, so no picture is
    sent more than twice. Frames without pixels and pairs of different size do not match; nor do rows with a null key.
    """
    size = max(1, 8 * window)
    kinds = ", ".join(f"{k} {target.schema[k].dataType.simpleString()}" for k in keys)
    pixels = F.transform("pixels", lambda v: v.cast("double")).alias("pixels")
    seen = [F.col(c).isNotNull() for c in ("pixels", "frame_no")]
    left = target.where(seen[0] & seen[1]).select(*keys, F.floor(F.col("frame_no") / size).alias("block"), F.col("frame_no").cast("long").alias("no"), pixels)
    edges = [F.floor((F.col("frame_no") + d) / size) for d in (-window, window)]
    right = reference.where(seen[0] & seen[1]).select(*keys, F.explode(F.sequence(*edges)).alias("block"), F.col("frame_no").cast("long").alias("no"), pixels)
    reach_workers(target.sparkSession)

    def pictures(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [np.asarray(p, float) for p in table["pixels"].to_pylist()]
        out = np.zeros((len(rows), max(map(len, rows), default=0)))
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return table["no"].to_numpy(), np.array([len(r) for r in rows]), out

    def matched(key, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        no, lengths, a = pictures(ours)
        other, other_lengths, b = pictures(theirs.sort_by("no"))
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
        best, match = np.full(len(no), np.inf), np.zeros(len(no), np.int64)
        for offset in range(-window, window + 1, step) if len(no) and len(other) else ():
            first, last = np.searchsorted(other, no + offset), np.searchsorted(other, no + offset, "right")
            for again in range(int((last - first).max(initial=0))):  # repeated frame numbers
                here = np.flatnonzero((first + again < last) & (lengths == other_lengths[np.minimum(first + again, len(other) - 1)]))
                error = ((a[here] - b[first[here] + again]) ** 2).sum(axis=1) / np.maximum(1, lengths[here])
                less = error < best[here]
                best[here[less]], match[here[less]] = error[less], no[here[less]] + offset
        found = np.flatnonzero(np.isfinite(best))
        named = {k: pa.array([key[i].as_py()] * len(found), ours.schema.field(k).type) for i, k in enumerate(keys)}
        return pa.table({**named, "target_no": no[found], "match_no": match[found], "mse": best[found]})

    on = [*keys, "block"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(matched, f"{kinds}, target_no long, match_no long, mse double")


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two vectors, in double."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)
