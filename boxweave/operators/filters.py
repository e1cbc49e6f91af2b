"""Filters and projections over detections, frames and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxweave.functions import geometry as G
from boxweave.functions import scalars as S
from boxweave.functions.staged import staged
from boxweave.operators.scan import Step, ordered_scan, time_block
from boxweave.session import broadcast_if_small


def filter_confidence(df: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Inclusive for decoded heads, strict for quantised ones."""
    return df.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def filter_classes(df: DataFrame, labels: list[str]) -> DataFrame:
    """Keep the named classes; no names keep everything."""
    return df.where(F.col("label").isin(labels)) if labels else df


def roi_to_pixels(regions: DataFrame, width: float, height: float) -> DataFrame:
    """Normalised regions as pixel rectangles; empty ones are dropped."""
    x1, y1 = S.clamp01(F.col("x")), S.clamp01(F.col("y"))
    x2, y2 = S.clamp01(F.col("x") + F.col("w")), S.clamp01(F.col("y") + F.col("h"))
    return regions.where((x2 > x1) & (y2 > y1)).select(
        "region_id",
        "region_ord",
        (x1 * width).alias("rx1"),
        (y1 * height).alias("ry1"),
        (x2 * width).alias("rx2"),
        (y2 * height).alias("ry2"),
    )


def roi_assign(
    df: DataFrame,
    regions: DataFrame,
    width: float,
    height: float,
    filter_outside: bool = True,
    cells: int = 16,
    max_literal: int = 64,
) -> DataFrame:
    """First region, in ``region_ord``, that holds the centre of each box.

    Up to 64 regions, checked, become one CASE expression. More are listed under the
    cells of a grid over the frame, at most one row per cell, so each box meets one row
    by an equality join and no box is multiplied.
    """
    pixels = roi_to_pixels(regions, width, height)
    b = G.box()
    cx, cy = G.center_x(b), G.center_y(b)
    few = pixels.orderBy("region_ord").limit(max_literal + 1).collect()
    if len(few) <= max_literal:
        picked = F.lit(None).cast("struct<region_ord:int,region_id:string>")
        for r in reversed(few):
            held = cx.between(r.rx1, r.rx2) & cy.between(r.ry1, r.ry2)
            here = F.struct(F.lit(r.region_ord).alias("region_ord"), F.lit(r.region_id).alias("region_id"))
            picked = F.when(held, here).otherwise(picked)
        out = staged(df, {"hit": picked}).select(*df.columns, "hit.region_ord", "hit.region_id")
        # No usable region at all means that nothing is filtered.
        return out.where(F.col("region_id").isNotNull()) if filter_outside and few else out

    def cell(c: Column, extent: float) -> Column:
        return S.clamp(F.floor(c * cells / extent), 0, cells - 1).cast("int")

    listed = (
        pixels.withColumn("cell_x", F.explode(F.sequence(cell(F.col("rx1"), width), cell(F.col("rx2"), width))))
        .withColumn("cell_y", F.explode(F.sequence(cell(F.col("ry1"), height), cell(F.col("ry2"), height))))
        .groupBy("cell_x", "cell_y")
        .agg(F.array_sort(F.collect_list(F.struct("region_ord", "region_id", "rx1", "ry1", "rx2", "ry2"))).alias("near"))
    )
    placed = df.withColumn("cell_x", cell(cx, width)).withColumn("cell_y", cell(cy, height))
    joined = placed.join(broadcast_if_small(listed), ["cell_x", "cell_y"], "left")
    hits = F.filter(
        F.coalesce(F.col("near"), F.array()),
        lambda r: cx.between(r["rx1"], r["rx2"]) & cy.between(r["ry1"], r["ry2"]),
    )
    out = staged(joined, {"hit": F.try_element_at(hits, F.lit(1))}).select(
        *df.columns, F.col("hit.region_ord").alias("region_ord"), F.col("hit.region_id").alias("region_id")
    )
    return out.where(F.col("region_id").isNotNull()) if filter_outside else out


def clip_boxes(df: DataFrame, width: float, height: float, min_px: float = 2.0) -> DataFrame:
    """Clamp to the image; boxes thinner than ``min_px`` go."""
    out = df.withColumns(
        {
            "x1": S.clamp(F.col("x1"), 0.0, width),
            "y1": S.clamp(F.col("y1"), 0.0, height),
            "x2": S.clamp(F.col("x2"), 0.0, width),
            "y2": S.clamp(F.col("y2"), 0.0, height),
        }
    )
    return out.where((F.col("x2") - F.col("x1") >= min_px) & (F.col("y2") - F.col("y1") >= min_px))


def to_xyxy(df: DataFrame, src: str, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """Corner boxes from ``center`` (normalised cx, cy, w, h) or ``xywh`` (top-left and size)."""
    if src == "center":
        b = G.from_center(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
        corners = [b.x1 * width, b.y1 * height, b.x2 * width, b.y2 * height]
    elif src == "xywh":
        corners = [F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")]
    else:
        raise ValueError(f"unknown box format {src!r}")
    return df.withColumns(dict(zip(("x1", "y1", "x2", "y2"), corners)))


def to_norm(df: DataFrame, width: float, height: float) -> DataFrame:
    """Normalised centre boxes from corners."""
    b = G.box()
    return df.withColumns(
        {
            "cx": G.center_x(b) / width,
            "cy": G.center_y(b) / height,
            "w": (b.x2 - b.x1) / width,
            "h": (b.y2 - b.y1) / height,
        }
    )


def untile(df: DataFrame) -> DataFrame:
    """Tile coordinates to frame coordinates."""
    return df.withColumns(
        {
            "x1": F.col("x1") + F.col("tile_x"),
            "y1": F.col("y1") + F.col("tile_y"),
            "x2": F.col("x2") + F.col("tile_x"),
            "y2": F.col("y2") + F.col("tile_y"),
        }
    )


def make_tiles(regions: DataFrame, frame_width: int, frame_height: int, cols: int = 2, rows: int = 1,
               overlap_ratio: float = 0.10) -> DataFrame:
    """Overlapping tiles of each pixel region (rx1..ry2); at most two by two."""
    cols, rows = min(2, max(1, cols)), min(2, max(1, rows))
    x0 = F.greatest(F.lit(0), F.floor("rx1").cast("int"))
    y0 = F.greatest(F.lit(0), F.floor("ry1").cast("int"))
    x2 = F.least(F.lit(frame_width), F.ceil("rx2").cast("int"))
    y2 = F.least(F.lit(frame_height), F.ceil("ry2").cast("int"))
    ratio = min(0.50, max(0.01, overlap_ratio))
    df = regions.select("*", x0.alias("ax"), y0.alias("ay"), x2.alias("bx"), y2.alias("by"))
    df = df.withColumns({"rw": F.greatest(F.lit(2), F.col("bx") - F.col("ax")), "rh": F.greatest(F.lit(2), F.col("by") - F.col("ay"))})
    df = df.withColumn("shared", S.clamp(F.floor(F.col("rw") * ratio + 0.5).cast("int"), 384, 512))
    df = df.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    df = df.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))

    def span(start: str, extent: str, low: str, high: str, index: str, count: int) -> tuple[Column, Column]:
        before = F.when(F.col(index) > 0, F.floor(F.col("shared") / 2)).otherwise(0)
        after = F.when(F.col(index) + 1 < count, F.col("shared") - F.floor(F.col("shared") / 2)).otherwise(0)
        begin = F.col(start) + F.floor(F.col(extent) * F.col(index) / count) - before
        end = F.col(start) + F.floor(F.col(extent) * (F.col(index) + 1) / count) + after
        return F.greatest(F.col(low), begin), F.least(F.col(high), end)

    sx, ex = span("ax", "rw", "ax", "bx", "tile_col", cols)
    sy, ey = span("ay", "rh", "ay", "by", "tile_row", rows)
    tile = {"tile_x": S.even_floor(sx), "tile_y": S.even_floor(sy), "tile_w": S.even_floor(ex - sx), "tile_h": S.even_floor(ey - sy)}
    return df.select(*regions.columns, "tile_row", "tile_col", *[c.cast("int").alias(n) for n, c in tile.items()])


def filter_frame_shape(frames: DataFrame, channels: DataFrame) -> DataFrame:
    """Frames of the configured, even size."""
    wanted = broadcast_if_small(channels.select("channel_id", F.col("width").alias("want_w"), F.col("height").alias("want_h")))
    ok = (
        (F.col("width") == F.col("want_w"))
        & (F.col("height") == F.col("want_h"))
        & (F.col("width") % 2 == 0)
        & (F.col("height") % 2 == 0)
    )
    return frames.join(wanted, "channel_id").where(ok).drop("want_w", "want_h")


def frame_shape_drops(frames: DataFrame, channels: DataFrame) -> DataFrame:
    """How many frames per channel ``filter_frame_shape`` drops."""
    kept = filter_frame_shape(frames, channels).groupBy("channel_id").agg(F.count("*").alias("kept"))
    seen = frames.groupBy("channel_id").agg(F.count("*").alias("frames"))
    return seen.join(kept, "channel_id", "left").select(
        "channel_id", "frames", (F.col("frames") - F.coalesce(F.col("kept"), F.lit(0))).alias("dropped")
    )


def pacing_step(source_fps: float, target_fps: float) -> int:
    return max(1, int(source_fps / target_fps + 0.5)) if source_fps > 0 and target_fps > 0 else 1


def pace_frames(df: DataFrame, step: int, phase: str = "source", block: int = 100_000) -> DataFrame:
    """Every ``step``-th frame of a channel, by ordinal in frame order.

    ``source`` keeps ordinals n, 2n, ... counted from 1; ``inference`` keeps 0, n, ...
    counted from 0.
    """
    if step <= 1:
        return df
    ranked = ordered_scan(
        df, ["channel_id"], [time_block("frame_id", block)], [F.col("frame_id")], [Step("__ordinal", "count")]
    )
    first = F.lit(0 if phase == "source" else 1)
    return ranked.where(F.pmod(F.col("__ordinal") - first, F.lit(step)) == 0).drop("__ordinal")


def drop_stale(df: DataFrame, now_ms: int, max_age_ms: int) -> DataFrame:
    """Drop frames older than ``max_age_ms``; age 0 turns it off, timestamp 0 is never stale."""
    if max_age_ms == 0:
        return df
    return df.where((F.col("ts_ms") <= 0) | (F.col("ts_ms") >= now_ms - max_age_ms))


def displayable(tracks: DataFrame, at_pts_ms: int, confirm_hits: int = 2, hold_ms: int = 100) -> DataFrame:
    """Tracks that may be drawn at a media time."""
    return tracks.where(
        (F.col("state") == "active") & (F.col("hits") >= confirm_hits) & (at_pts_ms - F.col("last_pts_ms") <= hold_ms)
    )


def remap_class(df: DataFrame, mapping: dict[str, tuple[int, str]], drop_unmapped: bool = True) -> DataFrame:
    """Class id and name by source label; unmapped rows go or keep what they have."""
    key = F.trim(F.col("label"))
    ids = F.create_map(*[F.lit(x) for k, (i, _) in mapping.items() for x in (k, i)])
    names = F.create_map(*[F.lit(x) for k, (_, n) in mapping.items() for x in (k, n)])
    if drop_unmapped:
        df = df.where(key.isin(list(mapping)))
    return df.withColumns(
        {"class_id": F.coalesce(ids[key], F.col("class_id")), "label": F.coalesce(names[key], F.col("label"))}
    )


def valid_motion(df: DataFrame) -> DataFrame:
    """Samples with a plausible time step and at least one steady track."""
    return df.where(F.col("dt_ms").between(10, 250) & (F.col("stable_tracks") > 0))


def motion_speed() -> Column:
    return F.col("raw_step_ratio") * 1000.0 / F.col("dt_ms")


def band_motion(df: DataFrame, low: float = 0.35, high: float = 0.75) -> DataFrame:
    """Band by speed in box diagonals per second; the gap between belongs to neither."""
    speed = motion_speed()
    return df.withColumn("band", F.when(speed <= low, "stationary").when(speed >= high, "moving").otherwise("between"))


def normalise_pts(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Shift media time so that a connection starts at 0 with its first known time."""
    origin = (
        frames.where(F.col("source_pts_ms").isNotNull())
        .groupBy(*keys)
        .agg(F.min_by("source_pts_ms", "frame_id").alias("__origin"))
    )
    joined = frames.join(origin, keys, "left")
    return joined.withColumn("pts_ms", F.col("source_pts_ms") - F.col("__origin")).drop("__origin")


def photo_attrs(df: DataFrame) -> DataFrame:
    """Shape group and the capture time written in the file name."""
    aspect = (
        F.when(F.col("width") > F.col("height"), "landscape_16x9")
        .when(F.col("height") > F.col("width"), "portrait_9x16")
        .otherwise("other")
    )
    return df.withColumns({"aspect_group": aspect, "capture_time": S.capture_time(F.col("image_name"))})


def session_or_folder(df: DataFrame) -> Column:
    """Session of a row; where it has none, the folder that holds its picture."""
    session = F.trim(F.coalesce(F.col("session"), F.lit("")))
    path = next((c for c in ("image_path", "path") if c in df.columns), None)
    folder = F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit("")) if path else F.lit("")
    return F.when(session != "", F.col("session")).otherwise(folder)


def select_reviewed(df: DataFrame, exclude_sessions: list[str] | None = None) -> DataFrame:
    """Rows marked keep, less the excluded sessions; a row without a session goes by its picture's folder."""
    choice = F.lower(F.trim(F.coalesce(F.col("review_choice"), F.lit("")))) == "keep"
    out = df.where(S.is_keep(F.col("keep")) | choice)
    return out.where(~session_or_folder(df).isin(exclude_sessions)) if exclude_sessions else out


def check_labels(df: DataFrame, n_classes: int = 6, strict_center: bool = True) -> DataFrame:
    """Parse label lines (``line``) and name the first broken rule in ``reason``; null if valid."""
    parts = F.split(F.trim(F.col("line")), r"\s+")
    parsed = staged(
        staged(df, {"__f": parts}),
        {
            "n_fields": F.size("__f"),
            "class_id": F.get("__f", F.lit(0)).try_cast("int"),
            "cx": F.get("__f", F.lit(1)).try_cast("double"),
            "cy": F.get("__f", F.lit(2)).try_cast("double"),
            "w": F.get("__f", F.lit(3)).try_cast("double"),
            "h": F.get("__f", F.lit(4)).try_cast("double"),
        },
    )
    numbers = F.col("class_id").isNull()
    for c in ("cx", "cy", "w", "h"):
        numbers = numbers | F.col(c).isNull()
    reason = (
        F.when(F.col("n_fields") != 5, "fields")
        .when(numbers, "number")
        .when(~F.col("class_id").between(0, n_classes - 1), "class")
    )
    if strict_center:
        reason = reason.when(~(F.col("cx").between(0, 1) & F.col("cy").between(0, 1)), "center")
    size_ok = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("w") <= 1) & (F.col("h") <= 1)
    return parsed.withColumn("reason", reason.when(~size_ok, "size")).drop("__f", "n_fields")


def validate_labels(df: DataFrame, n_classes: int = 6) -> tuple[DataFrame, DataFrame]:
    """Valid label rows, and rejects with a reason. Blank lines are neither."""
    lines = staged(df, {"line": F.col("line")}).select(*df.columns)
    checked = check_labels(lines.where(F.trim("line") != ""), n_classes)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def rank_by_score(df: DataFrame, by: list[str], order: str = "det_ord") -> DataFrame:
    """Rank within ``by``, best score first; ties by ``order``."""
    window = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(order))
    return df.withColumn("rank", F.row_number().over(window))


def tile_of() -> G.Box:
    x, y = F.col("tile_x"), F.col("tile_y")
    return G.Box(x, y, x + F.col("tile_w"), y + F.col("tile_h"))


def reliability_key(origin: Column, clearance: Column, score: Column) -> list[Column]:
    """Ascending sort keys: rechecked boxes first, then clear of tile edges, then score.

    Clearance is compared in whole pixels, which makes the order total.
    """
    joint = origin == "joint"
    return [F.when(joint, 0).otherwise(1), -F.when(joint, F.lit(0.0)).otherwise(F.floor(clearance)), -score]


def rank_by_reliability(df: DataFrame, by: list[str]) -> DataFrame:
    keys = reliability_key(F.col("origin"), G.edge_clearance(G.box(), tile_of()), F.col("score"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys, "det_ord")))


def limit_sorted(df: DataFrame, n: int, by: str) -> DataFrame:
    """The first ``n`` rows in name order."""
    return df.orderBy(by).limit(n)
