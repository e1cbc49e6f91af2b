"""Queries for filters, projections, decoding and box joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxweave.functions import geometry as G
from boxweave.functions import scalars as S
from boxweave.operators import decode as D
from boxweave.operators import filters as P
from boxweave.operators import joins as J
from boxweave.plans import sql as Q
from boxweave.plans.registry import query, r6
from boxweave.plans.views import LABELS, view
from boxweave.plans.views import with_views as W

FRAME_W, FRAME_H = 640.0, 480.0
BOX = ["x1", "y1", "x2", "y2"]
BOX_SQL = ", ".join(BOX)

# ---------------------------------------------------------------- sources


@query("read_detections", W(f"SELECT channel_id, frame_id, pts_ms, ts_ms, det_ord, class_id, label, score, {BOX_SQL} FROM detections", "detections"))
def _(spark, sf):
    return view(spark, sf, "detections")


@query("read_head_cells", W("SELECT frame_id, branch, grid_row, grid_col, sum_code, list_sum(box)::BIGINT AS box_total, len(scores)::BIGINT AS n_scores FROM head_cells", "head_cells"))
def _(spark, sf):
    cells = view(spark, sf, "head_cells")
    total = F.aggregate("box", F.lit(0).cast("long"), lambda a, v: a + v)
    return cells.select("frame_id", "branch", "grid_row", "grid_col", "sum_code", total.alias("box_total"), F.size("scores").cast("long").alias("n_scores"))


# ---------------------------------------------------------------- filters


@query("filter_confidence", W("SELECT frame_id, det_ord, score FROM detections WHERE score >= 0.5", "detections"))
def _(spark, sf):
    return P.filter_confidence(view(spark, sf, "detections"), 0.5).select("frame_id", "det_ord", "score")


@query("filter_confidence_strict", W("SELECT frame_id, det_ord, score FROM detections WHERE score > 0.5", "detections"))
def _(spark, sf):
    return P.filter_confidence(view(spark, sf, "detections"), 0.5, strict=True).select("frame_id", "det_ord", "score")


@query("filter_classes", W("SELECT frame_id, det_ord, label FROM detections WHERE label IN ('cup', 'book')", "detections"))
def _(spark, sf):
    return P.filter_classes(view(spark, sf, "detections"), ["cup", "book"]).select("frame_id", "det_ord", "label")


ROI_PIXELS = f"""roi AS (
  SELECT region_id, region_ord, {Q.clamp('x', '0', '1')} * 640 AS rx1, {Q.clamp('y', '0', '1')} * 480 AS ry1,
         {Q.clamp('x + w', '0', '1')} * 640 AS rx2, {Q.clamp('y + h', '0', '1')} * 480 AS ry2
  FROM regions
  WHERE {Q.clamp('x + w', '0', '1')} > {Q.clamp('x', '0', '1')} AND {Q.clamp('y + h', '0', '1')} > {Q.clamp('y', '0', '1')})"""
ROI_HIT = f"""hit AS (
  SELECT d.frame_id, d.det_ord, min(r.region_ord) AS region_ord
  FROM detections d JOIN roi r ON {Q.cx('d.')} BETWEEN r.rx1 AND r.rx2 AND {Q.cy('d.')} BETWEEN r.ry1 AND r.ry2
  GROUP BY 1, 2)"""


@query("roi_to_pixels", W(f"+{ROI_PIXELS} SELECT region_id, region_ord, {Q.r6('rx1', 'rx1')}, {Q.r6('ry1', 'ry1')}, {Q.r6('rx2', 'rx2')}, {Q.r6('ry2', 'ry2')} FROM roi", "regions"))
def _(spark, sf):
    px = P.roi_to_pixels(view(spark, sf, "regions"), FRAME_W, FRAME_H)
    return px.select("region_id", "region_ord", *[r6(c) for c in ("rx1", "ry1", "rx2", "ry2")])


@query("roi_filter", W(f"+{ROI_PIXELS}, {ROI_HIT} SELECT h.frame_id, h.det_ord, r.region_id FROM hit h JOIN roi r USING (region_ord)", "detections", "regions"))
def _(spark, sf):
    out = P.roi_assign(view(spark, sf, "detections"), view(spark, sf, "regions"), FRAME_W, FRAME_H)
    return out.select("frame_id", "det_ord", "region_id")


@query("roi_assign", W(f"+{ROI_PIXELS}, {ROI_HIT} SELECT d.frame_id, d.det_ord, coalesce(r.region_id, 'none') AS region_id FROM detections d LEFT JOIN hit h USING (frame_id, det_ord) LEFT JOIN roi r USING (region_ord)", "detections", "regions"))
def _(spark, sf):
    # The grid, meant for many regions.
    out = P.roi_assign(view(spark, sf, "detections"), view(spark, sf, "regions"), FRAME_W, FRAME_H, filter_outside=False, max_literal=0)
    return out.select("frame_id", "det_ord", F.coalesce("region_id", F.lit("none")).alias("region_id"))


@query("clip_boxes", W(f"""+c AS (SELECT frame_id, det_ord, {', '.join(f"{Q.clamp(c + ' - 100', '0.0', '320.0' if c[0] == 'x' else '240.0')} AS {c}" for c in BOX)} FROM detections)
  SELECT frame_id, det_ord, {BOX_SQL} FROM c WHERE x2 - x1 >= 2 AND y2 - y1 >= 2""", "detections"))
def _(spark, sf):
    moved = view(spark, sf, "detections").withColumns({c: F.col(c) - 100.0 for c in BOX})
    return P.clip_boxes(moved, 320.0, 240.0).select("frame_id", "det_ord", *BOX)


@query("to_norm", W(f"SELECT frame_id, det_ord, {Q.r6('(x1 + x2) * 0.5 / 640', 'cx')}, {Q.r6('(y1 + y2) * 0.5 / 480', 'cy')}, {Q.r6('(x2 - x1) / 640', 'w')}, {Q.r6('(y2 - y1) / 480', 'h')} FROM detections", "detections"))
def _(spark, sf):
    out = P.to_norm(view(spark, sf, "detections"), FRAME_W, FRAME_H)
    return out.select("frame_id", "det_ord", *[r6(c) for c in ("cx", "cy", "w", "h")])


@query("to_xyxy_center", W(f"SELECT frame_id, anchor, {Q.r6('cx - w / 2', 'x1')}, {Q.r6('cy - h / 2', 'y1')}, {Q.r6('cx + w / 2', 'x2')}, {Q.r6('cy + h / 2', 'y2')} FROM decoded_cells", "decoded_cells"))
def _(spark, sf):
    out = P.to_xyxy(view(spark, sf, "decoded_cells"), "center")
    return out.select("frame_id", "anchor", *[r6(c) for c in BOX])


@query("to_xyxy_xywh", W("SELECT frame_id, det_ord, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM (SELECT frame_id, det_ord, x1, y1, x2 / 2 AS w, y2 / 2 AS h FROM detections)", "detections"))
def _(spark, sf):
    b = G.box()
    boxes = view(spark, sf, "detections").select("frame_id", "det_ord", b.x1.alias("x"), b.y1.alias("y"), (b.x2 / 2).alias("w"), (b.y2 / 2).alias("h"))
    return P.to_xyxy(boxes, "xywh").select("frame_id", "det_ord", *BOX)


@query("untile", W(f"SELECT frame_id, det_ord, x1 + tile_x AS x1, y1 + tile_y AS y1, x2 + tile_x AS x2, y2 + tile_y AS y2 FROM tiled", "tiled"))
def _(spark, sf):
    return P.untile(view(spark, sf, "tiled")).select("frame_id", "det_ord", *BOX)


TILE_SQL = f"""+{ROI_PIXELS.replace('640', '3840').replace('480', '2160')},
  a AS (SELECT region_id, greatest(0, floor(rx1)::INT) AS x0, greatest(0, floor(ry1)::INT) AS y0,
               least(3840, ceil(rx2)::INT) AS x2, least(2160, ceil(ry2)::INT) AS y2 FROM roi),
  b AS (SELECT *, greatest(2, x2 - x0) AS rw, greatest(2, y2 - y0) AS rh FROM a),
  s AS (SELECT *, greatest(384, least(512, round(rw * 0.1)::INT)) AS o FROM b),
  t AS (SELECT s.*, r, c FROM s, range(2) rr(r), range(2) cc(c)),
  u AS (SELECT region_id, r, c,
     greatest(x0, x0 + (rw * c) // 2 - CASE WHEN c > 0 THEN o // 2 ELSE 0 END) AS sx,
     greatest(y0, y0 + (rh * r) // 2 - CASE WHEN r > 0 THEN o // 2 ELSE 0 END) AS sy,
     least(x2, x0 + (rw * (c + 1)) // 2 + CASE WHEN c = 0 THEN o - o // 2 ELSE 0 END) AS ex,
     least(y2, y0 + (rh * (r + 1)) // 2 + CASE WHEN r = 0 THEN o - o // 2 ELSE 0 END) AS ey FROM t)
  SELECT region_id, r::INT AS tile_row, c::INT AS tile_col, (sx - sx % 2)::INT AS tile_x, (sy - sy % 2)::INT AS tile_y,
         ((ex - sx) - (ex - sx) % 2)::INT AS tile_w, ((ey - sy) - (ey - sy) % 2)::INT AS tile_h FROM u"""


@query("make_tiles", W(TILE_SQL, "regions"))
def _(spark, sf):
    px = P.roi_to_pixels(view(spark, sf, "regions"), 3840, 2160)
    tiles = P.make_tiles(px, 3840, 2160, cols=2, rows=2)
    return tiles.select("region_id", "tile_row", "tile_col", "tile_x", "tile_y", "tile_w", "tile_h")


CHANNELS_SQL = "c AS (SELECT channel_id, CASE WHEN channel_id = 'ch3' THEN 1280 ELSE 640 END AS ww, CASE WHEN channel_id = 'ch3' THEN 720 ELSE 480 END AS hh FROM frames GROUP BY channel_id)"


def _channels(frames):
    third = F.col("channel_id") == "ch3"
    return frames.select("channel_id").distinct().select(
        "channel_id", F.when(third, 1280).otherwise(640).alias("width"), F.when(third, 720).otherwise(480).alias("height")
    )


@query("filter_frame_shape", W(f"+{CHANNELS_SQL} SELECT f.channel_id, f.frame_id, f.width, f.height FROM frames f JOIN c USING (channel_id) WHERE width = ww AND height = hh AND width % 2 = 0 AND height % 2 = 0", "frames"))
def _(spark, sf):
    frames = view(spark, sf, "frames")
    return P.filter_frame_shape(frames, _channels(frames)).select("channel_id", "frame_id", "width", "height")


@query("frame_shape_drops", W(f"+{CHANNELS_SQL} SELECT channel_id, count(*) AS frames, count(*) FILTER (NOT (width = ww AND height = hh AND width % 2 = 0 AND height % 2 = 0)) AS dropped FROM frames JOIN c USING (channel_id) GROUP BY channel_id", "frames"))
def _(spark, sf):
    frames = view(spark, sf, "frames")
    return P.frame_shape_drops(frames, _channels(frames))


PACE_SQL = "+n AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY frame_id) AS k FROM frames) SELECT channel_id, frame_id FROM n WHERE "


@query("pace_frames_source", W(PACE_SQL + "k % 3 = 0", "frames"))
def _(spark, sf):
    step = P.pacing_step(30.0, 10.0)
    return P.pace_frames(view(spark, sf, "frames"), step, block=1000).select("channel_id", "frame_id")


@query("pace_frames_inference", W(PACE_SQL + "(k - 1) % 4 = 0", "frames"))
def _(spark, sf):
    return P.pace_frames(view(spark, sf, "frames"), 4, "inference", block=1000).select("channel_id", "frame_id")


@query("drop_stale", W("SELECT channel_id, frame_id, ts_ms FROM frames WHERE ts_ms <= 0 OR ts_ms >= 1700000250000 - 100000", "frames"))
def _(spark, sf):
    return P.drop_stale(view(spark, sf, "frames"), 1700000250000, 100000).select("channel_id", "frame_id", "ts_ms")


@query("displayable", W("SELECT channel_id, track_id, hits, last_pts_ms FROM track_table WHERE state = 'active' AND hits >= 2 AND 100000 - last_pts_ms <= 100", "track_table"))
def _(spark, sf):
    return P.displayable(view(spark, sf, "track_table"), 100000).select("channel_id", "track_id", "hits", "last_pts_ms")


# Source label to class id and label of the six-class set.
REMAP = {"cell phone": (0, "cell phone"), "cup": (1, "cup"), "keyboard": (2, "keyboard"), "mouse": (3, "mouse"), "tvmonitor": (4, "laptop"), "book": (5, "book")}


@query("remap_class", W("""+s AS (SELECT *, CASE WHEN label = 'laptop' THEN 'tvmonitor' WHEN label = 'mouse' THEN 'toothbrush ' ELSE label || ' ' END AS raw FROM detections)
  SELECT frame_id, det_ord, CASE WHEN raw = 'tvmonitor' THEN 4 ELSE class_id END AS class_id, CASE WHEN raw = 'tvmonitor' THEN 'laptop' ELSE trim(raw) END AS label FROM s WHERE trim(raw) <> 'toothbrush'""", "detections"))
def _(spark, sf):
    d = view(spark, sf, "detections")
    raw = F.when(F.col("label") == "laptop", "tvmonitor").when(F.col("label") == "mouse", "toothbrush ").otherwise(F.concat("label", F.lit(" ")))
    return P.remap_class(d.withColumn("label", raw), REMAP).select("frame_id", "det_ord", "class_id", "label")


# Names drawn next to a box.
DISPLAY_NAMES = {"cell phone": "手机", "cup": "杯子", "keyboard": "键盘", "mouse": "鼠标", "laptop": "笔记本", "book": "书"}


@query("display_text", W("SELECT frame_id, det_ord, CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY_NAMES.items()) + " ELSE label END || ' ' || CAST(least(100, greatest(0, CAST(trunc(score * 1.25 * 100) AS INT))) AS VARCHAR) || '%' AS txt FROM detections", "detections"))
def _(spark, sf):
    d = P.remap_class(view(spark, sf, "detections"), {k: (i, v) for i, (k, v) in enumerate(DISPLAY_NAMES.items())}, drop_unmapped=False)
    return d.select("frame_id", "det_ord", S.display_text(F.col("label"), F.col("score") * 1.25).alias("txt"))


@query("valid_motion", W("SELECT run_id, frame_id, dt_ms FROM motion_stats WHERE dt_ms BETWEEN 10 AND 250 AND stable_tracks > 0", "motion_stats"))
def _(spark, sf):
    return P.valid_motion(view(spark, sf, "motion_stats")).select("run_id", "frame_id", "dt_ms")


@query("band_motion", W("SELECT run_id, frame_id, CASE WHEN v <= 0.35 THEN 'stationary' WHEN v >= 0.75 THEN 'moving' ELSE 'between' END AS band FROM (SELECT *, raw_step_ratio * 1000.0 / dt_ms AS v FROM motion_stats WHERE dt_ms BETWEEN 10 AND 250 AND stable_tracks > 0)", "motion_stats"))
def _(spark, sf):
    return P.band_motion(P.valid_motion(view(spark, sf, "motion_stats"))).select("run_id", "frame_id", "band")


@query("normalise_pts", W("""+o AS (SELECT channel_id, connection, arg_min(source_pts_ms, frame_id) AS origin FROM source_frames WHERE source_pts_ms IS NOT NULL GROUP BY 1, 2)
  SELECT channel_id, frame_id, coalesce(source_pts_ms - origin, -1) AS pts_ms FROM source_frames LEFT JOIN o USING (channel_id, connection)""", "source_frames"))
def _(spark, sf):
    out = P.normalise_pts(view(spark, sf, "source_frames"), ["channel_id", "connection"])
    return out.select("channel_id", "frame_id", F.coalesce("pts_ms", F.lit(-1)).alias("pts_ms"))


@query("photo_attrs", W("""SELECT doc_id, CASE WHEN width > height THEN 'landscape_16x9' WHEN height > width THEN 'portrait_9x16' ELSE 'other' END AS aspect_group,
    CASE WHEN doc_id % 2 = 0 THEN CAST(make_timestamp(2024, 1 + (doc_id % 12)::INT, 1 + (doc_id % 28)::INT, 10, (doc_id % 60)::INT, 30) AS VARCHAR) ELSE '' END AS taken FROM images""", "images"))
def _(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    doc = F.col("doc_id")
    name = F.when(doc % 2 == 0, F.concat(F.lit("IMG_2024"), two(1 + doc % 12), two(1 + doc % 28), F.lit("_10"), two(doc % 60), F.lit("30.jpg"))).otherwise(F.lit("IMG_20x.jpg"))
    out = P.photo_attrs(view(spark, sf, "images").withColumn("image_name", name))
    return out.select("doc_id", "aspect_group", F.coalesce(F.date_format("capture_time", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("taken"))


@query("select_reviewed", W("""+k AS (SELECT image_name, CASE WHEN doc_id % 6 = 2 THEN NULL WHEN doc_id % 7 = 3 THEN '' ELSE session END AS session, split_part(path, '/', 3) AS folder FROM images
   WHERE lower(trim(keep)) IN ('1', 'y', 'yes', 'true', 'keep', '保留') OR lower(trim(review_choice)) = 'keep')
  SELECT image_name, coalesce(session, 'none') AS session FROM k WHERE CASE WHEN coalesce(session, '') = '' THEN folder ELSE session END NOT IN ('src3', 'src7', 'fr')""", "images"))
def _(spark, sf):
    images = view(spark, sf, "images").withColumn("session", F.expr("CASE WHEN doc_id % 6 = 2 THEN NULL WHEN doc_id % 7 = 3 THEN '' ELSE session END"))
    return P.select_reviewed(images, ["src3", "src7", "fr"]).select("image_name", F.coalesce("session", F.lit("none")).alias("session"))


CHECK_SQL = """+p AS (SELECT image_stem, line_no, string_split(line, ' ') AS f FROM label_lines),
  n AS (SELECT image_stem, line_no, len(f) AS k, TRY_CAST(f[1] AS INT) AS class_id, TRY_CAST(f[2] AS DOUBLE) AS cx, TRY_CAST(f[3] AS DOUBLE) AS cy, TRY_CAST(f[4] AS DOUBLE) AS w, TRY_CAST(f[5] AS DOUBLE) AS h FROM p),
  r AS (SELECT *, CASE WHEN k <> 5 THEN 'fields' WHEN class_id IS NULL THEN 'number' WHEN class_id NOT BETWEEN 0 AND 5 THEN 'class'
        WHEN NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1) THEN 'center' WHEN NOT (w > 0 AND h > 0 AND w <= 1 AND h <= 1) THEN 'size' END AS reason FROM n)"""


@query("validate_labels_valid", W(CHECK_SQL + " SELECT image_stem, line_no, class_id, cx, cy, w, h FROM r WHERE reason IS NULL", "label_lines"))
def _(spark, sf):
    valid, _ = P.validate_labels(view(spark, sf, "label_lines"))
    return valid.select("image_stem", "line_no", "class_id", "cx", "cy", "w", "h")


@query("validate_labels_rejects", W(CHECK_SQL + " SELECT image_stem, line_no, reason FROM r WHERE reason IS NOT NULL", "label_lines"))
def _(spark, sf):
    _, rejects = P.validate_labels(view(spark, sf, "label_lines"))
    return rejects.select("image_stem", "line_no", "reason")


@query("rank_by_score", W("SELECT frame_id, det_ord, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_ord)::INT AS rank FROM detections", "detections"))
def _(spark, sf):
    return P.rank_by_score(view(spark, sf, "detections"), ["frame_id"]).select("frame_id", "det_ord", "rank")


CLEARANCE = "greatest(0.0, least(x1 - tile_x, y1 - tile_y, tile_x + tile_w - x2, tile_y + tile_h - y2))"
FRAME_TILED = """f AS (SELECT * REPLACE (x1 + tile_x AS x1, x2 + tile_x AS x2, y1 + tile_y AS y1, y2 + tile_y AS y2) FROM tiled)"""


@query("rank_by_reliability", W(f"""+{FRAME_TILED} SELECT frame_id, det_ord, row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN origin = 'joint' THEN 0 ELSE 1 END,
   CASE WHEN origin = 'joint' THEN 0.0 ELSE -floor({CLEARANCE}) END, -score, det_ord)::INT AS rank FROM f""", "tiled"))
def _(spark, sf):
    return P.rank_by_reliability(P.untile(view(spark, sf, "tiled")), ["frame_id"]).select("frame_id", "det_ord", "rank")


@query("limit_sorted", W("SELECT image_name FROM images ORDER BY image_name LIMIT 50", "images"))
def _(spark, sf):
    return P.limit_sorted(view(spark, sf, "images").select("image_name"), 50, "image_name")


# ---------------------------------------------------------------- decoding

CENTER_SQL = f"""+b AS (SELECT *, list_max(scores) AS score, list_position(scores, list_max(scores))::INT - 1 AS class_id FROM decoded_cells)
  SELECT frame_id, anchor, class_id, {Q.r6('score', 'score')}, {Q.r6('(cx - w * 0.5) * 1280 / 640', 'x1')}, {Q.r6('(cy - h * 0.5) * 720 / 640', 'y1')},
         {Q.r6('(cx + w * 0.5) * 1280 / 640', 'x2')}, {Q.r6('(cy + h * 0.5) * 720 / 640', 'y2')} FROM b WHERE score >= 0.15"""


@query("decode_center", W(CENTER_SQL, "decoded_cells"))
def _(spark, sf):
    out = D.decode_center(view(spark, sf, "decoded_cells"), LABELS, 640, 1280, 720, 0.15)
    return out.select("frame_id", "anchor", "class_id", *[r6(c) for c in ("score", *BOX)])


@query("decode_layout_decoded", W(CENTER_SQL + " AND class_id IN (1, 5)", "decoded_cells"))
def _(spark, sf):
    out = D.decode(view(spark, sf, "decoded_cells"), "decoded", labels=LABELS, model_size=640, width=1280, height=720, threshold=0.15, keep_labels=["cup", "book"])
    return out.select("frame_id", "anchor", "class_id", *[r6(c) for c in ("score", *BOX)])


HEADS_SQL = """heads AS (SELECT * FROM (VALUES (0, 8, 16, 0.05, -3, 0.004, -5, 0.004), (1, 16, 16, 0.06, 2, 0.005, 0, 0.005), (2, 32, 16, 0.07, 0, 0.006, 4, 0.006))
  h(branch, stride, dfl_len, box_scale, score_zp, score_scale, sum_zp, sum_scale))"""
CUT = lambda zp, sc: f"trunc({Q.clamp(f'0.05 / CAST({sc} AS DOUBLE) + {zp}', '-128.0', '127.0')})::INT"
BEST_SQL = f"""{HEADS_SQL}, best AS (
  SELECT c.*, h.*, list_max(c.scores) AS code, list_position(c.scores, list_max(c.scores))::INT - 1 AS class_id
  FROM head_cells c JOIN heads h ON c.branch = h.branch
  WHERE c.sum_code >= {CUT('sum_zp', 'sum_scale')} AND list_max(c.scores) > {CUT('score_zp', 'score_scale')})"""
SCORE_SQL = Q.r6("(code - score_zp) * CAST(score_scale AS DOUBLE)", "score")


def _heads(spark):
    rows = [(0, 8, 16, 0.05, -3, 0.004, -5, 0.004), (1, 16, 16, 0.06, 2, 0.005, 0, 0.005), (2, 32, 16, 0.07, 0, 0.006, 4, 0.006)]
    return spark.createDataFrame(rows, "branch int, stride int, dfl_len int, box_scale double, score_zp int, score_scale double, sum_zp int, sum_scale double")


@query("best_class", W(f"+{BEST_SQL} SELECT frame_id, branch, class_id, {SCORE_SQL} FROM best", "head_cells"))
def _(spark, sf):
    out = D.best_class(view(spark, sf, "head_cells"), _heads(spark), 0.05)
    return out.select("frame_id", "branch", "class_id", r6("score"))


def _side(i: int) -> str:
    bins = f"list_slice(box, {i * 16 + 1}, {i * 16 + 16})"
    weights = f"list_transform({bins}, lambda v: exp((v - list_max({bins})) * CAST(box_scale AS DOUBLE)))"
    return f"list_sum(list_transform({weights}, lambda v, j: v * (j - 1))) / list_sum({weights})"


DFL_SQL = f"""+{BEST_SQL}, dist AS (SELECT *, {', '.join(f'{_side(i)} AS d{i}' for i in range(4))} FROM best)
  SELECT frame_id, class_id, {SCORE_SQL},
    {Q.r6(Q.clamp('((grid_col + 0.5 - d0) * stride - 0) / 0.5', '0', '1280'), 'x1')}, {Q.r6(Q.clamp('((grid_row + 0.5 - d1) * stride - 140) / 0.5', '0', '720'), 'y1')},
    {Q.r6(Q.clamp('((grid_col + 0.5 + d2) * stride - 0) / 0.5', '0', '1280'), 'x2')}, {Q.r6(Q.clamp('((grid_row + 0.5 + d3) * stride - 140) / 0.5', '0', '720'), 'y2')} FROM dist"""


@query("decode_dfl", W(DFL_SQL, "head_cells"))
def _(spark, sf):
    heads = _heads(spark)
    picked = D.best_class(view(spark, sf, "head_cells"), heads, 0.05)
    out = D.decode_dfl(picked, heads, 640, 640, 1280, 720)
    return out.select("frame_id", "class_id", *[r6(c) for c in ("score", *BOX)])


@query("decode_layout_dfl", W(DFL_SQL + " WHERE class_id IN (0, 2, 4)", "head_cells"))
def _(spark, sf):
    out = D.decode(view(spark, sf, "head_cells"), "dfl", heads=_heads(spark), labels=LABELS, threshold=0.05,
                   keep_labels=["cell phone", "keyboard", "laptop"], model_width=640, model_height=640, width=1280, height=720)
    return out.select("frame_id", "class_id", *[r6(c) for c in ("score", *BOX)])


@query("quantise", W("""+q AS (SELECT frame_id, det_ord, trunc(least(greatest(score / 0.007 - 20, -128.0), 127.0))::INT AS code FROM detections)
  SELECT frame_id, det_ord, code, ROUND((code + 20) * CAST(0.007 AS DOUBLE), 6) AS back FROM q""", "detections"))
def _(spark, sf):
    d = view(spark, sf, "detections").withColumn("code", S.quant(F.col("score"), F.lit(-20), F.lit(0.007)))
    return d.select("frame_id", "det_ord", "code", r6(S.dequant(F.col("code"), F.lit(-20), F.lit(0.007)), "back"))


def _letter(even: bool) -> str:
    fix = (lambda s: f"greatest(2, ({s}) - ({s}) % 2)") if even else (lambda s: s)
    scale = "least(640.0 / CAST(width AS DOUBLE), 640.0 / CAST(height AS DOUBLE))"
    iw, ih = fix(f"floor(width * {scale} + 0.5)::INT"), fix(f"floor(height * {scale} + 0.5)::INT")
    return f"""SELECT frame_id, {Q.r6(scale, 'scale')}, {iw} AS inner_w, {ih} AS inner_h, (640 - {iw}) // 2 AS pad_x, (640 - {ih}) // 2 AS pad_y FROM frames"""


@query("letterbox_even", W(_letter(True), "frames"))
def _(spark, sf):
    return D.letterbox(view(spark, sf, "frames"), 640, 640).select("frame_id", r6("scale"), "inner_w", "inner_h", "pad_x", "pad_y")


@query("letterbox_plain", W(_letter(False), "frames"))
def _(spark, sf):
    return D.letterbox(view(spark, sf, "frames"), 640, 640, even=False).select("frame_id", r6("scale"), "inner_w", "inner_h", "pad_x", "pad_y")


@query("unletterbox", W(f"""SELECT frame_id, det_ord, {Q.r6(Q.clamp('x1 / 0.5', '0.0', '1280.0'), 'x1')}, {Q.r6(Q.clamp('(y1 - 140) / 0.5', '0.0', '720.0'), 'y1')},
   {Q.r6(Q.clamp('x2 / 0.5', '0.0', '1280.0'), 'x2')}, {Q.r6(Q.clamp('(y2 - 140) / 0.5', '0.0', '720.0'), 'y2')} FROM detections""", "detections"))
def _(spark, sf):
    d = view(spark, sf, "detections").withColumns({"width": F.lit(1280), "height": F.lit(720)})
    return D.unletterbox(d, 640, 640).select("frame_id", "det_ord", *[r6(c) for c in BOX])


# ---------------------------------------------------------------- geometry

NEXT_SQL = """nx AS (SELECT a.frame_id, a.det_ord AS a_ord, b.det_ord AS b_ord, {cols} FROM detections a JOIN detections b ON a.channel_id = b.channel_id AND b.frame_id = a.frame_id + 4)"""


@query("box_geometry", W(f"""SELECT a.frame_id, a.det_ord AS a_ord, b.det_ord AS b_ord, {Q.area('a.')} AS area_a, {Q.inter('a.', 'b.')} AS shared,
    {Q.r6(Q.iou('a.', 'b.'), 'iou_detector')}, {Q.r6(Q.iou('a.', 'b.', '1e-12'), 'iou_labels')}, {Q.r6(Q.iou('a.', 'b.', '1e-9'), 'iou_dataset')}, {Q.r6(Q.iou_tracker('a.', 'b.'), 'iou_tracker')},
    {Q.r6(Q.ios('a.', 'b.'), 'ios')}, {Q.center_inside('a.', 'b.')} AS center_in, {Q.r6(Q.hypot(f"{Q.cx('a.')} - {Q.cx('b.')}", f"{Q.cy('a.')} - {Q.cy('b.')}"), 'distance')}
  FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.det_ord < b.det_ord AND {Q.inter('a.', 'b.')} > 0""", "detections"))
def _(spark, sf):
    pairs = J.overlap_pairs(view(spark, sf, "detections"), ["channel_id", "frame_id"])
    a, b = G.box("a_"), G.box("b_")
    return pairs.select(
        "frame_id", F.col("a_det_ord").alias("a_ord"), F.col("b_det_ord").alias("b_ord"), G.area(a).alias("area_a"), G.intersection(a, b).alias("shared"),
        *[r6(G.iou(a, b, d), f"iou_{d}") for d in ("detector", "labels", "dataset", "tracker")],
        r6(G.containment(a, b), "ios"), G.center_inside(a, b).alias("center_in"), r6(G.center_distance(a, b), "distance"),
    )


def _blend(new: str, old: str) -> str:
    return f"(0.25 * ({new}) + 0.75 * ({old}))"


def _pair_filters_sql() -> str:
    a, b = "a.", "b."
    far = Q.hypot(f"{Q.cx(a)} - {Q.cx(b)}", f"{Q.cy(a)} - {Q.cy(b)}")
    w, h = (f"greatest(1.0, a.{u}2 - a.{u}1)" for u in "xy")
    areas = [f"(greatest(1.0, {p}x2 - {p}x1) * greatest(1.0, {p}y2 - {p}y1))" for p in (a, b)]
    middle = {"x": _blend(Q.cx(b), Q.cx(a)), "y": _blend(Q.cy(b), Q.cy(a))}
    half = {u: f"{_blend(f'b.{u}2 - b.{u}1', f'a.{u}2 - a.{u}1')} * 0.5" for u in "xy"}
    back = {u: f"CASE WHEN {far} <= 20 THEN 0.0 ELSE ({c(a)} - {c(b)}) * (1 - 20 / {far}) END" for u, c in (("x", Q.cx), ("y", Q.cy))}
    parts = [
        f"CASE WHEN a.class_id = b.class_id THEN {Q.ios(a, b)} >= 0.7 AND {Q.center_inside(a, b)} ELSE {Q.iou_tracker(a, b)} >= 0.85 OR ({Q.ios(a, b)} >= 0.5 AND {Q.center_inside(a, b)}) END AS duplicate",
        f"{far} < 60 AND abs(b.x2 - b.x1 - {w}) / {w} < 0.3 AND abs(b.y2 - b.y1 - {h}) / {h} < 0.3 AS resting",
        Q.r6(f"least({', '.join(areas)}) / greatest({', '.join(areas)})", "similar"),
        *[Q.r6(f"{middle[u]} {sign} {half[u]}", f"ema_{u}{n}") for u in "xy" for n, sign in ((1, "-"), (2, "+"))],
        *[Q.r6(f"b.{u}{n} + {back[u]}", f"held_{u}{n}") for u in "xy" for n in (1, 2)],
    ]
    return "SELECT a.frame_id, a.det_ord AS a_ord, b.det_ord AS b_ord, " + ", ".join(parts) + f" FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.det_ord < b.det_ord AND {Q.inter(a, b)} > 0"


@query("box_filter_steps", W(_pair_filters_sql(), "detections"))
def _(spark, sf):
    """The rules and single steps that trackers are made of, on all overlapping pairs."""
    pairs = J.overlap_pairs(view(spark, sf, "detections"), ["channel_id", "frame_id"])
    a, b = G.box("a_"), G.box("b_")
    ema, held = G.ema_box(a, b, 0.25), G.clamp_center_correction(a, b, 20.0)
    corners = [r6(getattr(box, f"{u}{n}"), f"{name}_{u}{n}") for name, box in (("ema", ema), ("held", held)) for u in "xy" for n in (1, 2)]
    return pairs.select(
        "frame_id", F.col("a_det_ord").alias("a_ord"), F.col("b_det_ord").alias("b_ord"), G.is_duplicate_box(a, b).alias("duplicate"),
        G.in_deadzone(a, b, 60.0, 0.3).alias("resting"), r6(G.size_similarity(a, b), "similar"), *corners,
    )


@query("number_helpers", W(f"""SELECT frame_id, det_ord, ROUND(t * t * (3 - 2 * t), 6) + 0.0 AS eased, {Q.r6('ln((x2 - x1) / (y2 - y1))', 'log_step')}, CAST(x2 AS BIGINT) + (16 - CAST(x2 AS BIGINT) % 16) % 16 AS aligned,
    CASE WHEN v < 0 THEN -1 ELSE 1 END * floor(abs(v) + 0.5) AS rounded, replace(label, ' ', '_') AS slug, ts_ms // 1000 AS epoch_s
  FROM (SELECT *, least(1.0, greatest(0.0, score * 2 - 0.4)) AS t, (x1 - y1) / 4 AS v FROM detections)""", "detections"))
def _(spark, sf):
    d = view(spark, sf, "detections")
    return d.select(
        "frame_id", "det_ord", r6(S.smoothstep(F.col("score") * 2 - 0.4), "eased"), r6(S.log_step(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), "log_step"),
        S.align_up(F.col("x2"), 16).alias("aligned"), S.round_half_away((F.col("x1") - F.col("y1")) / 4).alias("rounded"), S.class_slug(F.col("label")).alias("slug"), S.epoch_seconds(F.col("ts_ms")).alias("epoch_s"),
    )


def _rival(a, b):
    return f"({Q.iou_tracker(a, b)} >= 0.85 OR ({Q.ios(a, b)} >= 0.5 AND {Q.center_inside(a, b)}))"


def _w(p):
    return f"greatest(1.0, {p}x2 - {p}x1)"


def _h(p):
    return f"greatest(1.0, {p}y2 - {p}y1)"


SIM = f"(least({_w('a.')} * {_h('a.')}, {_w('b.')} * {_h('b.')}) / greatest({_w('a.')} * {_h('a.')}, {_w('b.')} * {_h('b.')}))"
DIST = Q.hypot(f"{Q.cx('a.')} - {Q.cx('b.')}", f"{Q.cy('a.')} - {Q.cy('b.')}")
REACH = "96.0"
NEAR = f"({DIST} <= greatest(48.0, least({REACH}, 1.25 * greatest({Q.hypot(_w('a.'), _h('a.'))}, {Q.hypot(_w('b.'), _h('b.'))}))) AND {SIM} >= 0.4)"
CAND_SQL = f"""+c AS (SELECT a.channel_id, a.frame_id, a.det_ord AS track_ord, b.det_ord AS det_ord, a.class_id = b.class_id AS same, {_rival('a.', 'b.')} AS rival,
   {Q.iou_tracker('a.', 'b.')} AS overlap, {DIST} AS distance, {SIM} AS sim, {Q.ios('a.', 'b.')} AS inside, {NEAR} AS near, {Q.center_inside('a.', 'b.')} AS centred, a.score >= 0.5 AS active
   FROM detections a JOIN detections b ON b.channel_id = a.channel_id AND b.frame_id = a.frame_id + 4)
  SELECT channel_id, frame_id, track_ord, det_ord, NOT same AS competitor, ROUND(1e-9 + overlap + sim * 0.1 + CASE WHEN same THEN inside * 0.1 ELSE 0.05 END - distance / {REACH} * 0.05 + CASE WHEN active THEN 0.05 ELSE 0.0 END, 6) + 0.0 AS match_score
  FROM c WHERE CASE WHEN same THEN overlap >= 0.2 OR near OR (inside >= 0.7 AND centred) ELSE rival END"""


@query("track_candidates", W(CAND_SQL, "detections"))
def _(spark, sf):
    d = view(spark, sf, "detections").select("channel_id", "frame_id", "det_ord", "class_id", "score", *BOX)
    previous = d.withColumn("active", F.col("score") >= 0.5).withColumn("frame_id", F.col("frame_id") + 4)
    out = J.track_candidates(previous, d, ["channel_id", "frame_id"], FRAME_W, FRAME_H)
    return out.select("channel_id", (F.col("frame_id") - 4).alias("frame_id"), F.col("t_det_ord").alias("track_ord"), F.col("d_det_ord").alias("det_ord"), "competitor", F.round(F.col("match_score") + 1e-9, 6).alias("match_score"))


AUDIT_PAIRS = f"""pr AS (SELECT a.channel_id, a.frame_id, a.det_ord AS a_ord, b.det_ord AS b_ord, {Q.inter('a.', 'b.')} AS shared, {Q.iou('a.', 'b.', '0')} AS iou, {Q.ios('a.', 'b.')} AS ios
  FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.det_ord < b.det_ord AND {Q.inter('a.', 'b.')} > 400)"""


@query("overlap_pairs", W(f"+{AUDIT_PAIRS} SELECT channel_id, frame_id, a_ord, b_ord, shared, ROUND(iou, 6) AS iou, ROUND(ios, 6) AS ios FROM pr", "detections"))
def _(spark, sf):
    out = J.overlap_pairs(view(spark, sf, "detections"), ["channel_id", "frame_id"], 400.0)
    return out.select("channel_id", "frame_id", F.col("a_det_ord").alias("a_ord"), F.col("b_det_ord").alias("b_ord"), F.col("intersection_area").alias("shared"), r6("iou"), r6("ios"))


SHOWN_SQL = """sn AS (SELECT channel_id, frame_id, pts_ms, n_boxes FROM snapshots),
  dsp AS (SELECT f.channel_id, f.frame_id, f.pts_ms, s.frame_id AS sf, s.pts_ms AS sp, s.n_boxes FROM frames f ASOF JOIN sn s ON f.channel_id = s.channel_id AND f.pts_ms >= s.pts_ms),
  fst AS (SELECT *, lag(sf) OVER w AS psf, lag(sp) OVER w AS psp FROM dsp WHERE n_boxes >= 2 WINDOW w AS (PARTITION BY channel_id ORDER BY pts_ms, frame_id)),
  shown AS (SELECT * FROM fst WHERE psf IS NULL OR psf <> sf OR psp <> sp)"""


def _display(spark, sf):
    return J.asof_snapshot(
        view(spark, sf, "frames").select("channel_id", "frame_id", "pts_ms"), view(spark, sf, "snapshots"), ["n_boxes"], block_ms=60_000
    ).where(F.col("snapshot_frame_id").isNotNull())


@query("overlap_audit", W(f"+{AUDIT_PAIRS}, {SHOWN_SQL} SELECT p.channel_id, s.frame_id AS video_frame, p.frame_id AS snapshot_frame, p.a_ord, p.b_ord, s.pts_ms - s.sp AS pts_delta_ms, ROUND(p.ios, 6) AS ios FROM pr p JOIN shown s ON p.channel_id = s.channel_id AND p.frame_id = s.sf", "detections", "frames", "snapshots"))
def _(spark, sf):
    boxes = view(spark, sf, "detections").drop("pts_ms", "ts_ms")
    out = J.overlap_audit(_display(spark, sf), boxes, 400.0)
    return out.select(
        "channel_id", F.col("frame_id").alias("video_frame"), F.col("snapshot_frame_id").alias("snapshot_frame"),
        F.col("a_det_ord").alias("a_ord"), F.col("b_det_ord").alias("b_ord"), "pts_delta_ms", r6("ios"),
    )


@query("overlap_summary", W(f"+{AUDIT_PAIRS} SELECT channel_id, count(*) AS pairs, count(DISTINCT frame_id) AS frames, ROUND(max(ios), 6) AS worst_ios, ROUND(max(iou), 6) AS worst_iou FROM pr GROUP BY channel_id", "detections"))
def _(spark, sf):
    from boxweave.operators.aggregates import overlap_summary

    return overlap_summary(J.overlap_pairs(view(spark, sf, "detections"), ["channel_id", "frame_id"], 400.0))


@query("asof_snapshot", W("""SELECT f.channel_id, f.frame_id, coalesce(s.frame_id, -1) AS snapshot_frame_id, coalesce(s.n_boxes, -1) AS n_boxes, coalesce(f.pts_ms - s.pts_ms, -1) AS pts_delta_ms
   FROM frames f ASOF LEFT JOIN snapshots s ON f.channel_id = s.channel_id AND f.pts_ms >= s.pts_ms""", "frames", "snapshots"))
def _(spark, sf):
    video = view(spark, sf, "frames").select("channel_id", "frame_id", "pts_ms")
    out = J.asof_snapshot(video, view(spark, sf, "snapshots"), ["n_boxes"], block_ms=60_000)
    fill = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return out.select("channel_id", "frame_id", fill("snapshot_frame_id"), fill("n_boxes"), fill("pts_delta_ms"))


@query("labels_with_detections", W("""+m AS (SELECT f.channel_id, f.frame_id, s.frame_id AS sf FROM frames f ASOF JOIN snapshots s ON f.channel_id = s.channel_id AND f.pts_ms >= s.pts_ms)
   SELECT m.channel_id, m.frame_id, m.sf AS snapshot_frame_id, d.det_ord, d.label FROM m JOIN detections d ON d.channel_id = m.channel_id AND d.frame_id = m.sf""", "frames", "snapshots", "detections"))
def _(spark, sf):
    video = view(spark, sf, "frames").select("channel_id", "frame_id", "pts_ms")
    out = J.labels_with_detections(video, view(spark, sf, "snapshots"), view(spark, sf, "detections"))
    return out.select("channel_id", "frame_id", "snapshot_frame_id", "det_ord", "label")


COVERED = f"({Q.area('t.')} > 0 AND ({Q.inter('t.', 'j.')} / {Q.area('t.')} >= 0.5 OR {Q.inter('t.', 'j.')} / greatest(1.0, {Q.area('j.')}) >= 0.5 OR {Q.inter('t.', 'j.')} / greatest(1.0, least({Q.area('t.')}, {Q.area('j.')})) >= 0.35))"


@query("suppress_tile_duplicates", W(f"""+{FRAME_TILED} SELECT t.frame_id, t.det_ord FROM f t WHERE t.origin = 'tile' AND NOT EXISTS (
   SELECT 1 FROM f j WHERE j.origin = 'joint' AND j.frame_id = t.frame_id AND j.class_id = t.class_id AND {COVERED})""", "tiled"))
def _(spark, sf):
    boxes = P.untile(view(spark, sf, "tiled"))
    out = J.suppress_tile_duplicates(boxes.where("origin = 'tile'"), boxes.where("origin = 'joint'"), ["frame_id"])
    return out.select("frame_id", "det_ord")


TX, TY = "greatest(a.tile_x, b.tile_x)", "greatest(a.tile_y, b.tile_y)"
TX2, TY2 = "least(a.tile_x + a.tile_w, b.tile_x + b.tile_w)", "least(a.tile_y + a.tile_h, b.tile_y + b.tile_h)"


def _reaches(p):
    return f"(least({p}x2, {TX2}) > greatest({p}x1, {TX}) AND least({p}y2, {TY2}) > greatest({p}y1, {TY}))"


def _ratio(c):
    return f"(greatest(0.0, least(a.{c}2, b.{c}2) - greatest(a.{c}1, b.{c}1)) / least(a.{c}2 - a.{c}1, b.{c}2 - b.{c}1))"


def _gap(c):
    return f"greatest(0.0, greatest(a.{c}1, b.{c}1) - least(a.{c}2, b.{c}2))"


JOINT_SQL = f"""+{FRAME_TILED}, jp AS (SELECT a.frame_id, a.det_ord AS a_ord, b.det_ord AS b_ord,
    greatest(0, floor(least(a.x1, b.x1))::INT - 256) AS px1, greatest(0, floor(least(a.y1, b.y1))::INT - 160) AS py1,
    least(3840, ceil(greatest(a.x2, b.x2))::INT + 256) AS px2, least(2160, ceil(greatest(a.y2, b.y2))::INT + 160) AS py2
  FROM f a JOIN f b ON a.frame_id = b.frame_id AND a.class_id = b.class_id AND a.det_ord < b.det_ord
  WHERE {TX2} > {TX} AND {TY2} > {TY} AND {_reaches('a.')} AND {_reaches('b.')}
    AND CASE WHEN {TX2} - {TX} < {TY2} - {TY} THEN {_ratio('y')} >= 0.3 AND {_gap('x')} <= 384 ELSE {_ratio('x')} >= 0.3 AND {_gap('y')} <= 384 END)
  SELECT frame_id, a_ord, b_ord, px1 - px1 % 16 AS region_x, py1 - py1 % 2 AS region_y,
    greatest(2, least(3840, ((px2 + 15) // 16) * 16) - (px1 - px1 % 16)) AS region_w, greatest(2, (py2 - py2 % 2) - (py1 - py1 % 2)) AS region_h FROM jp"""


@query("joint_recheck_pairs", W(JOINT_SQL, "tiled"))
def _(spark, sf):
    out = J.joint_recheck_pairs(P.untile(view(spark, sf, "tiled")), ["frame_id"], 3840, 2160)
    return out.select("frame_id", "a_ord", "b_ord", "region_x", "region_y", "region_w", "region_h")


def _gt_pred(spark, sf):
    gt = view(spark, sf, "ground_truth").withColumnRenamed("det_ord", "gt_ord")
    pred = view(spark, sf, "predictions").withColumnRenamed("det_ord", "pred_ord")
    return gt, pred


GT_PAIRS = f"""gp AS (SELECT g.frame_id, g.class_id, g.det_ord AS gt_ord, p.det_ord AS pred_ord, p.score, {Q.iou('p.', 'g.')} AS iou
  FROM ground_truth g JOIN predictions p ON g.frame_id = p.frame_id AND g.class_id = p.class_id AND {Q.inter('p.', 'g.')} > 0)"""


@query("gt_candidates", W(f"+{GT_PAIRS} SELECT frame_id, class_id, gt_ord, pred_ord, ROUND(iou, 6) AS iou FROM gp", "ground_truth", "predictions"))
def _(spark, sf):
    out = J.gt_candidates(*_gt_pred(spark, sf), ["frame_id", "class_id"])
    return out.select("frame_id", "class_id", "gt_ord", "pred_ord", r6("iou"))


@query("best_gt", W(f"+{GT_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id, pred_ord ORDER BY iou DESC, gt_ord) AS n FROM gp) SELECT frame_id, class_id, pred_ord, gt_ord, ROUND(iou, 6) AS iou FROM k WHERE n = 1", "ground_truth", "predictions"))
def _(spark, sf):
    keys = ["frame_id", "class_id"]
    out = J.best_gt(J.gt_candidates(*_gt_pred(spark, sf), keys), keys)
    return out.select("frame_id", "class_id", "pred_ord", "gt_ord", r6("iou"))


@query("sweep", W("SELECT s.track_id, s.frame_id, p.param_id::INT AS param_id, p.size_alpha_max FROM motion_tracks s, (VALUES (0, CAST(0.45 AS DOUBLE)), (1, CAST(0.3 AS DOUBLE)), (2, CAST(0.2 AS DOUBLE))) p(param_id, size_alpha_max)", "motion_tracks"))
def _(spark, sf):
    out = J.sweep(view(spark, sf, "motion_tracks"), [{"size_alpha_max": a} for a in (0.45, 0.30, 0.20)])
    return out.select("track_id", "frame_id", "param_id", "size_alpha_max")


MSE_SQL = "list_sum(list_transform(list_zip(t.pixels, r.pixels), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) / 64.0"


@query("best_frame_match", W(f"""+c AS (SELECT t.video_id, t.frame_no AS target_no, r.frame_no AS match_no, {MSE_SQL} AS mse FROM pixels t JOIN ref r ON t.video_id = r.video_id AND r.frame_no BETWEEN t.frame_no - 20 AND t.frame_no + 20)
  SELECT video_id, target_no, arg_min(match_no, (mse, match_no)) AS match_no, ROUND(min(mse), 6) AS mse FROM c GROUP BY 1, 2""".replace("+c AS", "+ref AS (SELECT video_id, frame_no + 5 AS frame_no, vec_id, pixels FROM pixels), c AS", 1), "pixels"))
def _(spark, sf):
    target = view(spark, sf, "pixels")
    reference = target.withColumn("frame_no", F.col("frame_no") + 5)
    return J.best_frame_match(target, reference, ["video_id"], 20, step=5).select("video_id", "target_no", "match_no", r6("mse"))
