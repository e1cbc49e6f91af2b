"""Readers and writers over files that are written from the given tables to the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxweave import schemas
from boxweave.operators import decode as Dc
from boxweave.plans.registry import query, r6
from boxweave.plans.views import LABELS, view
from boxweave.plans.views import with_views as W
from boxweave.session import run_dir
from boxweave.sources import readers as Rd
from boxweave.sources import sinks as K
from boxweave.streaming import stateful as S

#: Frames described by one ground-truth or COCO file.
PER_FILE = 2000
#: Rows of a file of streamed detections, some 50 MB in the shuffle.
PER_STREAMED_FILE = 1_000_000
CORNERS = ["x1", "y1", "x2", "y2"]


def _by_file(df, spark, name: str) -> str:
    """One JSON document per file, from rows ``(part, value)``; returns the pattern of the files."""
    path = run_dir(spark, name)
    df.write.partitionBy("part").text(path)
    return f"{path}/*"


@query("read_gt_map", W("SELECT 'f' || frame_id || '.jpg' AS image, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY det_ord) - 1 AS INT) AS gt_ord, class_id, label, x1, y1, x2, y2 FROM ground_truth", "ground_truth"))
def _(spark, sf):
    box = F.struct("det_ord", F.struct("class_id", "label", F.array(*CORNERS).alias("box")).alias("b"))
    images = view(spark, sf, "ground_truth").groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(box)), lambda x: x.b).alias("boxes"))
    entry = F.struct(F.concat(F.lit("f"), "frame_id", F.lit(".jpg")).alias("k"), F.col("boxes").alias("v"))
    maps = images.groupBy(F.floor(F.col("frame_id") / PER_FILE).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return Rd.read_gt_map(spark, _by_file(maps, spark, "gt"))


SOME_CLASSES = {11: (0, LABELS[0]), 14: (3, LABELS[3])}
COCO_CLASSES = {11 + i: (i, name) for i, name in enumerate(LABELS)}


def _coco(spark, sf, classes=COCO_CLASSES):
    """COCO files of all frames; the pictures wanted are those of 1280 by 720."""
    frames = view(spark, sf, "frames")
    image = F.struct(F.col("frame_id").alias("id"), F.concat("frame_id", F.lit(".jpg")).alias("file_name"), "width", "height")
    box = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    note = F.struct(F.col("frame_id").alias("image_id"), (F.col("class_id") + 11).alias("category_id"), box.alias("bbox"))
    part = F.floor(F.col("frame_id") / PER_FILE).alias("part")
    images = frames.groupBy(part).agg(F.collect_list(image).alias("images"))
    notes = view(spark, sf, "detections").groupBy(part).agg(F.collect_list(note).alias("annotations"))
    docs = images.join(notes, "part", "left").select("part", F.to_json(F.struct("images", "annotations")).alias("value"))
    wanted = frames.where("width = 1280 AND height = 720").select(F.concat(F.lit("/pictures/"), F.lpad(F.col("frame_id").cast("string"), 12, "0"), F.lit(".jpg")).alias("image_path"))
    return Rd.read_coco(spark, _by_file(docs, spark, "coco"), wanted, classes)


COCO_SQL = "SELECT lpad(d.frame_id::VARCHAR, 12, '0') || '.jpg' AS image, d.class_id, d.label, ROUND(x1, 6) AS x1, ROUND(y1, 6) AS y1, ROUND(x2, 6) AS x2, ROUND(y2, 6) AS y2 FROM detections d JOIN frames f USING (frame_id) WHERE width = 1280 AND height = 720"


@query("read_coco", W(COCO_SQL, "detections", "frames"))
def _(spark, sf):
    return _coco(spark, sf)[0].select("image", "class_id", "label", *[r6(c) for c in CORNERS])


@query("read_coco_some_classes", W(f"{COCO_SQL} AND class_id IN (0, 3)", "detections", "frames"))
def _(spark, sf):
    return _coco(spark, sf, SOME_CLASSES)[0].select("image", "class_id", "label", *[r6(c) for c in CORNERS])


@query("read_coco_images", W("SELECT lpad(frame_id::VARCHAR, 12, '0') || '.jpg' AS image, CAST(width AS INT) AS width, CAST(height AS INT) AS height FROM frames WHERE width = 1280 AND height = 720", "frames"))
def _(spark, sf):
    return _coco(spark, sf)[1].select("image", "width", "height")


@query("read_manifest", W("SELECT keep, review_choice, session, path AS image_path, 'book, \"cup\"' || chr(10) || doc_id AS suggested_labels, CAST(NULL AS VARCHAR) AS note FROM (SELECT * REPLACE (nullif(trim(keep), '') AS keep) FROM images)", "images"))
def _(spark, sf):
    rows = view(spark, sf, "images").select(F.trim("keep").alias("keep"), "review_choice", "session", F.col("path").alias("image_path"), F.concat(F.lit('book, "cup"\n'), "doc_id").alias("suggested_labels"))
    path = run_dir(spark, "review")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return Rd.read_manifest(spark, path, schemas.REVIEW_MANIFEST, ["keep", "image_path"], multi_line=True)


@query("write_manifest", W("SELECT image_name, session, path AS source_path, '/work/' || image_name AS annotation_image_path, '/work/labels, \"v2\"/' || doc_id || '.txt' AS label_path, nullif(negative_hint, '') AS negative_hint FROM images", "images"))
def _(spark, sf):
    i = view(spark, sf, "images")
    label = F.concat(F.lit('/work/labels, "v2"/'), "doc_id", F.lit(".txt")).alias("label_path")
    path = run_dir(spark, "annotation")
    K.write_manifest(i.select("image_name", "session", F.col("path").alias("source_path"), F.concat(F.lit("/work/"), "image_name").alias("annotation_image_path"), label, "negative_hint"), path)
    return Rd.read_manifest(spark, path, schemas.ANNOTATION_MANIFEST, ["image_name", "label_path"])


@query("write_motion_tracks", W("SELECT channel_id, CAST(CAST(epoch_ms(pts_ms) AS DATE) AS VARCHAR) AS date, frame_id, track_id, class_id, raw_x1, smooth_y2, reset, active FROM motion_tracks", "motion_tracks"))
def _(spark, sf):
    path = run_dir(spark, "motion-tracks")
    K.write_motion_tracks(view(spark, sf, "motion_tracks"), path)
    return spark.read.parquet(path).select("channel_id", F.col("date").cast("string").alias("date"), "frame_id", "track_id", "class_id", "raw_x1", "smooth_y2", "reset", "active")


@query("write_noop", W("SELECT count(*) AS rows, ROUND(sum(score), 4) AS scores, count(DISTINCT channel_id) AS channels FROM detections", "detections"))
def _(spark, sf):
    seen = K.write_noop(
        view(spark, sf, "detections"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("score"), 4).alias("scores"), F.size(F.collect_set("channel_id")).cast("long").alias("channels")
    )
    return spark.createDataFrame([(seen["rows"], seen["scores"], seen["channels"])], "rows long, scores double, channels long")


TENSORS = """SELECT CAST(FLOOR((c_custkey - 1) / 9) AS BIGINT) AS model_id, CAST(FLOOR((c_custkey - 1) % 9 / 3) AS INT) AS branch,
  CASE (c_custkey - 1) % 3 WHEN 0 THEN 'box' WHEN 1 THEN 'score' ELSE 'sum' END AS tensor, CASE WHEN c_nationkey = 9 THEN 'uint8' ELSE 'int8' END AS dtype,
  'affine' AS quantisation, CASE WHEN c_nationkey = 7 THEN 3 ELSE 4 END AS n_dims,
  CAST(CASE (c_custkey - 1) % 3 WHEN 0 THEN CASE WHEN c_nationkey = 4 THEN 62 ELSE 64 END WHEN 1 THEN CASE WHEN c_nationkey = 5 THEN 7 WHEN c_nationkey < 12 THEN 6 ELSE 80 END ELSE 1 END AS INT) AS channels,
  CAST(CASE WHEN c_nationkey = 3 THEN 48 ELSE 80 / POWER(2, FLOOR((c_custkey - 1) % 9 / 3)) END AS INT) AS grid_h, CAST(80 / POWER(2, FLOOR((c_custkey - 1) % 9 / 3)) AS INT) AS grid_w FROM {customer}"""
HEADS_SQL = f"""WITH t AS ({TENSORS.format(customer='customer')}),
  b AS (SELECT model_id, branch, bool_and(dtype = 'int8' AND quantisation = 'affine') AS affine, bool_and(n_dims = 4) AS four, max(channels) FILTER (tensor = 'box') AS v, max(grid_h) FILTER (tensor = 'box') AS h, max(grid_w) FILTER (tensor = 'box') AS w,
    max(channels) FILTER (tensor = 'score') AS sc, max(grid_h) FILTER (tensor = 'score') AS sh, max(grid_w) FILTER (tensor = 'score') AS sw, max(channels) FILTER (tensor = 'sum') AS uc, max(grid_h) FILTER (tensor = 'sum') AS uh, max(grid_w) FILTER (tensor = 'sum') AS uw FROM t GROUP BY 1, 2),
  c AS (SELECT *, coalesce(h > 0 AND w > 0 AND v > 0 AND v % 4 = 0 AND v <= {Dc.MAX_DFL_VALUES}, false) AS shaped, coalesce(sc IN {Dc.CLASS_COUNTS} AND uc = 1 AND sh = h AND sw = w AND uh = h AND uw = w, false) AS alike FROM b)
  SELECT model_id, -1 AS branch, 'output count' AS violation FROM t GROUP BY 1 HAVING count(*) <> 9
  UNION ALL SELECT model_id, branch, 'not affine int8' FROM c WHERE NOT affine UNION ALL SELECT model_id, branch, 'not four-dimensional' FROM c WHERE NOT four
  UNION ALL SELECT model_id, branch, 'DFL shape' FROM c WHERE NOT shaped UNION ALL SELECT model_id, branch, 'shapes differ' FROM c WHERE NOT alike
  UNION ALL SELECT model_id, branch, 'stride' FROM c WHERE shaped AND NOT (480 % h = 0 AND 640 % w = 0 AND 480.0 / h = 640.0 / w)"""


@query("validate_heads", HEADS_SQL)
def _(spark, sf):
    tensors = spark.sql(TENSORS, customer=spark.read.parquet(f"{sf}/customer.parquet"))
    return Dc.validate_heads(tensors, 640, 480).select("model_id", F.coalesce("branch", F.lit(-1)).alias("branch"), "violation")


def streamed_files(rows: int) -> int:
    """Files that a table arrives in: three micro-batches, as many files more as its rows need."""
    return 3 * max(1, -(-rows // (3 * PER_STREAMED_FILE)))


@query("stream_detections", W("SELECT frame_id, det_ord, class_id, label, score, x1, y2 FROM detections", "detections"))
def _(spark, sf):
    """Several files in three micro-batches; each file is written by a task of its own."""
    path, arriving = run_dir(spark, "arriving"), view(spark, sf, "detections")
    files = streamed_files(arriving.count())
    arriving.repartition(files, "frame_id").write.parquet(path)
    boxes = Rd.stream_detections(spark, path, max_files=files // 3)
    return S.run_available(boxes, "detections").select("frame_id", "det_ord", "class_id", "label", "score", "x1", "y2")
