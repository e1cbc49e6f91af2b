"""Readers and writers on real files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from boxweave import schemas
from boxweave.operators import filters as P
from boxweave.operators.scoring import pseudo_label
from boxweave.sources import logs as L
from boxweave.sources import readers as Rd
from boxweave.sources import sinks as K


def test_label_files_keep_empty_ones(spark, scratch):
    for name, text in {"a": "0 0.5 0.5 0.1 0.1\n\n1 0.2 0.2 0.1 0.1\n", "empty": "", "bad": "1 2 3 4\n6 0.5 0.5 0.1 0.1\n1 1.2 0.5 0.1 0.1\n1 0.5 0.5 0 0.1\nx 0.5 0.5 0.1 0.1"}.items():
        (scratch / f"{name}.txt").write_text(text)
    files, lines = Rd.read_label_files(spark, str(scratch))
    assert {(r.image_stem, r.n_lines) for r in files.collect()} == {("a", 2), ("empty", 0), ("bad", 5)}
    valid, rejects = P.validate_labels(lines)
    assert [(r.line_no, r.class_id) for r in valid.orderBy("line_no").collect()] == [(1, 0), (3, 1)]
    assert [r.reason for r in rejects.orderBy("line_no").collect()] == ["fields", "class", "center", "size", "number"]


def test_ground_truth_map(spark, scratch):
    data = {f"f{i}.jpg": [{"class_id": 5, "label": "book", "box": [10, 20, 110 + i, 220]}, {"class_id": 3, "label": "mouse", "box": [300, 40, 350, 90]}] for i in range(3)}
    (scratch / "gt.json").write_text(json.dumps(data, indent=1))
    rows = Rd.read_gt_map(spark, str(scratch / "gt.json")).collect()
    assert len(rows) == 6 and {(r.gt_ord, r.label, r.x2) for r in rows} == {(0, "book", 110.0), (0, "book", 111.0), (0, "book", 112.0), (1, "mouse", 350.0)}


def test_coco_subset(spark, scratch):
    doc = {"images": [{"id": 7, "file_name": "7.jpg", "width": 10, "height": 20}, {"id": 8, "file_name": "8.jpg", "width": 1, "height": 2}],
           "annotations": [{"image_id": 7, "category_id": 77, "bbox": [1, 2, 3, 4]}, {"image_id": 7, "category_id": 1, "bbox": [0, 0, 1, 1]}, {"image_id": 8, "category_id": 77, "bbox": [0, 0, 1, 1]}]}
    (scratch / "coco.json").write_text(json.dumps(doc))
    subset = spark.createDataFrame([("imgs/000007.jpg",), (" ",)], "image_path string")
    boxes, images = Rd.read_coco(spark, str(scratch / "coco.json"), subset, {77: (67, "cell phone")})
    r = boxes.collect()
    assert [(x.image, x.class_id, x.label, x.x1, x.y1, x.x2, x.y2) for x in r] == [("000007.jpg", 67, "cell phone", 1.0, 2.0, 4.0, 6.0)]
    assert [(x.image, x.width) for x in images.collect()] == [("000007.jpg", 10)]


def test_manifest_checks_columns_and_refuses_to_overwrite(spark, scratch):
    (scratch / "m.csv").write_text("keep,session,image_path\n1,s,/a/b.jpg\n,t,/a/c.jpg\n")
    df = Rd.read_manifest(spark, str(scratch / "m.csv"), schemas.REVIEW_MANIFEST, ["image_path"])
    assert P.select_reviewed(df).select("session").collect()[0].session == "s" and P.select_reviewed(df).count() == 1
    with pytest.raises(ValueError, match="label_path"):
        Rd.read_manifest(spark, str(scratch / "m.csv"), schemas.ANNOTATION_MANIFEST, ["label_path"])
    K.write_manifest(df, str(scratch / "out"))
    assert spark.read.option("header", True).csv(str(scratch / "out")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        K.write_manifest(df, str(scratch / "out"))


def test_image_inventory(spark, scratch):
    folder = scratch / "cup"
    folder.mkdir()
    (folder / "desk__1.jpg").write_bytes(b"abc")
    (folder / "plain.png").write_bytes(b"abc")
    (folder / "note.md").write_text("no picture")
    rows = {r.image_name: r for r in Rd.image_inventory(spark, str(scratch)).collect()}
    assert set(rows) == {"desk__1.jpg", "plain.png"}
    assert rows["desk__1.jpg"].session == "desk" and rows["plain.png"].session is None
    assert rows["plain.png"].sha256 == hashlib.sha256(b"abc").hexdigest() and rows["plain.png"].folder == "cup" and rows["plain.png"].bytes == 3


def test_reports_round_trip(spark, scratch):
    rows = [("a", 5, [("cup", 1, 0.5)]), ("b", 6, [])]
    df = spark.createDataFrame(rows, "channel_id string, timestamp long, objects array<struct<label:string,count:int,score:double>>")
    K.write_reports(df, str(scratch / "reports"))
    back = Rd.read_reports(spark, str(scratch / "reports"))
    assert {(r.report.channel_id, r.report.timestamp, len(r.report.objects)) for r in back.where("valid").collect()} == {("a", 5, 1), ("b", 6, 0)}
    broken = Rd.check_reports(spark.createDataFrame([("{nope",), ('{"channel_id":"a","thumbnail":{"width":2,"height":2,"data":"AAAA"}}',)], "value string")).collect()
    assert [r.valid for r in broken] == [False, True] and broken[1].thumbnail_ok is False


def test_streamed_reports(spark, scratch):
    rows = [("a", 5, [("cup", 1, 0.5)])]
    schema = "channel_id string, timestamp long, objects array<struct<label:string,count:int,score:double>>"
    spark.createDataFrame(rows, schema).write.parquet(str(scratch / "in"))
    stream = spark.readStream.schema(schema).parquet(str(scratch / "in"))
    K.write_reports(stream, str(scratch / "out"), checkpoint=str(scratch / "ck"), availableNow=True).awaitTermination()
    assert [r.topic for r in spark.read.text(str(scratch / "out")).collect()] == ["reports/a"]


def test_labels_are_written_once(spark, scratch):
    boxes = spark.createDataFrame([("a", 2, 1, 0.5, 0.5, 0.1, 0.2), ("a", 1, 0, 0.25, 0.5, 0.1, 0.2), ("b", 1, 0, 0.5, 0.5, 0.1, 0.2)], "image_stem string, det_ord int, class_id int, cx double, cy double, w double, h double")
    have = spark.createDataFrame([("b",)], "image_stem string")
    K.write_label_rows(boxes, str(scratch / "labels"), have)
    rows = spark.read.parquet(str(scratch / "labels")).collect()
    assert [(r.image_stem, r.content) for r in rows] == [("a", "0 0.250000 0.500000 0.100000 0.200000\n1 0.500000 0.500000 0.100000 0.200000\n")]
    K.write_label_rows(boxes, str(scratch / "texts"), as_text=True)
    assert spark.read.text(str(scratch / "texts")).where("image_stem = 'a'").count() == 2


def test_metrics_only_sink(spark):
    assert K.write_noop(spark.range(10)) == {"rows": 10}


def test_motion_tracks_sink(spark, scratch):
    df = spark.createDataFrame([("a", 1, 86_400_000), ("b", 2, 0)], "channel_id string, track_id long, pts_ms long")
    K.write_motion_tracks(df, str(scratch / "tracks"))
    assert {(r.channel_id, str(r.date)) for r in spark.read.parquet(str(scratch / "tracks")).collect()} == {("a", "1970-01-02"), ("b", "1970-01-01")}


def test_repeated_keys_and_markers_in_logs(spark, scratch):
    (scratch / "run.log").write_text("noise\nx [PullStats] enc_drop=1 enc_drop=2 [PullStats] enc_drop=9 [StreamStats] channel=c1 write_fail=3 host=abc\n")
    rows = L.parse_runtime_stats(L.read_lines(spark, str(scratch / "run.log"))).collect()
    assert {(r.source, r.channel_id, r.metric, r.value) for r in rows} == {("PullStats", None, "enc_drop", 2.0), ("StreamStats", "c1", "write_fail", 3.0)}


def test_pseudo_labels(spark):
    images = spark.createDataFrame([("a.jpg", 100, 50, True), ("b.jpg", 100, 50, True), ("c.jpg", 100, 50, True), ("d.jpg", 100, 50, False)], "image_name string, width int, height int, readable boolean")
    files = spark.createDataFrame([("c",)], "image_stem string")

    def model(pdf):
        hit = pdf[pdf["image_name"] == "a.jpg"]
        return hit.assign(det_ord=0, class_id=1, label="cup", score=0.5, x1=10.0, y1=10.0, x2=30.0, y2=20.0)[["image_name", "det_ord", "class_id", "label", "score", "x1", "y1", "x2", "y2"]]

    manifest, rows = pseudo_label(images, files, model)
    assert {(r.image_name, r.status, r.labels) for r in manifest.collect()} == {
        ("a.jpg", "written", "cup:0.500"), ("b.jpg", "no_detection_unwritten", ""), ("c.jpg", "skipped_existing", ""), ("d.jpg", "missing_image", "")}
    assert [(r.image_stem, r.content) for r in rows.collect()] == [("a", "1 0.200000 0.300000 0.200000 0.200000\n")]
    draft, _ = pseudo_label(images, files, model, style="draft")
    assert {r.status for r in draft.collect()} == {"draft", "draft_empty", "skipped_existing", "missing_image"}


def test_stream_of_detections(spark, scratch):
    rows = [("c", 1, 33, 33, 0, 1, "cup", 0.5, 0.0, 0.0, 1.0, 1.0)]
    spark.createDataFrame(rows, schemas.DETECTIONS).write.parquet(str(scratch / "d"))
    assert Rd.read_detections(spark, str(scratch / "d")).count() == 1
    stream = Rd.stream_detections(spark, str(scratch / "d"), max_files=1)
    assert stream.isStreaming
    q = stream.groupBy().agg(F.count("*").alias("n")).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").first().n == 1
