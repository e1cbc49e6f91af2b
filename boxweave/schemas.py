"""Fixed schemas; nothing is inferred."""

from __future__ import annotations

DETECTIONS = (
    "channel_id string, frame_id long, pts_ms long, ts_ms long, det_ord long, class_id int, label string, score double, "
    "x1 double, y1 double, x2 double, y2 double"
)
FRAMES = "channel_id string, frame_id long, pts_ms long, ts_ms long, width int, height int"
REGIONS = "region_id string, region_ord int, x double, y double, w double, h double"
HEAD_CELLS = "frame_id long, branch int, grid_row int, grid_col int, box array<int>, scores array<int>, sum_code int"
REPORT = (
    "channel_id string, timestamp long, objects array<struct<label:string,count:int,score:double>>, "
    "thumbnail struct<width:int,height:int,format:string,data:string>, "
    "roi_events array<struct<region:string,label:string,dwell_sec:double>>"
)
GT_MAP = "map<string, array<struct<class_id:int,label:string,box:array<double>>>>"
COCO = (
    "images array<struct<id:long,file_name:string,width:int,height:int>>, "
    "annotations array<struct<image_id:long,category_id:int,bbox:array<double>>>"
)
REVIEW_MANIFEST = "keep string, review_choice string, session string, image_path string, suggested_labels string, note string"
ANNOTATION_MANIFEST = (
    "image_name string, session string, source_path string, annotation_image_path string, label_path string, negative_hint string"
)
SPLIT_MANIFEST = (
    "image_name string, session string, split string, source_image_path string, source_label_path string, "
    "split_image_path string, split_label_path string"
)
PHOTO_MANIFEST = (
    "source_class_id int, source_class string, source_name string, source_path string, annotation_name string, sha256 string, "
    "bytes long, capture_time string, duplicate_of string, label_status string"
)
PSEUDO_LABEL_MANIFEST = "image string, status string, detections string, labels string"
