"""Detection-shaped views over the given tables, as SQL text for two engines.

Each view is one SELECT over the parquet tables, so its size follows theirs. The few
functions that are spelled differently come from a dialect object.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The six class labels in class-id order.
LABELS = ["cell phone", "cup", "keyboard", "mouse", "laptop", "book"]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class SparkDialect:
    def epoch_ms(self, ts):
        return f"unix_millis(CAST({ts} AS TIMESTAMP))"

    def sha256(self, text):
        return f"sha2({text}, 256)"

    def array(self, *items):
        return f"array({', '.join(items)})"

    def transform(self, arr, var, body):
        return f"transform({arr}, {var} -> {body})"

    def slice(self, arr, start, length):
        return f"slice({arr}, {start}, {length})"

    def largest(self, arr):
        return f"array_max({arr})"

    def idiv(self, a, b):
        return f"({a} div {b})"

    def number(self, text):
        return f"CAST({text} AS BIGINT)"


class DuckDialect:
    def epoch_ms(self, ts):
        return f"epoch_ms({ts})"

    def sha256(self, text):
        return f"sha256({text})"

    def array(self, *items):
        return f"[{', '.join(items)}]"

    def transform(self, arr, var, body):
        return f"list_transform({arr}, lambda {var}: {body})"

    def slice(self, arr, start, length):
        return f"list_slice({arr}, {start}, {start} + {length} - 1)"

    def largest(self, arr):
        return f"list_max({arr})"

    def idiv(self, a, b):
        return f"({a} // {b})"

    def number(self, text):
        return f"CAST({text} AS BIGINT)"


def _label(class_id: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LABELS))
    return f"CASE {class_id} {arms} END"


def _detections(d, where="") -> str:
    return f"""
      SELECT concat('ch', CAST(l_orderkey % 4 AS STRING)) AS channel_id,
             l_orderkey AS frame_id,
             33 * l_orderkey AS pts_ms,
             1700000000000 + 33 * l_orderkey AS ts_ms,
             ((CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 1000000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS det_ord,
             CAST(l_partkey % 6 AS INT) AS class_id,
             {_label('l_partkey % 6')} AS label,
             ROUND(CAST(0.05 AS DOUBLE) + 9 * l_discount, 6) AS score,
             CAST(40 * (l_partkey % 8) AS DOUBLE) AS x1,
             CAST(30 * (l_suppkey % 8) AS DOUBLE) AS y1,
             CAST(40 * (l_partkey % 8) + 40 AS DOUBLE) + 4 * l_quantity AS x2,
             CAST(30 * (l_suppkey % 8) + 30 AS DOUBLE) + 3 * l_quantity AS y2
      FROM {{lineitem}} {where}"""


def _split_of(session: str, d) -> str:
    number = d.number(f"substr({session}, 4)")
    return f"CASE WHEN {number} % 10 < 7 THEN 'train' WHEN {number} % 10 < 9 THEN 'val' ELSE 'test' END"


def _views(d) -> dict[str, str]:
    sum8 = "CAST(ROUND(CAST(x AS DOUBLE) * 100) AS INT)"
    return {
        "detections": _detections(d),
        "ground_truth": _detections(d, "WHERE l_linenumber % 2 = 0"),
        "predictions": _detections(d, "WHERE l_linenumber % 2 = 1"),
        "frames": """
      SELECT concat('ch', CAST(o_orderkey % 4 AS STRING)) AS channel_id,
             o_orderkey AS frame_id,
             33 * o_orderkey AS pts_ms,
             1700000000000 + 33 * o_orderkey AS ts_ms,
             CASE WHEN o_orderkey % 10 = 3 THEN 641 WHEN o_custkey % 9 = 2 THEN 1280 ELSE 640 END AS width,
             CASE WHEN o_orderkey % 12 = 5 THEN 481 WHEN o_custkey % 9 = 2 THEN 720 ELSE 480 END AS height
      FROM {orders}""",
        "source_frames": """
      SELECT concat('ch', CAST(o_orderkey % 4 AS STRING)) AS channel_id,
             o_orderkey AS frame_id,
             CASE WHEN o_orderkey % 37 = 0 THEN NULL
                  WHEN o_custkey % 53 = 0 THEN 33 * (o_orderkey % 4000) + 500000 - 400
                  ELSE 33 * (o_orderkey % 4000) + 500000 END AS source_pts_ms,
             o_orderkey % 4000 AS position,
             (o_orderkey - o_orderkey % 4000) AS connection
      FROM {orders}""",
        "regions": """
      SELECT concat('roi', CAST(r_regionkey AS STRING)) AS region_id,
             CAST(r_regionkey AS INT) AS region_ord,
             r_regionkey * CAST(0.15 AS DOUBLE) - CAST(0.05 AS DOUBLE) AS x,
             CAST(0.25 AS DOUBLE) * (r_regionkey % 3) AS y,
             CASE WHEN r_regionkey = 4 THEN CAST(0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS w,
             CAST(0.5 AS DOUBLE) AS h
      FROM {region}""",
        "tiled": f"""
      SELECT l_orderkey AS frame_id,
             ((CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 1000000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS det_ord,
             CAST(l_partkey % 3 AS INT) AS class_id,
             {_label('l_partkey % 3')} AS label,
             ROUND(CAST(0.05 AS DOUBLE) + 9 * l_discount, 6) AS score,
             CAST(200 * (l_partkey % 8) AS DOUBLE) AS x1,
             CAST(150 * (l_suppkey % 8) AS DOUBLE) AS y1,
             CAST(200 * (l_partkey % 8) + 100 AS DOUBLE) + 12 * l_quantity AS x2,
             CAST(150 * (l_suppkey % 8) + 100 AS DOUBLE) + 18 * l_quantity AS y2,
             CAST(1728 * (l_linenumber % 2) AS INT) AS tile_x, 0 AS tile_y, 2112 AS tile_w, 2160 AS tile_h,
             CASE WHEN l_partkey % 5 = 0 THEN 'joint' ELSE 'tile' END AS origin
      FROM {{lineitem}}""",
        "motion_tracks": f"""
      SELECT concat('ch', CAST({d.idiv('event_id', '1000')} % 4 AS STRING)) AS channel_id,
             {d.idiv('event_id', '5')} AS frame_id,
             50 * {d.idiv('event_id', '5')} AS pts_ms,
             event_id % 5 + 5 * {d.idiv('event_id', '1000')} AS track_id,
             CAST(event_id % 5 AS INT) AS class_id,
             CASE WHEN event_id % 23 = 0 THEN 0 WHEN event_id % 29 = 0 THEN 300 ELSE 20 + event_id % 60 END AS dt_ms,
             CAST(100 + 7 * (event_id % 11) AS DOUBLE) AS raw_x1,
             CAST(50 + 5 * (event_id % 13) AS DOUBLE) AS raw_y1,
             CAST(160 + 7 * (event_id % 11) AS DOUBLE) + FLOOR(value / 4) AS raw_x2,
             CAST(90 + 5 * (event_id % 13) AS DOUBLE) + FLOOR(value / 8) AS raw_y2,
             CAST(100 + 7 * (event_id % 11) + event_id % 5 AS DOUBLE) AS smooth_x1,
             CAST(50 + 5 * (event_id % 13) + event_id % 3 AS DOUBLE) AS smooth_y1,
             CAST(160 + 7 * (event_id % 11) + event_id % 4 AS DOUBLE) + FLOOR(value / 4) AS smooth_x2,
             CAST(90 + 5 * (event_id % 13) + event_id % 6 AS DOUBLE) + FLOOR(value / 8) AS smooth_y2,
             CAST(event_id % 21 - 10 AS DOUBLE) AS raw_dx,
             CAST(event_id % 13 - 6 AS DOUBLE) AS raw_dy,
             event_id % 7 = 0 AS deadzone,
             event_id % 10 = 0 AS reset,
             event_id % 8 <> 1 AS was_active,
             event_id % 9 <> 0 AS active,
             CAST(0.45 AS DOUBLE) AS size_alpha
      FROM {{events}}""",
        "motion_stats": f"""
      SELECT concat('run', CAST(user_id % 2 AS STRING)) AS run_id,
             event_id AS frame_id,
             50 * event_id AS pts_ms,
             CASE WHEN event_id % 31 = 0 THEN 400 WHEN event_id % 41 = 0 THEN 5 ELSE 20 + event_id % 60 END AS dt_ms,
             event_id % 4 AS stable_tracks,
             CAST(100 + event_id % 50 AS DOUBLE) AS raw_center_x,
             CAST(80 + event_id % 40 AS DOUBLE) AS raw_center_y,
             CAST(98 + event_id % 45 AS DOUBLE) AS smooth_center_x,
             CAST(79 + event_id % 35 AS DOUBLE) AS smooth_center_y,
             CAST(event_id % 21 - 10 AS DOUBLE) AS raw_dx,
             CAST(event_id % 13 - 6 AS DOUBLE) AS raw_dy,
             CAST(event_id % 11 - 5 AS DOUBLE) / 2 AS smooth_dx,
             CAST(event_id % 7 - 3 AS DOUBLE) / 2 AS smooth_dy,
             CAST(event_id % 97 AS DOUBLE) / 1000 AS raw_step_ratio,
             CAST(event_id % 89 AS DOUBLE) / 2000 AS smooth_step_ratio,
             value / 10000 AS raw_size_step,
             value / 40000 AS smooth_size_step,
             event_id % 2 AS raw_reversals,
             CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS created,
             CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS lost,
             {d.array('user_id % 3', 'event_id % 2 + 3')} AS active_ids,
             {d.array('user_id % 3')} AS stable_ids
      FROM {{events}}""",
        "telemetry": f"""
      SELECT concat('ch', CAST(user_id % 4 AS STRING)) AS channel_id,
             event_id, {d.epoch_ms('ts')} AS ts_ms, ts,
             CASE WHEN event_type IN ('click', 'view') THEN 'PullStats'
                  WHEN event_type = 'error' THEN 'StreamStats' ELSE 'EncodeStats' END AS source,
             event_type AS metric, value
      FROM {{events}}""",
        "inference_results": """
      SELECT concat('ch', CAST(o_custkey % 4 AS STRING)) AS channel_id,
             o_orderkey AS frame_id,
             o_orderstatus <> 'P' AS success,
             33 * o_orderkey AS pts_ms,
             33 * o_orderkey + 1 AS ts_ms,
             CAST(o_orderkey % 3 AS DOUBLE) AS preprocess_ms,
             CAST(FLOOR(o_totalprice / 10000) + 5 AS DOUBLE) AS npu_ms,
             CAST(o_custkey % 50 AS DOUBLE) AS queue_wait_ms,
             FLOOR(o_totalprice / 10000) + 9 + CAST(o_custkey % 50 AS DOUBLE) AS e2e_ms,
             o_custkey % 11 = 0 AS replaced,
             o_custkey % 13 = 0 AS throttled,
             o_custkey % 17 = 0 AS stale
      FROM {orders}""",
        "head_cells": f"""
      SELECT vec_id AS frame_id, CAST(vec_id % 3 AS INT) AS branch,
             CAST(vec_id % 20 AS INT) AS grid_row, CAST(label AS INT) AS grid_col,
             {d.transform('embedding', 'x', sum8)} AS box,
             {d.transform(d.slice('embedding', 1, 6), 'x', sum8)} AS scores,
             {d.largest(d.transform(d.slice('embedding', 1, 6), 'x', sum8))} - CAST(vec_id % 4 AS INT) AS sum_code
      FROM {{embeddings}}""",
        "decoded_cells": f"""
      SELECT vec_id AS frame_id, CAST(vec_id % 7 AS INT) AS anchor,
             CAST(300 + 10 * (vec_id % 11) AS DOUBLE) AS cx, CAST(200 + 7 * (vec_id % 13) AS DOUBLE) AS cy,
             CAST(40 + vec_id % 50 AS DOUBLE) AS w, CAST(30 + vec_id % 70 AS DOUBLE) AS h,
             {d.transform(d.slice('embedding', 1, 6), 'x', 'CAST(ROUND(CAST(x AS DOUBLE) * 100) AS DOUBLE) / 100')} AS scores
      FROM {{embeddings}}""",
        "pixels": """
      SELECT concat('vid', CAST(vec_id % 5 AS STRING)) AS video_id, vec_id - vec_id % 5 AS frame_no,
             vec_id AS vec_id, embedding AS pixels
      FROM {embeddings}""",
        "images": f"""
      SELECT concat(source, '__', CAST(doc_id AS STRING), '.jpg') AS image_name,
             concat('/data/', lang, '/', source, '__', CAST(doc_id AS STRING), '.jpg') AS path,
             source AS session, doc_id, n_chars AS bytes,
             {d.sha256('text')} AS sha256,
             CAST(doc_id % 6 AS INT) AS source_class_id,
             {_label('doc_id % 6')} AS source_class,
             CASE WHEN doc_id % 97 = 0 THEN 'val' ELSE {_split_of('source', d)} END AS split,
             CASE WHEN doc_id % 3 = 0 THEN 4000 WHEN doc_id % 3 = 1 THEN 3000 ELSE 2000 END AS width,
             CASE WHEN doc_id % 4 = 0 THEN 4000 WHEN doc_id % 4 = 1 THEN 3000 ELSE 2000 END AS height,
             CASE WHEN doc_id % 5 = 0 THEN '1' ELSE '' END AS negative_hint,
             CASE WHEN doc_id % 8 = 0 THEN ' Keep ' WHEN doc_id % 8 = 1 THEN 'YES' WHEN doc_id % 8 = 2 THEN '1'
                  WHEN doc_id % 8 = 3 THEN 'no' ELSE '' END AS keep,
             CASE WHEN doc_id % 11 = 0 THEN 'keep' ELSE 'drop' END AS review_choice
      FROM {{documents}}""",
        "label_files": """
      SELECT concat(d.source, '__', CAST(d.doc_id AS STRING)) AS image_stem,
             CASE WHEN l.toxic = 1 THEN 0 ELSE 1 + l.doc_id % 3 END AS n_lines
      FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
        "sessions": f"""
      SELECT DISTINCT source AS session, {_split_of('source', d)} AS split
      FROM {{documents}} WHERE source <> 'src19'""",
        "dataset_boxes": f"""
      SELECT l_orderkey AS image_id,
             CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split,
             CAST(CASE WHEN l_partkey % 12 < 7 THEN 0 ELSE l_partkey % 6 END AS INT) AS class_id,
             {_label('CASE WHEN l_partkey % 12 < 7 THEN 0 ELSE l_partkey % 6 END')} AS label
      FROM {{lineitem}}""",
        "label_lines": """
      SELECT concat('img', CAST(l_orderkey AS STRING)) AS image_stem,
             ((CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 1000000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS line_no,
             CASE WHEN l_suppkey % 40 = 0 THEN '1 2 3'
                  ELSE concat(CAST(l_partkey % 7 AS STRING), ' ',
                              CAST(CAST(l_suppkey % 12 AS DOUBLE) / 10 AS STRING), ' ',
                              CAST(CAST(l_suppkey % 9 AS DOUBLE) / 8 AS STRING), ' ',
                              CAST(CAST(l_partkey % 5 AS DOUBLE) / 4 AS STRING), ' ', '0.25') END AS line
      FROM {lineitem}""",
        "reports": f"""
      SELECT concat('conv', CAST(conv_id AS STRING)) AS channel_id, turn, 1000 * turn AS ts_ms, role AS summary_key,
             turn % 5 = 4 AS has_events
      FROM {{conversations}}""",
        "snapshots": """
      SELECT concat('ch', CAST(o_orderkey % 4 AS STRING)) AS channel_id, o_orderkey AS frame_id,
             33 * o_orderkey + o_custkey % 3 * 11 AS pts_ms, 1 + o_custkey % 5 AS n_boxes
      FROM {orders} WHERE o_custkey % 3 <> 1 OR o_orderkey % 7 = 0""",
        "track_table": f"""
      SELECT concat('ch', CAST(user_id % 4 AS STRING)) AS channel_id, event_id AS track_id,
             CASE event_id % 3 WHEN 0 THEN 'tentative' WHEN 1 THEN 'active' ELSE 'shadow' END AS state,
             event_id % 5 AS hits, 20 * event_id AS last_pts_ms
      FROM {{events}}""",
    }


_SPARK = _views(SparkDialect())
_DUCK = _views(DuckDialect())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables in ``sf_dir``."""
    text = _SPARK[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables as file streams."""
    text = _SPARK[name]

    def source(t: str) -> DataFrame:
        # A pattern for one name, which may be a file or a folder of files; a plain path may be a folder only.
        return spark.readStream.schema(table(spark, sf_dir, t).schema).parquet(f"{sf_dir}/[{t[0]}]{t[1:]}.parquet")

    return spark.sql(text, **{t: source(t) for t in set(re.findall(r"\{(\w+)\}", text))})


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB query over the views in ``names``."""
    parts = [f"{n} AS ({_DUCK[n].format(**{t: t for t in TABLES})})" for n in names]
    prefix = "WITH RECURSIVE " if recursive else "WITH "
    head = (prefix + ", ".join(parts)) if parts else ""
    glue = ", " if parts and body.lstrip().startswith("+") else " "
    return head + glue + body.lstrip().lstrip("+")
