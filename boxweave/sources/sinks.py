"""Writers for reports, labels, manifests and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def report_messages(df: DataFrame, topic_prefix: str = "reports/") -> DataFrame:
    """(topic, value) rows, one topic per channel."""
    payload = [c for c in ("channel_id", "timestamp", "objects", "thumbnail", "roi_events") if c in df.columns]
    return df.select(F.concat(F.lit(topic_prefix), F.col("channel_id")).alias("topic"), F.to_json(F.struct(*payload)).alias("value"))


def write_reports(df: DataFrame, path: str | None = None, kafka: dict | None = None, checkpoint: str | None = None, **trigger):
    """Send report messages, batch or stream, to Kafka or to JSON text files by topic.

    At least once: a retried micro-batch writes its messages again.
    """
    messages = report_messages(df)
    if df.isStreaming:
        writer = messages.writeStream.option("checkpointLocation", checkpoint)
        writer = writer.format("kafka").options(**kafka) if kafka else writer.format("text").partitionBy("topic").option("path", path)
        return (writer.trigger(**trigger) if trigger else writer).start()
    if kafka:
        return messages.write.format("kafka").options(**kafka).save()
    return messages.write.partitionBy("topic").mode("append").text(path)


def label_rows(boxes: DataFrame, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """One text per image: six-decimal ``class cx cy w h`` lines in ``det_ord`` order.

    Images that already have labels are left alone unless ``overwrite``. An image's boxes
    are bounded by what a model head can give.
    """
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    rows = boxes.withColumn("line", line)
    if existing is not None and not overwrite:
        rows = rows.join(existing.select("image_stem"), "image_stem", "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("det_ord", "line"))), lambda x: x["line"])
    return rows.groupBy("image_stem").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("content"), F.count("*").alias("n_lines"))


def write_label_rows(boxes: DataFrame, path: str, existing: DataFrame | None = None, overwrite: bool = False, as_text: bool = False) -> None:
    """Label texts as a parquet table, or as one text folder per image."""
    rows = label_rows(boxes, existing, overwrite)
    if as_text:
        rows.select("image_stem", F.regexp_replace("content", "\n$", "").alias("value")).write.partitionBy("image_stem").text(path)
    else:
        rows.write.parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """CSV with header, quotes within a value doubled; refuses to overwrite."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_noop(df: DataFrame, *metrics) -> dict:
    """Run the plan, keep only metrics (row count by default)."""
    seen = Observation()
    df.observe(seen, *(metrics or (F.count(F.lit(1)).alias("rows"),))).write.format("noop").mode("overwrite").save()
    return seen.get


def write_motion_tracks(df: DataFrame, path: str) -> None:
    """Track samples by channel and day of their media or wall time."""
    clock = "ts_ms" if "ts_ms" in df.columns else "pts_ms"
    day = F.to_date(F.timestamp_millis(F.col(clock)))
    df.withColumn("date", day).repartition("channel_id", "date", F.pmod(F.xxhash64("track_id"), F.lit(16))).write.partitionBy("channel_id", "date").mode("append").parquet(path)
