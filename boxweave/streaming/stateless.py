"""Streams that built-in windows and watermarks express; they run on batches too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxweave.operators.aggregates import RING


def _clock(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis(F.col(time)))


def _watermarked(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("event_time", delay) if df.isStreaming else df


def telemetry_windows(df: DataFrame, width: str = "10 seconds", delay: str = "10 seconds", time: str = "ts_ms") -> DataFrame:
    """Samples, sum and mean of each metric per channel and tumbling window of event time."""
    grouped = _watermarked(_clock(df, time), delay).groupBy(F.window("event_time", width), "channel_id", "metric")
    out = grouped.agg(F.count("*").alias("samples"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select("channel_id", "metric", F.unix_millis("window.start").alias("window_ms"), "samples", "total", "mean")


def inference_windows(df: DataFrame, width_ms: int = 10_000, delay: str = "10 seconds") -> DataFrame:
    """Scheduler counters and latencies per channel and window.

    Averages and P95 use the window's last 512 samples, which bounds what a window keeps.
    A channel's samples in a window are limited by its frame rate.
    """
    ran = ~F.col("replaced") & ~F.col("stale")
    grouped = _watermarked(_clock(df, "ts_ms"), delay).groupBy(F.window("event_time", f"{width_ms} milliseconds"), "channel_id")
    sample = F.struct("ts_ms", "frame_id", "npu_ms", "queue_wait_ms", "e2e_ms")
    counted = grouped.agg(
        F.count("*").alias("received"),
        F.count_if("replaced").alias("mailbox_replaced"),
        F.count_if("stale").alias("stale_dropped"),
        F.count_if("throttled").alias("throttled"),
        F.count_if(ran).alias("dispatched"),
        F.count_if(ran & F.col("success")).alias("completed"),
        F.count_if(ran & ~F.col("success")).alias("failed"),
        (F.coalesce(F.sum(F.when(ran, F.col("e2e_ms") - F.col("queue_wait_ms"))), F.lit(0.0)) / width_ms).alias("busy_ratio"),
        F.slice(F.sort_array(F.collect_list(F.when(ran, sample)), asc=False), 1, RING).alias("ring"),
    )
    n = F.size("ring")

    def mean(field: str) -> Column:
        total = F.aggregate(F.transform("ring", lambda s: s[field]), F.lit(0.0), lambda a, v: a + v)
        return F.when(n > 0, total / n).otherwise(0.0)

    def p95(field: str) -> Column:
        values = F.sort_array(F.transform("ring", lambda s: s[field]))
        return F.coalesce(F.try_element_at(values, F.greatest(F.lit(1), F.ceil(F.round(n * 0.95, 6)).cast("int"))), F.lit(0.0))

    return counted.select(
        F.unix_millis("window.start").alias("window_ms"), "channel_id", "received", "mailbox_replaced", "stale_dropped", "throttled",
        "dispatched", "completed", "failed", "busy_ratio", (F.col("completed") * 1000.0 / width_ms).alias("actual_fps"),
        mean("npu_ms").alias("npu_avg_ms"), p95("npu_ms").alias("npu_p95_ms"), mean("queue_wait_ms").alias("wait_avg_ms"),
        p95("queue_wait_ms").alias("wait_p95_ms"), p95("e2e_ms").alias("e2e_p95_ms"),
    )


def dedupe_stream(df: DataFrame, delay: str, keys: list[str] | None = None, time: str = "ts_ms") -> DataFrame:
    """Drop repeats of a frame that arrive within ``delay``; later rows than that are late."""
    keys = keys or ["channel_id", "frame_id"]
    clocked = _clock(df, time)
    out = clocked.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else clocked.dropDuplicates(keys)
    return out.drop("event_time")
