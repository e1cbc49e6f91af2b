"""Aggregates over detections, telemetry and motion samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxweave.functions import scalars as S
from boxweave.operators import windows as Wn
from boxweave.operators.filters import band_motion, valid_motion
from boxweave.operators.scan import Step, ordered_scan, value_block
from boxweave.session import broadcast_if_small, checkpointed

# Fixed value: latency samples kept for averages and percentiles.
RING = 512


#: Rank error of the sketch that brackets a percentile, as a share of the group (one in so many).
ACCURACY = 2000
_LOWEST, _HIGHEST = -1.7976931348623157e308, 1.7976931348623157e308


def _bracketed(df: DataFrame, keys: list[str], value: str, qs: list[float], plain: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Per group its size and, for each percentile, two values it lies between; and the counts of values, coarse outside of these.

    A mergeable sketch gives values that are off by one in ``ACCURACY`` of the ranks at most, so three times that to either side is
    enough; groups of a few thousand values are counted whole. What lies outside of all brackets is counted
    as one cell for each gap between them. The input is read twice.
    """
    margin = 3 / ACCURACY
    probes = sorted({min(1.0, max(0.0, p)) for q in qs for p in (q - margin, q + margin)})
    number = F.col(value).cast("double")
    sketch = df.groupBy(*keys).agg(
        F.count(value).alias("__total"), F.percentile_approx(number, probes, ACCURACY).alias("__p"), *[c.alias(n) for n, c in plain.items()]
    )
    small = F.col("__total") <= 2 * ACCURACY

    def bound(p: float, end: float) -> Column:
        inside = 0.0 < p < 1.0
        return F.when(small, F.lit(end)).otherwise(F.element_at("__p", probes.index(p) + 1)) if inside else F.lit(end)

    brackets = F.array(*[F.struct(bound(q - margin, _LOWEST).alias("low"), bound(q + margin, _HIGHEST).alias("high")) for q in qs])
    sketch = checkpointed(sketch.select(*keys, "__total", *plain, brackets.alias("__b")))
    met = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    rows = df.where(F.col(value).isNotNull()).select(*keys, number.alias("__v")).alias("r")
    joined = rows.join(broadcast_if_small(sketch.select(*keys, "__b")).alias("s"), reduce(and_, met)) if keys else rows.join(F.broadcast(sketch.select("__b")), F.lit(True))
    inside = F.exists("__b", lambda b: (F.col("__v") >= b["low"]) & (F.col("__v") <= b["high"]))
    gap = F.aggregate("__b", F.lit(_LOWEST), lambda top, b: F.when(b["high"] < F.col("__v"), F.greatest(top, b["high"])).otherwise(top))
    cells = joined.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.when(inside, F.col("__v")).otherwise(gap).alias("__cell"), F.when(inside, 0).otherwise(1).alias("__out"))
    return sketch, cells.groupBy(*keys, "__cell", "__out").agg(F.count("*").alias("__n"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float | tuple[float, str]], method: str = "linear", plain: dict[str, Column] | None = None) -> DataFrame:
    """Exact percentiles without holding a group: ``linear`` at (n-1)q, ``nearest`` rank ceil(nq).

    A percentile may name its own method. ``plain`` are further aggregates of the same groups, made in the first of two
    readings. Values are counted between the brackets of a sketch only (see ``_bracketed``), the counts summed up by a
    block-wise scan; a rank outside of its bracket, which the sketch rules out, would be an error and no wrong value.
    """
    asked = {name: q if isinstance(q, tuple) else (q, method) for name, q in qs.items()}
    sketch, counted = _bracketed(df, keys, value, sorted({q for q, _ in asked.values()}), plain or {})
    # As a struct, a key is equal to itself where parts of it are null.
    key = (F.struct(*keys) if keys else F.lit(0)).alias("__key")
    counted = checkpointed(counted.select(key, "__cell", "__out", "__n"))
    scanned = ordered_scan(counted, ["__key"], [value_block("__cell")], [F.col("__cell"), F.col("__out")], [Step("__cum", "sum", F.col("__n"))])
    placed = sketch.select(key, "__total", *(plain or {})).join(scanned, "__key", "left" if plain else "inner")
    first, last, total = F.col("__cum") - F.col("__n"), F.col("__cum") - 1, F.col("__total")
    value_here = F.when(F.col("__out") == 0, F.col("__cell")).otherwise(F.raise_error(F.lit("percentile outside of its bracket")).cast("double"))

    def at(index: Column) -> Column:
        return F.max(F.when(index.between(first, last), value_here))

    aggs, outs = [], []
    for name, (q, how) in asked.items():
        if how == "nearest":
            index = F.greatest(F.lit(0), F.ceil(F.round(total * q, 9)) - 1)
            aggs.append(at(index).alias(f"__{name}"))
            outs.append(F.col(f"__{name}").alias(name))
        else:
            position = (total - 1) * F.lit(q)
            low, high = F.floor(position), F.ceil(position)
            aggs += [at(low).alias(f"__lo_{name}"), at(high).alias(f"__hi_{name}"), F.max(position - low).alias(f"__f_{name}")]
            lo, hi, f = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__f_{name}")
            outs.append((lo * (1 - f) + hi * f).alias(name))
    grouped = placed.groupBy("__key").agg(*[F.first(n).alias(n) for n in plain or {}], *aggs)
    return grouped.select(*[F.col(f"__key.{k}").alias(k) for k in keys], *(plain or {}), *outs)


def summarize_objects(df: DataFrame, by: list[str]) -> DataFrame:
    """Count and best score (two decimals) of each label per frame."""
    return df.groupBy(*by, "label").agg(
        F.count("*").alias("count"), (F.floor(F.max("score") * 100 + 0.5) / 100).alias("score")
    )


def summary_json(summary: DataFrame, by: list[str]) -> DataFrame:
    """Label-ordered JSON array per frame, the key by which reports are compared."""
    objects = F.sort_array(F.collect_list(F.struct("label", "count", "score")))
    return summary.groupBy(*by).agg(F.to_json(objects).alias("summary_key"), F.sum("count").alias("n_objects"))


def frame_reports(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """One report row per frame, ``[]`` for frames without boxes."""
    by = ["channel_id", "frame_id"]
    joined = frames.join(summary_json(summarize_objects(detections, by), by), by, "left")
    return joined.withColumns(
        {"summary_key": F.coalesce("summary_key", F.lit("[]")), "n_objects": F.coalesce("n_objects", F.lit(0))}
    )


def overlap_summary(pairs: DataFrame) -> DataFrame:
    """Overlapping pairs per channel and the worst of them."""
    per_frame = pairs.groupBy("channel_id", "frame_id").agg(
        F.count("*").alias("n"), F.max("ios").alias("ios"), F.max("iou").alias("iou")
    )
    return per_frame.groupBy("channel_id").agg(
        F.sum("n").alias("pairs"),
        F.count("*").alias("frames"),
        F.round(F.max("ios"), 6).alias("worst_ios"),
        F.round(F.max("iou"), 6).alias("worst_iou"),
    )


def ring_percentile(df: DataFrame, by: list[str], value: str, q: float, order: str, ring: int = RING) -> DataFrame:
    """Nearest-rank percentile of the last ``ring`` samples of each group.

    The ring is a top-k per group, which Spark cuts before the shuffle; at most ``ring``
    values meet in a group.
    """
    newest = df.withColumn("__no", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).where(F.col("__no") <= ring)
    return newest.groupBy(*by).agg(nearest_rank(value, q).alias("value"), F.count("*").alias("samples"))


def nearest_rank(value: str, q: float) -> Column:
    """Nearest-rank percentile, an aggregate for groups of bounded size (a ring)."""
    values = F.sort_array(F.collect_list(value))
    return F.element_at(values, F.greatest(F.lit(1), F.ceil(F.round(F.size(values) * F.lit(q), 6)).cast("int")))


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, nearest-rank P90, least and most."""
    plain = {"mean": F.avg(value), "min": F.min(value), "max": F.max(value)}
    return exact_quantiles(df, by, value, {"median": 0.5, "p90": (0.9, "nearest")}, plain=plain)


def inference_stats(df: DataFrame, window_ms: int = 10_000) -> DataFrame:
    """Scheduler counters per window and channel, and over all channels (``*``).

    Averages and percentiles use the last 512 samples of the window, as a ring does.
    """
    start = F.floor(F.col("ts_ms") / window_ms) * window_ms
    levels = df.withColumn("window_ms", start.cast("long")).withColumn(
        "level", F.explode(F.array(F.col("channel_id"), F.lit("*")))
    )
    by = ["window_ms", "level"]
    ran = ~F.col("replaced") & ~F.col("stale")
    busy = F.when(ran, F.col("e2e_ms") - F.col("queue_wait_ms"))
    counts = levels.groupBy(*by).agg(
        F.count("*").alias("received"),
        F.count_if("replaced").alias("mailbox_replaced"),
        F.count_if("stale").alias("stale_dropped"),
        F.count_if("throttled").alias("throttled"),
        F.count_if(ran).alias("dispatched"),
        F.count_if(ran & F.col("success")).alias("completed"),
        F.count_if(ran & ~F.col("success")).alias("failed"),
        (F.coalesce(F.sum(busy), F.lit(0.0)) / window_ms).alias("busy_ratio"),
    )
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("ts_ms").desc(), F.col("frame_id").desc()))
    ring = levels.where(ran).withColumn("__no", newest).where(F.col("__no") <= RING)
    samples = ring.groupBy(*by).agg(
        F.avg("npu_ms").alias("npu_avg_ms"),
        nearest_rank("npu_ms", 0.95).alias("npu_p95_ms"),
        F.avg("queue_wait_ms").alias("wait_avg_ms"),
        nearest_rank("queue_wait_ms", 0.95).alias("wait_p95_ms"),
        nearest_rank("e2e_ms", 0.95).alias("e2e_p95_ms"),
    )
    zero = {c: 0.0 for c in ("npu_avg_ms", "npu_p95_ms", "wait_avg_ms", "wait_p95_ms", "e2e_p95_ms")}
    out = counts.join(samples, by, "left").fillna(zero)
    return out.withColumn("actual_fps", F.col("completed") * 1000.0 / window_ms).withColumnRenamed("level", "channel_id")


def frame_medians(df: DataFrame, by: list[str]) -> DataFrame:
    """Median centre and size (at least one pixel) of a frame's boxes, a group the model head bounds."""
    x1, y1, x2, y2 = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    one = F.lit(1.0)
    return df.groupBy(*by).agg(
        S.pctl((x1 + x2) * 0.5, 0.5).alias("median_cx"),
        S.pctl((y1 + y2) * 0.5, 0.5).alias("median_cy"),
        S.pctl(F.greatest(x2 - x1, one), 0.5).alias("median_w"),
        S.pctl(F.greatest(y2 - y1, one), 0.5).alias("median_h"),
    )


def motion_report(samples: DataFrame, low: float = 0.35, high: float = 0.75) -> DataFrame:
    """Motion quality of each run: jitter, lag, jumps, reversals and track turnover."""
    valid = band_motion(valid_motion(samples), low, high)
    still, moving = F.col("band") == "stationary", F.col("band") == "moving"
    plain = valid.groupBy("run_id").agg(
        F.count("*").alias("samples"),
        F.min_by("pts_ms", F.struct("pts_ms", "frame_id")).alias("__first"),
        F.max_by("pts_ms", F.struct("pts_ms", "frame_id")).alias("__last"),
        F.count_if(still).alias("stationary_samples"),
        F.count_if(moving).alias("moving_samples"),
        *[
            S.rms(F.when(still, F.col(c))).alias(f"__{c}")
            for c in ("raw_step_ratio", "smooth_step_ratio", "raw_size_step", "smooth_size_step")
        ],
        F.sum("created").alias("__created"),
        F.sum("lost").alias("__lost"),
        F.avg("stable_tracks").alias("mean_stable_tracks"),
    )
    lag = Wn.equivalent_lag(valid.where(moving)).select("run_id", F.lit("lag").alias("metric"), F.col("lag_ms").alias("value"))
    steps = valid.select(
        "run_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("all").alias("metric"), F.col("smooth_step_ratio").alias("value")),
                    F.when(still, F.struct(F.lit("still").alias("metric"), F.col("smooth_step_ratio").alias("value"))),
                    F.when(moving, F.struct(F.lit("moving").alias("metric"), F.col("smooth_step_ratio").alias("value"))),
                )
            )
        ).alias("m"),
    ).select("run_id", "m.metric", "m.value")
    ranks = exact_quantiles(lag.unionByName(steps), ["run_id", "metric"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95})

    def pick(metric: str, q: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(q)))

    wide = ranks.groupBy("run_id").agg(
        (pick("still", "p90") * 100).alias("static_center_smooth_p90_pct_diag"),
        pick("lag", "p50").alias("moving_equivalent_lag_p50_ms"),
        pick("lag", "p90").alias("moving_equivalent_lag_p90_ms"),
        (pick("moving", "p90") * 100).alias("moving_smooth_step_p90_pct_diag"),
        (pick("all", "p95") * 100).alias("overall_smooth_step_p95_pct_diag"),
    )
    counts = {f"__{side}_{k}": c for side in ("raw", "smooth") for k, c in zip(("eligible", "turns"), Wn.turn_counts(side))}
    steps_back = Wn.neighbours(valid).groupBy("run_id").agg(*[c.alias(n) for n, c in counts.items()], Wn.set_changes().alias("__changes"))

    def rate(side: str) -> Column:
        eligible = F.col(f"__{side}_eligible")
        return F.when(eligible > 0, F.col(f"__{side}_turns") * 100.0 / eligible).alias(f"{side}_direction_reversal_rate_pct")

    seen = samples.groupBy("run_id").agg(F.count("*").alias("__seen"))
    out = plain.join(seen, "run_id")
    for other in (wide, steps_back):
        out = out.join(other, "run_id", "left")
    duration = F.greatest(F.lit(0.0), (F.col("__last") - F.col("__first")) / 1000.0)
    minutes = F.greatest(F.col("duration_sec") / 60.0, F.lit(1e-9))
    c = F.col
    return out.withColumn("duration_sec", duration).select(
        "run_id",
        "samples",
        (c("__seen") - c("samples")).alias("discarded_timing_samples"),
        "duration_sec",
        "stationary_samples",
        "moving_samples",
        F.lit(low).alias("stationary_speed_threshold_diag_per_sec"),
        F.lit(high).alias("moving_speed_threshold_diag_per_sec"),
        (c("__raw_step_ratio") * 100).alias("static_center_raw_rms_pct_diag"),
        (c("__smooth_step_ratio") * 100).alias("static_center_smooth_rms_pct_diag"),
        (-S.safe_change(c("__raw_step_ratio"), c("__smooth_step_ratio"))).alias("static_center_smoothing_reduction_pct"),
        "static_center_smooth_p90_pct_diag",
        (c("__raw_size_step") * 100).alias("static_size_raw_rms_pct"),
        (c("__smooth_size_step") * 100).alias("static_size_smooth_rms_pct"),
        (-S.safe_change(c("__raw_size_step"), c("__smooth_size_step"))).alias("static_size_smoothing_reduction_pct"),
        "moving_equivalent_lag_p50_ms",
        "moving_equivalent_lag_p90_ms",
        "moving_smooth_step_p90_pct_diag",
        "overall_smooth_step_p95_pct_diag",
        rate("raw"),
        rate("smooth"),
        (c("__changes") * 100.0 / F.greatest(F.lit(1), c("samples") - 1)).alias("track_set_change_rate_pct"),
        (c("__created") / minutes).alias("created_tracks_per_min"),
        (c("__lost") / minutes).alias("lost_tracks_per_min"),
        "mean_stable_tracks",
    )


# Counters summed over a run, and the metrics of the encoder with their percentile.
DROP_COUNTERS = ["enc_drop", "put_fail", "out_drop", "write_fail", "infer_drop"]
ENCODER_QUANTILES = {"packet_fps": ("encode_fps_p50", 0.5), "bitrate_kbps": ("bitrate_kbps_p50", 0.5), "pts_delta_ms": ("pts_delta_ms_p90", 0.9)}
LAST_WINDOW = {
    ("EncodeStats", "input_fps"): "input_fps",
    ("EncodeStats", "packet_fps"): "packet_fps",
    ("EncodeStats", "bitrate_kbps"): "bitrate_kbps",
    ("EncodeStats", "avg_process_ms"): "avg_process_ms",
    ("EncodeStats", "put_fail"): "put_fail",
    ("EncodeStats", "out_drop"): "out_drop",
    ("StreamStats", "output_fps"): "stream_fps",
    ("StreamStats", "bitrate_kbps"): "stream_bitrate_kbps",
    ("StreamStats", "write_fail"): "write_fail",
}


def runtime_report(telemetry: DataFrame, by: list[str], mode: str = "summary", encoder: str = "EncodeStats",
                   quantiles: dict | None = None, counters: list[str] | None = None) -> DataFrame:
    """Runtime counters of each run from (source, metric, value, seq) rows.

    ``summary``: encoder percentiles and summed drops. ``last``: the newest window's
    values, with ``pace_drop`` summed.
    """
    if mode == "last":
        named = F.coalesce(*[
            F.when((F.col("source") == s) & (F.col("metric") == m), F.lit(n)) for (s, m), n in LAST_WINDOW.items()
        ])
        aggs = [
            F.coalesce(F.max_by(F.when(F.col("__as") == n, F.col("value")), F.when(F.col("__as") == n, F.col("seq"))), F.lit(0.0)).alias(n)
            for n in LAST_WINDOW.values()
        ]
        pace = F.coalesce(F.sum(F.when(F.col("metric") == "pace_drop", F.col("value"))), F.lit(0.0)).alias("pace_drop")
        return telemetry.withColumn("__as", named).groupBy(*by).agg(*aggs, pace)
    quantiles = quantiles or ENCODER_QUANTILES
    counters = DROP_COUNTERS if counters is None else counters
    sums = telemetry.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("metric") == c, F.col("value"))), F.lit(0.0)).alias(c) for c in counters]
    )
    wanted = telemetry.where((F.col("source") == encoder) & F.col("metric").isin(list(quantiles)))
    ranks = exact_quantiles(wanted, [*by, "metric"], "value", {f"q{i}": q for i, (_, q) in enumerate(quantiles.values())})
    wide = ranks.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(f"q{i}"))).alias(n) for i, (m, (n, _)) in enumerate(quantiles.items())]
    )
    return sums.join(wide, by, "left")


# What an A/B comparison looks at; lower is better in all of them.
COMPARED = [
    "static_center_smooth_rms_pct_diag",
    "static_size_smooth_rms_pct",
    "moving_equivalent_lag_p90_ms",
    "moving_smooth_step_p90_pct_diag",
    "track_set_change_rate_pct",
    "created_tracks_per_min",
]


def _long(report: DataFrame, metrics: list[str], side: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(side)) for m in metrics])
    return report.select(F.explode(pairs).alias("m")).select("m.metric", f"m.{side}")


def compare_runs(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row per compared metric of two one-row reports: change, verdict and comparability gaps."""
    gaps = ["duration_sec", "stationary_samples", "moving_samples"]
    left, right = _long(base, COMPARED + gaps, "before"), _long(candidate, COMPARED + gaps, "after")
    both = left.join(right, "metric")
    change = S.safe_change(F.col("before"), F.col("after"))
    floor = F.when(F.col("metric") == "duration_sec", 1e-9).otherwise(1.0)
    gap = F.abs(F.col("after") - F.col("before")) / F.greatest(F.col("before"), floor)
    is_gap = F.col("metric").isin(gaps)
    limit = F.when(F.col("metric") == "duration_sec", 0.05).otherwise(0.10)
    verdict = (
        F.when(is_gap, F.when(gap > limit, "not comparable").otherwise("comparable"))
        .when(change.isNull(), "n/a")
        .when(change < 0, "improved")
        .otherwise("regressed")
    )
    return both.select("metric", "before", "after", F.when(is_gap, gap * 100).otherwise(change).alias("change_pct"), verdict.alias("verdict"))


def quality_warnings(report: DataFrame) -> DataFrame:
    """Reasons to distrust a motion report, one row each."""
    c = F.col
    cols = set(report.columns)
    rules = [
        F.when(c("stationary_samples") < 20, "few stationary samples"),
        F.when(c("moving_samples") < 20, "few moving samples"),
        F.when(c("duration_sec") < 20.0, "short duration"),
    ]
    if "enc_drop" in cols:
        rules.append(F.when(c("enc_drop") > 0, "encoder input drops"))
    failures = [x for x in ("put_fail", "out_drop", "write_fail") if x in cols]
    if failures:
        total = sum((F.coalesce(c(x), F.lit(0.0)) for x in failures[1:]), F.coalesce(c(failures[0]), F.lit(0.0)))
        rules.append(F.when(total > 0, "encode or stream failures"))
    return report.select("run_id", F.explode(F.array_compact(F.array(*rules))).alias("warning"))


def psnr(mse: Column) -> Column:
    """Peak signal to noise for 8-bit pixels; 100 dB for equal pictures."""
    return F.when(mse == 0, F.lit(100.0)).otherwise(20.0 * F.log10(F.lit(255.0) / F.sqrt(mse)))
