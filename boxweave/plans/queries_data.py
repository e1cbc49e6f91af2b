"""Queries for telemetry, motion metrics, replays, logs and data sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxweave.functions import scalars as S
from boxweave.operators import aggregates as A
from boxweave.operators import dataset as D
from boxweave.operators import filters as P
from boxweave.operators import joins as J
from boxweave.operators import replay as X
from boxweave.operators import windows as Wn
from boxweave.plans import sql as Q
from boxweave.plans.registry import query, r6
from boxweave.plans.views import LABELS, view
from boxweave.plans.views import with_views as W
from boxweave.sources import logs as L
from boxweave.sources import readers as Rd
from boxweave.sources import sinks as K
from boxweave.session import checkpointed

# ---------------------------------------------------------------- percentiles and telemetry


@query("percentiles_linear", W("SELECT metric, ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.9), 6) AS p90, ROUND(quantile_cont(value, 0.99), 6) AS p99 FROM telemetry GROUP BY metric", "telemetry"))
def _(spark, sf):
    out = A.exact_quantiles(view(spark, sf, "telemetry"), ["metric"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("metric", r6("p50"), r6("p90"), r6("p99"))


@query("percentiles_nearest", W("SELECT channel_id, metric, quantile_disc(value, 0.95) AS p95 FROM telemetry GROUP BY ALL", "telemetry"))
def _(spark, sf):
    return A.exact_quantiles(view(spark, sf, "telemetry"), ["channel_id", "metric"], "value", {"p95": 0.95}, "nearest")


@query("pctl_rms", W("SELECT channel_id, metric, ROUND(quantile_cont(value, 0.9), 6) AS p90, ROUND(sqrt(avg(value * value)), 6) AS rms FROM telemetry GROUP BY ALL", "telemetry"))
def _(spark, sf):
    t = view(spark, sf, "telemetry")
    return t.groupBy("channel_id", "metric").agg(r6(S.pctl(F.col("value"), 0.9), "p90"), r6(S.rms(F.col("value")), "rms"))


@query("ring_percentile", W("+n AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY event_id DESC) AS k FROM telemetry), s AS (SELECT channel_id, list(value ORDER BY value) AS v FROM n WHERE k <= 512 GROUP BY 1) SELECT channel_id, v[ceil(len(v) * 0.95)::INT] AS value, len(v) AS samples FROM s", "telemetry"))
def _(spark, sf):
    return A.ring_percentile(view(spark, sf, "telemetry"), ["channel_id"], "value", 0.95, "event_id")


@query("latency_summary", W("SELECT channel_id, ROUND(avg(npu_ms), 6) AS mean, ROUND(quantile_cont(npu_ms, 0.5), 6) AS median, quantile_disc(npu_ms, 0.9) AS p90, min(npu_ms) AS min, max(npu_ms) AS max FROM inference_results GROUP BY 1", "inference_results"))
def _(spark, sf):
    out = A.latency_summary(view(spark, sf, "inference_results"), ["channel_id"], "npu_ms")
    return out.select("channel_id", r6("mean"), r6("median"), "p90", "min", "max")


STATS_SQL = """+lv AS (SELECT (ts_ms // 30000) * 30000 AS window_ms, channel_id AS lvl, * FROM inference_results UNION ALL SELECT (ts_ms // 30000) * 30000, '*', * FROM inference_results),
  ct AS (SELECT window_ms, lvl, count(*) AS received, count(*) FILTER (replaced) AS mailbox_replaced, count(*) FILTER (stale) AS stale_dropped, count(*) FILTER (throttled) AS throttled,
    count(*) FILTER (NOT replaced AND NOT stale) AS dispatched, count(*) FILTER (NOT replaced AND NOT stale AND success) AS completed, count(*) FILTER (NOT replaced AND NOT stale AND NOT success) AS failed,
    coalesce(sum(e2e_ms - queue_wait_ms) FILTER (NOT replaced AND NOT stale), 0) / 30000 AS busy_ratio FROM lv GROUP BY 1, 2),
  rg AS (SELECT *, row_number() OVER (PARTITION BY window_ms, lvl ORDER BY ts_ms DESC, frame_id DESC) AS k FROM lv WHERE NOT replaced AND NOT stale),
  sm AS (SELECT window_ms, lvl, avg(npu_ms) AS npu_avg_ms, list(npu_ms ORDER BY npu_ms) AS v1, avg(queue_wait_ms) AS wait_avg_ms, list(queue_wait_ms ORDER BY queue_wait_ms) AS v2, list(e2e_ms ORDER BY e2e_ms) AS v3 FROM rg WHERE k <= 512 GROUP BY 1, 2)
  SELECT window_ms, lvl AS channel_id, received, mailbox_replaced, stale_dropped, throttled, dispatched, completed, failed, ROUND(busy_ratio, 6) AS busy_ratio, ROUND(completed / 30.0, 6) AS actual_fps,
    ROUND(coalesce(npu_avg_ms, 0), 6) AS npu_avg_ms, coalesce(v1[ceil(round(len(v1) * 0.95, 6))::INT], 0) AS npu_p95_ms, ROUND(coalesce(wait_avg_ms, 0), 6) AS wait_avg_ms, coalesce(v2[ceil(round(len(v2) * 0.95, 6))::INT], 0) AS wait_p95_ms, coalesce(v3[ceil(round(len(v3) * 0.95, 6))::INT], 0) AS e2e_p95_ms
  FROM ct LEFT JOIN sm USING (window_ms, lvl)"""


@query("inference_stats", W(STATS_SQL, "inference_results"))
def _(spark, sf):
    out = A.inference_stats(view(spark, sf, "inference_results"), 30_000)
    rounded = {"busy_ratio", "actual_fps", "npu_avg_ms", "wait_avg_ms"}
    return out.select(*[r6(c) if c in rounded else F.col(c) for c in out.columns])


@query("frame_medians", W("SELECT frame_id, quantile_cont((x1 + x2) * 0.5, 0.5) AS median_cx, quantile_cont((y1 + y2) * 0.5, 0.5) AS median_cy, quantile_cont(greatest(x2 - x1, 1.0), 0.5) AS median_w, quantile_cont(greatest(y2 - y1, 1.0), 0.5) AS median_h FROM detections GROUP BY 1", "detections"))
def _(spark, sf):
    return A.frame_medians(view(spark, sf, "detections"), ["frame_id"])


@query("runtime_report", W("""SELECT channel_id, coalesce(sum(value) FILTER (metric = 'click'), 0) AS click, coalesce(sum(value) FILTER (metric = 'error'), 0) AS error,
   ROUND(quantile_cont(value, 0.5) FILTER (metric = 'purchase'), 6) AS fps_p50, ROUND(quantile_cont(value, 0.9) FILTER (metric = 'signup'), 6) AS delta_p90 FROM (SELECT * REPLACE (round(value * 100)::BIGINT AS value) FROM telemetry) GROUP BY 1""", "telemetry"))
def _(spark, sf):
    t = view(spark, sf, "telemetry").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    out = A.runtime_report(t, ["channel_id"], quantiles={"purchase": ("fps_p50", 0.5), "signup": ("delta_p90", 0.9)}, counters=["click", "error"])
    return out.select("channel_id", F.col("click").cast("double").alias("click"), F.col("error").cast("double").alias("error"), r6("fps_p50"), r6("delta_p90"))


RENAMED = "CASE metric WHEN 'click' THEN 'pace_drop' WHEN 'view' THEN 'enc_drop' WHEN 'error' THEN 'output_fps' WHEN 'purchase' THEN 'packet_fps' ELSE 'bitrate_kbps' END"


@query("runtime_report_last", W(f"""+t AS (SELECT channel_id, event_id, source, {RENAMED} AS m, value FROM telemetry)
  SELECT channel_id, arg_max(value, event_id) FILTER (m = 'packet_fps') AS packet_fps, arg_max(value, event_id) FILTER (m = 'bitrate_kbps') AS bitrate_kbps,
    arg_max(value, event_id) FILTER (m = 'output_fps') AS stream_fps, ROUND(sum(value) FILTER (m = 'pace_drop'), 4) AS pace_drop FROM t GROUP BY 1""", "telemetry"))
def _(spark, sf):
    t = view(spark, sf, "telemetry").withColumn("metric", F.expr(RENAMED)).withColumnRenamed("event_id", "seq")
    out = A.runtime_report(t, ["channel_id"], mode="last")
    return out.select("channel_id", "packet_fps", "bitrate_kbps", "stream_fps", F.round("pace_drop", 4).alias("pace_drop"))


@query("telemetry_windows", W("SELECT channel_id, metric, (ts_ms // 3600000) * 3600000 AS window_ms, count(*) AS samples, ROUND(sum(value), 4) AS total, ROUND(avg(value), 6) AS mean FROM telemetry GROUP BY ALL", "telemetry"))
def _(spark, sf):
    from boxweave.streaming.stateless import telemetry_windows

    out = telemetry_windows(view(spark, sf, "telemetry"), "1 hour")
    return out.select("channel_id", "metric", "window_ms", "samples", F.round("total", 4).alias("total"), r6("mean"))


# ---------------------------------------------------------------- motion metrics

VALID = "va AS (SELECT *, raw_step_ratio * 1000.0 / dt_ms AS v FROM motion_stats WHERE dt_ms BETWEEN 10 AND 250 AND stable_tracks > 0)"
REV = """rv_{s} AS (SELECT run_id, count(*) FILTER (ok) AS eligible, count(*) FILTER (ok AND {s}_dx * px + {s}_dy * py < 0) AS reversals FROM (
    SELECT *, pids = stable_ids AND sqrt({s}_dx * {s}_dx + {s}_dy * {s}_dy) > 0.5 AND sqrt(px * px + py * py) > 0.5 AS ok FROM (
      SELECT *, lag({s}_dx) OVER w AS px, lag({s}_dy) OVER w AS py, lag(stable_ids) OVER w AS pids FROM va WINDOW w AS (PARTITION BY run_id ORDER BY pts_ms))) GROUP BY 1)"""
CHG = "ch AS (SELECT run_id, count(*) FILTER (before <> active_ids) AS changes, count(*) AS n FROM (SELECT *, lag(active_ids) OVER (PARTITION BY run_id ORDER BY pts_ms) AS before FROM va) GROUP BY 1)"
LAG = "lg AS (SELECT run_id, frame_id, al / st * dt_ms AS lag_ms FROM (SELECT *, sqrt(raw_dx * raw_dx + raw_dy * raw_dy) AS st, ((raw_center_x - smooth_center_x) * raw_dx + (raw_center_y - smooth_center_y) * raw_dy) / nullif(sqrt(raw_dx * raw_dx + raw_dy * raw_dy), 0) AS al FROM va WHERE v >= 0.75) WHERE st > 1e-6 AND al > 0)"


def _valid(spark, sf):
    return P.valid_motion(view(spark, sf, "motion_stats"))


@query("reversal_rate", W(f"+{VALID}, {REV.format(s='raw')} SELECT run_id, eligible, reversals, ROUND(reversals * 100.0 / eligible, 6) AS rate_pct FROM rv_raw", "motion_stats"))
def _(spark, sf):
    return Wn.reversal_rate(_valid(spark, sf), smooth=False, block_ms=60_000).select("run_id", "eligible", "reversals", r6("rate_pct"))


@query("track_set_change_rate", W(f"+{VALID}, {CHG} SELECT run_id, changes, n AS samples, ROUND(changes * 100.0 / greatest(1, n - 1), 6) AS rate_pct FROM ch", "motion_stats"))
def _(spark, sf):
    return Wn.track_set_change_rate(_valid(spark, sf), block_ms=60_000).select("run_id", "changes", "samples", r6("rate_pct"))


@query("equivalent_lag", W(f"+{VALID}, {LAG} SELECT run_id, frame_id, ROUND(lag_ms, 6) AS lag_ms FROM lg", "motion_stats"))
def _(spark, sf):
    moving = P.band_motion(_valid(spark, sf)).where("band = 'moving'")
    return Wn.equivalent_lag(moving).select("run_id", "frame_id", r6("lag_ms"))


REPORT_SQL = f"""+{VALID}, {REV.format(s='raw')}, {REV.format(s='smooth')}, {CHG}, {LAG},
  lq AS (SELECT run_id, quantile_cont(lag_ms, 0.5) AS l50, quantile_cont(lag_ms, 0.9) AS l90 FROM lg GROUP BY 1),
  sn AS (SELECT run_id, count(*) AS seen FROM motion_stats GROUP BY 1),
  ag AS (SELECT run_id, count(*) AS samples, greatest(0.0, (max(pts_ms) - min(pts_ms)) / 1000.0) AS duration_sec, count(*) FILTER (v <= 0.35) AS stationary_samples, count(*) FILTER (v >= 0.75) AS moving_samples,
    sqrt(avg(raw_step_ratio * raw_step_ratio) FILTER (v <= 0.35)) AS rs, sqrt(avg(smooth_step_ratio * smooth_step_ratio) FILTER (v <= 0.35)) AS ss,
    sqrt(avg(raw_size_step * raw_size_step) FILTER (v <= 0.35)) AS rz, sqrt(avg(smooth_size_step * smooth_size_step) FILTER (v <= 0.35)) AS sz,
    quantile_cont(smooth_step_ratio, 0.9) FILTER (v <= 0.35) AS q1, quantile_cont(smooth_step_ratio, 0.9) FILTER (v >= 0.75) AS q2, quantile_cont(smooth_step_ratio, 0.95) AS q3,
    sum(created) AS cr, sum(lost) AS lo, avg(stable_tracks) AS mean_stable_tracks FROM va GROUP BY 1),
  rp AS (SELECT run_id, samples, seen - samples AS discarded_timing_samples, duration_sec, stationary_samples, moving_samples,
    CAST(0.35 AS DOUBLE) AS stationary_speed_threshold_diag_per_sec, CAST(0.75 AS DOUBLE) AS moving_speed_threshold_diag_per_sec,
    rs * 100 AS static_center_raw_rms_pct_diag, ss * 100 AS static_center_smooth_rms_pct_diag, -(ss - rs) / rs * 100 AS static_center_smoothing_reduction_pct, q1 * 100 AS static_center_smooth_p90_pct_diag,
    rz * 100 AS static_size_raw_rms_pct, sz * 100 AS static_size_smooth_rms_pct, -(sz - rz) / rz * 100 AS static_size_smoothing_reduction_pct,
    l50 AS moving_equivalent_lag_p50_ms, l90 AS moving_equivalent_lag_p90_ms, q2 * 100 AS moving_smooth_step_p90_pct_diag, q3 * 100 AS overall_smooth_step_p95_pct_diag,
    a.reversals * 100.0 / a.eligible AS raw_direction_reversal_rate_pct, b.reversals * 100.0 / b.eligible AS smooth_direction_reversal_rate_pct, changes * 100.0 / greatest(1, n - 1) AS track_set_change_rate_pct,
    cr / greatest(duration_sec / 60.0, 1e-9) AS created_tracks_per_min, lo / greatest(duration_sec / 60.0, 1e-9) AS lost_tracks_per_min, mean_stable_tracks
    FROM ag JOIN sn USING (run_id) LEFT JOIN lq USING (run_id) LEFT JOIN rv_raw a USING (run_id) LEFT JOIN rv_smooth b USING (run_id) LEFT JOIN ch USING (run_id))"""
REPORT_INTS = ["samples", "discarded_timing_samples", "stationary_samples", "moving_samples"]


@query("motion_report", W(REPORT_SQL + " SELECT run_id, " + ", ".join(REPORT_INTS) + ", ROUND(COLUMNS(c -> c NOT IN ('run_id', 'samples', 'discarded_timing_samples', 'stationary_samples', 'moving_samples')), 5) FROM rp".replace("c ->", "lambda c:"), "motion_stats"))
def _(spark, sf):
    out = A.motion_report(view(spark, sf, "motion_stats"))
    return out.select(*[c if c in ("run_id", *REPORT_INTS) else F.round(c, 5).alias(c) for c in out.columns])


COMPARE_PAIRS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST(a.{m} AS DOUBLE) AS before, CAST(b.{m} AS DOUBLE) AS after FROM rp a, rp b WHERE a.run_id = 'run0' AND b.run_id = 'run1'"
    for m in [*A.COMPARED, "duration_sec", "stationary_samples", "moving_samples"]
)
COMPARE_SQL = f""", pr AS ({COMPARE_PAIRS}), g AS (SELECT *, metric IN ('duration_sec', 'stationary_samples', 'moving_samples') AS is_gap,
    abs(after - before) / greatest(before, CASE WHEN metric = 'duration_sec' THEN 1e-9 ELSE 1.0 END) AS gap, (after - before) / before * 100 AS change FROM pr)
  SELECT metric, ROUND(before, 5) AS before, ROUND(after, 5) AS after, ROUND(CASE WHEN is_gap THEN gap * 100 ELSE change END, 5) AS change_pct,
    CASE WHEN is_gap THEN CASE WHEN gap > CASE WHEN metric = 'duration_sec' THEN 0.05 ELSE 0.1 END THEN 'not comparable' ELSE 'comparable' END WHEN change < 0 THEN 'improved' ELSE 'regressed' END AS verdict FROM g"""


@query("compare_runs", W(REPORT_SQL + COMPARE_SQL, "motion_stats"))
def _(spark, sf):
    report = checkpointed(A.motion_report(view(spark, sf, "motion_stats")))
    out = A.compare_runs(report.where("run_id = 'run0'"), report.where("run_id = 'run1'"))
    return out.select("metric", *[F.round(c, 5).alias(c) for c in ("before", "after", "change_pct")], "verdict")


RUN_OF = "CASE WHEN frame_id % 200 = 7 THEN concat('part', CAST(FLOOR(frame_id / 2000) AS BIGINT)) ELSE run_id END"


@query("quality_warnings", W(f"""+{VALID.replace('FROM motion_stats', f'FROM (SELECT * REPLACE ({RUN_OF} AS run_id) FROM motion_stats)')},
  a AS (SELECT run_id, count(*) FILTER (v <= 0.35) AS s, count(*) FILTER (v >= 0.75) AS m, (max(pts_ms) - min(pts_ms)) / 1000.0 AS d FROM va GROUP BY 1)
  SELECT run_id, 'few stationary samples' AS warning FROM a WHERE s < 20 UNION ALL SELECT run_id, 'few moving samples' FROM a WHERE m < 20 UNION ALL SELECT run_id, 'short duration' FROM a WHERE d < 20
  UNION ALL SELECT run_id, 'encoder input drops' FROM a WHERE s % 3 > 0 UNION ALL SELECT run_id, 'encode or stream failures' FROM a WHERE m % 2 > 0 OR s % 5 = 4""", "motion_stats"))
def _(spark, sf):
    report = A.motion_report(view(spark, sf, "motion_stats").withColumn("run_id", F.expr(RUN_OF)))
    drops = {"enc_drop": F.col("stationary_samples") % 3, "put_fail": F.col("moving_samples") % 2, "write_fail": F.when(F.col("stationary_samples") % 5 == 4, 1.0)}
    return A.quality_warnings(report.withColumns(drops))


MEASURES = ["raw_center_x", "raw_center_y", "smooth_center_x", "smooth_center_y", "raw_dx", "raw_dy", "smooth_dx", "smooth_dy", "raw_w", "raw_h", "smooth_w", "smooth_h",
            "center_gap", "center_gap_ratio", "delta_gap", "raw_step_ratio", "smooth_step_ratio", "raw_size_step", "smooth_size_step"]
UPD_SQL = """up AS (SELECT channel_id, frame_id, pts_ms, row_number() OVER w AS no, lag(pts_ms) OVER w AS ppts FROM (SELECT DISTINCT channel_id, frame_id, pts_ms FROM motion_tracks) WINDOW w AS (PARTITION BY channel_id ORDER BY frame_id)),
  mt AS (SELECT t.*, up.no, up.ppts FROM motion_tracks t JOIN up USING (channel_id, frame_id) WHERE was_active),
  lg AS (SELECT *, lag(no) OVER w AS pno, lag(raw_dx) OVER w AS pdx, lag(raw_dy) OVER w AS pdy, """ + ", ".join(f"lag({s}_{c}) OVER w AS p_{s}_{c}" for s in ("raw", "smooth") for c in ("x1", "y1", "x2", "y2")) + """ FROM mt WINDOW w AS (PARTITION BY channel_id, track_id ORDER BY no)),
  md AS (SELECT channel_id, frame_id, any_value(pts_ms) - any_value(ppts) AS dt_ms, count(*) AS matched_active, count(*) FILTER (pno = no - 1) AS stable_tracks,
    count(*) FILTER (pno = no - 1 AND (raw_dx <> 0 OR raw_dy <> 0) AND (pdx <> 0 OR pdy <> 0) AND raw_dx * pdx + raw_dy * pdy < 0) AS raw_reversals, """ + ", ".join(
    f"quantile_cont({e}, 0.5) FILTER (pno = no - 1) AS {n}"
    for p, q in (("", ""), ("p_", "p_")) for s in ("raw", "smooth")
    for e, n in ((f"({p}{s}_x1 + {p}{s}_x2) * 0.5", f"{q}{s}_cx"), (f"({p}{s}_y1 + {p}{s}_y2) * 0.5", f"{q}{s}_cy"), (f"greatest(1.0, {p}{s}_x2 - {p}{s}_x1)", f"{q}{s}_w"), (f"greatest(1.0, {p}{s}_y2 - {p}{s}_y1)", f"{q}{s}_h"))
) + " FROM lg GROUP BY channel_id, frame_id)"


@query("motion_stats", W(f"""+{UPD_SQL} SELECT channel_id, frame_id, dt_ms, matched_active, stable_tracks, raw_reversals,
   {Q.r6('raw_cx', 'raw_center_x')}, {Q.r6('raw_cy', 'raw_center_y')}, {Q.r6('smooth_cx', 'smooth_center_x')}, {Q.r6('smooth_cy', 'smooth_center_y')},
   {Q.r6('raw_cx - p_raw_cx', 'raw_dx')}, {Q.r6('raw_cy - p_raw_cy', 'raw_dy')}, {Q.r6('smooth_cx - p_smooth_cx', 'smooth_dx')}, {Q.r6('smooth_cy - p_smooth_cy', 'smooth_dy')},
   {Q.r6('raw_w', 'raw_w')}, {Q.r6('raw_h', 'raw_h')}, {Q.r6('smooth_w', 'smooth_w')}, {Q.r6('smooth_h', 'smooth_h')},
   {Q.r6(Q.hypot('raw_cx - smooth_cx', 'raw_cy - smooth_cy') + ' / greatest(1.0, ' + Q.hypot('raw_w', 'raw_h') + ')', 'center_gap_ratio')},
   {Q.r6(Q.hypot('(raw_cx - p_raw_cx) - (smooth_cx - p_smooth_cx)', '(raw_cy - p_raw_cy) - (smooth_cy - p_smooth_cy)'), 'delta_gap')},
   {Q.r6(Q.hypot('smooth_cx - p_smooth_cx', 'smooth_cy - p_smooth_cy') + ' / greatest(1.0, ' + Q.hypot('raw_w', 'raw_h') + ')', 'smooth_step_ratio')},
   {Q.r6(Q.hypot('ln(raw_w / p_raw_w)', 'ln(raw_h / p_raw_h)'), 'raw_size_step')}, {Q.r6(Q.hypot('raw_cx - smooth_cx', 'raw_cy - smooth_cy'), 'center_gap')},
   {Q.r6(Q.hypot('raw_cx - p_raw_cx', 'raw_cy - p_raw_cy') + ' / greatest(1.0, ' + Q.hypot('raw_w', 'raw_h') + ')', 'raw_step_ratio')},
   {Q.r6(Q.hypot('ln(smooth_w / p_smooth_w)', 'ln(smooth_h / p_smooth_h)'), 'smooth_size_step')} FROM md WHERE stable_tracks > 0""", "motion_tracks"))
def _(spark, sf):
    t = view(spark, sf, "motion_tracks")
    out = Wn.motion_stats(t.where("was_active"), t.select("channel_id", "frame_id", "pts_ms").distinct(), block=50)
    return out.select("channel_id", "frame_id", "dt_ms", "matched_active", "stable_tracks", "raw_reversals", *[r6(c) for c in MEASURES])


MOTION_SQL = """lt AS (SELECT *, (raw_x1 + raw_x2) * 0.5 AS cx, (raw_y1 + raw_y2) * 0.5 AS cy FROM motion_tracks),
  ll AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(active) OVER w AS pa FROM lt WINDOW w AS (PARTITION BY channel_id, track_id ORDER BY frame_id)),
  fm AS MATERIALIZED (SELECT channel_id, frame_id, pts_ms, count(*) AS tracks, quantile_cont(cx - px, 0.5) AS dx, quantile_cont(cy - py, 0.5) AS dy FROM ll WHERE px IS NOT NULL AND dt_ms BETWEEN 10 AND 250 AND {rule} GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


@query("frame_motion", W(f"+{MOTION_SQL.format(rule='pa AND active AND NOT reset')} SELECT channel_id, frame_id, tracks, ROUND(dx, 6) + 0.0 AS dx, ROUND(dy, 6) + 0.0 AS dy FROM fm", "motion_tracks"))
def _(spark, sf):
    return Wn.frame_motion(view(spark, sf, "motion_tracks"), block=50).select("channel_id", "frame_id", "tracks", r6("dx"), r6("dy"))


@query("frame_motion_live", W(f"+{MOTION_SQL.format(rule='was_active')} SELECT channel_id, frame_id, tracks, ROUND(dx, 6) + 0.0 AS dx, ROUND(dy, 6) + 0.0 AS dy FROM fm", "motion_tracks"))
def _(spark, sf):
    return Wn.frame_motion(view(spark, sf, "motion_tracks"), rule="live", block=50).select("channel_id", "frame_id", "tracks", r6("dx"), r6("dy"))


EMA_SQL = """nm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY pts_ms, frame_id) AS n FROM fm),
  em AS (SELECT channel_id, n, frame_id, pts_ms, dx AS sx, dy AS sy FROM nm WHERE n = 1
    UNION ALL SELECT m.channel_id, m.n, m.frame_id, m.pts_ms, CASE WHEN {fresh} THEN m.dx ELSE 0.25 * m.dx + 0.75 * e.sx END, CASE WHEN {fresh} THEN m.dy ELSE 0.25 * m.dy + 0.75 * e.sy END
    FROM em e JOIN nm m ON m.channel_id = e.channel_id AND m.n = e.n + 1)"""


@query("smooth_motion", W(f"+{MOTION_SQL.format(rule='pa AND active AND NOT reset')}, {EMA_SQL.format(fresh='m.pts_ms - e.pts_ms > 250')} SELECT channel_id, frame_id, ROUND(sx, 6) + 0.0 AS smooth_dx, ROUND(sy, 6) + 0.0 AS smooth_dy FROM em", "motion_tracks", recursive=True))
def _(spark, sf):
    m = Wn.frame_motion(view(spark, sf, "motion_tracks"))
    return Wn.smooth_motion(m, 0.25, block_ms=5000).select("channel_id", "frame_id", r6("smooth_dx"), r6("smooth_dy"))


# ---------------------------------------------------------------- replays

_T = "least(1.0, greatest(0.0, {v}))"


def _ease(v: str) -> str:
    t = _T.format(v=v)
    return f"({t} * {t} * (3.0 - 2.0 * {t}))"


READY_SQL = """b AS (SELECT *, greatest(1.0, raw_x2 - raw_x1) AS w, greatest(1.0, raw_y2 - raw_y1) AS h, (raw_x1 + raw_x2) * 0.5 AS cx, (raw_y1 + raw_y2) * 0.5 AS cy,
    row_number() OVER (PARTITION BY channel_id, track_id ORDER BY frame_id) AS n FROM motion_tracks),
  q AS (SELECT *, lag(w) OVER k AS pw, lag(h) OVER k AS ph, lag(cx) OVER k AS px, lag(cy) OVER k AS py, lag(active) OVER k AS pa FROM b WINDOW k AS (PARTITION BY channel_id, track_id ORDER BY frame_id)),
  s AS MATERIALIZED (SELECT *, reset OR px IS NULL OR dt_ms <= 0 AS fresh, CASE WHEN dt_ms > 0 AND px IS NOT NULL THEN sqrt((cx - px) ** 2 + (cy - py) ** 2) / greatest(32.0, sqrt(((w + pw) * 0.5) ** 2 + ((h + ph) * 0.5) ** 2)) / (dt_ms / 1000.0) ELSE 0 END AS cm,
    CASE WHEN dt_ms > 0 AND px IS NOT NULL THEN sqrt(ln(w / pw) ** 2 + ln(h / ph) ** 2) / (dt_ms / 1000.0) ELSE 0 END AS sm, greatest(1.0, sqrt(w * w + h * h)) AS dg,
    sqrt((cx - px) ** 2 + (cy - py) ** 2) / greatest(1.0, sqrt(w * w + h * h)) / (nullif(dt_ms, 0) / 1000.0) AS speed,
    active AND coalesce(pa, false) AND dt_ms BETWEEN 10 AND 250 AND NOT (reset OR px IS NULL OR dt_ms <= 0) AS cnt FROM q)"""


def _size_sql() -> str:
    fc, fs = "(0.35 * s.cm + 0.65 * p.fc)", "(0.35 * s.sm + 0.65 * p.fs)"
    top = f"(p.top + CASE WHEN p.gated THEN (0.45 - p.top) * {_ease(f'greatest(s.cm, {fc}) / 1.2')} ELSE 0 END)"
    alpha = f"least(1.0, greatest(0.0, 0.12 + ({top} - 0.12) * {_ease(f'greatest(s.sm, {fs}) / 1.2')}))"
    return f"""ps AS (SELECT * FROM (VALUES (0, CAST(0.45 AS DOUBLE), false), (1, CAST(0.3 AS DOUBLE), false), (2, CAST(0.2 AS DOUBLE), true)) v(param_id, top, gated)),
  z AS (SELECT param_id, top, gated, channel_id, track_id, n, frame_id, CAST(0 AS DOUBLE) AS fc, CAST(0 AS DOUBLE) AS fs, CAST(1 AS DOUBLE) AS alpha, w AS width, h AS height, CAST(0 AS DOUBLE) AS prev_width, CAST(0 AS DOUBLE) AS prev_height FROM s, ps WHERE n = 1
    UNION ALL SELECT p.param_id, p.top, p.gated, s.channel_id, s.track_id, s.n, s.frame_id,
      CASE WHEN s.fresh THEN 0 WHEN s.deadzone THEN 0.65 * p.fc ELSE {fc} END, CASE WHEN s.fresh THEN 0 WHEN s.deadzone THEN 0.65 * p.fs ELSE {fs} END,
      CASE WHEN s.fresh THEN 1 WHEN s.deadzone THEN 0 ELSE {alpha} END,
      CASE WHEN s.fresh THEN s.w WHEN s.deadzone THEN p.width ELSE {alpha} * s.w + (1 - {alpha}) * p.width END,
      CASE WHEN s.fresh THEN s.h WHEN s.deadzone THEN p.height ELSE {alpha} * s.h + (1 - {alpha}) * p.height END, p.width, p.height
    FROM z p JOIN s ON s.channel_id = p.channel_id AND s.track_id = p.track_id AND s.n = p.n + 1)"""


SIZE_PARAMS = [{"size_alpha_max": 0.45}, {"size_alpha_max": 0.30}, {"size_alpha_max": 0.20, "center_gated": True}]


@query("replay_size_rows", W(f"+{READY_SQL}, {_size_sql()} SELECT param_id::INT AS param_id, channel_id, track_id, frame_id, ROUND(alpha + 1e-9, 6) AS alpha, ROUND(width + 1e-9, 6) AS width, ROUND(height + 1e-9, 6) AS height FROM z", "motion_tracks", recursive=True))
def _(spark, sf):
    out = X.replay_size_rows(view(spark, sf, "motion_tracks"), SIZE_PARAMS, block=50)
    return out.select("param_id", "channel_id", "track_id", "frame_id", *[r6(F.col(c) + 1e-9, c) for c in ("alpha", "width", "height")])


SIZE_METRICS_SQL = """zz AS (SELECT z.*, s.* EXCLUDE (channel_id, track_id, n, frame_id), greatest(1.0, smooth_x2 - smooth_x1) AS lw, greatest(1.0, smooth_y2 - smooth_y1) AS lh FROM z JOIN s USING (channel_id, track_id, n)),
  mm AS (SELECT *, cnt AND speed <= 0.35 AS still, cnt AND speed >= 0.75 AS mov, 0.5 * sqrt((width - prev_width) ** 2 + (height - prev_height) ** 2) / dg AS es,
    CASE WHEN cnt THEN sqrt(ln(width / prev_width) ** 2 + ln(height / prev_height) ** 2) END AS ss, sqrt(ln(width / w) ** 2 + ln(height / h) ** 2) AS se, 0.5 * sqrt((width - w) ** 2 + (height - h) ** 2) / dg AS ee, abs(width - lw) AS we, abs(height - lh) AS he FROM zz),
  rp AS (SELECT param_id, any_value(top) AS size_alpha_max, count(*) AS track_samples, count(*) FILTER (cnt) AS active_transitions, count(*) FILTER (still) AS stationary_transitions, count(*) FILTER (mov) AS moving_transitions,
    100 * sqrt(avg(ss * ss) FILTER (still)) AS static_size_step_rms_pct, 100 * quantile_cont(ss, 0.9) FILTER (still) AS static_size_step_p90_pct, 100 * sqrt(avg(es * es) FILTER (still)) AS static_edge_step_rms_pct_diag,
    100 * quantile_cont(se, 0.9) FILTER (mov) AS moving_size_error_p90_pct, 100 * quantile_cont(ee, 0.9) FILTER (mov) AS moving_edge_error_p90_pct_diag, 100 * quantile_cont(es, 0.9) FILTER (mov) AS moving_edge_step_p90_pct_diag,
    100 * quantile_cont(es, 0.95) FILTER (cnt) AS all_edge_step_p95_pct_diag, quantile_cont(we, 0.99) AS replay_width_error_p99_px, quantile_cont(he, 0.99) AS replay_height_error_p99_px, max(greatest(we, he)) AS replay_error_max_px, avg(alpha) AS mean_size_alpha FROM mm GROUP BY param_id)"""
SIZE_METRICS = ["static_size_step_rms_pct", "static_size_step_p90_pct", "static_edge_step_rms_pct_diag", "moving_size_error_p90_pct", "moving_edge_error_p90_pct_diag", "moving_edge_step_p90_pct_diag",
                "all_edge_step_p95_pct_diag", "replay_width_error_p99_px", "replay_height_error_p99_px", "replay_error_max_px", "mean_size_alpha"]
SIZE_COUNTS = ["track_samples", "active_transitions", "stationary_transitions", "moving_transitions"]


@query("replay_size", W(f"+{READY_SQL}, {_size_sql()}, {SIZE_METRICS_SQL} SELECT param_id::INT AS param_id, size_alpha_max, {', '.join(SIZE_COUNTS)}, {', '.join(f'ROUND({m}, 5) AS {m}' for m in SIZE_METRICS)} FROM rp", "motion_tracks", recursive=True))
def _(spark, sf):
    out = X.replay_size(view(spark, sf, "motion_tracks"), SIZE_PARAMS)
    return out.select("param_id", "size_alpha_max", *SIZE_COUNTS, *[F.round(m, 5).alias(m) for m in SIZE_METRICS])


@query("recommend", W(f"""+{READY_SQL}, {_size_sql()}, {SIZE_METRICS_SQL}, el AS (SELECT r.* FROM rp r, rp b WHERE b.param_id = 0 AND (b.static_edge_step_rms_pct_diag - r.static_edge_step_rms_pct_diag) / b.static_edge_step_rms_pct_diag * 100 >= 5
     AND (r.moving_edge_error_p90_pct_diag - b.moving_edge_error_p90_pct_diag) / b.moving_edge_error_p90_pct_diag * 100 <= 10)
  SELECT coalesce((SELECT arg_min(size_alpha_max, static_edge_step_rms_pct_diag) FROM el), CAST(0.45 AS DOUBLE)) AS size_alpha_max, (SELECT count(*) FROM el) AS eligible""", "motion_tracks", recursive=True))
def _(spark, sf):
    return X.recommend(X.replay_size(view(spark, sf, "motion_tracks"), SIZE_PARAMS))


CENTER_PARAMS = [{"weight": 1.0}, {"weight": 0.5}, {"weight": 1.0, "global_alpha": 0.25}]


def _center_sql() -> str:
    fc = "(0.35 * s.cm + 0.65 * p.fc)"
    alpha = f"least(1.0, greatest(0.0, 0.18 + 0.72 * {_ease(f'greatest(s.cm * p.weight, {fc}) / 1.2')}))"
    gx, gy = "(CASE WHEN p.common THEN coalesce(g.sx, 0) ELSE 0 END)", "(CASE WHEN p.common THEN coalesce(g.sy, 0) ELSE 0 END)"
    return f"""ps AS (SELECT * FROM (VALUES (0, CAST(1 AS DOUBLE), false), (1, CAST(0.5 AS DOUBLE), false), (2, CAST(1 AS DOUBLE), true)) v(param_id, weight, common)),
  gm AS MATERIALIZED (SELECT channel_id, frame_id, sx, sy FROM em),
  z AS (SELECT param_id, weight, common, channel_id, track_id, n, frame_id, CAST(0 AS DOUBLE) AS fc, CAST(1 AS DOUBLE) AS alpha, cx AS x, cy AS y FROM s, ps WHERE n = 1
    UNION ALL SELECT param_id, weight, common, channel_id, track_id, n, frame_id, fc, alpha, CASE WHEN f THEN rx WHEN d THEN x ELSE x + dx * k END, CASE WHEN f THEN ry WHEN d THEN y ELSE y + dy * k END FROM (
      SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) > 120 THEN 120 / sqrt(dx * dx + dy * dy) ELSE 1 END AS k FROM (
        SELECT p.param_id, p.weight, p.common, s.channel_id, s.track_id, s.n, s.frame_id, CASE WHEN s.fresh THEN 0 WHEN s.deadzone THEN 0.65 * p.fc ELSE {fc} END AS fc, s.fresh AS f, s.deadzone AS d, s.cx AS rx, s.cy AS ry, p.x, p.y,
          CASE WHEN s.fresh THEN 1 WHEN s.deadzone THEN 0 ELSE {alpha} END AS alpha, {gx} + {alpha} * (s.cx - p.x - {gx}) AS dx, {gy} + {alpha} * (s.cy - p.y - {gy}) AS dy
        FROM z p JOIN s ON s.channel_id = p.channel_id AND s.track_id = p.track_id AND s.n = p.n + 1 LEFT JOIN gm g ON g.channel_id = s.channel_id AND g.frame_id = s.frame_id)))"""


CENTER_SQL = f"{MOTION_SQL.format(rule='pa AND active AND NOT reset')}, {EMA_SQL.format(fresh='false')}, {READY_SQL}, {_center_sql()}"


@query("replay_center_rows", W(f"+{CENTER_SQL} SELECT param_id::INT AS param_id, channel_id, track_id, frame_id, ROUND(alpha + 1e-9, 6) AS alpha, ROUND(x + 1e-9, 6) AS cx, ROUND(y + 1e-9, 6) AS cy FROM z", "motion_tracks", recursive=True))
def _(spark, sf):
    out = X.replay_center_rows(view(spark, sf, "motion_tracks"), CENTER_PARAMS, block=50)
    return out.select("param_id", "channel_id", "track_id", "frame_id", *[r6(F.col(c) + 1e-9, c) for c in ("alpha", "cx", "cy")])


CENTER_METRICS_SQL = """zz AS (SELECT z.*, s.cx, s.cy, s.dg, s.speed, s.cnt, s.fresh, s.deadzone, (smooth_x1 + smooth_x2) * 0.5 AS lx, (smooth_y1 + smooth_y2) * 0.5 AS ly FROM z JOIN s USING (channel_id, track_id, n)),
  st AS (SELECT *, CASE WHEN NOT fresh THEN x - lag(x) OVER w END AS sx, CASE WHEN NOT fresh THEN y - lag(y) OVER w END AS sy FROM zz WINDOW w AS (PARTITION BY param_id, channel_id, track_id ORDER BY n)),
  ls AS (SELECT *, lag(sx) OVER w AS qx, lag(sy) OVER w AS qy FROM st WINDOW w AS (PARTITION BY param_id, channel_id, track_id ORDER BY n)),
  mm AS (SELECT *, cnt AND speed <= 0.35 AS still, cnt AND speed >= 0.75 AS mov, sqrt(sx * sx + sy * sy) / dg AS stp, sqrt((x - cx) ** 2 + (y - cy) ** 2) / dg AS err, sqrt((sx - qx) ** 2 + (sy - qy) ** 2) / dg AS rough, sqrt((x - lx) ** 2 + (y - ly) ** 2) AS off FROM ls)
  SELECT param_id::INT AS param_id, count(*) AS track_samples, ROUND(100 * sqrt(avg(stp * stp) FILTER (still)), 5) AS static_center_step_rms_pct_diag, ROUND(100 * sqrt(avg(rough * rough) FILTER (still)), 5) AS static_center_roughness_rms_pct_diag,
    ROUND(100 * quantile_cont(err, 0.9) FILTER (still), 5) AS static_center_error_p90_pct_diag, ROUND(100 * quantile_cont(err, 0.9) FILTER (mov), 5) AS moving_center_error_p90_pct_diag, ROUND(100 * quantile_cont(stp, 0.9) FILTER (mov), 5) AS moving_center_step_p90_pct_diag,
    ROUND(100 * quantile_cont(stp, 0.95) FILTER (cnt), 5) AS all_center_step_p95_pct_diag, ROUND(avg(alpha), 5) AS mean_center_alpha, ROUND(quantile_cont(off, 0.99), 5) AS baseline_center_error_p99_px, ROUND(max(off), 5) AS baseline_center_error_max_px FROM mm GROUP BY param_id"""


@query("replay_center", W(f"+{CENTER_SQL}, {CENTER_METRICS_SQL}", "motion_tracks", recursive=True))
def _(spark, sf):
    out = X.replay_center(view(spark, sf, "motion_tracks"), CENTER_PARAMS)
    kept = [c for c in out.columns if c not in ("weight", "global_alpha", "param_id", "track_samples")]
    return out.select("param_id", "track_samples", *[F.round(c, 5).alias(c) for c in kept])


# ---------------------------------------------------------------- frame quality


@query("psnr", W("""+j AS (SELECT a.video_id, a.frame_no, list_sum(list_transform(list_zip(a.pixels, b.pixels), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) / 64.0 AS mse FROM pixels a JOIN pixels b ON a.video_id = b.video_id AND b.frame_no = a.frame_no - a.frame_no % 3 * 5)
  SELECT video_id, frame_no, ROUND(mse, 8) AS mse, ROUND(CASE WHEN mse = 0 THEN 100.0 ELSE 20 * log10(255.0 / sqrt(mse)) END, 6) AS psnr FROM j""", "pixels"))
def _(spark, sf):
    a = view(spark, sf, "pixels").withColumn("other", F.col("frame_no") - F.col("frame_no") % 3 * 5)
    b = view(spark, sf, "pixels").select("video_id", F.col("frame_no").alias("other"), F.col("pixels").alias("pixels_b"))
    out = a.join(b, ["video_id", "other"]).withColumn("mse", J.mse(F.col("pixels"), F.col("pixels_b")))
    return out.select("video_id", "frame_no", F.round("mse", 8).alias("mse"), r6(A.psnr(F.col("mse")), "psnr"))


# ---------------------------------------------------------------- logs and messages

STATS_LINE = "concat('x [MotionStats] frame=', event_id, ' pts_ms=', event_id * 50, ' dt_ms=', CASE WHEN event_id % 50 = 0 THEN 'x' ELSE CAST(event_id % 60 AS STRING) END, ' stable_tracks=1 raw_center=', event_id % 50, ',100 smooth_center=', event_id % 45, ',99.5 raw_delta=1,-2 smooth_delta=0.5,0 raw_step_ratio=0.25 smooth_step_ratio=0.125 raw_size_step=0.5 smooth_size_step=0.25 raw_reversals=0 created=', event_id % 2, CASE WHEN event_id % 40 = 0 THEN '' ELSE ' lost=0' END, ' active_ids=', user_id, ',7 stable_ids=', CASE WHEN event_id % 3 = 0 THEN '' ELSE '7' END)"
TRACK_LINE = "concat('[MotionTrack] frame=', event_id, ' pts_ms=', event_id * 50, ' id=', user_id, ' class_id=', user_id % 6, ' dt_ms=', event_id % 60, ' raw=', event_id % 11, ',0,', 100 + event_id % 7, ',50.5 smooth=', event_id % 11, ',1,2', CASE WHEN event_id % 30 = 0 THEN '' ELSE ',3' END, ' deadzone=', event_id % 2, ' reset=', CASE WHEN event_id % 35 = 0 THEN '2' ELSE '0' END, ' was_active=1 active=0 size_alpha=0.25')"
RUNTIME_LINE = "concat('a [PullStats] channel=ch', user_id % 4, ' input_fps=30 enc_drop=', event_id % 5, ' infer_drop=1 [EncodeStats] channel=ch', user_id % 4, ' packet_fps=', event_id % 30, '.5 out_drop=-1 packet_fps=', event_id % 31, ' [StreamStats] write_fail=', event_id % 2)"


def _lines(spark, sf, expr):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select(F.col("event_id").alias("line_no"), F.expr(expr).alias("value"))


@query("parse_motion_stats", "SELECT event_id AS line_no, event_id AS frame_id, event_id % 60 AS dt_ms, CAST(event_id % 50 AS DOUBLE) AS raw_center_x, CAST(event_id % 45 AS DOUBLE) AS smooth_center_x, CAST(-2 AS DOUBLE) AS raw_dy, event_id % 2 AS created, user_id AS first_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_stable FROM events WHERE event_id % 50 <> 0 AND event_id % 40 <> 0")
def _(spark, sf):
    good, _ = L.parse_motion_stats(_lines(spark, sf, STATS_LINE))
    return good.select("line_no", "frame_id", "dt_ms", "raw_center_x", "smooth_center_x", "raw_dy", "created", F.col("active_ids")[0].alias("first_id"), F.size("stable_ids").cast("long").alias("n_stable"))


@query("parse_motion_stats_rejects", "SELECT event_id AS line_no, CASE WHEN event_id % 40 = 0 THEN 'missing lost' ELSE 'format' END AS reason FROM events WHERE event_id % 50 = 0 OR event_id % 40 = 0")
def _(spark, sf):
    return L.parse_motion_stats(_lines(spark, sf, STATS_LINE))[1].select("line_no", "reason")


@query("parse_motion_tracks", "SELECT event_id AS line_no, user_id AS track_id, CAST(user_id % 6 AS INT) AS class_id, CAST(event_id % 11 AS DOUBLE) AS raw_x1, CAST(50.5 AS DOUBLE) AS raw_y2, CAST(3 AS DOUBLE) AS smooth_y2, event_id % 2 = 1 AS deadzone, false AS reset FROM events WHERE event_id % 30 <> 0 AND event_id % 35 <> 0")
def _(spark, sf):
    return L.parse_motion_tracks(_lines(spark, sf, TRACK_LINE))[0].select("line_no", "track_id", "class_id", "raw_x1", "raw_y2", "smooth_y2", "deadzone", "reset")


@query("parse_runtime_stats", """SELECT 'ch' || (user_id % 4) AS channel_id, event_id AS line_no, v.source, v.metric, v.value FROM events, LATERAL (VALUES ('PullStats', 'input_fps', CAST(30 AS DOUBLE)), ('PullStats', 'enc_drop', CAST(event_id % 5 AS DOUBLE)), ('PullStats', 'infer_drop', 1.0),
   ('EncodeStats', 'packet_fps', CAST(event_id % 31 AS DOUBLE)), ('EncodeStats', 'out_drop', -1.0), ('StreamStats', 'write_fail', CAST(event_id % 2 AS DOUBLE))) v(source, metric, value)""")
def _(spark, sf):
    out = L.parse_runtime_stats(_lines(spark, sf, RUNTIME_LINE))
    # The third marker names no channel; the line's first one stands for it.
    line_channel = F.max("channel_id").over(Window.partitionBy("line_no"))
    return out.select(line_channel.alias("channel_id"), "line_no", "source", "metric", "value")


MESSAGE = """CASE WHEN conv_id % 9 = 0 AND turn = 1 THEN '{broken' ELSE concat('{"channel_id":"', conv_id, '","timestamp":', turn, ',"objects":[{"label":"', role, '","count":', turn + 1, ',"score":0.5}]', CASE WHEN turn % 3 = 1 THEN concat(',"thumbnail":{"width":2,"height":2,"format":"nv12","data":"', CASE WHEN conv_id % 2 = 0 THEN 'AAAAAAAA' ELSE 'AAAA' END, '"}') ELSE '' END, '}') END"""


@query("read_reports", """SELECT conv_id, turn, NOT (conv_id % 9 = 0 AND turn = 1) AS valid, CASE WHEN conv_id % 9 = 0 AND turn = 1 THEN '' ELSE role END AS label, CASE WHEN conv_id % 9 = 0 AND turn = 1 THEN 'none' WHEN turn % 3 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'ok' ELSE 'bad' END ELSE 'none' END AS picture FROM conversations""")
def _(spark, sf):
    lines = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.expr(MESSAGE).alias("value"))
    out = Rd.check_reports(lines)
    picture = F.when(F.col("thumbnail_ok"), "ok").when(~F.col("thumbnail_ok"), "bad").otherwise("none")
    return out.select("conv_id", "turn", "valid", F.coalesce(F.col("report.objects")[0]["label"], F.lit("")).alias("label"), picture.alias("picture"))


@query("report_messages", """SELECT 'reports/conv' || conv_id AS topic, '{"channel_id":"conv' || conv_id || '","timestamp":' || turn || ',"objects":[{"label":"' || role || '","count":' || turn + 1 || ',"score":0.5}]'
    || CASE WHEN turn % 3 = 1 THEN ',"thumbnail":{"width":2,"height":2,"format":"nv12","data":"AAAAAAAA"}' ELSE '' END
    || ',"roi_events":[' || CASE WHEN turn % 5 = 4 THEN '{"region":"roi' || conv_id % 3 || '","label":"' || role || '","dwell_sec":' || turn || '.25}' ELSE '' END || ']}' AS value FROM conversations""")
def _(spark, sf):
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    events = F.array(F.struct(F.concat(F.lit("roi"), F.col("conv_id") % 3).alias("region"), F.col("role").alias("label"), (F.col("turn") + 0.25).alias("dwell_sec")))
    r = talks.select(
        F.concat(F.lit("conv"), "conv_id").alias("channel_id"), F.col("turn").alias("timestamp"),
        F.array(F.struct(F.col("role").alias("label"), (F.col("turn") + 1).cast("int").alias("count"), F.lit(0.5).alias("score"))).alias("objects"),
        F.when(F.col("turn") % 3 == 1, F.struct(F.lit(2).alias("width"), F.lit(2).alias("height"), F.lit("nv12").alias("format"), F.lit("AAAAAAAA").alias("data"))).alias("thumbnail"),
        F.when(F.col("turn") % 5 == 4, events).otherwise(F.slice(events, 1, 0)).alias("roi_events"),
    )
    return K.report_messages(r)


# ---------------------------------------------------------------- data sets


@query("read_label_files", "SELECT doc_id::VARCHAR AS image_stem, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS n_lines FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE replace(text, '. ', '.' || chr(10)) END AS text FROM documents)")
def _(spark, sf):
    text = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.replace("text", F.lit(". "), F.lit(".\n")))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("/labels/"), "doc_id", F.lit(".txt")).alias("path"), text.alias("content"))
    files, _ = Rd.label_files_of(docs)
    return files


@query("image_inventory", "SELECT doc_id::VARCHAR || '.jpg' AS image_name, source AS session, lang AS folder, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = F.concat(F.lit("/d/"), "lang", F.lit("/"), "source", F.lit("__"), "doc_id", F.lit(".jpg"))
    out = Rd.inventory_of(docs.select(path.alias("path"), F.encode("text", "UTF-8").alias("content")))
    return out.select(F.substring_index("image_name", "__", -1).alias("image_name"), "session", "folder", "bytes", "sha256")


@query("label_status", W("SELECT i.image_name, CASE WHEN l.image_stem IS NOT NULL THEN 'labelled' WHEN negative_hint = '1' THEN 'negative' ELSE 'pending' END AS status FROM images i LEFT JOIN label_files l ON i.image_name = l.image_stem || '.jpg'", "images", "label_files"))
def _(spark, sf):
    return D.label_status(view(spark, sf, "images"), view(spark, sf, "label_files")).select("image_name", "status")


def _split(spark, sf):
    images = view(spark, sf, "images").drop("split")
    return D.assign_split(images, view(spark, sf, "sessions"), images.where("doc_id % 13 = 0"))


@query("assign_split", W("SELECT i.image_name, s.split FROM images i JOIN sessions s USING (session) WHERE i.doc_id % 13 <> 0", "images", "sessions"))
def _(spark, sf):
    return _split(spark, sf)[0].select("image_name", "split")


@query("assign_split_unassigned", W("SELECT session, count(*) AS images FROM images WHERE doc_id % 13 <> 0 AND session NOT IN (SELECT session FROM sessions) GROUP BY 1", "images", "sessions"))
def _(spark, sf):
    return _split(spark, sf)[1]


WANTED = {"src0": 25, "src1": 10, "src2": 10_000, "nowhere": 3}
FROZEN_SQL = f"""n AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in WANTED.items())}) v(session, wanted)),
  z AS (SELECT image_name, session, doc_id FROM (SELECT image_name, i.session, doc_id, wanted, row_number() OVER (PARTITION BY i.session ORDER BY image_name) AS no FROM images i JOIN n ON n.session = i.session) WHERE no <= wanted)"""


def _frozen(spark, sf):
    images = view(spark, sf, "images")
    return D.frozen_eval(images.select("image_name", "session", "doc_id"), images.where("doc_id % 7 <> 0"), WANTED)


@query("frozen_eval", W(f"+{FROZEN_SQL} SELECT image_name, session FROM z WHERE doc_id % 7 <> 0", "images"))
def _(spark, sf):
    return _frozen(spark, sf)[0].select("image_name", "session")


@query("frozen_eval_short", W(f"+{FROZEN_SQL} SELECT n.session, n.wanted::BIGINT AS wanted, count(z.session) AS found FROM n LEFT JOIN z USING (session) GROUP BY ALL HAVING count(z.session) < n.wanted", "images"))
def _(spark, sf):
    return _frozen(spark, sf)[1]


BOXES_SPLIT = ", ".join(f"count(*) FILTER (split = '{s}') AS {s}" for s in D.SPLITS)


@query("class_distribution", W(f"+b AS (SELECT CASE WHEN class_id = 4 THEN 5 ELSE class_id END AS class_id, split FROM dataset_boxes) SELECT c.class_id, {BOXES_SPLIT}, count(b.class_id) AS total, ROUND(count(b.class_id) * 100.0 / (SELECT count(*) FROM b), 6) AS ratio_pct FROM (SELECT CAST(range AS INT) AS class_id FROM range(0, 6)) c LEFT JOIN b USING (class_id) GROUP BY 1 UNION ALL SELECT -1, {BOXES_SPLIT}, count(*), 100.0 FROM b", "dataset_boxes"))
def _(spark, sf):
    # Class 4 counts as class 5 here, so that one class is without a box.
    boxes = view(spark, sf, "dataset_boxes").withColumn("class_id", F.when(F.col("class_id") == 4, 5).otherwise(F.col("class_id")).cast("int"))
    out = D.class_distribution(boxes)
    return out.withColumn("ratio_pct", F.round("ratio_pct", 6))


@query("split_stats", W("+j AS (SELECT split, image_name, image_stem, n_lines FROM images i LEFT JOIN label_files l ON i.image_name = l.image_stem || '.jpg' UNION ALL SELECT unnest(['train', 'val', 'test', 'frozen']), NULL, NULL, NULL) SELECT coalesce(split, 'total') AS split, count(image_name) AS images, count(image_stem) AS labels, count(*) FILTER (n_lines = 0) AS empty_labels, coalesce(sum(n_lines), 0)::BIGINT AS boxes FROM j GROUP BY ROLLUP (split)", "images", "label_files"))
def _(spark, sf):
    return D.split_stats(view(spark, sf, "images"), view(spark, sf, "label_files"), [*D.SPLITS, "frozen"])


@query("class_imbalance", W("+c AS (SELECT label, count(*) AS n FROM dataset_boxes GROUP BY 1) SELECT arg_max(label, n) AS most_class, max(n) AS most, arg_min(label, n) AS least_class, min(n) AS least, ROUND(max(n) / min(n), 6) AS ratio, max(n) / min(n) > 10 AS high FROM c", "dataset_boxes"))
def _(spark, sf):
    out = D.class_imbalance(view(spark, sf, "dataset_boxes"), list(enumerate(LABELS)))
    return out.withColumn("ratio", F.round("ratio", 6))


@query("split_sessions", W("SELECT split, session, count(*) AS images FROM images GROUP BY ALL", "images"))
def _(spark, sf):
    return D.split_sessions(view(spark, sf, "images"))


@query("pending_by_session", W("+p AS (SELECT session, count(*) AS pending FROM images WHERE doc_id % 4 = 0 GROUP BY 1), s AS (SELECT session, max(split) AS split FROM images WHERE session <> 'src5' GROUP BY 1) SELECT session, pending, coalesce(split, 'NOT YET ASSIGNED') AS split FROM p LEFT JOIN s USING (session)", "images"))
def _(spark, sf):
    images = view(spark, sf, "images")
    return D.pending_by_session(images.where("doc_id % 4 = 0"), images.where("session <> 'src5'"))


@query("dup_counts", W("SELECT source_class, count(*) AS images, count(DISTINCT sha256) AS unique_contents, count(*) - count(DISTINCT sha256) AS duplicates FROM images GROUP BY 1", "images"))
def _(spark, sf):
    return D.dup_counts(view(spark, sf, "images"), ["source_class"])


MIX = ", ".join(f"count(*) FILTER (source_class_id = {c}) AS class_{c}" for c in range(6))


@query("source_mix", W(f"SELECT session, {MIX}, count(*) AS total FROM images GROUP BY 1", "images"))
def _(spark, sf):
    return D.source_mix(view(spark, sf, "images"), "session")


BMIX = ", ".join(f"count(*) FILTER (class_id = {c}) AS class_{c}" for c in range(6))


@query("source_mix_boxes", W(f"SELECT split AS domain, {BMIX}, count(*) AS total FROM dataset_boxes GROUP BY 1", "dataset_boxes"))
def _(spark, sf):
    boxes = view(spark, sf, "dataset_boxes")
    images = boxes.select("image_id", F.col("split").alias("domain")).distinct()
    return D.source_mix(images, "domain", boxes.select("image_id", "class_id"), "image_id")


KEPT = "(lower(trim(keep)) IN ('1', 'y', 'yes', 'true', 'keep', '保留') OR lower(trim(review_choice)) = 'keep')"


# Some rows have no session; the folder of their picture stands for it.
NO_SESSION = "CASE WHEN doc_id % 6 = 2 THEN NULL WHEN doc_id % 7 = 3 THEN '' ELSE session END"


@query("selection_audit", W(f"""+k AS (SELECT *, CASE WHEN coalesce(session, '') = '' THEN split_part(path, '/', 3) ELSE session END IN ('src3', 'src7', 'fr') AS ex, doc_id % 17 = 0 AS mi, doc_id % 5 = 0 AS th FROM (SELECT * REPLACE ({NO_SESSION} AS session) FROM images) WHERE {KEPT})
  SELECT count(*) AS selected, count(*) FILTER (ex) AS skipped_excluded, count(*) FILTER (NOT ex AND mi) AS missing_source, count(*) FILTER (NOT ex AND NOT mi AND th) AS skipped_existing, count(*) FILTER (NOT ex AND NOT mi AND NOT th) AS copied FROM k""", "images"))
def _(spark, sf):
    images = view(spark, sf, "images").withColumn("session", F.expr(NO_SESSION))
    return D.selection_audit(images, ["src3", "src7", "fr"], images.where("doc_id % 5 = 0"), images.where("doc_id % 17 <> 0"))


@query("mark_duplicates", W("+f AS (SELECT *, first(path) OVER (PARTITION BY sha256 ORDER BY source_class_id, path) AS head FROM images) SELECT path, CASE WHEN head = path THEN '' ELSE head END AS duplicate_of FROM f", "images"))
def _(spark, sf):
    out = Wn.mark_duplicates(view(spark, sf, "images"), order=["source_class_id", "path"])
    return out.select("path", F.coalesce("duplicate_of", F.lit("")).alias("duplicate_of"))


def _spaced(n: int) -> str:
    pick = "n - 1 = size // 2" if n == 1 else f"size <= {n} OR n - 1 IN (SELECT (k * (size - 1)) // {n - 1} FROM range({n}) t(k))"
    return f"+o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY image_name) AS n, count(*) OVER (PARTITION BY session) AS size FROM images) SELECT session, image_name FROM o WHERE {pick}"


@query("evenly_spaced", W("+o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY image_name) AS n, count(*) OVER (PARTITION BY session) AS size FROM images), k AS (SELECT DISTINCT session, size, (k * (size - 1)) // 6 AS i FROM o, range(7) t(k)) SELECT o.session, image_name FROM o JOIN k ON o.session = k.session AND o.n - 1 = k.i", "images"))
def _(spark, sf):
    return Wn.evenly_spaced(view(spark, sf, "images"), ["session"], 7, "image_name").select("session", "image_name")


@query("evenly_spaced_middle", W(_spaced(1), "images"))
def _(spark, sf):
    return Wn.evenly_spaced(view(spark, sf, "images"), ["session"], 1, "image_name").select("session", "image_name")


@query("first_n", W("SELECT session, image_name FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY image_name) AS n FROM images) WHERE n <= 5", "images"))
def _(spark, sf):
    return Wn.first_n(view(spark, sf, "images"), ["session"], 5, "image_name").select("session", "image_name")


@query("mix_sources", W("""SELECT 'photos' AS domain, 'p_r' || k || '_' || replace(image_name, '.jpg', '') AS output_stem, k::INT AS repeat FROM images, range(1, 4) t(k) WHERE split = 'train'
  UNION ALL SELECT 'history', 'h_r1_' || replace(image_name, '.jpg', ''), 1 FROM images WHERE split = 'val'""", "images"))
def _(spark, sf):
    images = view(spark, sf, "images")
    out = D.mix_sources([(images.where("split = 'train'"), "photos", "p", 3), (images.where("split = 'val'"), "history", "h", 1)])
    return out.select("domain", "output_stem", "repeat")


@query("session_leakage", W("SELECT DISTINCT a.session, a.split AS split_a, b.split AS split_b FROM (SELECT DISTINCT session, split FROM images) a JOIN (SELECT DISTINCT session, split FROM images) b ON a.session = b.session AND a.split < b.split", "images"))
def _(spark, sf):
    return D.session_leakage(view(spark, sf, "images"))


@query("content_leakage", W("SELECT sha256, count(*) FILTER (split = 'train') AS in_a, count(*) FILTER (split = 'val') AS in_b FROM images WHERE split IN ('train', 'val') GROUP BY 1 HAVING count(DISTINCT split) = 2", "images"))
def _(spark, sf):
    return D.content_leakage(view(spark, sf, "images"), "train", "val")


@query("missing_classes", W("SELECT s.split, c::INT AS class_id FROM (VALUES ('train'), ('val'), ('test')) s(split), range(8) t(c) WHERE NOT EXISTS (SELECT 1 FROM dataset_boxes b WHERE b.split = s.split AND b.class_id = c)", "dataset_boxes"))
def _(spark, sf):
    return D.missing_classes(view(spark, sf, "dataset_boxes"), list(range(8)))


@query("unlabelled", W("SELECT image_name FROM images WHERE replace(image_name, '.jpg', '') NOT IN (SELECT image_stem FROM label_files)", "images", "label_files"))
def _(spark, sf):
    return D.unlabelled(view(spark, sf, "images"), view(spark, sf, "label_files")).select("image_name")


@query("union_candidates", W("SELECT frame_id, det_ord, origin FROM tiled", "tiled"))
def _(spark, sf):
    t = view(spark, sf, "tiled").select("frame_id", "det_ord", "origin")
    return D.union_candidates(t.where("origin = 'tile'"), t.where("origin = 'joint'"))


@query("composite_split", W("SELECT image_name, split FROM images UNION ALL SELECT image_name, 'dev' FROM images WHERE split IN ('val', 'test')", "images"))
def _(spark, sf):
    return D.composite_split(view(spark, sf, "images").select("image_name", "split"), ["val", "test"], "dev")


@query("duplicate_names", W("SELECT sha256, session, count(*) AS copies FROM images GROUP BY ALL HAVING count(*) > 1", "images"))
def _(spark, sf):
    return D.duplicate_names(view(spark, sf, "images"), ["sha256", "session"])


@query("label_rows", W("""SELECT 'f' || frame_id AS image_stem, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + x2) * 0.5 / 640, (y1 + y2) * 0.5 / 480, (x2 - x1) / 640, (y2 - y1) / 480), chr(10) ORDER BY det_ord) || chr(10) AS content, count(*) AS n_lines FROM detections WHERE frame_id % 3 <> 0 GROUP BY 1""", "detections"))
def _(spark, sf):
    d = P.to_norm(view(spark, sf, "detections"), 640.0, 480.0).withColumn("image_stem", F.concat(F.lit("f"), "frame_id"))
    existing = view(spark, sf, "frames").where("frame_id % 3 = 0").select(F.concat(F.lit("f"), "frame_id").alias("image_stem"))
    return K.label_rows(d, existing)


@query("pseudo_label_manifest", W("""SELECT i.image_name, CASE WHEN l.image_stem IS NOT NULL THEN 'skipped_existing' WHEN doc_id % 19 = 0 THEN 'missing_image' WHEN bytes % 3 > 0 THEN 'written' ELSE 'no_detection_unwritten' END AS status,
   CASE WHEN l.image_stem IS NOT NULL OR doc_id % 19 = 0 THEN 0 ELSE bytes % 3 END AS detections FROM images i LEFT JOIN label_files l ON i.image_name = l.image_stem || '.jpg'""", "images", "label_files"))
def _(spark, sf):
    """A rule stands in for the model: ``bytes % 3`` boxes per picture."""
    from boxweave.operators.scoring import pseudo_label

    def rule(pdf):
        pdf = pdf.loc[pdf.index.repeat((pdf["bytes"] % 3).astype(int))].copy()
        order = pdf.groupby("image_name").cumcount()
        return pdf.assign(det_ord=order, class_id=1, label="cup", score=0.5, x1=1.0, y1=2.0, x2=30.0, y2=40.0)[
            ["image_name", "det_ord", "class_id", "label", "score", "x1", "y1", "x2", "y2"]
        ]

    images = view(spark, sf, "images").select("image_name", "bytes", "width", "height", (F.col("doc_id") % 19 != 0).alias("readable"))
    manifest, _ = pseudo_label(images, view(spark, sf, "label_files"), rule)
    return manifest.select("image_name", "status", "detections")


@query("score", W("SELECT frame_id, det_ord, ROUND(score * 0.5, 6) AS rescored FROM detections", "detections"))
def _(spark, sf):
    from boxweave.operators.scoring import score

    d = view(spark, sf, "detections").select("frame_id", "det_ord", "score")
    out = score(d, lambda pdf: pdf.assign(rescored=pdf["score"] * 0.5)[["frame_id", "det_ord", "rescored"]], "frame_id long, det_ord long, rescored double")
    return out.select("frame_id", "det_ord", r6("rescored"))
