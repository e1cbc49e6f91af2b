"""Streaming operators, run over the given tables as bounded streams.

Each drains its source (``availableNow``) into a table in the shared folder. Windows are
written in update mode, so those the watermark has not passed are complete as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from boxweave.operators import filters as P
from boxweave.operators import tracking as T
from boxweave.plans.queries_boxes import FRAME_H, FRAME_W, ROI_HIT, ROI_PIXELS
from boxweave.plans.queries_data import STATS_SQL
from boxweave.plans import track_sql
from boxweave.plans.queries_frames import CONNECTED, DWELL_SQL, LIVE, connected, mailbox
from boxweave.plans.registry import query, r6
from boxweave.plans.views import stream_view, view
from boxweave.plans.views import with_views as W
from boxweave.streaming import stateful as S
from boxweave.streaming import stateless as L

NOW = "0 seconds"  # the source holds no late rows; a live stream allows for some


@query("telemetry_stream", W("SELECT channel_id, metric, (ts_ms // 3600000) * 3600000 AS window_ms, count(*) AS samples, ROUND(sum(value), 4) AS total, ROUND(avg(value), 6) AS mean FROM telemetry GROUP BY ALL", "telemetry"))
def _(spark, sf):
    out = S.run_updates(L.telemetry_windows(stream_view(spark, sf, "telemetry"), "1 hour", NOW), "telemetry", ["channel_id", "metric", "window_ms"])
    return out.select("channel_id", "metric", "window_ms", "samples", F.round("total", 4).alias("total"), r6("mean"))


@query("inference_stats_stream", W(STATS_SQL + " WHERE lvl <> '*'", "inference_results"))
def _(spark, sf):
    out = S.run_updates(L.inference_windows(stream_view(spark, sf, "inference_results"), 30_000, NOW), "inference", ["window_ms", "channel_id"])
    rounded = {"busy_ratio", "actual_fps", "npu_avg_ms", "wait_avg_ms"}
    return out.select(*[r6(c) if c in rounded else F.col(c) for c in out.columns])


@query("dedupe_stream", W("SELECT DISTINCT channel_id, ts_ms FROM (SELECT channel_id, ts_ms - ts_ms % 1000 AS ts_ms FROM frames)", "frames"))
def _(spark, sf):
    seconds = stream_view(spark, sf, "frames").select("channel_id", (F.col("ts_ms") - F.col("ts_ms") % 1000).alias("ts_ms"))
    return S.run_available(L.dedupe_stream(seconds, NOW, ["channel_id", "ts_ms"]), "dedupe")


@query("report_stream", W("+l AS (SELECT *, lag(summary_key) OVER w AS before, row_number() OVER w AS n FROM reports WINDOW w AS (PARTITION BY channel_id ORDER BY ts_ms)) SELECT channel_id, turn, summary_key, has_events FROM l WHERE n = 1 OR before IS DISTINCT FROM summary_key OR has_events", "reports"))
def _(spark, sf):
    return S.run_available(S.report_stream(stream_view(spark, sf, "reports"), 0, NOW), "reports").select("channel_id", "turn", "summary_key", "has_events")


@query("report_stream_throttled", W("""+x AS MATERIALIZED (SELECT channel_id, turn, ts_ms, summary_key, has_events FROM reports),
   r AS (SELECT channel_id, min(ts_ms) AS ts_ms FROM x GROUP BY 1
     UNION ALL SELECT channel_id, later FROM (SELECT r.channel_id, (SELECT min(x.ts_ms) FROM x WHERE x.channel_id = r.channel_id AND x.ts_ms >= r.ts_ms + 3000) AS later FROM r) WHERE later IS NOT NULL),
   l AS (SELECT x.*, lag(summary_key) OVER w AS before, row_number() OVER w AS n FROM x JOIN r USING (channel_id, ts_ms) WINDOW w AS (PARTITION BY channel_id ORDER BY ts_ms))
   SELECT channel_id, turn, summary_key, has_events FROM l WHERE n = 1 OR before IS DISTINCT FROM summary_key OR has_events""", "reports", recursive=True))
def _(spark, sf):
    """Ticks at least three seconds apart, of these the changed ones."""
    return S.run_available(S.report_stream(stream_view(spark, sf, "reports"), 3, NOW), "reports").select("channel_id", "turn", "summary_key", "has_events")


@query("dwell_stream", W(f"+{ROI_PIXELS}, {ROI_HIT}, {DWELL_SQL} SELECT channel_id, region_ord, class_id, frame_id, det_ord, dwell AS dwell_sec FROM g WHERE dwell >= 0.5", "detections", "regions"))
def _(spark, sf):
    boxes = P.roi_assign(stream_view(spark, sf, "detections"), view(spark, sf, "regions"), FRAME_W, FRAME_H)
    out = S.run_available(S.dwell_stream(boxes.select("channel_id", "region_ord", "class_id", "frame_id", "det_ord", "ts_ms", *S.BOX), 0.5, delay=NOW), "dwell")
    return out.select("channel_id", "region_ord", "class_id", "frame_id", "det_ord", "dwell_sec")


@query("thin_stream", W(f"+{mailbox(333)} SELECT channel_id, f.frame_id, ts_ms FROM r JOIN f USING (channel_id, ts_ms) WHERE sent - ts_ms <= 300 AND sent <= (SELECT max(ts_ms) FROM f)", "frames", recursive=True))
def _(spark, sf):
    frames = stream_view(spark, sf, "frames").select("channel_id", "frame_id", "ts_ms")
    return S.run_available(S.thin_stream(frames, 3, max_age_ms=300, delay=NOW), "thin")


@query("align_stream", W("""SELECT f.channel_id, f.frame_id, coalesce(s.frame_id, -1) AS snapshot_frame_id, coalesce(s.n_boxes, -1) AS n_boxes, coalesce(f.pts_ms - s.pts_ms, -1) AS pts_delta_ms
   FROM frames f ASOF LEFT JOIN snapshots s ON f.channel_id = s.channel_id AND f.pts_ms >= s.pts_ms""", "frames", "snapshots"))
def _(spark, sf):
    out = S.run_available(S.align_stream(stream_view(spark, sf, "frames"), stream_view(spark, sf, "snapshots"), NOW), "align")
    fill = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return out.select("channel_id", "frame_id", fill("snapshot_frame_id"), fill("n_boxes"), fill("pts_delta_ms"))


@query("track_stream", W(track_sql.snapshots(LIVE), "frames", "detections", recursive=True))
def _(spark, sf):
    """Per-frame counts of the streamed tracker."""
    boxes = stream_view(spark, sf, "detections")
    beats = stream_view(spark, sf, "frames").select("channel_id", "frame_id", "pts_ms", "ts_ms")
    rows = connected(boxes.unionByName(beats, allowMissingColumns=True))
    out = S.run_available(S.track_stream(rows, LIVE, delay=NOW, keys=CONNECTED, kinds=("frame",)), "track")
    return T.snapshots(out, CONNECTED)
