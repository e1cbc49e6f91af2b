"""Replays of logged track samples under other filter settings.

What a sample needs from the one before comes from a block-wise scan; the two filters
are linear recurrences with known weights, solved for whole batches at once. Resets
start a track afresh, so tracks are cut there and a long track runs on many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxweave.functions import scalars as S
from boxweave.operators.aggregates import exact_quantiles
from boxweave.operators.joins import BOX_COLUMNS
from boxweave.operators.scan import Step, ordered_scan, time_block
from boxweave.operators.sequential import affine_scan, stream_pandas
from boxweave.operators.windows import frame_motion, smooth_motion
from boxweave.session import checkpointed

RAW = [f"raw_{c}" for c in BOX_COLUMNS]
STILL, MOVING = 0.35, 0.75  # fixed values: box diagonals per second
FIDELITY_PX = 0.10


def _sides(prefix: str) -> tuple[Column, Column]:
    x1, y1, x2, y2 = [F.col(f"{prefix}{c}") for c in BOX_COLUMNS]
    return F.greatest(x2 - x1, F.lit(1.0)), F.greatest(y2 - y1, F.lit(1.0))


def _middle(prefix: str) -> tuple[Column, Column]:
    x1, y1, x2, y2 = [F.col(f"{prefix}{c}") for c in BOX_COLUMNS]
    return (x1 + x2) * 0.5, (y1 + y2) * 0.5


def prepare(tracks: DataFrame, block: int = 100_000) -> DataFrame:
    """Measured motion against the sample before, and where the filters start afresh.

    ``counts`` marks the transitions that metrics use.
    """
    keys, order = ["channel_id", "track_id"], [F.col("frame_id")]
    blocks = [time_block("frame_id", block)]
    resets = F.col("reset") | (F.col("dt_ms") <= 0)
    seen = ordered_scan(
        tracks, keys, blocks, order,
        [Step("__p", "lag", F.struct("active", *RAW)), Step("__cut", "last", F.when(resets, F.col("frame_id")))],
    )
    fresh = resets | F.col("__p").isNull()
    (w, h), (pw, ph) = _sides("raw_"), _sides("__p.raw_")
    (x, y), (px, py) = _middle("raw_"), _middle("__p.raw_")
    seconds = F.col("dt_ms") / 1000.0
    reference = F.greatest(F.lit(32.0), F.hypot((w + pw) * 0.5, (h + ph) * 0.5))
    step = F.hypot(x - px, y - py)
    diagonal = F.greatest(F.lit(1.0), F.hypot(w, h))
    moving = ~F.col("fresh") & ~F.col("deadzone")
    out = seen.withColumn("fresh", fresh)
    return out.select(
        *keys, "frame_id", "pts_ms", "class_id", "dt_ms", "deadzone", "fresh",
        w.alias("raw_w"), h.alias("raw_h"), x.alias("raw_cx"), y.alias("raw_cy"),
        *[c.alias(n) for c, n in zip(_sides("smooth_"), ("logged_w", "logged_h"))],
        *[c.alias(n) for c, n in zip(_middle("smooth_"), ("logged_cx", "logged_cy"))],
        F.when(moving, step / reference / seconds).otherwise(0.0).alias("center_motion"),
        F.when(moving, F.hypot(F.log(w / pw), F.log(h / ph)) / seconds).otherwise(0.0).alias("size_motion"),
        diagonal.alias("diagonal"),
        F.when(~F.col("fresh"), step / diagonal / seconds).alias("speed"),
        (F.col("active") & F.coalesce(F.col("__p.active"), F.lit(False)) & F.col("dt_ms").between(10, 250) & ~F.col("fresh")).alias("counts"),
        F.coalesce("__cut", F.lit(-1)).alias("cut"),
    )


def _ease(v: np.ndarray) -> np.ndarray:
    t = np.clip(v, 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


class _Filtered:
    """Motion filters over a batch, carrying on from the batch before."""

    def __init__(self, smoothing: float):
        self.k, self.carry = smoothing, {}

    def __call__(self, rows: pd.DataFrame, name: str) -> np.ndarray:
        fresh = rows["fresh"].to_numpy(bool)
        keep = np.where(fresh, 0.0, 1.0 - self.k)
        out = affine_scan(keep, self.k * rows[name].to_numpy(float), self.carry.get(name, 0.0))
        self.carry[name] = out[-1]
        return out


def _shifted(values: np.ndarray, carry: float) -> np.ndarray:
    return np.concatenate([[carry], values[:-1]])


def replay_size_rows(tracks: DataFrame, params: list[dict], smoothing: float = 0.35, full_response: float = 1.20,
                     alpha_min: float = 0.12, block: int = 100_000) -> DataFrame:
    """Size and weight of every sample under every parameter set.

    A set has ``size_alpha_max`` and, optionally, ``center_gated`` and
    ``high_motion_size_alpha_max``. ``param_id`` is its place in the list.
    """
    sets = [{"center_gated": False, "high_motion_size_alpha_max": 0.45, **p} for p in params]
    ready = prepare(tracks, block)
    kept = ["channel_id", "track_id", "frame_id", "deadzone", "fresh", "raw_w", "raw_h", "logged_w", "logged_h", "diagonal", "speed", "counts"]
    schema = ready.select(*kept).schema
    for c in ("alpha", "width", "height", "prev_width", "prev_height"):
        schema = schema.add(c, "double")
    schema = schema.add("param_id", "integer")

    def make():
        motion, carry = _Filtered(smoothing), {}

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            fresh, dead = rows["fresh"].to_numpy(bool), rows["deadzone"].to_numpy(bool)
            full = max(0.01, full_response)
            responses = {}
            for name in ("center_motion", "size_motion"):
                raw = rows[name].to_numpy(float)
                responses[name] = _ease(np.maximum(raw, motion(rows, name)) / full)
            parts = []
            for i, p in enumerate(sets):
                top = p["size_alpha_max"]
                if p["center_gated"]:
                    top = top + (p["high_motion_size_alpha_max"] - top) * responses["center_motion"]
                alpha = np.clip(alpha_min + (top - alpha_min) * responses["size_motion"], 0.0, 1.0)
                alpha = np.where(fresh, 1.0, np.where(dead, 0.0, alpha))
                part = rows[kept].assign(alpha=alpha)
                for side, raw in (("width", "raw_w"), ("height", "raw_h")):
                    before = carry.get((i, side), 0.0)
                    values = affine_scan(1.0 - alpha, alpha * rows[raw].to_numpy(float), before)
                    part[side], part[f"prev_{side}"] = values, _shifted(values, before)
                    carry[i, side] = values[-1]
                parts.append(part.assign(param_id=np.int32(i))[schema.names])
            return pd.concat(parts, ignore_index=True)

        return step

    return stream_pandas(ready, ["channel_id", "track_id", "cut"], [F.col("frame_id")], make, schema)


def _quantile_columns(df: DataFrame, metrics: dict[str, Column], wanted: list[tuple[str, str, float, float]]) -> DataFrame:
    """Percentiles of several metrics per parameter set in one pass.

    wanted: (output, metric, q, factor).
    """
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in metrics.items()])
    long = df.select("param_id", F.explode(entries).alias("m")).select("param_id", "m.metric", "m.value").where(F.col("value").isNotNull())
    qs = sorted({q for _, _, q, _ in wanted})
    table = exact_quantiles(long, ["param_id", "metric"], "value", {f"q{i}": q for i, q in enumerate(qs)})
    return table.groupBy("param_id").agg(
        *[(F.max(F.when(F.col("metric") == m, F.col(f"q{qs.index(q)}"))) * f).alias(out) for out, m, q, f in wanted]
    )


def replay_size(tracks: DataFrame, params: list[dict], rows: DataFrame | None = None, **options) -> DataFrame:
    """Jitter, step and error metrics of each size-filter setting, and fidelity to the log."""
    rows = checkpointed(replay_size_rows(tracks, params, **options)) if rows is None else rows
    c = F.col
    counts = c("counts")
    still, moving = counts & (c("speed") <= STILL), counts & (c("speed") >= MOVING)
    size_step = F.hypot(F.log(c("width") / c("prev_width")), F.log(c("height") / c("prev_height")))
    edge_step = F.hypot(c("width") - c("prev_width"), c("height") - c("prev_height")) * 0.5 / c("diagonal")
    size_error = F.hypot(F.log(c("width") / c("raw_w")), F.log(c("height") / c("raw_h")))
    edge_error = F.hypot(c("width") - c("raw_w"), c("height") - c("raw_h")) * 0.5 / c("diagonal")
    width_error, height_error = F.abs(c("width") - c("logged_w")), F.abs(c("height") - c("logged_h"))
    worst = F.greatest(width_error, height_error)
    path = F.when(c("fresh"), "reset").when(c("deadzone"), "deadzone").otherwise("adaptive")
    plain = rows.groupBy("param_id").agg(
        F.count("*").alias("track_samples"),
        F.count_if(counts).alias("active_transitions"),
        F.count_if(still).alias("stationary_transitions"),
        F.count_if(moving).alias("moving_transitions"),
        (S.rms(F.when(still, size_step)) * 100).alias("static_size_step_rms_pct"),
        (S.rms(F.when(still, edge_step)) * 100).alias("static_edge_step_rms_pct_diag"),
        F.max(worst).alias("replay_error_max_px"),
        F.min_by(F.struct("frame_id", "track_id", path.alias("path")), F.struct(-worst, c("frame_id"), c("track_id"))).alias("w"),
        F.avg("alpha").alias("mean_size_alpha"),
    )
    ranks = _quantile_columns(
        rows,
        {
            "size_step": F.when(still, size_step), "size_error": F.when(moving, size_error), "edge_error": F.when(moving, edge_error),
            "moving_step": F.when(moving, edge_step), "edge_step": F.when(counts, edge_step), "w": width_error, "h": height_error,
        },
        [
            ("static_size_step_p90_pct", "size_step", 0.90, 100.0),
            ("moving_size_error_p90_pct", "size_error", 0.90, 100.0),
            ("moving_edge_error_p90_pct_diag", "edge_error", 0.90, 100.0),
            ("moving_edge_step_p90_pct_diag", "moving_step", 0.90, 100.0),
            ("all_edge_step_p95_pct_diag", "edge_step", 0.95, 100.0),
            ("replay_width_error_p99_px", "w", 0.99, 1.0),
            ("replay_height_error_p99_px", "h", 0.99, 1.0),
        ],
    )
    out = plain.join(ranks, "param_id", "left")
    settings = _with_settings(out, params)
    return settings.select(
        "*", c("w.frame_id").alias("replay_error_max_frame"), c("w.track_id").alias("replay_error_max_track_id"), c("w.path").alias("replay_error_max_path")
    ).drop("w")


def _with_settings(df: DataFrame, params: list[dict]) -> DataFrame:
    """Parameter values by ``param_id``, from a literal list."""
    listed = F.array(*[
        F.struct(
            F.lit(float(p["size_alpha_max"])).alias("size_alpha_max"),
            F.lit(bool(p.get("center_gated", False))).alias("center_gated"),
            F.lit(float(p.get("high_motion_size_alpha_max", 0.45))).alias("high_motion_size_alpha_max"),
        )
        for p in params
    ])
    picked = df.withColumn("__s", F.element_at(listed, F.col("param_id") + 1))
    return picked.select("*", "__s.*").drop("__s")


def fidelity(report: DataFrame, limit_px: float = FIDELITY_PX) -> DataFrame:
    """Whether the first setting reproduces the log: P99 width and height error within the limit."""
    ok = (F.col("replay_width_error_p99_px") <= limit_px) & (F.col("replay_height_error_p99_px") <= limit_px)
    return report.where(F.col("param_id") == 0).select("param_id", ok.alias("faithful"))


def recommend(report: DataFrame) -> DataFrame:
    """Least jitter among settings at least 5 % calmer that follow motion at most 10 % worse.

    Without one the answer is the first setting, the baseline.
    """
    jitter, error = "static_edge_step_rms_pct_diag", "moving_edge_error_p90_pct_diag"
    base = report.where(F.col("param_id") == 0).select(F.col(jitter).alias("__j"), F.col(error).alias("__e"), F.col("size_alpha_max").alias("__a"))
    joined = report.join(F.broadcast(base), F.lit(True))  # one row
    gain = F.when(F.col("__j") > 1e-12, (F.col("__j") - F.col(jitter)) / F.col("__j") * 100)
    worse = F.when(F.col("__e") > 1e-12, (F.col(error) - F.col("__e")) / F.col("__e") * 100)
    passed = F.coalesce((gain >= 5.0) & (worse <= 10.0), F.lit(False))
    best = joined.agg(
        F.min_by(F.when(passed, F.col("size_alpha_max")), F.when(passed, F.struct(jitter, "param_id"))).alias("__best"),
        F.max("__a").alias("__a"), F.count_if(passed).alias("eligible"),
    )
    return best.select(F.coalesce("__best", "__a").alias("size_alpha_max"), "eligible")


def replay_center_rows(tracks: DataFrame, params: list[dict], alpha_min: float = 0.18, alpha_max: float = 0.90, full_response: float = 1.20,
                       smoothing: float = 0.35, max_correction_px: float = 120.0, block: int = 100_000) -> DataFrame:
    """Centre, weight and step of every sample under every parameter set.

    A set has ``weight`` (of the momentary motion) and, optionally, ``global_alpha``:
    then the smoothed common motion of the frame is fed forward.
    """
    sets = [{"global_alpha": None, **p} for p in params]
    ready = prepare(tracks, block)
    shared = {a for p in sets if (a := p["global_alpha"]) is not None}
    names = {a: f"g{i}" for i, a in enumerate(sorted(shared))}
    if names:
        common = checkpointed(frame_motion(tracks, block=block))
        for a, n in names.items():
            smooth = smooth_motion(common, a, reset_after_ms=None).select(
                "channel_id", "frame_id", F.col("smooth_dx").alias(f"{n}_x"), F.col("smooth_dy").alias(f"{n}_y")
            )
            ready = ready.join(smooth, ["channel_id", "frame_id"], "left").fillna(0.0, [f"{n}_x", f"{n}_y"])
    kept = ["channel_id", "track_id", "frame_id", "deadzone", "fresh", "raw_cx", "raw_cy", "logged_cx", "logged_cy", "diagonal", "speed", "counts"]
    schema = ready.select(*kept).schema
    for c in ("alpha", "cx", "cy", "step_x", "step_y", "last_x", "last_y"):
        schema = schema.add(c, "double")
    schema = schema.add("param_id", "integer")

    def walk(alpha, raw, shift, fresh, dead, before):
        """Plain walk, for batches in which a correction hits its limit."""
        out, at = np.empty_like(raw), np.array(before)
        for i in range(len(alpha)):
            if fresh[i]:
                at = raw[i]
            elif not dead[i]:
                d = shift[i] + alpha[i] * (raw[i] - at - shift[i])
                far = np.hypot(*d)
                at = at + (d if far <= max_correction_px else d * (max_correction_px / far))
            out[i] = at
        return out

    def make():
        motion, carry = _Filtered(smoothing), {}

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            fresh, dead = rows["fresh"].to_numpy(bool), rows["deadzone"].to_numpy(bool)
            now, filtered = rows["center_motion"].to_numpy(float), motion(rows, "center_motion")
            raw = rows[["raw_cx", "raw_cy"]].to_numpy(float)
            parts = []
            for i, p in enumerate(sets):
                response = _ease(np.maximum(now * p["weight"], filtered) / max(0.01, full_response))
                alpha = np.clip(alpha_min + (alpha_max - alpha_min) * response, 0.0, 1.0)
                alpha = np.where(fresh, 1.0, np.where(dead, 0.0, alpha))
                name = names.get(p["global_alpha"])
                shift = rows[[f"{name}_x", f"{name}_y"]].to_numpy(float) if name else np.zeros_like(raw)
                shift = np.where((fresh | dead)[:, None], 0.0, shift)
                before = carry.get(i, (np.zeros(2), np.full(2, np.nan)))
                keep = 1.0 - alpha
                place = np.stack([affine_scan(keep, alpha * raw[:, k] + keep * shift[:, k], before[0][k]) for k in (0, 1)], axis=1)
                moved = place - np.vstack([before[0], place[:-1]])
                if np.any(np.hypot(moved[:, 0], moved[:, 1])[~fresh] > max_correction_px):
                    place = walk(alpha, raw, shift, fresh, dead, before[0])
                    moved = place - np.vstack([before[0], place[:-1]])
                moved[fresh] = np.nan
                last = np.vstack([before[1], moved[:-1]])
                last[fresh] = np.nan
                carry[i] = (place[-1], moved[-1])
                part = rows[kept].assign(alpha=alpha, cx=place[:, 0], cy=place[:, 1], step_x=moved[:, 0], step_y=moved[:, 1],
                                         last_x=last[:, 0], last_y=last[:, 1], param_id=np.int32(i))
                parts.append(part[schema.names])
            return pd.concat(parts, ignore_index=True)

        return step

    rows = stream_pandas(ready, ["channel_id", "track_id", "cut"], [F.col("frame_id")], make, schema)
    return rows.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("step_x", "step_y", "last_x", "last_y")})


def replay_center(tracks: DataFrame, params: list[dict], rows: DataFrame | None = None, **options) -> DataFrame:
    """Jitter, roughness, error and step metrics of each centre-filter setting."""
    rows = checkpointed(replay_center_rows(tracks, params, **options)) if rows is None else rows
    c = F.col
    counts = c("counts") & c("step_x").isNotNull()
    still, moving = counts & (c("speed") <= STILL), counts & (c("speed") >= MOVING)
    step = F.hypot("step_x", "step_y") / c("diagonal")
    error = F.hypot(c("cx") - c("raw_cx"), c("cy") - c("raw_cy")) / c("diagonal")
    rough = F.hypot(c("step_x") - c("last_x"), c("step_y") - c("last_y")) / c("diagonal")
    off = F.hypot(c("cx") - c("logged_cx"), c("cy") - c("logged_cy"))
    plain = rows.groupBy("param_id").agg(
        F.count("*").alias("track_samples"),
        (S.rms(F.when(still, step)) * 100).alias("static_center_step_rms_pct_diag"),
        (S.rms(F.when(still & c("last_x").isNotNull(), rough)) * 100).alias("static_center_roughness_rms_pct_diag"),
        F.avg("alpha").alias("mean_center_alpha"),
        F.max(off).alias("baseline_center_error_max_px"),
    )
    ranks = _quantile_columns(
        rows,
        {"still_error": F.when(still, error), "moving_error": F.when(moving, error), "moving_step": F.when(moving, step),
         "step": F.when(counts, step), "off": off},
        [
            ("static_center_error_p90_pct_diag", "still_error", 0.90, 100.0),
            ("moving_center_error_p90_pct_diag", "moving_error", 0.90, 100.0),
            ("moving_center_step_p90_pct_diag", "moving_step", 0.90, 100.0),
            ("all_center_step_p95_pct_diag", "step", 0.95, 100.0),
            ("baseline_center_error_p99_px", "off", 0.99, 1.0),
        ],
    )
    listed = F.array(*[F.struct(F.lit(float(p["weight"])).alias("weight"), F.lit(p.get("global_alpha")).cast("double").alias("global_alpha")) for p in params])
    return plain.join(ranks, "param_id", "left").withColumn("__s", F.element_at(listed, c("param_id") + 1)).select("*", "__s.*").drop("__s")
