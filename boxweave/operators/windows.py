"""Ordered operators: change detection, dwell, throttling, curves, sampling."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxweave.functions import geometry as G
from boxweave.operators.compose import entry_states
from boxweave.operators.joins import BOX_COLUMNS
from boxweave.operators.pacing import paced
from boxweave.operators.scan import Step, chains, ordered_scan, time_block
from boxweave.operators.sequential import affine_scan, group_tables, numbers, starts, stream, with_columns
from boxweave.session import broadcast_if_small, checkpointed

HOUR_MS = 3_600_000


def changed_only(reports: DataFrame, key: str = "summary_key", events: str | None = "has_events",
                 block_ms: int = HOUR_MS) -> DataFrame:
    """Ticks whose summary differs from the tick before, or that carry events; the first always."""
    scanned = ordered_scan(
        reports, ["channel_id"], [time_block("ts_ms", block_ms)], [F.col("ts_ms")],
        [Step("__before", "lag", F.struct(F.col(key).alias("k")))],
    )
    fresh = F.col("__before").isNull() | ~F.col("__before.k").eqNullSafe(F.col(key))
    return scanned.where(fresh | F.col(events) if events else fresh).drop("__before")


def roi_dwell(boxes: DataFrame, dwell_sec: float, iou_min: float = 0.20, block_ms: int = HOUR_MS) -> DataFrame:
    """Boxes that have stayed in a region for ``dwell_sec`` or longer.

    A chain per (channel, region, class) restarts when a box overlaps the one before it
    by less than ``iou_min``. Rows need ``region_ord``, ``ts_ms``, ``det_ord``.
    """
    keys = ["channel_id", "region_ord", "class_id"]

    def moved(previous, current):
        return G.iou(G.Box(*[previous(c) for c in BOX_COLUMNS]), G.Box(*[current(c) for c in BOX_COLUMNS])) < iou_min

    chained = chains(
        boxes, keys, [time_block("ts_ms", block_ms)], [F.col("ts_ms"), F.col("det_ord")], BOX_COLUMNS, moved, F.col("ts_ms"), {"__since": "since"}
    )
    timed = chained.withColumn("dwell_sec", (F.col("ts_ms") - F.col("__since")) / 1000.0)
    return timed.where(F.col("dwell_sec") >= dwell_sec).drop("__since")


def connection_epoch(frames: DataFrame, keys: list[str] | None = None, pts: str = "pts_ms", block: int = 100_000) -> DataFrame:
    """Count of times the media clock fell back while frame numbers grew."""
    keys = keys or ["channel_id"]
    counted = chains(
        frames, keys, [time_block("frame_id", block)], [F.col("frame_id")], [pts], lambda p, c: p(pts) > c(pts), F.col("frame_id"), {"epoch": "count"}
    )
    return counted.withColumn("epoch", F.col("epoch") - 1)


def neighbours(samples: DataFrame, block_ms: int = HOUR_MS) -> DataFrame:
    """Samples with ``before``: steps and track ids of the sample before, per run."""
    fields = F.struct("raw_dx", "raw_dy", "smooth_dx", "smooth_dy", "stable_ids", "active_ids")
    return ordered_scan(
        samples, ["run_id"], [time_block("pts_ms", block_ms)], [F.col("pts_ms"), F.col("frame_id")], [Step("before", "lag", fields)]
    )


def turn_counts(side: str, min_step: float = 0.5) -> tuple[Column, Column]:
    """(eligible steps, turns back) over ``neighbours``, both aggregates."""
    dx, dy, px, py = F.col(f"{side}_dx"), F.col(f"{side}_dy"), F.col(f"before.{side}_dx"), F.col(f"before.{side}_dy")
    same = F.col("before").isNotNull() & (F.col("before.stable_ids") == F.col("stable_ids"))
    eligible = same & (F.hypot(dx, dy) > min_step) & (F.hypot(px, py) > min_step)
    return F.count_if(eligible), F.count_if(eligible & (dx * px + dy * py < 0))


def set_changes() -> Column:
    """Samples whose tracks differ from those before, an aggregate over ``neighbours``."""
    return F.count_if(F.col("before").isNotNull() & (F.col("before.active_ids") != F.col("active_ids")))


def reversal_rate(samples: DataFrame, smooth: bool, block_ms: int = HOUR_MS, min_step: float = 0.5) -> DataFrame:
    """Percent of steps that turn back, per run, over neighbours with the same steady tracks.

    Columns: run_id, eligible, reversals, rate_pct (null without eligible steps).
    """
    eligible, turns = turn_counts("smooth" if smooth else "raw", min_step)
    counted = neighbours(samples, block_ms).groupBy("run_id").agg(eligible.alias("eligible"), turns.alias("reversals"))
    return counted.withColumn("rate_pct", F.when(F.col("eligible") > 0, F.col("reversals") * 100.0 / F.col("eligible")))


def track_set_change_rate(samples: DataFrame, block_ms: int = HOUR_MS) -> DataFrame:
    """Percent of neighbouring samples whose set of tracks differs, per run."""
    out = neighbours(samples, block_ms).groupBy("run_id").agg(set_changes().alias("changes"), F.count("*").alias("samples"))
    return out.withColumn("rate_pct", F.col("changes") * 100.0 / F.greatest(F.lit(1), F.col("samples") - 1))


def motion_stats(matched: DataFrame, updates: DataFrame, block: int = 100_000) -> DataFrame:
    """Per update: medians over the tracks also matched in the update just before.

    ``updates`` lists every update of a channel (also those without a match, which break
    the chain); ``matched`` the active matches with raw and smooth boxes and raw deltas.
    """
    numbered = ordered_scan(
        updates.select("channel_id", "frame_id", "pts_ms"), ["channel_id"], [time_block("frame_id", block)], [F.col("frame_id")],
        [Step("update_no", "count"), Step("__before", "lag", F.struct(F.col("pts_ms").alias("p")))],
    )
    rows = matched.drop("pts_ms").join(numbered, ["channel_id", "frame_id"])
    sides = [f"{s}_{c}" for s in ("raw", "smooth") for c in BOX_COLUMNS]
    before = ordered_scan(
        rows, ["channel_id", "track_id"], [time_block("update_no", block)], [F.col("update_no")],
        [Step("__p", "lag", F.struct("update_no", "raw_dx", "raw_dy", *sides))],
    )
    steady = F.col("__p.update_no") == F.col("update_no") - 1
    step, last = F.hypot("raw_dx", "raw_dy"), F.hypot(F.col("__p.raw_dx"), F.col("__p.raw_dy"))
    turned = steady & (step > 0) & (last > 0) & (F.col("raw_dx") * F.col("__p.raw_dx") + F.col("raw_dy") * F.col("__p.raw_dy") < 0)

    # Medians per frame: a frame's tracks are bounded by the boxes a model head can give.
    def median(c: Column) -> Column:
        return F.percentile(F.when(steady, c), F.lit(0.5))

    aggs = []
    for s in ("raw", "smooth"):
        for prefix, name in (("", s), ("__p.", f"prev_{s}")):
            x1, y1, x2, y2 = [F.col(f"{prefix}{s}_{c}") for c in BOX_COLUMNS]
            aggs += [median((x1 + x2) * 0.5).alias(f"{name}_cx"), median((y1 + y2) * 0.5).alias(f"{name}_cy"),
                     median(G.side(x2 - x1)).alias(f"{name}_w"), median(G.side(y2 - y1)).alias(f"{name}_h")]
    per_frame = before.groupBy("channel_id", "frame_id", "pts_ms", F.col("__before.p").alias("prev_pts")).agg(
        F.count("*").alias("matched_active"), F.count_if(steady).alias("stable_tracks"), F.count_if(turned).alias("raw_reversals"),
        F.sort_array(F.collect_set("track_id")).alias("active_ids"),
        F.sort_array(F.collect_set(F.when(steady, F.col("track_id")))).alias("stable_ids"), *aggs,
    ).where(F.col("stable_tracks") > 0)
    col = F.col
    moved = per_frame.withColumns({f"{s}_d{a}": col(f"{s}_c{a}") - col(f"prev_{s}_c{a}") for s in ("raw", "smooth") for a in "xy"})
    diagonal = F.greatest(F.lit(1.0), F.hypot("raw_w", "raw_h"))

    def size_step(s: str) -> Column:
        return F.hypot(F.log(col(f"{s}_w") / col(f"prev_{s}_w")), F.log(col(f"{s}_h") / col(f"prev_{s}_h")))

    center_gap = F.hypot(col("raw_cx") - col("smooth_cx"), col("raw_cy") - col("smooth_cy"))
    return moved.select(
        "channel_id", "frame_id", "pts_ms", (col("pts_ms") - col("prev_pts")).alias("dt_ms"), "matched_active", "stable_tracks", "raw_reversals",
        "active_ids", "stable_ids",
        col("raw_cx").alias("raw_center_x"), col("raw_cy").alias("raw_center_y"),
        col("smooth_cx").alias("smooth_center_x"), col("smooth_cy").alias("smooth_center_y"),
        "raw_w", "raw_h", "smooth_w", "smooth_h", "raw_dx", "raw_dy", "smooth_dx", "smooth_dy",
        center_gap.alias("center_gap"), (center_gap / diagonal).alias("center_gap_ratio"),
        F.hypot(col("raw_dx") - col("smooth_dx"), col("raw_dy") - col("smooth_dy")).alias("delta_gap"),
        (F.hypot("raw_dx", "raw_dy") / diagonal).alias("raw_step_ratio"), (F.hypot("smooth_dx", "smooth_dy") / diagonal).alias("smooth_step_ratio"),
        size_step("raw").alias("raw_size_step"), size_step("smooth").alias("smooth_size_step"),
    )


def curve_order(image: str = "frame_id", image_block: Column | None = None) -> tuple[list[Column], list[Column]]:
    """Blocks and order of a precision-recall curve: best score first, then image, then box.

    Scores count in millionths. Many equal scores are cut further by image.
    """
    score = (-F.round(F.col("score") * 1e6)).cast("long")
    blocks = [score, image_block if image_block is not None else time_block(image, 100_000)]
    return blocks, [score, F.col(image), F.col("pred_ord")]


def pr_curve(matches: DataFrame, gt_counts: DataFrame, by: list[str], image: str = "frame_id", style: str = "detector") -> DataFrame:
    """Cumulative true and false positives, precision and recall along the score.

    ``gt_counts``: ``by`` and ``n_gt``. style: ``detector`` adds 1e-6 under the precision,
    ``dataset`` only avoids a zero.
    """
    blocks, order = curve_order(image)
    hit = F.col("tp").cast("long")
    curve = ordered_scan(matches, by, blocks, order, [Step("cum_tp", "sum", hit), Step("cum_fp", "sum", 1 - hit)])
    seen = F.col("cum_tp") + F.col("cum_fp")
    precision = F.col("cum_tp") / (seen + 1e-6) if style == "detector" else F.col("cum_tp") / F.greatest(seen.cast("double"), F.lit(1e-9))
    with_gt = curve.join(gt_counts, by, "left")
    n_gt = F.coalesce(F.col("n_gt"), F.lit(0))
    return with_gt.withColumns({"n_gt": n_gt, "precision": precision, "recall": F.col("cum_tp") / F.greatest(n_gt, F.lit(1))})


def precision_envelope(curve: DataFrame, by: list[str], image: str = "frame_id") -> DataFrame:
    """Best precision at this or any later point."""
    blocks, order = curve_order(image)
    return ordered_scan(curve, by, blocks, order, [Step("envelope", "max", F.col("precision"))], reverse=True)


def mark_duplicates(df: DataFrame, hash_col: str = "sha256", order: list[str] | None = None, name: str = "path", salts: int = 16) -> DataFrame:
    """``duplicate_of``: name of the first row with the same content, null for that row itself.

    The first of each content comes from an aggregate with map-side combine; only contents
    that repeat meet the rows again, each listed under every salt so that one often copied
    content does not land in one task.
    """
    order = order or [name]
    rank = F.struct(*order)
    firsts = (
        df.groupBy(hash_col)
        .agg(F.count("*").alias("copies"), F.min_by(F.struct(name), rank).alias("first"), F.min(rank).alias("first_rank"))
        .where(F.col("copies") > 1)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    salted = df.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    joined = salted.join(firsts, [hash_col, "salt"], "left")
    repeated = F.col("copies").isNotNull() & (F.col("first_rank") != rank)
    return joined.select(*df.columns, F.when(repeated, F.col(f"first.{name}")).alias("duplicate_of"))


def numbered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` with ``__i``, the place of each row in its group (from 0) in ``order``, and ``__size``, the group's rows.

    Rows are dealt by ranges of group and order, whose bounds Spark takes from a sample, so neither a large group nor a
    prefix that all names share ends in one task; what lies before a range comes from the ranges' counts.
    """
    at, key = F.col("__at"), F.struct(*by).alias("__key")
    dealt = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn("__at", F.monotonically_increasing_id())
    dealt = checkpointed(dealt).select("*", key, F.shiftright(at, 33).alias("__part"))
    spans = dealt.groupBy("__key", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy("__key")
    before = F.sum("__n").over(group.orderBy("__part")) - F.col("__n")
    placed = spans.select("__key", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias("__size"))
    return dealt.join(placed, ["__key", "__part"]).select(*df.columns, (at + F.col("__shift")).alias("__i"), "__size")


def evenly_spaced(df: DataFrame, by: list[str], n: int, order: str) -> DataFrame:
    """``n`` rows of each group at even distances in name order; all if there are fewer.

    With one row wanted it is the middle one.
    """
    if n <= 0:
        raise ValueError("sample count must be positive")
    i, size = F.col("__i"), F.col("__size")
    if n == 1:
        wanted = i == F.floor(size / 2)
    else:
        # The sampled indexes are (k * (size-1)) div (n-1): i is one of them when the
        # smallest k that reaches i lands exactly on it.
        k = F.ceil(i * (n - 1) / (size - 1))
        wanted = F.floor(k * (size - 1) / (n - 1)) == i
    return numbered(df, by, order).where((size <= n) | wanted).drop("__i", "__size")


def first_n(df: DataFrame, by: list[str], n: int, order: str) -> DataFrame:
    """First ``n`` rows of each group in name order (Spark limits each group before the shuffle)."""
    ranked = df.withColumn("__no", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return ranked.where(F.col("__no") <= n).drop("__no")


def thin_by_gap(df: DataFrame, keys: list[str], time: str, gap: int, unit: int = 1, block: int = HOUR_MS) -> DataFrame:
    """Greedy spacing: keep a row when at least ``gap`` (in whole ``unit``) passed since the last kept one."""
    return paced(df, keys, time, gap * unit, newest=False, block=block)


def throttle_ticks(df: DataFrame, interval_sec: int, exact: bool = True) -> DataFrame:
    """Report ticks at least ``interval_sec`` whole seconds apart; or the newest per aligned window."""
    if exact:
        return thin_by_gap(df, ["channel_id"], "ts_ms", interval_sec, unit=1000)
    return newest_per_bucket(df, ["channel_id"], "ts_ms", interval_sec * 1000)


def newest_per_bucket(df: DataFrame, keys: list[str], time: str, width: int) -> DataFrame:
    """The newest row of each aligned time bucket."""
    rest = [c for c in df.columns if c not in keys]
    bucketed = df.withColumn("__bucket", time_block(time, width))
    newest = bucketed.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(*rest), F.col(time)).alias("r"))
    return newest.select(*keys, "r.*").select(*df.columns)


class Mailbox:
    """The newest row waits; it leaves when ``gap`` has passed since the last one left.

    A row that arrives when that time is over leaves at once. ``due`` is when the next may leave,
    None before the first row.
    """

    def __init__(self, gap: int, due: int | None = None, waiting=None):
        self.gap, self.due, self.waiting = gap, due, waiting

    def clock(self, now: int):
        """(row, time) that leaves before ``now``, or None."""
        if self.waiting is None or self.due >= now:
            return None
        out, self.waiting = (self.waiting, self.due), None
        self.due += self.gap
        return out

    def put(self, row, time: int):
        """Take a row; (row, time) if it leaves at once."""
        if self.due is None or (self.waiting is None and time >= self.due):
            self.due = time + self.gap
            return row, time
        self.waiting = row
        return None


def thin_to_newest(df: DataFrame, keys: list[str], time: str, gap: int, block: int = HOUR_MS) -> DataFrame:
    """Rows that leave a one-row mailbox per key: ``gap`` apart, each the newest at its time (see ``Mailbox``)."""
    return paced(df, keys, time, gap, newest=True, block=block)


def rate_thin(df: DataFrame, fps: int, exact: bool = True) -> DataFrame:
    """At most ``fps`` rows a second per channel, ``1000 div fps`` ms apart and each the newest at its time; or newest per bucket."""
    spacing = 1000 // fps
    return thin_to_newest(df, ["channel_id"], "ts_ms", spacing) if exact else newest_per_bucket(df, ["channel_id"], "ts_ms", spacing)


def equivalent_lag(samples: DataFrame) -> DataFrame:
    """Delay of the smooth centre behind the raw one along the motion, where positive."""
    step = F.hypot("raw_dx", "raw_dy")
    off_x = F.col("raw_center_x") - F.col("smooth_center_x")
    off_y = F.col("raw_center_y") - F.col("smooth_center_y")
    along = (off_x * F.col("raw_dx") + off_y * F.col("raw_dy")) / step
    lagged = samples.where(step > 1e-6).withColumn("__along", along)
    return lagged.where(F.col("__along") > 0).withColumn("lag_ms", F.col("__along") / step * F.col("dt_ms")).drop("__along")


#: A block of frames as a map: where the time before it is under ``breaks[i]`` it ends at ``exits[i]`` (the first such i),
#: above all breaks it moves on by ``steps``; ``alone`` is its end with no frame before.
REPAIR_TABLE = "breaks array<bigint>, exits array<bigint>, steps bigint, alone bigint"


def _repaired(values: list[int | None], last: int | None, step_ms: int) -> list[int]:
    """The rule: a value above the last one stands, all others follow it by one step; the first counts as 0 if it is missing."""
    out = []
    for value in values:
        last = (value or 0) if last is None else value if value is not None and value > last else last + step_ms
        out.append(last)
    return out


def _repair_map(values: list[int | None], step_ms: int) -> dict:
    """Frame i is the first to stand if it is above the time before and i steps more; the frame after it likewise."""
    n, marks = len(values), [None if v is None else v - i * step_ms for i, v in enumerate(values)]
    ends, ahead = [0] * n, []  # ahead: places to the right, their marks falling from the right end to the left
    for i in range(n - 1, -1, -1):
        if marks[i] is None:
            continue
        # The nearest place above the bar lies last among those above it.
        above = bisect_left(ahead, -(marks[i] - step_ms), key=lambda j: -marks[j])
        ends[i] = ends[ahead[above - 1]] if above else values[i] + (n - 1 - i) * step_ms
        while ahead and marks[ahead[-1]] <= marks[i]:
            ahead.pop()
        ahead.append(i)
    breaks, exits = [], []
    for i in ahead:  # the marks that exceed all before them, from the greatest
        if not exits or exits[-1] != ends[i]:
            breaks.append(marks[i])
            exits.append(ends[i])
    return {"breaks": breaks[::-1], "exits": exits[::-1], "steps": n * step_ms, "alone": _repaired(values, None, step_ms)[-1]}


def _repair_exit(table: dict, last: int) -> int:
    i = bisect_right(table["breaks"], last)
    return table["exits"][i] if i < len(table["breaks"]) else last + table["steps"]


def _repair_joined(a: dict, b: dict) -> dict:
    top = a["breaks"][-1] if a["breaks"] else None
    late = [(m - a["steps"], e) for m, e in zip(b["breaks"], b["exits"]) if top is None or m - a["steps"] > top]
    pairs = [*zip(a["breaks"], (_repair_exit(b, e) for e in a["exits"])), *late]
    kept = [p for p, following in zip(pairs, [*pairs[1:], (None, None)]) if p[1] != following[1]]
    return {"breaks": [m for m, _ in kept], "exits": [e for _, e in kept], "steps": a["steps"] + b["steps"], "alone": _repair_exit(b, a["alone"])}


def repair_pts(frames: DataFrame, step_ms: int, keys: list[str], block: int = 100_000) -> DataFrame:
    """Media time made strictly growing: missing or not above the last one means last plus step.

    What a block of frames does depends on the time before it alone, and by a map of few steps: as soon as a frame
    stands on its own, all that came before is forgotten. Blocks are composed (``compose``) and then repaired in parallel, also
    where one frame far ahead makes all that follow count on from it.
    """
    on = [*keys, "__block"]
    rows = checkpointed(frames.withColumn("__block", time_block("frame_id", block)))
    order = [F.col("frame_id")]

    def table(batch: pa.RecordBatch) -> dict[str, list]:
        return {k: [v] for k, v in _repair_map(batch.column("pts_ms").to_pylist(), step_ms).items()}

    def enter(own: dict, state: dict) -> dict:
        return {"last": own["alone"] if state["last"] is None else _repair_exit(own, state["last"])}

    tables = group_tables(rows.select(*on, "frame_id", F.col("pts_ms").cast("long").alias("pts_ms")), on, order, table, REPAIR_TABLE)
    entered = entry_states(tables, keys, REPAIR_TABLE, "last bigint", _repair_joined, enter).withColumnRenamed("last", "__last")
    schema = StructType([*frames.schema.fields]).add("repaired_pts_ms", "long")

    def make():
        held: dict = {"key": None, "last": None}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, entries, out = batch.column("__pts").to_pylist(), batch.column("__last"), []
            edges = [*starts(batch, on).tolist(), len(values)]
            for a, b in zip(edges, edges[1:]):
                key = tuple(batch.column(k)[a].as_py() for k in on)
                if key != held["key"]:
                    held.update(key=key, last=entries[a].as_py())
                out += _repaired(values[a:b], held["last"], step_ms)
                held["last"] = out[-1]
            return with_columns(batch, names, repaired_pts_ms=pa.array(out, pa.int64()))

        return step

    names = frames.columns
    ready = rows.join(entered, on).withColumn("__pts", F.col("pts_ms").cast("long"))
    return stream(ready, on, order, make, schema)


def frame_motion(tracks: DataFrame, min_tracks: int = 3, rule: str = "replay", block: int = 100_000) -> DataFrame:
    """Common motion of a frame: component medians over its continuous active tracks.

    ``replay``: active before and after and not reset. ``live``: the track was active.
    Frames with fewer than ``min_tracks`` such tracks have none.
    """
    cx, cy = (F.col("raw_x1") + F.col("raw_x2")) * 0.5, (F.col("raw_y1") + F.col("raw_y2")) * 0.5
    placed = tracks.withColumns({"__cx": cx, "__cy": cy})
    seen = ordered_scan(
        placed, ["channel_id", "track_id"], [time_block("frame_id", block)], [F.col("frame_id")],
        [Step("__p", "lag", F.struct("__cx", "__cy", "active"))],
    )
    usable = F.col("__p").isNotNull() & F.col("dt_ms").between(10, 250)
    usable = usable & (F.col("__p.active") & F.col("active") & ~F.col("reset") if rule == "replay" else F.col("was_active"))
    moved = seen.where(usable)
    # Exact medians of one frame's tracks, a group bounded by the model head.
    return (
        moved.groupBy("channel_id", "frame_id", "pts_ms")
        .agg(
            F.count("*").alias("tracks"),
            F.percentile(F.col("__cx") - F.col("__p.__cx"), F.lit(0.5)).alias("dx"),
            F.percentile(F.col("__cy") - F.col("__p.__cy"), F.lit(0.5)).alias("dy"),
        )
        .where(F.col("tracks") >= min_tracks)
    )


def smooth_motion(motion: DataFrame, alpha: float = 0.25, reset_after_ms: int | None = 250, block_ms: int = HOUR_MS) -> DataFrame:
    """Exponential smoothing of common motion; starts afresh after a pause (None: never)."""
    order = [F.col("pts_ms"), F.col("frame_id")]

    def paused(previous, current):
        gap = current("pts_ms") - previous("pts_ms")
        return F.lit(False) if reset_after_ms is None else (gap > reset_after_ms) | (gap <= 0)

    cut = chains(
        motion, ["channel_id"], [time_block("pts_ms", block_ms)], order, ["pts_ms"], paused, F.col("pts_ms"), {"__cut": "since", "__fresh": "starts"}
    )
    schema = StructType(list(motion.schema.fields)).add("smooth_dx", "double").add("smooth_dy", "double")
    columns = motion.columns

    def make():
        carry = {"dx": 0.0, "dy": 0.0}

        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            fresh = numbers(rows, "__fresh").astype(bool)
            keep, gain = np.where(fresh, 0.0, 1.0 - alpha), np.where(fresh, 1.0, alpha)
            smooth = {}
            for axis in ("dx", "dy"):
                smooth[f"smooth_{axis}"] = affine_scan(keep, gain * numbers(rows, axis), carry[axis])
                carry[axis] = float(smooth[f"smooth_{axis}"][-1])
            return with_columns(rows, columns, **smooth)

        return step

    return stream(cut, ["channel_id", "__cut"], order, make, schema)
