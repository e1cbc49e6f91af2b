"""Multi-object tracking: one small step per frame, batch and stream share it.

A channel is sequential by nature, but an update without boxes that comes later than
the time to live after the last box empties all state. Channels are cut after such
updates, so the parts run in parallel and still give the exact result; track numbers
are made continuous afterwards from the counts of the parts before.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from math import isfinite, log, sqrt
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxweave.functions import boxmath as M
from boxweave.functions.geometry import CROSS_CLASS_CONTAINMENT, CROSS_CLASS_IOU, SAME_CLASS_CONTAINMENT
from boxweave.operators.scan import Step, ordered_scan, time_block
from boxweave.operators.sequential import starts, stream
from boxweave.session import checkpointed

# Fixed value: hits in a row before a track takes over another class.
SWITCH_HITS = 2
GLOBAL_MOTION_STALE_MS = 250
#: Track-detection pairs of a frame up to which plain floats are faster than arrays; both give the same bits.
SMALL = 150
_first = itemgetter(0)


@dataclass(frozen=True)
class TrackerConfig:
    """The defaults equal those of the live system."""

    mode: str = "tracked"
    confirm_hits: int = 2
    ttl_ms: int = 300
    match_iou: float = 0.20
    center_distance_ratio: float = 0.12
    ema_alpha: float = 0.25
    deadzone_center_px: float = 6.0
    deadzone_size_ratio: float = 0.01
    innovation_iou: float = 0.45
    max_correction_px: float = 120.0
    jump_confirm_hits: int = 2
    adaptive_filter: bool = True
    center_alpha_min: float = 0.18
    center_alpha_max: float = 0.90
    size_alpha_min: float = 0.12
    size_alpha_max: float = 0.45
    center_gated_size_filter: bool = False
    low_motion_size_alpha_max: float = 0.20
    motion_full_response_ratio: float = 1.20
    motion_smoothing_alpha: float = 0.35
    display_hold_ms: int = 100
    reversal_damping: bool = False
    reversal_center_alpha_max: float = 0.35
    reversal_min_motion_ratio: float = 0.005
    global_motion: bool = False
    global_motion_alpha: float = 0.25
    global_motion_min_tracks: int = 3


@dataclass(slots=True)
class Seen:
    """One detection inside the tracker."""

    box: list[float]
    class_id: int
    label: str
    score: float


@dataclass(slots=True)
class Track:
    id: int
    shown: Seen
    last_pts: int
    measured: list[float]
    state: str
    hits: int = 1
    misses: int = 0
    jump: list[float] | None = None
    jump_hits: int = 0
    rival: Seen | None = None
    rival_hits: int = 0
    center_motion: float = 0.0
    size_motion: float = 0.0
    last_step: tuple[float, float] | None = None
    center_alpha: float = 1.0
    size_alpha: float = 1.0


@dataclass(slots=True)
class Update:
    """What one frame did."""

    shown: list[tuple[int, Seen]] = field(default_factory=list)
    motion: list[tuple] = field(default_factory=list)
    matched: int = 0
    created: int = 0
    lost: int = 0


def _limit(v: float, low: float = 0.0, high: float = 1.0) -> float:
    return min(high, max(low, v))


def _ease(v: float) -> float:
    t = _limit(v)
    return t * t * (3.0 - 2.0 * t)


def _root(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(x * x + y * y)


def _sides(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Corners, centre, area, width and height (one pixel at least) and diagonal of boxes."""
    x1, y1, x2, y2 = b
    w, h = x2 - x1, y2 - y1
    full = np.maximum(0.0, w) * np.maximum(0.0, h)
    w, h = np.maximum(1.0, w), np.maximum(1.0, h)
    return x1, y1, x2, y2, (x1 + x2) * 0.5, (y1 + y2) * 0.5, full, w * h, _root(w, h)


def _measures(tracks: np.ndarray, boxes: np.ndarray) -> dict[str, np.ndarray]:
    """All track-detection pairs of one frame at once; boxes come as four rows of coordinates."""
    ax1, ay1, ax2, ay2, acx, acy, ta, tp, tl = (v[:, None] for v in _sides(tracks))
    bx1, by1, bx2, by2, bcx, bcy, da, dp, dl = _sides(boxes)
    shared = np.maximum(0.0, np.minimum(ax2, bx2) - np.maximum(ax1, bx1)) * np.maximum(0.0, np.minimum(ay2, by2) - np.maximum(ay1, by1))
    small = np.minimum(ta, da)
    holds_d = (bcx >= ax1) & (bcx <= ax2) & (bcy >= ay1) & (bcy <= ay2)
    holds_t = (acx >= bx1) & (acx <= bx2) & (acy >= by1) & (acy <= by2)
    return {
        "iou": shared / np.maximum(1.0, ta + da - shared),
        "inside": np.where(small > 0, shared / np.where(small > 0, small, 1.0), 0.0),
        "centred": np.where(ta <= da, holds_t, holds_d),
        "distance": _root(acx - bcx, acy - bcy),
        "similar": np.minimum(tp, dp) / np.maximum(tp, dp),
        "longest": np.maximum(tl, dl),
    }


def _sided(box: list[float]) -> tuple[float, ...]:
    """``_sides`` of one box."""
    x1, y1, x2, y2 = box
    w, h = x2 - x1, y2 - y1
    full = w * h if w > 0.0 and h > 0.0 else 0.0
    w, h = max(1.0, w), max(1.0, h)
    return x1, y1, x2, y2, (x1 + x2) * 0.5, (y1 + y2) * 0.5, full, w * h, sqrt(w * w + h * h)


def _middle(values: tuple[float, ...]) -> float:
    """Median of at least one value."""
    v, half = sorted(values), len(values) // 2
    return v[half] if len(v) % 2 else (v[half - 1] + v[half]) / 2


def _one_to_one(ranked: Iterable[tuple[int, int, float, float, bool]]) -> list[tuple[int, int, float, float, bool]]:
    """Of the pairs, best first, those whose track and detection are both still free."""
    chosen, used_t, used_d = [], set(), set()
    for pair in ranked:
        a, b = pair[0], pair[1]
        if a not in used_t and b not in used_d:
            used_t.add(a)
            used_d.add(b)
            chosen.append(pair)
    return chosen


class Tracker:
    """State of one channel (or of one exact part of it)."""

    def __init__(self, config: TrackerConfig, frame_width: float, frame_height: float):
        self.config = config
        self.reach = max(48.0, M.length(frame_width, frame_height) * config.center_distance_ratio)
        self.tracks: list[Track] = []
        self.next_id = 1
        self.common: tuple[float, float] | None = None
        self.common_pts = 0

    # -- association

    def candidates(self, seen: list[Seen]) -> list[tuple[int, int, float, float, bool]]:
        """Chosen (track, detection, overlap, distance, rival) pairs, best first, one to one."""
        if not self.tracks or not seen:
            return []
        c = self.config
        if len(self.tracks) * len(seen) <= SMALL:
            found = self._few(seen)
            if found is not None:
                return _one_to_one(found)
        m = _measures(np.array([t.shown.box for t in self.tracks]).T, np.array([s.box for s in seen]).T)
        same = np.array([t.shown.class_id for t in self.tracks])[:, None] == np.array([s.class_id for s in seen])[None, :]
        near = (m["distance"] <= np.maximum(48.0, np.minimum(self.reach, 1.25 * m["longest"]))) & (m["similar"] >= 0.40)
        nested = (m["inside"] >= SAME_CLASS_CONTAINMENT) & m["centred"]
        rival = ~same & ((m["iou"] >= CROSS_CLASS_IOU) | ((m["inside"] >= CROSS_CLASS_CONTAINMENT) & m["centred"]))
        possible = np.where(same, (m["iou"] >= c.match_iou) | near | nested, rival)
        active = np.array([t.state == "active" for t in self.tracks])[:, None]
        score = (
            m["iou"] + m["similar"] * 0.10 + np.where(same, m["inside"] * 0.10, 0.05)
            - m["distance"] / self.reach * 0.05 + np.where(active, 0.05, 0.0)
        )
        at = np.flatnonzero(possible)
        flat, width = score.ravel()[at], len(seen)
        ranked = (divmod(k, width) for k in at[np.argsort(-flat, kind="stable")].tolist())
        return _one_to_one((a, b, float(m["iou"][a, b]), float(m["distance"][a, b]), bool(rival[a, b])) for a, b in ranked)

    def _few(self, seen: list[Seen]) -> list[tuple[int, int, float, float, bool]] | None:
        """The possible pairs of a small frame, best first, by the same steps on plain floats; None where a box is not finite."""
        c, reach = self.config, self.reach
        boxes, found = [_sided(s.box) for s in seen], []
        for a, t in enumerate(self.tracks):
            ax1, ay1, ax2, ay2, acx, acy, ta, tp, tl = track = _sided(t.shown.box)
            if not isfinite(sum(track)):
                return None
            kind, bonus = t.shown.class_id, 0.05 if t.state == "active" else 0.0
            for b, (bx1, by1, bx2, by2, bcx, bcy, da, dp, dl) in enumerate(boxes):
                w = (ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1)
                h = (ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1)
                shared = w * h if w > 0.0 and h > 0.0 else 0.0
                same = kind == seen[b].class_id
                if shared == 0.0 and not same:
                    continue
                dx, dy = acx - bcx, acy - bcy
                distance = sqrt(dx * dx + dy * dy)
                similar = tp / dp if tp < dp else dp / tp
                iou = shared / max(1.0, ta + da - shared)
                small = ta if ta < da else da
                inside = shared / small if small > 0 else 0.0
                if ta <= da:
                    centred = acx >= bx1 and acx <= bx2 and acy >= by1 and acy <= by2
                else:
                    centred = bcx >= ax1 and bcx <= ax2 and bcy >= ay1 and bcy <= ay2
                if same:
                    near = similar >= 0.40 and distance <= max(48.0, min(reach, 1.25 * (tl if tl > dl else dl)))
                    if not (near or iou >= c.match_iou or (centred and inside >= SAME_CLASS_CONTAINMENT)):
                        continue
                elif not (iou >= CROSS_CLASS_IOU or (centred and inside >= CROSS_CLASS_CONTAINMENT)):
                    continue
                score = iou + similar * 0.10 + (inside * 0.10 if same else 0.05) - distance / reach * 0.05 + bonus
                found.append((-score, a, b, iou, distance, not same))
        if not all(isfinite(sum(box)) for box in boxes):
            return None
        found.sort(key=_first)
        return [f[1:] for f in found]

    def common_motion(self, chosen, seen: list[Seen], pts: int) -> tuple[float, float] | None:
        """Smoothed median step of the active tracks, when enough of them moved on."""
        c = self.config
        if not c.global_motion:
            return None
        steps = []
        for a, b, *_ in chosen:
            t = self.tracks[a]
            if t.state == "active" and 10 <= pts - t.last_pts <= 250:
                (nx, ny), (ox, oy) = M.center(seen[b].box), M.center(t.measured)
                steps.append((nx - ox, ny - oy))
        if len(steps) < max(1, c.global_motion_min_tracks):
            return None
        now = tuple(_middle(v) for v in zip(*steps))
        fresh = self.common is None or pts - self.common_pts > GLOBAL_MOTION_STALE_MS or pts <= self.common_pts
        a = _limit(c.global_motion_alpha)
        self.common = now if fresh else tuple(a * n + (1 - a) * o for n, o in zip(now, self.common))
        self.common_pts = pts
        return self.common

    # -- filtering

    def _adapt(self, t: Track, prior: list[float], box: list[float], dt: float, shift: tuple[float, float]) -> list[float]:
        """Follow fast motion closely and slow motion smoothly, centre and size apart."""
        c = self.config
        (pw, ph), (mw, mh), (lw, lh) = M.size(prior), M.size(box), M.size(t.measured)
        (pcx, pcy), (mcx, mcy), (lcx, lcy) = M.center(prior), M.center(box), M.center(t.measured)
        diagonal = max(32.0, M.length((lw + mw) * 0.5, (lh + mh) * 0.5))
        dx, dy = mcx - lcx, mcy - lcy
        moved = M.length(dx, dy)
        raw_center = moved / diagonal / dt
        raw_size = M.length(log(mw / lw), log(mh / lh)) / dt
        k = _limit(c.motion_smoothing_alpha)
        t.center_motion = k * raw_center + (1 - k) * t.center_motion
        t.size_motion = k * raw_size + (1 - k) * t.size_motion
        full = max(0.01, c.motion_full_response_ratio)
        center_response = _ease(max(raw_center, t.center_motion) / full)
        size_response = _ease(max(raw_size, t.size_motion) / full)
        t.center_alpha = _limit(c.center_alpha_min + (c.center_alpha_max - c.center_alpha_min) * center_response)
        top = c.size_alpha_max
        if c.center_gated_size_filter:
            calm = _limit(c.low_motion_size_alpha_max, c.size_alpha_min, c.size_alpha_max)
            top = calm + (c.size_alpha_max - calm) * center_response
        t.size_alpha = _limit(c.size_alpha_min + (top - c.size_alpha_min) * size_response)
        least = max(0.0, c.reversal_min_motion_ratio) * diagonal
        if c.reversal_damping and t.last_step and moved >= least and M.length(*t.last_step) >= least:
            if dx * t.last_step[0] + dy * t.last_step[1] < 0:
                t.center_alpha = min(t.center_alpha, _limit(c.reversal_center_alpha_max))
        if moved >= least:
            t.last_step = (dx, dy)
        a, s = t.center_alpha, t.size_alpha
        return M.around(
            a * mcx + (1 - a) * (pcx + shift[0]), a * mcy + (1 - a) * (pcy + shift[1]), s * mw + (1 - s) * pw, s * mh + (1 - s) * ph
        )

    def _in_deadzone(self, prior: list[float], box: list[float]) -> bool:
        c = self.config
        w, h = M.size(prior)
        return (
            M.distance(prior, box) < c.deadzone_center_px
            and abs((box[2] - box[0]) - w) / w < c.deadzone_size_ratio
            and abs((box[3] - box[1]) - h) / h < c.deadzone_size_ratio
        )

    def _held_back(self, prior: list[float], box: list[float]) -> list[float]:
        far = M.distance(prior, box)
        limit = self.config.max_correction_px
        if far <= limit or far <= 0.001:
            return box
        (px, py), (cx, cy), f = M.center(prior), M.center(box), limit / far
        return M.around(px + (cx - px) * f, py + (cy - py) * f, box[2] - box[0], box[3] - box[1])

    def _waits(self, t: Track, s: Seen, pts: int, overlap: float, distance: float, rival: bool) -> tuple[bool, bool]:
        """(the match has to wait for confirmation, a class switch was confirmed)."""
        c, switched = self.config, False
        if rival:
            again = t.rival_hits > 0 and t.rival.class_id == s.class_id and M.rivals(t.rival.box, s.box)
            if again:
                t.rival_hits += 1
            else:
                t.rival, t.rival_hits = s, 1
            if t.rival_hits < SWITCH_HITS:
                # A pending rival keeps the track alive; a pending jump (below) does not.
                t.last_pts, t.misses = pts, 0
                return True, False
            switched = True
        t.rival_hits = 0
        if distance > c.max_correction_px and overlap < c.innovation_iou and t.state != "active":
            if t.jump_hits > 0 and M.distance(t.jump, s.box) <= c.max_correction_px:
                t.jump_hits += 1
            else:
                t.jump, t.jump_hits = s.box, 1
            if t.jump_hits < c.jump_confirm_hits:
                return True, switched
        return False, switched

    def _follow(self, t: Track, s: Seen, pts: int, overlap: float, switched: bool, common) -> tuple[bool, bool]:
        """Move the shown box towards the detection; returns (deadzone, reset)."""
        c, prior = self.config, t.shown.box
        dt = max(0.001, (pts - t.last_pts) / 1000.0)
        dead, reset, box = self._in_deadzone(prior, s.box), False, prior
        if dead:
            k = 1.0 - c.motion_smoothing_alpha
            t.center_motion, t.size_motion = t.center_motion * k, t.size_motion * k
            t.center_alpha = t.size_alpha = 0.0
        else:
            reset = t.state != "active" or overlap < c.match_iou or switched
            if reset:
                box, t.center_motion, t.size_motion, t.last_step = s.box, 0.0, 0.0, None
                t.center_alpha = t.size_alpha = 1.0
            elif c.adaptive_filter:
                box = self._adapt(t, prior, s.box, dt, common or (0.0, 0.0))
            else:
                a = t.center_alpha = t.size_alpha = c.ema_alpha
                # Centre and size blend by the same weight, so the corners do too.
                box = [a * n + (1 - a) * o for n, o in zip(s.box, prior)]
        if not reset:
            box = self._held_back(prior, box)
        named = t.shown if dead else s
        t.shown = Seen(box, named.class_id, named.label, s.score)
        t.measured = s.box
        return dead, reset

    # -- one frame

    def update(self, frame_pts: int, seen: list[Seen]) -> Update:
        c, pts, out = self.config, frame_pts, Update()
        if c.mode == "raw":
            out.shown = [(0, s) for s in seen]
            return out
        chosen = self.candidates(seen)
        common = self.common_motion(chosen, seen, pts)
        met_t = {a for a, *_ in chosen}
        met_d = {b for _, b, *_ in chosen}
        for a, b, overlap, distance, rival in chosen:
            t, s = self.tracks[a], seen[b]
            was_active, before = t.state == "active", t.last_pts
            raw_step = tuple(n - o for n, o in zip(M.center(s.box), M.center(t.measured)))
            waits, switched = self._waits(t, s, pts, overlap, distance, rival)
            if waits:
                continue
            dead, reset = self._follow(t, s, pts, overlap, switched, common)
            t.jump_hits, t.last_pts, t.misses = 0, pts, 0
            t.hits += 1
            if t.hits >= c.confirm_hits:
                t.state = "active"
            out.matched += 1
            out.motion.append((t.id, s, t.shown.box, max(1, pts - before), dead, reset, was_active, t.state == "active", t.center_alpha, t.size_alpha, *raw_step))
        for i, t in enumerate(self.tracks):
            t.misses += i not in met_t
        for b, s in enumerate(seen):
            if b not in met_d:
                state = "active" if c.confirm_hits <= 1 else "tentative"
                t = Track(self.next_id, s, pts, s.box, state)
                self.next_id += 1
                self.tracks.append(t)
                out.created += 1
                out.motion.append((t.id, s, s.box, 0, False, True, False, state == "active", 1.0, 1.0, 0.0, 0.0))
        for t in self.tracks:
            if t.state == "active" and pts - t.last_pts > c.display_hold_ms:
                t.state = "shadow"
        alive = [t for t in self.tracks if pts - t.last_pts <= c.ttl_ms and not (t.hits < c.confirm_hits and t.misses > 0)]
        kept = self._without_twins(alive, pts)
        out.lost = len(self.tracks) - len(kept)
        self.tracks = kept
        # No two of those that are left lie in one place, so what is shown needs no further choice.
        out.shown = [(t.id, t.shown) for t in kept if self.displayable(t, pts)]
        return out

    def displayable(self, t: Track, pts: int) -> bool:
        c = self.config
        return t.state == "active" and t.hits >= c.confirm_hits and pts - t.last_pts <= c.display_hold_ms

    def _without_twins(self, tracks: list[Track], pts: int) -> list[Track]:
        """Of two tracks in one place keep the displayable, fresher, better, longer one."""

        def worth(t: Track):
            return self.displayable(t, pts), t.last_pts, t.shown.score, t.hits

        out: set[int] = set()
        boxes = [t.shown.box for t in tracks]
        for i, a in enumerate(tracks):
            if i in out:
                continue
            x1, y1, x2, y2 = box = boxes[i]
            for j in range(i + 1, len(tracks)):
                other = boxes[j]
                if x1 < other[2] and other[0] < x2 and y1 < other[3] and other[1] < y2 and j not in out:
                    b = tracks[j]
                    if M.duplicates(box, a.shown.class_id, other, b.shown.class_id):
                        if worth(b) > worth(a):
                            out.add(i)
                            break
                        out.add(j)
        return [t for i, t in enumerate(tracks) if i not in out] if out else tracks


# ------------------------------------------------------------ batch

OUTPUT = (
    "frame_id long, pts_ms long, kind string, track_id long, class_id int, label string, score double, "
    "x1 double, y1 double, x2 double, y2 double, raw_x1 double, raw_y1 double, raw_x2 double, raw_y2 double, dt_ms long, "
    "deadzone boolean, reset boolean, was_active boolean, active boolean, center_alpha double, size_alpha double, "
    "raw_dx double, raw_dy double, n_boxes int, matched int, created int, lost int"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_MOTION = ["deadzone", "reset", "was_active", "active"]


KINDS = ("frame", "shown", "motion")


def rows_of(frame_id: int, pts: int, u: Update, kinds: tuple[str, ...] = KINDS) -> Iterable[tuple]:
    """One ``frame`` row with counters, a ``shown`` row per drawn box, a ``motion`` row per update of a track."""
    none4, none_tail = (None,) * 4, (None,) * 9
    if "frame" in kinds:
        yield (frame_id, pts, "frame", None, None, None, None, *none4, *none4, *none_tail, len(u.shown), u.matched, u.created, u.lost)
    for track_id, s in u.shown if "shown" in kinds else ():
        yield (frame_id, pts, "shown", track_id, s.class_id, s.label, s.score, *s.box, *none4, *none_tail, *none4)
    for track_id, s, box, dt, dead, reset, was, now, ca, sa, dx, dy in u.motion if "motion" in kinds else ():
        yield (frame_id, pts, "motion", track_id, s.class_id, s.label, s.score, *box, *s.box, dt, dead, reset, was, now, ca, sa, dx, dy, *none4)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
OUTPUT_TYPES = [_ARROW[c.split()[1]] for c in OUTPUT.split(", ")]


def seen_in(batch: pa.RecordBatch) -> list[list[Seen]]:
    """Detections of each frame row, from its array columns."""

    def flat(name: str) -> list:
        return batch.column(name).flatten().to_pylist()

    each = [Seen(list(map(float, box)), k, name, s) for *box, k, name, s in zip(*(flat(c) for c in ("x1s", "y1s", "x2s", "y2s", "classes", "labels", "scores")))]
    out, at = [], 0
    for n in batch.column("n").to_pylist():
        out.append(each[at : at + n])
        at += n
    return out


def frame_rows(frames: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """One row per frame with its boxes as arrays, in ``det_ord`` order; frames without boxes stay, boxes without a frame go (``unframed``)."""
    on = [*keys, "frame_id"]
    boxes = F.array_sort(F.collect_list(F.struct("det_ord", "class_id", "label", "score", "x1", "y1", "x2", "y2")))
    gathered = detections.groupBy(*on).agg(boxes.alias("b"))
    names = {"class_id": "classes", "label": "labels", "score": "scores", "x1": "x1s", "y1": "y1s", "x2": "x2s", "y2": "y2s"}
    joined = frames.select(*on, "pts_ms").join(gathered, on, "left")
    return joined.select(
        *on, "pts_ms", F.coalesce(F.size("b"), F.lit(0)).alias("n"), *[F.col(f"b.{a}").alias(b) for a, b in names.items()]
    ).withColumn("n", F.greatest("n", F.lit(0)))


def unframed(frames: DataFrame, detections: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Boxes whose frame is not among ``frames``; tracking has no time for them and leaves them out."""
    return detections.join(frames.select(*(keys or ["channel_id"]), "frame_id"), [*(keys or ["channel_id"]), "frame_id"], "left_anti")


def cut_parts(frames: DataFrame, detections: DataFrame, keys: list[str], config: TrackerConfig, block: int) -> DataFrame:
    """(keys, frame_id, part): parts start after updates that no track can survive.

    Works on one narrow row per frame. A part starts at a frame with boxes whose
    predecessor had none and came late enough to clear everything.
    """
    on = [*keys, "frame_id"]
    counts = detections.groupBy(*on).agg(F.count("*").alias("n"))
    narrow = checkpointed(frames.select(*on, "pts_ms").join(counts, on, "left").withColumn("n", F.coalesce("n", F.lit(0))))
    order, blocks = [F.col("frame_id")], [time_block("frame_id", block)]
    quiet_ms = max(config.ttl_ms, GLOBAL_MOTION_STALE_MS)
    seen = ordered_scan(
        narrow, keys, blocks, order,
        [Step("__p", "lag", F.struct("pts_ms", "n")), Step("__last", "last", F.when(F.col("n") > 0, F.col("pts_ms")), before=True)],
    )
    quiet = F.col("__last").isNull() | (F.col("__p.pts_ms") - F.col("__last") > quiet_ms)
    starts = F.coalesce((F.col("n") > 0) & (F.col("__p.n") == 0) & quiet, F.lit(False)).cast("long")
    return ordered_scan(seen, keys, blocks, order, [Step("part", "sum", starts)]).select(*on, "part")


def track(frames: DataFrame, detections: DataFrame, config: TrackerConfig = TrackerConfig(), width: float = 640.0, height: float = 480.0,
          keys: list[str] | None = None, block: int = 100_000, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Track all channels; see ``rows_of`` for the kinds of rows, of which only those named are made.

    ``frames`` are the updates, also those without boxes. Add ``epoch`` to ``keys`` when
    media time restarts on reconnect.
    """
    keys, made = keys or ["channel_id"], tuple({*kinds, "frame"})
    on = [*keys, "frame_id"]
    if config.mode == "raw":
        parts = frame_rows(frames, detections, keys).withColumn("part", F.col("frame_id"))
    else:
        parts = frame_rows(frames, detections, keys).join(cut_parts(frames, detections, keys, config, block), on)
    heads = [*keys, "part"]

    def make():
        current: dict = {"key": None, "tracker": None}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            begins, rows, of = set(starts(batch, heads).tolist()), [], []
            frame_ids, times = batch.column("frame_id").to_pylist(), batch.column("pts_ms").to_pylist()
            for i, (frame_id, pts, seen) in enumerate(zip(frame_ids, times, seen_in(batch))):
                if i in begins:
                    key = tuple(batch.column(h)[i].as_py() for h in heads)
                    if key != current["key"]:
                        current.update(key=key, tracker=Tracker(config, width, height))
                update = current["tracker"].update(pts, seen)
                before = len(rows)
                rows.extend(rows_of(frame_id, pts, update, made))
                of.extend([i] * (len(rows) - before))
            named = batch.select(heads).take(pa.array(of, pa.int64()))
            columns = zip(*rows) if rows else [()] * len(COLUMNS)
            return pa.RecordBatch.from_arrays([*named.columns, *(pa.array(c, t) for c, t in zip(columns, OUTPUT_TYPES))], [*heads, *COLUMNS])

        return step

    key_types = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)
    tracked = stream(parts, heads, [F.col("frame_id")], make, f"{key_types}, part long, {OUTPUT}")
    wanted = F.col("kind").isin(*kinds)
    if config.mode == "raw" or set(kinds) == {"frame"}:
        return tracked.where(wanted).drop("part")
    # Numbers given inside a part continue after those of the parts before it. The result
    # is written once to the shared folder, as several tables are taken from it.
    tracked = checkpointed(tracked)
    begun = tracked.where(F.col("kind") == "frame").groupBy(*keys, "part").agg(F.sum("created").alias("__made"))
    numbered = ordered_scan(begun, keys, [time_block("part", block)], [F.col("part")], [Step("__cum", "sum", F.col("__made"))])
    offsets = numbered.select(*keys, "part", (F.col("__cum") - F.col("__made")).alias("__offset"))
    joined = tracked.where(wanted).join(offsets, [*keys, "part"])
    return joined.withColumn("track_id", F.col("track_id") + F.col("__offset")).drop("part", "__offset")


def snapshots(tracked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Frame rows: what was shown, matched, created and lost at each update."""
    return tracked.where(F.col("kind") == "frame").select(*(keys or ["channel_id"]), "frame_id", "pts_ms", "n_boxes", "matched", "created", "lost")


def shown_boxes(tracked: DataFrame) -> DataFrame:
    return tracked.where(F.col("kind") == "shown").select("channel_id", "frame_id", "pts_ms", "track_id", "class_id", "label", "score", "x1", "y1", "x2", "y2")


def motion_tracks(tracked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per-track samples for the diagnostics, the metrics and the replays."""
    smooth = [F.col(c).alias(f"smooth_{c}") for c in ("x1", "y1", "x2", "y2")]
    return tracked.where(F.col("kind") == "motion").select(
        *(keys or ["channel_id"]), "frame_id", "pts_ms", "track_id", "class_id", "dt_ms", "raw_x1", "raw_y1", "raw_x2", "raw_y2", *smooth,
        "deadzone", "reset", "was_active", "active", "center_alpha", "size_alpha", "raw_dx", "raw_dy",
    )
