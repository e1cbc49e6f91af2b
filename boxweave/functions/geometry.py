"""Box geometry as Column expressions. A box is anything with x1, y1, x2, y2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Corner columns of one box, optionally with class and score."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column
    class_id: Column | None = None
    score: Column | None = None

    @property
    def corners(self) -> list[Column]:
        return [self.x1, self.y1, self.x2, self.y2]


def box(prefix: str = "") -> Box:
    """Box from flat columns ``<prefix>x1`` and so on."""
    return Box(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2", "class_id", "score")])


def box_of(struct: Column) -> Box:
    """Box from a struct column, as met inside higher-order functions."""
    return Box(*[struct[c] for c in ("x1", "y1", "x2", "y2", "class_id", "score")])


def at_least_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def area(b: Box) -> Column:
    return at_least_zero(b.x2 - b.x1) * at_least_zero(b.y2 - b.y1)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return at_least_zero(w) * at_least_zero(h)


# What each use of IoU adds to, or demands of, its denominator.
IOU_EPSILON = {"detector": 1e-6, "labels": 1e-12, "dataset": 1e-9}


def iou(a: Box, b: Box, denominator: str = "detector") -> Column:
    """Intersection over union.

    denominator: ``detector`` (+1e-6), ``labels`` (+1e-12), ``dataset`` (+1e-9) or
    ``tracker`` (union of at least one square pixel).
    """
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    if denominator == "tracker":
        return inter / F.greatest(union, F.lit(1.0))
    return inter / (union + F.lit(IOU_EPSILON[denominator]))


def smaller_area(a: Box, b: Box) -> Column:
    return F.least(area(a), area(b))


def containment(a: Box, b: Box) -> Column:
    """Intersection over the smaller box; 0 when the smaller box is empty."""
    small = smaller_area(a, b)
    return F.when(small > 0, intersection(a, b) / small).otherwise(F.lit(0.0))


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) * 0.5


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) * 0.5


def _holds_center(outer: Box, inner: Box) -> Column:
    return center_x(inner).between(outer.x1, outer.x2) & center_y(inner).between(outer.y1, outer.y2)


def center_inside(a: Box, b: Box) -> Column:
    """The centre of the smaller box lies in the larger one (``a`` wins a tie as the smaller)."""
    return F.when(area(a) <= area(b), _holds_center(b, a)).otherwise(_holds_center(a, b))


def point_in(px: Column, py: Column, b: Box) -> Column:
    return px.between(b.x1, b.x2) & py.between(b.y1, b.y2)


def center_distance(a: Box, b: Box) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def side(c: Column) -> Column:
    """Side length of at least one pixel."""
    return F.greatest(c, F.lit(1.0))


def width(b: Box) -> Column:
    return side(b.x2 - b.x1)


def height(b: Box) -> Column:
    return side(b.y2 - b.y1)


def size_similarity(a: Box, b: Box) -> Column:
    one, two = width(a) * height(a), width(b) * height(b)
    return F.least(one, two) / F.greatest(one, two)


def overlap_ratio_1d(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared length over the shorter interval; 0 when that one is empty."""
    shorter = F.least(a2 - a1, b2 - b1)
    return F.when(shorter > 0, at_least_zero(F.least(a2, b2) - F.greatest(a1, b1)) / shorter).otherwise(F.lit(0.0))


def interval_gap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return at_least_zero(F.greatest(a1, b1) - F.least(a2, b2))


def rects_overlap(a: Box, b: Box) -> Column:
    """Open overlap: touching edges do not count."""
    return (F.least(a.x2, b.x2) > F.greatest(a.x1, b.x1)) & (F.least(a.y2, b.y2) > F.greatest(a.y1, b.y1))


def shared_rect(a: Box, b: Box) -> Box:
    x1, y1 = F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1)
    return Box(x1, y1, F.greatest(F.least(a.x2, b.x2), x1), F.greatest(F.least(a.y2, b.y2), y1))


def edge_clearance(b: Box, tile: Box) -> Column:
    """Distance of a box to the nearest edge of its tile, 0 if it sticks out."""
    return at_least_zero(F.least(b.x1 - tile.x1, b.y1 - tile.y1, tile.x2 - b.x2, tile.y2 - b.y2))


# Fixed values of the duplicate rules.
SAME_CLASS_CONTAINMENT = 0.70
CROSS_CLASS_CONTAINMENT = 0.50
CROSS_CLASS_IOU = 0.85


def is_cross_class_competitor(a: Box, b: Box, denominator: str = "tracker") -> Column:
    """Nearly the same box, or one that mostly lies inside the other."""
    nested = (containment(a, b) >= CROSS_CLASS_CONTAINMENT) & center_inside(a, b)
    return (iou(a, b, denominator) >= CROSS_CLASS_IOU) | nested


def is_duplicate_box(a: Box, b: Box) -> Column:
    same = (containment(a, b) >= SAME_CLASS_CONTAINMENT) & center_inside(a, b)
    return F.when(a.class_id == b.class_id, same).otherwise(is_cross_class_competitor(a, b))


def in_deadzone(previous: Box, measured: Box, center_px: float = 6.0, size_ratio: float = 0.01) -> Column:
    w, h = width(previous), height(previous)
    return (
        (center_distance(previous, measured) < center_px)
        & (F.abs((measured.x2 - measured.x1) - w) / w < size_ratio)
        & (F.abs((measured.y2 - measured.y1) - h) / h < size_ratio)
    )


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w * 0.5, cy - h * 0.5, cx + w * 0.5, cy + h * 0.5)


def ema_box(previous: Box, measured: Box, alpha: float) -> Box:
    """Centre and size moved by ``alpha`` towards the measured box."""

    def blend(new: Column, old: Column) -> Column:
        return new * F.lit(alpha) + old * F.lit(1.0 - alpha)

    return from_center(
        blend(center_x(measured), center_x(previous)),
        blend(center_y(measured), center_y(previous)),
        blend(measured.x2 - measured.x1, previous.x2 - previous.x1),
        blend(measured.y2 - measured.y1, previous.y2 - previous.y1),
    )


def clamp_center_correction(previous: Box, candidate: Box, max_px: float) -> Box:
    """Pull the candidate back so that its centre moves by at most ``max_px``."""
    distance = center_distance(previous, candidate)
    factor = F.when((distance <= max_px) | (distance <= 0.001), F.lit(1.0)).otherwise(F.lit(max_px) / distance)
    shift_x = (center_x(previous) - center_x(candidate)) * (1 - factor)
    shift_y = (center_y(previous) - center_y(candidate)) * (1 - factor)
    return Box(candidate.x1 + shift_x, candidate.y1 + shift_y, candidate.x2 + shift_x, candidate.y2 + shift_y)
