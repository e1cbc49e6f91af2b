"""SQL fragments for the checking queries (DuckDB)."""

from __future__ import annotations


def area(p: str) -> str:
    return f"(greatest(0.0, {p}x2 - {p}x1) * greatest(0.0, {p}y2 - {p}y1))"


def inter(a: str, b: str) -> str:
    return (
        f"(greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
        f" * greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"
    )


def iou(a: str, b: str, plus: str = "1e-6") -> str:
    return f"({inter(a, b)} / ({area(a)} + {area(b)} - {inter(a, b)} + {plus}))"


def iou_tracker(a: str, b: str) -> str:
    return f"({inter(a, b)} / greatest(1.0, {area(a)} + {area(b)} - {inter(a, b)}))"


def ios(a: str, b: str) -> str:
    return f"(CASE WHEN least({area(a)}, {area(b)}) > 0 THEN {inter(a, b)} / least({area(a)}, {area(b)}) ELSE 0.0 END)"


def cx(p: str) -> str:
    return f"(({p}x1 + {p}x2) * 0.5)"


def cy(p: str) -> str:
    return f"(({p}y1 + {p}y2) * 0.5)"


def center_inside(a: str, b: str) -> str:
    def held(inner, outer):
        return f"({cx(inner)} BETWEEN {outer}x1 AND {outer}x2 AND {cy(inner)} BETWEEN {outer}y1 AND {outer}y2)"

    return f"(CASE WHEN {area(a)} <= {area(b)} THEN {held(a, b)} ELSE {held(b, a)} END)"


def hypot(x: str, y: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"


def r6(expr: str, name: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def clamp(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}), {high})"
