"""The tracker as recursive SQL (DuckDB): one row per channel and frame, the state a list of track structs."""

from __future__ import annotations

from boxweave.functions.geometry import CROSS_CLASS_CONTAINMENT, CROSS_CLASS_IOU, SAME_CLASS_CONTAINMENT
from boxweave.operators.tracking import GLOBAL_MOTION_STALE_MS, SWITCH_HITS, TrackerConfig
from boxweave.plans import sql as Q

#: Frame numbers of one connection; media time and tracks begin anew with each.
CONNECTION = 400

#: Added before rounding: filtered boxes often end in a 5 at the seventh place, which engines round either way.
OFF_TIE = 3.1e-8

_BOX = ("x1", "y1", "x2", "y2")
_KINDS = {
    "id": "BIGINT", **dict.fromkeys(_BOX, "DOUBLE"), "k": "INT", "score": "DOUBLE", "last": "BIGINT", **{f"m{c}": "DOUBLE" for c in _BOX}, "st": "VARCHAR",
    "hits": "INT", "misses": "INT", **{f"j{c}": "DOUBLE" for c in _BOX}, "jh": "INT", **{f"r{c}": "DOUBLE" for c in _BOX}, "rk": "INT", "rh": "INT",
    "cm": "DOUBLE", "sm": "DOUBLE", "sx": "DOUBLE", "sy": "DOUBLE", "ca": "DOUBLE", "sa": "DOUBLE",
}
_MOTION = {
    "id": "BIGINT", "k": "INT", "dt": "BIGINT", **{f"raw_{c}": "DOUBLE" for c in _BOX}, **{f"smooth_{c}": "DOUBLE" for c in _BOX}, "dead": "BOOLEAN", "reset": "BOOLEAN",
    "was": "BOOLEAN", "active": "BOOLEAN", "ca": "DOUBLE", "sa": "DOUBLE", "dx": "DOUBLE", "dy": "DOUBLE",
}


def _struct(kinds: dict[str, str], values: dict[str, object]) -> str:
    return "{" + ", ".join(f"'{n}': CAST({values[n]} AS {k})" for n, k in kinds.items()) + "}"


def _type(kinds: dict[str, str]) -> str:
    return "STRUCT(" + ", ".join(f"{n} {k}" for n, k in kinds.items()) + ")[]"


def _with(rows: str, **fields: str) -> str:
    """``rows`` with more fields on each element ``e``."""
    return f"[struct_insert(e, {', '.join(f'{n} := {v}' for n, v in fields.items())}) FOR e IN {rows}]"


def _layers(source: str, *layers: dict[str, str]) -> str:
    for layer in layers:
        source = f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in layer.items())} FROM ({source})"
    return source


def _dist(a: str, b: str) -> str:
    return Q.hypot(f"{Q.cx(a)} - {Q.cx(b)}", f"{Q.cy(a)} - {Q.cy(b)}")


def _side(p: str, c: str) -> str:
    return f"greatest(1.0, {p}{c}2 - {p}{c}1)"


def _rivals(a: str, b: str) -> str:
    return f"({Q.iou_tracker(a, b)} >= {CROSS_CLASS_IOU} OR ({Q.ios(a, b)} >= {CROSS_CLASS_CONTAINMENT} AND {Q.center_inside(a, b)}))"


def _duplicates(a: str, b: str) -> str:
    return f"(CASE WHEN {a}k = {b}k THEN {Q.ios(a, b)} >= {SAME_CLASS_CONTAINMENT} AND {Q.center_inside(a, b)} ELSE {_rivals(a, b)} END)"


def _ease(v: str) -> str:
    t = Q.clamp(v, "0.0", "1.0")
    return f"({t} * {t} * (3.0 - 2.0 * {t}))"


def _greedy(pairs: str, clash: str) -> str:
    """Pairs taken in order unless they clash with one taken before (``k`` against ``e``)."""
    return f"list_reduce(list_prepend([e FOR e IN {pairs} IF false], [[e] FOR e IN {pairs}]), lambda got, x: CASE WHEN len([k FOR k IN got IF {clash}]) > 0 THEN got ELSE list_concat(got, x) END)"


def _survivors(rows: str) -> str:
    """Duels of standing elements in order, each with the number of its loser; the better ``worth`` wins, the earlier on a tie."""
    duels = (
        f"flatten([[struct_pack(i := p.i, j := q.i, lost := CASE WHEN q.worth > p.worth THEN p.i ELSE q.i END) "
        f"FOR q IN {rows} IF q.i > p.i AND {Q.inter('p.', 'q.')} > 0 AND {_duplicates('p.', 'q.')}] FOR p IN {rows}])"
    )
    return _greedy(duels, "k.lost = x[1].i OR k.lost = x[1].j")


def tracker(config: TrackerConfig, width: float = 640.0, height: float = 480.0) -> str:
    """CTEs that end in ``r(channel_id, n, frame_id, pts, n_boxes, matched, created, lost, motion, ...)``; n is 0 before the first frame."""
    c = config
    reach = max(48.0, (width * width + height * height) ** 0.5 * c.center_distance_ratio)
    # Lists that a lambda holds from outside are copied for each element, so it is given narrow ones.
    slim = "list_transform(tracks, lambda t, a: struct_pack(a := a, t := struct_pack(x1 := t.x1, y1 := t.y1, x2 := t.x2, y2 := t.y2, k := t.k, st := t.st)))"
    pairs = "flatten([list_transform(seen, lambda s, b: struct_pack(a := p.a, b := b, t := p.t, s := s)) FOR p IN slim])"
    measured = _with(
        "pairs", same="e.t.k = e.s.k", iou=Q.iou_tracker("e.t.", "e.s."), inside=Q.ios("e.t.", "e.s."), centred=Q.center_inside("e.t.", "e.s."), dist=_dist("e.t.", "e.s."),
        tp=f"{_side('e.t.', 'x')} * {_side('e.t.', 'y')}", dp=f"{_side('e.s.', 'x')} * {_side('e.s.', 'y')}",
        longest=f"greatest({Q.hypot(_side('e.t.', 'x'), _side('e.t.', 'y'))}, {Q.hypot(_side('e.s.', 'x'), _side('e.s.', 'y'))})",
    )
    judged = _with(
        "measured", similar="least(e.tp, e.dp) / greatest(e.tp, e.dp)",
        rival=f"NOT e.same AND (e.iou >= {CROSS_CLASS_IOU} OR (e.inside >= {CROSS_CLASS_CONTAINMENT} AND e.centred))",
        close=f"e.dist <= greatest(48.0, least({reach}, 1.25 * e.longest)) AND least(e.tp, e.dp) / greatest(e.tp, e.dp) >= 0.40",
    )
    possible = f"[e FOR e IN judged IF CASE WHEN e.same THEN e.iou >= {c.match_iou} OR e.close OR (e.inside >= {SAME_CLASS_CONTAINMENT} AND e.centred) ELSE e.rival END]"
    score = f"e.iou + e.similar * 0.10 + CASE WHEN e.same THEN e.inside * 0.10 ELSE 0.05 END - e.dist / {reach} * 0.05 + CASE WHEN e.t.st = 'active' THEN 0.05 ELSE 0.0 END"
    ranked = f"list_sort([struct_pack(o := -({score}), a := e.a, b := e.b, iou := e.iou, dist := e.dist, rival := e.rival) FOR e IN possible])"

    steady = f"[e FOR e IN chosen IF tracks[e.a].st = 'active' AND pts - tracks[e.a].last BETWEEN 10 AND 250]"
    moved = {x: f"list_aggregate([{f('seen[e.b].')} - {f('tracks[e.a].m')} FOR e IN steady], 'median')" for x, f in (("nx", Q.cx), ("ny", Q.cy))}
    enough = f"len(steady) >= {max(1, c.global_motion_min_tracks)}" if c.global_motion else "false"
    ga = min(1.0, max(0.0, c.global_motion_alpha))
    fresh = f"gp IS NULL OR pts - gp > {GLOBAL_MOTION_STALE_MS} OR pts <= gp"
    common = {x: f"CASE WHEN enough THEN CASE WHEN {fresh} THEN n{x} ELSE {ga} * n{x} + (1 - {ga}) * g{x} END END" for x in "xy"}

    # One match: its track t and detection s, then step by step what becomes of it.
    met = "[struct_pack(a := e.a, t := tracks[e.a], s := seen[e.b], iou := e.iou, dist := e.dist, rival := e.rival) FOR e IN chosen]"
    again = _with("met", again=f"e.rival AND e.t.rh > 0 AND e.t.rk = e.s.k AND {_rivals('e.t.r', 'e.s.')}")
    rival = _with("met1", rh="CASE WHEN NOT e.rival THEN 0 WHEN e.again THEN e.t.rh + 1 ELSE 1 END")
    jumps = f"e.dist > {c.max_correction_px} AND e.iou < {c.innovation_iou} AND e.t.st <> 'active'"
    waits = _with("met2", pending=f"e.rival AND e.rh < {SWITCH_HITS}", far=jumps, near=f"e.t.jh > 0 AND {_dist('e.t.j', 'e.s.')} <= {c.max_correction_px}")
    jumped = _with("met3", jh="CASE WHEN e.near THEN e.t.jh + 1 ELSE 1 END", switched="e.rival")
    held = _with("met4", jumping=f"NOT e.pending AND e.far AND e.jh < {c.jump_confirm_hits}", dt="greatest(0.001, (pts - e.t.last) / 1000.0)",
                 dead=f"{_dist('e.t.', 'e.s.')} < {c.deadzone_center_px} AND " + " AND ".join(f"abs((e.s.{x}2 - e.s.{x}1) - {_side('e.t.', x)}) / {_side('e.t.', x)} < {c.deadzone_size_ratio}" for x in "xy"))
    reset = _with("met5", reset=f"NOT e.dead AND (e.t.st <> 'active' OR e.iou < {c.match_iou} OR e.switched)",
                  diagonal=f"greatest(32.0, {Q.hypot(*[f'({_side('e.t.m', x)} + {_side('e.s.', x)}) * 0.5' for x in 'xy'])})",
                  dx=f"{Q.cx('e.s.')} - {Q.cx('e.t.m')}", dy=f"{Q.cy('e.s.')} - {Q.cy('e.t.m')}")
    k = min(1.0, max(0.0, c.motion_smoothing_alpha))
    speed = _with("met6", step=Q.hypot("e.dx", "e.dy"), rc=f"{Q.hypot('e.dx', 'e.dy')} / e.diagonal / e.dt",
                  rs=f"{Q.hypot(*[f'ln({_side('e.s.', x)} / {_side('e.t.m', x)})' for x in 'xy'])} / e.dt")
    full = max(0.01, c.motion_full_response_ratio)
    smooth = _with("met7", cm=f"{k} * e.rc + (1 - {k}) * e.t.cm", sm=f"{k} * e.rs + (1 - {k}) * e.t.sm")
    eased = _with("met8", cr=_ease(f"greatest(e.rc, e.cm) / {full}"), sr=_ease(f"greatest(e.rs, e.sm) / {full}"))
    top = f"{c.size_alpha_max}"
    if c.center_gated_size_filter:
        calm = min(c.size_alpha_max, max(c.size_alpha_min, c.low_motion_size_alpha_max))
        top = f"({calm} + ({c.size_alpha_max} - {calm}) * e.cr)"
    alphas = _with("met9", ca=Q.clamp(f"{c.center_alpha_min} + ({c.center_alpha_max} - {c.center_alpha_min}) * e.cr", "0.0", "1.0"),
                   sa=Q.clamp(f"{c.size_alpha_min} + ({top} - {c.size_alpha_min}) * e.sr", "0.0", "1.0"),
                   least=f"{max(0.0, c.reversal_min_motion_ratio)} * e.diagonal")
    turned = f"e.t.sx IS NOT NULL AND e.step >= e.least AND {Q.hypot('e.t.sx', 'e.t.sy')} >= e.least AND e.dx * e.t.sx + e.dy * e.t.sy < 0" if c.reversal_damping else "false"
    damped = _with("met10", ca2=f"CASE WHEN {turned} THEN least(e.ca, {min(1.0, max(0.0, c.reversal_center_alpha_max))}) ELSE e.ca END")
    ema = c.ema_alpha

    def blended(x: str, sign: str) -> str:
        centre, side = Q.cx if x == "x" else Q.cy, _side
        if not c.adaptive_filter:
            return f"{ema} * e.s.{x}{1 if sign == '-' else 2} + (1 - {ema}) * e.t.{x}{1 if sign == '-' else 2}"
        middle = f"(e.ca2 * {centre('e.s.')} + (1 - e.ca2) * ({centre('e.t.')} + coalesce(c{x}, 0.0)))"
        return f"{middle} {sign} (e.sa * {side('e.s.', x)} + (1 - e.sa) * {side('e.t.', x)}) * 0.5"

    corners = {f"{x}{n}": (x, sign) for x in "xy" for n, sign in ((1, "-"), (2, "+"))}
    boxed = _with("met11", **{f"b{n}": f"CASE WHEN e.dead THEN e.t.{n} WHEN e.reset THEN e.s.{n} ELSE {blended(x, sign)} END" for n, (x, sign) in corners.items()})
    limited = _with("met12", far_by=_dist("e.t.", "e.b"))
    late = f"NOT e.reset AND e.far_by > {c.max_correction_px} AND e.far_by > 0.001"

    def back(x: str, sign: str) -> str:
        centre = Q.cx if x == "x" else Q.cy
        return f"{centre('e.t.')} + ({centre('e.b')} - {centre('e.t.')}) * ({c.max_correction_px} / e.far_by) {sign} (e.b{x}2 - e.b{x}1) * 0.5"

    placed = _with("met13", **{f"f{n}": f"CASE WHEN {late} THEN {back(x, sign)} ELSE e.b{n} END" for n, (x, sign) in corners.items()}, waits="e.pending OR e.jumping", hits="e.t.hits + 1")

    keep = {n: f"e.t.{n}" for n in _KINDS}
    moved_on = {
        **keep, **{n: f"e.f{n}" for n in _BOX}, "k": "CASE WHEN e.dead THEN e.t.k ELSE e.s.k END", "score": "e.s.score", "last": "pts", **{f"m{n}": f"e.s.{n}" for n in _BOX},
        "st": f"CASE WHEN e.hits >= {c.confirm_hits} THEN 'active' ELSE e.t.st END", "hits": "e.hits", "misses": "0", "jh": "0", "rh": "0",
        **{f"j{n}": f"CASE WHEN e.far AND NOT e.near THEN e.s.{n} ELSE e.t.j{n} END" for n in _BOX},
        **{f"r{n}": f"CASE WHEN e.rival AND NOT e.again THEN e.s.{n} ELSE e.t.r{n} END" for n in _BOX}, "rk": "CASE WHEN e.rival AND NOT e.again THEN e.s.k ELSE e.t.rk END",
    }
    calmed, untouched = f"{1.0 - c.motion_smoothing_alpha}", "e.t."
    plain = not c.adaptive_filter
    moved_on |= {
        "cm": f"CASE WHEN e.dead THEN e.t.cm * {calmed} WHEN e.reset THEN 0.0 ELSE {'e.t.cm' if plain else 'e.cm'} END",
        "sm": f"CASE WHEN e.dead THEN e.t.sm * {calmed} WHEN e.reset THEN 0.0 ELSE {'e.t.sm' if plain else 'e.sm'} END",
        "ca": f"CASE WHEN e.dead THEN 0.0 WHEN e.reset THEN 1.0 ELSE {ema if plain else 'e.ca2'} END", "sa": f"CASE WHEN e.dead THEN 0.0 WHEN e.reset THEN 1.0 ELSE {ema if plain else 'e.sa'} END",
        **{f"s{x}": f"CASE WHEN e.dead THEN {untouched}s{x} WHEN e.reset THEN NULL {'' if plain else f'WHEN e.step >= e.least THEN e.d{x} '}ELSE {untouched}s{x} END" for x in "xy"},
    }
    pending = {**keep, "last": "pts", "misses": "0", "rh": "e.rh", **{n: moved_on[n] for n in ("rx1", "ry1", "rx2", "ry2", "rk")}}
    jumping = {**keep, "rh": "0", "jh": "e.jh", **{n: moved_on[n] for n in ("jx1", "jy1", "jx2", "jy2", "rx1", "ry1", "rx2", "ry2", "rk")}}
    after = _with("met14", now=f"CASE WHEN e.pending THEN {_struct(_KINDS, pending)} WHEN e.jumping THEN {_struct(_KINDS, jumping)} ELSE {_struct(_KINDS, moved_on)} END")
    missed = _struct(_KINDS, {**{n: f"t.{n}" for n in _KINDS}, "misses": "t.misses + 1"})
    first_state = "'active'" if c.confirm_hits <= 1 else "'tentative'"
    none = {n: "NULL" for n in _KINDS}
    fresh_track = _struct(_KINDS, {
        **none, "id": "next_id + i - 1", **{n: f"s.{n}" for n in (*_BOX, "k", "score")}, "last": "pts", **{f"m{n}": f"s.{n}" for n in _BOX}, "st": first_state,
        "hits": "1", "misses": "0", "jh": "0", "rh": "0", "cm": "0.0", "sm": "0.0", "ca": "1.0", "sa": "1.0",
    })
    old = f"list_transform(tracks, lambda t, a: CASE WHEN list_contains(met_a, a) THEN nows[list_position(met_a, a)] ELSE {missed} END)"
    aged = _struct(_KINDS, {**{n: f"e.{n}" for n in _KINDS}, "st": f"CASE WHEN e.st = 'active' AND pts - e.last > {c.display_hold_ms} THEN 'shadow' ELSE e.st END"})
    alive = f"[e FOR e IN aged IF pts - e.last <= {c.ttl_ms} AND NOT (e.hits < {c.confirm_hits} AND e.misses > 0)]"
    displayable = f"({{a}}st = 'active' AND {{a}}hits >= {c.confirm_hits} AND pts - {{a}}last <= {c.display_hold_ms})"
    worth = f"struct_pack(a := {displayable.format(a='e.')}, b := e.last, c := e.score, d := e.hits)"
    motion_old = _struct(_MOTION, {
        "id": "e.t.id", "k": "e.s.k", "dt": "greatest(1, pts - e.t.last)", **{f"raw_{n}": f"e.s.{n}" for n in _BOX}, **{f"smooth_{n}": f"e.f{n}" for n in _BOX},
        "dead": "e.dead", "reset": "e.reset", "was": "e.t.st = 'active'", "active": "e.now.st = 'active'", "ca": "e.now.ca", "sa": "e.now.sa", "dx": "e.dx", "dy": "e.dy",
    })
    motion_new = _struct(_MOTION, {
        "id": "e.id", "k": "e.k", "dt": "0", **{f"raw_{n}": f"e.{n}" for n in _BOX}, **{f"smooth_{n}": f"e.{n}" for n in _BOX}, "dead": "false", "reset": "true", "was": "false",
        "active": "e.st = 'active'", "ca": "1.0", "sa": "1.0", "dx": "0.0", "dy": "0.0",
    })
    step = _layers(
        "SELECT r.channel_id, f.n, f.frame_id, f.pts, f.seen, r.tracks, r.next_id, r.gx, r.gy, r.gp FROM r JOIN f ON f.channel_id = r.channel_id AND f.n = r.n + 1",
        {"slim": slim}, {"pairs": pairs}, {"measured": measured}, {"judged": judged}, {"possible": possible}, {"ranked": ranked}, {"chosen": _greedy("ranked", "k.a = x[1].a OR k.b = x[1].b")},
        {"steady": steady, "met": met, "met_a": "[e.a FOR e IN chosen]", "met_b": "[e.b FOR e IN chosen]"}, {**moved, "enough": enough}, {"cx": common["x"], "cy": common["y"]},
        {"met1": again}, {"met2": rival}, {"met3": waits}, {"met4": jumped}, {"met5": held}, {"met6": reset}, {"met7": speed}, {"met8": smooth}, {"met9": eased}, {"met10": alphas},
        {"met11": damped}, {"met12": boxed}, {"met13": limited}, {"met14": placed}, {"met15": after, "fresh": "list_filter(seen, lambda s, b: NOT list_contains(met_b, b))"}, {"nows": "[e.now FOR e IN met15]"},
        {"old": old, "born": f"list_transform(fresh, lambda s, i: {fresh_track})"}, {"every": "list_concat(old, born)"}, {"aged": f"[{aged} FOR e IN every]"}, {"alive": alive},
        {"rivals": f"list_transform(alive, lambda e, i: struct_pack(i := i, x1 := e.x1, y1 := e.y1, x2 := e.x2, y2 := e.y2, k := e.k, worth := {worth}))"},
        {"twins": f"[e.lost FOR e IN {_survivors('rivals')}]"}, {"kept": "list_filter(alive, lambda e, i: NOT list_contains(twins, i))"},
        {"drawn": f"[e FOR e IN kept IF {displayable.format(a='e.')}]"},
    )
    seen = "list({" + ", ".join(f"'{n}': {n}" for n in _BOX) + ", 'k': class_id, 'score': score} ORDER BY det_ord)"
    # A step costs much the same for one row or many, so all connections go side by side.
    return f"""f AS MATERIALIZED (SELECT channel_id || '/' || frame_id // {CONNECTION} AS channel_id, frame_id, pts_ms AS pts,
      row_number() OVER (PARTITION BY channel_id, frame_id // {CONNECTION} ORDER BY frame_id) AS n, coalesce(seen, []) AS seen
    FROM frames LEFT JOIN (SELECT channel_id, frame_id, {seen} AS seen FROM detections GROUP BY ALL) USING (channel_id, frame_id)),
  r AS (SELECT DISTINCT channel_id, 0::BIGINT AS n, 0::BIGINT AS frame_id, 0::BIGINT AS pts, CAST([] AS {_type(_KINDS)}) AS tracks, 1::BIGINT AS next_id,
      NULL::DOUBLE AS gx, NULL::DOUBLE AS gy, NULL::BIGINT AS gp, 0::INT AS n_boxes, 0::INT AS matched, 0::INT AS created, 0::INT AS lost, CAST([] AS {_type(_MOTION)}) AS motion FROM f
    UNION ALL
    SELECT channel_id, n, frame_id, pts, kept, next_id + len(fresh), CASE WHEN enough THEN cx ELSE gx END, CASE WHEN enough THEN cy ELSE gy END, CASE WHEN enough THEN pts ELSE gp END,
      len(drawn)::INT, len([e FOR e IN met15 IF NOT e.waits])::INT, len(fresh)::INT, (len(every) - len(kept))::INT,
      list_concat([{motion_old} FOR e IN met15 IF NOT e.waits], [{motion_new} FOR e IN born])
    FROM ({step}))"""


_KEY = "split_part(channel_id, '/', 1) AS channel_id, split_part(channel_id, '/', 2)::BIGINT AS connection"


def snapshots(config: TrackerConfig) -> str:
    return f"+{tracker(config)} SELECT {_KEY}, frame_id, pts AS pts_ms, n_boxes, matched, created, lost FROM r WHERE n > 0"


def motion(config: TrackerConfig) -> str:
    rounded = [*(f"smooth_{n}" for n in _BOX), "center_alpha", "size_alpha"]
    names = {"track_id": "id", "class_id": "k", "dt_ms": "dt", **{f"raw_{n}": f"raw_{n}" for n in _BOX}, **{f"smooth_{n}": f"smooth_{n}" for n in _BOX}, "deadzone": "dead", "reset": "reset",
             "was_active": "was", "active": "active", "center_alpha": "ca", "size_alpha": "sa", "raw_dx": "dx", "raw_dy": "dy"}
    columns = ", ".join(Q.r6(f"m.{v} + {OFF_TIE}", n) if n in rounded else f"m.{v} AS {n}" for n, v in names.items())
    return f"+{tracker(config)} SELECT {_KEY}, frame_id, pts AS pts_ms, {columns} FROM (SELECT channel_id, frame_id, pts, unnest(motion) AS m FROM r)"
