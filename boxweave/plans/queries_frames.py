"""Queries for greedy selection, matching, evaluation and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxweave.operators import aggregates as A
from boxweave.operators import evaluate as E
from boxweave.operators import filters as P
from boxweave.operators import greedy as R
from boxweave.operators import joins as J
from boxweave.operators import tracking as T
from boxweave.operators import windows as Wn
from boxweave.plans import sql as Q
from boxweave.plans import track_sql
from boxweave.plans.queries_boxes import (
    BOX, BOX_SQL, CLEARANCE, FRAME_H, FRAME_TILED, FRAME_W, GT_PAIRS, JOINT_SQL, ROI_HIT, ROI_PIXELS, _gt_pred,
)
from boxweave.plans.registry import query, r6
from boxweave.plans.views import view
from boxweave.plans.views import with_views as W
from boxweave.session import checkpointed


def _packed(p: str, *more: str) -> str:
    names = [*BOX, *more]
    return "{" + ", ".join(f"'{n}': {p}{n}" for n in names) + "}"


def _greedy(source: str, keys: str, order: str, conflict: str) -> str:
    """Recursive twin of a greedy keep over ``source`` in ``order``."""
    same = " AND ".join(f"o.{k} = r.{k}" for k in keys.split(", "))
    more = ["class_id", "score"]
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {source}),
  r AS (SELECT {keys}, n, det_ord, true AS ok, [{_packed('', *more)}] AS kept FROM o WHERE n = 1
    UNION ALL
    SELECT {', '.join('o.' + k for k in keys.split(', '))}, o.n, o.det_ord, len(list_filter(r.kept, lambda k: {conflict})) = 0,
      CASE WHEN len(list_filter(r.kept, lambda k: {conflict})) = 0 THEN list_append(r.kept, {_packed('o.', *more)}) ELSE r.kept END
    FROM r JOIN o ON {same} AND o.n = r.n + 1)"""


NMS_SQL = _greedy("detections", "frame_id, class_id", "round(score, 6) DESC, det_ord", f"{Q.iou('k.', 'o.')} > 0.45")


@query("nms", W(f"+{NMS_SQL} SELECT frame_id, class_id, det_ord FROM r WHERE ok", "detections", recursive=True))
def _(spark, sf):
    return R.nms(view(spark, sf, "detections"), 0.45, ["frame_id"]).select("frame_id", "class_id", "det_ord")


@query("nms_crowded", W("+b AS (SELECT * REPLACE (frame_id % 4 AS frame_id, x1 + 700 * (frame_id // 4) AS x1, x2 + 700 * (frame_id // 4) AS x2) FROM detections), "
                        + NMS_SQL.replace("FROM detections)", "FROM detections), o2 AS (SELECT 1)", 1)
                        + " SELECT d.frame_id % 4 AS frame_id, d.class_id, d.det_ord, d.frame_id AS place FROM detections d JOIN r ON r.ok AND r.frame_id = d.frame_id AND r.class_id = d.class_id AND r.det_ord = d.det_ord", "detections", recursive=True))
def _(spark, sf):
    """All boxes of a channel in one frame, side by side: the path for frames too crowded for one task."""
    d = view(spark, sf, "detections").withColumn("place", F.col("frame_id"))
    shift = F.floor(F.col("place") / 4) * 700.0
    wide = d.withColumns({"frame_id": F.col("place") % 4, "x1": F.col("x1") + shift, "x2": F.col("x2") + shift})
    wide = wide.withColumn("uid", F.col("det_ord")).withColumn("det_ord", F.struct("det_ord", "place"))
    kept = R.nms(wide, 0.45, ["frame_id"], max_group=500)
    return kept.select("frame_id", "class_id", F.col("uid").alias("det_ord"), "place")


RIVAL_KO = f"({Q.iou('k.', 'o.')} >= 0.85 OR ({Q.ios('k.', 'o.')} >= 0.5 AND {Q.center_inside('k.', 'o.')}))"
RELIABLE = f"CASE WHEN origin = 'joint' THEN 0 ELSE 1 END, CASE WHEN origin = 'joint' THEN 0.0 ELSE -floor({CLEARANCE}) END, -round(score, 6), det_ord"


@query("select_exclusive", W(f"+{FRAME_TILED}, {_greedy('f', 'frame_id', RELIABLE, RIVAL_KO)} SELECT frame_id, det_ord FROM r WHERE ok", "tiled", recursive=True))
def _(spark, sf):
    return R.select_exclusive(P.untile(view(spark, sf, "tiled")), ["frame_id"]).select("frame_id", "det_ord")


ABSORBS = f"(k.class_id = o.class_id AND ({Q.iou('k.', 'o.')} > 0.45 OR ({Q.ios('k.', 'o.')} >= 0.7 AND {Q.center_inside('k.', 'o.')})))"
GROWS = f"({Q.iou('k.', 'o.')} <= 0.45 AND {Q.area('o.')} > {Q.area('k.')} AND o.score + 0.1 >= k.score)"
PLACE = f"coalesce(list_position(list_transform(r.kept, lambda k: {ABSORBS}), true), 0)"
M_FIELDS = ["class_id", "score", "det_ord"]
MERGE_SQL = f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(score, 6) DESC, det_ord) AS n FROM detections),
  r AS (SELECT frame_id, n, [{_packed('', *M_FIELDS)}] AS kept FROM o WHERE n = 1
    UNION ALL
    SELECT o.frame_id, o.n, CASE WHEN {PLACE} = 0 THEN list_append(r.kept, {_packed('o.', *M_FIELDS)})
      ELSE list_transform(r.kept, lambda k, i: CASE WHEN i = {PLACE} AND {GROWS} THEN {_packed('o.', *M_FIELDS)} ELSE k END) END
    FROM r JOIN o ON o.frame_id = r.frame_id AND o.n = r.n + 1),
  w AS (SELECT frame_id, unnest(arg_max(kept, n)) AS b FROM r GROUP BY frame_id),
  o2 AS MATERIALIZED (SELECT frame_id, b.*, row_number() OVER (PARTITION BY frame_id ORDER BY round(b.score, 6) DESC, b.det_ord) AS n FROM w),
  r2 AS (SELECT frame_id, n, det_ord, true AS ok, [{_packed('', *M_FIELDS)}] AS kept FROM o2 WHERE n = 1
    UNION ALL
    SELECT o.frame_id, o.n, o.det_ord, len(list_filter(r2.kept, lambda k: k.class_id <> o.class_id AND {RIVAL_KO})) = 0,
      CASE WHEN len(list_filter(r2.kept, lambda k: k.class_id <> o.class_id AND {RIVAL_KO})) = 0 THEN list_append(r2.kept, {_packed('o.', *M_FIELDS)}) ELSE r2.kept END
    FROM r2 JOIN o2 o ON o.frame_id = r2.frame_id AND o.n = r2.n + 1)"""


@query("merge_detections", W(f"+{MERGE_SQL} SELECT frame_id, det_ord FROM r2 WHERE ok", "detections", recursive=True))
def _(spark, sf):
    return R.merge_detections(view(spark, sf, "detections"), ["frame_id"]).select("frame_id", "det_ord")


def _seam(a: str, b: str, u: str, v: str) -> str:
    """Two boxes are halves of one along axis ``u``: near the middle of the band their tiles share, side by side across it."""
    low = f"greatest({a}.t{u}1, {b}.t{u}1)"
    band = f"(least({a}.t{u}2, {b}.t{u}2) - {low})"
    middle, margin = f"({low} + {band} * 0.5)", f"greatest(96.0, {band} * 0.25)"
    near = [f"({p}.{u}2 >= {middle} - {margin} AND {q}.{u}1 <= {middle} + {margin})" for p, q in ((a, b), (b, a))]
    shorter = f"least({a}.{v}2 - {a}.{v}1, {b}.{v}2 - {b}.{v}1)"
    return f"""(CASE WHEN {a}.t{u}1 <= {b}.t{u}1 THEN {near[0]} ELSE {near[1]} END AND {shorter} > 0
      AND greatest(0.0, least({a}.{v}2, {b}.{v}2) - greatest({a}.{v}1, {b}.{v}1)) / {shorter} >= 0.45 AND greatest({a}.{u}1, {b}.{u}1) - least({a}.{u}2, {b}.{u}2) <= 96)"""


def _seams() -> str:
    """Boundary merge, one pair of a frame's boxes per step: the list of boxes goes from step to step."""
    a, b = "bs[i]", "bs[j]"
    shared = {u: f"(least({a}.t{u}2, {b}.t{u}2) - greatest({a}.t{u}1, {b}.t{u}1))" for u in "xy"}
    halves = f"(least({shared['x']}, {shared['y']}) > 0 AND CASE WHEN {shared['x']} < {shared['y']} THEN {_seam(a, b, 'x', 'y')} ELSE {_seam(a, b, 'y', 'x')} END)"
    clear = lambda e: f"greatest(0.0, least({e}.x1 - {e}.tx1, {e}.y1 - {e}.ty1, {e}.tx2 - {e}.x2, {e}.ty2 - {e}.y2))"
    lead = f"({clear(a)} - {clear(b)})"
    keep = "o := e.o, c := e.c, tx1 := e.tx1, ty1 := e.ty1, tx2 := e.tx2, ty2 := e.ty2"
    grown = f"struct_pack({keep}, s := greatest({a}.s, {b}.s), x1 := least({a}.x1, {b}.x1), y1 := least({a}.y1, {b}.y1), x2 := greatest({a}.x2, {b}.x2), y2 := greatest({a}.y2, {b}.y2), gone := false)"
    left = f"struct_pack({keep}, s := e.s, x1 := e.x1, y1 := e.y1, x2 := e.x2, y2 := e.y2, gone := true)"
    return f"""ut AS (SELECT * REPLACE (x1 + tile_x AS x1, y1 + tile_y AS y1, x2 + tile_x AS x2, y2 + tile_y AS y2) FROM tiled),
  g AS MATERIALIZED (SELECT frame_id, count(*) AS n, list(struct_pack(o := det_ord, c := class_id, tx1 := tile_x, ty1 := tile_y, tx2 := tile_x + tile_w, ty2 := tile_y + tile_h, s := score, x1 := x1, y1 := y1, x2 := x2, y2 := y2, gone := false) ORDER BY det_ord) AS bs FROM ut GROUP BY 1),
  pr AS MATERIALIZED (SELECT n, p, i, j, row_number() OVER (PARTITION BY n ORDER BY p, i, j) AS k FROM (SELECT DISTINCT n FROM g), (SELECT unnest([1, 2]) AS p), LATERAL (SELECT unnest(range(1, n + 1)) AS i), LATERAL (SELECT unnest(range(i + 1, n + 1)) AS j)),
  r AS (SELECT frame_id, n, 0::BIGINT AS k, bs FROM g
    UNION ALL SELECT frame_id, n, k, CASE what WHEN 'unite' THEN list_transform(bs, lambda e, m: CASE WHEN m = i THEN {grown} WHEN m = j THEN {left} ELSE e END)
        WHEN 'first goes' THEN list_transform(bs, lambda e, m: CASE WHEN m = i THEN {left} ELSE e END) WHEN 'second goes' THEN list_transform(bs, lambda e, m: CASE WHEN m = j THEN {left} ELSE e END) ELSE bs END
    FROM (SELECT *, CASE WHEN {a}.gone OR {b}.gone OR {a}.c <> {b}.c THEN 'none' WHEN p = 1 THEN CASE WHEN {halves} THEN 'unite' ELSE 'none' END
          WHEN {Q.ios(a + '.', b + '.')} < 0.35 THEN 'none' WHEN {lead} <= -32 THEN 'first goes' WHEN {lead} >= 32 THEN 'second goes' ELSE 'unite' END AS what
        FROM (SELECT r.frame_id, r.n, pr.k, r.bs, pr.p, pr.i, pr.j FROM r JOIN pr ON pr.n = r.n AND pr.k = r.k + 1))),
  fin AS (SELECT unnest(bs) AS e, frame_id FROM (SELECT frame_id, arg_max(bs, k) AS bs FROM r GROUP BY 1))"""


@query("merge_boundary", W(f"+{_seams()} SELECT frame_id, e.o AS det_ord, e.s AS score, e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2 FROM fin WHERE NOT e.gone", "tiled", recursive=True))
def _(spark, sf):
    return R.merge_boundary(P.untile(view(spark, sf, "tiled")), ["frame_id"]).select("frame_id", "det_ord", "score", *BOX)


def _dup(a: str, b: str) -> str:
    same = f"({Q.ios(a, b)} >= 0.7 AND {Q.center_inside(a, b)})"
    cross = f"({Q.iou_tracker(a, b)} >= 0.85 OR ({Q.ios(a, b)} >= 0.5 AND {Q.center_inside(a, b)}))"
    return f"(CASE WHEN {a}class_id = {b}class_id THEN {same} ELSE {cross} END)"


DEDUP_SQL = f"""pr AS MATERIALIZED (SELECT frame_id, i, j, sj > si AS beats FROM (
      SELECT a.frame_id, a.n AS i, b.n AS j, a.score AS si, b.score AS sj FROM nd a JOIN nd b ON a.frame_id = b.frame_id AND a.n < b.n AND {_dup('a.', 'b.')})),
  lst AS MATERIALIZED (SELECT frame_id, i, list({{'j': j, 'beats': beats}} ORDER BY j) AS dups FROM pr GROUP BY 1, 2),
  steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY i) AS k FROM lst),
  r AS (SELECT DISTINCT frame_id, 0::BIGINT AS k, []::BIGINT[] AS gone FROM steps
    UNION ALL
    SELECT s.frame_id, s.k, CASE WHEN list_contains(r.gone, s.i) THEN r.gone ELSE list_concat(r.gone,
        list_transform(list_filter(s.dups, lambda d: NOT list_contains(r.gone, d.j) AND d.j < coalesce(list_min(list_transform(list_filter(s.dups, lambda e: e.beats AND NOT list_contains(r.gone, e.j)), lambda e: e.j)), 1000000)), lambda d: d.j),
        CASE WHEN len(list_filter(s.dups, lambda e: e.beats AND NOT list_contains(r.gone, e.j))) > 0 THEN [s.i] ELSE []::BIGINT[] END) END
    FROM r JOIN steps s ON s.frame_id = r.frame_id AND s.k = r.k + 1),
  fin AS (SELECT frame_id, arg_max(gone, k) AS gone FROM r GROUP BY frame_id)"""


@query("dedup_display", W(f"+nd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY det_ord) AS n FROM detections), {DEDUP_SQL} SELECT n.frame_id, n.det_ord FROM nd n LEFT JOIN fin USING (frame_id) WHERE NOT coalesce(list_contains(gone, n), false)".replace("list_contains(gone, n), false", "list_contains(gone, n.n), false"), "detections", recursive=True))
def _(spark, sf):
    return R.dedup_display(view(spark, sf, "detections"), ["frame_id"]).select("frame_id", "det_ord")


OVER_KO = "(least(k.x2, o.x2) > greatest(k.x1, o.x1) AND least(k.y2, o.y2) > greatest(k.y1, o.y1))"
RPLACE = f"coalesce(list_position(list_transform(r.kept, lambda k: {OVER_KO}), true), 0)"
REGION_SQL = f"""jr AS ({JOINT_SQL[JOINT_SQL.rindex('SELECT frame_id, a_ord'):]}),
  o AS MATERIALIZED (SELECT frame_id, region_x AS x1, region_y AS y1, region_x + region_w AS x2, region_y + region_h AS y2, row_number() OVER (PARTITION BY frame_id ORDER BY a_ord, b_ord) AS n FROM jr),
  r AS (SELECT frame_id, n, [{_packed('')}] AS kept FROM o WHERE n = 1
    UNION ALL
    SELECT o.frame_id, o.n, CASE WHEN {RPLACE} = 0 THEN list_append(r.kept, {_packed('o.')})
      ELSE list_transform(r.kept, lambda k, i: CASE WHEN i = {RPLACE} THEN {{'x1': least(k.x1, o.x1), 'y1': least(k.y1, o.y1), 'x2': greatest(k.x2, o.x2), 'y2': greatest(k.y2, o.y2)}} ELSE k END) END
    FROM r JOIN o ON o.frame_id = r.frame_id AND o.n = r.n + 1),
  fin AS (SELECT frame_id, arg_max(kept, n) AS kept FROM r GROUP BY frame_id),
  u AS (SELECT frame_id, unnest(kept) AS b, generate_subscripts(kept, 1) - 1 AS region_no FROM fin)"""


@query("merge_regions", W(JOINT_SQL[: JOINT_SQL.rindex("SELECT frame_id, a_ord")].rstrip() + f", {REGION_SQL} SELECT frame_id, region_no::INT AS region_no, b.x1 AS region_x, b.y1 AS region_y, b.x2 - b.x1 AS region_w, b.y2 - b.y1 AS region_h FROM u", "tiled", recursive=True))
def _(spark, sf):
    pairs = J.joint_recheck_pairs(P.untile(view(spark, sf, "tiled")), ["frame_id"], 3840, 2160)
    return R.merge_regions(pairs, ["frame_id"])


# ---------------------------------------------------------------- matching and evaluation


def _match(order: str, thr: str, plus: str) -> str:
    return f"""ed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY {order}) AS n FROM (
      SELECT g.frame_id, g.class_id, g.det_ord AS gt_ord, p.det_ord AS pred_ord, p.score, {Q.iou('p.', 'g.', plus)} AS iou
      FROM ground_truth g JOIN predictions p ON g.frame_id = p.frame_id AND g.class_id = p.class_id AND {Q.inter('p.', 'g.')} > 0) WHERE iou >= {thr}),
  m AS (SELECT frame_id, class_id, n, pred_ord, gt_ord, iou, true AS ok, [pred_ord] AS up, [gt_ord] AS ug FROM ed WHERE n = 1
    UNION ALL
    SELECT e.frame_id, e.class_id, e.n, e.pred_ord, e.gt_ord, e.iou, NOT list_contains(m.up, e.pred_ord) AND NOT list_contains(m.ug, e.gt_ord),
      CASE WHEN NOT list_contains(m.up, e.pred_ord) AND NOT list_contains(m.ug, e.gt_ord) THEN list_append(m.up, e.pred_ord) ELSE m.up END,
      CASE WHEN NOT list_contains(m.up, e.pred_ord) AND NOT list_contains(m.ug, e.gt_ord) THEN list_append(m.ug, e.gt_ord) ELSE m.ug END
    FROM m JOIN ed e ON e.frame_id = m.frame_id AND e.class_id = m.class_id AND e.n = m.n + 1),
  mt AS MATERIALIZED (SELECT frame_id, class_id, pred_ord, gt_ord, iou FROM m WHERE ok)"""


KEYS = ["frame_id", "class_id"]
SCORED = _match("round(score, 6) DESC, pred_ord, iou DESC, gt_ord", "0.3", "1e-6")
SCORED_ALL = f"""{SCORED}, ms AS MATERIALIZED (SELECT p.frame_id, p.class_id, p.det_ord AS pred_ord, p.score, mt.gt_ord, mt.iou, mt.gt_ord IS NOT NULL AS tp
  FROM predictions p LEFT JOIN mt ON mt.frame_id = p.frame_id AND mt.class_id = p.class_id AND mt.pred_ord = p.det_ord)"""


def _matched(spark, sf, max_group=R.MAX_GROUP):
    gt, pred = _gt_pred(spark, sf)
    return gt, R.match_scored(gt, pred, KEYS, 0.3, max_group=max_group)


@query("match_scored", W(f"+{SCORED_ALL} SELECT frame_id, class_id, pred_ord, tp, coalesce(gt_ord, -1) AS gt_ord, ROUND(coalesce(iou, 0), 6) AS match_iou FROM ms", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    _, m = _matched(spark, sf)
    return m.select(*KEYS, "pred_ord", "tp", F.coalesce("gt_ord", F.lit(-1)).alias("gt_ord"), r6(F.coalesce("match_iou", F.lit(0.0)), "match_iou"))


@query("match_scored_crowded", W(f"+{SCORED_ALL} SELECT frame_id, class_id, pred_ord, tp FROM ms", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    """The rounds that settle crowded images, forced here by a tiny group limit."""
    _, m = _matched(spark, sf, max_group=1)
    return m.select(*KEYS, "pred_ord", "tp")


LABEL_MATCH = _match("pred_ord, iou DESC, gt_ord", "0.3", "1e-12") + """, oc AS MATERIALIZED (
  SELECT p.frame_id, p.class_id, p.det_ord AS ord, CASE WHEN mt.gt_ord IS NULL THEN 'fp' ELSE 'tp' END AS outcome, mt.iou
  FROM predictions p LEFT JOIN mt ON mt.frame_id = p.frame_id AND mt.class_id = p.class_id AND mt.pred_ord = p.det_ord
  UNION ALL
  SELECT g.frame_id, g.class_id, g.det_ord, 'fn', NULL FROM ground_truth g WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.frame_id = g.frame_id AND mt.class_id = g.class_id AND mt.gt_ord = g.det_ord))"""


def _outcomes(spark, sf):
    return R.match_labels(*_gt_pred(spark, sf), KEYS, 0.3)


@query("match_labels", W(f"+{LABEL_MATCH} SELECT frame_id, class_id, ord, outcome, ROUND(coalesce(iou, 0), 6) AS iou FROM oc", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    o = _outcomes(spark, sf)
    ord_ = F.when(F.col("outcome") == "fn", F.col("gt_ord")).otherwise(F.col("pred_ord"))
    return o.select(*KEYS, ord_.alias("ord"), "outcome", r6(F.coalesce("iou", F.lit(0.0)), "iou"))


@query("label_pair_metrics", W(f"""+{LABEL_MATCH}, c AS (SELECT coalesce(class_id, -1) AS class_id, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn, coalesce(avg(iou), 0) AS mean_iou FROM oc GROUP BY ROLLUP (class_id)),
  d AS (SELECT *, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall FROM c)
  SELECT class_id, tp, fp, fn, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(2 * precision * recall / greatest(1e-12, precision + recall), 6) AS f1, ROUND(mean_iou, 6) AS mean_iou FROM d""", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    out = E.label_pair_metrics(_outcomes(spark, sf))
    return out.select("class_id", "tp", "fp", "fn", *[r6(c) for c in ("precision", "recall", "f1", "mean_iou")])


PR_SQL = f"""{SCORED_ALL}, gc AS (SELECT class_id, count(*) AS n_gt FROM ground_truth GROUP BY 1),
  pc AS MATERIALIZED (SELECT *, sum(tp::INT) OVER w AS cum_tp, sum(1 - tp::INT) OVER w AS cum_fp FROM ms WINDOW w AS (PARTITION BY class_id ORDER BY round(score * 1e6) DESC, frame_id, pred_ord ROWS UNBOUNDED PRECEDING)),
  cv AS MATERIALIZED (SELECT pc.*, n_gt, cum_tp / (cum_tp + cum_fp + 1e-6) AS precision, cum_tp / greatest(n_gt, 1) AS recall FROM pc JOIN gc USING (class_id)),
  en AS MATERIALIZED (SELECT *, max(precision) OVER (PARTITION BY class_id ORDER BY round(score * 1e6) DESC, frame_id, pred_ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM cv)"""


def _curve(spark, sf):
    gt, m = _matched(spark, sf)
    n_gt = gt.groupBy("class_id").agg(F.count("*").alias("n_gt"))
    return gt, m, Wn.pr_curve(m, n_gt, ["class_id"])


@query("pr_curve", W(f"+{PR_SQL} SELECT class_id, frame_id, pred_ord, cum_tp::BIGINT AS cum_tp, cum_fp::BIGINT AS cum_fp, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall FROM cv", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    return _curve(spark, sf)[2].select("class_id", "frame_id", "pred_ord", "cum_tp", "cum_fp", r6("precision"), r6("recall"))


@query("precision_envelope", W(f"+{PR_SQL} SELECT class_id, frame_id, pred_ord, ROUND(envelope, 6) AS envelope FROM en", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    env = Wn.precision_envelope(_curve(spark, sf)[2], ["class_id"])
    return env.select("class_id", "frame_id", "pred_ord", r6("envelope"))


AP_SQL = f"""{PR_SQL}, ap AS (SELECT class_id, max(n_gt) AS gt_count, count(*) AS pred_count, sum(CASE WHEN tp THEN envelope ELSE 0 END) / max(n_gt) AS ap, max(cum_tp) / (count(*) + 1e-6) AS precision, max(cum_tp) / max(n_gt) AS recall FROM en GROUP BY class_id)"""


@query("average_precision", W(f"+{AP_SQL} SELECT class_id, gt_count, pred_count, ROUND(ap, 6) AS ap, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall FROM ap UNION ALL SELECT 6, 0, 0, 0.0, 0.0, 0.0", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    gt, m = _matched(spark, sf)
    out = E.average_precision(m, gt, ["class_id"], classes=list(range(7)))
    return out.select("class_id", "gt_count", "pred_count", r6("ap"), r6("precision"), r6("recall"))


DOMAIN_SQL = PR_SQL.replace("SELECT class_id, count(*) AS n_gt FROM ground_truth GROUP BY 1", "SELECT channel_id, class_id, count(*) AS n_gt FROM ground_truth GROUP BY 1, 2").replace(
    "FROM ms WINDOW", "FROM (SELECT ms.*, concat('ch', CAST(frame_id % 4 AS VARCHAR)) AS channel_id FROM ms) WINDOW").replace("PARTITION BY class_id ORDER BY round", "PARTITION BY channel_id, class_id ORDER BY round").replace("JOIN gc USING (class_id)", "JOIN gc USING (channel_id, class_id)")


@query("mean_average_precision", W(f"""+{DOMAIN_SQL}, ap AS (SELECT channel_id, class_id, sum(CASE WHEN tp THEN envelope ELSE 0 END) / max(n_gt) AS ap FROM en GROUP BY 1, 2)
  SELECT channel_id, ROUND(avg(ap), 6) AS map, count(*) AS classes FROM ap GROUP BY 1""", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    gt, m = _matched(spark, sf)
    per_class = E.average_precision(m, gt, ["channel_id", "class_id"])
    out = E.mean_average_precision(per_class, ["channel_id"])
    return out.select("channel_id", r6("map"), "classes")


DATASET_AP_SQL = f"""{PR_SQL.replace("(cum_tp + cum_fp + 1e-6)", "greatest(cum_tp + cum_fp, 1e-9)")}, ap AS (
    SELECT class_id, max(n_gt) AS gt_count, count(*) AS pred_count, sum(CASE WHEN tp THEN envelope ELSE 0 END) / max(n_gt) AS ap, max(cum_tp) / greatest(count(*), 1e-9) AS precision, max(cum_tp) / max(n_gt) AS recall FROM en GROUP BY class_id
    UNION ALL SELECT 6, 0, 0, 0.0, 0.0, 0.0)"""


def _dataset_ap(spark, sf):
    gt, m = _matched(spark, sf)
    return E.average_precision(m, gt, ["class_id"], classes=list(range(7)), style="dataset")


@query("average_precision_dataset", W(f"+{DATASET_AP_SQL} SELECT class_id, gt_count, pred_count, ROUND(ap, 6) AS ap, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall FROM ap", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    return _dataset_ap(spark, sf).select("class_id", "gt_count", "pred_count", r6("ap"), r6("precision"), r6("recall"))


@query("mean_average_precision_zero", W(f"+{DATASET_AP_SQL} SELECT ROUND(avg(ap), 6) AS map, count(*) AS classes FROM ap", "ground_truth", "predictions", recursive=True))
def _(spark, sf):
    """A class without ground truth counts as 0."""
    return E.mean_average_precision(_dataset_ap(spark, sf), missing_class="zero").select(r6("map"), "classes")


@query("prediction_totals", W("SELECT count(*) AS images, (SELECT count(*) FROM predictions) AS predictions, count(*) FILTER (NOT EXISTS (SELECT 1 FROM predictions p WHERE p.frame_id = f.frame_id)) AS empty_images FROM frames f", "frames", "predictions"))
def _(spark, sf):
    return E.prediction_totals(view(spark, sf, "frames").select("frame_id"), view(spark, sf, "predictions"))


# ---------------------------------------------------------------- reports and regions over time

SUMMARY_SQL = "sm AS (SELECT channel_id, frame_id, label, count(*) AS cnt, floor(max(score) * 100 + 0.5) / 100 AS score FROM detections GROUP BY 1, 2, 3)"


@query("summarize_objects", W(f"+{SUMMARY_SQL} SELECT channel_id, frame_id, label, cnt AS count, score FROM sm", "detections"))
def _(spark, sf):
    return A.summarize_objects(view(spark, sf, "detections"), ["channel_id", "frame_id"])


@query("changed_only", W("+l AS (SELECT *, lag(summary_key) OVER w AS before, row_number() OVER w AS n FROM reports WINDOW w AS (PARTITION BY channel_id ORDER BY ts_ms)) SELECT channel_id, turn, summary_key, has_events FROM l WHERE n = 1 OR before IS DISTINCT FROM summary_key OR has_events", "reports"))
def _(spark, sf):
    return Wn.changed_only(view(spark, sf, "reports"), block_ms=3000).select("channel_id", "turn", "summary_key", "has_events")


LIVE_SQL = f"""kept AS (SELECT d.* FROM detections d JOIN hit h USING (frame_id, det_ord) WHERE d.score >= 0.3 AND d.label IN ('cup', 'laptop', 'book')),
  s AS (SELECT frame_id, label, count(*) AS cnt, floor(max(score) * 100 + 0.5) / 100 AS sc FROM kept GROUP BY 1, 2),
  k AS (SELECT frame_id, string_agg(label || ':' || cnt || ':' || sc, ',' ORDER BY label) AS key, sum(cnt)::BIGINT AS n FROM s GROUP BY 1),
  t AS (SELECT f.channel_id, f.frame_id, f.ts_ms, coalesce(key, '') AS key, coalesce(n, 0) AS n_objects FROM frames f LEFT JOIN k USING (frame_id)),
  l AS (SELECT *, lag(key) OVER w AS before, row_number() OVER w AS i FROM t WINDOW w AS (PARTITION BY channel_id ORDER BY ts_ms))"""


@query("live_reports", W(f"+{ROI_PIXELS}, {ROI_HIT}, {LIVE_SQL} SELECT channel_id, frame_id, ts_ms, n_objects FROM l WHERE i = 1 OR before <> key", "detections", "regions", "frames"))
def _(spark, sf):
    """Flagship: score, class and region filters, object summary per frame, reports on change."""
    d = P.filter_confidence(view(spark, sf, "detections"), 0.3)
    d = P.filter_classes(d, ["cup", "laptop", "book"])
    d = P.roi_assign(d, view(spark, sf, "regions"), FRAME_W, FRAME_H)
    # One small row per frame, scanned twice below: written once.
    reports = checkpointed(A.frame_reports(view(spark, sf, "frames"), d))
    return Wn.changed_only(reports, events=None).select("channel_id", "frame_id", "ts_ms", "n_objects")


DWELL_SQL = f"""a AS (SELECT d.*, h.region_ord, d.ts_ms AS t FROM detections d JOIN hit h USING (frame_id, det_ord)),
  b AS (SELECT *, lag(t) OVER w AS pt, {', '.join(f'lag({c}) OVER w AS p{c}' for c in BOX)} FROM a WINDOW w AS (PARTITION BY channel_id, region_ord, class_id ORDER BY t, det_ord)),
  c AS (SELECT *, CASE WHEN pt IS NULL OR {Q.iou('b.', 'b.p')} < 0.2 THEN 1 ELSE 0 END AS st FROM b),
  e AS (SELECT *, sum(st) OVER (PARTITION BY channel_id, region_ord, class_id ORDER BY t, det_ord ROWS UNBOUNDED PRECEDING) AS isl FROM c),
  g AS (SELECT *, (t - min(t) OVER (PARTITION BY channel_id, region_ord, class_id, isl)) / 1000.0 AS dwell FROM e)"""


@query("roi_dwell", W(f"+{ROI_PIXELS}, {ROI_HIT}, {DWELL_SQL} SELECT channel_id, region_ord, class_id, frame_id, det_ord, dwell AS dwell_sec FROM g WHERE dwell >= 0.5", "detections", "regions"))
def _(spark, sf):
    boxes = P.roi_assign(view(spark, sf, "detections").drop("label", "pts_ms", "score"), view(spark, sf, "regions"), FRAME_W, FRAME_H)
    out = Wn.roi_dwell(boxes, 0.5, block_ms=60_000)
    return out.select("channel_id", "region_ord", "class_id", "frame_id", "det_ord", "dwell_sec")


@query("connection_epoch", W("""+l AS (SELECT *, lag(pts) OVER (PARTITION BY channel_id ORDER BY frame_id) AS before FROM (SELECT channel_id, frame_id, 33 * position AS pts FROM source_frames))
  SELECT channel_id, frame_id, sum(CASE WHEN before > pts THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id ORDER BY frame_id)::BIGINT AS epoch FROM l""", "source_frames"))
def _(spark, sf):
    f = view(spark, sf, "source_frames").withColumn("pts_ms", F.col("position") * 33)
    return Wn.connection_epoch(f, block=1000).select("channel_id", "frame_id", "epoch")


def _next(gap: int) -> str:
    return f"""f AS MATERIALIZED (SELECT channel_id, frame_id, ts_ms FROM frames),
  nx AS MATERIALIZED (SELECT a.channel_id, a.frame_id, a.ts_ms, b.frame_id AS nf, b.ts_ms AS nt FROM (SELECT *, ts_ms + {gap} AS due FROM f) a ASOF LEFT JOIN f b ON a.channel_id = b.channel_id AND a.due <= b.ts_ms),
  r AS (SELECT channel_id, arg_min(frame_id, ts_ms) AS frame_id, min(ts_ms) AS ts_ms FROM f GROUP BY channel_id
    UNION ALL SELECT r.channel_id, nx.nf, nx.nt FROM r JOIN nx ON nx.channel_id = r.channel_id AND nx.ts_ms = r.ts_ms WHERE nx.nt IS NOT NULL)"""


@query("throttle_ticks", W(f"+{_next(2000)} SELECT channel_id, frame_id, ts_ms FROM r", "frames", recursive=True))
def _(spark, sf):
    return Wn.throttle_ticks(view(spark, sf, "frames"), 2).select("channel_id", "frame_id", "ts_ms")


@query("throttle_ticks_aligned", W("SELECT channel_id, arg_max(frame_id, ts_ms) AS frame_id, max(ts_ms) AS ts_ms FROM frames GROUP BY channel_id, ts_ms // 2000", "frames"))
def _(spark, sf):
    return Wn.throttle_ticks(view(spark, sf, "frames"), 2, exact=False).select("channel_id", "frame_id", "ts_ms")


def mailbox(gap: int) -> str:
    """Dispatch times and the newest row at each: at the due time if anything came since the last, else when the next comes."""
    return f"""f AS MATERIALIZED (SELECT channel_id, frame_id, ts_ms FROM frames),
  r AS (SELECT channel_id, min(ts_ms) AS sent, min(ts_ms) AS ts_ms FROM f GROUP BY 1
    UNION ALL SELECT channel_id, CASE WHEN newest > sent THEN sent + {gap} ELSE later END, CASE WHEN newest > sent THEN newest ELSE later END
    FROM (SELECT r.channel_id, r.sent, (SELECT max(f.ts_ms) FROM f WHERE f.channel_id = r.channel_id AND f.ts_ms <= r.sent + {gap}) AS newest,
        (SELECT min(f.ts_ms) FROM f WHERE f.channel_id = r.channel_id AND f.ts_ms > r.sent + {gap}) AS later FROM r) WHERE newest > sent OR later IS NOT NULL)"""


@query("rate_thin", W(f"+{mailbox(333)} SELECT channel_id, f.frame_id, ts_ms FROM r JOIN f USING (channel_id, ts_ms)", "frames", recursive=True))
def _(spark, sf):
    return Wn.rate_thin(view(spark, sf, "frames"), 3).select("channel_id", "frame_id", "ts_ms")


@query("rate_thin_aligned", W("SELECT channel_id, arg_max(frame_id, ts_ms) AS frame_id, max(ts_ms) AS ts_ms FROM frames GROUP BY channel_id, ts_ms // 333", "frames"))
def _(spark, sf):
    return Wn.rate_thin(view(spark, sf, "frames"), 3, exact=False).select("channel_id", "frame_id", "ts_ms")


REPAIR_SQL = """s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel_id, connection ORDER BY frame_id) AS n FROM source_frames),
  r AS (SELECT channel_id, connection, n, frame_id, coalesce(source_pts_ms, 0) AS p FROM s WHERE n = 1
    UNION ALL SELECT s.channel_id, s.connection, s.n, s.frame_id, CASE WHEN s.source_pts_ms > r.p THEN s.source_pts_ms ELSE r.p + 132 END
    FROM r JOIN s ON s.channel_id = r.channel_id AND s.connection = r.connection AND s.n = r.n + 1)"""


@query("repair_pts", W(f"+{REPAIR_SQL} SELECT channel_id, frame_id, p AS repaired_pts_ms FROM r", "source_frames", recursive=True))
def _(spark, sf):
    f = view(spark, sf, "source_frames").select("channel_id", "connection", "frame_id", F.col("source_pts_ms").alias("pts_ms"))
    return Wn.repair_pts(f, 132, ["channel_id", "connection"], block=500).select("channel_id", "frame_id", "repaired_pts_ms")


# ---------------------------------------------------------------- tracking


@query("track_raw", W(f"SELECT channel_id, frame_id, label, score, {BOX_SQL} FROM detections", "detections"))
def _(spark, sf):
    d = view(spark, sf, "detections")
    out = T.track(view(spark, sf, "frames"), d, T.TrackerConfig(mode="raw"))
    return out.where("kind = 'shown'").select("channel_id", "frame_id", "label", "score", *BOX)


@query("unframed", W("SELECT frame_id, det_ord FROM detections d JOIN frames f USING (frame_id) WHERE width % 2 = 1 OR height % 2 = 1", "detections", "frames"))
def _(spark, sf):
    even = view(spark, sf, "frames").where("width % 2 = 0 AND height % 2 = 0")
    return T.unframed(even, view(spark, sf, "detections")).select("frame_id", "det_ord")


LIVE = T.TrackerConfig()
ALL_OPTIONS = T.TrackerConfig(confirm_hits=1, reversal_damping=True, global_motion=True)
CONNECTED = ["channel_id", "connection"]


def connected(df):
    """``df`` with the connection its frames came over; the tracker starts anew with each."""
    return df.withColumn("connection", F.floor(F.col("frame_id") / track_sql.CONNECTION).cast("long"))


@query("track_snapshots", W(track_sql.snapshots(LIVE), "frames", "detections", recursive=True))
def _(spark, sf):
    frames, boxes = connected(view(spark, sf, "frames")), connected(view(spark, sf, "detections"))
    return T.snapshots(T.track(frames, boxes, LIVE, keys=CONNECTED, kinds=("frame",)), CONNECTED)


@query("track_snapshots_options", W(track_sql.snapshots(ALL_OPTIONS), "frames", "detections", recursive=True))
def _(spark, sf):
    frames, boxes = connected(view(spark, sf, "frames")), connected(view(spark, sf, "detections"))
    return T.snapshots(T.track(frames, boxes, ALL_OPTIONS, keys=CONNECTED, kinds=("frame",)), CONNECTED)


def _motion(spark, sf, config):
    frames, boxes = connected(view(spark, sf, "frames")), connected(view(spark, sf, "detections"))
    out = T.motion_tracks(T.track(frames, boxes, config, keys=CONNECTED, kinds=("motion",)), CONNECTED)
    return out.withColumns({c: r6(F.col(c) + track_sql.OFF_TIE) for c in (*(f"smooth_{b}" for b in BOX), "center_alpha", "size_alpha")})


@query("track_motion", W(track_sql.motion(ALL_OPTIONS), "frames", "detections", recursive=True))
def _(spark, sf):
    return _motion(spark, sf, ALL_OPTIONS)


@query("track_motion_live", W(track_sql.motion(LIVE), "frames", "detections", recursive=True))
def _(spark, sf):
    return _motion(spark, sf, LIVE)
