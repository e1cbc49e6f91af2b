"""Operators against plain loops on random small input, hot groups, streams against batch."""

import datetime
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from boxweave.functions import boxmath as M
from boxweave.operators import aggregates as A
from boxweave.operators import compose
from boxweave.operators import filters as P
from boxweave.operators import greedy as R
from boxweave.operators import joins as J
from boxweave.operators import replay as X
from boxweave.operators import tracking as T
from boxweave.operators import windows as Wn
from boxweave.operators.pacing import paced
from boxweave.operators.scan import Step, ordered_scan, time_block
from boxweave.operators.sequential import affine_scan, group_tables
from boxweave.streaming import stateful as S

BOX = "class_id int, label string, score double, x1 double, y1 double, x2 double, y2 double"


def boxes(seed, frames, per_frame, span=300.0, classes=3):
    rng = random.Random(seed)
    rows = []
    for f in range(frames):
        for o in range(rng.randint(0, per_frame)):
            x, y = rng.uniform(0, span), rng.uniform(0, span)
            c = rng.randrange(classes)
            rows.append((f, o, c, f"c{c}", rng.choice([0.3, 0.5, 0.7, 0.9]), x, y, x + rng.uniform(20, 150), y + rng.uniform(20, 150)))
    return rows


def test_scan_equals_plain_window(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else "cold", t, rng.choice([None, rng.randint(0, 9)])) for t in rng.sample(range(3000), 800)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    steps = [Step("s", "sum", F.coalesce("v", F.lit(0))), Step("l", "last", F.col("v")), Step("m", "max", F.col("v")), Step("p", "lag", F.struct("t")), Step("n", "count")]
    got = ordered_scan(df, ["k"], [time_block("t", 400), time_block("t", 50)], [F.col("t")], steps)
    w = Window.partitionBy("k").orderBy("t")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "t", "v", F.sum(F.coalesce("v", F.lit(0))).over(up).alias("s"), F.last("v", True).over(up).alias("l"), F.max("v").over(up).alias("m"),
                     F.lag("t").over(w).alias("p"), F.row_number().over(w).alias("n"))
    a = sorted((r.k, r.t, r.s, r.l, r.m, r.p.t if r.p else None, r.n) for r in got.collect())
    b = sorted((r.k, r.t, r.s, r.l, r.m, r.p, r.n) for r in want.collect())
    assert a == b
    back = ordered_scan(df, ["k"], [time_block("t", 50)], [F.col("t")], [Step("m", "max", F.col("v"))], reverse=True)
    down = w.rowsBetween(0, Window.unboundedFollowing)
    assert sorted((r.k, r.t, r.m) for r in back.collect()) == sorted((r.k, r.t, r.m) for r in df.select("k", "t", F.max("v").over(down).alias("m")).collect())


def test_affine_scan_equals_loop():
    import numpy as np

    rng = np.random.default_rng(2)
    a = rng.choice([0.0, 1.0, 0.65, 0.9], 1000)
    b = rng.normal(size=1000)
    x, want = 3.0, []
    for i in range(1000):
        x = a[i] * x + b[i]
        want.append(x)
    assert np.allclose(affine_scan(a, b, 3.0), want, atol=1e-9)


@pytest.mark.parametrize("max_group", [R.MAX_GROUP, 4])
def test_nms_equals_loop_also_for_crowded_frames(spark, max_group):
    rows = boxes(3, 12, 25)
    df = spark.createDataFrame(rows, f"frame_id long, det_ord long, {BOX}")
    want = set()
    for f in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[4], r[1])):
            def iou(k):
                s = M.shared(k[5:], r[5:])
                return s / (M.area(k[5:]) + M.area(r[5:]) - s + 1e-6)
            if all(k[2] != r[2] or iou(k) <= 0.45 for k in kept):
                kept.append(r)
        want |= {(f, k[1]) for k in kept}
    got = R.nms(df, 0.45, ["frame_id"], max_group)
    assert {(r.frame_id, r.det_ord) for r in got.collect()} == want
    assert R.nms(got, 0.45, ["frame_id"]).count() == len(want)


def test_crowded_frames_merge_like_quiet_ones(spark):
    """Strips of a crowded frame give what the frame as a whole gives."""
    rows = [(r[0], *r[1:5], r[5] * 4, r[6], r[5] * 4 + r[7] - r[5], r[8]) for r in boxes(15, 6, 30)]
    df = spark.createDataFrame(rows, f"frame_id long, det_ord long, {BOX}")
    for op in (R.merge_detections, R.dedup_display):
        whole = {(r.frame_id, r.det_ord) for r in op(df, ["frame_id"]).collect()}
        cut = {(r.frame_id, r.det_ord) for r in op(df, ["frame_id"], max_group=3).collect()}
        assert whole == cut and len(whole) < len(rows)


def test_pile_of_copies(spark):
    rows = [(0, i, 1, "c", 0.5, 0.0, 0.0, 10.0, 10.0) for i in range(300)] + [(0, 1000, 1, "c", 0.9, 2.0, 0.0, 11.0, 10.0), (0, 1001, 1, "c", 0.1, 5.0, 5.0, 5.0, 5.0), (0, 1002, 1, "c", 0.1, 5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, f"frame_id long, det_ord long, {BOX}")
    for limit in (R.MAX_GROUP, 5):
        assert {r.det_ord for r in R.nms(df, 0.45, ["frame_id"], limit).collect()} == {1000, 1001, 1002}


def test_crowded_frames_write_down_conflicts_not_boxes(spark, monkeypatch):
    """Of 400 boxes side by side 40 meet another one: the rounds hold these pairs only, none of the other boxes."""
    rows = [(0, i, 1, "c", 0.9, 700.0 * i, 0.0, 700.0 * i + 100, 100.0) for i in range(400)]
    rows += [(0, 1000 + i, 1, "c", 0.5, 700.0 * i + 10, 0.0, 700.0 * i + 110, 100.0) for i in range(40)]
    written, cut = [], R.checkpointed

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(R, "checkpointed", counted)
    df = spark.createDataFrame(rows, f"frame_id long, det_ord long, {BOX}")
    assert {r.det_ord for r in R.nms(df, 0.45, ["frame_id"], 100).collect()} == set(range(400))
    assert max(written) == 40 and sum(written) <= 100


@pytest.mark.parametrize("max_group", [R.MAX_GROUP, 4])
def test_exclusive_choice_in_long_chains(spark, max_group):
    """Each box beats the next one only: every second one stays, whatever the number of rounds."""
    rows = [(0, i, 1, "c", 0.9 - i / 100, 10.0 * i, 0.0, 10.0 * i + 30, 10.0, 0, 0, 5000, 5000, "tile") for i in range(12)]
    df = spark.createDataFrame(rows, f"frame_id long, det_ord long, {BOX}, tile_x int, tile_y int, tile_w int, tile_h int, origin string")
    assert {r.det_ord for r in R.select_exclusive(df, ["frame_id"], max_group).collect()} == set(range(0, 12, 2))


TILED = f"frame_id long, det_ord long, {BOX}, tile_x int, tile_y int, tile_w int, tile_h int, origin string"


def _halves(spark, rows):
    """Boundary merge of boxes in a left tile (0 to 300) or a right one (200 to 500), 500 high."""
    tiles = {"L": (0, 0, 300, 500, "tile"), "R": (200, 0, 300, 500, "tile")}
    df = spark.createDataFrame([(0, i, c, "x", s, *map(float, box), *tiles[t]) for i, (t, c, s, box) in enumerate(rows)], TILED)
    return sorted((r.det_ord, r.score, r.x1, r.y1, r.x2, r.y2) for r in R.merge_boundary(df, ["frame_id"]).collect())


def test_halves_at_a_seam_become_one_box(spark):
    left, right = ("L", 1, 0.6, (100, 100, 280, 200)), ("R", 1, 0.8, (220, 105, 400, 205))
    assert _halves(spark, [left, right]) == [(0, 0.8, 100, 100, 400, 205)]
    assert len(_halves(spark, [left, ("R", 2, 0.8, (220, 105, 400, 205))])) == 2  # another class
    assert len(_halves(spark, [left, ("R", 1, 0.8, (220, 170, 400, 290))])) == 2  # 30 of 100 px side by side
    assert len(_halves(spark, [("L", 1, 0.6, (20, 100, 120, 200)), ("R", 1, 0.8, (390, 100, 480, 200))])) == 2  # far from the seam


def test_what_overlaps_after_that_unites_or_goes(spark):
    # Too far from the middle to be halves. Nearly as clear of the tile's edge: one box of both;
    # clearer by more than 32 px: that one stays as it is.
    assert _halves(spark, [("R", 1, 0.5, (447, 60, 480, 160)), ("R", 1, 0.9, (450, 100, 498, 200))]) == [(0, 0.9, 447, 60, 498, 200)]
    assert _halves(spark, [("R", 1, 0.5, (448, 60, 498, 160)), ("R", 1, 0.4, (447, 60, 455, 160))]) == [(1, 0.4, 447, 60, 455, 160)]


def test_order_of_frames_and_rows_does_not_matter(spark):
    rng = random.Random(5)
    rows = [(f, o, c, n, s, x1, y1, x2, y2, *((0, 0, 300, 500) if rng.random() < 0.5 else (200, 0, 300, 500)), "tile") for f, o, c, n, s, x1, y1, x2, y2 in boxes(4, 20, 10, span=250.0, classes=2)]
    once = {tuple(r) for r in R.merge_boundary(spark.createDataFrame(rows, TILED), ["frame_id"]).collect()}
    rng.shuffle(rows)
    assert {tuple(r) for r in R.merge_boundary(spark.createDataFrame(rows, TILED).repartition(5), ["frame_id"]).collect()} == once and len(once) < len(rows)


@pytest.mark.parametrize("max_group", [R.MAX_GROUP, 2])
def test_matching_equals_loop(spark, max_group):
    gt, pred = boxes(6, 15, 8, 120.0, 2), boxes(7, 15, 12, 120.0, 2)
    g = spark.createDataFrame(gt, f"frame_id long, gt_ord long, {BOX}")
    p = spark.createDataFrame(pred, f"frame_id long, pred_ord long, {BOX}")
    want, taken = set(), set()
    for r in sorted(pred, key=lambda r: (-r[4], r[1])):
        best, at = -1.0, None
        for t in sorted(gt, key=lambda t: t[1]):
            if t[0] == r[0] and t[2] == r[2] and (t[0], t[1]) not in taken:
                s = M.shared(t[5:], r[5:])
                v = s / (M.area(t[5:]) + M.area(r[5:]) - s + 1e-6)
                if v > best:
                    best, at = v, t
        if best >= 0.3:
            taken.add((at[0], at[1]))
            want.add((r[0], r[1], at[1]))
    got = R.match_scored(g, p, ["frame_id", "class_id"], 0.3, max_group=max_group)
    assert {(r.frame_id, r.pred_ord, r.gt_ord) for r in got.where("tp").collect()} == want


def test_throttle_and_repair_equal_loops(spark):
    rng = random.Random(8)
    t, rows = 0, []
    for i in range(600):
        t += rng.choice([10, 40, 90, 400])
        rows.append(("c" if rng.random() < 0.8 else "d", i, t, rng.choice([None, t, t, t - 300])))
    df = spark.createDataFrame(rows, "channel_id string, frame_id long, ts_ms long, pts_ms long")
    want, last = set(), {}
    repaired, now = {}, {}
    for c, f, ts, pts in rows:
        if c not in last or ts - last[c] >= 142:
            last[c] = ts
            want.add(f)
        now[c] = pts if pts is not None and (c not in now or pts > now[c]) else (now[c] + 33 if c in now else 0)
        repaired[f] = now[c]
    got = Wn.thin_by_gap(df, ["channel_id"], "ts_ms", 142, block=500)
    assert {r.frame_id for r in got.collect()} == want
    fixed = Wn.repair_pts(df, 33, ["channel_id"], block=50)
    assert {r.frame_id: r.repaired_pts_ms for r in fixed.collect()} == repaired


def mailbox_loop(times, gap):
    """Rows kept by a mailbox of one row: the newest waits and leaves ``gap`` after the last one left."""
    out, due, waiting = [], None, None
    for i, t in enumerate(times):
        while waiting is not None and due < t:
            out.append(waiting)
            waiting, due = None, due + gap
        if due is None or (waiting is None and t >= due):
            out.append(i)
            due = t + gap
        else:
            waiting = i
    return out + ([waiting] if waiting is not None else [])


def gap_loop(times, gap):
    out, last = [], None
    for i, t in enumerate(times):
        if last is None or t - last >= gap:
            out.append(i)
            last = t
    return out


@pytest.mark.parametrize("newest, loop", [(True, mailbox_loop), (False, gap_loop)])
def test_one_channel_in_many_blocks_is_paced_like_a_loop(spark, monkeypatch, newest, loop):
    """A channel that never pauses, blocks of a few rows, tables joined two at a time over several levels."""
    monkeypatch.setattr(compose.entry_states, "__defaults__", (2,))
    rng = random.Random(11)
    rows, t = [], 10**6
    for i in range(700):
        t += rng.choice([0, 1, 5, 9, 14, 30])
        rows.append(("hot", t, i))
    rows += [("cold", 50, 1000), ("cold", 2_000_000, 1001), (None, 5, 1002), ("cold", None, 1003)]
    df = spark.createDataFrame(rows, "k string, t long, n long")
    want = {i for i in loop([t for k, t, _ in rows if k == "hot"], 40)} | {1000, 1001}
    got = {r.n for r in paced(df.orderBy("k", "t", "n").coalesce(1), ["k"], "t", 40, newest, block=100).collect()}
    times = {n: t for _, t, n in rows}
    assert sorted((times[n] or 0) for n in got) == sorted(times[n] for n in want)
    assert {n for n in got if n >= 1000} == {1000, 1001}


WIDE = "channel_id string, frame_id long, ts_ms long, pts_ms long, big long, flag boolean, tags array<string>, at timestamp"


def test_ordered_steps_leave_other_values_as_they_are(spark):
    """64-bit numbers beside nulls, booleans, arrays and times come back bit by bit."""
    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [("c", i, 100 * i, 100 * i, None if i % 3 == 0 else 2**60 + i, None if i % 4 == 0 else i % 2 == 0, None if i % 5 == 0 else [f"t{i}", None], None if i % 7 == 0 else when) for i in range(60)]
    df = spark.createDataFrame(rows, WIDE)
    whole = {r.frame_id: r for r in df.collect()}
    for kept in (Wn.rate_thin(df, 3), Wn.throttle_ticks(df, 1), Wn.repair_pts(df, 33, ["channel_id"], block=7).drop("repaired_pts_ms")):
        got = kept.collect()
        assert got and all(r == whole[r.frame_id] for r in got)
    boxed = df.withColumns({"det_ord": F.col("frame_id"), "class_id": F.lit(1), "score": F.lit(0.5), "x1": F.col("frame_id") * 30.0, "y1": F.lit(0.0), "x2": F.col("frame_id") * 30.0 + 20, "y2": F.lit(9.0),
                            "tile_x": F.lit(0), "tile_y": F.lit(0), "tile_w": F.lit(9000), "tile_h": F.lit(900), "frame": F.lit(1)})
    for kept in (R.dedup_display(boxed, ["frame"]), R.merge_boundary(boxed, ["frame"])):
        assert {r.frame_id: (r.big, r.flag, r.tags, r["at"]) for r in kept.collect()} == {f: (r.big, r.flag, r.tags, r["at"]) for f, r in whole.items()}
    moved = df.withColumns({"dx": F.lit(1.0), "dy": F.lit(2.0)})
    assert {r.frame_id: r.big for r in Wn.smooth_motion(moved).collect()} == {f: r.big for f, r in whole.items()}


@pytest.mark.parametrize("block", [1, 13, 10_000])
def test_repair_after_a_spike_counts_on(spark, block):
    """One frame far ahead: all that follow are steps after it, over many blocks."""
    values = [None, 10, 20, 5_000, *range(30, 330, 10), None, 9_000, 100]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "channel_id string, frame_id long, pts_ms long")
    want, last = [], None
    for v in values:
        last = (v or 0) if last is None else v if v is not None and v > last else last + 7
        want.append(last)
    got = sorted((r.frame_id, r.repaired_pts_ms, r.pts_ms) for r in Wn.repair_pts(df, 7, ["channel_id"], block=block).collect())
    assert [g[1] for g in got] == want and [g[2] for g in got] == values


def test_keys_stay_whole_after_a_join_that_becomes_a_broadcast(spark):
    """A join on the same keys, planned as a shuffle and run as a broadcast, leaves every key in one task (F3)."""
    set_to = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in set_to.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 50).alias("k"), "id")
        joined = rows.join(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("one")), "k")
        got = group_tables(joined, ["k"], [F.col("id")], lambda batch: {"n": [batch.num_rows]}, "n long").collect()
    finally:
        for name in set_to:
            spark.conf.unset(name)
    assert sorted((r.k, r.n) for r in got) == [(k, 80) for k in range(50)]


def test_repair_maps_compose():
    rng = random.Random(1)
    for _ in range(300):
        step, values = rng.choice([1, 3, 10]), [rng.choice([None, rng.randrange(-20, 60)]) for _ in range(rng.randrange(2, 12))]
        cut = rng.randrange(1, len(values))
        whole, joined = Wn._repair_map(values, step), Wn._repair_joined(Wn._repair_map(values[:cut], step), Wn._repair_map(values[cut:], step))
        for last in range(-60, 90):
            want = Wn._repaired(values, last, step)[-1]
            assert Wn._repair_exit(whole, last) == Wn._repair_exit(joined, last) == want
        assert whole["alone"] == joined["alone"] == Wn._repaired(values, None, step)[-1]


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_names_with_a_long_common_prefix_are_sampled_evenly(spark, n):
    rng = random.Random(3)
    names = {g: sorted(f"{'x' * 40}{rng.randrange(10**9):09d}" for _ in range(size)) for g, size in (("big", 400), ("small", 5), (None, 60))}
    rows = [(g, name) for g, own in names.items() for name in own]
    rng.shuffle(rows)
    want = set()
    for g, own in names.items():
        picks = range(len(own)) if n >= len(own) else [len(own) // 2] if n == 1 else [i * (len(own) - 1) // (n - 1) for i in range(n)]
        want |= {(g, own[i]) for i in picks}
    got = Wn.evenly_spaced(spark.createDataFrame(rows, "g string, name string").repartition(5), ["g"], n, "name").collect()
    assert len(got) == len(want) and {(r.g, r.name) for r in got} == want


@pytest.mark.parametrize("window, step", [(0, 1), (4, 1), (6, 3)])
def test_frames_match_like_a_loop(spark, window, step):
    rng = random.Random(window)

    def frames(n):
        return [(v, i * 2 + rng.randrange(2), None if rng.random() < 0.05 else [rng.randrange(4) for _ in range(6)]) for v in ("a", "b") for i in range(n)]

    ours, theirs = frames(80), frames(80) + [("a", 7, [0, 1, 2, 3, 0, 1]), ("a", 7, [3, 3, 3, 3, 3, 3]), ("b", 9, [1, 1])]
    want = set()
    for v, no, p in ours:
        near = [(sum((x - y) ** 2 for x, y in zip(p, q)) / len(p), m) for w, m, q in theirs if p and q and w == v and len(p) == len(q) and m - no in range(-window, window + 1, step)]
        if near:
            error, match = min(near)
            want.add((v, no, match, round(error, 9)))
    schema = "video string, frame_no int, pixels array<int>"
    got = J.best_frame_match(spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema), ["video"], window, step).collect()
    assert {(r.video, r.target_no, r.match_no, round(r.mse, 9)) for r in got} == want


def test_percentiles_of_crowded_values(spark):
    """Most values in a narrow band, many ties, infinite tails of the range, several groups and both definitions in one run."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 10 == 0, "few").when(F.col("id") % 10 < 9, "many").alias("k"),
        F.when(F.col("id") % 97 == 0, -1e300).when(F.col("id") % 89 == 0, 1e300).when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 501 == 0, F.lit(None)).otherwise(7.0 + (F.col("id") * 7919 % 20011) * 1e-9).alias("v"),
    )
    qs = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    nearest = {f"n{k[1:]}": (q, "nearest") for k, q in qs.items()}
    got = {r.k: r for r in A.exact_quantiles(df, ["k"], "v", {**qs, **nearest}, plain={"most": F.max("v")}).collect()}
    values = {}
    for r in df.where("v IS NOT NULL").collect():
        values.setdefault(r.k, []).append(r.v)
    assert got.keys() == values.keys() == {"few", "many", None}
    for k, own in values.items():
        own.sort()
        for name, q in qs.items():
            at = (len(own) - 1) * q
            lo, hi = own[math.floor(at)], own[math.ceil(at)]
            assert got[k][name] == pytest.approx(lo * (1 - at % 1) + hi * (at % 1), rel=1e-12)
            assert got[k][f"n{name[1:]}"] == own[max(0, math.ceil(round(len(own) * q, 9)) - 1)]
        assert got[k].most == own[-1]


def test_hot_key_percentile(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), (F.col("id") * 7919 % 20011 - 9000).cast("double").alias("v"))
    got = {r.k: r for r in A.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    want = {r.k: r for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.99)).alias("p99")).collect()}
    for k in ("hot", "cold"):
        assert got[k].p50 == pytest.approx(want[k].p50) and got[k].p99 == pytest.approx(want[k].p99)


def scene(seed, frames=120, channels=("a", "b")):
    """Objects that drift, vanish and come back, with quiet stretches."""
    rng = random.Random(seed)
    frame_rows, det_rows = [], []
    for ch in channels:
        objects = [[rng.uniform(0, 400), rng.uniform(0, 300), rng.randrange(3)] for _ in range(4)]
        for f in range(frames):
            pts = f * 40
            frame_rows.append((ch, f, pts, 1_000_000 + pts))
            if 50 <= f < 65 or f % 30 == 29:
                continue
            for o, obj in enumerate(objects):
                obj[0] += rng.uniform(-4, 6)
                obj[1] += rng.uniform(-3, 3)
                if rng.random() < 0.8:
                    c = obj[2] if rng.random() < 0.9 else (obj[2] + 1) % 3
                    x, y = obj[0] + rng.uniform(-2, 2), obj[1]
                    det_rows.append((ch, f, pts, 1_000_000 + pts, o, c, f"c{c}", round(rng.uniform(0.3, 0.9), 3), x, y, x + 80 + rng.uniform(-5, 5), y + 60))
    return frame_rows, det_rows


FRAMES = "channel_id string, frame_id long, pts_ms long, ts_ms long"
DETS = "channel_id string, frame_id long, pts_ms long, ts_ms long, det_ord long, class_id int, label string, score double, x1 double, y1 double, x2 double, y2 double"
CONFIGS = {
    "default": T.TrackerConfig(),
    "all options": T.TrackerConfig(confirm_hits=1, reversal_damping=True, global_motion=True, center_gated_size_filter=True),
    "plain blend": T.TrackerConfig(adaptive_filter=False),
}


def _rows(df):
    return sorted((r.channel_id, r.frame_id, r.kind, r.track_id or 0, r.class_id, round(r.x1 or 0, 6), round(r.y2 or 0, 6), r.n_boxes, r.created, r.lost) for r in df.collect())


@pytest.mark.parametrize("name", CONFIGS)
def test_cut_tracker_equals_one_pass(spark, name):
    """Cutting at quiet stretches changes nothing, track numbers included."""
    frames, dets = scene(9)
    got = T.track(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(dets, DETS).drop("pts_ms", "ts_ms"), CONFIGS[name], block=30)
    want = []
    for ch in ("a", "b"):
        tracker = T.Tracker(CONFIGS[name], 640.0, 480.0)
        for c, f, pts, _ in frames:
            if c == ch:
                seen = [T.Seen(list(d[8:12]), d[5], d[6], d[7]) for d in dets if d[0] == ch and d[1] == f]
                for r in T.rows_of(f, pts, tracker.update(pts, seen)):
                    v = dict(zip(T.COLUMNS, r))
                    want.append((ch, f, v["kind"], v["track_id"] or 0, v["class_id"], round(v["x1"] or 0, 6), round(v["y2"] or 0, 6), v["n_boxes"], v["created"], v["lost"]))
    assert _rows(got) == sorted(want)


def test_shown_boxes_never_coincide(spark):
    frames, dets = scene(10)
    shown = T.shown_boxes(T.track(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(dets, DETS).drop("pts_ms", "ts_ms"), T.TrackerConfig(confirm_hits=1)))
    by_frame = {}
    for r in shown.collect():
        by_frame.setdefault((r.channel_id, r.frame_id), []).append(r)
    assert by_frame
    for group in by_frame.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                assert not M.duplicates((a.x1, a.y1, a.x2, a.y2), a.class_id, (b.x1, b.y1, b.x2, b.y2), b.class_id)


def test_tracker_log_replays_with_fidelity(spark):
    """What the tracker logs, the replays reproduce: the gate of the sweeps."""
    frames, dets = scene(11)
    tracked = T.track(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(dets, DETS).drop("pts_ms", "ts_ms"), T.TrackerConfig(confirm_hits=1))
    motion = T.motion_tracks(tracked)
    size = X.replay_size(motion, [{"size_alpha_max": 0.45}]).first()
    assert size.replay_width_error_p99_px < 1e-6 and size.replay_height_error_p99_px < 1e-6
    center = X.replay_center(motion, [{"weight": 1.0}]).first()
    assert center.baseline_center_error_p99_px < 1e-6


def _parts(spark, df, scratch, n=4):
    """The rows as several files, in order of time, a few rows swapped across file borders."""
    path = str(scratch / "in")
    late = F.col("ts_ms") + F.when(F.xxhash64("frame_id") % 7 == 0, 200).otherwise(0)
    bounds = df.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).first()
    width = (bounds.b - bounds.a) // n + 1
    for i in range(n):
        part = df.where((F.floor((late - bounds.a) / width) == i) if i < n - 1 else (late - bounds.a >= width * i))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_tracker_equals_batch_with_late_rows(spark, scratch):
    frames, dets = scene(12, frames=80)
    f, d = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(dets, DETS)
    end = 1_000_000 + 79 * 40
    closing = [(c, 80 + i, 80 * 40 + i, end + 40 + 60_000 * i) for c in ("a", "b") for i in (0, 1)]
    beats = spark.createDataFrame(frames + closing, FRAMES)
    stream = _parts(spark, d.unionByName(beats, allowMissingColumns=True), scratch)
    out = S.run_available(S.track_stream(stream, T.TrackerConfig(confirm_hits=1), delay="2 seconds"), "test-track")
    batch = T.track(f, d.drop("pts_ms", "ts_ms"), T.TrackerConfig(confirm_hits=1))
    assert _rows(out.where("frame_id < 80")) == _rows(batch)


def test_streamed_reports_equal_batch(spark, scratch):
    rng = random.Random(13)
    rows = [(c, i, 1_000_000 + i * 300, rng.choice("xyz"), rng.random() < 0.1) for c in "ab" for i in range(100)]
    df = spark.createDataFrame(rows, "channel_id string, frame_id long, ts_ms long, summary_key string, has_events boolean")
    batch = Wn.changed_only(Wn.throttle_ticks(df, 1))
    closing = spark.createDataFrame([(c, 999, 2_000_000, "end", False) for c in "ab"], df.schema)
    stream = _parts(spark, df.unionByName(closing), scratch)
    out = S.run_available(S.report_stream(stream, 1, delay="3 seconds"), "test-report")
    assert {(r.channel_id, r.frame_id) for r in out.where("frame_id < 999").collect()} == {(r.channel_id, r.frame_id) for r in batch.collect()}


def test_expired_dwell_starts_anew(spark, scratch):
    rows = [("c", 0, 1, i, ts, 0.0, 0.0, 10.0, 10.0) for i, ts in enumerate((1_000_000, 1_001_000, 1_200_000, 1_201_000, 1_900_000))]
    df = spark.createDataFrame(rows, "channel_id string, region_ord int, class_id int, det_ord long, ts_ms long, x1 double, y1 double, x2 double, y2 double")
    path = str(scratch / "in")
    for i in range(5):
        df.where(F.col("det_ord") == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = S.run_available(S.dwell_stream(stream, 0.0, delay="0 seconds", expire_ms=60_000), "test-dwell")
    assert sorted((r.ts_ms, r.dwell_sec) for r in out.collect()) == [(1_000_000, 0.0), (1_001_000, 1.0), (1_200_000, 0.0), (1_201_000, 1.0), (1_900_000, 0.0)]


def test_pairs_come_once_whatever_the_cell(spark):
    rows = [r for r in boxes(14, 5, 20)]
    df = spark.createDataFrame([("c", *r) for r in rows], f"channel_id string, frame_id long, det_ord long, {BOX}")
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and M.shared(a[5:], b[5:]) > 0)
    from boxweave.operators.spatial import rect_pairs
    from boxweave.functions import geometry as G

    for cell in (16.0, 64.0, 5000.0):
        a, b = G.box("a_"), G.box("b_")
        left, right = J.prefixed(df, "a_", ["frame_id"]), J.prefixed(df, "b_", ["frame_id"])
        pairs = rect_pairs(left, right, ["frame_id"], a.corners, b.corners, cell, extra=(F.col("a_det_ord") < F.col("b_det_ord")) & (G.intersection(a, b) > 0))
        assert sorted((r.frame_id, r.a_det_ord, r.b_det_ord) for r in pairs.collect()) == want
