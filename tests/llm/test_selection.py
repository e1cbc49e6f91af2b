"""Filter audit, importance resampling and exact search against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from boxweave.llm import interactions, resample, topk
from boxweave.llm.interactions import audit, counted, filter_interactions
from boxweave.llm.resample import nth_smallest, resampled
from boxweave.llm.topk import top_products
from conftest_llm import prose

ORDERS = ["".join(p) for p in permutations("ABCDE")]


# ---- filter audit


def audited(rows, labels):
    """The audit by applying each order to all rows."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failing = []
    for i, text, part in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        bad = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i,
        }
        failing.append((part or "", {f for f in bad if bad[f]}, labels.get(i, (0, 0))))
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    for order in ORDERS:
        for step, f in enumerate(order, 1):
            before = set(order[: step - 1])
            for part, bad, (good, toxic) in failing:
                x = out[part, order, step]
                x[0] += not bad & (before | {f})
                x[1] += f in bad and not bad & before
                x[2] += f in bad and bool(bad & before)
                x[3] += bad == {f}
                x[4] += f in bad and not bad & before and good == 1
                x[5] += f in bad and not bad & before and toxic == 1
                shapley[part, f] += f in bad and not bad & before
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def audit_rows(seed):
    rng = random.Random(seed)
    texts = [prose(i, rng.choice([0, 5, 99, 100, 101, 300])) for i in range(12)]
    texts += ["A" * 10 + "b" * 90, "A" * 11 + "b" * 89, " ".join(f"w{i}" for i in range(120)), "x " * 150, "cost $5", None, "", "é" * 5 + "A", "tab\tone\x1ctwo\x85three"]
    rows = [(rng.randrange(40), rng.choice(texts), rng.choice(["en", "de", None])) for _ in range(80)]
    return rows + [(None, texts[3], "en"), (None, texts[3], "en"), (-5, texts[4], "de"), (3, "same row", "en"), (3, "same row", "en"), (3, "same row", "de"), (1, "same row", "en")]


LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 40, 3)] + [(3, 1, 0), (None, 1, 1)]


def by_id(labels):
    out = {}
    for i, q, t in labels:
        if i is not None:
            out[i] = (max(q, out.get(i, (0, 0))[0]), max(t, out.get(i, (0, 0))[1]))
    return out


@pytest.mark.parametrize("files", [1, 7])
def test_audit_equals_applying_every_order(spark, scratch, files):
    rows = audit_rows(files)
    random.Random(files).shuffle(rows)
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, name string, mask int").repartition(files).write.parquet(f"{scratch}/docs")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert as_dict(filter_interactions(spark, f"{scratch}/docs", labels)) == audited(rows, by_id(LABELS))


def test_smaller_ids_in_later_files_retract_what_was_counted(spark, scratch):
    """Ids come in descending order, a file each; after every file the counters are those of the rows so far, over restarts as well."""
    texts = [prose(1, 120), prose(2, 20), prose(1, 120)]
    rows, labels = [], spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for i in (30, 21, 9, 9, 3):
        new = [(i, t, ["en", "de", "fr"][(i + j) % 3]) for j, t in enumerate(texts)] + [(i + 1, "once %d" % len(rows), "en")]
        spark.createDataFrame(new, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(f"{scratch}/docs")
        rows += new
        stream = spark.readStream.schema("doc_id long, text string, lang string").option("maxFilesPerTrigger", 1).parquet(f"{scratch}/docs")
        assert as_dict(audit(counted(stream, labels, 5, folder=f"{scratch}/state"))) == audited(rows, by_id(LABELS))


def test_large_ids_beside_null_ones_stay_exact(spark, scratch):
    rows = [(2**60 + i, prose(i % 3, 20), "en") for i in (5, 3, 4, 1, 2)] + [(None, prose(i % 3, 20), "en") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{scratch}/docs")
    stream = spark.readStream.schema("doc_id long, text string, lang string").parquet(f"{scratch}/docs")
    labels = [(2**60 + 1, 1, 0), (2**60 + 2, 0, 1)]
    got = as_dict(audit(counted(stream, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 1)))
    assert got == audited(rows, by_id(labels))


def test_the_state_takes_the_disk_that_it_fills(spark, scratch):
    """No file of the state reserves disk beyond its size; 4 MB each, on 211 partitions nearly a GB."""
    spark.createDataFrame([(i, prose(i, 20), "en") for i in range(20)], "doc_id long, text string, lang string").write.parquet(f"{scratch}/docs")
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    before = set(local.rglob("MANIFEST*"))
    filter_interactions(spark, f"{scratch}/docs", spark.createDataFrame([(6, 1, 1)], "doc_id long, quality int, toxic int")).count()
    written = [f.stat() for f in set(local.rglob("MANIFEST*")) - before]
    assert written and max(f.st_blocks * 512 - f.st_size for f in written) < 2**20


def test_audit_of_nothing(spark, scratch):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{scratch}/docs")
    assert filter_interactions(spark, f"{scratch}/docs", spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_odd_rows_are_audited(spark, scratch, odd):
    odd.write.parquet(f"{scratch}/docs")
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    got = as_dict(filter_interactions(spark, f"{scratch}/docs", spark.createDataFrame([(6, 1, 1)], "doc_id long, quality int, toxic int")))
    assert got == audited(rows, {6: (1, 1)})


def test_mask_of_a_long_text():
    assert interactions.own_mask("a b " * 500_000) == interactions.B


# ---- importance resampling


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def drawn_by_hand(rows, target, n=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features(x, n)), Counter(bucket(f) for x in target for f in features(x, n))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        own = features(x, n)
        weight = sum(gain(bucket(f)) for f in own)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x)) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], 1 << 64 if r[0] is None else r[0]))
    chosen = able[: percent * len(able) // 100]
    plain = lambda r, rank: (r[0], r[1], r[2], r[3], rank)
    rest = list(out)
    for r in chosen:
        rest.remove(r)
    return Counter([*(plain(r, k) for k, r in enumerate(chosen, 1)), *(plain(r, None) for r in rest)])


def sampled(spark, rows, target, **options):
    docs = spark.createDataFrame([(*r, "z", 4) for r in rows], "doc_id long, text string, row string, score int").repartition(5)
    got = resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    return Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())


TARGET = [prose(90, 300), prose(91, 50), None, "ÄÖ x9 Mixed_CASE"]


@pytest.mark.parametrize("options", [{}, {"n": 2, "buckets": 50, "percent": 33}, {"percent": 100, "least": 0}, {"percent": 0}])
def test_draw_equals_sorting_all_rows(spark, options):
    rows = [(i, prose(i, 3 * i % 70)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "Ünï 1a-b\x00c"), (None, prose(7, 40)), (1003, prose(8, 30_000))]
    rows += [(5, prose(1, 60))] * 40 + [(None, prose(7, 40))] * 3
    named = {"n": "words", "least": "least_words"}
    assert sampled(spark, rows, TARGET, **{named.get(k, k): v for k, v in options.items()}) == drawn_by_hand(rows, TARGET, **options)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 7)
    for n in (1, 2, 3):
        found = [b for _, own in resample.feature_buckets(prose(3, 90).encode(), n, resample._Buckets(10**9)) for b in own]
        assert sorted(found) == sorted(crc32(f.encode()) % 10**9 for f in features(prose(3, 90), n))


def test_nth_smallest_is_the_sorted_one(spark):
    rng = random.Random(4)
    values = [rng.choice([-(10**15), -3, 0, 7, 7, 7, 10**12, rng.randrange(-50, 50)]) for _ in range(500)] + [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 2, 100, 250, 501, 502):
        want = sorted(values)[n - 1]
        assert nth_smallest(df, "v", n) == (want, sum(v < want for v in values))


def test_resampling_odd_and_no_rows(spark, odd, none):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = Counter(tuple(r) for r in resampled(odd, target).collect())
    assert got == drawn_by_hand([(r.doc_id, r.text) for r in odd.collect()], TARGET)
    assert resampled(none, target).count() == 0
    assert resampled(odd, none).count() == odd.count()
    with pytest.raises(ValueError):
        resampled(odd.withColumn("doc_id", F.col("doc_id").cast("string")), target)


# ---- exact search


def best_by_hand(rows, k=5, scale=256, every=3):
    ok = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in ok if m != n))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return Counter(out)


def searched(spark, rows, k=5, every=3, **options):
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "vec_id long, embedding array<double>, row string, v int").repartition(4)
    return Counter(tuple(r) for r in top_products(df, F.col("vec_id") % every == 0, k, **options).select("query_id", "rank", "vec_id", "score").collect())


def vectors(seed, n, width):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, 0.2) for c in centre[i % 5]]) for i in range(n)]


@pytest.mark.parametrize("lists, width, k", [(1, 8, 5), (2, 16, 5), (3, 7, 2), (4, 3, 6)])
def test_search_equals_scoring_all_pairs(spark, monkeypatch, lists, width, k):
    monkeypatch.setattr(topk, "BUCKET", 60)
    monkeypatch.setattr(topk, "CHUNK", 40)
    rows = vectors(width, 300, width)
    assert searched(spark, rows, k, lists=lists, head=6) == best_by_hand(rows, k)


def test_search_with_copies_ties_and_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(120)] + [(200 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)]
    rows += [(301, None), (302, [1.0, None, 0.0, 2.0]), (303, [float("nan")] * 4), (304, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0] * 4), (306, []), (307, [0.001, -0.001, 1e-30, 5e3])]
    rows += [(309, [0.5, -0.5]), (309, [0.5, -0.5]), (309, [0.5])]
    assert searched(spark, rows) == best_by_hand([(i, v and v + [0.0] * (4 - len(v)) if v is not None else v) for i, v in rows])


@pytest.mark.parametrize("n", [1, 2, 4])
def test_search_with_fewer_rows_than_wanted(spark, n):
    assert searched(spark, vectors(1, n, 5)) == best_by_hand(vectors(1, n, 5), 5)


def test_scores_beyond_a_double_are_exact(spark):
    rows = [(i, [(1 << 30) / 256 - i, float(i), 3.0 + i * 7919]) for i in range(30)]
    assert searched(spark, rows, lists=2) == best_by_hand(rows, 5)


def test_search_in_nothing(spark):
    assert searched(spark, [(1, [1.0])], every=7) == Counter()
    assert spark.createDataFrame([], "vec_id long, embedding array<float>").transform(lambda d: top_products(d, F.col("vec_id") % 2 == 0)).count() == 0
