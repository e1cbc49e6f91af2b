import numpy as np
import pytest
from pyspark.sql import functions as F

from boxweave.llm import language, quality
from conftest_llm import odd_texts, prose

SF = "/root/testdata/sf0.01"


def numeric(f, weights, which, at, eps):
    old = weights[which].flat[at]
    weights[which].flat[at] = old + eps
    up = f()
    weights[which].flat[at] = old - eps
    down = f()
    weights[which].flat[at] = old
    return (up - down) / (2 * eps)


def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(0)
    net = language.ByteNet.fresh(["a", "b", "c"], rng)
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = rng.integers(1, 255, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    for which, g in enumerate(net.gradients(x, y)):
        for at in np.argsort(-np.abs(g).ravel())[:5]:
            assert g.flat[at] == pytest.approx(numeric(loss, net.weights(), which, at, 1e-6), rel=1e-3, abs=1e-7)


def test_gradients_of_the_attention():
    rng = np.random.default_rng(1)
    bags = [rng.random((n, quality._measures())) for n in (1, 4, 2)]
    x, first, y = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    net = quality.AttentionNet.fresh(x, rng)

    def loss():
        p = net.forward(x, first)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for which, g in enumerate(net.gradients(x, first, y, decay=0.0)):
        for at in np.argsort(-np.abs(g).ravel())[:5]:
            assert g.flat[at] == pytest.approx(numeric(loss, net.weights(), which, at, 1e-6), rel=1e-4, abs=1e-8)


def test_attention_finds_the_passage_that_counts():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, 300)
    bags = []
    for label in labels:
        bag = rng.normal(0, 1, (6, quality._measures())).astype(np.float32)
        bag[:, 0] = 0
        if label == 0:
            bag[rng.integers(6), 0] = 6
        bags.append(bag)
    net = quality.train(bags[:200], labels[:200].tolist())
    first = np.arange(100) * 6
    score, _, weight, *_ = net.forward(np.concatenate(bags[200:]).astype(np.float64), first)
    assert ((score >= 0.5) == labels[200:]).mean() > 0.95
    bad = [i for i in range(100) if labels[200 + i] == 0]
    assert np.mean([weight[6 * i : 6 * i + 6].argmax() == bags[200 + i][:, 0].argmax() for i in bad]) > 0.8


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    net = language.learned(docs, ~held)
    rows = language.languages(docs.where(held), net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    net = quality.learned(docs, labels.where(~held))
    rows = quality.quality_scores(docs, net).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95 and all((r.score >= 0.7) == r.predicted for r in rows)


def test_odd_rows_and_none(spark, odd, none):
    net = language.learned(odd, F.lit(True))
    rows = language.languages(odd, net).collect()
    assert sorted((str(r.doc_id), r.lang_pred == "und") for r in rows) == sorted((str(i), not any(c.isalpha() for c in t or "")) for i, t in odd_texts())
    assert language.in_a_language(odd, net).columns == odd.columns
    assert language.languages(none, language.learned(none, F.lit(True))).count() == 0
    labels = spark.createDataFrame([(1, 1), (5, 1), (9, 0), (9, 0), (2, None), (None, 1), (77, 0)], "doc_id long, quality int")
    scorer = quality.learned(odd, labels)
    assert sorted(str(r.doc_id) for r in quality.quality_scores(odd, scorer).collect()) == sorted(str(i) for i, _ in odd_texts())
    assert quality.quality_scores(none, quality.learned(none, labels)).count() == 0


def test_windows_and_passages_cover_the_whole_text():
    text = prose(1, 5000)
    assert language.cut(text).tobytes().rstrip(b"\0") == text.encode()
    assert len(quality.measured(text)) == -(-5000 // quality.PASSAGE) and len(quality.measured(None)) == 1
