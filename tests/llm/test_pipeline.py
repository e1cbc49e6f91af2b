"""The stages on planted cases."""

import random

import corpus_pipeline as pipeline
from boxweave.llm.bpe import decode
from boxweave.llm.pii import sanitised
from conftest_llm import WORDS, odd_texts, prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark, path):
    rng = random.Random(3)
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    base = prose(11, 400).split()
    edited = [*base]
    edited[100] = "other"
    texts = [prose(i, 60) for i in range(20, 60)] + [" ".join(base), " ".join(base), " ".join(edited), prose(12, 50) + " " + item.upper() + "! " + prose(13, 50)]
    texts += ["write to bob.b@example.com or +1 (415) 555-2671 " + prose(14, 60), None, "", "123 456"]
    rows = [(i, t, ["en", "de"][i % 2] if t and i < 40 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(99, 25)), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts


def test_planted_cases_go_and_clean_ones_stay(spark, scratch):
    texts = planted(spark, scratch)
    docs, left = spark.read.parquet(f"{scratch}/documents.parquet"), []
    for n, (name, stage) in enumerate(pipeline.STAGES):
        before = docs.columns
        docs = pipeline.stored(stage(spark, docs, str(scratch)), name)
        assert n == len(pipeline.STAGES) - 1 or docs.columns == before
        left.append({r.doc_id for r in docs.collect()})
    every = set(range(len(texts)))
    assert every - left[0] >= {45, 46, 47} and left[0] >= set(range(40, 45))
    assert left[0] - left[1] == {41, 42}
    assert left[1] - left[2] == {43}
    assert left[2] == left[3] == left[4]
    last = {r.doc_id: r for r in docs.collect()}
    assert last[44].decoded.startswith("write to [EMAIL] or [PHONE] ") and all(decode(r.ids, pipeline.public_tokenizers.path(pipeline.VOCABULARY)) == r.decoded for r in last.values())
    assert all(last[i].decoded == texts[i] for i in left[4] - {44})


def test_personal_data_leaves_other_columns_and_rows(odd, none):
    got = sanitised(odd)
    assert got.columns == odd.columns and sanitised(none).count() == 0
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t in odd_texts())
