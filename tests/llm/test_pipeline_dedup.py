"""The pipeline's near copies are those of SimHash."""

import corpus_pipeline as pipeline
from boxweave.llm.simhash import near_duplicates
from conftest_llm import prose


def test_the_stage_keeps_the_first_of_each_simhash_class(spark, scratch, monkeypatch):
    monkeypatch.setattr(pipeline.simhash.similar, "signed", None)
    texts = [prose(i, 80) for i in range(12)]
    edited = texts[3].split()
    edited[40] = "other"
    texts += [texts[0], texts[0].upper(), " ".join(edited), None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_dedup(spark, docs, str(scratch))
    first = {r.doc_id for r in near_duplicates(docs).collect() if r.doc_id == r.component_id}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == first and not first & {12, 13, 16}
