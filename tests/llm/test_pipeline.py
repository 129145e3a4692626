"""The five stages, each against a plain version of its rule on its own input."""

from __future__ import annotations

import corpus_pipeline
from seriesloom.llm import hyperlang, quality, token_efficiency
from seriesloom.llm.queries import WORD_BPE

from . import odd
from .test_group_join import brute
from .test_packing import check_pieces


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = odd.documents(spark)
    labels = spark.read.parquet(f"{odd.SF}/labels.parquet")
    columns = docs.columns

    good = stages["quality_classifier"](spark, docs, odd.SF).cache()
    scores = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {k for k, s in scores.items() if s >= 0.5} and good.columns == columns

    known = stages["language_id"](spark, good, odd.SF).cache()
    told = {r.doc_id: r for r in hyperlang.predict_languages(good).collect()}
    assert {r.doc_id for r in known.collect()} == {k for k, r in told.items() if r.lang_pred != "und" and r.score >= hyperlang.LEAST_LIKENESS}

    single = stages["jaccard_join"](spark, known, odd.SF).cache()
    classes = brute([(r.doc_id, r.text) for r in known.collect()])
    assert {r.doc_id for r in single.collect()} == {int(c) for _, _, c in classes} and single.columns == columns

    clean = stages["secret_scan"](spark, single, odd.SF).cache()
    before = {r.doc_id: r for r in single.collect()}
    for r in clean.collect():
        spans = token_efficiency.find_spans(before[r.doc_id].text or "", "byte_bpe_50k.tiktoken")
        assert spans or r == before[r.doc_id]
        assert r.n_chars == len(r.text)
    assert clean.count() == len(before) and clean.columns == columns and clean.schema == single.schema

    from seriesloom.llm import packing

    assert stages["packing"](spark, clean, odd.SF).count() > 0
    check_pieces(packing.pack_documents(clean, WORD_BPE).collect(), [(r.doc_id, r.text) for r in clean.collect()], 2048)


def test_run_and_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    odd.frame(spark).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{odd.SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    assert set(corpus_pipeline.run(spark, folder).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    corpus_pipeline.run(spark, folder).count()
