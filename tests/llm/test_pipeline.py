"""Pipeline stages on edge rows and on the small tables."""

from __future__ import annotations

import corpus_pipeline
from abode.session import materialize
from tests.conftest import SF0001
from tests.llm.helpers import components, edge_docs, word_list


def through(spark, docs):
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SF0001), "test-stage"))
    return tables


def test_stages_on_edge_rows(spark):
    docs, good, single, masked, mixed, coded = through(spark, edge_docs(spark, "copies"))
    for t in (good, single, masked, mixed):
        assert t.columns == docs.columns
    assert {6, 7, 8, 14} <= {r.doc_id for r in good.collect()}
    assert {6} == {r.doc_id for r in single.collect()} & {6, 7, 8}
    assert any("[ASSIGN]" in r.text and r.n_chars == len(r.text) for r in masked.collect())
    assert coded.count() == mixed.count() and all(r.lossless for r in coded.collect())
    assert through(spark, docs.limit(0))[-1].count() == 0


def test_stages_on_documents(spark):
    docs, good, single, masked, mixed, _ = through(spark, spark.read.parquet(f"{SF0001}/documents.parquet"))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(components(rows).values()))
    assert masked.count() == single.count()
    sizes = {}
    for r in masked.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(word_list(r.text))
    assert mixed.count() > 0 and {r.source for r in mixed.collect()} <= set(sizes)
