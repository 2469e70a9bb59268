"""Benchmark rows with a null item_id (op4_decontamination, pipeline)."""

import corpus_pipeline
from tessera.llm import decontaminate as D

ITEM = "which of these words names a tree that grows by the river alder"


def test_items_without_an_id_are_searched(spark, make, tmp_path):
    docs = make(["nothing of it", f"so {ITEM} and more", "the second question asks for something else entirely"])
    items = spark.createDataFrame([(None, ITEM), (None, "not in any of the texts at all here"), (3, "the second question asks for something else entirely")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contamination(docs, items).collect()} == {(1, None), (2, 3)}
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [0]
