"""Rows without an id: each operator that works row by row gives them what it gives any other, with a null id; the filters judge them by their text."""

import pytest

import corpus_pipeline
from tessera.llm import decontaminate as D
from tessera.llm import langid as G
from tessera.llm import pieces as P
from tessera.llm import pii as I
from tessera.llm import secret_scan as C
from tessera.llm import toxicity as T

ITEM = "which of these words names a tree that grows by the river alder"
TEXT = f"write to bob@example.org, token = abcdef123, {ITEM}"
ROWS = [(None, TEXT), (7, TEXT), (None, None), (None, ""), (8, "")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM)], "item_id long, text string")


def rows_of(df):
    """Rows by id, without the id."""
    out = {}
    for r in df.collect():
        d = r.asDict(recursive=True)
        out.setdefault(d.pop("doc_id"), []).append(repr(sorted(d.items())))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("run", [
    P.token_counts, P.encode, C.secret_scan, lambda d: I.personal_data(d, {}), lambda d: G.identify(d, (("en", ("which words name a tree",)), ("fr", ("quels mots nomment un arbre",)))).drop("held_out"),
    lambda d: T.score(d, T.Ordinal({"tree": 2.0}, (1.0, 2.0))),
])
def test_rows_without_an_id_get_what_others_get(from_rows, run):
    got = rows_of(run(from_rows(ROWS)))
    assert len(got[None]) == 3 and got[None] == sorted(got[7] + 2 * got[8])


def test_rows_without_an_id_are_not_held_out(from_rows):
    assert not any(r.held_out for r in G.identify(from_rows(ROWS), ()).collect() if r.doc_id is None)


def test_contaminated_rows_without_an_id(from_rows, items):
    assert sorted((r.doc_id or -1, r.item_id) for r in D.contamination(from_rows(ROWS), items).collect()) == [(-1, 1), (7, 1)]


def test_labels_and_samples_leave_rows_without_an_id_out(spark, from_rows):
    docs = from_rows([(None, "vile")] * 30 + [(i, f"w{i} fine") for i in range(40)])
    labels = spark.createDataFrame([(None, 1)] * 30 + [(i, 0) for i in range(40)], "doc_id long, toxic int")
    assert T.learn(docs, labels).weights == {}
    assert G.learn(from_rows([(None, "a text without an id")])) == ()
    assert len(I.sample(from_rows([(None, "call 555 0100"), (3, "call 555 0100")]))) == 2  # an id isn't needed to learn from a text's own patterns


@pytest.mark.parametrize("stage, left", [("toxicity", 5), ("decontamination", 3), ("sentencepiece", 5)])
def test_stages(spark, from_rows, items, tmp_path, stage, left):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = dict(corpus_pipeline.STAGES)[stage](spark, from_rows(ROWS), str(tmp_path)).collect()
    assert len(got) == left and sum(r.doc_id is None for r in got) == (2 if stage == "decontamination" else 3)
