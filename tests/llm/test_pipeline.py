"""The pipeline against a brute-force version, and its stages on odd tables."""

import re
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as C
from tessera.llm import decontaminate as D
from tessera.llm import pieces as P
from tessera.llm import toxicity as T
from tessera.llm.common import table

from .test_dedup import LOWER, slow_fingerprint, slow_near
from .test_models import slow_parts, slow_search

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The driver's smallest tables with copies, near copies, benchmark items and toxic texts added."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    top = max(d["doc_id"] for d in docs) + 1
    text = lambda k: docs[k]["text"]
    extra = [text(0), text(0).upper() if text(0).isascii() else text(0), text(1), text(2) + "\n", "x y z. " * 30 + items[0]["text"] + " more words here", None, None, "", "A b"]
    docs += [{"doc_id": top + i, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for i, t in enumerate(extra)]
    bad = [f"w{i} vileword w{i + 1} w{i + 2} awfulword" for i in range(80)]
    docs += [{"doc_id": top + 100 + i, "text": t, "lang": "en", "source": "s", "n_chars": len(t)} for i, t in enumerate(bad)]
    labels = [{"doc_id": d["doc_id"], "quality": 1, "toxic": int(d["doc_id"] >= top + 100)} for d in docs if d["doc_id"] % 2 == 0]
    out = str(tmp_path_factory.mktemp("sf"))
    for name, rows, ddl in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame([tuple(r.values()) for r in rows], ddl).repartition(3).write.parquet(f"{out}/{name}.parquet")
    return out, top


def test_equals_brute_force(spark, planted):
    sf, top = planted
    model = T.learn(table(spark, sf, "documents"), table(spark, sf, "labels"))
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    # the severity by its formula, benchmark items by every passage and item, pieces by the tokenizer's library
    latent = lambda t: sum(model.weights.get(p, 0.0) for w in set(re.findall(r"[^\W_]+", (t or "").lower())) for p in slow_parts(w))
    ids = [i for i, t in docs.items() if 1 / (1 + np.exp(-(latent(t) - model.thresholds[0]))) < model.cut]
    assert not [i for i in ids if i >= top + 100] and len(ids) > 150
    groups = defaultdict(list)
    for i in ids:
        groups[(docs[i] or "").translate(LOWER)].append(i)
    ids = sorted(max(g) for g in groups.values())
    root = slow_near({i: slow_fingerprint(docs[i]) for i in ids})
    ids = [i for i in ids if root[i][1] == i]
    items = next(D.items_of(table(spark, sf, "benchmark")))
    ids = [i for i in ids if not slow_search(items, docs[i] or "")]
    assert top + 4 not in ids
    lib = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    want = {i: lib.encode(docs[i] or "") for i in ids}
    got = C.run(spark, sf).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("stage", [s for s, _ in C.STAGES])
def test_stage_on_odd_tables(spark, planted, make, odd, stage):
    sf, _ = planted
    f = dict(C.STAGES)[stage]
    docs = make(odd)
    got = f(spark, docs, sf)
    if stage != C.STAGES[-1][0]:
        assert got.columns == docs.columns
        kept = {r.doc_id for r in got.select("doc_id").collect()}
        assert 12 in kept and 6 in kept
        if stage == "exact_dedup":
            assert 0 not in kept and 1 in kept and {4, 5} & kept == {5} and {8, 9} & kept == {9}
        else:
            assert f(spark, docs.limit(0), sf).count() == 0
    else:
        assert got.count() == len(odd)
    assert f(spark, docs.limit(0), sf).columns == got.columns


def test_stages_are_in_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]


def test_rows_without_an_id_stay(spark, planted, from_rows):
    docs = from_rows([(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (2, "a b c d")])
    assert sorted(r.doc_id or -1 for r in C.drop_copies(spark, docs, planted[0]).collect()) == [-1, -1, 2]
    assert sorted(r.doc_id or -1 for r in C.drop_near_copies(spark, docs, planted[0]).collect()) == [-1, -1, 1]
