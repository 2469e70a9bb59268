"""What the personal data model is trained on (op10_personal_data)."""

import random

from tessera.llm import pii as P

LOG = "x".join(f" took {k} ms {'.' * 120}" for k in range(3_000))
RARE = [f"{'.' * 200} mail bob{k}@mail.example.com or {'.' * 200}" for k in range(40)]


def test_every_window_with_a_span_is_kept():
    data = P.training_data([LOG, *RARE], random.Random(7))
    gold = [g for w, g in data if g and "@mail.example.com" in w.text]
    assert len(P.windows(LOG)) == 3_000 and len([1 for w, _ in data if w.text is LOG]) == P.EMPTY_WINDOWS
    assert len([1 for w, _ in data if w.text in RARE]) == len(RARE) and len(gold) >= len(RARE)
    assert len([1 for w, _ in P.training_data([LOG], random.Random(7), empty=50)]) == 50


def test_every_span_of_a_window_has_altered_copies():
    text = " ".join(f"bob{k}@mail.example.com" for k in range(9))
    assert len(P.windows(text)) == 1 and len(P.training_data([text], random.Random(7))) == 1 + 9 * P.COPIES
    assert len(P.training_data([text], random.Random(7), copies=1)) == 1 + 9


def test_rare_type_is_learned_beside_a_long_log():
    f = P.Field(P.train([LOG, *RARE], epochs=2))
    assert ("email", "eve [at] example [dot] com") in [(k, "eve [at] example [dot] com"[a:b]) for k, a, b in P.model_spans("eve [at] example [dot] com", [], f)]


def test_sample_is_the_texts_of_the_least_hashes(spark, make):
    docs = make([f"call {k}000 now" for k in range(300)] + ["no digits"] * 50 + ["x" * (P.SAMPLE_CHARS + 1) + " 123"])
    got = P.sample(docs, texts=10)
    want = [r.text for r in docs.filter("text RLIKE '[0-9]{3}' AND length(text) < 100").selectExpr("text", "xxhash64(doc_id) AS h").orderBy("h").limit(10).collect()]
    assert got == want
    everything = P.sample(docs, texts=1_000)
    assert len(everything) == 301 and len(everything[-1]) > P.SAMPLE_CHARS
