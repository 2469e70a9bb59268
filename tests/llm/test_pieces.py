import random
import string

import numpy as np
import pytest

from tessera.llm import pieces as P

FLOOR = -40_000.0  # of the marker scores, for the unigram rule: the library's float32 sums are exact only above about -2**24


@pytest.fixture(scope="module")
def library():
    """The sentencepiece library on the file as it is."""
    import sentencepiece as sp

    return sp.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def unigram():
    """The library on the same pieces as a unigram file, and our vocabulary of it."""
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(P.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, FLOOR)
    lib = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    kind = lambda i: "byte" if lib.is_byte(i) else "unknown" if lib.is_unknown(i) else "control" if lib.is_control(i) else "normal"
    return lib, P.Vocabulary((lib.id_to_piece(i), lib.get_score(i), kind(i)) for i in range(lib.get_piece_size()))


def ids_of(v, text):
    u = P.split_marked(text)
    e = P.encode_words(v, set(u))
    return [int(i) for w in u for i in np.frombuffer(e[w], "<i4")]


PLANTED = ["", " ", "  ", "a  b", " lead", "trail ", "x   y", "Hello, wörld", "aaaaaaaaaaaaaaaa", "import os; os.system('ls')", "\n\n a\n", "漢字  x\n" * 9, " " * 500 + "the" + " " * 33, "x" * 5000]


def test_equals_the_tokenizer_on_whole_documents(library, sample):
    v = P.Vocabulary.load(P.MODEL)
    rng = random.Random(1)
    noise = ["".join(rng.choices(string.ascii_letters + string.digits + "  .,#%&é漢=-\n", k=400)) for _ in range(100)] + ["".join(rng.choices("abt he", k=60)) for _ in range(200)]
    texts = [t for _, t in sample] + PLANTED + noise
    assert v.merges and max(map(len, texts)) > 5_000
    for t in texts:
        u = P.split_marked(t)
        assert u == P.units(t)
        got = ids_of(v, t)
        assert got == library.encode(t), t[:80]
        count = P.count_words(v, set(u))
        assert sum(count[w] for w in u) == len(got)


def test_compatible_by_merging():
    v = P.Vocabulary.load(P.MODEL)
    rng = random.Random(2)
    first = [p for p in v.score if not p.startswith(P.MARK * 2)]
    second = [p for p in first if P.MARK not in p]
    for a, b in zip(rng.choices(first, k=4000), rng.choices(second, k=4000)):
        assert v.compatible(0, a, b) == (v.merged(a + b) == [a, b]), (a, b)


def test_unigram_rule_equals_the_library(unigram, sample):
    lib, v = unigram
    texts = [line for _, t in sample for line in t.split("\n") if len(line) < 1500] + PLANTED[:10]
    assert len(texts) > 300 and not v.merges
    for t in texts:
        assert ids_of(v, t) == lib.encode(t), t


def test_count_is_length_of_encoding(sample):
    v = P.Vocabulary.load(P.MODEL)
    for _, t in sample[:60]:
        for w in set(P.split_marked(t)):
            assert P.count_words(v, {w})[w] == len(np.frombuffer(P.encode_words(v, {w})[w], "<i4"))


def test_best_by_brute_force():
    """All segmentations of short words, with the tie rule: of equal scores the longest last piece, then so on backwards."""
    v = P.Vocabulary([("<0x%02X>" % i, 0.0, "byte") for i in range(256)] + [("▁", -5.0, "normal"), ("a", -1.0, "normal"), ("b", -1.0, "normal"), ("ab", -2.0, "normal"), ("ba", -1.5, "normal"), ("aab", -3.0, "normal")])
    pieces = set(v.score)

    def every(w):
        if not w:
            return [[]]
        out = []
        for k in range(1, len(w) + 1):
            if w[-k:] in pieces:
                out += [x + [w[-k:]] for x in every(w[:-k])]
            elif k == 1:
                out += [x + [None] for x in every(w[:-1])]
        return out

    for w in ("a", "ab", "aab", "abab", "baab", "aabba", "▁abé", "é"):
        best = max(every(w), key=lambda s: (sum(v.score[p] if p else v.unk for p in s), [len(p or "x") for p in reversed(s)]))
        want = [i for p in _spell(best, w) for i in ([v.ids[p]] if p in pieces else [v.byte_id[b] for b in p.encode()])]
        assert np.frombuffer(P.encode_words(v, {w})[w], "<i4").tolist() == want, w
        assert P.count_words(v, {w})[w] == len(want)


def _spell(seg, w):
    out, at = [], 0
    for p in seg:
        k = len(p) if p else 1
        out.append(w[at : at + k])
        at += k
    return out


def test_prefix_sharing_changes_nothing(sample):
    v = P.Vocabulary.load(P.MODEL)
    words = {w for _, t in sample[:40] for w in P.split_marked(t)}
    together = P.encode_words(v, words)
    assert all(together[w] == P.encode_words(v, {w})[w] for w in words)


def test_table(make, odd, sample):
    docs = make(odd + [t for _, t in sample[:50]])
    counts = {r.doc_id: r for r in P.token_counts(docs).collect()}
    rows = {r.doc_id: r for r in P.encode(docs).collect()}
    assert len(rows) == len(counts) == len(odd) + 50
    assert counts[0].n_tokens == counts[1].n_tokens == 0 and rows[0].ids == []
    for i, t in enumerate(odd):
        assert rows[i].n_tokens == counts[i].n_tokens == len(rows[i].ids)
        assert rows[i].round_trip
    back = {r.doc_id: r.text for r in P.decode(P.encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(odd))


def test_mark_in_text_is_a_space(make):
    assert not P.encode(make(["a▁b"])).first().round_trip


def test_empty_table(make):
    assert P.token_counts(make(["x"]).limit(0)).collect() == [] and P.encode(make(["x"]).limit(0)).collect() == []
