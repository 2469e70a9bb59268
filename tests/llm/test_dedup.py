"""Exact dedup (8), SimHash (2), line dedup (9): brute force and odd tables."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import common
from tessera.llm import exact_dedup as E
from tessera.llm import line_dedup as L
from tessera.llm import simhash as S

LOWER = {i: i + 32 for i in range(65, 91)}


def copies(sample):
    texts = [t for _, t in sample[:60]]
    return texts + [texts[0].upper() if texts[0].isascii() else texts[0], texts[1], texts[1], texts[2] + " more", texts[3]] * 3


def check_exact(docs_rows, got):
    groups = defaultdict(list)
    for i, t in docs_rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(k.encode()).hexdigest()) for k, ids in groups.items() for i in ids}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    assert len(got) == len(docs_rows)


def test_exact(make, odd, sample):
    texts = [t for t in odd if t is None or "\ud800" > t[:1]] + copies(sample)
    got = E.exact_dedup(make(texts)).collect()
    check_exact(list(enumerate(texts)), got)


def test_exact_under_colliding_digests(make, odd, sample):
    texts = copies(sample)
    got = E.exact_dedup(make(texts), digest=lambda x: hashlib.sha256(x[:1]).digest()).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.translate(LOWER)].append(i)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_odd_tables(from_rows, make):
    assert E.exact_dedup(make(["a"]).limit(0)).collect() == []
    got = E.exact_dedup(from_rows([(None, "a"), (None, "a"), (1, "a"), (2, "A"), (2, "A")])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 1, True), (-1, -1, 1, True), (1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True)]


@pytest.fixture
def nothing_is_small(monkeypatch):
    """Every join is shuffled, and keys of more than three rows are salted."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(E, "COPIES_PER_SALT", 4)


def test_shuffled_joins_give_the_same(nothing_is_small, make, odd, sample, from_rows):
    texts = [t for t in odd if t is None or "\x00" not in t] + copies(sample) + ["shared line of many\nown"] * 20 + [None] * 9
    docs, rows = make(texts), list(enumerate(texts))
    check_exact(rows, E.exact_dedup(docs).collect())
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in L.line_dedup(docs).collect()}
    assert got == slow_lines(rows)
    fps = {i: S.fingerprint((t or "").encode()) for i, t in rows}
    assert {r.doc_id: (r.n_near, r.component_id) for r in S.near_dedup(docs).collect()} == slow_near(fps)
    repeated = from_rows([(1, "same text of all")] * 30 + [(2, "Same text of all"), (3, "else"), (None, "else")])
    assert {(r.doc_id, r.keep_id, r.group_size) for r in E.exact_dedup(repeated).collect()} == {(1, 2, 31), (2, 2, 31), (3, 3, 1), (None, None, 1)}


def test_join_hot_is_a_join(nothing_is_small, spark):
    rows = spark.createDataFrame([(i, k) for k, n in enumerate((1, 3, 4, 50)) for i in range(n)], "i long, k long")
    about = common.materialise(rows.groupBy("k").agg({"i": "count"}).withColumnRenamed("count(i)", "n").filter("k > 0"), "about")
    got = common.join_hot(rows, about, "k", rows.i).select("i", "k", "n").collect()
    assert sorted(map(tuple, got)) == sorted((r.i, r.k, (1, 3, 4, 50)[r.k]) for r in rows.collect() if r.k)


def test_bytes_decide_what_is_small(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2], bytearray(500))] * 10 + [(None, None, None)], "t string, a array<int>, b binary")
    assert not common.small(df, 15_000) and common.small(df, 17_000) and common.small(df.limit(0), 0)


def test_snapshot_serves_several_batches(make, sample):
    docs = make([t for _, t in sample])
    old = E.snapshot_of(docs)
    for batch in ([t for _, t in sample[:20]] + ["new one", "new one"], ["NEW two", "new two"]):
        rows = common.materialise(E.digests(common.project(make(batch, 10_000))), "batch")
        got = {bytes(r.digest): (r.last, r.n) for r in E.groups(rows, old).collect()}
        want = defaultdict(list)
        for i, t in [*((i, t) for i, t in enumerate(t for _, t in sample)), *((10_000 + i, t) for i, t in enumerate(batch))]:
            want[hashlib.sha256(t.translate(LOWER).encode()).digest()].append(i)
        assert got == {k: (max(v), len(v)) for k, v in want.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 40_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    f = E.BinaryFuse.load(E.BinaryFuse.build(np.concatenate([keys, keys])).dump())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.01


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_near(fps):
    ids = sorted(fps)
    link = {i: [j for j in ids if j != i and (fps[i] ^ fps[j]).bit_count() <= 2] for i in ids}
    root = {}
    for i in ids:
        todo, seen = [i], {i}
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(seen)
    return {i: (len(link[i]), root[i]) for i in ids}


def test_simhash(make, odd, sample):
    texts = odd + [t for _, t in sample] + [sample[0][1] + " tail", sample[1][1].upper(), "one two", "two one"]
    got = S.near_dedup(make(texts)).collect()
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {r.doc_id: (r.n_near, r.component_id) for r in got} == slow_near(fps)
    assert len(got) == len(texts)


def test_fingerprint_of_a_text_of_several_chunks():
    rng = np.random.default_rng(8)
    text = " ".join(f"w{x}" for x in rng.integers(0, 5_000, 70_000))
    assert text.count(" ") > S.CHUNK and S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_chains_of_links(spark):
    """Links of planted fingerprints: chains, bursts and far ones, against all pairs."""
    rng = np.random.default_rng(1)
    fps = set()
    for c in rng.integers(0, 2**63, 12).tolist():
        x = c
        for _ in range(40):
            fps.add(x)
            for _ in range(int(rng.integers(1, 4))):
                x ^= 1 << int(rng.integers(64))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r.a, r.b) for r in S.links(df).collect()}
    u = lambda x: x & (1 << 64) - 1
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if (u(a) ^ u(b)).bit_count() <= 2}
    assert got == want and len(want) > 50
    comp = {r.v: r.root for r in S.components(spark.createDataFrame(sorted(want), "u long, v long")).collect()}
    parent = {v: v for e in want for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in want:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert comp == {v: find(v) for v in parent}


def test_simhash_odd_tables(from_rows, make):
    assert S.near_dedup(make(["a"]).limit(0)).collect() == []
    got = S.near_dedup(from_rows([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None), (8, " ")])).collect()
    assert sorted((r.doc_id or -1, r.n_near, r.component_id) for r in got) == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 1, 7), (8, 1, 7)]


def slow_lines(rows):
    key = lambda x: x.encode().strip().lower().decode()
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (len(held.get(key(x), ())) >= 2 and min(held[key(x)]) != i)]
        out[i] = (len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def test_lines(make, odd, sample):
    shared = "A line that many documents SHARE"
    texts = odd + [t for _, t in sample] + [f"own line number {i}\n  {shared.lower()}\t\nend\n{shared}" for i in range(200)] + ["ÄÄÄÄÄÄÄÄÄÄ\nx", "ÄÄÄÄÄÄÄÄÄÄ", "ääääääääää", "123456789\n123456789", "123456789"]
    rows = list(enumerate(texts))
    got = L.line_dedup(make(texts), with_text=True).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == slow_lines(rows)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_dropped for r in got) >= 2 * 199


def test_line_bitmaps(make):
    maps = {r.doc_id: r for r in L.bitmaps(make(["shared line here\nkeep me as I am", "other\nshared line here\nanother line", "x"])).collect()}
    assert set(maps) == {1} and L.unpack(maps[1].keep, 2).tolist() == [True, False] and maps[1].n_dropped == 1


def test_lines_odd_tables(from_rows, make):
    assert L.line_dedup(make(["a"]).limit(0)).collect() == []
    got = L.line_dedup(from_rows([(None, "a shared line"), (1, "a shared line\na shared line"), (2, "A SHARED LINE"), (2, "A SHARED LINE"), (3, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped) for r in got) == [(-1, 1, 0), (1, 2, 0), (2, 1, 1), (2, 1, 1), (3, 1, 0)]
