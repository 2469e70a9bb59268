"""Operator 2, SimHash near-dedup by anchor-point covering.

A fingerprint has a bit set if over half of the XXH64 hashes (seed 42) of the text's 3-word shingles, repeats included, have it.
Fingerprints link at THRESHOLD or fewer differing bits.

Anchors are the words of a covering code on bits 0..60: the direct sum of two perfect Golay codes [23,12] (covering radius 3 each) and the
perfect Hamming code [15,11] (radius 1), 2**35 anchors in all; bits 61..63 are left out of the anchors, not of the comparison. For two
fingerprints at distance 2 or less take a word m within 1 of both: the nearest anchor of m is within the covering radius of m in each
block, so within the covering radius plus one of both. Replicating every fingerprint to the anchors that lie within covering radius plus
half the threshold (the nearest anchors of it and of its one-bit neighbours, about 16) therefore brings each linked pair together at an
anchor: the threshold is shared between the two sides rather than put on one of them, which is exact and five times less to shuffle.

Copies never multiply: rows are first grouped by fingerprint (with partial aggregation), and only distinct fingerprints are replicated and
compared. An anchor holds only distinct fingerprints within a few bits of it; its comparison is a sort-merge join that streams, spills and is
split by AQE if skewed. Where rows get back what is known of their fingerprint, fingerprints that many rows share are salted.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import as_bytes, by_row, join_hot, materialise, project, ship

THRESHOLD = 2
SEED = 42
CODED_BITS = 61
#: Shingles whose bits are counted at once; bounds the memory that a very long text takes.
CHUNK = 65_280


def _votes(digests: bytes) -> tuple[np.ndarray, int]:
    """How many of the big-endian 8-byte hashes have each bit, the highest first, and how many hashes there are."""
    total, n = np.zeros(64, np.int64), len(digests) // 8
    for a in range(0, n, CHUNK):
        bits = np.unpackbits(np.frombuffer(digests[8 * a : 8 * (a + CHUNK)], np.uint8).reshape(-1, 8), axis=1)
        lanes = bits.view(np.uint64)  # eight counters of eight bits each, good for 255 rows
        for b in range(0, len(lanes), 255):
            total += np.add.reduce(lanes[b : b + 255], axis=0).view(np.uint8)
    return total, n


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text."""
    w = text.lower().split()  # of bytes: A-Z only, and exactly the separators 0x20 and 0x09-0x0D
    if not w:
        return 0
    shingles: Iterable[bytes] = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= 3 else [b" ".join(w)]
    total, n = _votes(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))))
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed number."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(x) for x in as_bytes(b.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

        return f

    return by_row(project(docs, id_col, text_col), "doc_id long, fp long", make)


class _Block:
    """A perfect linear code on width bits: nearest words, and those that are nearest to a one-bit neighbour, by syndrome."""

    def __init__(self, width: int, generator: int):
        degree = generator.bit_length() - 1
        column = []
        for i in range(width):
            x = 1 << i
            for k in range(width - 1, degree - 1, -1):
                if x >> k & 1:
                    x ^= generator << (k - degree)
            column.append(x)
        self.width, self.column = width, np.array(column, np.int64)
        leader = {0: 0}
        layer = [(0, 0, 0)]
        while len(leader) < 1 << degree:
            layer = [(s ^ column[i], e | 1 << i, i + 1) for s, e, a in layer for i in range(a, width)]
            for s, e, _ in layer:
                leader.setdefault(s, e)
        self.leader = np.array([leader[s] for s in range(1 << degree)], np.int64)
        near = [sorted({(1 << i) ^ leader[s ^ column[i]] for i in range(width)} - {leader[s]}) for s in range(1 << degree)]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in near])])
        self.near = np.array([e for x in near for e in x], np.int64)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.int64)
        for i, c in enumerate(self.column):
            s ^= np.where(x >> i & 1, c, 0)
        return s


_BLOCKS: list[tuple[int, _Block]] = []


def _blocks() -> list[tuple[int, _Block]]:
    """(first bit, code): built once per worker."""
    if not _BLOCKS:
        golay = _Block(23, 0b110001110101)
        _BLOCKS.extend([(0, golay), (23, golay), (46, _Block(15, 0b10011))])
    return _BLOCKS


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index into fp) of every anchor within covering radius plus one of each int64 fingerprint."""
    home = np.zeros(len(fp), np.int64)
    parts = []
    for at, block in _blocks():
        x = fp >> at & (1 << block.width) - 1
        s = block.syndrome(x)
        parts.append((at, block, x, s))
        home |= (x ^ block.leader[s]) << at
    out, of = [home], [np.arange(len(fp))]
    for at, block, x, s in parts:
        size = block.start[s + 1] - block.start[s]
        row = np.repeat(np.arange(len(fp)), size)
        k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(block.start[s], size)
        out.append(home[row] & ~(((1 << block.width) - 1) << at) | (x[row] ^ block.near[k]) << at)
        of.append(row)
    return np.concatenate(out), np.concatenate(of)


def replicate(fps: DataFrame) -> DataFrame:
    """(anchor, fp) of distinct fingerprints (fp)."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            a, of = anchors(fp)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(fp[of], pa.int64())], ["anchor", "fp"])

        return f

    return by_row(fps.select("fp"), "anchor long, fp long", make)


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints that differ in 1 to threshold bits, each once."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds up to 2")
    at = materialise(replicate(fps), "op2-anchors")  # read by both sides
    pair = at.select("anchor", F.col("fp").alias("a")).join(at.select("anchor", F.col("fp").alias("b")), "anchor")
    return pair.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root) for every vertex of edges (u, v): the smallest vertex of its component.

    Alternates large-star and small-star steps until the edges no longer change; each step is two shuffles of the edges, aggregated before
    them, and is written to the shared folder. Stars of any size are aggregated and joined, never collected; a hub of more than HOT_ROWS edges is salted.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        # e has u > v. Large: every neighbour larger than u goes to the least of u and its neighbours. Small: the smaller ones, and u, do.
        # The hub is then the least vertex for all, so edges (x, least) with x > least remain.
        arcs = e.select(F.col("u").alias("at"), F.col("v").alias("to"))
        if large:
            arcs = arcs.unionByName(e.select(F.col("v").alias("at"), F.col("u").alias("to")))
        least = arcs.groupBy("at").agg(F.min("to").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("least", F.least("at", "least"))
        hung = arcs.join(least, "at") if 2 * n <= common.HOT_ROWS else join_hot(arcs, materialise(least, name), "at", F.col("to"))
        if large:
            out = hung.filter(F.col("to") > F.col("at")).select(F.col("to").alias("u"), F.col("least").alias("v"))
        else:
            out = hung.select(F.col("to").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("at").alias("u"), F.col("least").alias("v")))
        return out.filter("u > v").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), name)
    was = state(e)
    while was[0]:
        e = materialise(star(star(e, True, was[0]), False, 2 * was[0]), name)  # a step has at most an edge per arc
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select(F.col("v"), F.col("v").alias("root")).distinct())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, n_near long, component_id) of every row.

    n_near counts the other rows linked directly, copies included; component_id is the smallest id reachable. Null and empty texts, and
    those of separators only, have fingerprint zero and link like any other; repeated rows count each. A row with a null id is
    fingerprinted and counted like any other, but is never a component_id unless its component has no other id. Other columns are ignored;
    an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = materialise(fingerprints(docs, id_col, text_col), "op2-fingerprints")
    # each distinct fingerprint once: its number of rows and the smallest id, which stands for it as a vertex
    each = materialise(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "op2-distinct")
    pairs = materialise(links(each, threshold), "op2-links")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(each.select(F.col("fp").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("linked"))
    root = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), "op2-edges")
    ids = root.join(each.select(F.col("fp").alias("v"), "first"), "v").groupBy("root").agg(F.min("first").alias("component_id"))
    root = root.join(ids, "root").select(F.col("v").alias("fp"), "component_id")
    linked = near.withColumnRenamed("a", "fp").join(root, "fp")
    about = each.join(linked, "fp", "left").select("fp", "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_near"), F.coalesce("component_id", "first").alias("component_id"))
    # a fingerprint that many rows share, as all empty texts do, is salted
    return join_hot(rows, materialise(about, "op2-about"), "fp", F.col("doc_id")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
