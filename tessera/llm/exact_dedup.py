"""Operator 8, exact dedup: static binary-fuse filters per immutable snapshot screen incoming digests.

Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays.

 1. One pass over the text writes (doc_id, digest, incoming): SHA-256 of the normalised text. Nothing else carries text.
 2. A snapshot is immutable and written once: one row per digest (its exact bucket: largest id, number of rows), and per shard of
    digests a binary-fuse filter. Shards are ranges of the digest, as many as keep each at SHARD_KEYS, so a filter's build is bounded.
    A table without a snapshot is its own: the older half of its ids.
 3. The incoming rows are grouped among themselves first (partial aggregation before the shuffle, so a hot text costs one row per task).
 4. Each incoming digest is screened by its shard's filter; negatives are new for certain, positives join the exact bucket. There are as many positives as
    digests of both sides, and a few false ones, so the snapshot's buckets aren't shuffled while these are small.
 5. Texts of groups of two or more are fetched again and compared byte for byte with the text of the row that stays. Narrow rows find their group and get a
    salt first, hot groups salted in that join too; a text moves only with its salt, so that the copies of one text are spread over tasks.
    Should texts differ under one digest, such groups are formed anew by the text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_row, join_hot, keep_ids, materialise, project, ship, small

#: Keys of a filter's shard.
SHARD_KEYS = 65_536
#: Copies of one text that one task compares with the text that stays.
COPIES_PER_SALT = 2_048

Digest = Callable[[bytes], bytes]


def sha256(x: bytes) -> bytes:
    return hashlib.sha256(x).digest()


class BinaryFuse:
    """Static 3-wise binary-fuse filter of 8-bit fingerprints over distinct 64-bit keys; no false negatives, 0.4 % false positives."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            return h ^ (h >> np.uint64(33))

    @staticmethod
    def _places(h: np.ndarray, segment: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Three places in consecutive segments, of which the first is one of count."""
        first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
        m = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & m)
        third = (first + np.uint64(2 * segment)) ^ (h & m)
        return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        """keys: uint64; repeated keys count once."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        segment = min(segment, 1 << 18)
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        count = max(1, -(-int(n * factor) // segment) - 2 + 1)
        for seed in range(1, 200):
            size = (count + 2) * segment
            h = cls._mix(keys, seed)
            places = cls._places(h, segment, count)
            order = cls._peel(places, size)
            if order is not None:
                table = np.zeros(size, np.uint8)
                p = np.stack(places, 1)
                prints = cls._print(h)
                for k, at in reversed(order):
                    a, b, c = p[k]
                    table[at] = prints[k] ^ table[a] ^ table[b] ^ table[c]
                return cls(seed, segment, count, table)
            if seed % 10 == 0:
                count += 1 + count // 20
        raise RuntimeError("no binary-fuse filter could be built")

    @staticmethod
    def _peel(places: tuple[np.ndarray, ...], size: int) -> list[tuple[int, int]] | None:
        """Keys in the order in which each was alone at a place, with that place; None if some never are."""
        n = len(places[0])
        degree = np.zeros(size, np.int64)
        acc = np.zeros(size, np.int64)
        for p in places:
            np.add.at(degree, p, 1)
            np.bitwise_xor.at(acc, p, np.arange(n))
        todo = np.flatnonzero(degree == 1).tolist()
        deg, who, at = degree.tolist(), acc.tolist(), [p.tolist() for p in places]
        order: list[tuple[int, int]] = []
        while todo:
            x = todo.pop()
            if deg[x] != 1:
                continue
            k = who[x]
            order.append((k, x))
            for p in at:
                y = p[k]
                deg[y] -= 1
                who[y] ^= k
                if deg[y] == 1:
                    todo.append(y)
        return order if len(order) == n else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = self._mix(keys.astype(np.uint64), self.seed)
        a, b, c = self._places(h, self.segment, self.count)
        t = self.table
        return self._print(h) == t[a] ^ t[b] ^ t[c]

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], "<i8").tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> "BinaryFuse":
        return cls(*(int(x) for x in np.frombuffer(raw[:24], "<i8")), np.frombuffer(raw[24:], np.uint8))


def _keys(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(x[:8] for x in digests.to_pylist()), "<u8")


def digests(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """(doc_id, digest) of the normalised texts."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(x.lower()) for x in as_bytes(b.column(1))], pa.binary())], ["doc_id", "digest"])

        return f

    return by_row(docs, "doc_id long, digest binary", make)


def build_filters(snapshot: DataFrame) -> DataFrame:
    """(shard, filter) of a snapshot's rows (shard, digest)."""

    def build(t: pa.Table) -> pa.Table:
        f = BinaryFuse.build(_keys(t.column("digest").combine_chunks()))
        return pa.table({"shard": pa.array(t.column("shard")[:1].to_pylist(), pa.int32()), "filter": pa.array([f.dump()], pa.binary())})

    return snapshot.groupBy("shard").applyInArrow(build, "shard int, filter binary")


@dataclass(frozen=True)
class Snapshot:
    """Written tables: buckets (digest, last, n) and, of shards of their digests, filters (shard, filter)."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def _per_digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int):
    return (F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long") % F.lit(shards)).cast("int")


def snapshot(rows: DataFrame) -> Snapshot:
    """Of rows (doc_id, digest), to be used for any number of incoming batches; rows without an id aren't part of it."""
    buckets = materialise(_per_digest(rows.filter(F.col("doc_id").isNotNull())), "op8-buckets")
    shards = max(1, -(-buckets.count() // SHARD_KEYS))
    return Snapshot(buckets, materialise(build_filters(buckets.select(_shard(shards).alias("shard"), "digest")), "op8-filters"), shards)


def snapshot_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> Snapshot:
    """snapshot() of a table of texts."""
    ship(docs.sparkSession)
    return snapshot(digests(project(docs, id_col, text_col), digest))


def screen(rows: DataFrame, old: Snapshot) -> DataFrame:
    """(digest, last, n, maybe) of the digests of incoming rows (doc_id, digest), written; maybe: whether the snapshot's filter holds the digest."""

    def probe(rows: pa.Table, f: pa.Table) -> pa.Table:
        rows = rows.select(["digest", "last", "n"])
        hit = BinaryFuse.load(f.column("filter")[0].as_py()).contains(_keys(rows.column("digest").combine_chunks())) if f.num_rows and rows.num_rows else np.zeros(rows.num_rows, bool)
        return rows.append_column("maybe", pa.array(hit, pa.bool_()))

    by_shard = _per_digest(rows).withColumn("shard", _shard(old.shards)).groupBy("shard")
    return materialise(by_shard.cogroup(old.filters.groupBy("shard")).applyInArrow(probe, "digest binary, last long, n long, maybe boolean"), "op8-screened")


def groups(rows: DataFrame, old: Snapshot) -> DataFrame:
    """(digest, last, n) of all digests of the snapshot and of incoming rows (doc_id, digest)."""
    new = screen(rows, old)
    met = materialise(new.filter("maybe").select("digest", F.col("last").alias("last2"), F.col("n").alias("n2")), "op8-met")
    if small(met):  # the buckets stay where they are
        both = old.buckets.join(F.broadcast(met), "digest", "left").unionByName(met.join(old.buckets.select("digest"), "digest", "left_anti"), allowMissingColumns=True)
    else:
        both = old.buckets.join(met, "digest", "full_outer")
    both = both.select("digest", F.greatest("last", "last2").alias("last"), (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).cast("long").alias("n"))
    return both.unionByName(new.filter(~F.col("maybe")).select("digest", "last", "n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size long, kept boolean, text_sha256) of every row, dropped ones too.

    Null texts count as empty, and all empty texts are one group. A row that repeats another's id and text belongs to its group (both are
    kept if that id stays). Rows with a null id can't be told apart: each stays, as a group of its own with a null keep_id. Other columns
    are ignored; an empty table gives an empty one.
    """
    src = project(docs, id_col, text_col)
    ship(docs.sparkSession)
    bounds = src.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if bounds[0] is None else bounds[0] + (bounds[1] - bounds[0]) // 2
    rows = materialise(digests(src, digest).withColumn("incoming", F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))), "op8-digests")
    known = rows.filter(F.col("doc_id").isNotNull())
    every = materialise(groups(known.filter("incoming"), snapshot(known.filter(~F.col("incoming")))), "op8-groups")
    several = materialise(every.filter("n > 1"), "op8-several")

    # byte checks: texts of groups of several rows against the text that stays, the copies spread by salt
    found = join_hot(known.select("doc_id", "digest"), several, "digest", F.col("doc_id")).select("doc_id", "digest", "last", "n").distinct()
    members = materialise(found.withColumn("salts", F.ceil(F.col("n") / F.lit(COPIES_PER_SALT)).cast("int")), "op8-members")
    texts = _normalised(keep_ids(src, members.select("doc_id").distinct(), "left_semi"), digest).withColumn("part", F.spark_partition_id())  # rows that repeat an id are spread too
    texts = texts.join(F.broadcast(members) if small(members) else members.hint("shuffle_hash"), ["doc_id", "digest"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.col("salts")).cast("int"))
    stays = texts.filter(F.col("doc_id") == F.col("last")).groupBy("digest", "salts").agg(F.min("text").alias("kept_text")).select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    compared = texts.join(stays, ["digest", "salt"]).select("doc_id", "digest", "last", "n", (F.col("text") == F.col("kept_text")).alias("same"), F.when(F.col("text") != F.col("kept_text"), F.col("text")).alias("other"))
    compared = materialise(compared, "op8-compared")
    if compared.filter(~F.col("same")).head(1):
        regrouped = compared.groupBy("digest", "other").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        compared = compared.drop("last", "n").join(regrouped.withColumnsRenamed({"digest": "of", "other": "body"}), F.expr("digest = of AND other <=> body")).select("doc_id", "digest", "last", "n")
    multi = compared.select("doc_id", F.col("last").alias("keep_id"), F.col("n").alias("group_size"), (F.col("doc_id") == F.col("last")).alias("kept"), "digest")
    single = rows.filter(F.col("doc_id").isNull()).select("doc_id", "digest").unionByName(every.filter("n = 1").select(F.col("last").alias("doc_id"), "digest"))
    out = multi.unionByName(single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _normalised(docs: DataFrame, digest: Digest) -> DataFrame:
    """(doc_id, digest, text) with normalised texts."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            low = [x.lower() for x in as_bytes(b.column(1))]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(x) for x in low], pa.binary()), pa.array(low, pa.binary())], ["doc_id", "digest", "text"])

        return f

    return by_row(docs, "doc_id long, digest binary, text binary", make)


#: DuckDB: the same rows. translate() lower-cases A-Z only; \uXXXX needs no care, as sha256() takes the UTF-8 bytes.
SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
