"""Operator 9, line dedup: range-partitioned hashes, sorted by document and position, streamed; compressed keep bitmaps instead of text.

 1. One pass over the texts writes a narrow row (hash of the key, doc_id, positions, hash of the text) per document and distinct key of MIN_POINTS or more code
    points: repeats within a document are merged before the shuffle. The hash is XXH3-128.
 2. The rows are range-partitioned by (hash, doc_id) and sorted within partitions. The range covers the document too, so a line that a third of
    the documents share spans as many partitions as it needs.
 3. Each partition streams its rows: the first document of a hash keeps its lines, all later ones drop theirs. Only a partition's first hash may
    have begun in an earlier one; its first row is handed on unresolved, with the partition's number and last hash. Those few rows (one per
    partition, and its repeats of a doc_id) are resolved by a join among them.
 4. Dropped positions per document and text become a bitmap of kept lines, compressed. Where the text is wanted, documents are joined with their bitmaps
    (broadcast if they are small, else by shuffle with the bitmaps hashed) and cut.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, by_row, materialise, project, ship, small

MIN_POINTS = 10


def key_of(line: bytes) -> bytes | None:
    """The line stripped of 0x20 and 0x09-0x0D with A-Z lower-cased; None if it is too short to count."""
    k = line.strip().lower()  # of bytes: those characters exactly
    if len(k) >= 4 * MIN_POINTS or len(k) >= MIN_POINTS and (k.isascii() or len(k.decode("utf-8", "replace")) >= MIN_POINTS):
        return k
    return None


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, t): with the hash of each text, which tells rows apart that share a doc_id."""
    return project(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))


def lines(docs: DataFrame) -> DataFrame:
    """(h, l, doc_id, at array<int>, t): the two halves of the hash of each distinct key of a document, the positions of its lines, and its text's hash.

    docs: (doc_id, text, t).
    """

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            hashes, ids, of, flat, sizes = [], [], [], [], [0]
            for d, t, own in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist()):
                if d is None:
                    continue
                here: dict[bytes, list[int]] = {}
                for i, line in enumerate(t.split(b"\n")):
                    k = key_of(line)
                    if k is not None:
                        here.setdefault(xxhash.xxh3_128_digest(k), []).append(i)
                hashes += here
                ids += [d] * len(here)
                of += [own] * len(here)
                for at in here.values():
                    flat += at
                    sizes.append(len(flat))
            h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            at = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(ids, pa.int64()), at, pa.array(of, pa.int64())], ["h", "l", "doc_id", "at", "t"])

        return f

    return by_row(docs, "h long, l long, doc_id long, at array<int>, t long", make)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to drop, of rows sorted by hash and document. The partition's first row, and others of its hash and document, come with part, its number,
    and the hash; the last row is repeated with its hash alone, so that the next partition's first row can be resolved."""
    part = TaskContext.get().partitionId()
    last: tuple[int, int, int] | None = None  # hash, and the document that keeps it
    schema = pa.schema([("part", pa.int32()), ("first", pa.bool_()), ("h", pa.int64()), ("l", pa.int64()), ("doc_id", pa.int64()), ("at", pa.list_(pa.int32())), ("t", pa.int64()), ("owner", pa.int64())])
    for b in batches:
        if not b.num_rows:
            continue
        h, l, d = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.empty(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
        new[0] = last is None or (h[0], l[0]) != last[:2]
        # the owner of each row's hash: the document of the hash's first row
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        owner = np.where(start >= 0, d[np.maximum(start, 0)], last[2] if last else 0)
        drop = d != owner
        if last is None:
            head = (h[0], l[0], d[0])
        begins = (h == head[0]) & (l == head[1]) & (d == head[2])
        drop |= begins
        at = np.flatnonzero(drop)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(begins[at]), *(pa.array(x[at]) for x in (h, l, d)), b.column(3).take(pa.array(at)), b.column(4).take(pa.array(at)), pa.array(owner[at])], schema=schema)
        last = (int(h[-1]), int(l[-1]), int(owner[-1]))
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.bool_()), pa.array([last[0]]), pa.array([last[1]]), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.int64()), pa.array([last[2]])], schema=schema)


def drops(docs: DataFrame) -> DataFrame:
    """(doc_id, t, at array<int>): positions of the lines that each document's text of hash t loses, for texts that lose any. docs: (doc_id, text, t)."""
    rows = materialise(lines(docs), "op9-lines")
    ranged = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "l", "doc_id").sortWithinPartitions("h", "l", "doc_id")
    out = materialise(ranged.mapInArrow(_stream, "part int, first boolean, h long, l long, doc_id long, at array<int>, t long, owner long"), "op9-streamed")
    # One first row (more if rows repeat its doc_id) and one last row per partition. A partition's hash may run through several: its owner is that of the first of them.
    ends = out.filter("first IS NULL OR first").select("part", "h", "l", "doc_id", "at", "t", "owner", F.coalesce("first", F.lit(False)).alias("first"))
    heads, tails = ends.filter("first"), ends.filter("NOT first").select("h", "l", F.col("part").alias("of"))
    # the head drops if an earlier partition ends in its hash
    before = tails.groupBy("h", "l").agg(F.min("of").alias("of"))
    continued = heads.join(F.broadcast(before), ["h", "l"]).filter("of < part")
    sure = out.filter("first = false").select("doc_id", "t", "at")
    both = sure.unionByName(continued.select("doc_id", "t", "at"))
    return both.groupBy("doc_id", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("at"))  # a set: rows that repeat a document add nothing


def pack(at: list[int]) -> bytes:
    """Compressed bitmap of kept lines up to the last dropped one; lines beyond it are kept."""
    keep = np.ones(at[-1] + 1 if at else 0, bool)
    keep[at] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """Whether each of the first n lines is kept; n is at most the number of lines that were packed."""
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool)
        used = min(n, len(bits))
        keep[:used] = bits[:used]
    return keep


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, n_dropped, last, keep binary) of each document's text that loses lines: its hash, and a compressed bitmap of the lines up to position last."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            at = b.column(2).to_pylist()
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, at), pa.int64()), pa.array([x[-1] for x in at], pa.int32()), pa.array(map(pack, at), pa.binary())], ["doc_id", "t", "n_dropped", "last", "keep"])

        return f

    return by_row(drops(_hashed(docs, id_col, text_col)), "doc_id long, t long, n_dropped long, last int, keep binary", make)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, text]) of every row.

    Keys of MIN_POINTS or more code points found in two documents or more lose all their lines but those of the smallest doc_id holding them.
    A null or empty text is one empty line. Rows that repeat a doc_id are one document: none makes another lose lines, and each loses those
    of its own text that a smaller doc_id holds. A row with a null id holds no key and loses nothing. Other columns are ignored; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    src = _hashed(docs, id_col, text_col)
    maps = materialise(bitmaps(docs, id_col, text_col).select("doc_id", "t", "last", "keep"), "op9-bitmaps")
    joined = src.join(F.broadcast(maps) if small(maps) else maps.hint("shuffle_hash"), ["doc_id", "t"], "left")

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            n, gone, sha, kept = [], [], [], []
            for t, last, bitmap in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if last is None:
                    n.append(t.count(b"\n") + 1)
                    gone.append(0)
                else:
                    part = t.split(b"\n")
                    keep = np.ones(len(part), bool)
                    k = min(last + 1, len(part))
                    keep[:k] = unpack(bitmap, last + 1)[:k]
                    n.append(len(part))
                    gone.append(int(len(part) - keep.sum()))
                    t = b"\n".join(x for x, y in zip(part, keep) if y)
                sha.append(hashlib.sha256(t).hexdigest())
                if with_text:
                    kept.append(t.decode("utf-8", "replace"))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept, pa.string())] * with_text
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["text"] * with_text)

        return f

    return by_row(joined.select("doc_id", "text", "last", "keep"), "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text, make)


#: DuckDB: the same rows. trim() with a list of characters strips those at both ends.
SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.line, k.pos, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
