"""Helpers of the text operators: Arrow columns, projection of inputs, size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise, shared_dir, ship, table

__all__ = ["as_bytes", "as_text", "by_row", "documents", "hash_below", "join_hot", "keep_ids", "materialise", "project", "shared_dir", "ship", "small", "table", "TOKENIZERS"]

#: Where the vocabulary files lie; every operator that needs one takes the path as a parameter.
TOKENIZERS = "/opt/tokenizers"

#: A side of a join is broadcast only if its rows take at most so many bytes.
BROADCAST_BYTES = 32 << 20
#: The same where the other side is narrow too, and costs little to shuffle.
NARROW_BYTES = 1 << 20
#: Rows of a batch that Python works on at once.
SLICE = 2_048
#: Rows that share a join key and that one task gets, at most.
HOT_ROWS = 1_000_000


def documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def project(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as doc_id) and the text, whatever other columns there are and however they are called. Ids are whole numbers: others raise, or are null
    where the session isn't in ANSI mode."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def as_bytes(col: pa.Array) -> list[bytes]:
    """Null counts as empty."""
    return [b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist()]


def as_text(col: pa.Array) -> list[str]:
    """Null counts as empty."""
    return ["" if x is None else x for x in col.to_pylist()]


def by_row(docs: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with a function that make() builds once per task, and that gets SLICE rows at a time, so that few texts are Python objects at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for a in range(0, b.num_rows, SLICE):
                yield f(b.slice(a, SLICE))

    return docs.mapInArrow(run, schema)


def width(df: DataFrame) -> Column:
    """Bytes of a row: those of its texts and binaries, and 8 of each other column (and element, of an array)."""

    def of(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 8
        return 8 * (F.coalesce(F.size(name), F.lit(0)) + 1) if kind.startswith("array") else F.lit(8)

    return sum((of(n, k) for n, k in df.dtypes), F.lit(16)).cast("long")


def small(df: DataFrame, most: int | None = None) -> bool:
    """Whether a written table is small enough to be broadcast, by its bytes."""
    return (df.agg(F.sum(width(df))).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def hash_below(col: str | Column, share: float) -> Column:
    """Whether the hash of a column lies in the lowest share of all hashes: about that share of distinct values, whatever their number."""
    return F.xxhash64(col) <= F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)))


def join_hot(rows: DataFrame, about: DataFrame, key: str, of: Column, n: str = "n") -> DataFrame:
    """rows joined with about, a written table of one row per key that says how many rows have it (n).

    Both are narrow, so about is broadcast only if it has NARROW_BYTES at most. Otherwise keys of more than HOT_ROWS rows are salted: their row of about is repeated per salt, and
    their rows are spread over the salts by the hash of a column (of). There are few such keys, at most one per HOT_ROWS rows.
    """
    if small(about, min(NARROW_BYTES, BROADCAST_BYTES)):
        return rows.join(F.broadcast(about), key)
    if (about.agg(F.max(n)).first()[0] or 0) <= HOT_ROWS:
        return rows.join(about, key)
    salts = F.ceil(F.col(n) / F.lit(HOT_ROWS)).cast("int")
    hot = materialise(about.filter(F.col(n) > HOT_ROWS).select(key, salts.alias("salts_of_key")), "hot-keys")
    spread = rows.join(F.broadcast(hot) if small(hot) else hot, key, "left").withColumn("salt_of_row", F.when(F.col("salts_of_key").isNotNull(), F.pmod(F.xxhash64(of), F.col("salts_of_key"))).otherwise(0).cast("int")).drop("salts_of_key")
    each = about.withColumn("salt_of_row", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return spread.join(each, [key, "salt_of_row"]).drop("salt_of_row")


def keep_ids(docs: DataFrame, ids: DataFrame, how: str = "left_anti", on: str = "doc_id") -> DataFrame:
    """docs with (left_semi) or without (left_anti) the ids of a written table of one column.

    The ids are broadcast when they take at most BROADCAST_BYTES; otherwise both sides are shuffled, the ids as the hashed side.
    A row of docs whose id is null matches nothing: it stays with left_anti and goes with left_semi.
    """
    side = F.broadcast(ids) if small(ids) else ids.hint("shuffle_hash")
    return docs.join(side, on, how)
