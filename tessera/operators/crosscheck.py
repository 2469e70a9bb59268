"""Findings held against another authority, and downstream use as votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 3


def tolerance_match(a: DataFrame, b: DataFrame, tolerance: int = TOLERANCE, on: str = "path") -> DataFrame:
    """a (path, line) with agreed: whether b has a line of the same path within the tolerance.

    b's distinct lines are bucketed by line // (tolerance + 1) and looked up in a line's bucket and its neighbours, so a path with very many findings
    spreads over its buckets, and each comparison is an equi-join on (path, bucket) with a range filter.
    """
    width = tolerance + 1
    bucket = F.floor(F.col("line") / width)
    there = b.select(F.col(on).alias("_p"), F.col("line").alias("_l")).distinct().withColumn("_b", F.floor(F.col("_l") / width))
    mine = a.select(on, "line").distinct()
    spread = mine.withColumn("_k", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    hit = spread.join(there, (F.col(on) == F.col("_p")) & (F.col("_k") == F.col("_b")) & (F.abs(F.col("line") - F.col("_l")) <= tolerance), "left_semi").select(on, "line").distinct()
    return a.join(hit.withColumn("agreed", F.lit(True)), [on, "line"], "left").withColumn("agreed", F.coalesce("agreed", F.lit(False)))


def stem(path):
    """A path without its ending."""
    return F.regexp_replace(path, "\\.[^./]*$", "")


def votes(uses: DataFrame) -> DataFrame:
    """(symbol, votes): how many packages (package, symbol) use a symbol, each once."""
    return uses.select("package", "symbol").distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("votes"))


def most_voted(uses: DataFrame, n: int) -> DataFrame:
    return votes(uses).orderBy(F.desc("votes"), "symbol").limit(n)


def unused(labels: DataFrame, uses: DataFrame) -> DataFrame:
    """Labelled symbols that no package uses."""
    return labels.select("symbol").distinct().join(uses.select("symbol").distinct(), "symbol", "left_anti")


def unlabelled(labels: DataFrame, uses: DataFrame, n: int = 5) -> DataFrame:
    """Of the n most used symbols those without a label."""
    return most_voted(uses, n).join(labels.select("symbol").distinct(), "symbol", "left_anti")
