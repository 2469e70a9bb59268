"""A ranking held against labels: ranks, recall, precision, bounds from ties, medians; per target and in all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import bands


def label_ranks(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (target, id) with rank: that of the id's first occurrence among the candidates (target, id, rank), else their number plus 1."""
    first = candidates.groupBy("target", "id").agg(F.min("rank").alias("rank"))
    size = candidates.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    out = labels.join(first, ["target", "id"], "left").join(F.broadcast(size), "target", "left")
    return out.withColumn("found", F.col("rank").isNotNull()).withColumn("rank", F.coalesce("rank", F.coalesce("n", F.lit(0)) + 1).cast("long")).drop("n")


def label_bounds(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with best and worst, the positions that their score's band covers (null for labels that aren't candidates)."""
    score = candidates.groupBy("target", "id").agg(F.max("score").alias("score"))
    return labels.join(score, ["target", "id"], "left").join(F.broadcast(bands(candidates, ["target"])), ["target", "score"], "left").withColumn("best", (F.col("above") + 1).cast("long")).withColumn("worst", (F.col("above") + F.col("band")).cast("long")).drop("above", "band")


def recall_precision(ranks: DataFrame, k: int) -> DataFrame:
    """(target, hits, labels, recall, precision) at k; precision is over k whatever the number of candidates."""
    hits = F.count_if(F.col("rank") <= k)
    n = F.count(F.lit(1))
    return ranks.groupBy("target").agg(hits.alias("hits"), n.alias("n_labels"), (hits / n).alias("recall"), (hits / F.lit(float(k))).alias("precision"))


def recall_bounds(bounds: DataFrame, k: int) -> DataFrame:
    """(target, worst, best): hits at k if ties fall against, and for, the labels."""
    return bounds.groupBy("target").agg(F.count_if(F.col("worst") <= k).alias("worst_hits"), F.count_if(F.col("best") <= k).alias("best_hits"))


def median_ranks(ranks: DataFrame) -> DataFrame:
    """The exact median of the labels' ranks, the mean of the middle two of an even number."""
    return ranks.groupBy("target").agg(F.median(F.col("rank").cast("double")).alias("median_rank"))


def aggregate(ranks: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """Hits, labels, bounds and tie-decided labels of all targets together (one row)."""
    a = ranks.agg(F.count_if(F.col("rank") <= k).alias("hits"), F.count(F.lit(1)).alias("n_labels"))
    b = bounds.agg(F.count_if(F.col("worst") <= k).alias("worst_hits"), F.count_if(F.col("best") <= k).alias("best_hits"), F.count_if((F.col("best") <= k) & (F.col("worst") > k)).alias("tie_decided"))
    return a.crossJoin(b)  # one row each


def scores(candidates: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(target, n_candidates, n_labels, ranks, absent, hits, worst_hits, best_hits, median_rank) per target of labels (target, id).

    candidates: (target, id, rank, score). ranks are ascending; labels that aren't candidates (absent) count as one behind the last.
    """
    ranks, bounds = label_ranks(candidates, labels), label_bounds(candidates, labels)
    n = candidates.groupBy("target").agg(F.count(F.lit(1)).alias("n_candidates"))
    per = ranks.groupBy("target").agg(F.count(F.lit(1)).alias("n_labels"), F.array_sort(F.collect_list("rank")).alias("ranks"), F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("id")))).alias("absent"), F.count_if(F.col("rank") <= k).alias("hits"), F.median(F.col("rank").cast("double")).alias("median_rank"))
    return per.join(recall_bounds(bounds, k), "target").join(F.broadcast(n), "target", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
