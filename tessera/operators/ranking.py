"""Ranks, ties and limits of scored points. Scores take few distinct values, so ties are counted per score by aggregation and joined back
by broadcast of a side whose size is the number of distinct scores; rank positions come from a range partitioning, or of one target from a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

from .scoring import order

LOADER = "plugin_loader"


def split_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is to be implemented, and what plugins are registered with."""
    return points.filter(F.col("category") != LOADER), points.filter(F.col("category") == LOADER)


def bands(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per score: band (how many points have it), above (how many a higher one), within each target of by."""
    by = by or []
    per = points.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("band"))
    w = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("above", F.coalesce(F.sum("band").over(w), F.lit(0)).cast("long"))


def ranked(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """points with rank: the 1-based position in the total order of their target.

    With targets it is a window per target. Without, the rows are range-partitioned by the order and sorted within, so that a row's place is the number of rows in the
    partitions before plus its place in its own; the sorted rows are written first, since their places must not change between the two uses. No task sees more than its range.
    All columns of points are written, so give only those that are wanted beside the order's.
    """
    if by:
        return points.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order())).cast("long"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = points.repartitionByRange(n, *order()).sortWithinPartitions(*order()).withColumn("_at", F.monotonically_increasing_id())  # the partition, 33 bits up, and the place in it
    written = materialise(in_order, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = written.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    offsets = sizes.select("_part", before.alias("_before"))
    return written.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def top(points: DataFrame, limit: int) -> DataFrame:
    """The first points of the total order: a per-task top-k, then one of those."""
    return points.orderBy(*order()).limit(limit)


def numbered(points: DataFrame) -> DataFrame:
    """points with rank, of a few that a limit has left: one window over all."""
    return points.withColumn("rank", F.row_number().over(Window.orderBy(*order())))


def tied_with(points: DataFrame) -> DataFrame:
    """points with tied_with: how many others have the same score, before any limit. The score counts are few and broadcast."""
    return points.join(F.broadcast(points.groupBy("score").agg((F.count(F.lit(1)) - 1).alias("tied_with"))), "score")


def tie_note(points: DataFrame, shown: int) -> DataFrame:
    """One row (cutoff, band, above, in_view) about the last band in view; none if nothing is shown or the band is one point."""
    total = bands(points)
    within = total.filter((F.col("above") < shown) & (F.lit(shown) > 0)).orderBy("score").limit(1)
    whole = F.least(F.lit(shown), F.col("above") + F.col("band"))
    return within.filter("band >= 2").select(F.col("score").alias("cutoff"), F.col("band").cast("long").alias("band"), "above", (whole - F.col("above")).cast("long").alias("in_view"))


def tie_bounds(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """points with best and worst: the positions that a point may take among its equals."""
    by = by or []
    return points.join(F.broadcast(bands(points, by)), [*by, "score"]).withColumn("best", (F.col("above") + 1).cast("long")).withColumn("worst", (F.col("above") + F.col("band")).cast("long")).drop("above", "band")


def collapse_registrations(points: DataFrame) -> DataFrame:
    """Loaders once per module and name, with their number, and the place of the first."""
    return split_points(points)[1].groupBy("module", "name").agg(F.count(F.lit(1)).alias("n"), F.min("seam_ord").alias("first_ord"))
