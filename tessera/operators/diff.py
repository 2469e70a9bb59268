"""Comparing two snapshots: counted multisets of findings, and points field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import SEVERITY_RANK, rank_of

KEY = ["id", "module", "call"]
FIELDS = ["signature", "implement", "kind", "category"]


def surface_diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """(direction, id, module, call, category, severity, count) of findings introduced and removed, lines aside.

    Both snapshots (id, module, call, category, severity, ord) are counted per key in one aggregation with partial sums, so a key that fills a third of
    either side costs a row per task; the surplus is what multiset difference gives. Metadata is that of the first of a key, the new snapshot's first.
    """
    one = base.select(*KEY, "category", "severity", F.lit(1).alias("side"), F.col("ord").cast("long").alias("ord")).unionByName(new.select(*KEY, "category", "severity", F.lit(0).alias("side"), F.col("ord").cast("long").alias("ord")))
    per = one.groupBy(*KEY).agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("delta"), F.min_by(F.struct("category", "severity"), F.struct("side", "ord")).alias("meta"))
    return per.filter("delta <> 0").select(F.when(F.col("delta") > 0, "introduced").otherwise("removed").alias("direction"), *KEY, "meta.category", "meta.severity", F.abs("delta").cast("long").alias("count"))


def at_or_above(changes: DataFrame, threshold: str) -> DataFrame:
    """Introduced changes of at least a severity; 'none' lets nothing through."""
    if threshold == "none":
        return changes.limit(0)
    return changes.filter((F.col("direction") == "introduced") & (rank_of(F.col("severity")) <= SEVERITY_RANK[threshold]))


def last_by_id(points: DataFrame, ord_col: str = "ord") -> DataFrame:
    """One point per id, the last of several; points without an id are left out."""
    rest = [c for c in points.columns if c not in ("id", ord_col)]
    return points.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*rest), ord_col).alias("r")).select("id", "r.*")


def manifest_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) of ids added and removed. Each side's ids are made distinct, then one full outer join."""
    both = old.select("id").distinct().withColumn("o", F.lit(True)).join(new.select("id").distinct().withColumn("n", F.lit(True)), "id", "full_outer")
    return both.filter("o IS NULL OR n IS NULL").select("id", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change"))


def manifest_diff(old: DataFrame, new: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(id, change, field, old, new): ids added and removed, and each field that changed (null-safe; absent on both sides is equal)."""
    o, n = last_by_id(old), last_by_id(new)
    pack = lambda d, as_: d.select("id", F.struct(*fields).alias(as_))
    both = pack(o, "o").join(pack(n, "n"), "id", "full_outer")
    text = lambda c: c.cast("string")
    here: Column = F.col("o").isNotNull() & F.col("n").isNotNull()
    whole = F.when(F.col("n").isNull(), F.struct(F.lit("removed").alias("change"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))).when(
        F.col("o").isNull(), F.struct(F.lit("added").alias("change"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    )
    changed = [F.when(here & ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.struct(F.lit("changed").alias("change"), F.lit(f).alias("field"), text(F.col(f"o.{f}")).alias("old"), text(F.col(f"n.{f}")).alias("new"))) for f in fields]
    return both.select("id", F.explode(F.array_compact(F.array(whole, *changed))).alias("c")).select("id", "c.*")
