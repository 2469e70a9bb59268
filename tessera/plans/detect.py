"""From module rows to ranked points and risk findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, scoring, sinks
from tessera.sources import python_source
from tessera.sources.walk import Paths


def _table(modules: DataFrame, column: str) -> DataFrame:
    """One row per element of an array column, with its place; modules are ordered by name."""
    return modules.filter("parse_error IS NULL").select("qualname", "all_exports", F.posexplode(column).alias("idx", "x")).select(F.col("qualname").alias("module"), F.col("qualname").alias("module_ord"), "all_exports", "idx", "x.*")


def exported_names(modules: DataFrame) -> DataFrame:
    """(name): what the top-level packages export, by their lists or else by what they import from elsewhere."""
    top = graph.top_level_packages(modules.filter("parse_error IS NULL"))
    named = F.coalesce("all_exports", F.transform(F.filter("imports", lambda i: i["fromlist"]), lambda i: i["name"]))
    return top.select(F.explode(named).alias("name")).distinct()


def seams(modules: DataFrame) -> DataFrame:
    """All seams of the parsed modules, which are read once for them, and once more where reexported is asked for: then pass a written or cached table."""
    found = graph.reexported(graph.module_seams(modules.filter("parse_error IS NULL")), exported_names(modules))
    return found.withColumn("reexported", F.col("reexported") & (F.col("kind") != "dynamic_import")).select(*graph.SEAM)


def detect(modules: DataFrame, min_score: float = 0.0) -> DataFrame:
    return scoring.points(seams(modules), min_score)


def audit(modules: DataFrame) -> DataFrame:
    """Risk findings of Python modules: calls in the catalog, and definitions that customise pickling."""
    calls = _table(modules, "calls").drop("module_ord", "all_exports").withColumnRenamed("idx", "visit_ord")
    name = F.col("dotted")
    spec = F.when(F.col("is_definition"), sinks.entry(name, sinks.PY_METHOD)).otherwise(sinks.python_entry(name))
    return sinks.elevate(calls.withColumn("_s", spec).filter("_s IS NOT NULL").select("*", "_s.*")).drop("_s", "is_definition", "shell_true")


def edges(modules: DataFrame) -> DataFrame:
    """Distinct internal dependencies (src, dst)."""
    imports = modules.filter("parse_error IS NULL").select(F.col("qualname").alias("src"), F.explode("imports").alias("i")).select("src", F.col("i.module").alias("import")).distinct()
    return graph.dependencies(graph.resolve_imports(imports, modules))


def scan(spark: SparkSession, root: str, exclude: Paths = ()) -> DataFrame:
    """Parsed modules of a Python tree, kept for the lenses that share them."""
    return python_source.modules(spark, root, exclude).cache()


def declared_seams(modules: DataFrame) -> DataFrame:
    """Seams of front ends that give declarations only: public ones, without re-exports and override points."""
    d = modules.filter("parse_error IS NULL").select(F.col("qualname").alias("module"), F.posexplode("declarations").alias("idx", "x")).select("module", "idx", "x.*").filter("is_public")
    kind = F.when(F.col("kind") == "function", "function").when(F.col("is_abstract"), "abstract_class").otherwise("class")
    detail = F.array_join(F.when(F.col("kind") == "function", F.col("decorators")).otherwise(F.col("bases")), ", ")
    group = F.when(F.col("kind") == "function", 0).otherwise(1)
    return d.select(kind.alias("kind"), "module", "name", "lineno", detail.alias("detail"), F.lit(False).alias("reexported"), F.lit(False).alias("has_override_point"), F.struct(F.col("module").alias("module_ord"), group.alias("grp"), "idx").alias("seam_ord"))
