"""JSON snapshots of points and findings: an object that holds the list, or the bare list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<id: string, module: string, symbol: string, kind: string, category: string, signature: string, implement: array<string>, score: double, signals: array<string>>"
FINDING = "struct<id: string, category: string, severity: string, confidence: string, module: string, call: string, lineno: int>"
TRUTH = "struct<schema_version: string, targets: map<string, struct<version: string, extension_points: array<struct<id: string, justification: string>>>>>"
LOCK = "struct<hosts: map<string, struct<version: string, downstream: map<string, string>>>>"


class BadSnapshot(ValueError):
    """The file holds neither shape."""


def _listed(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """(ord, item.*) of one whole file; items that aren't objects are left out."""
    text = spark.read.text(path, wholetext=True)
    got = text.select(F.from_json("value", f"struct<{field}: array<string>>")[field].alias("a"), F.from_json("value", "array<string>").alias("b"), F.regexp_extract("value", "^\\s*(\\S)", 1).alias("c"))
    items = F.when(F.col("c") == "[", F.col("b")).otherwise(F.col("a"))
    row = got.select(items.isNull().alias("bad")).first()
    if row is None or row.bad:
        raise BadSnapshot(path)
    each = got.select(F.posexplode(items).alias("ord", "x")).filter(F.trim("x").startswith("{"))
    return each.select("ord", F.from_json("x", item).alias("x")).filter("x IS NOT NULL").select("ord", "x.*")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a manifest, or of a flat list; those without an id are left out."""
    return _listed(spark, path, "points", POINT).filter("id IS NOT NULL")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "sinks", FINDING)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(target, version, id, justification) of a ground-truth file."""
    targets = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TRUTH)["targets"]).alias("target", "t"))
    return targets.select("target", F.col("t.version").alias("version"), F.explode("t.extension_points").alias("p")).select("target", "version", "p.*")


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """(host, host_version, package, version) of a file of downstream packages."""
    hosts = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", LOCK)["hosts"]).alias("host", "h"))
    return hosts.select("host", F.col("h.version").alias("host_version"), F.explode("h.downstream").alias("package", "version"))


def pinned(labels: DataFrame, installed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels whose target is installed (target, version) in the version they name, and (target, version) of those to skip."""
    wanted = labels.select("target", "version").distinct()
    return labels.join(installed, ["target", "version"], "left_semi"), wanted.join(installed, ["target", "version"], "left_anti")
