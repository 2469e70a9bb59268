"""Findings of other scanners from their JSON output, as (path, line, test_id); output that can't be read gives no rows."""

from __future__ import annotations

import subprocess
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """An object with results, each with filename, line_number and test_id."""
    kind = "struct<results: array<struct<filename: string, line_number: int, test_id: string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["results"]).alias("r"))
    return rows.select(F.col("r.filename").alias("path"), F.col("r.line_number").alias("line"), F.col("r.test_id").alias("test_id"))


def read_by_file(spark: SparkSession, path: str) -> DataFrame:
    """A list of files with filePath and messages, each with line and ruleId."""
    kind = "array<struct<filePath: string, messages: array<struct<line: int, ruleId: string>>>>"
    files = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("f"))
    return files.select(F.col("f.filePath").alias("path"), F.explode("f.messages").alias("m")).select("path", F.col("m.line").alias("line"), F.col("m.ruleId").alias("test_id"))


def run(spark: SparkSession, command: list[str], read: Callable[[SparkSession, str], DataFrame], timeout: float = 600.0) -> DataFrame:
    """What a scanner that prints JSON finds, read by read_flat or read_by_file; one that isn't installed, hangs or prints something else finds nothing.

    Scanners exit with a failure when they find something, so their exit code says nothing.
    """
    try:
        said = subprocess.run(command, capture_output=True, text=True, timeout=timeout).stdout
    except (OSError, subprocess.TimeoutExpired):
        said = ""
    path = f"{shared_dir(spark)}/tessera/scanner-{uuid.uuid4().hex}"
    spark.createDataFrame([(said or "{}",)], "value string").coalesce(1).write.text(path)
    return read(spark, path)


def in_scope(findings: DataFrame, tests: list[str]) -> DataFrame:
    return findings.filter(F.col("test_id").isin(tests))
