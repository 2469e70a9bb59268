"""Snapshots that arrive as a stream: each batch is compared with the last state and the change appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import diff


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever file system its URI names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def watch(findings: DataFrame, base: str, out: str, checkpoint: str) -> StreamingQuery:
    """Compare each micro-batch of findings (id, module, call, category, severity, ord), a whole snapshot, with the one before.

    base: folder of snapshots by batch; out: folder of changes, with their batch; both may be URIs. A batch that is tried again writes the same files again. The first batch of a
    stream that goes on with a new checkpoint has none before it.
    """

    def compare(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{base}/{number}")
        before = f"{base}/{number - 1}"
        old = spark.read.schema(batch.schema).parquet(before) if number and _exists(spark, before) else batch.limit(0)
        new = spark.read.schema(batch.schema).parquet(f"{base}/{number}")
        diff.surface_diff(old, new).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return findings.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
