"""A corpus pipeline of five stages, each a use of one operator of tessera.llm over all that the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into the shared
folder and reads again as the next one's docs. All stages but the last return the columns of documents, however many and whatever called.

Decisions take effect: toxic documents go; of equal texts the largest doc_id stays; of a group of near duplicates the smallest doc_id stays;
documents that hold a benchmark item go; what is left is encoded. A row without an id is kept by the dedup stages, since nothing can name it.
Null texts are kept by the filters, count as empty, and are duplicates of each other. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, pieces, simhash, toxicity
from tessera.llm.common import keep_ids, materialise, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model, fitted on the labelled ones, calls toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(~toxicity.is_toxic(model)(F.col("text")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without exact copies, letters A-Z in either case."""
    gone = exact_dedup.exact_dedup(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return keep_ids(docs, materialise(gone, "pipeline-copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each component of near duplicates."""
    gone = simhash.near_dedup(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return keep_ids(docs, materialise(gone, "pipeline-near"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    ship(spark)
    for pieces in decontaminate.grouped(decontaminate.items_of(table(spark, sf_dir, "benchmark"))):
        docs = docs.filter(~decontaminate.is_contaminated(spark, pieces)(F.col("text")))
    return docs


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip)."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL can't express the model, the fingerprints' linking or the segmentation; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
