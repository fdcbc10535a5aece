"""The corpus pipeline: documents in, the training order of what is left out.

Every stage reads what its predecessor has written. All but the last return the columns of
`documents`: the quality classifier and decontamination drop documents, line dedup cuts texts, the
n-gram join leaves one document of each group. The last returns the mix, a row per copy of a
document that is taken, in training order.

Defined cases: documents without words, from the start or emptied by line dedup, go on unless a stage rejects them, and
the mix takes none of them; other null columns, ties, repeated rows and empty tables as the stages' operators state.
Columns beyond those of `documents` end with the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm import decontamination, line_dedup, mixing, ngram_join, ordinal_quality
from resona.session import use_checkpoint_dir
from resona.workload.registry import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ordinal_quality.graded(docs, labels).where("accepted").select(*COLUMNS)


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of passages."""
    ship(spark)
    return line_dedup.deduplicated(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: doc_id, source, size, source_size, target, taken, epoch and position of every copy."""
    return mixing.curriculum(mixing.mixture(docs))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("curriculum_mixing", mixture),
]

#: Classifier, suffix ranking and components have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them is written to the checkpoint folder."""
    folder = f"{use_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    order = ["position", F.col("doc_id").asc_nulls_last(), "epoch"]
    return docs.orderBy(*order)
