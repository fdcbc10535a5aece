"""Labelled rows for the classifiers: a bounded sample of labels beside their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.session import cut_lineage


def sample_labels(labels: DataFrame, label: Column, rows: int, allowed: Column | None = None) -> DataFrame:
    """(doc_id, label) of about `rows` doc_ids, chosen by hash; rows without id or label don't count.

    A doc_id with several labels gets the largest. About 16 bytes a row: safe to broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & label.isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    share = min(1.0, rows / max(known.count(), 1))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the documents that `labels` names, once per distinct text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return cut_lineage(rows.join(F.broadcast(labels), "doc_id").dropDuplicates(["doc_id", "text"]))
