"""Incremental catalogue upkeep and scoring with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from resona.operators import catalogue as C
from resona.operators import distances as D
from resona.operators.distances import Feature
from resona.plans import evaluate
from resona.plans.recommend import recommend_many
from resona.session import cut_lineage
from resona.sources import feature_text

Rows = Callable[[DataFrame], DataFrame]


def feature_lines(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 100) -> DataFrame:
    """New text files in a folder as a stream of lines with their path."""
    reader = spark.readStream.format("text").option("pathGlobFilter", pattern)
    lines = reader.option("maxFilesPerTrigger", files_per_batch).load(folder)
    return lines.select("value", F.input_file_name().alias("path"))


def ingest_new(
    stream: DataFrame, catalogue_path: str, checkpoint: str, quarantine_path: str | None = None, kind: str | None = None, id_col: str = "id",
    width: int | None = None, complete: Rows | None = None, beside: dict[str, Rows] | None = None,
) -> StreamingQuery:
    """Append rows whose id the catalogue does not have yet, then stop when all files are read.

    Of several new rows with one id the smallest is taken, column by column in their order.

    With `kind`, lines are parsed first and unreadable ones go to the quarantine. Files of a
    batch are written under its number, so a batch that runs again replaces its own output and
    does not take its earlier rows for known ones.

    `complete` adds columns to the new rows before they are stored (factors of Gaussians). `beside` keeps further tables in
    step, such as a bucket index: per folder a function of the stored new rows, written in the same micro-batch
    under the same number, so that a batch that runs again replaces these rows too.
    """
    spark = stream.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        rows = batch
        if kind:
            parsed = feature_text.parse(batch, kind, width)
            if quarantine_path:
                parsed = cut_lineage(parsed)  # parsed once for both readers
                aside = feature_text.quarantined(parsed)
                aside.write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
            rows = feature_text.good(parsed)
        others = [c for c in rows.columns if c != id_col]
        if others:
            rows = D.first_per_id(rows, id_col, others).select(*rows.columns)
        else:
            rows = rows.distinct()
        known = _known_ids(spark, catalogue_path, id_col, number)
        if known is not None:
            rows = C.not_yet_done(rows, known, id_col)
        stored = f"{catalogue_path}/batch={number}"
        (complete(rows) if complete else rows).write.mode("overwrite").parquet(stored)
        for path, derived in (beside or {}).items():
            derived(spark.read.parquet(stored)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _known_ids(spark: SparkSession, path: str, id_col: str, number: int) -> DataFrame | None:
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return None
    return spark.read.parquet(path).filter(F.col("batch") != number).select(id_col)


def score_queries(
    stream: DataFrame, catalogue: DataFrame, features: Sequence[Feature], k: int, out_path: str, checkpoint: str, id_col: str = "id"
) -> StreamingQuery:
    """Rank the static catalogue for every query track that arrives.

    Each micro-batch is one query list for the batch plan; the catalogue stays where it is.
    """

    def answer(batch: DataFrame, number: int) -> None:
        ranked = recommend_many(catalogue, batch, features, k, id_col=id_col)
        ranked.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def count_lists(stream: DataFrame, classes: DataFrame, out_path: str, checkpoint: str, feature_set: str = "all") -> StreamingQuery:
    """Class counts of result lists as their files arrive: (feature_set, original, detected, n).

    The state is one row per pair of classes, updated with every micro-batch; the newest counts replace the stored ones.
    """
    counts = evaluate.confusion(evaluate.labelled_lists(stream, classes, feature_set))

    def store(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(out_path)  # a row per pair of classes

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def distances_to_stream(
    stream: DataFrame, catalogue: DataFrame, reference_queries: DataFrame, features: Sequence[Feature], id_col: str = "id"
) -> DataFrame:
    """Distances of arriving tracks to a fixed, bounded set of reference tracks (a stream)."""
    batch = D.query_batch(reference_queries, [f.column for f in features], id_col, 32)
    return D.distance_rows(stream, batch, features, id_col)


def dedup_on_arrival(stream: DataFrame, event_time: str, delay: str = "1 hour", id_col: str = "id") -> DataFrame:
    """First row per id; ids are remembered for the watermark's delay only, so state is bounded."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([id_col])
