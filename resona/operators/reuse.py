"""One computation for several readers of the same rows, and counts on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def shared(rows: DataFrame) -> DataFrame:
    """Shuffle narrow rows once, so that what lies before runs once for several readers.

    All columns take part in the hash: then no reader prunes one, and the planner finds the
    readers' shuffles equal and reuses one. The source partition takes part as well, so equal
    rows in great number still spread out.
    """
    names = rows.columns
    pieces = rows.withColumn("_piece", F.spark_partition_id())
    return pieces.repartition("_piece", *names).select(*names)


def observed(df: DataFrame, *measures: Column) -> tuple[DataFrame, Observation]:
    """Measures of a step (row count if none are named), filled when a job passes through it.

    The session keeps them. MLlib's SVM models that are fitted in the same session afterwards cannot be sent to
    tasks (Spark 4.1), so observe in `spark.newSession()` where both are needed.
    """
    watch = Observation()
    return df.observe(watch, *(measures or [F.count(F.lit(1)).alias("rows")])), watch
