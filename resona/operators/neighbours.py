"""Nearest neighbours on standardised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.functions import kernels, vectors
from resona.operators import blocks, ranking


def concatenated(*columns: str) -> Column:
    """Several features side by side as one vector."""
    return F.concat(*[vectors.doubles(F.col(c)) for c in columns])


def dimension_statistics(catalogue: DataFrame, column: str) -> DataFrame:
    """One row: mean, population standard deviation per dimension and the row count.

    Summarizer keeps one small buffer per task; the rows are not spread out by dimension.
    """
    summary = Summarizer.metrics("mean", "variance", "count")
    row = catalogue.filter(F.col(column).isNotNull()).select(
        summary.summary(array_to_vector(vectors.doubles(F.col(column)))).alias("s")
    )
    n = F.col("s.count")
    variance = F.transform(
        vector_to_array("s.variance"), lambda v: F.when(n > 1, v * (n - 1) / n).otherwise(0.0)
    )
    return row.select(
        n.alias("n"),
        vector_to_array("s.mean").alias("mean"),
        F.transform(variance, lambda v: F.sqrt(v)).alias("stddev"),
    )


def _statistics(catalogue: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """Mean and deviation vectors; one row as wide as the vector comes to the driver."""
    row = dimension_statistics(catalogue, column).first()
    return row["mean"], row["stddev"]


def standardise(catalogue: DataFrame, column: str, out: str) -> DataFrame:
    """z-scores by the catalogue's own statistics; a constant dimension becomes 0."""
    mean, stddev = _statistics(catalogue, column)
    mean = vectors.constant_array(mean, "double")
    inverse = vectors.constant_array([1 / s if s > 0 else 0.0 for s in stddev], "double")
    centred = F.zip_with(vectors.doubles(F.col(column)), mean, lambda v, m: v - m)
    return catalogue.withColumn(out, F.zip_with(centred, inverse, lambda v, i: v * i))


def nearest(
    catalogue: DataFrame,
    queries: DataFrame,
    column: str,
    k: int,
    standardised: bool = True,
    skip_query: bool = False,
    id_col: str = "id",
) -> DataFrame:
    """k nearest tracks by L2: (query_id, rank, id, distance).

    Centring cancels in a difference, so standardising is a weight of 1/variance per dimension,
    taken from the catalogue alone; queries may come from elsewhere. The weights are one row that joins the
    queries; tasks send on their k best per query.
    """
    blocks.checked_id(catalogue, id_col)
    id_type = catalogue.schema[id_col].dataType
    asked = blocks.wanted(queries, [column], id_col)
    if standardised:
        weight = F.transform("stddev", lambda s: F.when(s > 0, 1 / (s * s)).otherwise(0.0))
        # one row as wide as the vector
        asked = asked.crossJoin(F.broadcast(dimension_statistics(catalogue, column).select(weight.alias("_weights"))))
    tracks = catalogue.filter(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), column)

    def score(pair: blocks.Pair) -> Iterator[tuple[str, np.ndarray, int]]:
        weights = None
        if standardised and len(pair.queries):
            weights = pair.queries.column("_weights")[0].values.to_numpy(zero_copy_only=False)
        out = np.full((pair.tracks.num_rows, len(pair.batch)), np.inf)
        ids = pair.tracks.column("id").to_numpy(zero_copy_only=False)
        dense = {}
        for j, query in enumerate(pair.batch.values[column]):
            if len(query) not in dense:
                dense[len(query)] = kernels.dense(pair.tracks.column(column), len(query))
            rows, good = dense[len(query)]
            difference = rows - query
            if weights is None or len(weights) != len(query):
                squares = np.einsum("ij,ij->i", difference, difference)
            else:
                squares = np.einsum("ij,ij,j->i", difference, difference, weights)
            out[:, j] = np.where(good, np.sqrt(squares), np.inf)
            if skip_query:
                out[ids == pair.batch.ids[j], j] = np.inf
        yield "nearest", out, 0

    schema = T.StructType([T.StructField("_list", T.StringType()), T.StructField("query_id", id_type), T.StructField("id", id_type)])
    partial = blocks.best_of(blocks.met(tracks, asked), [column], [], ["nearest"], k, schema.add("distance", "double"), score)
    return ranking.top_k(partial, k, "distance").select("query_id", "rank", "id", "distance")
