"""Approximate neighbours: buckets of random projections pick candidates, exact distances rank them.

The index is a narrow table of ids: every vector is projected once on `tables` seeded directions, a bucket is the whole part
of the projection over the bucket length. Tracks and queries that share a bucket in some table are candidates. Only ids
meet in that join; a bucket with more than `CROWDED` tracks is cut into parts, each with a copy of the bucket's queries, so
no task gets a whole crowded bucket. Vectors come to the distinct pairs afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.functions import vectors
from resona.operators import blocks, ranking, screen
from resona.operators.distances import Feature

#: Tracks of a bucket that are joined in one place.
CROWDED = 2048


@dataclass(frozen=True)
class Projections:
    """Unit directions, one per table, and the width of a bucket."""

    directions: tuple[tuple[float, ...], ...]
    length: float

    def buckets(self, column: str) -> Column:
        """`array<bigint>`, a bucket per table, as one JVM expression."""
        value = vectors.doubles(F.col(column))
        lines = vectors.matrix_literal(self.directions)
        return F.transform(lines, lambda line: F.floor(vectors.dot(value, line) / self.length))


def projections(width: int, bucket_length: float = 1.0, tables: int = 4, seed: int = 12345) -> Projections:
    """Random directions for vectors of `width` numbers, the same for a seed wherever they are drawn."""
    drawn = np.random.RandomState(seed).standard_normal((tables, width))
    unit = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    # short decimals, so that they can be written out as text without loss
    return Projections(tuple(tuple(round(float(v), 9) for v in line) for line in unit), bucket_length)


def index(model: Projections, catalogue: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """(id, table, bucket), a row per track and table: what a stored index holds."""
    good = catalogue.filter(vectors.all_numbers(F.col(column)) & (F.size(column) == len(model.directions[0])))
    return good.select(F.col(id_col).alias("id"), F.posexplode(model.buckets(column)).alias("table", "bucket"))


def candidates(tracks: DataFrame, queries: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Distinct pairs (query_id, id) of two indexes that share a bucket in some table."""
    sizes = tracks.groupBy("table", "bucket").agg(F.count("*").alias("n"))
    parts = sizes.select("table", "bucket", F.ceil(F.col("n") / crowded).cast("int").alias("parts"))
    asked = queries.withColumnRenamed("id", "query_id").join(parts, ["table", "bucket"])
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = parts.filter("parts > 1")
    held = tracks.join(large, ["table", "bucket"], "left")
    held = held.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), "parts").cast("int")).otherwise(0))
    met = held.select("id", "table", "bucket", "part").join(asked.drop("parts"), ["table", "bucket", "part"])
    return met.select("query_id", "id").distinct()


def candidate_distances(
    model: Projections, catalogue: DataFrame, queries: DataFrame, column: str, stored: DataFrame | None = None
) -> DataFrame:
    """Exact distances of all pairs (query, track) that share a bucket in some table.

    Queries without the feature, or with one of another width, have none; a list of any length is one plan. `stored` is
    the catalogue's index where it is kept beside it, so that its vectors are not projected again.
    """
    tracks = index(model, catalogue, column) if stored is None else stored.select("id", "table", "bucket")
    pairs = candidates(tracks, index(model, queries, column))
    ours = catalogue.select("id", vectors.doubles(F.col(column)).alias("_track"))
    theirs = queries.select(F.col("id").alias("query_id"), vectors.doubles(F.col(column)).alias("_query"))
    both = pairs.join(ours, "id").join(theirs, "query_id")
    far = both.select("query_id", "id", vectors.euclidean(F.col("_track"), F.col("_query")).alias("distance"))
    return far.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))


def approximate_top_k(
    model: Projections, catalogue: DataFrame, queries: DataFrame, column: str, k: int, stored: DataFrame | None = None
) -> DataFrame:
    """Candidates by buckets, ranked exactly."""
    return ranking.top_k(candidate_distances(model, catalogue, queries, column, stored), k, "distance")


def approximate_nearest(model: Projections, catalogue: DataFrame, column: str, key: Sequence[float], k: int) -> DataFrame:
    """About the k nearest of one vector: (rank, id, distance)."""
    kind = catalogue.schema["id"].dataType
    one = catalogue.sparkSession.range(1).select(F.lit(0).cast(kind).alias("id"), vectors.constant_array([float(v) for v in key], "double").alias(column))
    return approximate_top_k(model, catalogue, one, column, k).drop("query_id")


def _with_buckets(model: Projections, rows: DataFrame, column: str) -> DataFrame:
    """(id, column, _buckets): vectors with the buckets of all rows of their id, an array per table (one bucket, if ids are unique)."""
    good = rows.filter(vectors.all_numbers(F.col(column)) & (F.size(column) == len(model.directions[0])))
    good = good.select("id", vectors.doubles(F.col(column)).alias(column))
    of_id = good.select("id", model.buckets(column).alias("b")).groupBy("id").agg(F.collect_set("b").alias("_buckets"))
    return good.join(of_id, "id")


def _shares_bucket(tracks: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Of pairs with their buckets (pairs, rows of the id, tables), those with a common bucket in some table."""
    hit = np.zeros(len(tracks), bool)
    for a in range(tracks.shape[1]):
        for b in range(queries.shape[1]):
            hit |= (tracks[:, a] == queries[:, b]).any(axis=1)
    return hit


def _buckets(rows: screen.Rows, tables: int) -> np.ndarray:
    """(rows, most rows of an id, tables); ids with fewer rows repeat their first."""
    lists = rows.column("_buckets")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, tables)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(lengths.max(initial=0))[None, :]
    return flat[starts[:, None] + np.where(place < lengths[:, None], place, 0)]


def similarity_join(model: Projections, catalogue: DataFrame, queries: DataFrame, column: str, threshold: float) -> DataFrame:
    """Pairs (query, track) that share a bucket and are no farther apart than the threshold.

    `queries` may be of any length, also the catalogue itself: narrow buckets that many pairs share are no list of candidates. Packed
    blocks meet packed chunks, a bound of the distance leaves few pairs, and these are tested for a common bucket and measured.
    """
    tracks = _with_buckets(model, catalogue, column)
    asked = _with_buckets(model, queries, column).withColumnRenamed("id", "query_id")
    feature, tables = Feature(column, "euclidean", column), len(model.directions)
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", catalogue.schema["id"].dataType)])
    schema = schema.add("distance", "double")
    limit = np.float32(max(threshold, 0.0) ** 2 * (1 + 1e-6))

    def near(met: blocks.Met) -> Iterator[pa.RecordBatch]:
        for chunk, _, block in met:
            for piece in screen.pieces([feature], chunk, block):
                cells = piece.cells[0]
                close = cells.least <= limit if isinstance(cells, screen.Bounds) else cells <= threshold
                if piece.usable[0] is not None:
                    close &= piece.usable[0]
                track, query = screen.places(close)
                ours, theirs = (r.once("buckets", lambda: _buckets(r, tables)) for r in (chunk, block))
                for at in range(0, len(track), screen.MEASURED):
                    t, q = track[at : at + screen.MEASURED], query[at : at + screen.MEASURED]
                    d = piece.measured(0, t, q)
                    held = (d <= threshold) & _shares_bucket(ours[t + piece.at], theirs[q])
                    ids = [block.column("query_id").take(pa.array(q[held])), chunk.column("id").take(pa.array(t[held] + piece.at))]
                    if held.any():
                        yield pa.RecordBatch.from_arrays([*ids, pa.array(d[held])], schema.names)

    sizes = tuple(blocks.estimated_bytes(x.select("id", column)) for x in (catalogue, queries))
    pairs = blocks.meet(tracks, asked, near, schema, sizes[1] > blocks.SENT_BYTES, sizes=sizes)
    return pairs.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each query's exact list that the approximate list holds."""
    hits = approximate.select("query_id", "id", F.lit(1).alias("hit"))
    marked = exact.select("query_id", "id").join(hits, ["query_id", "id"], "left")
    return marked.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
