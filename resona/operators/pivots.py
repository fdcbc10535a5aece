"""Exact nearest neighbours of every track, without comparing all pairs.

A bounded set of pivots (a sample, spread by hash) is measured against every track. Tracks are sorted by their nearest
pivot (cell) and their distance to it, and packed into chunks; a chunk knows its box, the least and largest distance of its
tracks to every pivot, and its reach, the largest distance of any of its tracks to its k-th neighbour inside the chunk.
By the triangle inequality a chunk can hold a neighbour only if the boxes are no farther apart than the reach. That is a
range join on the distance to one pivot (the cell of the chunk's first track), done on bins of that distance, and then a test of the whole boxes; it meets
narrow rows of chunks alone. Packed chunks come to the pairs that are left.

The answer is exact whatever the pivots are; they decide only how many pairs are compared (`compared`).
Ids are unique. Tracks without the vector, with another width or with a null, NaN or infinite number take no part. A chunk of no more
than k tracks has no reach and meets all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.functions import vectors
from resona.operators import blocks, ranking, screen
from resona.operators import distances as D
from resona.session import cut_lineage

#: Pivots, tracks of a chunk, and bins of the distance to a pivot.
PIVOTS, CHUNK, BINS = 64, 256, 32
_VECTOR = D.Feature("vector", "euclidean", "vector")


@dataclass(frozen=True)
class Cut:
    """The chunks, stored, and the pairs (asked, chunk) of them that may hold neighbours."""

    chunks: DataFrame
    pairs: DataFrame
    k: int
    id_type: T.DataType


def _numbers(catalogue: DataFrame, column: str, width: int, id_col: str) -> DataFrame:
    rows = catalogue.select(F.col(id_col).alias("id"), vectors.doubles(F.col(column)).alias("vector"))
    finite = F.forall("vector", lambda v: F.abs(v) < float("inf"))
    return rows.where((F.size("vector") == width) & vectors.all_numbers(F.col("vector")) & finite)


def _parts(cells: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of up to `most` sorted tracks each; a chunk ends with its cell, but small cells go together."""
    start = 0
    for end in [*(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]:
        if end - start >= max(1, most // 4) or (end == len(cells) and end > start):
            yield from np.array_split(np.arange(start, end), -(-(end - start) // most))
            start = end


def _packed(rows: DataFrame, pivots: int, k: int, most: int) -> DataFrame:
    """Sorted rows as chunks: cell (of the first track), n, data, low, high, reach."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for part in _parts(cells, most):
                held = batch.slice(int(part[0]), len(part))
                ids, vector = held.column("id"), held.column("vector")
                to = held.column("to").flatten().to_numpy().reshape(len(part), pivots)
                inside = D.block_distances(_VECTOR, vector, D._values(pa.chunked_array([vector])))
                np.fill_diagonal(inside, np.inf)
                reach = np.partition(inside, k - 1, axis=0)[k - 1].max() if len(part) > k else np.inf
                data = pa.RecordBatch.from_arrays([ids, ids, vector], ["id", "query_id", "vector"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, data.schema) as writer:
                    writer.write_batch(data)
                cell, n = pa.array([int(cells[part[0]])], pa.int32()), pa.array([len(part)], pa.int64())
                box = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (to.min(axis=0), to.max(axis=0))]
                rest = [pa.array([sink.getvalue().to_pybytes()], pa.binary()), *box, pa.array([float(reach)])]
                yield pa.RecordBatch.from_arrays([cell, n, *rest], ["cell", "n", "data", "low", "high", "reach"])

    return rows.mapInArrow(pack, "cell int, n long, data binary, low array<double>, high array<double>, reach double")


def cut(
    catalogue: DataFrame, column: str, width: int, k: int, id_col: str = "id", pivots: int = PIVOTS, chunk: int = CHUNK
) -> Cut:
    """Chunks of the catalogue (one sort, written to the checkpoint folder) and the pairs of them to compare.

    The driver gets the pivots, `pivots` x `width` numbers, and one distance.
    """
    blocks.checked_id(catalogue, id_col)
    tracks = _numbers(catalogue, column, width, id_col)
    drawn = tracks.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    points = [np.array(r.vector) for r in drawn] or [np.zeros(width)]
    to = D._kernel_column(_VECTOR, points)
    located = tracks.withColumn("to", to).withColumn("near", F.array_min("to"))
    located = located.withColumn("cell", F.array_position("to", F.col("near")).cast("int") - 1)
    order = ["cell", "near", "id"]
    ordered = located.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = cut_lineage(_packed(ordered, len(points), k, chunk))
    chunks = chunks.withColumn("chunk", F.monotonically_increasing_id())  # stored rows keep their places
    return Cut(chunks, _pairs(chunks), k, catalogue.schema[id_col].dataType)


def _pairs(chunks: DataFrame) -> DataFrame:
    """Pairs (asked, chunk) whose boxes are no farther apart than the asked chunk's reach."""
    own = [F.element_at(F.col(x), F.col("cell") + 1) for x in ("low", "high")]
    far = chunks.agg(F.max(own[1])).first()[0] or 1.0
    wide = far / BINS

    def bins(low: Column, high: Column) -> Column:
        first = F.greatest(F.lit(0.0), F.floor(low / wide).cast("double"))
        last = F.least(F.lit(float(BINS)), F.floor(high / wide).cast("double"))
        return F.when(first <= last, F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))

    # rounding of distances is far below this
    reach = (F.col("reach") * (1 + 1e-9) + 1e-9 * (1 + F.array_max("high"))).alias("reach")
    held = chunks.select("chunk", "cell", bins(*own).alias("held"))
    held = held.select("*", F.explode(F.sequence("held.first", "held.last")).alias("bin"))
    asked = chunks.select(F.col("chunk").alias("asked"), reach, F.posexplode(F.arrays_zip("low", "high")).alias("cell", "box"))
    span = bins(F.col("box.low") - F.col("reach"), F.least(F.col("box.high") + F.col("reach"), F.lit(2 * far)))
    asked = asked.select("asked", "cell", span.alias("span")).where("span IS NOT NULL")
    asked = asked.select("*", F.explode(F.sequence("span.first", "span.last")).alias("bin"))
    once = F.col("bin") == F.greatest("held.first", "span.first")  # a pair counts in its first common bin
    near = asked.join(held, ["cell", "bin"]).where(once).select("asked", "chunk")
    ours = chunks.select("chunk", F.col("low").alias("_low"), F.col("high").alias("_high"))
    theirs = chunks.select(F.col("chunk").alias("asked"), "low", "high", reach)
    apart = F.array_max(
        F.concat(
            F.zip_with("_low", "high", lambda a, b: a - b),
            F.zip_with("low", "_high", lambda a, b: a - b),
        )
    )
    both = near.join(ours, "chunk").join(theirs, "asked")
    return both.where(apart <= F.col("reach")).select("asked", "chunk")


def compared(found: Cut) -> DataFrame:
    """One row: tracks, and pairs of tracks compared; all pairs are the square of the tracks."""
    sizes = found.chunks.select("chunk", "n")
    asked = sizes.select(F.col("chunk").alias("asked"), F.col("n").alias("m"))
    done = found.pairs.join(sizes, "chunk").join(asked, "asked").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("compared"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tracks")).crossJoin(done)  # two single rows


def nearest_of_all(found: Cut) -> DataFrame:
    """The k nearest other tracks of every track by L2: (query_id, rank, id, distance)."""
    # chunks and asked chunks meet in tiles: data is sent once per tile that needs it, not once per pair
    ours, theirs = blocks.TRACK_PARTS, blocks.QUERY_PARTS
    part = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    tile = (part("chunk", ours) * theirs + part("asked", theirs)).alias("tile")
    wanted = found.pairs.select(tile, "asked", "chunk")
    lists = wanted.groupBy("tile", "asked").agg(F.collect_list("chunk").alias("chunks"))
    asked = lists.join(found.chunks.select(F.col("chunk").alias("asked"), F.col("data").alias("queries")), "asked")
    tracks = wanted.select("tile", "chunk").distinct().join(found.chunks.select("chunk", F.col("data").alias("tracks")), "chunk")
    schema = T.StructType([T.StructField("_list", T.StringType()), T.StructField("query_id", found.id_type), T.StructField("id", found.id_type)])
    schema = schema.add("distance", "double")

    def best(met: blocks.Met) -> Iterator[pa.RecordBatch]:
        leaders = screen.Leaders(["nearest"], found_k, schema)
        for chunk, key, block in met:
            if key not in leaders.held and leaders.queries > blocks.HELD_QUERIES:
                yield from leaders.rows()
            front = leaders.of(key, block, chunk)["nearest"]
            for piece in screen.pieces([_VECTOR], chunk, block):
                cells = piece.cells[0]
                least = np.sqrt(np.maximum(cells.least, np.float32(0))) if isinstance(cells, screen.Bounds) else cells.astype(np.float32)
                ids = chunk.numbers("id")[piece.at : piece.at + len(least)]
                ok = ids[:, None] != block.numbers("query_id")[None, :]
                ok = ok if piece.usable[0] is None else ok & piece.usable[0]
                screen.offer(front, least, ok, 1.0, np.zeros(len(block)), 0.0, lambda t, q: piece.measured(0, t, q), ids)
        yield from leaders.rows()

    found_k = found.k
    tiles = ours * theirs
    asked, tracks = asked.select("tile", "queries", "chunks"), tracks.select((F.col("tile") + 0).alias("tile"), "chunk", "tracks")  # columns of their own
    partial = blocks.beside(tracks.repartition(tiles, "tile"), asked.repartition(tiles, "tile"), best, schema)
    return ranking.top_k(partial, found.k, "distance").select("query_id", "rank", "id", "distance")
