"""Answering similarity queries over a whole catalogue."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.operators import blocks, ranking, scaling, screen
from resona.operators import distances as D
from resona.operators.distances import Feature


def find_queries(catalogue: DataFrame, id_col: str, *ids) -> DataFrame:
    """Query rows by id; the filter reaches the scan."""
    return catalogue.filter(F.col(id_col).isin(*ids))


def recommend(
    catalogue: DataFrame,
    queries: DataFrame,
    features: Sequence[Feature],
    k: int | None = None,
    scale_mode: str = "after_join",
    missing: str = "drop",
    id_col: str = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rank the catalogue for each query: distances, scaling, weighted mean, order.

    With k, the best k per query and their `rank`; without, all tracks in order. With
    missing="keep" a query is answered by the features it has; else `distances.unanswered` lists
    the queries left out. A row goes on for every query and track, with all its distances; for long
    lists recommend_many sends on the best alone.
    """
    rows = blocks.distance_rows(catalogue, queries, features, id_col, keep, missing)
    scored = scaling.scale_rows(rows, features, scale_mode, missing)
    return ranking.ranked(scored, "aggregated") if k is None else ranking.top_k(scored, k, "aggregated")


def feature_rankings(
    catalogue: DataFrame, queries: DataFrame, features: Sequence[Feature], k: int, id_col: str = "id"
) -> DataFrame:
    """Raw ranking per single feature, no scaling: (query_id, feature, rank, id, distance)."""
    entries = []
    for f in features:
        d = F.when(D.usable(f), F.col(f.distance))
        order = -d if f.similarity else d
        entries.append(F.struct(F.lit(f.name).alias("feature"), d.alias("distance"), order.alias("_order")))
    rows = blocks.distance_rows(catalogue, queries, features, id_col)
    long = rows.select("query_id", "id", F.inline(F.array(*entries))).filter(F.col("distance").isNotNull())
    return ranking.top_k(long, k, "_order", per=("query_id", "feature")).drop("_order")


# Long query lists -----------------------------------------------------------------------


def _ranges(
    tracks: DataFrame, asked: DataFrame, features: Sequence[Feature], scale_mode: str, id_type: T.DataType, long: bool, max_queries: int, sizes: tuple[int, int]
) -> DataFrame:
    """Min and max per feature and query: a row per query and task, then one per query."""
    names = [f.name for f in features]
    schema = T.StructType([T.StructField("query_id", id_type)])
    for n in names:
        schema = schema.add(f"min_{n}", "double").add(f"max_{n}", "double")

    def reduce(met: blocks.Met) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[pa.Array, np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for ids, low, high in held.values():
                cells = [pa.array(x) for pair in zip(low, high) for x in pair]
                yield pa.RecordBatch.from_arrays([ids, *cells], schema.names)
            held.clear()

        for chunk, key, block in met:
            if key not in held:
                if sum(len(x[0]) for x in held.values()) > blocks.HELD_QUERIES:
                    yield from rows()
                shape = (len(features), len(block))
                held[key] = block.column("query_id"), np.full(shape, np.inf), np.full(shape, -np.inf)
            _, low, high = held[key]
            for piece in screen.pieces(features, chunk, block):
                complete = piece.complete() if scale_mode == "after_join" else None
                for i in range(len(features)):
                    ok = complete if scale_mode == "after_join" else piece.usable[i]
                    screen.widen(piece, ok, i, low[i], high[i])
        yield from rows()

    partial = blocks.meet(tracks, asked, reduce, schema, long, max_queries, sizes)
    return partial.groupBy("query_id").agg(
        *[F.min(f"min_{n}").alias(f"min_{n}") for n in names],
        *[F.max(f"max_{n}").alias(f"max_{n}") for n in names],
    )


class _Scales:
    """How the distances of a block of queries become shares of a score."""

    def __init__(self, features: Sequence[Feature], block: screen.Rows):
        self.features = features
        low, high = (np.stack([block.column(f"{x}_{f.name}").to_numpy() for f in features]) for x in ("min", "max"))
        self.flat = ~(high > low)
        with np.errstate(invalid="ignore"):
            self.low, self.spread = low, np.where(self.flat, 1.0, high - low)
        weights = np.array([[f.weight] for f in features])
        with np.errstate(invalid="ignore", over="ignore"):
            # what bounds are multiplied by, a little less than the exact factor, and what it takes off the low end
            self.factor = (np.where(self.flat, 0.0, weights / self.spread) * (1 - 8 * screen.UNIT)).astype(np.float32)
            self.shift = np.where(self.flat, 0.0, low * weights / self.spread)
            # similarities are taken off their largest one at once, a little less than it
            self.shift[[f.similarity for f in features]] = 0.0
            self.top = (high - 4 * screen.UNIT * np.abs(high)).astype(np.float32)

    def share(self, place: int, distances: np.ndarray, query: np.ndarray | slice) -> np.ndarray:
        f = self.features[place]
        with np.errstate(invalid="ignore"):
            share = (distances - self.low[place, query]) / self.spread[place, query]
        share = 1.0 - share if f.similarity else share
        return np.where(self.flat[place, query], 0.0, share) * f.weight

    def least(self, place: int, cells: np.ndarray | screen.Bounds) -> np.ndarray:
        """Shares of all pairs in single precision: of bounds without what `shift` takes off."""
        if isinstance(cells, screen.Bounds):
            root = cells.least + self.top[place] if self.features[place].similarity else cells.low(cells.least)
            root *= self.factor[place]
            return root
        with np.errstate(invalid="ignore", over="ignore"):
            return self.share(place, cells, slice(None)).astype(np.float32)


def recommend_sets(
    catalogue: DataFrame,
    queries: DataFrame,
    features: Sequence[Feature],
    sets: dict[str, Sequence[str]],
    k: int,
    scale_mode: str = "after_join",
    id_col: str = "id",
    max_queries: int = blocks.BLOCK_QUERIES,
) -> DataFrame:
    """The k best per query and feature set: (feature_set, query_id, rank, id, aggregated).

    Distances and scaling cover all `features`; every set averages its share of the scaled
    columns, so many sets cost one comparison. Blocks of queries meet chunks of the catalogue
    (`blocks.meet`) twice: tasks send on only min/max, which are joined to the queries, and then their k best,
    never the pairs. Euclidean features are bounded first and measured where the bound leaves a result open (`screen`).
    A list of any length is one plan; max_queries is the size of a block.
    """
    blocks.checked_id(catalogue, id_col)
    id_type = catalogue.schema[id_col].dataType
    columns = list(dict.fromkeys(f.column for f in features))
    tracks = catalogue.select(F.col(id_col).alias("id"), *columns)
    asked = blocks.wanted(queries, columns, id_col)
    sizes = blocks.estimated_bytes(tracks), blocks.estimated_bytes(asked)
    long = sizes[1] > blocks.SENT_BYTES
    ranges = _ranges(tracks, asked, features, scale_mode, id_type, long, max_queries, sizes)
    place = {f.name: i for i, f in enumerate(features)}
    members = {name: [place[n] for n in names] for name, names in sets.items()}
    schema = T.StructType([T.StructField("feature_set", T.StringType()), T.StructField("query_id", id_type), T.StructField("id", id_type)])
    schema = schema.add("aggregated", "double")

    def best(met: blocks.Met) -> Iterator[pa.RecordBatch]:
        leaders = screen.Leaders(list(members), k, schema)
        for chunk, key, block in met:
            if key not in leaders.held and leaders.queries * len(members) > blocks.HELD_QUERIES:
                yield from leaders.rows()
            fronts = leaders.of(key, block, chunk)
            scales = block.once("scales", lambda: _Scales(features, block))
            for piece in screen.pieces(features, chunk, block):
                complete = piece.complete()
                shares = [scales.least(i, cells) for i, cells in enumerate(piece.cells)]
                ids = chunk.numbers("id")[piece.at : piece.at + len(shares[0])]
                for name, picked in members.items():
                    least = shares[picked[0]]
                    for i in picked[1:]:
                        least = least + shares[i]

                    def exact(track: np.ndarray, query: np.ndarray) -> np.ndarray:
                        total = 0.0
                        for i in picked:
                            total = total + scales.share(i, piece.measured(i, track, query), query)
                        return total / len(picked)

                    bounds = [i for i in picked if isinstance(piece.cells[i], screen.Bounds)]
                    shift = scales.shift[bounds].sum(axis=0)
                    weight = sum(abs(features[i].weight) for i in picked)
                    screen.offer(fronts[name], least, complete, len(picked), shift, weight, exact, ids)
        yield from leaders.rows()

    partial = blocks.meet(tracks, asked.join(ranges, "query_id"), best, schema, long, max_queries, sizes)
    ranked = ranking.top_k(partial, k, "aggregated", per=("feature_set", "query_id"))
    return ranked.select("feature_set", "query_id", "rank", "id", "aggregated")


def recommend_many(
    catalogue: DataFrame,
    queries: DataFrame,
    features: Sequence[Feature],
    k: int,
    scale_mode: str = "after_join",
    id_col: str = "id",
    max_queries: int = blocks.BLOCK_QUERIES,
) -> DataFrame:
    """The k best per query for a long query list: (query_id, rank, id, aggregated)."""
    sets = {"all": [f.name for f in features]}
    ranked = recommend_sets(catalogue, queries, features, sets, k, scale_mode, id_col, max_queries)
    return ranked.drop("feature_set")
