"""Distances from a bounded batch of query tracks to every track of a catalogue.

The catalogue is one wide row per track. A query batch is small by contract (its size is
checked) and travels to the executors with the task; the catalogue is never shuffled, joined
or repeated: each row yields one vector of distances per feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.functions import kernels, vectors

# A batch crosses the driver and is copied to every task, hence the bounds.
MAX_BATCH_QUERIES = 4096
MAX_BATCH_BYTES = 64 << 20

SIMILARITIES = {"chroma", "chroma_2d", "chroma_full", "chroma_row"}
GAUSSIAN = {"js", "skl"}


@dataclass(frozen=True)
class Feature:
    """One enabled feature: where it is, how it is compared, what it weighs."""

    name: str
    metric: str
    column: str
    weight: float = 1.0
    max_distance: float | None = None

    @property
    def distance(self) -> str:
        return f"d_{self.name}"

    @property
    def scaled(self) -> str:
        return f"scaled_{self.name}"

    @property
    def similarity(self) -> bool:
        """True where larger means closer."""
        return self.metric in SIMILARITIES

    def weighted(self, weight: float) -> "Feature":
        return replace(self, weight=weight)


# fixed values: the eight features, their columns and the bound on symmetric divergence
FEATURES = {
    "rp": Feature("rp", "euclidean", "rp"),
    "rh": Feature("rh", "euclidean", "rh"),
    "bh": Feature("bh", "euclidean", "bh"),
    "notes": Feature("notes", "levenshtein", "notes"),
    "chroma": Feature("chroma", "chroma", "chroma"),
    "skl": Feature("skl", "skl", "mfcc", max_distance=10000.0),
    "js": Feature("js", "js", "mfcc"),
    "mfcc": Feature("mfcc", "mfcc_euclidean", "mfcc"),
}

# fixed values: feature sets with names
PRESETS = {
    "all": ["rp", "rh", "bh", "notes", "chroma", "skl", "js", "mfcc"],
    "fast": ["mfcc", "rh", "notes"],
    "precise": ["js", "rp", "chroma"],
    "private": ["rp", "notes", "mfcc"],
    "rh_bh_mfcc": ["rh", "bh", "mfcc"],
    "rh_mfcc_notes": ["rh", "mfcc", "notes"],
    "rp_js_chroma": ["rp", "js", "chroma"],
    "rp_skl_chroma": ["rp", "skl", "chroma"],
}


# the divergences on a catalogue that `with_factors` has completed
STORED = {
    "js": replace(FEATURES["js"], metric="js_stored", column="gaussian"),
    "skl": replace(FEATURES["skl"], metric="skl_stored", column="gaussian"),
}


def features_of(preset: str | Sequence[str], weights: dict[str, float] | None = None, stored: bool = False) -> list[Feature]:
    """Features by name; `stored` takes the divergences from the stored factors of `with_factors`."""
    names = PRESETS[preset] if isinstance(preset, str) else list(preset)
    weights = weights or {}
    known = FEATURES | STORED if stored else FEATURES
    return [known[n].weighted(weights.get(n, 1.0)) for n in names]


@dataclass(frozen=True)
class QueryBatch:
    """A checked, driver-side copy of query rows."""

    ids: list
    values: dict[str, list]

    def __len__(self) -> int:
        return len(self.ids)

    def of(self, feature: Feature) -> list:
        """One vector or text per query, None where the query lacks the feature."""
        return self.values[feature.column]


def _values(column: pa.ChunkedArray) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    return [None if v is None else np.array(v, dtype=np.float64) for v in column.to_pylist()]


def _to_batch(table: pa.Table, id_col: str, columns: Sequence[str]) -> QueryBatch:
    return QueryBatch(table[id_col].to_pylist(), {c: _values(table[c]) for c in columns})


def _usable(columns: Sequence[str], missing: str) -> Column:
    """Query rows to answer: those with every feature, with missing="keep" those with any."""
    found = [F.col(c).isNotNull() for c in columns]
    keep = found[0]
    for f in found[1:]:
        keep = (keep | f) if missing == "keep" else (keep & f)
    return keep


def first_per_id(queries: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Of rows with one id the smallest, so that a repeated query id has one comparator."""
    packed = F.min(F.struct(*columns)).alias("row")
    return queries.groupBy(id_col).agg(packed).select(id_col, "row.*")


def unanswered(queries: DataFrame, features: Sequence[Feature], id_col: str = "id") -> DataFrame:
    """(query_id, missing features) of the queries that the drop modes leave out."""
    names = [F.when(F.col(f.column).isNull(), F.lit(f.name)) for f in features]
    lacking = F.array_compact(F.array(*names))
    return queries.select(F.col(id_col).alias("query_id"), lacking.alias("missing")).where(F.size("missing") > 0)


def query_batch(
    queries: DataFrame, columns: Sequence[str], id_col: str = "id", max_queries: int = MAX_BATCH_QUERIES
) -> QueryBatch:
    """Fetch a query list that has to fit one batch; a longer one is an error, not a cut."""
    columns = list(dict.fromkeys(columns))
    wanted = first_per_id(queries.filter(_usable(columns, "drop")), id_col, columns)
    table = wanted.orderBy(id_col).limit(max_queries + 1).toArrow()
    if table.num_rows > max_queries or table.nbytes > MAX_BATCH_BYTES:
        raise ValueError(
            f"more than {max_queries} queries or {MAX_BATCH_BYTES} bytes: take resona.operators.blocks"
        )
    return _to_batch(table, id_col, columns)


def block_distances(feature: Feature, column: pa.Array, queries: Sequence) -> np.ndarray:
    """(n, m) distances of one Arrow column to the batch, by the feature's kernel.

    Queries are compared in groups of equal length; one without the feature is +inf to all. Edit
    distances arrive ready, as vectors of `levenshtein_column`.
    """
    if feature.metric == "levenshtein":
        return kernels.dense(column, len(queries), finite=False)[0]
    groups = {}
    for j, q in enumerate(queries):
        if q is not None:
            groups.setdefault(len(q), []).append(j)
    out = np.full((len(column), len(queries)), np.inf)
    for places in groups.values():
        out[:, places] = _equal_block(feature, column, [queries[j] for j in places])
    return out


def _equal_block(feature: Feature, column: pa.Array, queries: Sequence) -> np.ndarray:
    if feature.metric == "mfcc_euclidean":
        q = np.asarray(queries, dtype=np.float64)
        d = kernels.gaussian_width(q.shape[1])
        keep = np.concatenate([np.arange(d), d + np.flatnonzero(np.triu(np.ones((d, d))))])
        c, good = kernels.dense(column, q.shape[1])
        trimmed = pa.FixedSizeListArray.from_arrays(pa.array(c[:, keep].ravel()), len(keep))
        out = kernels.euclidean_block(trimmed.cast(pa.list_(pa.float64())), q[:, keep])
        out[~good] = np.inf
        return out
    return kernels.BLOCKS[feature.metric](column, queries)


def _kernel_column(feature: Feature, queries: Sequence) -> Column:
    @F.arrow_udf("array<double>")
    def distances(column: pa.Array) -> pa.Array:
        block = block_distances(feature, column, queries)
        offsets = pa.array(np.arange(len(column) + 1, dtype=np.int32) * block.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(block.ravel()))

    return distances(F.col(feature.column))


def _or_infinite(distance: Column) -> Column:
    """A null distance (missing or misshapen input) becomes +inf."""
    return F.coalesce(distance.cast("double"), F.lit(float("inf")))


def levenshtein_column(feature: Feature, queries: Sequence[str]) -> Column:
    source = F.col(feature.column)
    texts = vectors.constant_array(queries, "string")
    return F.transform(texts, lambda q: _or_infinite(F.levenshtein(source, q)))


def distance_vector(feature: Feature, batch: QueryBatch) -> Column:
    """`array<double>` with the distance to every query of the batch, in its order.

    One formula per metric, whatever the number of queries: edit distances by the built-in
    expression, everything else by the feature's kernel.
    """
    queries = batch.of(feature)
    if feature.metric == "levenshtein":
        return levenshtein_column(feature, queries)
    return _kernel_column(feature, queries)


def usable(feature: Feature) -> Column:
    """The track has a distance in this feature: finite and within the feature's bound."""
    d = F.col(feature.distance)
    ok = d.isNotNull() & ~F.isnan(d) & (d < float("inf")) & (d > float("-inf"))
    if feature.max_distance is not None:
        ok = ok & (d <= feature.max_distance)
    return ok


def all_usable(features: Sequence[Feature]) -> Column:
    keep = F.lit(True)
    for f in features:
        keep = keep & usable(f)
    return keep


def distance_rows(
    catalogue: DataFrame,
    batch: QueryBatch,
    features: Sequence[Feature],
    id_col: str = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows (query_id, id, kept columns, d_*), every distance unfiltered.

    All features come out of one pass over the wide row; nothing is joined.
    """
    id_type = catalogue.schema[id_col].dataType
    if not isinstance(id_type, (T.StringType, T.IntegralType)):
        raise TypeError("ids are strings or integers")
    measured = catalogue.select(
        F.col(id_col).alias("id"), *keep, *[distance_vector(f, batch).alias(f.distance) for f in features]
    )
    query_ids = vectors.constant_array(batch.ids, id_type.simpleString()).alias("query_id")
    zipped = F.arrays_zip(query_ids, *[F.col(f.distance) for f in features])
    return measured.select("id", *keep, F.inline(zipped)).select(
        "query_id", "id", *keep, *[f.distance for f in features]
    )


def gaussian_summary(column: str, d: int) -> Column:
    """Cholesky status, log-determinant and inverse of each row's covariance."""

    @F.arrow_udf("struct<status: string, log_det: double, inverse: array<double>>")
    def summary(flat: pa.Array) -> pa.Array:
        values, good = kernels.dense(flat, d + d * d)
        stack = kernels.Gaussians(values, good)
        status = np.where(~good, "missing", np.where(stack.definite, "ok", "not_positive_definite"))
        inverse = stack.inverse().reshape(len(values), -1)
        none = ~stack.definite
        return pa.StructArray.from_arrays(
            [
                pa.array(status.astype(object), pa.string()),
                pa.array(np.where(none, 0.0, stack.log_det), mask=none),
                pa.array([None if n else row for n, row in zip(none, inverse)], pa.list_(pa.float64())),
            ],
            names=["status", "log_det", "inverse"],
        )

    return summary(F.col(column))


def with_factors(catalogue: DataFrame, d: int, column: str = "mfcc", out: str = "gaussian") -> DataFrame:
    """The catalogue with mean, covariance, log-determinant and inverse in one vector, to be stored with it.

    Rankings by `features_of(..., stored=True)` then factorise nothing per query but the mixtures of the
    Jensen-Shannon divergence. Null where the covariance is not positive definite: such a track has no divergence.
    """
    factors = F.col("_factors")
    flat = F.concat(vectors.doubles(F.col(column)), F.array(factors["log_det"]), factors["inverse"])
    whole = catalogue.withColumn("_factors", gaussian_summary(column, d))
    return whole.withColumn(out, F.when(factors["status"] == "ok", flat)).drop("_factors")


def divergence_status(feature: Feature, batch: QueryBatch) -> Column:
    """Per query: ok, negative (set to 0), not_a_number or not_positive_definite."""
    queries = batch.of(feature)

    @F.arrow_udf("array<string>")
    def status(column: pa.Array) -> pa.Array:
        if not queries:
            return pa.array([[]] * len(column), pa.list_(pa.string()))
        q = kernels.Gaussians(np.asarray(queries, dtype=np.float64))
        flat, good = kernels.dense(column, len(queries[0]))
        c = kernels.Gaussians(flat, good)
        raw = {"js": kernels.jensen_shannon_raw, "skl": kernels.symmetric_kl_raw}[feature.metric](c, q)
        singular = ~c.definite[:, None] | ~q.definite[None, :]
        text = np.where(raw < 0, "negative", "ok")
        text = np.where(np.isnan(raw), "not_a_number", text)
        text = np.where(singular, "not_positive_definite", text)
        return pa.array([list(row) for row in text], pa.list_(pa.string()))

    return status(F.col(feature.column))


def divergence_diagnostics(catalogue: DataFrame, batch: QueryBatch, feature: Feature) -> DataFrame:
    """How many comparisons of each kind a metric met, per query (accumulators as an aggregate)."""
    kind = "string" if batch.ids and isinstance(batch.ids[0], str) else "bigint"
    ids = vectors.constant_array(batch.ids, kind).alias("query_id")
    states = catalogue.select(divergence_status(feature, batch).alias("status"))
    pairs = states.select(F.inline(F.arrays_zip(ids, F.col("status"))))
    return pairs.groupBy("query_id", "status").agg(F.count("*").alias("n"))
