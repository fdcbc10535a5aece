"""Retrieval in stages: keep the closer half, or the N best by one metric, then look further."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.operators import blocks, ranking, scaling
from resona.operators import distances as D
from resona.operators.distances import Feature
from resona.operators.reuse import shared
from resona.session import cut_lineage


def filter_refine(
    catalogue: DataFrame,
    queries: DataFrame,
    stages: Sequence[Sequence[Feature]] | Sequence[Feature],
    k: int | None = None,
    id_col: str = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Feature after feature, keep the tracks strictly closer than the mean of those still in.

    Each feature is scaled by min and max before its own filter. The order of the features
    matters: put the ones that cost least first. A stage reads its own column of the tracks that some query has left,
    and compares these pairs alone; what goes on is a narrow row per pair, written once per stage because its limits
    and its filter both read it. Ids of the catalogue are unique.
    """
    features = [f for s in stages for f in ([s] if isinstance(s, Feature) else s)]
    asked = queries.filter(D._usable([f.column for f in features], "drop"))
    rows = None
    for f in features:
        if rows is None:
            rows = blocks.distance_rows(catalogue, asked, [f], id_col, keep)
        else:
            rows = blocks.survivor_rows(catalogue, asked, rows, [f], id_col)
        rows = cut_lineage(rows.filter(D.usable(f)))
        d = F.col(f.distance)
        limits = rows.groupBy("query_id").agg(
            F.min(d).alias(f"min_{f.name}"), F.max(d).alias(f"max_{f.name}"), F.avg(d).alias(f"mean_{f.name}")
        )
        columns = [c for c in rows.columns if c != f.distance]
        rows = rows.join(limits, "query_id").filter(scaling.by_mean([f])).select(*columns, scaling.scaled(f).alias(f.scaled))
    scored = rows.withColumn("aggregated", scaling.mean_score(features))
    if k is None:
        return ranking.ranked(scored, "aggregated")
    return ranking.top_k(scored, k, "aggregated")


def prefilter(
    catalogue: DataFrame,
    queries: DataFrame,
    first: Feature,
    others: Sequence[Feature],
    n: int = 25,
    k: int | None = None,
    id_col: str = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The n best by one metric, then all other metrics on those alone, each with its own query.

    The first metric is scaled over the catalogue, the others over the n survivors. Ids of the catalogue are unique.
    """
    asked = queries.filter(D._usable([first.column, *[f.column for f in others]], "drop"))
    rows = blocks.distance_rows(catalogue, asked, [first], id_col, keep)
    rows = scaling.scale_rows(rows, [first], "after_join").drop("aggregated")
    order = -F.col(first.distance) if first.similarity else F.col(first.distance)
    best = cut_lineage(ranking.top_k(rows, n, order).drop("rank"))  # n rows per query
    both = shared(blocks.survivor_rows(catalogue, asked, best, others, id_col))
    ranges = scaling.min_max(both, others, own=True)
    both = both.join(ranges, "query_id").filter(D.all_usable(others))
    columns = [scaling.scaled(f).alias(f.scaled) for f in others]
    features = [first, *others]
    scored = both.select(*best.columns, *columns).withColumn("aggregated", scaling.mean_score(features))
    if k is None:
        return ranking.ranked(scored, "aggregated")
    return ranking.top_k(scored, k, "aggregated")
