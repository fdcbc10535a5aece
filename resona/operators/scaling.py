"""Min-max scaling and the weighted mean score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.operators.distances import Feature, all_usable, usable
from resona.operators.reuse import shared


def distance_stats(rows: DataFrame, features: Sequence[Feature], by: Sequence[str] = ("query_id",)) -> DataFrame:
    """count, min, max, mean and sample stddev of every distance, one row per query."""
    aggregates = [F.count("*").alias("n")]
    for f in features:
        d = F.col(f.distance)
        aggregates += [
            F.min(d).alias(f"min_{f.name}"),
            F.max(d).alias(f"max_{f.name}"),
            F.avg(d).alias(f"mean_{f.name}"),
            F.stddev(d).alias(f"stddev_{f.name}"),
        ]
    return rows.groupBy(*by).agg(*aggregates)


def min_max(rows: DataFrame, features: Sequence[Feature], own: bool) -> DataFrame:
    """Per query min and max; `own` takes each feature over its own usable rows."""
    aggregates = []
    for f in features:
        d = F.when(usable(f), F.col(f.distance)) if own else F.col(f.distance)
        aggregates += [F.min(d).alias(f"min_{f.name}"), F.max(d).alias(f"max_{f.name}")]
    return rows.groupBy("query_id").agg(*aggregates)


def scaled(feature: Feature) -> Column:
    """(d - min) / (max - min), mirrored for similarities, times weight; constant means 0."""
    d, low, high = F.col(feature.distance), F.col(f"min_{feature.name}"), F.col(f"max_{feature.name}")
    share = F.try_divide(d - low, high - low)
    share = F.lit(1.0) - share if feature.similarity else share
    return F.when(high == low, F.lit(0.0)).otherwise(share) * F.lit(float(feature.weight))


def mean_score(features: Sequence[Feature]) -> Column:
    """Sum of scaled features over their number (weights do not enter the divisor)."""
    total = F.col(features[0].scaled)
    for f in features[1:]:
        total = total + F.col(f.scaled)
    return total / len(features)


def present_score(features: Sequence[Feature]) -> Column:
    """The same over the features a track has, for catalogues with gaps; null without any."""
    total = sum((F.coalesce(F.col(f.scaled), F.lit(0.0)) for f in features), F.lit(0.0))
    present = sum((F.col(f.scaled).isNotNull().cast("int") for f in features), F.lit(0))
    return F.try_divide(total, present)


def scale_rows(
    rows: DataFrame, features: Sequence[Feature], scale_mode: str = "after_join", missing: str = "drop"
) -> DataFrame:
    """Add scaled_* and `aggregated` to distance rows.

    after_join: only tracks with every feature count, also for min and max.
    before_join: each feature is scaled over the tracks that have it, then incomplete ones go.
    missing="keep" scales as before_join and scores incomplete tracks by what they have.
    """
    if scale_mode not in ("after_join", "before_join"):
        raise ValueError(scale_mode)
    own = scale_mode == "before_join" or missing == "keep"
    if not own:
        rows = rows.filter(all_usable(features))
    rows = shared(rows)  # the wide catalogue is scanned and compared once
    ranges = min_max(rows, features, own)
    if own and missing == "drop":
        rows = rows.filter(all_usable(features))
    joined = rows.join(ranges, "query_id")  # one row per query: Spark broadcasts it up to its size limit
    if own and missing == "keep":
        columns = [F.when(usable(f), scaled(f)).alias(f.scaled) for f in features]
        return joined.select(*rows.columns, *columns).withColumn("aggregated", present_score(features))
    columns = [scaled(f).alias(f.scaled) for f in features]
    return joined.select(*rows.columns, *columns).withColumn("aggregated", mean_score(features))


def by_mean(features: Sequence[Feature]) -> Column:
    """The refine condition: strictly closer than the mean in every given feature."""
    keep = F.lit(True)
    for f in features:
        d, mean = F.col(f.distance), F.col(f"mean_{f.name}")
        keep = keep & ((d > mean) if f.similarity else (d < mean))
    return keep
