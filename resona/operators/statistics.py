"""Grouped statistics that hold up when one group has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resona.operators.reuse import shared

# fixed values: names of the seven statistics in their order
SEVEN = ["mean", "var", "skew", "kurtosis", "median", "min", "max"]

# fixed value: relative resolution of a double
_RESOLUTION = 1e-15

_ACCURACY = 2000
_MARGIN = 0.002


def median_per_group(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median (mean of the two middle values) per group.

    A sketch brackets the middle of each group, values outside the bracket are only counted,
    and the few inside are ranked. Where the sketch missed, all values of that group are.
    """
    keys = list(keys)
    rows = shared(df.filter(F.col(value).isNotNull()).select(*keys, value))
    return _median(rows, keys, value, out)


def _median(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    quantiles = F.percentile_approx(value, [0.5 - _MARGIN, 0.5 + _MARGIN], _ACCURACY)
    bracket = rows.groupBy(*keys).agg(F.count("*").alias("_n"), quantiles.alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    bracketed = counted.join(bracket, keys)
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    sums = bracketed.groupBy(*keys).agg(
        F.sum(F.when(F.col(value) < low, F.col("_c")).otherwise(0)).alias("_below"),
        F.sum(F.when(F.col(value) <= high, F.col("_c")).otherwise(0)).alias("_upto"),
    )
    hit = (F.col("_below") < first) & (F.col("_upto") >= second)
    near = bracketed.join(sums, keys).filter(~hit | F.col(value).between(low, high))
    so_far = F.sum("_c").over(Window.partitionBy(*keys).orderBy(value))
    ranked = near.withColumn("_rank", so_far + F.when(hit, F.col("_below")).otherwise(0))
    middle = (
        F.min(F.when(F.col("_rank") >= first, F.col(value))) + F.min(F.when(F.col("_rank") >= second, F.col(value)))
    ) / 2
    return ranked.groupBy(*keys).agg(middle.alias(out))


def _or_zero(column):
    return F.coalesce(F.nanvl(column, F.lit(0.0)), F.lit(0.0))


def seven_statistics(df: DataFrame, keys: Sequence[str], value: str, bounded: bool = False) -> DataFrame:
    """mean, population variance, skewness, Pearson kurtosis, median, min and max per group.

    Undefined ones are 0, and so are skewness and kurtosis where the variance is rounding noise
    beside the mean. `bounded` says that groups are small by construction (the frames of
    one segment); their median then comes with the other aggregates.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    varies = F.var_pop(v) > F.pow(F.avg(v) * _RESOLUTION, F.lit(2.0))
    aggregates = [
        _or_zero(F.avg(v)).alias("mean"),
        _or_zero(F.var_pop(v)).alias("var"),
        F.when(varies, _or_zero(F.skewness(v))).otherwise(0.0).alias("skew"),
        F.when(varies, _or_zero(F.kurtosis(v) + 3)).otherwise(0.0).alias("kurtosis"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]
    if bounded:
        out = df.groupBy(*keys).agg(*aggregates, F.percentile(v, F.lit(0.5)).alias("median"))
    else:
        rows = shared(df.select(*keys, v.alias(value)).filter(F.col(value).isNotNull()))
        out = rows.groupBy(*keys).agg(*aggregates).join(_median(rows, keys, value, "median"), keys)
    return out.select(*keys, *SEVEN)


def gaussian_of_frames(frames: DataFrame, d: int, vec: str = "vec", keys: Sequence[str] = ("id",)) -> DataFrame:
    """Per group mean, population variance and sample covariance of d-wide frames, in one pass.

    Only moments are shuffled. `gaussian` is the flat mean + covariance form.
    """
    v = [F.col(vec)[i] for i in range(d)]
    means = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(v)]
    variances = [F.var_pop(c).alias(f"_v{i}") for i, c in enumerate(v)]
    upper = [F.covar_samp(v[i], v[j]).alias(f"_c{i}_{j}") for i in range(d) for j in range(i, d)]
    sums = frames.groupBy(*keys).agg(F.count("*").alias("frames"), *means, *variances, *upper)
    mean = [F.col(f"_m{i}") for i in range(d)]
    cov = [F.col(f"_c{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)]
    return sums.select(
        *keys,
        "frames",
        F.array(*mean).alias("mean"),
        F.array(*[F.col(f"_v{i}") for i in range(d)]).alias("var"),
        F.array(*cov).alias("cov"),
        F.array(*mean, *cov).alias("gaussian"),
    )


def positions(df: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """Per key, in ascending `order`: `position` (from 0) and `previous` value of `order`.

    Windows run within ranges of `width` along `order`; a table of the ranges, one row each,
    carries counts and last values across. A key with very many rows is spread over its ranges.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width)).repartition(key, "_range")
    inner = Window.partitionBy(key, "_range").orderBy(order)
    local = ranged.withColumn("_at", F.row_number().over(inner) - 1).withColumn(
        "_before", F.lag(order).over(inner)
    )
    per_range = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"), F.max(order).alias("_last"))
    outer = Window.partitionBy(key).orderBy("_range")
    carried = per_range.select(
        key,
        "_range",
        F.coalesce(F.sum("_n").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.lag("_last").over(outer).alias("_carry"),
    )
    joined = local.join(carried, [key, "_range"])
    return joined.withColumns(
        {"position": F.col("_at") + F.col("_offset"), "previous": F.coalesce("_before", "_carry")}
    ).drop("_range", "_at", "_before", "_offset", "_carry")
