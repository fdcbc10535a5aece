"""Ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    rows: DataFrame, k: int, by: str | Column, per: Sequence[str] = ("query_id",), tie: str = "id", ascending: bool = True
) -> DataFrame:
    """The k best rows per query with `rank`; the window keeps k rows per task before it shuffles."""
    order = F.col(by) if isinstance(by, str) else by
    order = order.asc() if ascending else order.desc()
    window = Window.partitionBy(*per).orderBy(order, F.col(tie))
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def ranked(rows: DataFrame, by: str, ascending: bool = True, tie: str = "id") -> DataFrame:
    """The whole list in order, by a range shuffle (no per-query window over a whole catalogue)."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    lead = [F.col("query_id")] if "query_id" in rows.columns else []
    return rows.orderBy(*lead, order, F.col(tie))


def side_by_side(rankings: DataFrame, sets: Sequence[str], k: int) -> DataFrame:
    """Rank lists (feature_set, query_id, id, rank) of several feature sets, one line per place."""
    return (
        rankings.filter(F.col("rank") <= k)
        .groupBy("query_id", "rank")
        .pivot("feature_set", list(sets))
        .agg(F.first("id"))
    )


def overlap_at_k(rankings: DataFrame, k: int) -> DataFrame:
    """Shared tracks of every two feature sets per query, among the first k."""
    best = rankings.filter(F.col("rank") <= k)
    found = best.groupBy("query_id", "id").agg(F.array_sort(F.collect_set("feature_set")).alias("s"))

    def with_later(name: Column, place: Column) -> Column:
        later = F.slice("s", place + 2, F.size("s"))
        return F.transform(later, lambda other: F.struct(name.alias("set_a"), other.alias("set_b")))

    pairs = found.select("query_id", F.inline(F.flatten(F.transform("s", with_later))))
    return pairs.groupBy("query_id", "set_a", "set_b").agg(F.count("*").alias("shared"))
