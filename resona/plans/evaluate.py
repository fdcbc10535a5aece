"""Retrieval evaluation: class counts, confusion, hits, feature correlation, catalogue sweeps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.functions import ids
from resona.operators import pivots, ranking
from resona.operators.catalogue import subset
from resona.operators.distances import FEATURES, Feature, features_of
from resona.plans.recommend import recommend, recommend_sets

# fixed values: feature sets compared on cover versions
COVER_SETS = {
    "allf": ["chroma", "js", "rp", "rh", "bh", "skl", "notes", "mfcc"],
    "chroma": ["chroma"],
    "chroma_js": ["chroma", "js"],
    "chroma_js_rp": ["chroma", "js", "rp"],
    "chroma_mfcc": ["chroma", "mfcc"],
    "chroma_mfcc_rp": ["chroma", "mfcc", "rp"],
    "chroma_notes": ["chroma", "notes"],
    "chroma_notes_rp": ["chroma", "notes", "rp"],
    "chroma_rp": ["chroma", "rp"],
    "chroma_skl": ["chroma", "skl"],
    "chroma_skl_rp": ["chroma", "skl", "rp"],
    "mfcc_js_skl": ["mfcc", "js", "skl"],
    "mfcc_notes_rp": ["mfcc", "notes", "rp"],
    "notes": ["notes"],
    "notes_rp": ["notes", "rp"],
    "rp": ["rp"],
}

# fixed values: feature sets compared on genres
GENRE_SETS = {
    "allbut_melodic": ["rp", "rh", "bh", "mfcc", "skl", "js"],
    "js": ["js"],
    "js_mfcc": ["js", "mfcc"],
    "js_rp": ["js", "rp"],
    "js_skl_mfcc": ["js", "skl", "mfcc"],
    "mfcc": ["mfcc"],
    "mfcc_rp": ["mfcc", "rp"],
    "mfcc_skl": ["mfcc", "skl"],
    "mfcc_skl_rp": ["mfcc", "skl", "rp"],
    "skl": ["skl"],
    "skl_rp": ["skl", "rp"],
}


def neighbours_by_set(
    catalogue: DataFrame, queries: DataFrame, sets: dict[str, Sequence[str]], k: int
) -> DataFrame:
    """The k best other tracks per query and feature set (the query itself left out)."""
    names = [n for n in FEATURES if any(n in members for members in sets.values())]
    found = recommend_sets(catalogue, queries, features_of(names), sets, k + 1)
    others = found.filter(F.col("id") != F.col("query_id")).drop("rank")
    return ranking.top_k(others, k, "aggregated", per=("feature_set", "query_id"))


def with_classes(neighbours: DataFrame, classes: DataFrame) -> DataFrame:
    """Add the class of the query (`original`) and of the neighbour (`detected`)."""
    of_query = classes.select(F.col("id").alias("query_id"), F.col("class").alias("original"))
    of_track = classes.select("id", F.col("class").alias("detected"))
    return neighbours.join(of_query, "query_id").join(of_track, "id")


def detected_per_query(labelled: DataFrame) -> DataFrame:
    """How often each class was found per query."""
    return labelled.groupBy("feature_set", "query_id", "original", "detected").agg(
        F.count("*").alias("n")
    )


def confusion(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("feature_set", "original", "detected").agg(F.count("*").alias("n"))


def confusion_table(labelled: DataFrame, classes: Sequence) -> DataFrame:
    """One line per original class, one column per detected class."""
    wide = labelled.groupBy("feature_set", "original").pivot("detected", list(classes))
    return wide.agg(F.count(F.lit(1))).na.fill(0)


def confusion_rollup(labelled: DataFrame) -> DataFrame:
    """Counts with subtotals per original class and per feature set."""
    return labelled.rollup("feature_set", "original", "detected").agg(F.count("*").alias("n"))


def precision_at_k(labelled: DataFrame) -> DataFrame:
    """Same-class share of all retrieved tracks per feature set."""
    same = (F.col("original") == F.col("detected")).cast("int")
    return labelled.groupBy("feature_set").agg(
        F.count("*").alias("retrieved"),
        F.sum(same).alias("hits"),
        F.avg(same.cast("double")).alias("precision"),
    )


def cover_hits(labelled: DataFrame, classes: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Hits, precision and recall among the first k, per feature set.

    Recall divides by the versions there are: per query its class without the query itself.
    """
    sizes = classes.groupBy(F.col("class").alias("original")).agg((F.count("*") - 1).alias("others"))
    same = F.col("original") == F.col("detected")
    per_query = labelled.groupBy("feature_set", "query_id", "original").agg(
        *[F.sum((same & (F.col("rank") <= k)).cast("int")).alias(f"hits_{k}") for k in ks]
    )
    per_query = per_query.join(sizes, "original")
    out = [F.count("*").alias("queries")]
    for k in ks:
        hits = F.col(f"hits_{k}")
        out += [
            F.sum(hits).alias(f"hits_{k}"),
            F.avg(hits / k).alias(f"precision_{k}"),
            F.avg(F.try_divide(hits, F.col("others"))).alias(f"recall_{k}"),
        ]
    return per_query.groupBy("feature_set").agg(*out)


def evaluate_covers(catalogue: DataFrame, queries: DataFrame, classes: DataFrame, sets=None, ks=(1, 5)) -> DataFrame:
    found = neighbours_by_set(catalogue, queries, sets or COVER_SETS, max(ks))
    return cover_hits(with_classes(found, classes), classes, ks)


def neighbours_of_all(catalogue: DataFrame, feature: Feature, width: int, k: int) -> DataFrame:
    """The k nearest others of every track by one Euclidean feature, without comparing all pairs.

    Scaling one feature doesn't change its order, so this is the ranking of `neighbours_by_set` with every track as a query.
    """
    if feature.metric != "euclidean":
        raise ValueError("bounds by pivots need a Euclidean feature")
    found = pivots.nearest_of_all(pivots.cut(catalogue, feature.column, width, k))
    return found.select(F.lit(feature.name).alias("feature_set"), "query_id", "rank", "id", F.col("distance").alias("aggregated"))


def evaluate_genres(catalogue: DataFrame, queries: DataFrame, classes: DataFrame, sets=None, k: int = 10) -> DataFrame:
    found = neighbours_by_set(catalogue, queries, sets or GENRE_SETS, k)
    return confusion(with_classes(found, classes))


def classes_from_paths(results: DataFrame, root: str = "music/") -> DataFrame:
    """(id, class) from result rows whose id is a path with the class as first folder."""
    bare = ids.strip_prefix(F.col("id"), root)
    return results.select("id", ids.class_from_path(bare).alias("class"))


# From stored lists -----------------------------------------------------------------------


def labelled_lists(lists: DataFrame, classes: DataFrame, feature_set: str = "all") -> DataFrame:
    """Rows of stored lists (query, id, aggregated) with the classes of both tracks; the query's own row is left out.

    Works on a stream of list files as well: the classes are the only join.
    """
    rows = lists.select(
        F.lit(feature_set).alias("feature_set"), F.col("query").alias("query_id"), F.col("id").cast("string").alias("id"), "aggregated"
    )
    named = classes.select(F.col("id").cast("string").alias("id"), "class")
    return with_classes(rows.filter(F.col("id") != F.col("query_id")), named)


def among_first(labelled: DataFrame, k: int) -> DataFrame:
    """The k best rows of every stored list, with their rank among the other tracks."""
    return ranking.top_k(labelled, k, "aggregated", per=("feature_set", "query_id"))


def pair_hits(labelled: DataFrame, ks: Sequence[int]) -> DataFrame:
    """How often each class was found for each class among the first k: (feature_set, original, detected, hits_k)."""
    hits = [F.sum((F.col("rank") <= k).cast("long")).alias(f"hits_{k}") for k in ks]
    return labelled.groupBy("feature_set", "original", "detected").agg(*hits)


def correlation_matrix(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every two columns, long form, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = []
    for a, b in pairs:
        value = F.col(f"`{a}|{b}`").alias("correlation")
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), value))
    return one.select(F.inline(F.array(*entries)))


def sweep_sizes(total: int, step: int) -> list[int]:
    """Catalogue sizes of a sweep: all, then `step` rows fewer each time."""
    return list(range(total, 0, -step))


def size_sweep(
    catalogue: DataFrame, queries: DataFrame, features: Sequence[Feature], k: int, total: int, step: int = 10_000
) -> Iterator[tuple[int, DataFrame]]:
    """The same queries on ever smaller catalogues, for timing: (size, ranking)."""
    for size in sweep_sizes(total, step):
        yield size, recommend(subset(catalogue, size), queries, features, k)
