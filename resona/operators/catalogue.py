"""Assembling, merging, de-duplicating, repairing and checking feature catalogues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.functions import ids


def first_per_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Per id its smallest row."""
    rest = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("_row")).select(id_col, "_row.*")


def assemble(
    features: Sequence[DataFrame], id_col: str = "id", how: str = "inner", repeated: str = "all"
) -> DataFrame:
    """One wide row per track out of one DataFrame per feature.

    Equal lines are dropped before the joins, where they are cheap; distinct inputs then have
    distinct join results. how="left" keeps the tracks of the first feature without the others.
    An id with several different rows in several features yields all their combinations;
    repeated="first" takes one row per id and feature instead.
    """
    if repeated not in ("all", "first"):
        raise ValueError(repeated)
    single = (lambda f: f.dropDuplicates()) if repeated == "all" else (lambda f: first_per_id(f, id_col))
    return reduce(lambda a, b: a.join(b, id_col, how), [single(f) for f in features])


def union_catalogues(first: DataFrame, *others: DataFrame) -> DataFrame:
    merged = reduce(lambda a, b: a.unionByName(b), others, first)
    return merged.dropDuplicates()


def removed_by_dedup(df: DataFrame) -> DataFrame:
    """The surplus copies that dropping equal rows takes away."""
    return df.exceptAll(df.dropDuplicates())


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys seen more than once, with their number of rows."""
    return key_counts(df, keys).filter(F.col("copies") > 1)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key repeats (a semi join; the planner sizes it)."""
    return df.join(duplicate_keys(df, keys).drop("copies"), list(keys), "left_semi")


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is seen exactly once.

    One aggregation carries the row along, so a key with very many copies shrinks to one row
    per task before the shuffle.
    """
    packed = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_row"))
    return packed.filter(F.col("_n") == 1).select("_row.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row that is last by `order` (which should break all ties)."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(last).select("_row.*")


def compare_with_first(df: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Every row of a repeated id beside the id's smallest row, for inspection.

    A full self join on the id would pair all copies; this is one line per copy.
    """
    first = df.groupBy(id_col).agg(
        F.count("*").alias("copies"), F.min(F.struct(*columns)).alias("_first")
    ).filter(F.col("copies") > 1)
    others = [F.col(f"_first.{c}").alias(f"first_{c}") for c in columns]
    return df.select(id_col, *columns).join(first, id_col).select(id_col, "copies", *columns, *others)


def validation_report(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One line: rows, ids, ids seen once, rows with repeated ids, distinct rows."""
    by_row = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    by_id = by_row.groupBy(id_col).agg(F.sum("_copies").alias("_rows"), F.count("*").alias("_distinct"))
    once = F.col("_rows") == 1
    return by_id.agg(
        F.sum("_rows").alias("rows"),
        F.count("*").alias("ids"),
        F.sum(once.cast("bigint")).alias("unique_ids"),
        F.sum(F.when(once, 0).otherwise(F.col("_rows"))).alias("rows_of_repeated_ids"),
        F.sum("_distinct").alias("distinct_rows"),
    )


def subset(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """n rows, the same ones every time: the first by the MD5 of the id.

    Counts per hash slot tell which slots are needed whole; only the one slot on the border is
    sorted, so n may be in the millions.
    """
    rank = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    slot = F.conv(F.substring(rank, 1, 4), 16, 10).cast("int")  # 65536 of them, in the order of the hash
    counts = df.select(slot.alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    table = counts.orderBy("slot").toArrow()  # at most 65536 pairs of numbers
    upto = np.cumsum(table["n"].to_numpy())
    at = int(np.searchsorted(upto, n))
    if at == len(upto):
        return df
    if n <= 0:
        return df.limit(0)
    border = int(table["slot"][at].as_py())
    before = int(upto[at - 1]) if at else 0
    edge = df.filter(slot == border).orderBy(rank, F.col(id_col)).limit(n - before)
    return df.filter(slot < border).unionByName(edge)


def id_consistency(features: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """Per id that is missing or repeated in some feature: how often each feature has it."""
    long = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(F.col(id_col).alias("id"), F.lit(name).alias("feature")) for name, df in features.items()],
    )
    counts = [F.sum((F.col("feature") == name).cast("int")).alias(name) for name in features]
    wide = long.groupBy("id").agg(*counts)
    off = reduce(lambda a, b: a | b, [F.col(name) != 1 for name in features])
    return wide.filter(off)


def id_counts(features: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """Rows, ids and repeated ids per feature."""
    parts = []
    for name, df in features.items():
        per_id = df.groupBy(id_col).agg(F.count("*").alias("c"))
        parts.append(
            per_id.agg(
                F.lit(name).alias("feature"),
                F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("rows"),
                F.count("*").alias("ids"),
                F.count(F.when(F.col("c") > 1, 1)).alias("repeated_ids"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def common_ids(features: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """Ids that every feature has."""
    return reduce(lambda a, b: a.intersect(b), [f.select(id_col) for f in features])


def restrict(df: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in `wanted`, ordered by id."""
    return df.join(wanted.select(id_col), id_col, "left_semi").orderBy(id_col)


def not_yet_done(candidates: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids still to be processed."""
    return candidates.join(done.select(id_col), id_col, "left_anti")


def part_of(df: DataFrame, part: int, parts: int, id_col: str = "id") -> DataFrame:
    """The rows of one worker when work is dealt out over `parts`."""
    return df.filter(ids.batch_of(F.col(id_col), parts) == part)


def with_batch(df: DataFrame, parts: int, id_col: str = "id") -> DataFrame:
    return df.withColumn("batch", ids.batch_of(F.col(id_col), parts))


# Metadata ------------------------------------------------------------------------------------


def enrich(catalogue: DataFrame, metadata: DataFrame, id_col: str = "id", how: str = "inner") -> DataFrame:
    return catalogue.join(metadata, id_col, how)


def star(fact: DataFrame, *dimensions: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Inner joins with (dimension, key columns) one after the other; the planner picks each kind."""
    return reduce(lambda df, d: df.join(d[0], list(d[1])), dimensions, fact)


def text_key(col: Column) -> Column:
    return F.lower(F.trim(col))


def join_by_text(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on several text columns, case and outer blanks aside; left spelling wins."""
    keys = [f"_k{i}" for i in range(len(columns))]
    a = left.withColumns({k: text_key(F.col(c)) for k, c in zip(keys, columns)})
    b = right.withColumns({k: text_key(F.col(c)) for k, c in zip(keys, columns)}).drop(*columns)
    return a.join(b, keys, how).drop(*keys)


def align_labels(
    features: DataFrame, labels: DataFrame, strip: bool = False, lower: bool = False, id_col: str = "id"
) -> DataFrame:
    """Features with their class: ids matched, optionally without folder, extension and case."""

    def key(col: Column) -> Column:
        if strip:
            col = ids.strip_extension(ids.base_name(col))
        return F.lower(col) if lower else col

    wanted = labels.select(key(F.col(id_col)).alias("_key"), *[c for c in labels.columns if c != id_col])
    return features.withColumn("_key", key(F.col(id_col))).join(wanted, "_key").drop("_key").orderBy(id_col)


def match_report(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """One line: ids on each side, ids on both."""
    a = left.select(F.col(id_col).alias("id"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(F.col(id_col).alias("id"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    sides = a.unionByName(b).groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.sum("l").alias("left_ids"),
        F.sum("r").alias("right_ids"),
        F.sum(F.col("l") * F.col("r")).alias("matching"),
    )
