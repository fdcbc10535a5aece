"""Mixing sources to target weights along a time-varying curriculum; column functions only.

Sources, ordered by code point with null last, get the weights in turn. Targets share the
words of all documents by weight; none exceeds `most` times its source's size, and what is
over goes to the others by weight (water filling in closed form over sources sorted by the
level at which they are full). A source's stream is its documents in hash order, repeated in
whole epochs and then, up to the target, in part: a document belongs to the last, partial epoch
if its middle lies before the target, so a source misses its target by half a document at most.

Each weight class has a schedule, weights at knots of training progress with straight lines
between. A source's schedule integrated and scaled to its demand says how much of its stream is
due at any moment; inverting that turns an offset in the stream into a training position. Rows
are then sorted by range of position.

Defined cases: null or wordless texts have size 0 and are taken 0 times; sources of size 0 have
target 0; repeated rows are documents of their own; an empty table gives an empty result; other
columns are ignored. Equal positions are ordered by doc_id, null last, then epoch.

Running sums work on two levels, prefixes of the hash and rows of a prefix, with about as many
prefixes as rows in each, so a source with a third of all rows is dealt out like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.llm.text import word_count
from resona.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: By weight class: (progress, weight) knots. Heavy sources lead, light ones come late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, kind (its weight class) and target, from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("kind", (F.row_number().over(by_name) - 1) % len(weights))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    per = per.withColumn("cap", most * F.col("source_size"))
    per = per.withColumn("all_words", F.sum("source_size").over(everywhere))
    left = F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    full = F.col("cap") <= F.col("level") * F.col("weight")
    per = per.withColumn("open_level", F.when(~full, F.col("level")))
    level = F.max("open_level").over(everywhere)
    target = F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return per.select("source", "source_size", "kind", target.alias("target"), "all_words")


def progress(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The moment (0 to 1) at which the schedule has handed out `share` of its demand."""
    areas = [(a + b) / 2 * (t1 - t0) for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False)]
    total, done, parts = sum(areas), 0.0, []
    for (t0, a), (t1, b), area in zip(knots, knots[1:], areas, strict=False):
        if area:
            slope, due = (b - a) / (t1 - t0), share * total - done
            root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * due, F.lit(0.0)))
            parts.append((done + area, F.when(due <= 0, F.lit(t0)).otherwise(t0 + 2 * due / (a + root))))
            done += area
    at = F.least(parts[-1][1], F.lit(knots[-1][0]))
    for end, part in reversed(parts[:-1]):
        at = F.when(share * total <= end, part).otherwise(at)
    return at


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, most: int = 3) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken (words, repeats
    counted), epochs and positions (in words of training, one per copy taken)."""
    sizes = cut_lineage(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    )
    digits = max(1, math.ceil(math.log(max(sizes.count(), 2), 16) / 2))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sizes.withColumn("key", key).withColumn("prefix", F.substring("key", 1, digits))
    targets = cut_lineage(source_targets(sizes, weights, most))

    prefixes = rows.groupBy("source", "prefix").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = prefixes.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    sources = targets.select(F.col("source").alias("s"), "source_size", "kind", "target", "all_words")
    prefixes = prefixes.join(sources, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("p_source"), F.col("prefix").alias("p_prefix"), "before", "source_size", "kind", "target",
        "all_words",
    )
    rows = rows.join(
        prefixes, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("prefix") == F.col("p_prefix"))
    )
    inside = (
        Window.partitionBy("source", "prefix")
        .orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("offset", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("whole", whole.cast("long"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (F.col("size") > 0) & (2 * F.col("offset") + F.col("size") <= 2 * rest)
    rows = rows.withColumn("epochs", F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(0))
    rows = rows.withColumn("taken", F.col("size") * F.col("epochs"))

    def position(epoch: Column) -> Column:
        stream = epoch * F.col("source_size") + F.col("offset") + F.col("size") / 2
        share = F.least(stream / F.col("target"), F.lit(1.0))
        moment = progress(share, schedules[-1])
        for i, knots in reversed(list(enumerate(schedules[:-1]))):
            moment = F.when(F.col("kind") % len(schedules) == i, progress(share, knots)).otherwise(moment)
        return F.round(moment * F.col("all_words"), 3)

    epochs = F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)
    positions = F.when(F.col("epochs") > 0, F.transform(epochs, position))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "taken", "epochs",
        F.coalesce(positions, F.array().cast("array<double>")).alias("positions"),
    )


def in_order(mix: DataFrame) -> DataFrame:
    """`mix` range-sorted by the position of each document's first copy (untaken ones last)."""
    first = F.when(F.size("positions") > 0, F.element_at("positions", 1))
    rows = mix.withColumn("first_position", first)
    return rows.orderBy(F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def curriculum(mix: DataFrame) -> DataFrame:
    """The training order: a row per copy taken, range-sorted by position."""
    copies = mix.select("*", F.posexplode("positions").alias("epoch", "position")).drop("positions", "epochs")
    return copies.orderBy("position", F.col("doc_id").asc_nulls_last(), "epoch")
