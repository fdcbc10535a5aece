"""Line dedup by prefix doubling over line-ID sequences.

Every line is a number (64-bit hash). Suffixes of documents' line sequences are ranked by their
first line, then by their first 2, 4, 8 ... lines: the rank of twice the length is that of the pair of
ranks at p and p + 2^k, found by a range sort of the distinct pairs. Only pairs that occur twice go
on, so a round holds the suffixes inside intervals of a common prefix of at least that length and
nothing else. Two overlapping ranks tell any run of lines apart, so suffixes with a common prefix of
any length n share the key (n, rank at p, rank at p + n - 2^k).

A run is a passage if it has at least `MIN_WORDS` words. A passage that stands at an earlier place
(order: doc_id, then text, then line) is deleted. Any such passage is covered by those that are the
shortest from their first or up to their last line; the common-prefix intervals are looked up for
these, two per line, and their union is what the maximal repeated runs cover.

The text left is that of the remaining lines. Nothing else of a document is touched, also if no line
remains. Defined cases: null and wordless texts stay as they are; rows with one doc_id and different
texts are different documents; equal rows are one document and keep equal texts; a passage repeated
inside a document loses its later copies as well; an empty table gives an empty result; columns other
than text and n_chars (set to the new length) are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.llm.text import mixed, pieces, span_hashes
from resona.session import cut_lineage

MIN_WORDS = 50
_DOC = ["doc_id", "text_key"]


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, line, id, words, ahead, behind): `ahead` is the least number of lines from
    this one on with `min_words` words, `behind` of those up to this one; 0 if there are not as many."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                breaks = piece.data == 10
                owner = np.concatenate((np.arange(len(piece)), np.searchsorted(piece.offsets, np.flatnonzero(breaks), side="right") - 1))
                starts = np.concatenate((piece.offsets[:-1], np.flatnonzero(breaks) + 1))
                order = np.lexsort((starts, owner))
                owner, starts = owner[order], starts[order]
                last = np.concatenate((owner[1:] != owner[:-1], [True]))
                ends = np.where(last, piece.offsets[owner + 1], np.concatenate((starts[1:], [0])) - 1)
                ids = np.zeros(len(starts), np.uint64)
                full = ends > starts
                ids[full] = span_hashes(piece.data, starts[full], ends[full])
                word_at = piece.spans[0]
                words = np.searchsorted(word_at, ends) - np.searchsorted(word_at, starts)
                total = np.concatenate(([0], np.cumsum(words)))
                first = np.searchsorted(owner, np.arange(len(piece)))
                at, lines = np.arange(len(starts)), np.bincount(owner, minlength=len(piece))
                # the first place after which enough words have been seen, the last before which they have not
                stop = np.searchsorted(total, total[:-1] + min_words)
                ahead = np.where(stop <= (first + lines)[owner], stop - at, 0)
                begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
                behind = np.where(begin >= first[owner], at + 1 - begin, 0)
                rows = pa.array(owner + piece.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - first[owner]).astype(np.int32)),
                     pa.array(mixed(ids).view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (words, ahead, behind))],
                    [*_DOC, "line", "id", "words", "ahead", "behind"],
                )

    schema = docs.select("doc_id").schema.add("text_key", "long").add("line", "integer").add("id", "long")
    for name in ("words", "ahead", "behind"):
        schema = schema.add(name, "integer")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, schema)


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def _doubled(ranks: DataFrame, reach: int) -> DataFrame:
    """Ranks by twice as many lines, for suffixes whose first 2 * reach lines occur twice or more."""
    ahead = Window.partitionBy(*_DOC).orderBy("line").rangeBetween(reach, reach)
    pairs = ranks.withColumn("next", F.max("rank").over(ahead)).where("next is not null")
    often = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select("rank", "next")
    # increasing in (rank, next): partitions are ranges in order, rows inside them are sorted
    often = often.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next")
    named = cut_lineage(often.withColumn("longer", F.monotonically_increasing_id()))
    return cut_lineage(pairs.join(named, ["rank", "next"]).select(*_DOC, "line", F.col("longer").alias("rank")))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, gone): the numbers of the lines that stand in passages with an earlier copy."""
    lines = line_table(docs, min_words).dropDuplicates([*_DOC, "line"])
    lines = cut_lineage(lines.select(*_DOC, "line", "id", "ahead", "behind"))
    often = lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    lines = cut_lineage(lines.join(often, "id", "left_semi"))
    runs = lines.where("ahead > 0").select(*_DOC, F.col("line").alias("start"), F.col("ahead").alias("n"))
    ends = lines.where("behind > 0").select(*_DOC, (F.col("line") - F.col("behind") + 1).alias("start"), F.col("behind").alias("n"))
    runs = cut_lineage(runs.union(ends).distinct())

    ranks, reach, found = lines.select(*_DOC, "line", F.col("id").alias("rank")), 1, []
    while True:
        own = runs.where((F.col("n") >= reach) & (F.col("n") < 2 * reach))
        head = ranks.withColumnsRenamed({"line": "start", "rank": "head"})
        own = own.alias("r").join(head.alias("h"), _same_doc("r", "h") & (F.col("r.start") == F.col("h.start")))
        own = own.select("r.*", "h.head")
        if reach == 1:
            own = own.withColumn("tail", F.col("head"))
        else:
            tail = ranks.select(*_DOC, (F.col("line") + reach).alias("end"), F.col("rank").alias("tail"))
            own = own.alias("r").join(tail.alias("t"), _same_doc("r", "t") & (F.col("r.start") + F.col("r.n") == F.col("t.end")))
            own = own.select("r.*", "t.tail")
        own = cut_lineage(own)
        place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "start")
        key = ["n", "head", "tail"]
        first = own.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
        later = own.join(first, key).where(place != F.col("first"))
        inside = F.explode(F.expr("sequence(start, start + n - 1)")).alias("line")
        found.append(cut_lineage(later.select(*_DOC, inside).distinct()))
        reach *= 2
        if runs.where(F.col("n") >= reach).isEmpty():
            break
        ranks = _doubled(ranks, reach // 2)
        if ranks.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy(*_DOC).agg(F.collect_set("line").alias("gone"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without later copies of passages, and n_lines and n_deleted beside them."""
    gone = repeated_passages(docs, min_words).select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), F.col("gone").alias("gone_lines")
    )
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    rows = docs.drop("n_lines", "n_deleted", "gone_id", "gone_key", "gone_lines").join(gone, same, "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone_lines"))
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    changed = F.col("gone_lines").isNotNull()
    rows = rows.withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_deleted", F.coalesce(F.when(changed, F.size("gone_lines")), F.lit(0)).cast("long"))
    rows = rows.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        rows = rows.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars")))
    return rows.drop("gone_id", "gone_key", "gone_lines")
