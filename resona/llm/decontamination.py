"""Benchmark decontamination as a prefix-filtered containment join; column functions only.

Every run of `WINDOW` words of an item is a window (a shorter item is one window). A window
occurs in a document only if its rarest word does, so that word is all the prefix that a
containment of 100% needs. Words are ordered by how often all documents use them; documents'
words meet the windows on the rarest one, the place of the word must leave room for the
window before and behind it (positional and length bounds), and the words around it are
compared one by one.

Windows are broadcast only if their number is below `BROADCAST_WINDOWS`; above that the
documents' words carry their surroundings into an ordinary join. Both give the same rows.

Defined cases: null or wordless texts and items have no words and no windows; equal rows give
equal results; an item that stands in the benchmark twice counts once; items without an id
make hits but are not named; documents with one doc_id and different texts are judged apart.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm.text import alnum_words
from resona.session import cut_lineage

WINDOW = 10
#: About 200 bytes each: a broadcast of some 40 MB at most.
BROADCAST_WINDOWS = 200_000


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (words, item) pairs; `words` has `size` words, or all words of a shorter item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text")).alias("all"))
    last = F.greatest(F.size("all") - size, F.lit(0))
    starts = items.where(F.size("all") > 0).select("item", "all", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return starts.select(F.slice("all", F.col("at") + 1, F.lit(size)).alias("words"), "item").distinct()


def windows_by_rarest_word(windows: DataFrame, docs: DataFrame, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """Distinct windows with an id, their rarest word over all documents and its first place."""
    distinct = windows.select("words").distinct()
    vocabulary = distinct.select(F.explode("words").alias("word")).distinct()
    used = docs.select(F.explode(alnum_words(F.col("text"))).alias("w"))
    if vocabulary.count() <= limit:
        used = used.join(F.broadcast(vocabulary), F.col("w") == F.col("word")).groupBy("word")
        counts = used.agg(F.count("*").alias("uses"))
    else:
        counts = used.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("uses"))
        counts = counts.join(vocabulary, "word")
    placed = distinct.select("words", F.posexplode("words").alias("place", "word"))
    placed = placed.join(counts, "word", "left")
    rarest = F.min_by(F.struct("word", "place"), F.struct(F.coalesce("uses", F.lit(0)), "word", "place"))
    chosen = placed.groupBy("words").agg(rarest.alias("rarest"))
    return chosen.select(
        F.xxhash64(F.array_join("words", " ")).alias("window"), "words",
        F.col("rarest.word").alias("rarest"), F.col("rarest.place").alias("place"),
    )


def occurrences(docs: DataFrame, windows: DataFrame, broadcast: bool, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, length, window) of every window in every document."""
    key = ["doc_id", F.xxhash64("text").alias("text_key")]
    words = docs.select(*key, alnum_words(F.col("text")).alias("all"))
    if broadcast:
        spread = words.select("*", F.posexplode("all").alias("at", "word"))
        first, windows = F.lit(0), F.broadcast(windows)
    else:
        spread = words.select("*", F.posexplode("all").alias("at", "word"))
        first = F.greatest(F.col("at") - (size - 1), F.lit(0))
        around = F.slice("all", first + 1, F.lit(2 * size - 1))
        spread = spread.select("doc_id", "text_key", around.alias("all"), "at", first.alias("first"), "word")
        first = F.col("first")
    start, length = F.col("at") - F.col("place"), F.size("words")
    fits = (start >= 0) & (start - first + length <= F.size("all"))
    same = F.slice("all", F.greatest(start - first, F.lit(0)) + 1, length) == F.col("words")
    met = spread.join(windows, F.col("word") == F.col("rarest")).where(fits & same)
    return met.select("doc_id", "text_key", start.alias("start"), length.alias("length"), "window")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row per document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = cut_lineage(item_windows(benchmark, size))
    known = cut_lineage(windows_by_rarest_word(windows, docs, limit))
    found = cut_lineage(occurrences(docs, known, known.count() <= limit, size))

    stretch = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    covered = F.aggregate(
        stretch,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], a["upto"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    hits = found.groupBy("doc_id", "text_key").agg(covered.cast("long").alias("n_hit"))
    named = windows.where("item is not null").select(F.xxhash64(F.array_join("words", " ")).alias("window"), "item")
    items = found.select("doc_id", "text_key", "window").distinct().join(named, "window")
    items = items.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = hits.alias("h").join(
        items.alias("i"),
        F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.text_key") == F.col("i.text_key")),
        "left",
    )
    hits = hits.select(F.col("h.doc_id").alias("hit_id"), F.col("h.text_key").alias("hit_key"), "n_hit", "items")
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words")
    )
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    return rows.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without any hit, with all their columns."""
    marked = contamination(docs, benchmark, size).where("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")
    )
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_key"))
    return docs.join(marked.distinct(), same, "left_anti")
