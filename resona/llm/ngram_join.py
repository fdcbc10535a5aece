"""N-gram Jaccard self join with a vertically partitioned n-gram order.

A document's set holds its distinct five-word shingles by 64-bit hash (a shorter text has its whole
word sequence as one). Equal sets form classes; only classes are compared. The global order puts
rare n-grams first: frequencies come from a hashed count table of fixed size over all documents,
ties go by hash; the order is a number, so a set sorted by it can be cut into fragments anywhere.

1. Prefixes. Two sets of a similarity of at least `SHARE` percent have a common n-gram among the
   first n - ceil(SHARE * n) + 1 of each. Prefix n-grams meet by equality; length and position
   bounds drop pairs that can't reach the overlap.
2. Stars. Among the classes that share a prefix n-gram the one with the most frequent n-grams (an
   original rather than its copies) is the centre; pairs of centre and member are counted first.
3. Counting. The order is cut into `FRAGMENTS` ranges; a pair's overlap is counted range by range,
   a fragment of one set against the same fragment of the other, and summed per pair, so long
   documents and centres with many members are spread over fragments.
4. Rest. Classes linked so far form components. Pairs in different components that share a prefix
   n-gram, pass the bounds and were not counted are counted as well, so no link between different
   components is lost, while a large group of copies costs one pair per member.

Sets are computed from the texts in each pass instead of being kept: shingle hashes don't compress.
Which documents must send their set for counting is told by a bit table of fixed size (false hits
only send more).

Defined cases: null and wordless texts have empty sets, are linked with nothing and are components of
their own; rows with the same doc_id and different texts are different documents; equal rows are
linked; without doc_id a row counts, but never names a component that has another id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.llm.components import components
from resona.llm.text import Piece, mixed, pieces
from resona.session import cut_lineage

SIZE = 5
#: Least similarity in percent.
SHARE = 80
FRAGMENTS = 8
#: Cells of the frequency table and bits of the table of wanted documents.
CELLS = 1 << 19
BITS = 1 << 24


def sets(piece: Piece, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, document) pairs sorted by document and shingle, and where documents begin."""
    low = piece.lower
    value, doc = low.shingles(size)
    short = np.flatnonzero((low.n_words > 0) & (low.n_words < size))
    if len(short):
        h, owner = low.hashes, low.spans[2]
        place = np.searchsorted(owner, short)
        whole = np.array([np.bitwise_xor.reduce(mixed(h[p : p + n] + np.arange(1, n + 1, dtype=np.uint64)))
                          for p, n in zip(place, low.n_words[short], strict=True)], np.uint64)
        value, doc = np.concatenate((value, mixed(whole))), np.concatenate((doc, short))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
        value, doc = value[fresh], doc[fresh]
    return value, doc, np.searchsorted(doc, np.arange(len(piece) + 1))


def _keys(value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A number for each set; 0 for empty ones."""
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(value ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    total = running[edges[1:]] - running[edges[:-1]]
    n = np.diff(edges).astype(np.uint64)
    return np.where(n > 0, mixed(total + n), np.uint64(0)).view(np.int64)


def _cell(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(20)).astype(np.int64) % CELLS


def _ordered(value: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Shingles as numbers of the global order: frequency class, then hash. Not negative."""
    return (table[_cell(value)].astype(np.uint64) << np.uint64(55) | value >> np.uint64(9)).view(np.int64)


def fragment_edges(amount: np.ndarray, classes: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Cuts of the order into ranges of about equal numbers of occurrences."""
    per_class = np.bincount(classes, amount, 256)
    below = np.concatenate(([0.0], np.cumsum(per_class)))
    cuts = []
    for share in np.arange(1, fragments) / fragments:
        at = share * below[-1]
        c = min(int(np.searchsorted(below, at, side="right")) - 1, 255)
        inside = (at - below[c]) / per_class[c] if per_class[c] else 0.0
        cuts.append((c << 55) + int(inside * (1 << 55)))
    return np.array(cuts, np.int64)


def read_sets(docs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, text_key, n, key) of every document, the frequency classes of the cells and the cuts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.int64)
        names = ["doc_id", "text_key", "n", "key", "cells"]
        kind = None
        for batch in batches:
            kind = batch.schema
            n, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for piece in pieces(batch.column(2)):
                value, _, edges = sets(piece)
                table += np.bincount(_cell(value), minlength=CELLS)
                n.append(np.diff(edges))
                keys.append(_keys(value, edges))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(np.concatenate(x)) for x in (n, keys)), pa.nulls(batch.num_rows, pa.binary())],
                names,
            )
        if kind is not None:
            one = [pa.nulls(1, kind.field(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
            yield pa.RecordBatch.from_arrays([*one, pa.array([table.astype("<i4").tobytes()], pa.binary())], names)

    schema = docs.select("doc_id").schema
    for name, kind in (("text_key", "long"), ("n", "long"), ("key", "long"), ("cells", "binary")):
        schema = schema.add(name, kind)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    found = cut_lineage(rows.mapInArrow(read, schema))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for cells in batch.column(0).to_pylist():
                total += np.frombuffer(cells, "<i8" if len(cells) == 8 * CELLS else "<i4")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["cells"])

    tables = found.where("cells is not null").select("cells")
    while (parts := tables.rdd.getNumPartitions()) > 16:  # a tree of sums; one table of fixed size per task
        tables = tables.coalesce(max(1, parts // 8)).mapInArrow(add, "cells binary")
    amount = np.zeros(CELLS, np.int64)
    for row in tables.mapInArrow(add, "cells binary").toLocalIterator():
        amount += np.frombuffer(row.cells, "<i8")
    # 16 classes per doubling, so that frequency and not the cells' noise decides
    classes = np.minimum(16 * np.log2(np.maximum(amount, 1) / max(amount.mean(), 1) + 1), 255).astype(np.int64)
    return found.where("cells is null").drop("cells"), classes, fragment_edges(amount, classes)


def _prefix(n: np.ndarray, share: int = SHARE) -> np.ndarray:
    return n - -(-share * n // 100) + 1


def prefix_rows(docs: DataFrame, classes: np.ndarray, share: int = SHARE) -> DataFrame:
    """(token, key, size, place, weight) of every prefix n-gram, once per set and task."""
    send = docs.sparkSession.sparkContext.broadcast(classes.astype(np.uint8))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, met = send.value, set()
        for batch in batches:
            for piece in pieces(batch.column(0)):
                value, doc, edges = sets(piece)
                keys, n = _keys(value, edges), np.diff(edges)
                fresh = np.zeros(len(n), bool)
                for i in np.flatnonzero(n > 0):
                    if (key := int(keys[i])) not in met:
                        met.add(key)
                        fresh[i] = True
                token = _ordered(value, table)
                order = np.lexsort((token, doc))
                place = np.arange(len(token)) - edges[doc]  # documents keep their stretches
                wanted = fresh[doc] & (place < _prefix(n, share)[doc])
                weight = np.bincount(doc, table[_cell(value)], len(n)) * 64 / np.maximum(n, 1)
                own, rows = doc[wanted], order[wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[rows]), pa.array(keys[own]), pa.array(n[own].astype(np.int32)),
                     pa.array(place[wanted].astype(np.int32)), pa.array(weight[own].astype(np.int32))],
                    ["token", "key", "size", "place", "weight"],
                )

    rows = docs.select(F.col("text").cast("string"))
    return rows.mapInArrow(emit, "token long, key long, size int, place int, weight int")


def star_rows(prefixes: DataFrame) -> DataFrame:
    """Members of every n-gram that several sets share, each beside the n-gram's centre."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_now, key_now, centre = None, None, (0, 0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            token, key, size, place = (batch.column(i).to_numpy() for i in range(4))
            new = np.concatenate(([token_now != int(token[0])], token[1:] != token[:-1]))
            again = np.concatenate(([key_now == int(key[0])], key[1:] == key[:-1])) & ~new
            first = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            lead = [np.where(first < 0, c, x[first]) for c, x in zip(centre, (key, size, place), strict=True)]
            member = ~new & ~again & (lead[0] != key)
            token_now, key_now = int(token[-1]), int(key[-1])
            centre = tuple(int(x[-1]) for x in lead)
            if member.any():
                out = [x[member] for x in (token, key, size, place, *lead)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)],
                    ["token", "key", "size", "place", "centre", "centre_size", "centre_place"],
                )

    dealt = prefixes.repartition("token").sortWithinPartitions("token", F.desc("weight"), "key")
    return dealt.mapInArrow(
        emit, "token long, key long, size int, place int, centre long, centre_size int, centre_place int"
    )


def can_reach(size_a: Column, place_a: Column, size_b: Column, place_b: Column, share: int = SHARE) -> Column:
    """Whether two sets that share the n-grams at these places can have the similarity."""
    both = size_a + size_b
    length = 100 * F.least(size_a, size_b) >= share * F.greatest(size_a, size_b)
    # at the first common n-gram of a pair nothing before it counts, so there the pair is found
    most = F.least(size_a - place_a, size_b - place_b)
    return length & ((100 + share) * most.cast("long") >= share * both.cast("long"))


def reachable(common: Column, both: Column, larger: Column, share: int = SHARE) -> Column:
    """Whether `common` n-grams of the prefixes are enough: all others lie behind the prefix of one set."""
    behind = F.floor((share * larger + 99) / 100) - 1
    return (100 + share) * (common + behind) >= share * both


def star_pairs(stars: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b) of members and centres that can have the similarity. N-grams with another centre are
    not counted as common here; a pair that lacks them is left to the last step."""
    near = can_reach(F.col("size"), F.col("place"), F.col("centre_size"), F.col("centre_place"), share)
    pairs = stars.groupBy(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).agg(
        F.count("*").alias("common"), F.bool_or(near).alias("near"),
        F.max(F.col("size") + F.col("centre_size")).alias("both"), F.max(F.greatest("size", "centre_size")).alias("larger"),
    )
    return pairs.where(F.col("near") & reachable(F.col("common"), F.col("both"), F.col("larger"), share)).select("a", "b")


def open_pairs(lists: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b) of different components that can have the similarity, from (token, key, size, place, label).

    Pairs are met at n-grams that pass the bounds at their places; only then the prefixes of the
    two are compared whole, as arrays, for the number of n-grams they have in common.
    """
    a, b = (lists.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "size", "place", "label"))) for s in "ab")
    near = can_reach(F.col("size_a"), F.col("place_a"), F.col("size_b"), F.col("place_b"), share)
    met = a.join(b, "token").where((F.col("key_a") < F.col("key_b")) & (F.col("label_a") != F.col("label_b")) & near)
    met = met.groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(
        F.max(F.col("size_a") + F.col("size_b")).alias("both"), F.max(F.greatest("size_a", "size_b")).alias("larger")
    )
    whole = lists.groupBy("key").agg(F.collect_set("token").alias("tokens"))
    for side in "ab":
        met = met.join(whole.select(F.col("key").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return met.where(reachable(common, F.col("both"), F.col("larger"), share)).select("a", "b")


def overlaps(docs: DataFrame, pairs: DataFrame, known: DataFrame, classes: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """(a, b, common) for pairs of set keys; `known` has (key, who): the document to read a set from."""
    pairs = pairs.join(known.select(F.col("key").alias("a"), F.col("who").alias("who_a")), "a")
    pairs = cut_lineage(pairs.join(known.select(F.col("key").alias("b"), F.col("who").alias("who_b")), "b"))
    bit = F.pmod(F.col("who"), F.lit(BITS))
    needed = pairs.select(F.col("who_a").alias("who")).union(pairs.select("who_b")).distinct()
    words = needed.groupBy(F.shiftright(bit, 5).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(who, {BITS}) % 32 AS INT))")).alias("bits")
    )
    table = np.zeros(BITS // 32, np.uint32)  # at most BITS / 32 rows
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    send = docs.sparkSession.sparkContext.broadcast((classes.astype(np.uint8), cuts, table))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, cuts, table = send.value
        fragments = len(cuts) + 1
        for batch in batches:
            who = batch.column(0).to_numpy()
            place = np.mod(who, BITS)
            wanted = (table[place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(bool)
            who, texts = who[wanted], batch.column(1).filter(pa.array(wanted))
            for piece in pieces(texts):
                value, doc, edges = sets(piece)
                if not len(value):
                    continue
                keys = _keys(value, edges)
                token = _ordered(value, classes)
                order = np.lexsort((token, doc))
                token = token[order]
                group = doc * fragments + np.searchsorted(cuts, token, side="right")
                start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                of = group[start] // fragments
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(token)).astype(np.int32)), pa.array(token))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[piece.rows][of]), pa.array(keys[of]), pa.array((group[start] % fragments).astype(np.int32)), lists],
                    ["who", "key", "fragment", "tokens"],
                )

    rows = docs.select(F.xxhash64("doc_id").alias("who"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(emit, "who long, key long, fragment int, tokens array<long>")
    parts = parts.repartition("who", "key", "fragment")
    ranges = F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("fragment")
    left = parts.select(F.col("who").alias("who_a"), F.col("key").alias("a"), "fragment", F.col("tokens").alias("tokens_a"))
    right = parts.select(F.col("who").alias("who_b"), F.col("key").alias("b"), "fragment", F.col("tokens").alias("tokens_b"))
    met = pairs.select("*", ranges).join(right, ["who_b", "b", "fragment"]).join(left, ["who_a", "a", "fragment"])
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    counted = met.groupBy("a", "b", "fragment").agg(F.max(common).alias("common"))
    return counted.groupBy("a", "b").agg(F.sum("common").alias("common"))


def similar(counted: DataFrame, known: DataFrame, share: int = SHARE) -> DataFrame:
    """The (a, b) pairs that reach the similarity."""
    sizes = known.select("key", "n")
    counted = counted.join(sizes.select(F.col("key").alias("a"), F.col("n").alias("n_a")), "a")
    counted = counted.join(sizes.select(F.col("key").alias("b"), F.col("n").alias("n_b")), "b")
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return counted.where(100 * F.col("common") >= share * union).select("a", "b")


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """A row per document: doc_id, text_key, n_shingles, component_id (the least doc_id reachable
    by links) and first (whether the row is its component's first by doc_id and text_key)."""
    rows, classes, cuts = read_sets(docs)
    known = rows.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("least"), F.min(F.xxhash64("doc_id")).alias("any"))
    known = known.withColumn("who", F.when(F.col("least").isNull(), F.col("any")).otherwise(F.xxhash64("least")))
    known = cut_lineage(known.select("key", "n", "least", "who"))

    stars = cut_lineage(star_rows(prefix_rows(docs, classes, share)))
    first = cut_lineage(star_pairs(stars, share))
    links = cut_lineage(similar(overlaps(docs, first, known, classes, cuts), known, share))
    labels = components(links)

    # members and centres of n-grams whose sets are not all in one component yet
    lists = stars.select("token", "key", "size", "place").union(
        stars.select("token", "centre", "centre_size", "centre_place").distinct()
    )
    lists = lists.join(labels.withColumnRenamed("node", "key"), "key", "left")
    lists = lists.withColumn("label", F.coalesce("label", "key"))
    mixed_ = lists.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    lists = cut_lineage(lists.join(mixed_.select("token"), "token"))
    rest = open_pairs(lists, share)
    rest = cut_lineage(rest.join(first, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = similar(overlaps(docs, rest, known, classes, cuts), known, share)
        labels = components(links.union(more))

    joined = known.join(labels.withColumnRenamed("node", "key"), "key", "left")
    joined = joined.withColumn("label", F.coalesce("label", "key"))
    least = joined.groupBy("label").agg(F.min("least").alias("component"))
    named = joined.join(least, "label").select("key", "label", "component")
    out = rows.join(named, "key", "left")
    lead = out.where("n > 0").groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("lead")
    )
    out = out.join(lead, "label", "left")
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    return out.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | own.eqNullSafe(F.col("lead"))).alias("first"),
    )


def one_of_each(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents, with all their columns, that are first of their component; equal rows once."""
    rows = cut_lineage(near_duplicates(docs, share))
    gone = rows.where("not first").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    kept = docs.join(gone, same, "left_anti")
    twice = rows.where("first and n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    if twice.isEmpty():
        return kept
    full = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.where(full).dropDuplicates(["doc_id", "text"]).union(kept.where(~F.coalesce(full, F.lit(False))))
