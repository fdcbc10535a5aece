"""Query lists of any length as rows: packed blocks of queries meet packed chunks of the catalogue.

Both sides are packed where they are, as Arrow bytes of bounded size: a chunk holds some hundred tracks, a
block up to `BLOCK_QUERIES` queries. Every chunk meets every block once, in one job; the pairs that are joined
are pairs of packed rows, never of tracks and queries. Building the plan starts no job and nothing of the queries passes
through the driver: Spark sends the blocks to the chunks where its own size limit allows a broadcast, and pairs
partitions beyond it.

Edit distances are a built-in expression on the pair of packed rows, everything else is compared in one NumPy block. A
distance depends on the two rows alone, so it has the same bits for a query alone and among thousands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from resona.operators import distances as D
from resona.operators import screen
from resona.operators.distances import Feature, QueryBatch

#: Queries of a block, tracks of a chunk, and bytes of either.
BLOCK_QUERIES, CHUNK_TRACKS, PACKED_BYTES = 256, 1024, 2 << 20
#: Cells (features x tracks x queries) compared at a time, and queries whose running results a task holds.
BLOCK_CELLS = 4_000_000
HELD_QUERIES = 200_000
#: Query lists that are sent to every task unasked (beyond it Spark decides at run time), and catalogues so small
#: that they are dealt out to all cores first; both by Spark's estimate.
SENT_BYTES, SPREAD_BYTES = 16 << 20, 32 << 20
#: Parts of a catalogue and of a long query list; every part meets every part, so a row is copied once per part of the other side.
#: Beyond these bytes (by Spark's estimate, where it has one) of a part there are more, up to `MOST_PARTS`.
TRACK_PARTS, QUERY_PARTS, PART_BYTES, MOST_PARTS = 8, 24, 64 << 20, 96
#: Blocks that a task keeps unpacked.
KEPT_BLOCKS = 32
#: Pairs (some dozen bytes each) that are sent to every task instead of shuffling the catalogue.
SENT_PAIRS = 500_000


def checked_id(catalogue: DataFrame, id_col: str) -> str:
    """The type of the ids, which are strings or integers."""
    kind = catalogue.schema[id_col].dataType
    if not isinstance(kind, (T.StringType, T.IntegralType)):
        raise TypeError("ids are strings or integers")
    return kind.simpleString()


def wanted(queries: DataFrame, columns: Sequence[str], id_col: str = "id", missing: str = "drop") -> DataFrame:
    """The queries to answer, one row per id: query_id and the columns."""
    columns = list(dict.fromkeys(columns))
    found = D.first_per_id(queries.filter(D._usable(columns, missing)), id_col, columns)
    return found.select(F.col(id_col).alias("query_id"), *columns)


def packed(rows: DataFrame, name: str, most: int, texts: Sequence[str] = ()) -> DataFrame:
    """Rows as Arrow bytes (`name`) with a key of their content; `texts` go beside them as arrays of strings."""
    places = [rows.columns.index(t) for t in texts]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(most, int(PACKED_BYTES * batch.num_rows // max(batch.nbytes, 1)))) if batch.num_rows else 1
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                data = sink.getvalue().to_pybytes()
                key = hashlib.blake2b(data, digest_size=16).digest()
                columns = [pa.array([key], pa.binary()), pa.array([data], pa.binary())]
                columns += [pa.array([part.column(p).to_pylist()], pa.list_(pa.string())) for p in places]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [f"{name}_key", name, *[f"{name}_{t}" for t in texts]]
    kinds = ["binary", "binary"] + ["array<string>"] * len(texts)
    return rows.mapInArrow(pack, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def estimated_bytes(rows: DataFrame) -> int:
    """Spark's estimate from the sources' sizes, without a job; filters are not taken off, unknown is very large."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def met(tracks: DataFrame, queries: DataFrame, texts: Sequence[Feature] = (), block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Every chunk of tracks with every block of queries: tracks, queries_key, queries and, per text feature, d_*.

    d_* are the edit distances of all tracks of the chunk (outer) to all queries of the block (inner).
    """
    names = list(dict.fromkeys(f.column for f in texts))
    if estimated_bytes(tracks) <= SPREAD_BYTES:
        tracks = tracks.repartition(tracks.sparkSession.sparkContext.defaultParallelism)
    chunks = packed(tracks, "tracks", CHUNK_TRACKS, names).drop("tracks_key")
    blocks = packed(queries, "queries", block_queries, names)

    def distances(f: Feature) -> Column:
        inner = F.col(f"queries_{f.column}")
        outer = F.col(f"tracks_{f.column}")
        far = F.lit(float("inf"))
        return F.transform(
            outer, lambda t: F.transform(inner, lambda q: F.coalesce(F.levenshtein(t, q).cast("double"), far))
        )

    if estimated_bytes(queries) <= SENT_BYTES:
        blocks = F.broadcast(blocks)
    pairs = chunks.crossJoin(blocks)  # of packed rows
    return pairs.select("tracks", "queries_key", "queries", *[distances(f).alias(f.distance) for f in texts])


Met = Iterator[tuple[screen.Rows, bytes, screen.Rows]]


def _dealt(rows: DataFrame, id_col: str, parts: int, name: str, most: int) -> DataFrame:
    """Rows packed by part (a hash of the id, so that a row's part doesn't depend on where it is): _part and the bytes."""
    part = F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")
    dealt = rows.withColumn("_part", part).repartition(4 * parts, "_part").sortWithinPartitions("_part")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_part").to_numpy()
            held = batch.drop_columns(["_part"])
            step = max(1, min(most, int(PACKED_BYTES * held.num_rows // max(held.nbytes, 1)))) if held.num_rows else 1
            ends = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for first, end in zip(ends, ends[1:]):
                for start in range(first, end, step):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(at[start])], pa.int32()), pa.array([_bytes(held.slice(start, min(step, end - start)))], pa.binary())], ["_part", name]
                    )

    return dealt.mapInArrow(pack, f"_part int, `{name}` binary")


def _bytes(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def beside(tracks: DataFrame, queries: DataFrame, work: Callable[[Met], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """`work` on groups (columns `tile`, `tracks` | `queries`) of packed rows: all chunks of a tile with all its blocks.

    The chunks of a tile stay unpacked while its blocks pass, and `work` gets block after block. Where chunks are numbered (`chunk`) a
    block meets those it lists (`chunks`).
    """
    arrow = to_arrow_schema(schema)

    def run(chunks: pa.Table, blocks: pa.Table) -> pa.Table:
        numbered = "chunk" in chunks.column_names
        names = chunks.column("chunk").to_pylist() if numbered else range(len(chunks))
        held = {c: screen.Rows(unpacked(x.as_buffer())) for c, x in zip(names, chunks.column("tracks"))}

        def each() -> Met:
            for place, x in enumerate(blocks.column("queries")):
                data = x.as_buffer()
                key, block = hashlib.blake2b(data, digest_size=16).digest(), screen.Rows(unpacked(data))
                for c in blocks.column("chunks")[place].as_py() if numbered else names:
                    yield held[c], key, block

        return pa.Table.from_batches([b.cast(arrow) for b in work(each())] if held else [], arrow)

    return tracks.groupBy("tile").cogroup(queries.groupBy("tile")).applyInArrow(run, schema)


def meet(
    tracks: DataFrame, queries: DataFrame, work: Callable[[Met], Iterator[pa.RecordBatch]], schema: T.StructType, long: bool,
    block_queries: int = BLOCK_QUERIES, sizes: tuple[int, int] = (0, 0),
) -> DataFrame:
    """`work` on every chunk of tracks beside every block of queries (`id`, `query_id`), spread over tasks.

    Short query lists are sent to the chunks. Of `long` ones every part meets every part of the catalogue in a tile of its own: rows
    are shuffled once per part of the other side, a number that doesn't grow with them, and a task holds one tile's chunks. `sizes` are
    Spark's estimates of both sides.
    """
    if not long:
        if sizes[0] <= SPREAD_BYTES:
            tracks = tracks.repartition(tracks.sparkSession.sparkContext.defaultParallelism)
        chunks = packed(tracks, "tracks", CHUNK_TRACKS).drop("tracks_key")
        blocks = F.broadcast(packed(queries, "queries", block_queries))
        together = chunks.crossJoin(blocks).select("tracks", "queries_key", "queries")  # of packed rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from work(_unpacked_pairs(batches))

        return together.mapInArrow(run, schema)
    ours, theirs = _parts(sizes[0], TRACK_PARTS), _parts(sizes[1], QUERY_PARTS)
    chunks = _dealt(tracks, "id", ours, "tracks", CHUNK_TRACKS)
    chunks = chunks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
    chunks = chunks.select((F.col("_part") * theirs + F.col("_other")).alias("tile"), "tracks")
    blocks = _dealt(queries, "query_id", theirs, "queries", block_queries)
    blocks = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(ours - 1))))
    blocks = blocks.select((F.col("_other") * theirs + F.col("_part")).alias("tile"), "queries")
    tiles = ours * theirs
    return beside(chunks.repartition(tiles, "tile"), blocks.repartition(tiles, "tile"), work, schema)


def _parts(size: int, least: int) -> int:
    return least if size >= 1 << 60 else min(MOST_PARTS, max(least, -(-size // PART_BYTES)))


def _unpacked_pairs(batches: Iterator[pa.RecordBatch]) -> Met:
    """Rows (tracks, queries_key, queries); a chunk is read once for the blocks that follow each other, blocks are kept."""
    last, chunk, seen = None, None, {}
    for batch in batches:
        for row in range(batch.num_rows):
            data = batch.column(0)[row].as_buffer()
            if last is None or not data.equals(last):
                last, chunk = data, screen.Rows(unpacked(data))
            key = batch.column(1)[row].as_py()
            if key not in seen:
                if len(seen) >= KEPT_BLOCKS:
                    seen.clear()
                seen[key] = screen.Rows(unpacked(batch.column(2)[row].as_buffer()))
            yield chunk, key, seen[key]


@dataclass
class Pair:
    """One chunk beside one block: the tracks, the queries, and which edit distances came with them."""

    tracks: pa.RecordBatch
    queries: pa.RecordBatch
    key: bytes
    batch: QueryBatch
    texts: dict[str, np.ndarray]

    def distances(self, features: Sequence[Feature], at: int = 0, n: int | None = None) -> np.ndarray:
        """(features, tracks, queries) of the tracks from `at` on."""
        part = self.tracks.slice(at, n)
        return np.stack([
            self.texts[f.name][at : at + part.num_rows] if f.name in self.texts
            else D.block_distances(f, part.column(f.column), self.batch.of(f))
            for f in features
        ])


def pairs(batches: Iterator[pa.RecordBatch], columns: Sequence[str], texts: Sequence[str]) -> Iterator[Pair]:
    """The rows of `met`; a block is read once for all chunks that follow each other."""
    seen: dict[bytes, tuple[pa.RecordBatch, QueryBatch]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            key = batch.column(1)[row].as_py()
            if key not in seen:
                if len(seen) >= 8:
                    seen.clear()
                queries = unpacked(batch.column(2)[row].as_buffer())
                values = {c: D._values(pa.chunked_array([queries.column(c)])) for c in columns}
                seen[key] = queries, QueryBatch(queries.column("query_id").to_pylist(), values)
            queries, known = seen[key]
            tracks = unpacked(batch.column(0)[row].as_buffer())
            found = {}
            for place, name in enumerate(texts, 3):
                cells = batch.column(place)[row].values.flatten().to_numpy(zero_copy_only=False)
                found[name] = cells.reshape(tracks.num_rows, len(known))
            yield Pair(tracks, queries, key, known, found)


def _split(features: Sequence[Feature]) -> tuple[list[Feature], list[str]]:
    texts = [f for f in features if f.metric == "levenshtein"]
    return texts, list(dict.fromkeys(f.column for f in features if f.metric != "levenshtein"))


def distance_rows(
    catalogue: DataFrame, queries: DataFrame, features: Sequence[Feature], id_col: str = "id", keep: Sequence[str] = (), missing: str = "drop"
) -> DataFrame:
    """Rows (query_id, id, kept columns, d_*) of every query and track, every distance unfiltered."""
    checked_id(catalogue, id_col)
    texts, vectors = _split(features)
    columns = list(dict.fromkeys(f.column for f in features))
    tracks = catalogue.select(F.col(id_col).alias("id"), *keep, *[c for c in columns if c not in keep])
    together = met(tracks, wanted(queries, columns, id_col, missing), texts)
    names = [f.name for f in texts]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in pairs(batches, vectors, names):
            m = len(pair.batch)
            step = max(1, BLOCK_CELLS // (m * len(features)))
            for at in range(0, pair.tracks.num_rows, step):
                block = pair.distances(features, at, step)
                track = pa.array(np.repeat(np.arange(block.shape[1]), m) + at)
                query = pa.array(np.tile(np.arange(m), block.shape[1]))
                held = [pair.tracks.column(c).take(track) for c in ("id", *keep)]
                arrays = [pair.queries.column("query_id").take(query), *held, *[pa.array(x.ravel()) for x in block]]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    schema = T.StructType([T.StructField("query_id", catalogue.schema[id_col].dataType), T.StructField("id", catalogue.schema[id_col].dataType)])
    for c in keep:
        schema = schema.add(c, catalogue.schema[c].dataType)
    for f in features:
        schema = schema.add(f.distance, "double")
    return together.mapInArrow(compare, schema)


def survivor_rows(
    catalogue: DataFrame, queries: DataFrame, left: DataFrame, features: Sequence[Feature], id_col: str = "id"
) -> DataFrame:
    """`left` (query_id, id, ...) with d_* of exactly these pairs. `left` is counted, so it should be stored.

    Tracks that no query has left are dropped by the join that brings each track the list of its queries, so only their
    columns of these features go on and only the cells of the list are compared. Up to `SENT_PAIRS` pairs are
    sent to the catalogue, more are joined by a shuffle.
    """
    checked_id(catalogue, id_col)
    texts, vectors = _split(features)
    sent = F.broadcast if left.count() <= SENT_PAIRS else lambda df: df
    rows = left
    if vectors:
        lists = left.groupBy("id").agg(F.collect_list("query_id").alias("_queries"))
        tracks = catalogue.select(F.col(id_col).alias("id"), *vectors).join(sent(lists), "id")
        compared = [f for f in features if f.metric != "levenshtein"]
        together = met(tracks, wanted(queries, vectors, id_col, "keep"))
        schema = T.StructType([left.schema["query_id"], left.schema["id"]])
        for f in compared:
            schema = schema.add(f.distance, "double")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pair in pairs(batches, vectors, []):
                place = {q: j for j, q in enumerate(pair.batch.ids)}
                lists = pair.tracks.column("_queries")
                track = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                query = np.array([place.get(q, -1) for q in lists.flatten().to_pylist()], np.int64)
                track, query = track[query >= 0], query[query >= 0]
                for j in np.unique(query).tolist():
                    rows = pa.array(track[query == j])
                    part = pair.tracks.take(rows)
                    blocks = [D.block_distances(f, part.column(f.column), [pair.batch.of(f)[j]])[:, 0] for f in compared]
                    ids = pair.queries.column("query_id").take(pa.array(np.full(len(rows), j)))
                    yield pa.RecordBatch.from_arrays([ids, part.column("id"), *map(pa.array, blocks)], schema.names)

        rows = rows.join(together.mapInArrow(compare, schema), ["query_id", "id"])
    for f in texts:
        ours = catalogue.select(F.col(id_col).alias("id"), F.col(f.column).alias("_track"))
        theirs = wanted(queries, [f.column], id_col).select("query_id", F.col(f.column).alias("_query"))
        far = F.coalesce(F.levenshtein("_track", "_query").cast("double"), F.lit(float("inf")))
        near = ours.join(sent(left.select("query_id", "id")), "id").join(theirs, "query_id").select("query_id", "id", far.alias(f.distance))
        rows = rows.join(near, ["query_id", "id"])
    return rows


class Best:
    """Running k best (score, id) of one query."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0), None

    @property
    def bound(self) -> float:
        return self.scores[-1] if len(self.scores) >= self.k else np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            near = scores <= np.partition(scores, self.k - 1)[self.k - 1]
            scores, ids = scores[near], ids[near]
        if self.ids is not None:
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Leaders:
    """A task's k best per query of the blocks it has met, for several lists side by side."""

    def __init__(self, names: Sequence[str], k: int, schema: T.StructType):
        self.names, self.k, self.columns = list(names), k, schema.names
        self.held: dict[bytes, tuple[pa.Array, dict[str, list[Best]], dict[str, np.ndarray]]] = {}
        self.queries, self.id_type = 0, None

    def offer(self, pair: Pair, name: str, scores: np.ndarray, at: int) -> None:
        """Scores (tracks, queries) of the tracks from `at` on; what is not finite takes no part."""
        if pair.key not in self.held:
            m = len(pair.batch)
            self.queries += m
            self.held[pair.key] = (
                pair.queries.column("query_id"),
                {n: [Best(self.k) for _ in range(m)] for n in self.names},
                {n: np.full(m, np.inf) for n in self.names},
            )
        ids = pair.tracks.column("id").slice(at, len(scores))
        self.id_type = ids.type
        keys = ids.to_numpy(zero_copy_only=False)
        _, leaders, bounds = self.held[pair.key]
        near = (scores <= bounds[name]) & np.isfinite(scores)
        for j in np.flatnonzero(near.any(axis=0)).tolist():
            leader = leaders[name][j]
            leader.offer(scores[near[:, j], j], keys[near[:, j]])
            bounds[name][j] = leader.bound

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is held, as (list, query_id, id, score); the task starts anew."""
        for queries, leaders, _ in self.held.values():
            for name, group in leaders.items():
                filled = [(j, x) for j, x in enumerate(group) if x.ids is not None]
                if not filled:
                    continue
                query = pa.array(np.repeat([j for j, _ in filled], [len(x.ids) for _, x in filled]))
                ids = pa.array([i for _, x in filled for i in x.ids.tolist()], self.id_type)
                scores = pa.array(np.concatenate([x.scores for _, x in filled]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(query)), queries.take(query), ids, scores], self.columns)
        self.held, self.queries = {}, 0

    def full(self) -> bool:
        return self.queries * len(self.names) > HELD_QUERIES


def best_of(
    together: DataFrame, columns: Sequence[str], texts: Sequence[str], names: Sequence[str], k: int, schema: T.StructType,
    score: Callable[[Pair], Iterator[tuple[str, np.ndarray, int]]],
) -> DataFrame:
    """The k best tracks per list and query of every task; `score(pair)` gives (list, scores, first track)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = Leaders(names, k, schema)
        for pair in pairs(batches, columns, texts):
            for name, scores, at in score(pair):
                leaders.offer(pair, name, scores, at)
            if leaders.full():
                yield from leaders.rows()
        yield from leaders.rows()

    return together.mapInArrow(best, schema)
