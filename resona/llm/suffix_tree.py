"""Language-model scores from a probabilistic suffix tree.

A text is read as its lower-cased words, each closed by a space, and one end. The tree's symbols
are the bytes of that sequence. Every context of up to `DEPTH` symbols that training texts have is a
candidate, however rare, so the tree grows with the input. A candidate is retained if its next-symbol
distribution departs from that of its suffix: count times Kullback-Leibler divergence reaches
`DIVERGENCE` nats (or a longer retained context ends with it). Distributions are smoothed towards
the suffix's. Each symbol is predicted by the longest suffix of what precedes it that is a state.

The tree is never in one place: a gram is a context and the symbol after it, a row with its count.
Contexts of up to `TOP` symbols are shared by all: 256 ** 3 grams at most, of which the driver sees the 256 ** 2
shortest. All longer contexts with the same last `TOP` + 1 symbols are one subtree, which is grown where its grams
are; subtrees are dealt into parts of about `PART` grams.

Each block of documents asks every part for its distinct grams by one packed row and gets one packed row of
predictions. A part's predictions precede the questions in one sorted stream, so a task holds one part and one
question at a time, whatever the number of blocks.

A text's score is the sum over its symbols, so it is the probability of its token sequence. Beside it
stands a base score from the counts of whole words, which are asked for in the same way. Documents are dealt by hash
into blocks of some megabytes; no word or gram, however frequent, stands in more rows than there are blocks.

Words are compared by 64-bit hash. Defined cases: null and empty texts have the end as their only
token; rows without doc_id are training rows; repeated rows count each; without training rows known
words are none and N is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resona.llm.text import Piece, mixed, pieces
from resona.session import cut_lineage

DEPTH = 5
DIVERGENCE = 20.0
#: Weight of the suffix's distribution, in observations.
SMOOTHING = 4.0
BLOCK_BYTES, BLOCKS = 16 << 20, 24
#: Context symbols of the shared top of the tree, and keys of a part.
TOP, PART = 2, 1 << 17
#: Rows of the top that are sent to every task; beyond it they are joined by a shuffle.
SENT_ROWS = 500_000
_GRAM, _WORD = 0, 1
_END, _GAP = 10, 32
#: Stands for the end among word hashes.
_END_WORD = np.uint64(0)


def sequence(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, how many of its text stand before each, and the place of every text's end."""
    low = piece.lower
    starts, ends, doc = low.spans
    size = ends - starts
    before = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    at = before + doc
    stops = np.concatenate(([0], np.cumsum(np.bincount(doc, size + 1, len(piece)).astype(np.int64) + 1)))[1:] - 1
    out = np.full(int(stops[-1]) + 1 if len(stops) else 0, _GAP, np.uint8)
    if len(starts):
        inner = np.arange(int(size.sum())) - np.repeat(np.concatenate(([0], np.cumsum(size)))[:-1], size)
        out[np.repeat(at, size) + inner] = low.data[np.repeat(starts, size) + inner]
    out[stops] = _END
    first = np.concatenate(([0], stops + 1)).astype(np.int64)
    return out, np.arange(len(out)) - np.repeat(first[:-1], np.diff(first)), stops


def preceding(symbols: np.ndarray, before: np.ndarray, back: int) -> np.ndarray:
    """The symbol `back` places earlier in the same text; ends stand before a text."""
    out = np.full(len(symbols), _END, np.uint8)
    out[back:] = symbols[: max(len(symbols) - back, 0)]
    out[before < back] = _END
    return out


def grams(symbols: np.ndarray, before: np.ndarray, size: int) -> np.ndarray:
    """The last `size` symbols at every place as one number."""
    out = np.zeros(len(symbols), np.int64)
    for back in range(size - 1, -1, -1):
        out = out << 8 | preceding(symbols, before, back)
    return out


def _edges(ordered: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; sorting integers is several times faster here than `unique`."""
    ordered = np.sort(keys)
    return ordered[_edges(ordered)]


def _places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """`searchsorted` of grams (48 bits) in any order: runs are sorted first, with their places in the low bits."""
    out = np.empty(len(wanted), np.int64)
    for at in range(0, len(wanted), 1 << 15):
        part = wanted[at : at + (1 << 15)]
        order = np.sort(part << 15 | np.arange(len(part)))
        out[at + (order & 0x7FFF)] = np.searchsorted(known, order >> 15)
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, amount = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every)
    every = every[order]
    first = np.flatnonzero(_edges(every))
    return every[first], np.add.reduceat(amount[order], first) if len(first) else amount


def tally(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): grams and word hashes, and how often they stand in texts that are not held out.

    Grams that only held-out texts have are there with 0, words are not.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[list[np.ndarray]]] = [[[], []], [[], []]]

        def add(kind: int, keys: np.ndarray, n: np.ndarray) -> None:
            waiting[kind][0].append(keys)
            waiting[kind][1].append(n)
            if len(waiting[kind][0]) > 1 and sum(map(len, waiting[kind][0])) > max(3_000_000, 2 * len(waiting[kind][0][0])):
                waiting[kind][:] = [[x] for x in _summed(*waiting[kind])]

        for batch in batches:
            train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for piece in pieces(batch.column(0)):
                symbols, before, stops = sequence(piece)
                of = train[piece.rows]
                taught = np.repeat(of, np.diff(np.concatenate(([0], stops + 1))))
                every = grams(symbols, before, depth + 1)
                add(_GRAM, *np.unique(every[taught], return_counts=True))
                held = _distinct(every[~taught])
                add(_GRAM, held, np.zeros(len(held), np.int64))
                add(_WORD, *np.unique(piece.lower.hashes[of[piece.lower.spans[2]]].view(np.int64), return_counts=True))
                if of.any():
                    add(_WORD, np.array([_END_WORD]).view(np.int64), np.array([of.sum()]))
        for kind, (keys, counts) in enumerate(waiting):
            if not keys:
                continue
            key, n = _summed(keys, counts)
            for at in range(0, len(key), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key[part]), kind, np.int32)), pa.array(key[part]), pa.array(n[part])], ["kind", "key", "n"]
                )

    counted = rows.select(F.col("text").cast("string"), "held_out").mapInArrow(count, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _low(size: int) -> int:
    return (1 << 8 * size) - 1


def _last(size: int) -> Column:
    """The last `size` symbols of a gram."""
    return F.col("gram").bitwiseAND(F.lit(_low(size)).cast("long"))


#: Spreads neighbouring contexts over the parts.
_SPREAD = 2654435761


def _gram_part(parts: int) -> Column:
    root = F.shiftright("gram", 8).bitwiseAND(F.lit(_low(TOP + 1)).cast("long"))
    return F.shiftright(root * F.lit(_SPREAD), 16) % F.lit(parts)


def _parts(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of every key, as `_gram_part` has it for grams."""
    if kind == _WORD:
        return (mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    return (((keys >> 8) & _low(TOP + 1)) * _SPREAD >> 16) % parts


def _smoothed(n: np.ndarray, every: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed probabilities and the terms of the divergence."""
    safe = np.where(n > 0, n, 1)
    gain = np.where(n > 0, n * np.log(safe / np.maximum(every, 1) / base), 0.0)
    return (n + SMOOTHING * base) / (every + SMOOTHING), gain


def subtree(gram: np.ndarray, n: np.ndarray, base: np.ndarray, depth: int, divergence: float):
    """Whole subtrees from their grams, counts and the last symbols' probabilities after `TOP` symbols.

    Gives the states as (size << 48 | context), and for every gram log10 of its probability after the longest state and
    whether there is one here; where there is none it is log10 of `base`.
    """
    known, first = np.unique(gram & _low(TOP + 1), return_index=True)
    p = base[first]
    levels = []
    for size in range(TOP + 1, depth + 1):
        keys, place = np.unique(gram & _low(size + 1), return_inverse=True)
        times = np.bincount(place, n, len(keys))
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        p, gain = _smoothed(times, np.bincount(of, times, len(contexts))[of], p[np.searchsorted(known, keys & _low(size))])
        levels.append((size, p[place], contexts, of[place], np.bincount(of, gain, len(contexts)) >= divergence))
        known = keys
    states, longer = [], np.empty(0, np.int64)
    value, found = np.log10(base), np.zeros(len(gram), bool)
    for size, after, contexts, of, passed in reversed(levels):
        kept = passed | np.isin(contexts, longer & _low(size))
        longer = contexts[kept]
        states.append(size << 48 | longer)
        here = kept[of] & ~found
        value[here] = np.log10(after[here])
        found |= here
    return np.concatenate(states) if states else longer, value, found


def _top(counts: DataFrame, divergence: float):
    """The shared top: p of one and of two symbols, which contexts of one and of two symbols pass, and (gram, p) of three."""
    three = cut_lineage(counts.groupBy(_last(TOP + 1).alias("gram")).agg(F.sum("n").alias("n")))
    pairs = np.zeros((256, 256))
    for key, n in three.groupBy(_last(2).alias("gram")).agg(F.sum("n")).collect():  # at most 256 ** 2 rows
        pairs[key >> 8, key & 255] = n
    one = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * 256)
    two, gain = _smoothed(pairs, pairs.sum(axis=1, keepdims=True), one[None, :])
    passed_one, flat = gain.sum(axis=1) >= divergence, two.ravel()

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, n, every = (c.to_numpy() for c in batch.columns)
            p, gain = _smoothed(n, every, flat[gram & 0xFFFF])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(gain)], ["gram", "p", "gain"])

    every = F.sum("n").over(W.partitionBy(F.shiftright("gram", 8)))  # 256 rows each
    level = cut_lineage(three.select("gram", "n", every.alias("every")).mapInArrow(smooth, "gram long, p double, gain double"))
    passed_two = np.zeros(1 << 16, bool)
    context = F.shiftright("gram", 8).alias("context")
    for row in level.groupBy(context).agg(F.sum("gain").alias("gain")).where(F.col("gain") >= divergence).collect():
        passed_two[row.context] = True  # at most 256 ** 2 rows
    return one, flat, passed_one, passed_two, level.select("gram", "p")


def grow(counts: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE) -> tuple[DataFrame, DataFrame]:
    """(part, keys, values): all grams with log10 of their last symbol after the longest state, packed by part; and the
    states (size, context) except the root. `counts` (gram, n) is read more than once, so it should be stored.

    p is smoothed: (n + SMOOTHING * p of the gram without its oldest symbol) / (count of the context + SMOOTHING).
    """
    spark = counts.sparkSession
    parts = part_count(counts.count())
    one, two, passed_one, passed_two, level = _top(counts, divergence)
    near = level.select(F.col("gram").alias("short"), F.col("p").alias("base"))
    if level.count() <= SENT_ROWS:
        near = F.broadcast(near)
    dealt = counts.join(near, _last(TOP + 1) == F.col("short")).select(_gram_part(parts).alias("part"), "gram", "n", "base")

    def whole(left: pa.Table) -> pa.Table:
        left = left.sort_by("gram")
        gram, n, base = (left.column(c).to_numpy() for c in ("gram", "n", "base"))
        states, value, found = subtree(gram, n, base, depth, divergence)
        cells = [[left.column("part")[0].as_py()], [packed(gram)], [value.tobytes()], [found.tobytes()], [states]]
        return pa.table(dict(zip(("part", "keys", "values", "found", "states"), cells, strict=True)), grown)

    grown = pa.schema({"part": pa.int64(), "keys": pa.binary(), "values": pa.binary(), "found": pa.binary(), "states": pa.list_(pa.int64())})
    deep = cut_lineage(
        dealt.groupBy("part").applyInArrow(whole, "part long, keys binary, values binary, found binary, states array<long>")
    )
    state = deep.select(F.explode("states").alias("state"))
    size, context = F.shiftright("state", 48), F.col("state").bitwiseAND(F.lit(_low(6)).cast("long"))
    ends = state.where(size == TOP + 1).select(context.bitwiseAND(F.lit(_low(TOP)).cast("long")).alias("context")).distinct()
    kept_two = passed_two.copy()
    kept_two[[row.context for row in ends.collect()]] = True  # at most 256 ** 2 rows
    kept_one = passed_one | kept_two.reshape(256, 256).any(axis=0)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                gram = unpacked(batch.column(1)[row].as_py())
                value = np.frombuffer(batch.column(2)[row].as_py(), np.float64)
                found = np.frombuffer(batch.column(3)[row].as_py(), bool)
                after_one = np.where(kept_one[gram >> 8 & 255], two[gram & 0xFFFF], one[gram & 255])
                value = np.where(found | kept_two[gram >> 8 & 0xFFFF], value, np.log10(after_one))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([value.tobytes()])], names)

    names = ["part", "keys", "values"]
    filled = deep.select(*names, "found").mapInArrow(fill, "part long, keys binary, values binary")
    short = [(1, int(c)) for c in np.flatnonzero(kept_one)] + [(2, int(c)) for c in np.flatnonzero(kept_two)]
    top = spark.createDataFrame(short, "size int, context long")
    return filled, top.unionByName(state.select(size.cast("int").alias("size"), context.alias("context")))


def part_count(keys: int) -> int:
    return max(1, -(-keys // PART))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte by byte of all, which compresses well."""
    steps = np.diff(keys, prepend=np.int64(0)).astype(np.int64)
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _word_answers(counts: DataFrame, parts: int) -> DataFrame:
    """(part, keys, values): word hashes with their counts, packed by part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(_parts(_WORD, batch.column(0).to_numpy(), parts))
            yield pa.RecordBatch.from_arrays([part, *batch.columns], ["part", "key", "n"])

    def whole(left: pa.Table) -> pa.Table:
        left = left.sort_by("key")
        keys, n = left.column("key").to_numpy(), left.column("n").to_numpy()
        return pa.table({"part": [left.column("part")[0].as_py()], "keys": [packed(keys)], "values": [n.tobytes()]})

    dealt = counts.mapInArrow(deal, "part long, key long, n long")
    return dealt.groupBy("part").applyInArrow(whole, "part long, keys binary, values binary")


def _asked(texts: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """The distinct keys of a block, sorted."""
    found = {_GRAM: [np.empty(0, np.int64)], _WORD: [np.array([_END_WORD]).view(np.int64)]}
    for piece in pieces(texts):
        found[_GRAM].append(_distinct(grams(*sequence(piece)[:2], DEPTH + 1)))
        found[_WORD].append(_distinct(piece.lower.hashes.view(np.int64)))
    return {kind: _distinct(np.concatenate(keys)) for kind, keys in found.items()}


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, part, block, keys, values) sorted by these; block -1 has what is known, the others ask."""
    at, keys, values = None, np.empty(0, np.int64), np.empty(0, np.int64)
    names = ["block", "kind", "part", "values"]
    for batch in batches:
        out: list[tuple] = []
        for row in range(batch.num_rows):
            kind, part, block = (batch.column(c)[row].as_py() for c in range(3))
            if block < 0:
                at, keys = (kind, part), unpacked(batch.column(3)[row].as_py())
                values = np.frombuffer(batch.column(4)[row].as_py(), np.int64)
                continue
            asked = unpacked(batch.column(3)[row].as_py())
            answer = np.zeros(len(asked), np.int64)
            if at == (kind, part) and len(keys):
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                answer = np.where(keys[place] == asked, values[place], 0)
            out.append((block, kind, part, answer.tobytes()))
            if sum(len(x[3]) for x in out) > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER)], names)


_ANSWER = (pa.int64(), pa.int32(), pa.int64(), pa.binary())


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where `held_out` (a condition on doc_id) is true are scored, not learned from.
    """
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = cut_lineage(tally(rows))
    of_words = counts.where(F.col("kind") == _WORD).select("key", "n")
    words, taught = of_words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    of_grams = counts.where(F.col("kind") == _GRAM).select(F.col("key").alias("gram"), "n")
    parts = {_GRAM: part_count(of_grams.count()), _WORD: part_count(words)}
    bytes_ = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(BLOCKS, -(-bytes_ // BLOCK_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "held_out", "text")

    def ask(left: pa.Table) -> pa.Table:
        block, out = left.column("block")[0].as_py(), []
        for kind, keys in _asked(left.column("text")).items():
            of = _parts(kind, keys, parts[kind])
            order = np.argsort(of, kind="stable")
            edges = np.flatnonzero(np.diff(of[order], prepend=-1))
            for places in np.split(order, edges[1:]):
                out.append((kind, int(of[places[0]]), block, packed(keys[places]), None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), stream)], ["kind", "part", "block", "keys", "values"])

    stream = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    known = grow(of_grams)[0].withColumn("kind", F.lit(_GRAM))
    known = known.unionByName(_word_answers(of_words, parts[_WORD]).withColumn("kind", F.lit(_WORD)))
    columns = ["kind", "part", "block", "keys", "values"]
    questions = dealt.groupBy("block").applyInArrow(ask, "kind int, part long, block long, keys binary, values binary")
    meeting = questions.unionByName(known.withColumn("block", F.lit(-1).cast("long")).select(*columns))
    answers = (
        meeting.repartition("kind", "part").sortWithinPartitions("kind", "part", "block")
        .mapInArrow(_answered, "block long, kind int, part long, values binary")
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        asked, value = _asked(left.column("text")), {}
        for kind, keys in asked.items():
            got = right.filter(pc.equal(right.column("kind"), kind)).column("values").to_pylist()
            value[kind] = np.empty(len(keys), np.int64)
            value[kind][np.argsort(_parts(kind, keys, parts[kind]), kind="stable")] = np.frombuffer(b"".join(got), np.int64)
        log10, total = value[_GRAM].view(np.float64), value[_WORD]
        end_total = total[np.searchsorted(asked[_WORD], np.array([_END_WORD]).view(np.int64))][0]
        columns: list[list[np.ndarray]] = [[] for _ in range(4)]
        for piece in pieces(left.column("text")):
            low = piece.lower
            doc, h = low.spans[2], low.hashes.view(np.int64)
            c = total[np.searchsorted(asked[_WORD], h)] if len(h) else np.empty(0, np.int64)
            symbols, place, stops = sequence(piece)
            each = log10[_places(asked[_GRAM], grams(symbols, place, DEPTH + 1))]
            before = np.concatenate(([0.0], np.cumsum(each)))[np.concatenate(([0], stops + 1))]
            n = len(piece)
            columns[0].append(np.bincount(doc, minlength=n) + 1)
            columns[1].append(np.bincount(doc, c > 0, n).astype(np.int64) + (end_total > 0))
            columns[2].append(np.bincount(doc, np.log10(c + 0.5), n) + np.log10(end_total + 0.5))
            columns[3].append(np.diff(before))
        tokens, seen, base, model = (np.concatenate(x) for x in columns)
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": tokens.astype(np.int64),
            "n_known": seen.astype(np.int64), "known_sum": base.astype(float), "score": model.astype(float),
        })

    schema = dealt.select("doc_id", "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("known_sum", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    norm = float(np.log10(taught + 0.5 * (words + 1)))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(taught).cast("long").alias("train_tokens"),
        (F.col("known_sum") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score",
    )
