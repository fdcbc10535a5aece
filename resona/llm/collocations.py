"""Phrases that stand together more often than their parts, counted in HAT-tries.

Texts are cut into pieces at punctuation and line ends, pieces into words at spaces and tabs. A task
counts phrases in a trie over the ids it gives to words (`HatTrie`): the shallow upper nodes lead by word id, everything
below lies in hash containers of packed suffixes. Words with few phrases share hybrid containers; one with more than
`BURST` entries bursts, its crowded words get containers of their own, and these become nodes when they are too full. Beyond
`HELD` entries the largest subtrees are spilled whole, as runs sorted by phrase; the rest is spilled at the end. Spark deals the runs out by prefix partition and merges
them: a phrase's partition is its first word and one of `SLOTS` slots of what follows, so a prefix that
starts a third of all phrases is merged in `SLOTS` places, and each task sends a phrase once per run.

Two passes. The first counts words and pairs. A phrase of three or four words is as frequent as its least pair at most,
so the second counts only windows whose pairs are all frequent. It knows frequent pairs by a bit map with
`PAIR_BITS` bits a pair, which grows with their number; from `MAP_BYTES` on no map is sent and all windows are
counted. The map spares work and decides nothing: counts of what it lets through are exact.

The rest is joins on phrases that are frequent: parts of every cut, and the most frequent longer phrase around a
candidate. Scores are integer divisions of decimals. Words are compared as they are, never by hash.

Defined cases: null texts have no words, a null lang is `und`; rows without doc_id count like others; repeated rows
count each; ties go to the smallest cut and, in the ranking, to the first phrase; a language without candidates and
an empty table have no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resona.llm.text import UPPER, mixed
from resona.session import cut_lineage

LONGEST = 4
SLOTS = 64

#: Entries of a container before it bursts, words of a hybrid container's range (in bits), and entries a task holds
#: before it spills.
BURST, RANGE_BITS = 16384, 12
HELD = 1_000_000
#: Bytes of text counted at once.
PIECE = 1 << 20
#: Bits of a packed word id. A task that has met so many words spills all and starts its ids anew.
ID_BITS = 21
PAIR_BITS, MAP_BYTES = 32, 64 << 20

#: A-Z as a-z, tabs as spaces, breaks as a byte that UTF-8 has nowhere.
_FOLD = bytearray(range(256))
for _from, _to in zip(UPPER.encode(), UPPER.lower().encode(), strict=True):
    _FOLD[_from] = _to
for _byte in b".,;:!?\n\v\f\r":
    _FOLD[_byte] = 0xFF
_FOLD[9] = 32
_FOLD = bytes(_FOLD)
_BREAK = b"\xff"

Keys = np.ndarray


class Words(dict):
    """Word ids of a task in order of appearance. Id 0 is the break between pieces."""

    def __init__(self):
        super().__init__({_BREAK: 0})
        self.text = [_BREAK]
        self._hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.text)
        self.text.append(word)
        return n

    @property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash per id, the same in every task; used for partitions and for the bit map alone."""
        if len(self._hashes) < len(self.text):
            import xxhash

            new = [xxhash.xxh64_intdigest(x) for x in self.text[len(self._hashes) :]]
            self._hashes = np.concatenate((self._hashes, np.array(new, np.uint64)))
        return self._hashes


def _unpacked(keys: Keys, size: int) -> list[np.ndarray]:
    """The word ids of packed phrases of `size` words."""
    return [(keys >> (ID_BITS * (size - 1 - i))) & ((1 << ID_BITS) - 1) for i in range(size)]


class HatTrie:
    """Counts of phrases of one length.

    The root leads by first word: `own` has the containers of words with many phrases, `shared` hybrid containers, each
    for a range of words. A hybrid container that bursts gives its crowded words containers of their own.
    """

    def __init__(self, size: int):
        self.size = size
        self.shift = ID_BITS * (size - 1)
        # a hybrid container's keys still have to fit 63 bits
        self.range_bits = min(RANGE_BITS, 63 - self.shift)
        self.own: dict[int, Container | Node] = {}
        self.shared: dict[int, Container] = {}
        self.held = 0

    def add(self, words: list[np.ndarray]) -> None:
        """Count phrases given as arrays of their first to last word ids."""
        if not len(words[0]):
            return
        suffix = np.zeros(len(words[0]), np.int64)
        for part in words[1:]:
            suffix = suffix << ID_BITS | part
        heads, suffix, counts = _tallied(words[0], suffix, self.shift)
        if self.own:
            apart = np.isin(heads, np.fromiter(self.own, np.int64, len(self.own)))
            for lo, hi in _runs(heads[apart]):
                head = int(heads[apart][lo])
                self.held += self.own[head].add(suffix[apart][lo:hi].tolist(), counts[apart][lo:hi].tolist())
                self.own[head] = _small(self.own[head])
            heads, suffix, counts = heads[~apart], suffix[~apart], counts[~apart]
        ranges = heads >> self.range_bits
        keys = ((heads & ((1 << self.range_bits) - 1)) << self.shift) | suffix
        for lo, hi in _runs(ranges):
            number = int(ranges[lo])
            below = self.shared.get(number)
            if below is None:
                below = self.shared[number] = Container(self.size)
            self.held += below.add(keys[lo:hi].tolist(), counts[lo:hi].tolist())
            if len(below) > below.limit:
                self.burst(number, below)

    def burst(self, number: int, below: Container) -> None:
        """Words with an eighth of a full hybrid container move out of it; what stays may fill it up again."""
        keys, counts = below.rows()
        heads = keys >> self.shift
        words, sizes = np.unique(heads, return_counts=True)
        for word in words[sizes >= BURST // 8].tolist():
            out = heads == word
            own = self.own[number << self.range_bits | word] = Container(self.size - 1)
            own.add((keys[out] & ((1 << self.shift) - 1)).tolist(), counts[out].tolist())
        stay = np.isin(heads, words[sizes < BURST // 8])
        rest = self.shared[number] = Container(self.size)
        rest.add(keys[stay].tolist(), counts[stay].tolist())
        rest.limit = BURST + len(rest)

    def spilled(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out the largest subtrees until `keep` entries are left: first words, packed suffixes, counts."""
        heads, suffixes, counts = [], [], []
        subtrees = [(len(x), self.own, n) for n, x in self.own.items()] + [(len(x), self.shared, n) for n, x in self.shared.items()]
        for size, level, number in sorted(subtrees, key=itemgetter(0), reverse=True):
            if self.held <= keep:
                break
            keys, n = level.pop(number).rows()
            self.held -= size
            if level is self.own:
                heads.append(np.full(len(keys), number, np.int64))
            else:
                heads.append(number << self.range_bits | keys >> self.shift)
            suffixes.append(keys & ((1 << self.shift) - 1))
            counts.append(n)
        if not heads:
            return (np.empty(0, np.int64),) * 3
        return np.concatenate(heads), np.concatenate(suffixes), np.concatenate(counts)


def _tallied(heads: np.ndarray, suffix: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases in order with their counts."""
    if shift + ID_BITS <= 63:
        keys = np.sort(heads << shift | suffix)
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        at = np.flatnonzero(fresh)
        return keys[at] >> shift, keys[at] & ((1 << shift) - 1), np.diff(np.append(at, len(keys)))
    order = np.lexsort((suffix, heads))
    heads, suffix = heads[order], suffix[order]
    at = np.flatnonzero(np.concatenate(([True], (heads[1:] != heads[:-1]) | (suffix[1:] != suffix[:-1]))))
    return heads[at], suffix[at], np.diff(np.append(at, len(heads)))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of every run of equal values."""
    if len(values):
        edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))).tolist()
        yield from zip(edges[:-1], edges[1:], strict=True)


class Container(dict):
    """A hash table of packed suffixes of `size` words (of a hybrid one, with the words of its range before them)."""

    __slots__ = ("size", "limit")

    def __init__(self, size: int):
        self.size, self.limit = size, BURST

    def add(self, keys: list[int], counts: list[int]) -> int:
        before = len(self)
        if before:
            get = self.get
            for key, count in zip(keys, counts, strict=True):
                self[key] = get(key, 0) + count
        else:
            self.update(zip(keys, counts, strict=True))
        return len(self) - before

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(self, np.int64, len(self)), np.fromiter(self.values(), np.int64, len(self))


class Node:
    """An inner node: containers or nodes by the id of the next word."""

    def __init__(self, size: int):
        self.size = size
        self.below: dict[int, Container | Node] = {}
        self.held = 0

    def __len__(self) -> int:
        return self.held

    def add(self, keys: list[int], counts: list[int]) -> int:
        shift = ID_BITS * (self.size - 1)
        mask = (1 << shift) - 1
        groups: dict[int, tuple[list[int], list[int]]] = {}
        for key, count in zip(keys, counts, strict=True):
            group = groups.setdefault(key >> shift, ([], []))
            group[0].append(key & mask)
            group[1].append(count)
        new = 0
        for word, group in groups.items():
            below = self.below.get(word)
            if below is None:
                below = self.below[word] = Container(self.size - 1)
            new += below.add(*group)
            self.below[word] = _small(below)
        self.held += new
        return new

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        shift = ID_BITS * (self.size - 1)
        found = [(word, *below.rows()) for word, below in self.below.items()]
        return np.concatenate([(word << shift) | keys for word, keys, _ in found]), np.concatenate([x[2] for x in found])


def _small(below: Container | Node) -> Container | Node:
    """A container that is too full as a node; last words are not divided."""
    if isinstance(below, Node) or len(below) <= BURST or below.size < 2:
        return below
    node = Node(below.size)
    node.add(list(below), list(below.values()))
    return node


def _pair_bits(words: Words, lang: np.uint64, ids: np.ndarray, size: int) -> np.ndarray:
    """Places in the bit map of the pairs that start at each id but the last."""
    h = words.hashes[ids]
    return mixed(mixed(h[:-1] ^ lang) + h[1:]) & np.uint64(size - 1)


def _lang_hash(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


class Counting:
    """One task's tries: per language, one for each phrase length asked for."""

    def __init__(self, sizes: tuple[int, ...], pairs: np.ndarray | None):
        self.sizes, self.pairs = sizes, pairs
        self.words = Words()
        self.tries: dict[tuple[str, int], HatTrie] = {}
        self.totals: dict[str, int] = {}

    def add(self, lang: str, texts: bytes) -> Iterator[pa.RecordBatch]:
        """Count the phrases of texts that are separated by breaks; gives runs whenever too much is held."""
        at, carried = 0, [_BREAK]
        while at < len(texts):
            to = len(texts)
            if to - at > PIECE + (PIECE >> 2):  # cut at a space; the last words go along to the next cut
                to = texts.find(b" ", at + PIECE)
                to = to if to > 0 else len(texts)
            tokens = carried + texts[at:to].replace(_BREAK, b" \xff ").split()
            self.count(lang, np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens)), len(carried))
            carried = tokens[-(LONGEST - 1) :]
            at = to
            if self.full():
                yield from self.runs(last=False)

    def count(self, lang: str, ids: np.ndarray, old: int) -> None:
        """Count the phrases whose last word is among `ids[old:]`."""
        self.totals[lang] = self.totals.get(lang, 0) + int(np.count_nonzero(ids[old:]))
        known = None
        if self.pairs is not None and len(ids) > 1:
            bits = _pair_bits(self.words, _lang_hash(lang), ids, len(self.pairs) * 8)
            known = (self.pairs[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 > 0
        for size in self.sizes:
            n = len(ids) - size + 1
            if n <= 0:
                continue
            start = max(old - size + 1, 0)
            whole = np.ones(n - start, bool)
            for i in range(size):
                whole &= ids[start + i : n + i] != 0
            if known is not None:
                for i in range(size - 1):
                    whole &= known[start + i : n + i]
            places = np.flatnonzero(whole) + start
            self.trie(lang, size).add([ids[places + i] for i in range(size)])

    def trie(self, lang: str, size: int) -> HatTrie:
        return self.tries.setdefault((lang, size), HatTrie(size))

    def full(self) -> bool:
        return sum(x.held for x in self.tries.values()) > HELD or len(self.words.text) >= 1 << (ID_BITS - 1)

    def runs(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Spilled subtrees as sorted runs: all of them at the end and when ids run out, else down to a quarter."""
        whole = last or len(self.words.text) >= 1 << (ID_BITS - 1)
        share = 0 if whole else HELD // (4 * max(len(self.tries), 1))
        for (lang, size), trie in self.tries.items():
            first, suffix, counts = trie.spilled(share)
            if len(first):
                yield self.run(lang, [first, *_unpacked(suffix, size - 1)], counts)
        if whole:
            self.words, self.tries = Words(), {}
        if last and self.totals:
            langs = list(self.totals)
            yield _batch([-1] * len(langs), langs, [0] * len(langs), [""] * len(langs), list(self.totals.values()))

    def run(self, lang: str, ids: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        words = pa.array(self.words.text, pa.binary())
        phrases = pc.binary_join_element_wise(*[words.take(pa.array(x)) for x in ids], b" ").cast(pa.string(), safe=False)
        h = self.words.hashes
        rest = np.zeros(len(counts), np.uint64)
        for x in ids[1:]:
            rest = mixed(rest + h[x])
        part = (mixed(h[ids[0]] ^ _lang_hash(lang)) + rest % np.uint64(SLOTS)) & np.uint64(0x7FFFFFFF)
        batch = _batch(part.astype(np.int64), [lang] * len(counts), np.full(len(counts), len(ids), np.int32), phrases, counts)
        return batch.take(pc.sort_indices(phrases))


def _batch(part, lang, size, phrase, count) -> pa.RecordBatch:
    arrays = [pa.array(part, pa.int32()), pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.string()), pa.array(count, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["part", "lang", "size", "phrase", "f"])


def _counted(texts: DataFrame, sizes: tuple[int, ...], pairs=None) -> DataFrame:
    """Counts of all phrases of these lengths: lang, size, phrase, f; size 0 is the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(sizes, None if pairs is None else np.frombuffer(pairs.value, np.uint8))
        held: dict[str, list[bytes]] = {}
        room: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                if not text.is_valid:
                    continue
                folded = text.as_buffer().to_pybytes().translate(_FOLD)
                held.setdefault(lang, []).append(folded)
                room[lang] = room.get(lang, 0) + len(folded)
                if room[lang] >= PIECE:
                    room.pop(lang)
                    yield from counting.add(lang, _BREAK.join(held.pop(lang)))
        for lang, rest in held.items():
            yield from counting.add(lang, _BREAK.join(rest))
        yield from counting.runs(last=True)

    runs = texts.mapInArrow(count, "part int, lang string, size int, phrase string, f long")
    # each task has counted; a prefix partition merges its runs, without a second exchange
    return runs.repartition("part").groupBy("part", "lang", "size", "phrase").agg(F.sum("f").alias("f")).drop("part")


def _pair_map(frequent: DataFrame):
    """The frequent pairs as a bit map on every executor, or None if it would be too large."""
    spark = frequent.sparkSession
    pairs = frequent.where("size = 2").select("lang", "phrase")
    n = pairs.count()
    size = 1 << max(int(np.ceil(np.log2(max(n, 1) * PAIR_BITS))), 13)
    if size > MAP_BYTES * 8:
        return None

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words()
            places = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([words[x] for x in phrase.encode().split(b" ")], np.int64)
                places.append((lang, ids))
            bits = [int(_pair_bits(words, _lang_hash(lang), ids, size)[0]) for lang, ids in places]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], ["bit"])

    # the driver gets the map's bytes, 4 KiB a row, not the pairs
    block = F.shiftright("bit", 15).alias("block")
    rows = pairs.mapInArrow(marked, "bit long").groupBy(block).agg(F.collect_set((F.col("bit") % (1 << 15)).cast("int")).alias("bits"))
    found = np.zeros(size // 8, np.uint8)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bits in batch.column(1).to_pylist():
                mask = np.zeros(1 << 15, np.uint8)
                mask[bits] = 1
                out.append(np.packbits(mask, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "bytes"])

    for row in rows.mapInArrow(packed, "block long, bytes binary").toLocalIterator():
        part = found[row.block << 12 : (row.block + 1) << 12]
        part[:] = np.frombuffer(row.bytes, np.uint8)[: len(part)]
    return spark.sparkContext.broadcast(found.tobytes())


def phrase_counts(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to four words that occur `least` times or more (lang, size, phrase, f), and words per language (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    short = cut_lineage(_counted(texts, (1, 2)).where((F.col("f") >= least) | (F.col("size") == 0)))
    pairs = _pair_map(short.where("size > 0"))
    long = cut_lineage(_counted(texts, (3, 4), pairs).where((F.col("f") >= least) & (F.col("size") > 0)))
    return short.where("size > 0").unionByName(long), short.where("size = 0").select("lang", F.col("f").alias("n"))


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, scale: int = 2_000_000) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    `a` is the phrase's count, `l` and `r` those of the two parts of its lowest-scoring cut, the score
    `floor(scale * a / (l + r))`. A phrase inside a longer one that has `inside` percent of its count is left out.
    """
    counts, totals = phrase_counts(docs, least)
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), _words(F.col("phrase")).alias("words"))

    # what stands inside a longer candidate, once per task and phrase before it is shuffled
    whole = candidates.where("size > 2")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: _joined(F.col("words"), s, m)),
        )
    )
    longer = whole.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longest") < F.lit(inside).cast("decimal(20,0)") * F.col("a"))
    )

    cuts = kept.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        _joined(F.col("words"), F.lit(1), F.col("k")).alias("head"),
        _joined(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"),
    )
    left = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    exact = "decimal(38,0)"
    score = F.expr(f"(CAST({int(scale)} AS {exact}) * CAST(a AS decimal(20,0))) div (CAST(l AS {exact}) + CAST(r AS {exact}))")
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
