"""Quality rules as a short-circuit cascade.

Each rule rejects documents. On a bounded sample every rule sees every sampled document that passes the base
test (the cascade sees no others), which gives its CPU time and the pattern of rules that reject each document. Rules are then ordered
greedily: next comes the rule that rejects most of what the earlier ones leave, per unit of time.
Over the whole table a rule only looks at documents that all earlier rules passed. The verdict is
that of all rules together and does not depend on the order, so estimates that differ from run to
run change the time and nothing else.

Defined cases: null and empty texts have no words and fail the base measures; lines are compared as
they are, blank ones do not count; rows are independent, so ties and repeated rows get equal
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm.text import Piece, mixed, pieces

#: Documents in the sample that orders the rules, about.
SAMPLE = 2000
MIN_WORDS = 50

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITAL = np.isin(np.arange(256), list(range(65, 91)))
_SMALL = np.isin(np.arange(256), list(range(97, 123)))
_LETTER = _CAPITAL | _SMALL | (np.arange(256) >= 128)
_MARK = np.isin(np.arange(256), list(b"!?"))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def repeated_lines(piece: Piece) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    out = np.zeros(len(piece), np.int64)
    for i in range(len(piece)):
        lines = [x for x in piece.text(i).split(b"\n") if x.split(None, 1)]
        out[i] = len(lines) - len(set(lines))
    return out


def repeated_words(piece: Piece, size: int = 3) -> np.ndarray:
    """Words inside `size`-word windows that their document has twice or more."""
    value, doc = piece.shingles(size)
    out = np.zeros(len(piece.spans[2]) + 1, np.int64)
    if len(value):
        keys = value ^ mixed(doc.astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        words = piece.spans[2]
        first = np.flatnonzero(words[: len(words) - size + 1] == words[size - 1 :])[twice]
        np.add.at(out, first, 1)
        np.add.at(out, first + size, -1)
    covered = np.cumsum(out[:-1]) > 0
    return np.bincount(piece.spans[2][covered], minlength=len(piece))


def adjacent_repeats(piece: Piece) -> np.ndarray:
    h, doc = piece.hashes, piece.spans[2]
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][same], minlength=len(piece))


#: Name and test of every rule; a test is true for documents that it rejects.
RULES: dict[str, Callable[[Piece], np.ndarray]] = {
    "symbols": lambda p: _share(p.sums(_SYMBOL[p.data]), p.n_words) > 0.2,
    "capitals": lambda p: _share(p.sums(_CAPITAL[p.data]), p.sums((_CAPITAL | _SMALL)[p.data])) > 0.5,
    "marks": lambda p: _share(p.sums(_MARK[p.data]), p.n_words) > 0.2,
    "letters": lambda p: _share(p.sums(_LETTER[p.data]), np.diff(p.offsets)) < 0.5,
    "word_length": lambda p: (_share(p.word_chars, p.n_words) > 15) | (_share(p.word_chars, p.n_words) < 2),
    "adjacent": lambda p: _share(adjacent_repeats(p), p.n_words) > 0.2,
}


def subset(piece: Piece, which: np.ndarray) -> Piece:
    if which.all():
        return piece
    parts = [piece.data[piece.offsets[i] : piece.offsets[i + 1]] for i in np.flatnonzero(which)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    return Piece(np.concatenate(parts) if parts else piece.data[:0], offsets, piece.rows)


def base_failures(piece: Piece, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that fail the base test, and their repeated words."""
    repeats = repeated_words(piece)
    return (piece.n_words < min_words) | (100 * repeats > 50 * piece.n_words), repeats


def by_worth(names: list[str], patterns: dict[int, float], costs: dict[str, float]) -> list[str]:
    """The names in the order of greatest rejection per cost among what the earlier ones leave; ties: the cheaper first.

    patterns: how many documents are rejected by exactly the rules whose bits (places in `names`) are set.
    """
    left, order = dict(patterns), []
    while len(order) < len(names):
        def worth(name: str) -> tuple[float, float]:
            bit = 1 << names.index(name)
            return sum(n for key, n in left.items() if key & bit) / costs[name], -costs[name]

        best = max((n for n in names if n not in order), key=worth)
        order.append(best)
        left = {key: n for key, n in left.items() if not key & (1 << names.index(best))}
    return order


def rule_order(docs: DataFrame, names: list[str], sample: int = SAMPLE, min_words: int = MIN_WORDS) -> list[str]:
    """The order of the rules, from about `sample` documents."""
    rows = docs.count()
    if not rows:
        return names
    share = max(1, rows // max(sample, 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("text")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = np.zeros(len(names))
        patterns: dict[int, int] = {}
        for batch in batches:
            for whole in pieces(batch.column(0)):
                piece = subset(whole, ~base_failures(whole, min_words)[0])
                pattern = np.zeros(len(piece), np.int64)
                for i, name in enumerate(names):
                    fresh = Piece(piece.data, piece.offsets, piece.rows)
                    start = time.thread_time()
                    pattern |= RULES[name](fresh).astype(np.int64) << i
                    spent[i] += time.thread_time() - start
                for key, n in zip(*np.unique(pattern, return_counts=True), strict=True):
                    patterns[int(key)] = patterns.get(int(key), 0) + int(n)
        keys = [*patterns, *(-1 - i for i in range(len(names)))]
        values = [*map(float, patterns.values()), *map(float, spent)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.float64())], ["key", "value"])

    # one row per rule and per pattern of rules met in the sample
    seen = chosen.mapInArrow(profile, "key long, value double").groupBy("key").agg(F.sum("value").alias("value"))
    totals = {row.key: row.value for row in seen.collect()}
    costs = {name: max(totals.get(-1 - i, 0.0), 1e-9) for i, name in enumerate(names)}
    return by_worth(names, {key: n for key, n in totals.items() if key >= 0}, costs)


def judged(docs: DataFrame, rules: list[str] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per document: doc_id, the base measures, base_failed, rejected_by (the first rule of
    the order that rejects it, or null) and kept."""
    names = list(RULES) if rules is None else rules
    order = rule_order(docs, names, min_words=min_words)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in range(7)]
            for piece in pieces(batch.column(1)):
                n = piece.n_words
                failed, repeats = base_failures(piece, min_words)
                by = np.full(len(piece), None, object)
                alive = ~failed
                for name in order:  # only what is left
                    if not alive.any():
                        break
                    rejected = np.flatnonzero(alive)[RULES[name](subset(piece, alive))]
                    by[rejected] = name
                    alive[rejected] = False
                values = n, piece.word_chars, piece.sums(_SYMBOL[piece.data]), repeated_lines(piece), repeats
                for column, value in zip(found, (*values, failed, by), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string()]
            columns = [
                pa.array(np.concatenate(x) if x else [], kind) for x, kind in zip(found, kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *measures, "base_failed", "rejected_by"])

    schema = docs.select("doc_id").schema
    for name in measures:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("rejected_by", "string")
    rows = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(judge, schema)
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
