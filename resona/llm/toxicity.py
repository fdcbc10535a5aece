"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled documents that may be learned from fall into three parts by hash: the first gives a
lexicon (words, and beginnings of `STEMS` letters, with their log odds of standing in a toxic
document), the second trains the trees, the third calibrates them, so none of them sees its own
documents again. Features of a whole text: densities of lexicon words and stems and of their
weights, how many stand within three words of a second-person word, hits that only show once
obfuscation is undone, words with digits or marks between letters, shares of capitals, capital
words and punctuation, and length. Neither labels nor doc_id, lang or source are read.

The fit uses about `TRAIN_ROWS` labelled documents; the lexicon is bounded by that sample.

Defined cases: null and empty texts have all densities 0 and get the score of such features; if a
part lacks toxic or clean documents every score is the overall share of toxic ones; equal texts get
equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.llm.labelled import labelled_texts, sample_labels
from resona.llm.text import Piece, pieces, span_hashes
from resona.session import cut_lineage

#: Labelled documents in the fit, about.
TRAIN_ROWS = 12_000
LEAST_ODDS = 1.2
#: Bytes of the beginnings that count as stems.
STEMS = (4, 5, 6, 7)
#: Second-person words of the languages served. Fixed values.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus vuestro"
).split()
FEATURES = [
    "word_density", "word_weight", "word_hits", *(f"stem{i}_{x}" for i in STEMS for x in ("weight", "hits")), "near_person", "person_density", "hidden", "mixed_words", "capitals", "capital_words",
    "marks", "punctuation", "digits", "length",
]

# Bytes of a word as they are compared: letters in lower case, signs dropped (0).
_PLAIN = np.zeros(256, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
# Digits and signs that stand for letters. Fixed values.
_UNDONE = _PLAIN.copy()
for _sign, _letter in zip(b"0134578@$", b"oieastbas", strict=True):
    _UNDONE[_sign] = _letter
_CAPITAL, _DIGIT = ((np.arange(256) >= lo) & (np.arange(256) <= hi) for lo, hi in ((65, 90), (48, 57)))
_LETTER = _PLAIN > 0
_MARK = np.isin(np.arange(256), list(b"!?"))
_SIGN = (np.arange(256) > 32) & (np.arange(256) < 128) & ~_LETTER & ~_DIGIT


def _hashes(piece: Piece, table: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Hash of every word after `table`, of its first `longest` bytes; 0 where nothing is left."""
    starts, ends, _ = piece.spans
    mapped = table[piece.data]
    place = np.concatenate(([0], np.cumsum(mapped > 0)))
    lo, hi = place[starts], place[ends]
    out = np.zeros(len(starts), np.uint64)
    if longest:
        hi = np.where(hi - lo >= longest, lo + longest, lo)
    some = hi > lo
    out[some] = span_hashes(mapped[mapped > 0], lo[some], hi[some])
    return out


def _person_hashes() -> np.ndarray:
    piece = next(pieces(pa.array([" ".join(SECOND_PERSON)])))
    return np.sort(_hashes(piece, _PLAIN))


def _weights(hashes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, values[at], 0.0)


def dense(piece: Piece, lexicon: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The features of each document of the piece."""
    doc, n = piece.spans[2], np.maximum(piece.n_words, 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, len(piece)) / n

    def hits(values: np.ndarray) -> np.ndarray:
        return np.log1p(np.bincount(doc, values > 0, len(piece)))

    undone = _hashes(piece, _UNDONE)
    plain = _hashes(piece, _PLAIN)
    word = _weights(undone, *lexicon["word"])
    stems = [_weights(_hashes(piece, _UNDONE, size), *lexicon[f"stem{size}"]) for size in STEMS]
    hit = np.any([word > 0, *(x > 0 for x in stems)], axis=0)
    hidden = (word > 0) & (_weights(plain, *lexicon["word"]) == 0)
    people = _person_hashes()
    person = np.isin(plain, people)
    reach = np.concatenate(([0], np.cumsum(person)))
    lo, hi = np.maximum(np.arange(len(doc)) - 3, 0), np.minimum(np.arange(len(doc)) + 4, len(doc))
    near = hit & (reach[hi] > reach[lo])

    starts, ends, _ = piece.spans
    letters, capitals, digits, signs = (
        np.concatenate(([0], np.cumsum(t[piece.data]))) for t in (_LETTER, _CAPITAL, _DIGIT, _SIGN)
    )
    n_letters = letters[ends] - letters[starts]
    inner = np.maximum(ends - 1, starts)
    others = (digits + signs)[inner] - (digits + signs)[starts]
    obscured = (n_letters > 1) & (others > 0) & (others < n_letters)
    shouted = (n_letters > 2) & (capitals[ends] - capitals[starts] == n_letters)
    size = np.maximum(np.diff(piece.offsets), 1)
    return np.column_stack([
        per_word(word > 0), per_word(word), hits(word), *(f(x) for x in stems for f in (per_word, hits)), per_word(near), per_word(person), per_word(hidden), per_word(obscured),
        piece.sums(_CAPITAL[piece.data]) / size, per_word(shouted), piece.sums(_MARK[piece.data]) / n,
        piece.sums(_SIGN[piece.data]) / size, piece.sums(_DIGIT[piece.data]) / size, np.log1p(piece.n_words),
    ])


def learn_lexicon(texts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Words and stems in at least `LEAST_ODDS` times (as a log) the share of toxic documents as of others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                labels = batch.column(1).to_numpy(zero_copy_only=False)[piece.rows]
                for kind, longest in (("word", None), *((f"stem{size}", size) for size in STEMS)):
                    h = _hashes(piece, _UNDONE, longest)
                    pairs = np.unique(np.stack([h, piece.spans[2].astype(np.uint64)]), axis=1) if len(h) else np.empty((2, 0), np.uint64)
                    keys, place = np.unique(pairs[0], return_inverse=True)
                    toxic = np.bincount(place, labels[pairs[1].astype(np.int64)] == 1, len(keys))
                    both = np.bincount(place, minlength=len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(keys), pa.string()), pa.array(keys.view(np.int64)),
                         pa.array(toxic.astype(np.int64)), pa.array((both - toxic).astype(np.int64))],
                        ["kind", "key", "toxic", "clean"],
                    )

    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = texts.select("text", "label").mapInArrow(count, "kind string, key long, toxic long, clean long")
    counted = counted.groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    found = counted.withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (F.col("toxic") >= max(2, n_toxic // 60)))
    rows = found.where("key != 0").toPandas()  # bounded by the sample
    out = {}
    for kind in ("word", *(f"stem{size}" for size in STEMS)):
        own = rows[rows.kind == kind]
        keys = own.key.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        out[kind] = keys[order], own.odds.to_numpy(float)[order]
    return out


def with_features(rows: DataFrame, lexicon, keep: list[str]) -> DataFrame:
    """`keep` columns and the features of `text`."""
    send = rows.sparkSession.sparkContext.broadcast(lexicon)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dense(piece, send.value) for piece in pieces(batch.column(len(keep)))]
            table = np.concatenate(found) if found else np.empty((0, len(FEATURES)))
            columns = [pa.array(np.ascontiguousarray(table[:, i], dtype=float)) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *FEATURES])

    schema = rows.select(*keep).schema
    for name in FEATURES:
        schema = schema.add(name, "double")
    return rows.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(compute, schema)


def scored(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAIN_ROWS, cut: float = 0.3) -> DataFrame:
    """A row per document: doc_id, score, predicted. `allowed` (of doc_id): labels that may be learned."""
    chosen = labelled_texts(docs, sample_labels(labels, F.col("toxic"), rows, allowed))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)))
    kinds = {(r.part, r.label): r.n for r in chosen.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    if any(not kinds.get((part, label)) for part in range(3) for label in (0, 1)):
        toxic, every = sum(n for (_, label), n in kinds.items() if label == 1), sum(kinds.values())
        constant = docs.select("doc_id", F.lit(toxic / every if every else 0.0).alias("score"))
        return constant.withColumn("predicted", (F.col("score") >= cut).cast("int"))
    lexicon = learn_lexicon(chosen.where("part = 0"))
    table = cut_lineage(with_features(chosen.where("part > 0"), lexicon, ["label", "part"]))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep")
    training = gather.transform(table.where("part = 1")).withColumn("label", F.col("label").cast("double"))
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, seed=7, maxBins=64
    ).fit(training)

    def margin(rows: DataFrame) -> DataFrame:
        out = trees.transform(gather.transform(rows))
        return out.withColumn("margin", vector_to_array("rawPrediction")[1])

    held = margin(table.where("part = 2")).select(F.col("label").cast("double").alias("label"), "margin")
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(held)
    out = isotonic.transform(margin(with_features(docs, lexicon, ["doc_id"])).select("doc_id", "margin"))
    # flat stretches of the calibration keep the order of the trees
    score = 0.98 * F.col("calibrated") + 0.02 / (1 + F.exp(-2 * F.col("margin")))
    score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
