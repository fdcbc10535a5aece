"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered: 0 for rejected, 1 for good but toxic, 2 for good documents. One weight vector
over hashed tokens gives a document's position s; thresholds t1 < t2 give the tail probabilities
P(grade >= k) = sigmoid(s - t_k) (proportional odds), from which the expected grade follows. A
document is kept if P(grade >= 1) reaches one half.

Tokens come in families, each averaged over the document, so length has no say but through its own
family: byte trigrams, collapsed word shapes (`Aa`, `a,`, `A!`), pairs of neighbouring shapes, and
binned shares of the document (capitals, symbols, marks, repeated neighbours, repeated windows).

The fit uses about `TRAIN_ROWS` labelled documents, chosen by hash of doc_id: a table of fixed size,
fitted by full-batch Adam in one task. All documents are scored, whole texts.

Defined cases: null and empty texts have only their bins; without labelled rows of both kinds every
document is kept at expected grade 2; equal texts get equal grades; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm.labelled import labelled_texts, sample_labels
from resona.llm.quality_rules import _CAPITAL, _MARK, _SMALL, _SYMBOL, adjacent_repeats, repeated_words
from resona.llm.text import Piece, mixed, pieces, span_hashes

#: Labelled documents in the fit, about.
TRAIN_ROWS = 6000
WIDTH = 1 << 16
GRADES = 3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _slots(values: np.ndarray, family: int) -> np.ndarray:
    return (mixed(values ^ (np.uint64(family) << np.uint64(56))) % np.uint64(WIDTH)).astype(np.int64)


def _shapes(piece: Piece) -> np.ndarray:
    """Hash of each word's shape: classes of its bytes, runs as one."""
    starts, ends, _ = piece.spans
    if not len(starts):
        return np.empty(0, np.uint64)
    kind = _SHAPE[piece.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    place = np.concatenate(([0], np.cumsum(new)))
    return span_hashes(kind[new], place[starts], place[ends])


def families(piece: Piece) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slot, document) of every token, family by family."""
    doc, out = piece.spans[2], []
    data = piece.data.astype(np.uint64)
    if len(data) > 2:
        owner = np.repeat(np.arange(len(piece)), np.diff(piece.offsets))
        value = data[:-2] | data[1:-1] << np.uint64(8) | data[2:] << np.uint64(16)
        whole = owner[:-2] == owner[2:]
        out.append((_slots(value[whole], 1), owner[:-2][whole]))
    shapes = _shapes(piece)
    out.append((_slots(shapes, 2), doc))
    if len(shapes) > 1:
        whole = doc[1:] == doc[:-1]
        out.append((_slots((shapes[:-1] * np.uint64(31) + shapes[1:])[whole], 3), doc[1:][whole]))
    n, letters = np.maximum(piece.n_words, 1), piece.sums((_CAPITAL | _SMALL)[piece.data])
    shares = [
        piece.sums(_CAPITAL[piece.data]) / np.maximum(letters, 1),
        piece.sums(_SYMBOL[piece.data]) / n,
        piece.sums(_MARK[piece.data]) / n,
        adjacent_repeats(piece) / n,
        repeated_words(piece) / n,
    ]
    everyone = np.arange(len(piece))
    for i, share in enumerate(shares):
        out.append((_slots(np.minimum(share * 10, 10).astype(np.uint64), 10 + i), everyone))
    return out


def _rows(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of a piece: document, slot, value."""
    docs, slots, values = [], [], []
    for slot, doc in families(piece):
        size = np.bincount(doc, minlength=len(piece))
        key, n = np.unique(doc * WIDTH + slot, return_counts=True)
        docs.append(key // WIDTH)
        slots.append(key % WIDTH)
        values.append(n / size[key // WIDTH])
    return np.concatenate(docs), np.concatenate(slots), np.concatenate(values)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(row: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, steps: int = 150):
    """Weights and thresholds of the proportional-odds model, by Adam on all rows."""
    n = len(grade)
    above = (grade[:, None] >= np.arange(1, GRADES)).astype(float)
    rate = np.clip(above.mean(0), 0.5 / n, 1 - 0.5 / n)
    params = np.concatenate((np.zeros(WIDTH), -np.log(rate / (1 - rate))))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        s = np.bincount(row, params[slot] * value, n)
        thresholds = np.sort(params[WIDTH:])
        # the grade's own probability is the difference of two tails
        tail = np.hstack((np.ones((n, 1)), _sigmoid(s[:, None] - thresholds), np.zeros((n, 1))))
        at = np.arange(n)
        mass = np.maximum(tail[at, grade] - tail[at, grade + 1], 1e-9)
        slope = tail * (1 - tail)
        pull = (slope[at, grade] - slope[at, grade + 1]) / mass
        gradient = np.empty_like(params)
        gradient[:WIDTH] = np.bincount(slot, pull[row] * value, WIDTH) / n - 1e-5 * params[:WIDTH]
        for k in range(1, GRADES):
            at_low, at_high = (grade == k), (grade == k - 1)
            gradient[WIDTH + k - 1] = (np.sum(slope[at_high, k] / mass[at_high]) - np.sum(slope[at_low, k] / mass[at_low])) / n
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        params[WIDTH:] = thresholds
        params += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return params[:WIDTH], np.sort(params[WIDTH:])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """(weights, thresholds), or None without labelled documents of several grades."""
    good = F.col("quality") == 1
    grade = F.when(~good, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    chosen = labelled_texts(docs, sample_labels(labels, F.when(F.col("quality").isNotNull(), grade), rows))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                doc, slot, value = _rows(piece)
                order = np.argsort(doc, kind="stable")
                edges = pa.array(np.searchsorted(doc[order], np.arange(len(piece) + 1)).astype(np.int32))
                lists = (
                    pa.ListArray.from_arrays(edges, pa.array(x[order].astype(kind)))
                    for x, kind in ((slot, np.int32), (value, np.float32))
                )
                place, labels = (batch.column(c).slice(piece.rows.start, len(piece)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([place, labels.cast(pa.int32()), *lists], ["place", "grade", "slot", "value"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, features_schema)
        grades = rows.column("grade").to_numpy()
        if len(np.unique(grades)) > 1:
            slots, values = (rows.column(c).combine_chunks() for c in ("slot", "value"))
            row = np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(slots.offsets.to_numpy()))
            parts = fit(row, slots.flatten().to_numpy(), values.flatten().to_numpy(), grades)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in parts], ["weights", "thresholds"])

    features_schema = pa.schema(
        {"place": pa.int64(), "grade": pa.int32(), "slot": pa.list_(pa.int32()), "value": pa.list_(pa.float32())}
    )
    # one task fits the bounded sample, in a fixed order; the driver gets the weights
    rows = chosen.select(F.xxhash64("doc_id", "text").alias("place"), "text", "label").mapInArrow(
        features, "place long, grade int, slot array<int>, value array<float>"
    )
    rows = rows.repartition(1).sortWithinPartitions("place")
    model = rows.mapInArrow(fitted, "weights array<double>, thresholds array<double>").toArrow()
    if not model.num_rows:
        return None
    return tuple(model.column(c)[0].values.to_numpy() for c in ("weights", "thresholds"))


def graded(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, least: float = 0.5) -> DataFrame:
    """All columns of `docs` and: tail_1, tail_2 (P(grade >= k)), expected_grade, accepted (tail_1 >= `least`)."""
    model = train(docs, labels, rows)
    send = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH + 2 numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails: list[np.ndarray] = []
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            for piece in pieces(texts):
                if send.value is None:
                    tails.append(np.ones((len(piece), GRADES - 1)))
                    continue
                weights, thresholds = send.value
                s = np.zeros(len(piece))
                for slot, doc in families(piece):
                    size = np.maximum(np.bincount(doc, minlength=len(piece)), 1)
                    s += np.bincount(doc, weights[slot], len(piece)) / size
                tails.append(_sigmoid(s[:, None] - thresholds))
            tail = np.concatenate(tails) if tails else np.empty((0, GRADES - 1))
            columns = [pa.array(tail[:, k]) for k in range(GRADES - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, *(f"tail_{k}" for k in range(1, GRADES))]
            )

    own = [c for c in docs.columns if c not in {"expected_grade", "accepted", *(f"tail_{k}" for k in range(1, GRADES))}]
    schema = docs.select(*own).schema
    for k in range(1, GRADES):
        schema = schema.add(f"tail_{k}", "double")
    out = docs.select(*own).mapInArrow(score, schema)
    expected = sum((F.col(f"tail_{k}") for k in range(2, GRADES)), F.col("tail_1"))
    return out.withColumn("expected_grade", expected).withColumn("accepted", F.col("tail_1") >= least)
