"""Words of Arrow text batches as NumPy arrays, and word lists as column expressions.

A batch is worked through in pieces of whole documents of about `PIECE` bytes, so memory
does not follow the size of an Arrow batch; a longer document is a piece of its own. Null
texts count as empty. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = (np.arange(256) & 0xC0) != 0x80
_BYTE = np.random.RandomState(20240607).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: Column) -> Column:
    """A-Z as a-z, nothing else changed; null as an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(lowered(text), ALNUM_BREAK), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, in slices of bounded size. Spans are not empty and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    powers = _powers(int((ends - starts).max()))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        lo, hi = starts[at], ends[to - 1]
        lengths = ends[at:to] - starts[at:to]
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        offset = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        values = _BYTE[data[lo:hi][offset + np.repeat(starts[at:to] - lo, lengths)]] * powers[offset]
        out[at:to] = np.add.reduceat(values, first)
        at = to
    return mixed(out ^ ((ends - starts).astype(np.uint64) * _STEP))


@dataclass
class Piece:
    """Some whole documents: `data[offsets[i]:offsets[i + 1]]` is the UTF-8 text of document i."""

    data: np.ndarray
    offsets: np.ndarray
    rows: slice

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per document, the number of bytes where `mask` holds."""
        counts = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=counts[1:])
        return counts[self.offsets[1:]] - counts[self.offsets[:-1]]

    @cached_property
    def lower(self) -> Piece:
        return Piece(_LOWER[self.data], self.offsets, self.rows)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word."""
        inside = ~_SPACE[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
        ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.spans[2], minlength=len(self))

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, *self.spans[:2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.sums(_LEAD[self.data] & ~_SPACE[self.data])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of every `size`-word window; nothing for shorter documents."""
        h, doc = self.hashes, self.spans[2]
        n = len(h) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        value = np.zeros(n, np.uint64)
        for j in range(size):
            value = value * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
        whole = doc[:n] == doc[size - 1 :]
        return mixed(value[whole]), doc[:n][whole]


def pieces(texts: pa.Array | pa.ChunkedArray, limit: int = PIECE) -> Iterator[Piece]:
    """The column in pieces of whole documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, places, content = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        lo, hi = offsets[at], offsets[to]
        yield Piece(data[lo:hi], offsets[at : to + 1] - lo, slice(at, to))
        at = to
