"""Distance kernels on one Arrow batch against a bounded block of queries.

Every kernel returns an (n, m) matrix for n catalogue rows and m queries. A row the metric
cannot judge (missing, wrong length, singular) gets +inf, which callers drop.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

# fixed values: first-order Butterworth high-pass at 0.1 of Nyquist, by the bilinear transform
_K = np.tan(np.pi * 0.1 / 2)
HIGHPASS_GAIN = 1.0 / (1.0 + _K)
HIGHPASS_POLE = (1.0 - _K) / (1.0 + _K)

PITCHES = 12
_FFT_CELLS = 4_000_000  # cells transformed at a time


def dense(column: pa.Array, width: int, finite: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """List column to (n, width) plus the mask of rows that have this shape and only (finite) numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    good = lengths == width
    if good.any() and width:
        picked = column.filter(pa.array(good))
        values = picked.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[good] = values.reshape(-1, width)
        if finite:
            clean = np.isfinite(out).all(axis=1)
            out[~clean] = 0.0
            good = good & clean
    return out, good


def ragged(column: pa.Array) -> list[np.ndarray | None]:
    """List column of chroma to one array per row, None for null or unreadable rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (lengths > 0) & (lengths % PITCHES == 0) & (broken[ends] == broken[ends - lengths])
    return [values[e - n : e] if ok else None for e, n, ok in zip(ends, lengths, good)]


_DIFFERENCE_CELLS = 1 << 17


def euclidean_block(column: pa.Array, queries: Sequence[Sequence[float]]) -> np.ndarray:
    """L2 by differences, query by query, so a distance does not depend on the queries beside it.

    Rows are taken in pieces that stay in the cache.
    """
    q = np.asarray(queries, dtype=np.float64)
    c, good = dense(column, q.shape[1])
    out = np.empty((len(c), len(q)))
    step = max(1, _DIFFERENCE_CELLS // max(1, q.shape[1]))
    for at in range(0, len(c), step):
        part = c[at : at + step]
        for j, query in enumerate(q):
            diff = part - query
            out[at : at + step, j] = np.einsum("ij,ij->i", diff, diff)
    out = np.sqrt(out)
    out[~good] = np.inf
    return out


# Gaussians -----------------------------------------------------------------------------


def gaussian_width(length: int) -> int:
    """d of a flat mean + covariance vector of d + d*d numbers."""
    d = int((np.sqrt(1 + 4 * length) - 1) / 2 + 0.5)
    if d + d * d != length:
        raise ValueError(f"{length} numbers are no mean and covariance")
    return d


def stored_width(length: int) -> int:
    """d of a flat mean, covariance, log-determinant and inverse of d + d*d + 1 + d*d numbers."""
    d = int((np.sqrt(8 * length - 7) - 1) / 4 + 0.5)
    if d + 2 * d * d + 1 != length:
        raise ValueError(f"{length} numbers are no mean, covariance, log-determinant and inverse")
    return d


def cholesky_lower(matrices: np.ndarray) -> np.ndarray:
    """Lower factors of a stack, read from the lower triangles; NaN where not positive definite."""
    d = matrices.shape[-1]
    lower = np.zeros_like(matrices)
    with np.errstate(invalid="ignore", divide="ignore"):
        for j in range(d):
            pivot = matrices[:, j, j] - np.einsum("nk,nk->n", lower[:, j, :j], lower[:, j, :j])
            lower[:, j, j] = np.sqrt(np.where(pivot > 0, pivot, np.nan))
            below = matrices[:, j + 1 :, j] - np.einsum(
                "nik,nk->ni", lower[:, j + 1 :, :j], lower[:, j, :j]
            )
            lower[:, j + 1 :, j] = below / lower[:, j, j][:, None]
    return lower


def log_det(matrices: np.ndarray) -> np.ndarray:
    """Log-determinants; NaN where not positive definite."""
    diagonal = np.einsum("nii->ni", cholesky_lower(matrices))
    return 2.0 * np.log(diagonal).sum(axis=1)


class Gaussians:
    """Means, covariances and, on demand, log-determinants and inverses of a stack."""

    _inverse: np.ndarray | None = None

    def __init__(self, flat: np.ndarray, good: np.ndarray | None = None):
        d = gaussian_width(flat.shape[1])
        self.mean = flat[:, :d]
        self.cov = flat[:, d:].reshape(-1, d, d).copy()
        if good is not None:
            self.cov[~good] = np.nan
        self.log_det = log_det(self.cov)
        self.definite = np.isfinite(self.log_det)

    @classmethod
    def stored(cls, flat: np.ndarray, good: np.ndarray | None = None) -> Gaussians:
        """From vectors that bring their log-determinant and inverse along: mean, covariance, log-determinant, inverse."""
        d = stored_width(flat.shape[1])
        out = cls.__new__(cls)
        out.mean, out.cov = flat[:, :d], flat[:, d : d + d * d].reshape(-1, d, d)
        good = np.ones(len(flat), bool) if good is None else good
        out.log_det = np.where(good, flat[:, d + d * d], np.nan)
        out.definite = np.isfinite(out.log_det)
        out._inverse = flat[:, d + d * d + 1 :].reshape(-1, d, d)
        return out

    def inverse(self) -> np.ndarray:
        if self._inverse is not None:
            return self._inverse
        d = self.cov.shape[-1]
        low = np.tril(self.cov)
        symmetric = low + np.transpose(np.tril(self.cov, -1), (0, 2, 1))
        symmetric[~self.definite] = np.eye(d)
        return np.linalg.inv(symmetric)

    def keep_inverse(self) -> Gaussians:
        self._inverse = self.inverse()
        return self

    def take(self, places: np.ndarray) -> Gaussians:
        out = type(self).__new__(type(self))
        out.mean, out.cov, out.log_det, out.definite = (x[places] for x in (self.mean, self.cov, self.log_det, self.definite))
        out._inverse = None if self._inverse is None else self._inverse[places]
        return out


def _settle(div: np.ndarray) -> np.ndarray:
    """Not a number counts as unrelated, rounding below zero as identical."""
    div = np.where(np.isnan(div), np.inf, div)
    return np.where(div <= 0, 0.0, div)


#: Widest Gaussians that are compared entry by entry for all pairs at once.
SMALL = 4


def _each(operation: np.ufunc, a: np.ndarray, b: np.ndarray, beside: bool) -> np.ndarray:
    """Of all pairs, or of rows beside each other."""
    return operation(a, b) if beside else operation.outer(a, b)


def _log_det_of_mixtures(c: Gaussians, q: Gaussians, beside: bool = False) -> np.ndarray:
    """(n, m) log-determinants of the mixtures (n of rows `beside` each other), the factor's entries written out; NaN where not positive definite."""
    d = c.mean.shape[1]
    delta = [_each(np.subtract, c.mean[:, i], q.mean[:, i], beside) for i in range(d)]
    lower, total = {}, 0.0
    with np.errstate(invalid="ignore", divide="ignore"):
        for j in range(d):
            for i in range(j, d):
                entry = 0.5 * _each(np.add, c.cov[:, i, j], q.cov[:, i, j], beside) + 0.25 * delta[i] * delta[j]
                for k in range(j):
                    entry -= lower[i, k] * lower[j, k]
                lower[i, j] = np.sqrt(np.where(entry > 0, entry, np.nan)) if i == j else entry / lower[j, j]
            total = total + np.log(lower[j, j])
    return 2.0 * total


def jensen_shannon_raw(c: Gaussians, q: Gaussians) -> np.ndarray:
    if c.mean.shape[1] <= SMALL:
        div = 0.5 * _log_det_of_mixtures(c, q) - 0.25 * c.log_det[:, None] - 0.25 * q.log_det[None, :]
        return np.where(c.definite[:, None] & q.definite[None, :], div, np.inf)
    out = np.full((len(c.mean), len(q.mean)), np.inf)
    for j in range(len(q.mean)):
        if not q.definite[j]:
            continue
        delta = c.mean - q.mean[j]
        mixture = 0.5 * (c.cov + q.cov[j]) + 0.25 * delta[:, :, None] * delta[:, None, :]
        div = 0.5 * log_det(mixture) - 0.25 * c.log_det - 0.25 * q.log_det[j]
        out[:, j] = np.where(c.definite, div, np.inf)
    return out


def symmetric_kl_raw(c: Gaussians, q: Gaussians) -> np.ndarray:
    n, m, d = len(c.mean), len(q.mean), c.mean.shape[1]
    c_inv, q_inv = c.inverse(), q.inverse()
    c_cov = np.where(c.definite[:, None, None], c.cov, 0.0)
    q_cov = np.where(q.definite[:, None, None], q.cov, 0.0)
    if d <= SMALL:
        total = _four_divergences(c.mean, q.mean, c_cov, q_cov, c_inv, q_inv, False)
        return np.where(c.definite[:, None] & q.definite[None, :], 0.25 * total, np.inf)
    out = np.full((n, m), np.inf)
    for j in range(m):
        if q.definite[j]:
            # query by query, so that the last digit does not depend on the queries beside it
            traces = np.einsum("nik,ki->n", c_cov, q_inv[j]) + np.einsum("nik,ki->n", c_inv, q_cov[j])
            delta = c.mean - q.mean[j]
            quad = np.einsum("ni,nij,nj->n", delta, c_inv + q_inv[j], delta)
            out[:, j] = np.where(c.definite, 0.25 * (traces + quad - 2 * d), np.inf)
    return out


def _four_divergences(c_mean, q_mean, c_cov, q_cov, c_inv, q_inv, beside: bool) -> np.ndarray:
    """Four times the symmetric divergence of small Gaussians, entry by entry."""
    d = c_mean.shape[1]
    delta = [_each(np.subtract, c_mean[:, i], q_mean[:, i], beside) for i in range(d)]
    total = np.full(delta[0].shape, -2.0 * d)
    with np.errstate(invalid="ignore"):
        for i in range(d):
            for k in range(d):
                total += _each(np.multiply, c_cov[:, i, k], q_inv[:, k, i], beside)
                total += _each(np.multiply, c_inv[:, i, k], q_cov[:, k, i], beside)
                total += _each(np.add, c_inv[:, i, k], q_inv[:, i, k], beside) * delta[i] * delta[k]
    return total


def jensen_shannon_beside(c: Gaussians, q: Gaussians) -> np.ndarray:
    """Row by row, of small definite Gaussians: the numbers that `jensen_shannon_block` has for these pairs."""
    return _settle(0.5 * _log_det_of_mixtures(c, q, True) - 0.25 * c.log_det - 0.25 * q.log_det)


def symmetric_kl_beside(c: Gaussians, q: Gaussians) -> np.ndarray:
    return _settle(0.25 * _four_divergences(c.mean, q.mean, c.cov, q.cov, c.inverse(), q.inverse(), True))


def _gaussian_block(column: pa.Array, queries, raw) -> np.ndarray:
    q = Gaussians(np.asarray(queries, dtype=np.float64))
    flat, good = dense(column, len(queries[0]))
    return _settle(raw(Gaussians(flat, good), q))


def jensen_shannon_block(column: pa.Array, queries) -> np.ndarray:
    return _gaussian_block(column, queries, jensen_shannon_raw)


def symmetric_kl_block(column: pa.Array, queries) -> np.ndarray:
    return _gaussian_block(column, queries, symmetric_kl_raw)


def _stored_block(column: pa.Array, queries, raw) -> np.ndarray:
    """The same out of stored factors: nothing of a track or a query alone is factorised."""
    flat, good = dense(column, len(queries[0]))
    return _settle(raw(Gaussians.stored(flat, good), Gaussians.stored(np.asarray(queries, dtype=np.float64))))


def jensen_shannon_stored_block(column: pa.Array, queries) -> np.ndarray:
    return _stored_block(column, queries, jensen_shannon_raw)


def symmetric_kl_stored_block(column: pa.Array, queries) -> np.ndarray:
    return _stored_block(column, queries, symmetric_kl_raw)


# Edit distance -------------------------------------------------------------------------

_WORD = 64
_EDIT_CELLS = 8192  # pairs that one step moves on
_SHORT_CELLS = 16384  # the same for patterns of one word


class Texts:
    """Texts as rows of letter numbers (0 is no letter of any text), lengths, and which are there."""

    def __init__(self, texts: Sequence[str | None]):
        points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.there = np.array([t is not None for t in texts], bool)
        self.lengths = np.array([len(x) for x in points], np.int64)
        self.letters = np.unique(np.concatenate([np.empty(0, np.uint32), *points]))
        self.codes = np.zeros((len(points), int(self.lengths.max(initial=0))), np.int64)
        for row, x in zip(self.codes, points):
            row[: len(x)] = np.searchsorted(self.letters, x) + 1
        self.points = points
        self._places = None

    def places(self) -> np.ndarray:
        """(letters + 1, texts) bits of the places that each letter has in the texts of at most one word; made once."""
        if self._places is None:
            self._places = np.zeros((len(self.letters) + 1, len(self.points)), np.uint64)
            for place in range(min(_WORD, self.codes.shape[1])):
                rows = np.flatnonzero((place < self.lengths) & (self.lengths <= _WORD))
                self._places[self.codes[rows, place], rows] |= np.uint64(1 << place)
        return self._places

    def masks(self, points: np.ndarray, words: int) -> np.ndarray:
        """(words, letters + 1) bits of the places that each letter of these texts has in a pattern."""
        out = np.zeros((words, len(self.letters) + 1), np.uint64)
        at = np.searchsorted(self.letters, points)
        for place, (i, x) in enumerate(zip(at.tolist(), points.tolist())):
            if i < len(self.letters) and self.letters[i] == x:
                out[place // _WORD, i + 1] |= np.uint64(1 << (place % _WORD))
        return out


def levenshtein_block(texts: Texts, queries: Texts) -> np.ndarray:
    """(n, m) edit distances, bit by bit of the query and letter by letter of all texts; missing texts are +inf to all."""
    n, m = len(texts.lengths), len(queries.lengths)
    out = np.full((n, m), np.inf)
    needed = -(-queries.lengths // _WORD)
    for words in np.unique(needed[queries.there]).tolist():
        places = np.flatnonzero(queries.there & (needed == words))
        if words == 1:
            out[:, places] = _edit_short(texts, queries, places)
            continue
        step = max(1, _EDIT_CELLS // max(1, n))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            out[:, part] = _edit_steps(texts, [queries.points[j] for j in part], words).T
    out[~texts.there] = np.inf
    return out


def _edit_short(texts: Texts, queries: Texts, places: np.ndarray) -> np.ndarray:
    """(n, places) edit distances to patterns of one word, text by text beside all patterns.

    The state is kept with its negative half inverted, so that a shift brings in what belongs there. Longer texts come first: those that
    have ended are the last rows, which later steps leave out.
    """
    n, m = len(texts.lengths), len(places)
    known = np.searchsorted(queries.letters, texts.letters)
    same = np.append(queries.letters, 0)[known] == texts.letters
    # bits of the patterns by letter of the texts, none for a letter that no pattern has
    bits = queries.places()[:, places]
    table = np.zeros((len(texts.letters) + 1, m), np.uint64)
    table[np.flatnonzero(same) + 1] = bits[known[same] + 1]
    inside = ~np.uint64(0) >> (_WORD - queries.lengths[places]).astype(np.uint64)
    order = np.argsort(-texts.lengths, kind="stable")
    out = np.empty((n, m))
    step = max(1, _SHORT_CELLS // m)
    work = np.empty((5, min(n, step), m), np.uint64)
    both, either, differ, plus, invert = np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.add, np.invert
    for at in range(0, n, step):
        rows = order[at : at + step]
        lengths = texts.lengths[rows]
        codes = np.ascontiguousarray(texts.codes[rows, : lengths[0]].T)
        work[:2] = ~np.uint64(0)
        # steps with the same texts left
        ends = np.unique(lengths)
        for first, end in zip([0, *ends.tolist()], ends.tolist()):
            live = int((lengths >= end).sum())
            up, level, equal, zero, more = work[:, :live]
            for letters in codes[first:end, :live]:
                table.take(letters, 0, equal, "clip")
                both(equal, up, zero)
                plus(zero, up, zero)
                differ(zero, up, zero)
                either(zero, equal, zero)  # no change down the diagonal, but for where `level` is not set
                both(zero, up, more)
                plus(more, more, more)
                invert(zero, equal)
                either(zero, up, zero)
                both(zero, level, zero)
                plus(zero, zero, zero)
                both(equal, level, equal)
                either(zero, equal, level)
                both(zero, equal, zero)
                either(more, zero, up)
        up, level = work[:2, : len(rows)]
        gain = np.bitwise_count(up & inside).astype(np.int64) - np.bitwise_count(~level & inside)
        out[rows] = lengths[:, None] + gain
    return out


def _edit_steps(texts: Texts, patterns: list[np.ndarray], words: int) -> np.ndarray:
    n, one = len(texts.lengths), np.uint64(1)
    if not words:
        return np.broadcast_to(texts.lengths.astype(np.float64), (len(patterns), n))
    sizes = np.array([len(p) for p in patterns])
    masks = np.stack([texts.masks(p, words) for p in patterns])
    last = ((sizes - 1) % _WORD).astype(np.uint64)[:, None]
    high = np.uint64(_WORD - 1)
    up = [np.full((len(patterns), n), ~np.uint64(0)) for _ in range(words)]
    down = [np.zeros((len(patterns), n), np.uint64) for _ in range(words)]
    score = np.repeat(sizes[:, None].astype(np.int64), n, axis=1)
    for t in range(texts.codes.shape[1]):
        letter, more, less = texts.codes[:, t], one, np.uint64(0)
        for w in range(words):
            equal, pv, mv = masks[:, w, :][:, letter], up[w], down[w]
            vertical = equal | mv
            equal |= less
            horizontal = (((equal & pv) + pv) ^ pv) | equal
            plus, minus = mv | ~(horizontal | pv), pv & horizontal
            top = last if w == words - 1 else high
            add, drop = (plus >> top) & one, (minus >> top) & one
            plus, minus = (plus << one) | more, (minus << one) | less
            up[w], down[w] = minus | ~(vertical | plus), plus & vertical
            more, less = add, drop
        change = more.astype(np.int64) - less.astype(np.int64)
        score += change if t < texts.lengths.min() else np.where(t < texts.lengths, change, 0)
    return score.astype(np.float64)


# Chroma --------------------------------------------------------------------------------


def high_pass(signals: np.ndarray) -> np.ndarray:
    """The fixed high-pass along the last axis, from zero state."""
    steps = signals.copy()
    steps[..., 1:] -= signals[..., :-1]
    steps *= HIGHPASS_GAIN
    for i in range(1, steps.shape[-1]):
        steps[..., i] += HIGHPASS_POLE * steps[..., i - 1]
    return steps


def _padded(matrices: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(matrices), PITCHES, size))
    for i, m in enumerate(matrices):
        out[i, :, : m.shape[1]] = m
    return out


def _lag_lines(cross: np.ndarray, long_is_first: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Correlation at lags start, start + 1, ... with the longer operand in front.

    `cross` holds the circular correlation with the candidate in front; swapping the operands
    mirrors the lags. Cells past `length` are zero, and `valid` marks the others.
    """
    size = cross.shape[-1]
    position = np.arange(int(length.max()))
    lags = start[:, None] + position[None, :]
    lags = np.where(long_is_first[:, None], lags, -lags) % size
    valid = position[None, :] < length[:, None]
    return np.take_along_axis(cross, lags, axis=-1) * valid, valid


class _Candidates:
    """A run of chroma matrices and their transforms, one per padded size."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows
        self.beats = np.array([r.shape[1] for r in rows])
        self._lines: dict[int, np.ndarray] = {}
        self._planes: dict[int, np.ndarray] = {}

    def size_with(self, beats: int) -> int:
        return 1 << int(np.ceil(np.log2(self.beats.max() + beats)))

    def lines(self, size: int) -> np.ndarray:
        if size not in self._lines:
            self._lines[size] = np.fft.rfft(_padded(self.rows, size))
        return self._lines[size]

    def planes(self, size: int) -> np.ndarray:
        if size not in self._planes:
            self._planes[size] = np.fft.rfft2(_padded(self.rows, size), (2 * PITCHES, size))
        return self._planes[size]


def _chroma_pairs(candidates: _Candidates, query: np.ndarray, kind: str) -> np.ndarray:
    lq = query.shape[1]
    lc = candidates.beats
    n = len(lc)
    size = candidates.size_with(lq)
    padded_query = _padded([query], size)[0]
    front = lc > lq  # on equal lengths the query goes in front
    longer, shorter = np.maximum(lc, lq), np.minimum(lc, lq)

    if kind in ("same", "pitch_row"):
        spectrum = np.einsum("npk,pk->nk", candidates.lines(size), np.conj(np.fft.rfft(padded_query)))
        cross = np.fft.irfft(spectrum, size)
        middle = (shorter - 1) // 2 if kind == "same" else shorter // 2
        line, valid = _lag_lines(cross, front, middle - (shorter - 1), longer)
        line = line - line[:, :1]
        return np.where(valid, high_pass(line), -np.inf).max(axis=1)

    shape = (2 * PITCHES, size)
    plane = np.fft.irfft2(candidates.planes(size) * np.conj(np.fft.rfft2(padded_query, shape)), shape)
    if kind == "same_2d":
        pitch_lags = np.arange(PITCHES) - (PITCHES - 1) + PITCHES // 2
        start, length = shorter // 2 - (shorter - 1), longer
    else:
        pitch_lags = np.arange(2 * PITCHES - 1) - (PITCHES - 1)
        start, length = 1 - shorter, longer + shorter - 1
    lines = []
    for lag in pitch_lags:
        picked = np.where(front, lag, -lag) % (2 * PITCHES)
        line, valid = _lag_lines(plane[np.arange(n), picked], front, start, length)
        lines.append(line)
    peaks = np.stack([np.where(valid, line, -np.inf).max(axis=1) for line in lines])
    if kind == "same_2d":
        return peaks.max(axis=0)
    top = np.stack(lines)[peaks.argmax(axis=0), np.arange(n)]
    return np.where(valid, high_pass(top), -np.inf).max(axis=1)


def _as_matrix(flat: np.ndarray, beats_first: bool) -> np.ndarray:
    return flat.reshape(-1, PITCHES).T if beats_first else flat.reshape(PITCHES, -1)


def _chroma_block(column: pa.Array, queries, kind: str, beats_first: bool) -> np.ndarray:
    rows = ragged(column)
    out = np.full((len(rows), len(queries)), np.inf)
    index = np.array([i for i, r in enumerate(rows) if r is not None], dtype=int)
    # candidates of like length share a transform of one size
    index = index[np.argsort([len(rows[i]) for i in index], kind="stable")]
    matrices = [_as_matrix(np.asarray(q, dtype=np.float64), beats_first) for q in queries]
    at = 0
    while at < len(index):
        longest = len(rows[index[min(len(index), at + 512) - 1]]) // PITCHES
        cells = 8 * PITCHES * longest * (1 if kind in ("same", "pitch_row") else 2)
        part = index[at : at + max(1, min(512, _FFT_CELLS // cells))]
        candidates = _Candidates([_as_matrix(rows[i], beats_first) for i in part])
        for j, query in enumerate(matrices):
            out[part, j] = _chroma_pairs(candidates, query, kind)
        at += len(part)
    return out


def chroma_same_block(column: pa.Array, queries) -> np.ndarray:
    return _chroma_block(column, queries, "same", False)


def chroma_same_2d_block(column: pa.Array, queries) -> np.ndarray:
    return _chroma_block(column, queries, "same_2d", False)


def chroma_full_2d_block(column: pa.Array, queries) -> np.ndarray:
    return _chroma_block(column, queries, "full_2d", True)


def chroma_pitch_row_block(column: pa.Array, queries) -> np.ndarray:
    return _chroma_block(column, queries, "pitch_row", True)


BLOCKS = {
    "euclidean": euclidean_block,
    "js": jensen_shannon_block,
    "skl": symmetric_kl_block,
    "js_stored": jensen_shannon_stored_block,
    "skl_stored": symmetric_kl_stored_block,
    "chroma": chroma_same_block,
    "chroma_2d": chroma_same_2d_block,
    "chroma_full": chroma_full_2d_block,
    "chroma_row": chroma_pitch_row_block,
}
