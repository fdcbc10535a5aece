"""Distance kernels against plain NumPy definitions, and their properties."""

import numpy as np
import pyarrow as pa
import pytest

from resona.functions import kernels as K

RNG = np.random.default_rng(3)
D = 13


def gaussians(n, d=D):
    out = []
    for _ in range(n):
        frames = RNG.normal(size=(60, d)) * RNG.uniform(0.5, 3, d)
        out.append(np.concatenate([frames.mean(0) + RNG.normal(size=d), np.cov(frames.T).ravel()]))
    return np.array(out)


def as_lists(rows):
    return pa.array([None if r is None else [float(v) for v in r] for r in rows], pa.list_(pa.float64()))


def js_plain(a, b, d=D):
    m1, c1, m2, c2 = a[:d], a[d:].reshape(d, d), b[:d], b[d:].reshape(d, d)
    mean = (m1 + m2) / 2
    cov = (c1 + np.outer(m1, m1)) / 2 + (c2 + np.outer(m2, m2)) / 2 - np.outer(mean, mean)
    log_det = lambda c: np.linalg.slogdet(c)[1]
    return max(0.0, log_det(cov) / 2 - log_det(c1) / 4 - log_det(c2) / 4)


def skl_plain(a, b, d=D):
    m1, c1, m2, c2 = a[:d], a[d:].reshape(d, d), b[:d], b[d:].reshape(d, d)
    i1, i2, delta = np.linalg.inv(c1), np.linalg.inv(c2), m1 - m2
    return max(0.0, (np.trace(c1 @ i2) + np.trace(c2 @ i1) + delta @ (i1 + i2) @ delta - 2 * d) / 4)


def high_pass_plain(x):
    k = np.tan(np.pi * 0.1 / 2)
    b0, a1 = 1 / (1 + k), (k - 1) / (1 + k)
    y, px, py = [], 0.0, 0.0
    for v in x:
        py = b0 * v - b0 * px - a1 * py
        px = v
        y.append(py)
    return np.array(y)


def ordered(c, q):
    return (c, q) if c.shape[1] > q.shape[1] else (q, c)


def chroma_plain(c, q):
    a, b = ordered(c, q)
    line = sum(np.correlate(a[i], b[i], "same") for i in range(12))
    return high_pass_plain(line - line[0]).max()


def plane_plain(a, b):
    """Full 2-D correlation: cell (r, k) is lag (r - 11, k - (lb - 1))."""
    la, lb = a.shape[1], b.shape[1]
    out = np.zeros((23, la + lb - 1))
    for r in range(23):
        for k in range(la + lb - 1):
            dr, dk = r - 11, k - (lb - 1)
            for i in range(12):
                if 0 <= i + dr < 12:
                    lo, hi = max(0, -dk), min(lb, la - dk)
                    if hi > lo:
                        out[r, k] += a[i + dr, lo + dk : hi + dk] @ b[i, lo:hi]
    return out


def test_filter_constants():
    assert K.HIGHPASS_GAIN == pytest.approx(0.8632712640026805, abs=1e-15)
    assert K.HIGHPASS_POLE == pytest.approx(0.726542528005361, abs=1e-15)
    x = RNG.normal(size=50)
    assert np.allclose(K.high_pass(x[None])[0], high_pass_plain(x))


def test_euclidean_close_and_far():
    q = RNG.normal(size=(5, 40)) * 100
    c = np.vstack([q + 1e-7, RNG.normal(size=(50, 40)) * 100])
    out = K.euclidean_block(as_lists(c), q)
    assert np.allclose(out, np.linalg.norm(c[:, None] - q[None], axis=2), rtol=1e-9, atol=1e-12)
    bad = K.euclidean_block(as_lists([None, [1.0], [np.nan] * 40, c[0]]), q)
    assert np.isinf(bad[:3]).all() and np.isfinite(bad[3]).all()


def test_gaussian_divergences_match_definitions():
    rows = gaussians(8)
    column = as_lists(rows)
    js, skl = K.jensen_shannon_block(column, rows), K.symmetric_kl_block(column, rows)
    for i in range(8):
        for j in range(8):
            assert js[i, j] == pytest.approx(js_plain(rows[i], rows[j]), abs=1e-9)
            assert skl[i, j] == pytest.approx(skl_plain(rows[i], rows[j]), rel=1e-8, abs=1e-8)
    assert np.allclose(js, js.T) and np.allclose(skl, skl.T)
    assert np.allclose(np.diag(js), 0, atol=1e-9) and np.allclose(np.diag(skl), 0, atol=1e-8)


def test_not_definite_is_infinite():
    rows = gaussians(2)
    singular = rows[0].copy()
    singular[D:] = 0
    negative = rows[0].copy()
    negative[D] = -1
    column = as_lists([rows[1], singular, negative, None])
    for block in (K.jensen_shannon_block, K.symmetric_kl_block):
        out = block(column, [rows[0]])
        assert np.isfinite(out[0, 0]) and np.isinf(out[1:, 0]).all()
        assert np.isinf(block(column, [singular])).all()


def test_cholesky_matches_numpy():
    stack = gaussians(6)[:, D:].reshape(-1, D, D)
    assert np.allclose(K.cholesky_lower(stack), np.linalg.cholesky(stack))


@pytest.mark.parametrize("lengths", [(5, 5), (9, 4), (4, 9), (8, 5), (1, 1), (2, 7), (30, 17)])
def test_chroma_variants(lengths):
    lc, lq = lengths
    c, q = RNG.random((12, lc)), RNG.random((12, lq))
    column = as_lists([c.ravel()])
    assert K.chroma_same_block(column, [q.ravel()])[0, 0] == pytest.approx(chroma_plain(c, q), abs=1e-9)
    a, b = ordered(c, q)
    full = plane_plain(a, b)
    lb = b.shape[1]
    start = lb // 2
    same = full[6:18, start : start + a.shape[1]]
    assert K.chroma_same_2d_block(column, [q.ravel()])[0, 0] == pytest.approx(same.max(), abs=1e-9)

    # the other two read the vector beat by beat
    c2, q2 = c.ravel().reshape(-1, 12).T, q.ravel().reshape(-1, 12).T
    a, b = ordered(c2, q2)
    full = plane_plain(a, b)
    top = np.unravel_index(full.argmax(), full.shape)[0]
    assert K.chroma_full_2d_block(column, [q.ravel()])[0, 0] == pytest.approx(high_pass_plain(full[top]).max(), abs=1e-9)
    line = full[11, start : start + a.shape[1]]
    expected = high_pass_plain(line - line[0]).max()
    assert K.chroma_pitch_row_block(column, [q.ravel()])[0, 0] == pytest.approx(expected, abs=1e-9)


def test_chroma_many_lengths_at_once():
    rows = [RNG.random((12, n)) for n in RNG.integers(1, 60, 80)]
    queries = [RNG.random((12, n)) for n in (3, 20, 64)]
    column = as_lists([None] + [r.ravel() for r in rows] + [[1.0] * 13])
    out = K.chroma_same_block(column, [q.ravel() for q in queries])
    assert np.isinf(out[0]).all() and np.isinf(out[-1]).all()
    for i, r in enumerate(rows):
        for j, q in enumerate(queries):
            assert out[i + 1, j] == pytest.approx(chroma_plain(r, q), abs=1e-9)
