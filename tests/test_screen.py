"""Bounded comparison of all pairs, tiles and edit distances, against plain ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from resona.functions import kernels
from resona.operators import ann, blocks, distances, pivots, scaling, screen
from resona.operators.distances import features_of
from resona.plans import recommend


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_of_words_of_bits():
    draw = np.random.default_rng(3)
    texts = [None, "", "é😀"] + ["".join(draw.choice(list("ABCé😀"), n)) for n in (1, 5, 63, 64, 65, 127, 128, 129, 200)]
    got = kernels.levenshtein_block(kernels.Texts(texts), kernels.Texts(texts[::-1]))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[::-1]):
            assert got[i, j] == (np.inf if a is None or b is None else _distance(a, b))


@pytest.fixture(scope="module")
def odd(spark):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(150):
        v = [float(x) for x in np.round(draw.normal(size=6), 1) + (500 if i % 3 else 0)]
        rh = [float(x) for x in draw.normal(size=5)]
        cov = [2.0, 0.3, 0.3, 1.0 + i / 100]
        rows.append((i, v, rh, v[:2] + cov, "".join("ABCD"[int(abs(x)) % 4] for x in v + rh)))
    rows[3] = (3, None, *rows[3][2:])
    rows[4] = (4, [float("nan")] * 6, *rows[4][2:])
    rows[5] = (5, [1e20] * 6, *rows[5][2:])  # too large for single precision
    rows += [(200, *rows[20][1:]), (201, *rows[20][1:]), (20, *rows[20][1:])]  # equal rows, a repeated id
    return spark.createDataFrame(rows, "id long, rp array<double>, rh array<double>, mfcc array<double>, notes string").coalesce(3).localCheckpoint()


@pytest.mark.parametrize("mode", ["after_join", "before_join"])
def test_tiles_and_bounds_rank_like_all_exact_distances(odd, mode, monkeypatch):
    """Long lists (tiles) and short ones (sent blocks) against `recommend`, which compares every pair exactly."""
    monkeypatch.setattr(blocks, "TRACK_PARTS", 2)
    monkeypatch.setattr(blocks, "QUERY_PARTS", 3)
    features = features_of(["rp", "rh", "mfcc", "skl", "notes"], {"rh": 2.0})
    want = recommend.recommend(odd, odd, features, 8, mode)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.aggregated, 9)) for r in df.collect())
    want = key(want)
    for sent in (0, 1 << 64):
        monkeypatch.setattr(blocks, "SENT_BYTES", sent)
        many = recommend.recommend_many(odd, odd, features, 8, mode)
        assert key(many) == want
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and ("CoGroup" in plan) == (sent == 0)


def test_similarity_join_equals_the_join_of_candidates(odd, monkeypatch):
    """Also with a repeated id whose rows differ, and with long lists; no list of candidates is shuffled."""
    model = ann.projections(5, 0.4, 2)
    rows = odd.select("id", "rh").union(odd.where("id = 7").select(F.lit(20).cast("long"), "rh"))
    key = lambda df: sorted((r.query_id, r.id, round(r.distance, 9)) for r in df.collect())
    want = key(ann.candidate_distances(model, rows, rows, "rh").where("distance <= 1.9"))
    for sent in (0, 1 << 64):
        monkeypatch.setattr(blocks, "SENT_BYTES", sent)
        assert key(ann.similarity_join(model, rows, rows, "rh", 1.9)) == want


def test_neighbours_of_all_send_a_chunk_once_per_tile(odd):
    """Chunks go to the tiles, not to each of their pairs."""
    found = pivots.cut(odd.dropDuplicates(["id"]), "rh", 5, 3, pivots=8, chunk=8)
    plan = pivots.nearest_of_all(found)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan
    got = sorted((r.query_id, r["rank"], r.id) for r in pivots.nearest_of_all(found).collect())
    rows = {r.id: np.array(r.rh) for r in odd.select("id", "rh").dropDuplicates(["id"]).collect()}
    want = []
    for q, v in rows.items():
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows.items() if i != q)[:3]
        want += [(q, rank, i) for rank, (_, i) in enumerate(near, 1)]
    assert got == sorted(want)


def _gaussians(draw, n, spread):
    out = []
    for _ in range(n):
        a = draw.normal(size=(2, 2)) * 10.0 ** draw.uniform(-1, spread)
        out.append([*(draw.normal(size=2) * 10.0**spread).tolist(), *(a @ a.T + 0.01 * np.eye(2)).ravel().tolist()])
    return out


@pytest.mark.parametrize("spread", [0, 1])
def test_products_bound_divergences_and_chroma(spread):
    """Bounds hold, what is measured are the numbers of the plain comparison, extremes are the same; also beyond the largest distance."""
    draw = np.random.default_rng(11 + spread)

    def rows(n, key):
        chroma = [np.abs(draw.normal(size=12 * int(b))).tolist() for b in draw.integers(1, 9, n)]
        columns = {"mfcc": _gaussians(draw, n, spread), "chroma": chroma}
        if key == "id":
            columns["mfcc"][2:5] = [None, [0.0] * 6, [float("nan")] * 6]
            columns["chroma"][2:5] = [None, [1.0] * 13, [float("nan")] * 12]
        columns["mfcc"][7], columns["chroma"][7] = columns["mfcc"][6], columns["chroma"][6]
        kind = pa.list_(pa.float64())
        return screen.Rows(pa.RecordBatch.from_pydict({key: pa.array(range(n)), **{c: pa.array(v, kind) for c, v in columns.items()}}))

    tracks, queries = rows(300, "id"), rows(40, "query_id")
    for name in ("js", "skl", "chroma"):
        feature = features_of([name])[0]
        want = distances.block_distances(feature, tracks.column(feature.column), queries.values(feature.column))
        low, high = np.full(40, np.inf), np.full(40, -np.inf)
        for piece in screen.pieces([feature], tracks, queries):
            cells, part = piece.cells[0], want[piece.at : piece.at + 300]
            good = np.isfinite(part) & (part <= (feature.max_distance or np.inf))
            assert isinstance(cells, screen.Bounds) and (piece.complete() == good).all()
            with np.errstate(invalid="ignore"):
                gap = np.where(good, cells.key(np.where(good, part, 0.0)) - cells.least, 0.0)
            assert (gap >= 0).all() and (gap <= cells.error + cells.relative * np.abs(cells.least)).all()
            track, query = np.nonzero(good)
            np.testing.assert_allclose(cells.measured(track, query), part[track, query], rtol=0 if name != "chroma" else 1e-9, atol=1e-12)
            screen.widen(piece, piece.complete(), 0, low, high)
        good = np.isfinite(want) & (want <= (feature.max_distance or np.inf))
        np.testing.assert_allclose(low, np.where(good, want, np.inf).min(axis=0), rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(high, np.where(good, want, -np.inf).max(axis=0), rtol=1e-9, atol=1e-12)


def test_mixtures_too_flat_for_products_are_compared_exactly():
    rows = [[0.0, 0.0, 1e-9, 0.0, 0.0, 1e-9], [3e4, 3e4, 1e-9, 0.0, 0.0, 1e-9]]
    tracks = screen.Rows(pa.RecordBatch.from_pydict({"mfcc": pa.array(rows, pa.list_(pa.float64()))}))
    for feature in features_of(["js", "skl"]):
        assert all(not isinstance(p.cells[0], screen.Bounds) for p in screen.pieces([feature], tracks, tracks))


def test_a_ranking_of_many_sets_is_that_of_exact_distances(spark, monkeypatch):
    """All eight features by sets, with copies, missing values and far Gaussians, in tiles."""
    draw = np.random.default_rng(13)
    rows = []
    for i, g in enumerate(_gaussians(draw, 90, 1)):
        v = draw.normal(size=6).tolist()
        chroma = np.abs(draw.normal(size=12 * int(draw.integers(2, 6)))).tolist()
        rows.append((i, v, v[:3], v[3:], g, "".join(draw.choice(list("ABCD"), int(draw.integers(0, 70)))), chroma))
    rows[4] = (4, *rows[4][1:4], None, *rows[4][5:])
    rows[9] = (9, *rows[9][1:6], None)
    rows += [(100, *rows[20][1:]), (101, *rows[20][1:])]
    kinds = "id long, rp array<double>, rh array<double>, bh array<double>, mfcc array<double>, notes string, chroma array<double>"
    cat = spark.createDataFrame(rows, kinds).coalesce(3).localCheckpoint()
    monkeypatch.setattr(blocks, "TRACK_PARTS", 2)
    monkeypatch.setattr(blocks, "QUERY_PARTS", 2)
    monkeypatch.setattr(blocks, "SENT_BYTES", 0)
    sets = {"one": ["chroma"], "two": ["js", "skl"], "notes": ["notes", "rp"]}
    names = ["chroma", "js", "skl", "notes", "rp"]
    got = recommend.recommend_sets(cat, cat, features_of(names), sets, 7).collect()
    every = blocks.distance_rows(cat, cat, features_of(names))
    scaled = scaling.scale_rows(every, features_of(names), "after_join", "drop").collect()
    for name, members in sets.items():
        lists = {}
        for r in scaled:
            lists.setdefault(r.query_id, []).append((round(sum(r[f"scaled_{m}"] for m in members) / len(members), 9), r.id))
        want = {q: sorted(x)[:7] for q, x in lists.items()}
        found = {}
        for r in sorted((r for r in got if r.feature_set == name), key=lambda r: r["rank"]):
            found.setdefault(r.query_id, []).append((round(r.aggregated, 9), r.id))
        assert {q: sorted(x) for q, x in found.items()} == want
