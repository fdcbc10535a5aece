"""Merging, repair, labels, statistics and hot groups against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.operators import catalogue as C
from resona.operators import learn
from resona.operators import statistics as S

RNG = np.random.default_rng(11)


def test_repair_keeps_ids_seen_once(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 1)], "id string, v int")
    assert sorted(r["id"] for r in C.unique_rows(df, ["id"]).collect()) == ["b"]
    assert sorted(r["id"] for r in C.duplicate_rows(df, ["id"]).collect()) == ["a", "a", "c", "c"]
    assert [tuple(r) for r in C.removed_by_dedup(df).collect()] == [("c", 1)]
    report = C.validation_report(df).collect()[0].asDict()
    assert report == {"rows": 5, "ids": 3, "unique_ids": 1, "rows_of_repeated_ids": 4, "distinct_rows": 4}
    pairs = sorted(tuple(r) for r in C.compare_with_first(df, ["v"]).collect())
    assert pairs == [("a", 2, 1, 1), ("a", 2, 2, 1), ("c", 2, 1, 1), ("c", 2, 1, 1)]


def test_assemble_repeated_ids(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 5)], "id string, a int")
    b = spark.createDataFrame([("x", 7), ("x", 8)], "id string, b int")
    assert sorted(tuple(r) for r in C.assemble([a, b]).collect()) == [("x", 1, 7), ("x", 1, 8), ("x", 2, 7), ("x", 2, 8)]
    assert [tuple(r) for r in C.assemble([a, b], repeated="first").collect()] == [("x", 1, 7)]
    left = C.assemble([a, b], how="left", repeated="first").collect()
    assert sorted(tuple(r) for r in left) == [("x", 1, 7), ("y", 5, None)]


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "id string, t int, v string")
    assert sorted(tuple(r) for r in C.keep_last(df, ["id"], ["t"]).collect()) == [("a", 3, "y"), ("b", 2, "z")]


@pytest.mark.parametrize("n", [0, 1, 250, 999, 1000, 5000])
def test_subset_has_exactly_n_rows_and_nests(spark, n):
    df = spark.range(1000).repartition(7)
    got = {r["id"] for r in C.subset(df, n).collect()}
    assert len(got) == min(n, 1000)
    again = {r["id"] for r in C.subset(df.repartition(3), n).collect()}
    smaller = {r["id"] for r in C.subset(df, n // 2).collect()}
    assert got == again and smaller <= got


def test_consistency_and_alignment(spark):
    a = spark.createDataFrame([("x",), ("y",)], "id string")
    b = spark.createDataFrame([("x",), ("x",), ("z",)], "id string")
    got = {r["id"]: (r["a"], r["b"]) for r in C.id_consistency({"a": a, "b": b}).collect()}
    assert got == {"x": (1, 2), "y": (1, 0), "z": (0, 1)}
    counts = {r["feature"]: (r["rows"], r["ids"], r["repeated_ids"]) for r in C.id_counts({"a": a, "b": b}).collect()}
    assert counts == {"a": (2, 2, 0), "b": (3, 2, 1)}
    features = spark.createDataFrame([("m/Rock/One.MP3", 1), ("m/Two.wav", 2)], "id string, v int")
    labels = spark.createDataFrame([("one", "Rock"), ("three", "Pop")], "id string, class string")
    assert [(r["id"], r["class"]) for r in C.align_labels(features, labels, True, True).collect()] == [("m/Rock/One.MP3", "Rock")]


def test_parts_cover_everything_once(spark):
    df = spark.range(500)
    parts = [C.part_of(df, i, 4) for i in range(4)]
    assert sum(p.count() for p in parts) == 500
    assert all(p.count() > 60 for p in parts)


def hot(n=6000):
    """A third of all rows in one group, values with ties and extremes."""
    keys = RNG.integers(0, 20, n)
    keys[: n // 3] = 7
    values = np.round(RNG.normal(size=n) * 10, 1)
    values[:5] = [1e12, -1e12, 0, 0, 0]
    return keys, values


@pytest.mark.parametrize("shape", ["hot", "constant", "two", "ties"])
def test_exact_median(spark, shape):
    keys, values = hot()
    if shape == "constant":
        values[:] = 4.5
    if shape == "two":
        keys = np.arange(len(keys)) // 2
    if shape == "ties":
        values = np.sign(values)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)], "k int, v double").repartition(6)
    got = {r["k"]: r["median"] for r in S.median_per_group(df, ["k"], "v").collect()}
    assert got == {int(k): float(np.median(values[keys == k])) for k in set(keys)}


def test_seven_statistics_match_numpy(spark):
    keys, values = hot()
    values = values[5:]
    keys = keys[5:]
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)] + [(99, 3.0), (99, 3.0)], "k int, v double")
    for bounded in (True, False):
        got = {r["k"]: r for r in S.seven_statistics(df, ["k"], "v", bounded).collect()}
        for k in set(keys):
            x = values[keys == k]
            c = x - x.mean()
            expected = [x.mean(), x.var(), (c**3).mean() / x.std() ** 3, (c**4).mean() / x.var() ** 2, np.median(x), x.min(), x.max()]
            assert np.allclose([got[int(k)][s] for s in S.SEVEN], expected)
        assert [got[99][s] for s in S.SEVEN] == [3.0, 0.0, 0.0, 0.0, 3.0, 3.0, 3.0]


def test_gaussian_of_frames_matches_numpy(spark):
    frames = RNG.normal(size=(300, 4))
    frames[:, 1] += 1e3
    ids = RNG.integers(0, 3, 300)
    df = spark.createDataFrame([(int(i), [float(v) for v in f]) for i, f in zip(ids, frames)], "id int, vec array<double>").repartition(5)
    for r in S.gaussian_of_frames(df, 4).collect():
        part = frames[ids == r["id"]]
        assert np.allclose(r["mean"], part.mean(0)) and np.allclose(r["var"], part.var(0))
        assert np.allclose(np.reshape(r["cov"], (4, 4)), np.cov(part.T))
        assert r["gaussian"] == r["mean"] + r["cov"]


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_positions_do_not_depend_on_ranges(spark, width):
    keys, _ = hot(900)
    times = RNG.permutation(900) * 3
    df = spark.createDataFrame([(int(k), int(t)) for k, t in zip(keys, times)], "k int, t int").repartition(4)
    got = {(r["k"], r["t"]): (r["position"], r["previous"]) for r in S.positions(df, "k", "t", width).collect()}
    for k in set(keys):
        ordered = sorted(int(t) for t in times[keys == k])
        for i, t in enumerate(ordered):
            assert got[(int(k), t)] == (i, ordered[i - 1] if i else None)


def test_labels(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", "z")], "id string, class string")
    base = learn.majority_baseline(df).collect()[0]
    assert (base["class"], base["n"], base["share"]) == ("y", 2, 0.5)
    assert sorted(r["id"] for r in learn.with_minimum(df, 2).collect()) == ["b", "c"]
    table = learn.to_table(df, ["x", "y", "z"])
    assert Counter((r["id"], r["class"]) for r in learn.from_table(table, ["x", "y", "z"]).collect()) == Counter(
        (r["id"], r["class"]) for r in df.collect()
    )
    paths = spark.createDataFrame([("Rock/a_1.mp3",), ("Pop/b_2.mp3",)], "id string")
    assert sorted(r["class"] for r in learn.labels_from_paths(paths).collect()) == ["Pop", "Rock"]
    assert sorted(r["class"] for r in learn.labels_from_names(paths).collect()) == ["a", "b"]


def clusters(spark, n=90):
    rows = []
    for i in range(n):
        c = i % 3
        v = RNG.normal(size=4) + 6 * np.eye(4)[c]
        rows.append((str(i), "abc"[c], [float(x) for x in v], int(c == 0), int(c != 1)))
    return spark.createDataFrame(rows, "id string, class string, v array<double>, first int, not_second int")


def test_svm_learns_saves_and_loads(spark, tmp_path):
    df = clusters(spark)
    model = learn.train(df, "v", 10)
    learn.save(model, f"{tmp_path}/model")
    predicted = learn.classify(learn.load(f"{tmp_path}/model"), df, "v")
    assert learn.accuracy(predicted).collect()[0]["accuracy"] > 0.95
    assert set(learn.classify(model, df.drop("class"), "v").columns) == {"id", "predicted_class"}


def test_cross_validation(spark):
    df = clusters(spark)
    assert learn.cross_validate(df, "v", folds=3, iterations=5).avgMetrics[0] > 0.9
    columns = learn.cross_validate_columns(df, ["first", "not_second"], "v", folds=3, iterations=5).collect()
    assert [r["category"] for r in columns] == ["first", "not_second"] and all(r["accuracy"] > 0.8 for r in columns)
