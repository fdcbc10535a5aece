"""Scaling modes, batches, refine and approximate search against small brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.operators import ann, blocks, distances, neighbours, pivots, scaling
from resona.operators.distances import FEATURES, Feature, features_of
from resona.operators.reuse import observed
from resona.plans import evaluate, recommend, refine
from resona.workload import cataloguing, evaluation, files, tables

RNG = np.random.default_rng(5)
E = features_of(["rh", "bh"])


def small(spark, n=60):
    rows = [(f"t{i:03d}", RNG.normal(size=5).tolist(), RNG.normal(size=3).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, rh array<double>, bh array<double>").repartition(5)


def plain_scores(rows, query, names=("rh", "bh")):
    data = {r[0]: r[1:] for r in rows}
    total = 0
    for i in range(len(names)):
        d = np.array([np.linalg.norm(np.subtract(v[i], data[query][i])) for v in data.values()])
        total = total + (d - d.min()) / (d.max() - d.min())
    order = sorted(zip(total / len(names), data))
    return order


def test_recommend_and_batch_agree_with_brute_force(spark):
    rows, df = small(spark)
    expected = {q: plain_scores(rows, q)[:7] for q in ("t000", "t031")}
    queries = df.filter(F.col("id").isin(*expected))
    one = recommend.recommend(df, queries, E, 7).collect()
    many = recommend.recommend_many(df, queries, E, 7).collect()
    for found in (one, many):
        for q, best in expected.items():
            mine = sorted((r["rank"], r["id"], r["aggregated"]) for r in found if r["query_id"] == q)
            assert [m[1] for m in mine] == [b[1] for b in best]
            assert np.allclose([m[2] for m in mine], [b[0] for b in best])


def test_full_list_is_ordered_and_whole(spark):
    rows, df = small(spark)
    out = recommend.recommend(df, df.filter("id = 't005'"), E).collect()
    assert [r["id"] for r in out] == [i for _, i in plain_scores(rows, "t005")]


def test_blocks_of_any_size_serve_every_query(spark):
    _, df = small(spark, 90)
    whole = {(r["query_id"], r["rank"]): r["id"] for r in recommend.recommend_many(df, df, E, 3).collect()}
    cut = {(r["query_id"], r["rank"]): r["id"] for r in recommend.recommend_many(df, df, E, 3, max_queries=7).collect()}
    assert whole == cut and len(whole) == 270


def test_a_distance_does_not_depend_on_the_queries_beside_it(spark):
    _, df = small(spark, 90)
    scores = []
    for n in (1, 5, 33, 90):
        list_of = df.filter(F.col("id") < f"t{n:03d}")
        assert list_of.count() == n
        found = recommend.recommend(df, list_of, E).filter("query_id = 't000'")
        scores.append({r["id"]: r["aggregated"] for r in found.collect()})
        assert recommend.feature_rankings(df, list_of, E, 2).count() == n * 4
        assert neighbours.nearest(df, list_of, "rh", 2).count() == n * 2
    assert all(s == scores[0] for s in scores)


def test_empty_query_list_gives_no_rows(spark):
    _, df = small(spark)
    none = df.filter("id = 'nobody'")
    some = df.filter("id = 't000'")
    for ask in (
        lambda q: recommend.recommend(df, q, E, 3),
        lambda q: recommend.feature_rankings(df, q, E, 3),
        lambda q: neighbours.nearest(df, q, "rh", 3),
        lambda q: refine.filter_refine(df, q, E, 3),
        lambda q: refine.prefilter(df, q, E[0], E[1:], 5, 3),
        lambda q: recommend.recommend_many(df, q, E, 3),
    ):
        assert ask(none).count() == 0 and ask(none).columns == ask(some).columns


def test_query_without_a_feature_is_answered_by_the_rest(spark):
    rows = [("a", [0.0], None), ("b", [1.0], [3.0]), ("c", [4.0], [1.0]), ("d", None, None), ("e", [2.0, 2.0], [0.0])]
    df = spark.createDataFrame(rows, "id string, rh array<double>, bh array<double>")
    out = recommend.recommend(df, df.filter("id in ('a', 'c', 'd', 'e')"), E, 10, missing="keep")
    found = {(r["query_id"], r["id"]): r["aggregated"] for r in out.filter("aggregated is not null").collect()}
    assert found["a", "b"] == 0.25 and found["a", "c"] == 1.0 and ("a", "d") not in found
    assert {q for q, _ in found} == {"a", "c", "e"}
    left = {r["query_id"]: r["missing"] for r in distances.unanswered(df, E).collect()}
    assert left == {"a": ["bh"], "d": ["rh", "bh"]}


def test_edit_distance_against_plain(spark):
    notes = ["", "A", "ABKL", "€𝄞A", "ABCDEFGHIJKL" * 12, "BCDEFGHIJKLA" * 11, None]
    df = spark.createDataFrame(list(enumerate(notes)), "id long, notes string")
    batch = distances.query_batch(df, ["notes"])
    rows = distances.distance_rows(df, batch, features_of(["notes"])).collect()
    assert len(rows) == 42
    for r in rows:
        text = notes[r["id"]]
        plain = float("inf") if text is None else edit_plain(text, notes[r["query_id"]])
        assert r["d_notes"] == plain


def edit_plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_repeated_query_id_has_one_comparator(spark):
    _, df = small(spark)
    twice = df.filter("id = 't001'").unionByName(df.filter("id = 't001'").withColumn("rh", F.transform("rh", lambda v: v + 9)))
    batch = distances.query_batch(twice, ["rh"])
    assert batch.ids == ["t001"]


def test_a_very_frequent_id_changes_nothing(spark):
    rows, df = small(spark)
    hot = df.filter("id = 't007'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    out = recommend.recommend(df.unionByName(hot), df.filter("id = 't001'"), E)
    assert out.count() == 560
    best = {i: s for s, i in plain_scores(rows, "t001")}
    many = recommend.recommend_many(df.unionByName(hot), df.filter("id = 't001'"), E, 600).collect()
    assert len(many) == 560 and sum(r["id"] == "t007" for r in many) == 501
    assert all(abs(best[r["id"]] - r["aggregated"]) < 1e-12 for r in out.collect())


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([("a", [1.0], [0.0]), ("b", [1.0], [2.0])], "id string, rh array<double>, bh array<double>")
    out = {r["id"]: r for r in recommend.recommend(df, df.filter("id = 'a'"), E).collect()}
    assert out["b"]["scaled_rh"] == 0 and out["b"]["aggregated"] == 0.5
    many = {r["id"]: r["aggregated"] for r in recommend.recommend_many(df, df.filter("id = 'a'"), E, 5).collect()}
    assert many == {"a": 0.0, "b": 0.5}


def test_threshold_and_infinite_rows_leave(spark):
    one = [0.0, 0.0, 1.0, 0.0, 0.0, 1.0]
    far = [1000.0, 0.0, 1.0, 0.0, 0.0, 1.0]
    broken = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([("a", one), ("b", far), ("c", broken), ("d", None)], "id string, mfcc array<double>")
    out = recommend.recommend(df, df.filter("id = 'a'"), [FEATURES["skl"]]).collect()
    assert [r["id"] for r in out] == ["a"]
    loose = recommend.recommend(df, df.filter("id = 'a'"), [Feature("skl", "skl", "mfcc")]).collect()
    assert [r["id"] for r in loose] == ["a", "b"]


def test_result_does_not_depend_on_partitions(spark, sf):
    cat = tables.tracks(spark, sf)
    query = tables.first_query(cat)
    features = features_of("all")
    a = recommend.recommend(cat, query, features, 20).select("id", "rank").collect()
    b = recommend.recommend(cat.repartition(13), query, features, 20).select("id", "rank").collect()
    assert sorted(a) == sorted(b)


def test_scaled_columns_stay_in_range(spark, sf):
    cat = tables.tracks(spark, sf)
    features = features_of("all")
    out = recommend.recommend(cat, tables.query_list(cat), features)
    ranges = out.agg(*[F.min(f.scaled).alias(f"lo{i}") for i, f in enumerate(features)], *[F.max(f.scaled).alias(f"hi{i}") for i, f in enumerate(features)])
    values = ranges.collect()[0]
    assert all(0 <= values[f"lo{i}"] and values[f"hi{i}"] <= 1 + 1e-12 for i in range(len(features)))
    own = out.filter("id = query_id").agg(F.max("aggregated")).collect()[0][0]
    assert own == pytest.approx(out.groupBy("query_id").agg(F.min("aggregated").alias("m")).agg(F.max("m")).collect()[0][0], abs=0.2)


def test_wide_catalogue_is_scanned_once(spark, sf):
    cat = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("rp")
    )
    out = recommend.recommend(cat, cat.filter("id = 3"), features_of(["rp"]), 5)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert "ReusedExchange" in final
    assert "CartesianProduct" not in final and final.count("BroadcastNestedLoopJoin BuildRight") == 1  # of packed rows
    assert final.count("pack(id") == 1  # one comparison
    assert "WindowGroupLimit" in final
    assert final.count("Scan parquet") == 2  # the comparison and the lookup of the query


def test_only_the_needed_columns_are_read(spark, sf, tmp_path):
    tables.tracks(spark, sf).write.parquet(f"{tmp_path}/c")
    cat = spark.read.parquet(f"{tmp_path}/c")
    out = recommend.recommend(cat, cat.filter("id = 3"), features_of(["rh", "notes"]), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,rh:array<double>,notes:string>" in plan
    assert "chroma" not in plan and "mfcc" not in plan


def test_lookup_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = recommend.find_queries(df, "vec_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,3)]" in plan


def test_refine_order_matters_and_uses_strict_mean(spark):
    rows, df = small(spark)
    data = {r[0]: r[1:] for r in rows}
    left = dict(data)
    for i in range(2):
        d = {t: np.linalg.norm(np.subtract(v[i], data["t002"][i])) for t, v in left.items()}
        mean = np.mean(list(d.values()))
        left = {t: left[t] for t, x in d.items() if x < mean}
    out = refine.filter_refine(df, df.filter("id = 't002'"), E).collect()
    assert {r["id"] for r in out} == set(left)


def test_refine_on_constant_distances_is_empty(spark):
    df = spark.createDataFrame([("a", [1.0], [0.0]), ("b", [1.0], [2.0])], "id string, rh array<double>, bh array<double>")
    assert refine.filter_refine(df, df.filter("id = 'a'"), E).count() == 0


def test_approximate_results_are_exact_where_they_exist(spark, sf):
    cat = tables.tracks(spark, sf).select("id", "rp").cache()
    queries = cat.filter("id < 5")
    model = ann.projections(64, 0.4, 6)
    found = ann.approximate_top_k(model, cat, queries, "rp", 10)
    exact = neighbours.nearest(cat, queries, "rp", 500, standardised=False)
    both = found.alias("a").join(exact.alias("e"), ["query_id", "id"])
    assert both.count() == found.count()
    assert both.filter(F.abs(F.col("a.distance") - F.col("e.distance")) > 1e-9).count() == 0
    top = neighbours.nearest(cat, queries, "rp", 10, standardised=False)
    recall = ann.recall_at_k(found, top).agg(F.avg("recall")).collect()[0][0]
    assert recall >= 0.9
    near = ann.similarity_join(model, cat, cat, "rp", 1.0)
    pairs = {(r["query_id"], r["id"]) for r in near.collect()}
    assert len(pairs) >= cat.count()
    assert all((b, a) in pairs for a, b in pairs) and near.filter("distance > 1.0").count() == 0
    key = queries.first()
    single = ann.approximate_nearest(model, cat, "rp", key["rp"], 10)
    assert [r["id"] for r in single.orderBy("rank").collect()] == [
        r["id"] for r in found.filter(F.col("query_id") == key["id"]).orderBy("rank").collect()
    ]


def test_crowded_buckets_are_parts_with_the_same_candidates(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(400)] + [(1000 + k, RNG.normal(size=3).tolist()) for k in range(50)]
    tracks = ann.index(ann.projections(3, 0.5, 3), spark.createDataFrame(rows, "id long, rp array<double>"), "rp")
    queries = tracks.filter("id % 25 = 0")
    plain = queries.withColumnRenamed("id", "query_id").join(tracks, ["table", "bucket"]).select("query_id", "id").distinct()
    for crowded in (7, 100, 5000):
        found = ann.candidates(tracks, queries, crowded)
        assert found.count() == plain.count() and found.exceptAll(plain).count() == 0
    plan = ann.candidates(tracks, queries)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_approximate_search_leaves_out_unfit_vectors(spark):
    rows = [(k, RNG.normal(size=3).tolist()) for k in range(12)] + [(12, None), (13, [1.0]), (14, [1.0, None, 2.0])]
    cat = spark.createDataFrame(rows, "id long, rp array<double>")
    model = ann.projections(3, 0.8, 3)
    assert {r[0] for r in ann.candidate_distances(model, cat, cat, "rp").collect()} == set(range(12))
    assert ann.approximate_top_k(model, cat, cat.limit(0), "rp", 3).count() == 0


def test_building_a_plan_starts_no_job(spark):
    _, df = small(spark, 40)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans are only built")
    try:
        for queries in (df.filter("id = 't000'"), df):
            recommend.recommend(df, queries, E, 3)
            recommend.recommend_many(df, queries, E, 3)
            recommend.feature_rankings(df, queries, E, 3)
            neighbours.nearest(df, queries, "rh", 3)
            ann.approximate_top_k(ann.projections(3, 1.0), df, queries, "rh", 3)
        assert not tracker.getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_scores_have_the_same_bits_alone_and_in_long_lists(spark, sf):
    cat = tables.tracks(spark, sf).cache()
    features = features_of("all")
    alone = None
    for n in (1, 5, 33, 500):
        found = recommend.recommend_many(cat, cat.filter(F.col("id") < n), features, 9).filter("query_id = 0")
        rows = sorted((r["rank"], r["id"], r["aggregated"]) for r in found.collect())
        alone = alone or rows
        assert rows == alone and len(rows) == 9


def test_stored_factors_give_the_same_divergences(spark):
    d, n = 13, 40
    flat = []
    for i in range(n):
        a = RNG.normal(size=(d, d))
        cov = a @ a.T + np.eye(d) * (0.1 if i else -50)  # the first is not positive definite
        flat.append((i, np.concatenate([RNG.normal(size=d), cov.ravel()]).tolist()))
    df = spark.createDataFrame(flat, "id long, mfcc array<double>")
    stored = distances.with_factors(df, d).drop("mfcc").cache()
    assert stored.filter("gaussian is null").count() == 1
    queries = [1, 2, 3]
    plain = recommend.recommend(df, df.filter(F.col("id").isin(queries)), features_of(["js", "skl"]), 5)
    quick = recommend.recommend(stored, stored.filter(F.col("id").isin(queries)), features_of(["js", "skl"], stored=True), 5)
    key = lambda out: sorted((r["query_id"], r["rank"], r["id"], round(r["aggregated"], 9)) for r in out.collect())
    assert key(plain) == key(quick) and len(key(plain)) == 15


def test_refine_compares_survivors_with_their_own_queries(spark, sf):
    cat = tables.tracks(spark, sf).select("id", "rp", "notes", "mfcc").cache()
    queries = cat.filter("id < 6")
    left = blocks.distance_rows(cat, queries, features_of(["rp"])).filter("(id + query_id) % 7 = 0")
    wanted = features_of(["rp", "notes", "js", "skl"])
    found = blocks.survivor_rows(cat, queries, left.drop("d_rp"), wanted)
    every = blocks.distance_rows(cat, queries, wanted).join(left.select("query_id", "id"), ["query_id", "id"])
    key = lambda df: sorted(tuple(r[c] for c in ["query_id", "id"] + [f.distance for f in wanted]) for r in df.collect())
    assert key(found) == key(every) and len(key(found)) == left.count()


def test_tables_by_class_hold_classes_beyond_the_known(spark, sf, tmp_path):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(60)
    vectors.withColumn("label", F.col("label") + F.lit(5).cast("int")).write.parquet(f"{tmp_path}/embeddings.parquet")
    events = spark.read.parquet(f"{sf}/events.parquet").limit(40)
    events.withColumn("event_type", F.lit("skip")).write.parquet(f"{tmp_path}/events.parquet")
    wide = [r.asDict() for r in evaluation.confusion_table(spark, str(tmp_path)).collect()]
    retrieved = evaluation._labelled(spark, str(tmp_path)).count()
    assert sum(n for r in wide for c, n in r.items() if c not in ("feature_set", "original")) == retrieved
    users = events.select("user_id").distinct().count()
    for query in (cataloguing.multi_label_table, files.class_tables):
        assert query(spark, str(tmp_path)).where("skip = 1").count() == users
    assert {r["class"] for r in cataloguing.multi_label_list(spark, str(tmp_path)).collect()} == {"skip"}


def test_dimension_statistics_and_constant_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, v array<double>")
    stats = neighbours.dimension_statistics(df, "v").collect()[0]
    assert stats["mean"] == [2.0, 5.0] and stats["stddev"] == [1.0, 0.0]
    z = {r["id"]: r["z"] for r in neighbours.standardise(df, "v", "z").collect()}
    assert z == {1: [-1.0, 0.0], 2: [1.0, 0.0]}


def test_extended_statistics(spark):
    rows = spark.createDataFrame([(1, 10, 1.0), (1, 11, 3.0)], "query_id long, id long, d_rh double")
    got = scaling.distance_stats(rows, features_of(["rh"])).collect()[0]
    assert (got["n"], got["min_rh"], got["max_rh"], got["mean_rh"]) == (2, 1.0, 3.0, 2.0)
    assert got["stddev_rh"] == pytest.approx(2**0.5)


def test_observed_counts(spark):
    df, watch = observed(spark.range(7).filter("id > 1"))
    df.collect()
    assert watch.get == {"rows": 5}


def test_size_sweep(spark):
    _, df = small(spark)
    sizes = [(size, out.count()) for size, out in evaluate.size_sweep(df, df.filter("id = 't001'"), E, 100, 60, 25)]
    assert sizes == [(60, 60), (35, 35), (10, 10)]


@pytest.mark.parametrize("clusters", [1, 12])
def test_pruned_neighbours_equal_the_full_scan(spark, clusters):
    centres = RNG.normal(size=(clusters, 6)) * 8
    rows = [(i, (centres[i % clusters] + RNG.normal(size=6) * 0.2).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(9)]  # copies: ties at distance 0
    good = spark.createDataFrame(rows, "id long, v array<double>")
    bad = [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, [None] * 6)]
    found = pivots.cut(good.union(spark.createDataFrame(bad, good.schema)), "v", 6, 4, pivots=24, chunk=32)
    want = neighbours.nearest(good, good, "v", 4, standardised=False, skip_query=True)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(pivots.nearest_of_all(found)) == key(want)
    row = pivots.compared(found).first()
    assert row.tracks == 909 and (clusters == 1 or row.compared < 909**2 / 4)


def test_pruned_neighbours_of_few_tracks(spark):
    few = spark.createDataFrame([("a", [0.0]), ("b", [3.0])], "id string, v array<double>")
    assert [tuple(r) for r in pivots.nearest_of_all(pivots.cut(few, "v", 1, 5)).orderBy("query_id").collect()] == [("a", 1, "b", 3.0), ("b", 1, "a", 3.0)]
    none = pivots.cut(few.limit(0), "v", 1, 5)
    assert pivots.nearest_of_all(none).collect() == [] and tuple(pivots.compared(none).first()) == (0, 0)


def test_every_track_by_pivots_equals_the_scaled_ranking(spark):
    _, df = small(spark)
    got = evaluate.neighbours_of_all(df, FEATURES["rh"], 5, 3)
    want = evaluate.neighbours_by_set(df, df, {"rh": ["rh"]}, 3)
    key = lambda rows: sorted((r.query_id, r["rank"], r.id) for r in rows.collect())
    assert key(got) == key(want)
    with pytest.raises(ValueError):
        evaluate.neighbours_of_all(df, FEATURES["js"], 5, 3)
