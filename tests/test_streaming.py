"""Incremental ingestion, stream scoring and dedup on arrival."""

from pyspark.sql import functions as F

from resona.operators import ann
from resona.operators.distances import features_of, with_factors
from resona.plans.recommend import recommend_many
from resona.streaming import ingest


def test_only_new_ids_are_appended(spark, tmp_path):
    inbox, catalogue = tmp_path / "in", f"{tmp_path}/catalogue"
    inbox.mkdir()

    def run():
        lines = ingest.feature_lines(spark, str(inbox), "*.notes", files_per_batch=1)
        ingest.ingest_new(lines, catalogue, f"{tmp_path}/cp", f"{tmp_path}/aside", "notes").awaitTermination()
        return sorted((r["id"], r["notes"]) for r in spark.read.parquet(catalogue).collect())

    (inbox / "0.notes").write_text("a.mp3; A; major; [0]\nb.mp3; A; major; [1]\nb.mp3; A; major; [1]\nx.mp3; A; major; [99]\n")
    assert run() == [("a", "A"), ("b", "B")]
    assert [r["reason"] for r in spark.read.parquet(f"{tmp_path}/aside").collect()] == ["not a note list"]
    (inbox / "1.notes").write_text("b.mp3; A; major; [5]\nc.mp3; A; major; [2]\n")
    (inbox / "2.notes").write_text("c.mp3; A; major; [7]\nd.mp3; A; major; [3]\n")
    out = run()
    assert [i for i, _ in out] == ["a", "b", "c", "d"] and ("b", "B") in out
    assert run() == out


def test_scored_stream_equals_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/embeddings.parquet").schema
    shape = lambda df: df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("rh"))
    stream = shape(spark.readStream.schema(schema).option("pathGlobFilter", "embeddings.parquet").parquet(sf))
    static = shape(spark.read.parquet(f"{sf}/embeddings.parquet"))
    ingest.score_queries(stream, static, features_of(["rh"]), 3, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = recommend_many(static, static, features_of(["rh"]), 3)
    assert got.count() == 1500 and got.exceptAll(want.select(got.columns)).count() == 0


def test_distances_of_a_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/embeddings.parquet").schema
    shape = lambda df: df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("rh"))
    stream = shape(spark.readStream.schema(schema).option("pathGlobFilter", "embeddings.parquet").parquet(sf))
    static = shape(spark.read.parquet(f"{sf}/embeddings.parquet"))
    out = ingest.distances_to_stream(stream, static, static.filter("id < 2"), features_of(["rh"]))
    assert out.isStreaming
    query = out.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("scored").count() == 1000
    assert spark.table("scored").filter("id = query_id and d_rh > 0").count() == 0


def test_dedup_on_arrival(spark, tmp_path):
    inbox = tmp_path / "in"
    rows = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], "id string, ts string"
    ).withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(inbox))
    stream = spark.readStream.schema(rows.schema).parquet(str(inbox))
    query = ingest.dedup_on_arrival(stream, "ts").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.table("arrived").collect()) == ["a", "b"]


def test_index_and_factors_are_kept_up_by_the_stream(spark, sf, tmp_path):
    inbox, catalogue, index = f"{tmp_path}/in", f"{tmp_path}/catalogue", f"{tmp_path}/index"
    model = ann.projections(64, 0.4, 6)
    vector = F.col("embedding").cast("array<double>")
    gaussian = F.array(*[F.lit(v) for v in (0.0, 0.0, 2.0, 0.5, 0.5, 1.0)])
    all_rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), vector.alias("rp"), gaussian.alias("mfcc"))

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(all_rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        ingest.ingest_new(
            stream, catalogue, f"{tmp_path}/cp", complete=lambda new: with_factors(new, 2),
            beside={index: lambda new: ann.index(model, new, "rp")},
        ).awaitTermination()

    arrive(all_rows.where("id % 2 = 0"))
    arrive(all_rows.where("id % 2 = 1 or id < 20"))  # some are known already
    stored, kept = spark.read.parquet(catalogue), spark.read.parquet(index)
    assert stored.count() == all_rows.count() and stored.where("gaussian is null").count() == 0
    rebuilt = ann.index(model, all_rows, "rp")
    assert kept.count() == rebuilt.count() and rebuilt.exceptAll(kept.select(rebuilt.columns)).count() == 0
    queries = all_rows.where("id < 5")
    ours = ann.approximate_top_k(model, stored, queries, "rp", 5, kept)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ann.approximate_top_k(model, all_rows, queries, "rp", 5).collect()))


def test_a_table_is_a_stream_as_one_file_and_as_a_folder_of_parts(spark, sf, tmp_path):
    from resona.workload import cataloguing, registry

    registry.ship(spark)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").limit(40)
    rows.repartition(3).write.parquet(f"{tmp_path}/parts/embeddings.parquet")
    (tmp_path / "file").mkdir()
    rows.toPandas().to_parquet(f"{tmp_path}/file/embeddings.parquet")
    for kind in ("parts", "file"):
        found = cataloguing.stream_score(spark, f"{tmp_path}/{kind}")
        assert found.count() == 120 and found.select("query_id").distinct().count() == 40
