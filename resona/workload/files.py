"""Readers and writers: what Spark derives from the tables is written to the shared checkpoint
folder in the file formats of the engine and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from resona.operators import learn
from resona.operators.distances import features_of
from resona.operators.reuse import observed
from resona.plans import catalogue as build
from resona.plans import evaluate as E
from resona.plans import recommend as R
from resona.session import use_checkpoint_dir
from resona.sources import feature_text as T
from resona.sources import tabular
from resona.streaming import ingest
from resona.workload import tables as B
from resona.workload.tables import rounded, scaled_sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _folder(spark):
    return f"{use_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def _production_like(spark, sf_dir):
    """Tracks with 13 means and 169 covariance cells taken from their 64 numbers."""
    cat = B.tracks(spark, sf_dir)
    wide = F.concat(F.slice("rp", 1, 13), *[F.slice("rp", 1, 52)] * 3, F.slice("rp", 1, 13))
    chroma = F.transform("chroma", lambda v: F.round(v, 4))
    return cat.withColumns({"mfcc": wide, "chroma": chroma})


def ingest_feature_files(spark, sf_dir):
    """Six kinds of feature files in two shards each, to one wide catalogue."""
    folder = _folder(spark)
    cat = _production_like(spark, sf_dir)
    for kind in build.KINDS:
        for shard, part in enumerate((F.col("label") < 5, F.col("label") >= 5)):
            T.to_lines(cat.filter(part), kind).write.text(f"{folder}/out{shard}.{kind}")
    wide = build.ingest(spark, folder, widths={"rp": 64, "rh": 16, "bh": 16})
    return wide.select(
        "id",
        "key",
        "scale",
        "notes",
        F.round("bpm", 6).alias("bpm"),
        *[F.size(c).alias(f"n_{c}") for c in ("rp", "rh", "bh", "mfcc", "chroma")],
        F.round(F.element_at("rp", -1), 6).alias("last_rp"),
        F.round(F.element_at("mfcc", -1), 6).alias("last_mfcc"),
        F.round(F.element_at("chroma", -1), 6).alias("last_chroma"),
    )


QUERIES["ingest_feature_files"] = ingest_feature_files
SQL["ingest_feature_files"] = "WITH " + B.TRACKS_SQL + """ z AS (SELECT 1) SELECT id::VARCHAR AS id, key, scale, notes, round(bpm, 6) AS bpm,
64::INT AS n_rp, 16::INT AS n_rh, 16::INT AS n_bh, 182::INT AS n_mfcc, (12 * beats)::INT AS n_chroma,
round(rp[64], 6) AS last_rp, round(rp[13], 6) AS last_mfcc, round(round(chroma[12 * beats], 4), 6) AS last_chroma FROM tracks"""


def json_catalogue(spark, sf_dir):
    folder = _folder(spark)
    cat = B.tracks(spark, sf_dir).withColumn("id", F.col("id").cast("string")).drop("label")
    tabular.write_json(cat, folder)
    back = tabular.read_json(spark, folder)
    return back.select("id", "key", "scale", "notes", F.round(F.element_at("rp", 1), 6).alias("rp_1"), F.size("mfcc").alias("n_mfcc"))


QUERIES["json_catalogue"] = json_catalogue
SQL["json_catalogue"] = "WITH " + B.TRACKS_SQL + """ z AS (SELECT 1) SELECT id::VARCHAR AS id, key, scale, notes,
round(rp[1], 6) AS rp_1, 6::INT AS n_mfcc FROM tracks"""


def result_lists(spark, sf_dir):
    """One ranked list per query, written as files of their own and read as one table."""
    folder = _folder(spark)
    cat = B.tracks(spark, sf_dir)
    out = R.recommend(cat, B.query_list(cat), features_of("rh_bh_mfcc"), 10)
    names = ["rank", "id", "scaled_rh", "scaled_bh", "scaled_mfcc", "aggregated"]
    # the partition column becomes the folder of each list
    out.select("query_id", *names).write.partitionBy("query_id").option("sep", "\t").option("header", True).csv(folder)
    schema = "rank int, id bigint, scaled_rh double, scaled_bh double, scaled_mfcc double, aggregated double, query_id bigint"
    back = tabular.read_csv(spark, folder, schema, sep="\t")
    return rounded(back.select("query_id", "rank", "id", "aggregated"), "aggregated")


QUERIES["result_lists"] = result_lists
SQL["result_lists"] = scaled_sql(["rh", "bh", "mfcc"]) + B.top_sql(10, "query_id, rank, id, round(aggregated, 6) AS aggregated")


def numeric_csv(spark, sf_dir):
    """Numbers with the id as last column and the class as first."""
    folder = _folder(spark)
    cat = B.tracks(spark, sf_dir)
    flat = tabular.features_as_columns(cat, "rh", 16, "rh")
    columns = [c for c in flat.columns if c != "id"]
    labelled = flat.join(cat.select("id", "label"), "id")
    tabular.write_csv(labelled.select("label", *columns, "id"), folder, header=False)
    back = tabular.read_numeric_csv(spark, folder, id_cols=[-1, 0])
    return back.select(
        "id_0", "id_1", F.posexplode("features").alias("cell", "value")
    ).select(F.col("id_0").alias("id"), F.col("id_1").alias("label"), "cell", F.round("value", 6).alias("value"))


QUERIES["numeric_csv"] = numeric_csv
SQL["numeric_csv"] = """SELECT vec_id::VARCHAR AS id, label::VARCHAR AS label, i::INT AS cell, round(embedding[i + 1]::DOUBLE, 6) AS value
FROM embeddings, unnest(range(16)) AS u(i)"""


def numeric_csv_ids(spark, sf_dir):
    folder = _folder(spark)
    tabular.write_csv(table(spark, sf_dir, "supplier"), folder, header=False)
    return tabular.read_numeric_csv(spark, folder, id_cols=1, ids_only=True)


QUERIES["numeric_csv_ids"] = numeric_csv_ids
SQL["numeric_csv_ids"] = "SELECT s_name AS id FROM supplier"


def class_files(spark, sf_dir):
    """`path <tab> class`, read with path and extension cut off."""
    folder = _folder(spark)
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".mp3")).alias("id"), F.col("lang").alias("class"))
    tabular.write_class_list(files, folder)
    return tabular.read_classes(spark, folder, cut_path=True, cut_ext=True)


QUERIES["class_files"] = class_files
SQL["class_files"] = "SELECT doc_id::VARCHAR AS id, lang AS class FROM documents"

_KINDS = ["click", "error", "purchase", "signup", "view"]


def class_tables(spark, sf_dir):
    """A table of marks per user and event type, written and read."""
    folder = _folder(spark)
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.col("event_type").alias("class"))
    rows = learn.to_table(events, learn.listed_classes(events, _KINDS))
    tabular.write_class_table(rows, folder)
    return tabular.read_class_table(spark, folder)


QUERIES["class_tables"] = class_tables
SQL["class_tables"] = "SELECT 'u' || user_id AS id, " + ", ".join(
    f"max((event_type = '{k}')::INT) AS {k}" for k in _KINDS
) + " FROM events GROUP BY user_id"


def playlist_tracks(spark, sf_dir):
    """Orders as playlists of parts; the distinct parts come back."""
    folder = _folder(spark)
    uri = F.concat(F.lit("service:track:"), F.col("l_partkey"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(uri.alias("track_uri")).alias("track"))
    playlists = line.groupBy("l_orderkey").agg(F.struct(F.collect_list("track").alias("tracks")).alias("p"))
    playlists.select(F.array("p").alias("playlists")).write.json(folder)
    return tabular.playlist_track_ids(spark, folder, multi_line=False)


QUERIES["playlist_tracks"] = playlist_tracks
SQL["playlist_tracks"] = "SELECT DISTINCT l_partkey::VARCHAR AS id FROM lineitem"


def sharded_parquet(spark, sf_dir):
    folder = _folder(spark)
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), "c_acctbal")
    tabular.write_sharded(customers, folder)
    back = tabular.read_catalogue(spark, folder)
    return back.select("id", "c_acctbal", F.lpad(F.col("shard").cast("string"), 2, "0").alias("shard"))


QUERIES["sharded_parquet"] = sharded_parquet
SQL["sharded_parquet"] = "SELECT c_name AS id, c_acctbal, right(c_name, 2) AS shard FROM customer"


def per_feature_parquet(spark, sf_dir):
    """One folder per feature type, appended twice."""
    folder = _folder(spark)
    cat = B.tracks(spark, sf_dir)
    parts = {"rh": cat.select("id", F.col("rh").alias("v")), "bh": cat.select("id", F.col("bh").alias("v"))}
    tabular.write_per_feature(parts, folder)
    tabular.write_per_feature(parts, folder)
    return tabular.read_catalogue(spark, folder).groupBy("feature", "id").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"))


QUERIES["per_feature_parquet"] = per_feature_parquet
SQL["per_feature_parquet"] = """SELECT f AS feature, vec_id AS id, 2::BIGINT AS n, 16::INT AS width FROM embeddings, (VALUES ('rh'), ('bh')) t(f)"""


def feature_text_round_trip(spark, sf_dir):
    """Every track as lines of all seven kinds, read back: how many numbers came back as the very same doubles."""
    folder = _folder(spark)
    cat = B.tracks(spark, sf_dir)
    wide = F.concat(F.slice("rp", 1, 13), *[F.slice("rp", 1, 52)] * 3, F.slice("rp", 1, 13))
    euclid = F.concat(F.slice("rp", 1, 26), F.slice("rp", 1, 64), F.slice("rp", 1, 27))
    # tiny, huge and negative numbers, which print with exponents
    scaled = F.transform("rp", lambda v, i: v * F.pow(F.lit(10.0), F.when(i % 3 == 0, -9).when(i % 3 == 1, 0).otherwise(9)))
    cat = cat.withColumns({"mfcc": wide, "mfcc_euclid": euclid, "rp": scaled, "id": F.concat(F.lit("a; b, "), F.col("id"))})
    widths = {"rp": 64, "rh": 16, "bh": 16}
    found = None
    for kind, column in (("rp", "rp"), ("rh", "rh"), ("bh", "bh"), ("notes", "notes"), ("chroma", "chroma"), ("mfcckl", "mfcc"), ("mfcc", "mfcc_euclid")):
        T.to_lines(cat, kind).write.text(f"{folder}/out.{kind}")
        back = T.read_features(spark, f"{folder}/out.{kind}", kind, widths.get(kind)).select("id", F.col(column).alias("back"))
        # the cleaned id has no blanks and separators
        same = cat.select(F.col("id").alias("_id"), F.col(column).alias("was")).join(
            back.withColumn("_n", F.regexp_extract("id", r"(\d+)$", 1)), F.regexp_extract("_id", r"(\d+)$", 1) == F.col("_n")
        )
        one = same.agg(F.lit(kind).alias("kind"), F.count("*").alias("tracks"), F.sum((F.col("was") == F.col("back")).cast("long")).alias("equal"))
        found = one if found is None else found.unionByName(one)
    return found


QUERIES["feature_text_round_trip"] = feature_text_round_trip
SQL["feature_text_round_trip"] = """SELECT k AS kind, count(*) AS tracks, count(*) AS equal
FROM embeddings, (VALUES ('rp'), ('rh'), ('bh'), ('notes'), ('chroma'), ('mfcckl'), ('mfcc')) t(k) GROUP BY k"""

# Evaluation from stored lists ---------------------------------------------------------------------

_LISTED = ["rh", "bh", "mfcc"]
_LIST_COLUMNS = "rank int, id bigint, aggregated double"


def _stored_lists(spark, sf_dir):
    """The eleven best of one query per class, the query itself among them, a folder of files for each list."""
    folder = _folder(spark)
    cat = B.tracks(spark, sf_dir)
    out = R.recommend(cat, B.query_list(cat), features_of("rh_bh_mfcc"), 11)
    out.select("query_id", "rank", "id", "aggregated").write.partitionBy("query_id").option("sep", "\t").option("header", True).csv(folder)
    return folder, cat.select("id", F.col("label").alias("class"))


def _labelled_lists(spark, sf_dir):
    folder, classes = _stored_lists(spark, sf_dir)
    lists = tabular.read_result_lists(spark, folder, _LIST_COLUMNS, named="folder", sep="\t")
    return E.labelled_lists(lists, classes, "rh_bh_mfcc")


def genre_from_lists(spark, sf_dir):
    """Confusion counts among the ten best, read from the files of the lists."""
    return E.confusion(E.among_first(_labelled_lists(spark, sf_dir), 10))


def cover_pairs_from_lists(spark, sf_dir):
    """Hits per pair of classes among the first and the first five, read from the files of the lists."""
    return E.pair_hits(E.among_first(_labelled_lists(spark, sf_dir), 5), (1, 5))


def stream_list_counts(spark, sf_dir):
    """The same confusion counts while the files of the lists arrive as a stream."""
    folder, classes = _stored_lists(spark, sf_dir)
    out = _folder(spark)
    stream = tabular.read_result_lists(spark, folder, _LIST_COLUMNS, named="folder", sep="\t", stream=True)
    ingest.count_lists(stream, classes, f"{out}/counts", f"{out}/progress", "rh_bh_mfcc").awaitTermination()
    return spark.read.parquet(f"{out}/counts")


_LISTS_SQL = scaled_sql(_LISTED) + """, others AS (SELECT query_label AS original, label AS detected,
row_number() OVER (PARTITION BY query_id ORDER BY aggregated, id) AS rank FROM scored WHERE id != query_id)
SELECT 'rh_bh_mfcc' AS feature_set, original, detected, """

QUERIES["genre_from_lists"] = genre_from_lists
SQL["genre_from_lists"] = _LISTS_SQL + "count(*) AS n FROM others WHERE rank <= 10 GROUP BY ALL"
QUERIES["cover_pairs_from_lists"] = cover_pairs_from_lists
SQL["cover_pairs_from_lists"] = _LISTS_SQL + (
    "count(*) FILTER (rank <= 1) AS hits_1, count(*) FILTER (rank <= 5) AS hits_5 FROM others WHERE rank <= 5 GROUP BY ALL"
)
QUERIES["stream_list_counts"] = stream_list_counts
SQL["stream_list_counts"] = SQL["genre_from_lists"]


def numeric_csv_parts(spark, sf_dir):
    """Numbers in three files, read as one table."""
    folder = _folder(spark)
    cat = B.tracks(spark, sf_dir)
    flat = tabular.features_as_columns(cat, "rh", 16, "rh").withColumn("part", F.pmod("id", F.lit(3)))
    paths = [f"{folder}/part-{n}" for n in range(3)]
    for n, path in enumerate(paths):
        tabular.write_csv(flat.filter(F.col("part") == n).drop("part"), path, header=False)
    back = tabular.read_many(spark, paths, id_cols=0)
    return back.select("id", F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


QUERIES["numeric_csv_parts"] = numeric_csv_parts
SQL["numeric_csv_parts"] = "SELECT vec_id::VARCHAR AS id, round(list_sum(embedding[1:16]::DOUBLE[]), 6) AS total FROM embeddings"


def step_metrics(spark, sf_dir):
    """Rows and bytes that pass through a step, observed while another job runs over it."""
    # in a session of its own: SVM models hold their session, and one that has observed anything can't be sent to tasks
    docs = table(spark.newSession(), sf_dir, "documents").filter(F.col("lang") == "de")
    watched, watch = observed(docs, F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("characters"))
    watched.groupBy("source").count().write.format("noop").mode("overwrite").save()
    seen = watch.get
    return spark.createDataFrame([(seen["rows"], seen["characters"])], "rows long, characters long")


QUERIES["step_metrics"] = step_metrics
SQL["step_metrics"] = "SELECT count(*) AS rows, sum(length(text))::BIGINT AS characters FROM documents WHERE lang = 'de'"


def size_sweep(spark, sf_dir):
    """The same queries on the whole catalogue and on three ever smaller ones."""
    cat = B.tracks(spark, sf_dir)
    total = cat.count()
    found = None
    for size, ranked in E.size_sweep(cat, B.query_list(cat), features_of("rh_bh_mfcc"), 3, total, max(1, total // 4)):
        if size < total // 5:
            break
        one = ranked.select(F.lit(size).cast("long").alias("size"), "query_id", "rank", "id", F.round("aggregated", 6).alias("aggregated"))
        found = one if found is None else found.unionByName(one)
    return found


QUERIES["size_sweep"] = size_sweep
SQL["size_sweep"] = B.distances_sql(_LISTED) + """,
placed AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS place, count(*) OVER () AS total FROM embeddings),
sizes AS (SELECT DISTINCT total - n * greatest(1, total // 4) AS size FROM placed, range(0, 4) AS t(n)),
part AS (SELECT size, d.* FROM d JOIN placed USING (id), sizes WHERE place <= size AND size >= total // 5),
bounds AS (SELECT size, query_id, """ + ", ".join(f"min(d_{n}) AS lo_{n}, max(d_{n}) AS hi_{n}" for n in _LISTED) + """ FROM part GROUP BY size, query_id),
marks AS (SELECT size, query_id, id, (""" + " + ".join(
    f"CASE WHEN hi_{n} = lo_{n} THEN 0.0 ELSE (d_{n} - lo_{n}) / (hi_{n} - lo_{n}) END" for n in _LISTED
) + """) / 3 AS aggregated FROM part JOIN bounds USING (size, query_id))
SELECT size, query_id, rank, id, round(aggregated, 6) AS aggregated FROM (
  SELECT *, row_number() OVER (PARTITION BY size, query_id ORDER BY aggregated, id)::INT AS rank FROM marks) WHERE rank <= 3"""
