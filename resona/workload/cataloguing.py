"""Ingest, assembly, merging, repair, metadata, labels, classifiers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from resona.functions import ids
from resona.operators import ann, learn
from resona.operators import catalogue as C
from resona.plans import catalogue as build
from resona.session import use_checkpoint_dir
from resona.sources import feature_text as T
from resona.streaming import ingest
from resona.operators.distances import features_of
from resona.workload import evaluation as V
from resona.workload import tables as B
from resona.workload.tables import rounded, scaled_sql, table, top_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

_TRACKS = "WITH " + B.TRACKS_SQL

# Text lines of features ------------------------------------------------------------------------


def _lines(cat, kind, broken):
    """Tracks as text lines of their kind; lines of class 7 carry a fault."""
    lines = T.to_lines(cat, kind).withColumn("path", F.concat(F.lit("out0."), F.lit(kind)))
    kept = cat.select("id", "label")
    numbered = lines.withColumn("key", F.regexp_extract("value", r"^(\d+)", 1).cast("bigint"))
    joined = numbered.join(kept, numbered["key"] == kept["id"])
    return joined.select(F.when(F.col("label") == 7, broken(F.col("value"))).otherwise(F.col("value")).alias("value"), "path")


def _text_tracks(spark, sf_dir):
    return B.tracks(spark, sf_dir)


def parse_rhythm(spark, sf_dir):
    lines = _lines(_text_tracks(spark, sf_dir), "rh", lambda v: F.concat(v, F.lit("x")))
    quoted = lines.withColumn("value", F.regexp_replace("value", r"([^,]+)", "b'$1'"))
    rows = T.good(T.parse(quoted, "rh", 16))
    return rounded(rows.select("id", F.posexplode("rh").alias("cell", "value")), "value")


QUERIES["parse_rhythm_lines"] = parse_rhythm
SQL["parse_rhythm_lines"] = """SELECT vec_id::VARCHAR AS id, i::INT AS cell, round(embedding[i + 1]::DOUBLE, 6) AS value
FROM embeddings, unnest(range(16)) AS u(i) WHERE label != 7"""


def parse_beat_histogram(spark, sf_dir):
    lines = _lines(_text_tracks(spark, sf_dir), "bh", lambda v: F.regexp_replace(v, r"\]", ", nan]"))
    rows = T.good(T.parse(lines, "bh", 16))
    return rounded(rows.select("id", "bpm", F.posexplode("bh").alias("cell", "value")), "value", "bpm")


QUERIES["parse_beat_histogram_lines"] = parse_beat_histogram
SQL["parse_beat_histogram_lines"] = """SELECT vec_id::VARCHAR AS id, round(90.0::DOUBLE + embedding[1]::DOUBLE * 100, 6) AS bpm, i::INT AS cell,
round(embedding[17 + i]::DOUBLE, 6) AS value FROM embeddings, unnest(range(16)) AS u(i) WHERE label != 7"""


def parse_notes(spark, sf_dir):
    lines = _lines(_text_tracks(spark, sf_dir), "notes", lambda v: F.regexp_replace(v, r"\[", "[12, "))
    return T.good(T.parse(lines, "notes"))


QUERIES["parse_note_lines"] = parse_notes
SQL["parse_note_lines"] = _TRACKS + " z AS (SELECT 1) SELECT id::VARCHAR AS id, key, scale, notes FROM tracks WHERE label != 7"


def _chroma_tracks(spark, sf_dir):
    # small values print with an exponent
    return B.tracks(spark, sf_dir).withColumn("chroma", F.transform("chroma", lambda v: F.round(v, 4)))


def parse_chroma(spark, sf_dir):
    lines = _lines(_chroma_tracks(spark, sf_dir), "chroma", lambda v: F.regexp_replace(v, r"\[\[.*", "[]"))
    rows = T.good(T.parse(lines, "chroma"))
    return rounded(rows.select("id", F.posexplode("chroma").alias("cell", "value")), "value")


QUERIES["parse_chroma_lines"] = parse_chroma
SQL["parse_chroma_lines"] = _TRACKS + """ z AS (SELECT 1) SELECT id::VARCHAR AS id, i::INT AS cell, round(round(chroma[i + 1], 4), 6) AS value
FROM tracks, unnest(range(12 * beats)) AS u(i) WHERE label != 7"""


def _mfcc_tracks(spark, sf_dir):
    wide = F.concat(F.slice("rp", 1, 13), F.slice("rp", 1, 52), F.slice("rp", 1, 52), F.slice("rp", 1, 52), F.slice("rp", 1, 13))
    return B.tracks(spark, sf_dir).withColumn("mfcc", wide)


def parse_mfcc(spark, sf_dir):
    lines = _lines(_mfcc_tracks(spark, sf_dir), "mfcckl", lambda v: F.regexp_replace(v, r",[^,]*$", "]]"))
    rows = T.good(T.parse(lines, "mfcckl"))
    return rounded(rows.select("id", F.posexplode("mfcc").alias("cell", "value")), "value")


QUERIES["parse_mfcc_lines"] = parse_mfcc
SQL["parse_mfcc_lines"] = """SELECT vec_id::VARCHAR AS id, i::INT AS cell,
round(embedding[CASE WHEN i < 13 THEN i ELSE (i - 13) % 52 END + 1]::DOUBLE, 6) AS value
FROM embeddings, unnest(range(182)) AS u(i) WHERE label != 7"""


def parse_mfcc_euclid(spark, sf_dir):
    """Mean, variance and triangle of 4-wide frames: 4 + 4 + 10 numbers out of each track."""

    def text(start, length):
        return F.concat(F.lit("["), F.array_join(F.slice("rp", start, length).cast("array<string>"), ", "), F.lit("]"))

    cat = B.tracks(spark, sf_dir)
    name = F.concat(F.lit("audio/"), F.col("id"), F.lit(".mp3"))
    # class 7 lacks a number of its triangle
    triangle = F.when(F.col("label") == 7, text(9, 9)).otherwise(text(9, 10))
    lines = cat.select(F.concat_ws("; ", name, text(1, 4), text(5, 4), triangle).alias("value"), F.lit("out0.mfcc").alias("path"))
    rows = T.good(T.parse(lines, "mfcc", 4))
    return rounded(rows.select("id", F.posexplode("mfcc_euclid").alias("cell", "value")), "value")


QUERIES["parse_mfcc_euclid_lines"] = parse_mfcc_euclid
SQL["parse_mfcc_euclid_lines"] = """SELECT vec_id::VARCHAR AS id, i::INT AS cell, round(embedding[i + 1]::DOUBLE, 6) AS value
FROM embeddings, unnest(range(18)) AS u(i) WHERE label != 7"""


def quarantine(spark, sf_dir):
    lines = _lines(_text_tracks(spark, sf_dir), "notes", lambda v: F.regexp_replace(v, r"\[", "[12, "))
    aside = T.quarantined(T.parse(lines, "notes"))
    return aside.groupBy("path", "reason").agg(F.count("*").alias("n"))


QUERIES["quarantine_bad_lines"] = quarantine
SQL["quarantine_bad_lines"] = "SELECT 'out0.notes' AS path, 'not a note list' AS reason, count(*) AS n FROM embeddings WHERE label = 7"


def success_log(spark, sf_dir):
    lines = _lines(_text_tracks(spark, sf_dir), "rh", lambda v: F.concat(v, F.lit("x")))
    return T.success_log(T.parse(lines, "rh", 16))


QUERIES["success_log"] = success_log
SQL["success_log"] = """SELECT 'out0.rh' AS path, count(*) AS lines, count(*) FILTER (label != 7) AS kept,
count(*) FILTER (label = 7) AS quarantined FROM embeddings"""

# Assembly ----------------------------------------------------------------------------------------


def _features(spark, sf_dir):
    """Three features; the second lacks class 2, the third class 3 and repeats class 4."""
    cat = B.tracks(spark, sf_dir)
    first = cat.select("id", "rh")
    second = cat.filter(F.col("label") != 2).select("id", "notes")
    third = cat.filter(F.col("label") != 3).select("id", "bpm", "label")
    return first, second, third.unionByName(third.filter(F.col("label") == 4))


def assemble(how):
    def run(spark, sf_dir):
        wide = C.assemble(_features(spark, sf_dir), how=how)
        return rounded(wide.select("id", F.size("rh").alias("rh"), "notes", "label", "bpm"), "bpm")

    return run


_ASSEMBLY = _TRACKS + """ z AS (SELECT 1) SELECT a.id, len(a.rh)::INT AS rh, b.notes, c.label, round(c.bpm, 6) AS bpm FROM tracks a
{j} (SELECT id, notes FROM tracks WHERE label != 2) b ON a.id = b.id {j} (SELECT id, bpm, label FROM tracks WHERE label != 3) c ON a.id = c.id"""
QUERIES["assemble_inner"] = assemble("inner")
SQL["assemble_inner"] = _ASSEMBLY.format(j="JOIN")
QUERIES["assemble_left"] = assemble("left")
SQL["assemble_left"] = _ASSEMBLY.format(j="LEFT JOIN")


def feature_id_counts(spark, sf_dir):
    a, b, c = _features(spark, sf_dir)
    return C.id_counts({"rh": a, "notes": b, "bh": c})


QUERIES["feature_id_counts"] = feature_id_counts
SQL["feature_id_counts"] = """SELECT 'rh' AS feature, count(*) AS rows, count(*) AS ids, 0::BIGINT AS repeated_ids FROM embeddings
UNION ALL SELECT 'notes', count(*), count(*), 0 FROM embeddings WHERE label != 2
UNION ALL SELECT 'bh', count(*) + count(*) FILTER (label = 4), count(*), count(*) FILTER (label = 4) FROM embeddings WHERE label != 3"""


def feature_id_consistency(spark, sf_dir):
    a, b, c = _features(spark, sf_dir)
    return C.id_consistency({"rh": a, "notes": b, "bh": c})


QUERIES["feature_id_consistency"] = feature_id_consistency
SQL["feature_id_consistency"] = """SELECT vec_id AS id, 1::BIGINT AS rh, (label != 2)::BIGINT AS notes,
CASE label WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END::BIGINT AS bh FROM embeddings WHERE label IN (2, 3, 4)"""


def common_ids(spark, sf_dir):
    a, b, c = _features(spark, sf_dir)
    return C.restrict(B.tracks(spark, sf_dir).select("id", "label"), C.common_ids([a, b, c]))


QUERIES["common_ids"] = common_ids
SQL["common_ids"] = "SELECT vec_id AS id, label FROM embeddings WHERE label NOT IN (2, 3) ORDER BY id"

# Union, duplicates, repair ------------------------------------------------------------------------


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def union_dedup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.select("l_partkey", "l_suppkey", "l_returnflag")
    b = li.select("l_suppkey", "l_returnflag", "l_partkey")
    return C.union_catalogues(a, b)


QUERIES["union_dedup"] = union_dedup
SQL["union_dedup"] = """SELECT l_partkey, l_suppkey, l_returnflag FROM lineitem UNION SELECT l_partkey, l_suppkey, l_returnflag FROM lineitem"""

QUERIES["removed_by_dedup"] = lambda spark, sf_dir: C.removed_by_dedup(_docs(spark, sf_dir).select("text", "lang"))
SQL["removed_by_dedup"] = "SELECT text, lang FROM documents EXCEPT ALL SELECT DISTINCT text, lang FROM documents"

QUERIES["duplicate_keys"] = lambda spark, sf_dir: C.duplicate_keys(_docs(spark, sf_dir), ["text"])
SQL["duplicate_keys"] = "SELECT text, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1"

QUERIES["duplicate_full_rows"] = lambda spark, sf_dir: C.duplicate_keys(
    table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"),
    ["l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"],
)
SQL["duplicate_full_rows"] = """SELECT l_suppkey, l_quantity, l_returnflag, l_linestatus, count(*) AS copies
FROM lineitem GROUP BY ALL HAVING count(*) > 1"""

QUERIES["duplicate_rows"] = lambda spark, sf_dir: C.duplicate_rows(_docs(spark, sf_dir), ["text"]).select("doc_id", "lang", "n_chars")
SQL["duplicate_rows"] = """SELECT doc_id, lang, n_chars FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)"""

QUERIES["unique_rows"] = lambda spark, sf_dir: C.unique_rows(_docs(spark, sf_dir), ["text"]).select("doc_id", "lang", "n_chars")
SQL["unique_rows"] = """SELECT doc_id, lang, n_chars FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)"""

QUERIES["compare_with_first"] = lambda spark, sf_dir: C.compare_with_first(
    _docs(spark, sf_dir), ["doc_id", "source"], "text"
).drop("text")
SQL["compare_with_first"] = """SELECT copies, doc_id, source, first_doc_id, first_source FROM documents JOIN (
SELECT text, count(*) AS copies, min(doc_id) AS first_doc_id, arg_min(source, doc_id) AS first_source FROM documents GROUP BY text HAVING count(*) > 1) USING (text)"""


def validation_report(spark, sf_dir):
    return C.validation_report(_docs(spark, sf_dir).select(F.col("text").alias("id"), "lang", "source"))


QUERIES["validation_report"] = validation_report
SQL["validation_report"] = """WITH r AS (SELECT text, lang, source, count(*) AS c FROM documents GROUP BY ALL),
i AS (SELECT text, sum(c) AS n, count(*) AS d FROM r GROUP BY text)
SELECT sum(n)::BIGINT AS rows, count(*) AS ids, count(*) FILTER (n = 1) AS unique_ids,
coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_of_repeated_ids, sum(d)::BIGINT AS distinct_rows FROM i"""

QUERIES["keep_last"] = lambda spark, sf_dir: C.keep_last(
    _docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], ["n_chars", "doc_id"]
)
SQL["keep_last"] = """SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source
ORDER BY n_chars DESC, doc_id DESC) AS place FROM documents) WHERE place = 1"""


def build_catalogue(spark, sf_dir):
    """Two catalogues that share class 1, one row of each track of class 2 altered in the second."""
    cat = B.tracks(spark, sf_dir).select("id", "notes", "key", "label")
    meta = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", "source")
    first = cat.filter(F.col("label") <= 5)
    second = cat.filter((F.col("label") > 5) | F.col("label").isin(1, 2))
    second = second.withColumn("notes", F.when(F.col("label") == 2, F.lower("notes")).otherwise(F.col("notes")))
    return build.build([first, second], meta)


QUERIES["build_catalogue"] = build_catalogue
SQL["build_catalogue"] = _TRACKS + """ z AS (SELECT 1) SELECT id, notes, key, label, lang, source FROM tracks
JOIN (SELECT doc_id AS id, lang, source FROM documents) USING (id) WHERE label != 2"""

QUERIES["subset_of_size"] = lambda spark, sf_dir: C.subset(_docs(spark, sf_dir).select("doc_id", "lang"), 150, "doc_id")
SQL["subset_of_size"] = "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 150"
QUERIES["subset_count"] = lambda spark, sf_dir: C.subset(_docs(spark, sf_dir), 150, "doc_id").agg(
    F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")
)
SQL["subset_count"] = "SELECT least(150, count(*)) AS n, least(150, count(*)) AS ids FROM documents"


def round_robin(spark, sf_dir):
    """Every document falls into exactly one of eight batches."""
    dealt = C.with_batch(_docs(spark, sf_dir), 8, "doc_id")
    return dealt.agg(
        F.count("*").alias("n"),
        F.countDistinct("batch").alias("batches"),
        F.sum(F.col("batch").between(0, 7).cast("bigint")).alias("dealt"),
    )


QUERIES["work_batches"] = round_robin
SQL["work_batches"] = "SELECT count(*) AS n, 8::BIGINT AS batches, count(*) AS dealt FROM documents"

QUERIES["shard_sizes"] = lambda spark, sf_dir: table(spark, sf_dir, "customer").groupBy(
    ids.shard_of(F.col("c_name")).alias("shard")
).agg(F.count("*").alias("n"))
SQL["shard_sizes"] = "SELECT right(c_name, 2) AS shard, count(*) AS n FROM customer GROUP BY 1"

QUERIES["not_yet_labelled"] = lambda spark, sf_dir: C.not_yet_done(
    _docs(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id"
)
SQL["not_yet_labelled"] = "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)"

# Ids and classes out of paths ---------------------------------------------------------------------

_JUNK = "'[;.,\\s\"'']'"


def clean_ids(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = ids.strip_prefix(F.col("url"), "https?://")
    return pages.select(
        "page_id",
        ids.clean_id(F.col("url"), "https?://").alias("id"),
        ids.strip_bucket(path, 3).alias("unbucketed"),
        ids.class_from_path(path, 1).alias("class"),
        ids.base_name(path).alias("base"),
        ids.strip_extension(F.concat(F.element_at(F.split(path, "/"), 1), F.lit(".html"))).alias("host"),
        ids.class_from_prefix(F.element_at(F.split(path, "/"), 1), r"\.").alias("prefix"),
    )


QUERIES["clean_ids"] = clean_ids
SQL["clean_ids"] = r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS path FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(path, 'b''', '', 'g'), '\.mp3', '', 'g'), '[;.,\s"''/]', '', 'g') AS id,
path[4:] AS unbucketed, split_part(path, '/', 2) AS class, regexp_extract(path, '([^/]+)/*$', 1) AS base,
split_part(path, '/', 1) AS host, split_part(split_part(path, '/', 1), '.', 1) AS prefix FROM p"""

QUERIES["class_counts"] = lambda spark, sf_dir: learn.class_counts(
    learn.labels_from_paths(
        table(spark, sf_dir, "pages").select(ids.strip_prefix(F.col("url"), "https?://[^/]*/").alias("id"))
    )
)
SQL["class_counts"] = r"""SELECT split_part(regexp_replace(url, '^https?://[^/]*/', ''), '/', 1) AS class, count(*) AS n FROM pages GROUP BY 1"""


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("class"))


QUERIES["majority_baseline"] = lambda spark, sf_dir: rounded(learn.majority_baseline(_labels(spark, sf_dir)), "share")
SQL["majority_baseline"] = """WITH c AS (SELECT lang AS class, count(*) AS n FROM documents GROUP BY lang)
SELECT arg_max(class, (n, class)) AS class, max(n) AS n, sum(n)::BIGINT AS total, round(max(n) / sum(n), 6) AS share FROM c"""

QUERIES["classes_with_minimum"] = lambda spark, sf_dir: learn.with_minimum(
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("class")), 17
)
SQL["classes_with_minimum"] = """SELECT p_partkey AS id, p_brand || p_type AS class FROM part
WHERE p_brand || p_type IN (SELECT p_brand || p_type FROM part GROUP BY 1 HAVING count(*) >= 17)"""

QUERIES["class_subset"] = lambda spark, sf_dir: learn.of_classes(
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("class")), ["PROMO", "ECONOMY"]
)
SQL["class_subset"] = "SELECT p_partkey AS id, p_type AS class FROM part WHERE p_type IN ('PROMO', 'ECONOMY')"

QUERIES["encode_labels"] = lambda spark, sf_dir: learn.encode(_labels(spark, sf_dir))
SQL["encode_labels"] = """SELECT doc_id AS id, lang AS class, (dense_rank() OVER (ORDER BY lang) - 1)::DOUBLE AS class_index FROM documents"""

_LANGS = ["de", "en", "es", "fr"]


def _events_classes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("class"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


def multi_label_table(spark, sf_dir):
    events = _events_classes(spark, sf_dir)
    return learn.to_table(events, learn.listed_classes(events, _KINDS))


def multi_label_list(spark, sf_dir):
    rows = multi_label_table(spark, sf_dir)
    return learn.from_table(rows, rows.columns[1:])


QUERIES["multi_label_table"] = multi_label_table
SQL["multi_label_table"] = "SELECT user_id AS id, " + ", ".join(
    f"max((event_type = '{k}')::INT) AS {k}" for k in _KINDS
) + " FROM events GROUP BY user_id"
QUERIES["multi_label_list"] = multi_label_list
SQL["multi_label_list"] = "SELECT DISTINCT user_id AS id, event_type AS class FROM events"


def align_labels(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    features = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("Doc"), "doc_id", F.lit(".MP3"))).alias("id"), "n_chars")
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), "doc_id").alias("id"), "quality")
    return C.align_labels(features, labels, strip=True, lower=True)


QUERIES["align_labels"] = align_labels
SQL["align_labels"] = """SELECT source || '/' || lang || '/Doc' || doc_id || '.MP3' AS id, n_chars, quality
FROM documents JOIN labels USING (doc_id) ORDER BY id"""

QUERIES["match_report"] = lambda spark, sf_dir: C.match_report(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")
SQL["match_report"] = """SELECT (SELECT count(*) FROM documents) AS left_ids, (SELECT count(*) FROM labels) AS right_ids,
(SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS matching"""

# Metadata joins ------------------------------------------------------------------------------------


def enrich(spark, sf_dir):
    meta = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = C.enrich(table(spark, sf_dir, "orders"), meta, "o_custkey")
    return rows.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "o_totalprice")


QUERIES["metadata_enrichment"] = enrich
SQL["metadata_enrichment"] = """SELECT o_orderkey, o_custkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey"""


def star(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    nation = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    order = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = C.star(
        line,
        (order, ["o_orderkey"]),
        (t("customer").select("c_custkey", "c_nationkey"), ["c_custkey"]),
        (nation, ["c_nationkey"]),
        (t("region"), ["r_regionkey"]),
        (t("supplier").select("s_suppkey", "s_name"), ["s_suppkey"]),
    )
    return rows.groupBy("r_name", "n_name", "s_name").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


QUERIES["star_join"] = star
SQL["star_join"] = """SELECT r_name, n_name, s_name, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL"""


def join_by_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    left = part.select("p_partkey", F.col("p_name").alias("track"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"))
    tags = left.select(
        F.concat(F.lit(" "), F.upper("track")).alias("track"),
        F.lower("artist").alias("artist"),
        F.concat(F.lower("album"), F.lit(" ")).alias("album"),
        F.col("p_partkey").alias("tag"),
    )
    keys = ["track", "artist", "album"]
    return C.join_by_text(left, C.keep_last(tags, keys, ["tag"]), keys)


QUERIES["join_by_text"] = join_by_text
SQL["join_by_text"] = """SELECT p_partkey, p_name AS track, p_brand AS artist, p_type AS album, max(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS tag FROM part"""

QUERIES["attribute_filter"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").filter(
    F.col("text").isNotNull() & (F.trim("text") != "") & (F.col("source") == "src3")
).select("doc_id", "lang")
SQL["attribute_filter"] = "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND trim(text) != '' AND source = 'src3'"

# Classifiers ----------------------------------------------------------------------------------------


def _labelled(spark, sf_dir):
    return B.tracks(spark, sf_dir).select("id", "rp", F.col("label").alias("class"))


def svm_classify(spark, sf_dir):
    """One-vs-rest linear SVM on standardised vectors, predictions on the training tracks."""
    rows = _labelled(spark, sf_dir)
    return learn.classify(learn.train(rows, "rp", 10), rows, "rp")


QUERIES["svm_classify"] = svm_classify


def svm_accuracy(spark, sf_dir):
    """Trained on four fifths of the tracks, right answers on the rest."""
    rows = _labelled(spark, sf_dir)
    held_out = F.crc32(F.col("id").cast("string")) % 5 == 0
    model = learn.train(rows.filter(~held_out), "rp", 10)
    return learn.accuracy(learn.classify(model, rows.filter(held_out), "rp"))


QUERIES["svm_accuracy"] = svm_accuracy


def svm_cross_validation(spark, sf_dir):
    """Mean and deviation of the accuracy over three folds."""
    model = learn.cross_validate(_labelled(spark, sf_dir), "rp", folds=3, iterations=5)
    numbers = [(3, float(model.avgMetrics[0]), float(model.stdMetrics[0]))]
    return spark.createDataFrame(numbers, "folds int, accuracy double, deviation double")


QUERIES["svm_cross_validation"] = svm_cross_validation

# Streams ---------------------------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    """The table as a stream of files, be it one file or a folder of parts (a pattern meets both; a plain path of one file doesn't)."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _folder(spark):
    return f"{use_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def stream_ingest(spark, sf_dir):
    """All documents arrive as a stream at a catalogue that already has the labelled ones."""
    folder = _folder(spark)
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "source")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    known.withColumn("source", F.lit("known")).write.parquet(f"{folder}/catalogue/batch=-1")
    arriving = _stream(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    ingest.ingest_new(arriving, f"{folder}/catalogue", f"{folder}/checkpoint", id_col="doc_id").awaitTermination()
    return spark.read.parquet(f"{folder}/catalogue").select("doc_id", "lang", "source")


QUERIES["stream_ingest_new"] = stream_ingest
SQL["stream_ingest_new"] = """SELECT doc_id, lang, CASE WHEN l.doc_id IS NOT NULL THEN 'known' ELSE source END AS source
FROM documents LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)"""


def stream_score(spark, sf_dir):
    """Every track arrives as a query against the static catalogue."""
    folder = _folder(spark)
    raw = _stream(spark, sf_dir, "embeddings")
    queries = raw.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("rp"))
    queries = queries.withColumn("rh", F.slice("rp", 1, 16))
    cat = B.tracks(spark, sf_dir)
    ingest.score_queries(queries, cat, features_of(["rp", "rh"]), 3, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").select("query_id", "rank", "id", "aggregated"), "aggregated")


QUERIES["stream_score_queries"] = stream_score
SQL["stream_score_queries"] = scaled_sql(["rp", "rh"], source="queries AS (SELECT * FROM tracks),") + top_sql(
    3, "query_id, rank, id, round(aggregated, 6) AS aggregated"
)


def stream_index(spark, sf_dir):
    """Tracks arrive at a catalogue that has the even classes; the bucket index beside it answers for all of them."""
    folder = _folder(spark)
    catalogue, index = f"{folder}/catalogue", f"{folder}/index"
    known = B.tracks(spark, sf_dir).select("id", "label", "rp").where("label % 2 = 0")
    known.write.parquet(f"{catalogue}/batch=-1")
    ann.index(V.WIDE, known, "rp").write.parquet(f"{index}/batch=-1")
    raw = _stream(spark, sf_dir, "embeddings")
    arriving = raw.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("rp"))
    beside = {index: lambda new: ann.index(V.WIDE, new, "rp")}
    ingest.ingest_new(arriving, catalogue, f"{folder}/checkpoint", beside=beside).awaitTermination()
    cat = spark.read.parquet(catalogue).drop("batch")
    found = ann.approximate_top_k(V.WIDE, cat, B.query_list(cat), "rp", 10, spark.read.parquet(index))
    return rounded(found, "distance")


QUERIES["stream_keeps_index"] = stream_index
SQL["stream_keeps_index"] = V.SQL["lsh_top_k"]


def stream_dedup(spark, sf_dir):
    folder = _folder(spark)
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    query = (
        ingest.dedup_on_arrival(events, "ts", "60 days")
        .select("id")
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


QUERIES["stream_dedup_on_arrival"] = stream_dedup
SQL["stream_dedup_on_arrival"] = "SELECT DISTINCT user_id AS id FROM events"
