"""Staged retrieval, neighbours, approximate search and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from resona.operators import ann, blocks, learn, neighbours, pivots
from resona.operators import distances as D
from resona.operators.distances import FEATURES, features_of
from resona.plans import evaluate as E
from resona.plans import recommend as R
from resona.plans import refine
from resona.workload import tables as B
from resona.workload.tables import distances_sql, rounded, scaled_sql, top_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Filter and refine ---------------------------------------------------------------------------

ORDERS = {
    "chroma_first": ["chroma", "rp", "rh", "bh", "notes"],
    "bh_first": ["bh", "rh", "notes", "rp", "chroma"],
    "all_features": ["js", "skl", "mfcc", "chroma", "rp", "rh", "bh", "notes"],
}


def _refine(order):
    def run(spark, sf_dir):
        cat = B.tracks(spark, sf_dir)
        out = refine.filter_refine(cat, B.query_list(cat), features_of(order), keep=["label"])
        columns = [f"scaled_{n}" for n in order] + ["aggregated"]
        return rounded(out.select("query_id", "id", "label", *columns), *columns)

    return run


def _refine_sql(order):
    sql, previous = distances_sql(order), "d"
    for n in order:
        sign = ">" if n == "chroma" else "<"
        bound = " WHERE d_skl <= 10000" if n == "skl" else ""
        share = f"(d_{n} - lo) / (hi - lo)"
        share = f"1.0 - {share}" if n == "chroma" else share
        sql += f""", u_{n} AS (SELECT * FROM {previous}{bound}),
m_{n} AS (SELECT query_id, min(d_{n}) AS lo, max(d_{n}) AS hi, avg(d_{n}) AS mean FROM u_{n} GROUP BY query_id),
r_{n} AS (SELECT u_{n}.*, CASE WHEN hi = lo THEN 0.0 ELSE {share} END AS scaled_{n}
    FROM u_{n} JOIN m_{n} USING (query_id) WHERE d_{n} {sign} mean)"""
        previous = f"r_{n}"
    mean = " + ".join(f"scaled_{n}" for n in order)
    columns = ", ".join(f"round(scaled_{n}, 6) AS scaled_{n}" for n in order)
    return sql + f" SELECT query_id, id, label, {columns}, round(({mean}) / {len(order)}, 6) AS aggregated FROM {previous}"


for key, order in ORDERS.items():
    QUERIES[f"filter_refine_{key}"] = _refine(order)
    SQL[f"filter_refine_{key}"] = _refine_sql(order)


def prefilter_js(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    others = features_of(["rp", "rh", "notes", "mfcc", "skl"])
    out = refine.prefilter(cat, B.query_list(cat), FEATURES["js"], others, 25, keep=["label"])
    columns = ["scaled_js"] + [f.scaled for f in others] + ["aggregated"]
    return rounded(out.select("query_id", "id", "label", *columns), *columns)


QUERIES["prefilter_js"] = prefilter_js
_PRE = ["rp", "rh", "notes", "mfcc", "skl"]
SQL["prefilter_js"] = distances_sql(["js", *_PRE]) + f""", js AS (SELECT query_id, min(d_js) AS lo_js, max(d_js) AS hi_js FROM d GROUP BY query_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d_js, id) AS place FROM d) WHERE place <= 25),
ranges AS (SELECT query_id, {", ".join(f"min(d_{n}) AS lo_{n}, max(d_{n}) AS hi_{n}" for n in _PRE)} FROM best GROUP BY query_id),
s AS (SELECT best.*, (d_js - lo_js) / (hi_js - lo_js) AS scaled_js, {", ".join(f"(d_{n} - lo_{n}) / (hi_{n} - lo_{n}) AS scaled_{n}" for n in _PRE)}
FROM best JOIN js USING (query_id) JOIN ranges USING (query_id) WHERE d_skl <= 10000)
SELECT query_id, id, label, {", ".join(f"round(scaled_{n}, 6) AS scaled_{n}" for n in ["js", *_PRE])},
round(({" + ".join(f"scaled_{n}" for n in ["js", *_PRE])}) / 6, 6) AS aggregated FROM s"""

# Standardised neighbours ----------------------------------------------------------------------


def _knn(column, skip):
    def run(spark, sf_dir):
        cat = B.tracks(spark, sf_dir)
        cat = cat.withColumn("rh_bh", neighbours.concatenated("rh", "bh"))
        out = neighbours.nearest(cat, B.query_list(cat), column, 6, skip_query=skip)
        return rounded(out, "distance")

    return run


_Z = """dims AS (SELECT i, avg(v[i]) AS mean, stddev_pop(v[i]) AS sd FROM cat, unnest(range(1, {w} + 1)) AS u(i) GROUP BY i),
w AS (SELECT list(CASE WHEN sd > 0 THEN 1 / (sd * sd) ELSE 0 END ORDER BY i) AS w FROM dims),
n AS (SELECT q.id AS query_id, c.id AS id, sqrt(list_sum(list_transform(range(1, {w} + 1),
    lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i]) * w.w[i]))) AS distance FROM cat c, qs q, w {where})"""


def _knn_sql(vector, width, where="", queries=None):
    queries = queries or f"SELECT id, {vector} AS v FROM queries"
    return (
        "WITH " + B.TRACKS_SQL + B.QUERIES_SQL + f"cat AS (SELECT id, label, {vector} AS v FROM tracks), qs AS ({queries}), "
        + _Z.format(w=width, where=where)
        + top_sql(6, "query_id, rank, id, round(distance, 6) AS distance", "distance", "n")
    )


QUERIES["knn_standardised"] = _knn("rp", False)
SQL["knn_standardised"] = _knn_sql("rp", 64)
QUERIES["knn_skip_query"] = _knn("rh", True)
SQL["knn_skip_query"] = _knn_sql("rh", 16, "WHERE c.id != q.id")
QUERIES["knn_concatenated_features"] = _knn("rh_bh", True)
SQL["knn_concatenated_features"] = _knn_sql("list_concat(rh, bh)", 32, "WHERE c.id != q.id")


def knn_every_track(spark, sf_dir):
    """Six nearest others of every track: chunks whose boxes are near enough are compared, the answer is exact."""
    found = pivots.cut(B.tracks(spark, sf_dir), "bh", 16, 6)
    return rounded(pivots.nearest_of_all(found), "distance")


QUERIES["knn_every_track"] = knn_every_track
SQL["knn_every_track"] = f"""WITH {B.TRACKS_SQL}
near AS (SELECT q.id AS query_id, c.id AS id, list_distance(c.bh, q.bh) AS distance FROM tracks c, tracks q WHERE c.id != q.id)
""" + top_sql(6, "query_id, rank, id, round(distance, 6) AS distance", "distance", "near")


def _centroids(cat):
    """Query vectors that are no tracks: the mean vector of each class."""
    mean = F.array(*[F.avg(F.col("rp")[i]) for i in range(64)])
    return cat.groupBy(F.col("label").cast("bigint").alias("id")).agg(mean.alias("rp"))


def _external(standardised):
    def run(spark, sf_dir):
        cat = B.tracks(spark, sf_dir)
        return rounded(neighbours.nearest(cat, _centroids(cat), "rp", 6, standardised), "distance")

    return run


_MEANS = """SELECT label::BIGINT AS id, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(rp[i]) AS m
FROM tracks, unnest(range(1, 65)) AS u(i) GROUP BY label, i) GROUP BY label"""
QUERIES["knn_external_query_scaled"] = _external(True)
SQL["knn_external_query_scaled"] = _knn_sql("rp", 64, queries=_MEANS)
QUERIES["knn_external_query_raw"] = _external(False)
SQL["knn_external_query_raw"] = SQL["knn_external_query_scaled"].replace(
    "CASE WHEN sd > 0 THEN 1 / (sd * sd) ELSE 0 END", "1.0"
)


def dimension_statistics(spark, sf_dir):
    stats = neighbours.dimension_statistics(B.tracks(spark, sf_dir), "rp")
    zipped = F.arrays_zip("mean", "stddev").alias("z")
    return stats.select("n", F.posexplode(zipped).alias("dimension", "z")).select(
        "n", "dimension", F.round("z.mean", 6).alias("mean"), F.round("z.stddev", 6).alias("stddev")
    )


QUERIES["dimension_statistics"] = dimension_statistics
SQL["dimension_statistics"] = """SELECT count(*) AS n, (i - 1)::INT AS dimension, round(avg(embedding[i]::DOUBLE), 6) AS mean,
round(stddev_pop(embedding[i]::DOUBLE), 6) AS stddev FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY i"""


def standardised_vectors(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    out = neighbours.standardise(cat, "rh", "z").select("id", F.posexplode("z").alias("dimension", "z"))
    return rounded(out, "z")


QUERIES["standardised_vectors"] = standardised_vectors
SQL["standardised_vectors"] = """WITH cells AS (SELECT vec_id AS id, (i - 1)::INT AS dimension, embedding[i]::DOUBLE AS v
FROM embeddings, unnest(range(1, 17)) AS u(i)), dims AS (SELECT dimension, avg(v) AS mean, stddev_pop(v) AS sd FROM cells GROUP BY dimension)
SELECT id, dimension, round((v - mean) / sd, 6) AS z FROM cells JOIN dims USING (dimension)"""

# Approximate neighbours ------------------------------------------------------------------------

WIDE = ann.projections(64, 0.4, 6)
NARROW = ann.projections(64, 0.1, 3)


def _rp(spark, sf_dir):
    return B.tracks(spark, sf_dir).select("id", "label", "rp")


def lsh_top_k(spark, sf_dir):
    """Bucketed random projections, then exact ranking."""
    cat = _rp(spark, sf_dir)
    return rounded(ann.approximate_top_k(WIDE, cat, B.query_list(cat), "rp", 10), "distance")


def lsh_nearest_single(spark, sf_dir):
    cat = _rp(spark, sf_dir)
    return rounded(ann.approximate_top_k(WIDE, cat, B.first_query(cat), "rp", 10).select("id", "distance"), "distance")


def lsh_similarity_join(spark, sf_dir):
    """Pairs of tracks below a distance, from shared buckets: every track against every track."""
    cat = _rp(spark, sf_dir)
    return rounded(ann.similarity_join(NARROW, cat, cat, "rp", 1.1).filter(F.col("query_id") < F.col("id")), "distance")


def lsh_recall(spark, sf_dir):
    """Of the exact ten nearest, the share among the approximate ten."""
    cat = _rp(spark, sf_dir)
    queries = B.query_list(cat)
    approximate = ann.approximate_top_k(WIDE, cat, queries, "rp", 10)
    exact = neighbours.nearest(cat, queries, "rp", 10, standardised=False)
    return rounded(ann.recall_at_k(approximate, exact), "recall")


def _lsh_sql(model, queries):
    """CTEs up to `near`: (query_id, id, distance) of the pairs that share a bucket."""
    lines = ", ".join("[" + ", ".join(map(repr, line)) + "]" for line in model.directions)
    return f"""WITH {B.TRACKS_SQL} {queries}
directions AS (SELECT unnest([{lines}]) AS line, unnest(range(0, {len(model.directions)})) AS t),
hashed AS (SELECT id, rp, t, floor(list_dot_product(rp, line::DOUBLE[]) / {model.length}::DOUBLE) AS bucket FROM tracks, directions),
near AS (SELECT DISTINCT q.id AS query_id, c.id AS id, list_distance(c.rp, q.rp) AS distance
    FROM hashed q JOIN hashed c USING (t, bucket) WHERE q.id IN (SELECT id FROM queries))"""


SQL["lsh_top_k"] = _lsh_sql(WIDE, B.QUERIES_SQL) + top_sql(10, "query_id, id, round(distance, 6) AS distance, rank", "distance", "near")
SQL["lsh_nearest_single"] = _lsh_sql(WIDE, B.FIRST_SQL) + top_sql(10, "id, round(distance, 6) AS distance", "distance", "near")
SQL["lsh_similarity_join"] = _lsh_sql(NARROW, "queries AS (SELECT id FROM tracks),") + """
SELECT query_id, id, round(distance, 6) AS distance FROM near WHERE distance <= 1.1 AND query_id < id"""
SQL["lsh_recall"] = _lsh_sql(WIDE, B.QUERIES_SQL) + """,
found AS (SELECT query_id, id FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10),
exact AS (SELECT q.id AS query_id, c.id AS id FROM queries q, tracks c
    QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(c.rp, q.rp), c.id) <= 10)
SELECT query_id, round(count(found.id) / count(*), 6) AS recall FROM exact LEFT JOIN found USING (query_id, id) GROUP BY query_id"""
QUERIES["lsh_top_k"] = lsh_top_k
QUERIES["lsh_nearest_single"] = lsh_nearest_single
QUERIES["lsh_similarity_join"] = lsh_similarity_join
QUERIES["lsh_recall"] = lsh_recall

# Evaluation ------------------------------------------------------------------------------------


def _classes(cat):
    return cat.select("id", F.col("label").alias("class"))


def cover_evaluation(spark, sf_dir):
    """All 16 feature sets, every track as query, hits among 1 and 5."""
    cat = B.tracks(spark, sf_dir)
    out = E.evaluate_covers(cat, cat, _classes(cat))
    return rounded(out, "precision_1", "recall_1", "precision_5", "recall_5")


def genre_evaluation(spark, sf_dir):
    """All 11 feature sets, every track as query, confusion counts among 10."""
    cat = B.tracks(spark, sf_dir)
    return E.evaluate_genres(cat, cat, _classes(cat))


def _all_pairs(names):
    return scaled_sql(names, source="queries AS (SELECT * FROM tracks),").replace(
        "scored AS (SELECT *, ", "scored AS (SELECT *, "
    )


def _sets_sql(sets, k):
    names = [n for n in FEATURES if any(n in s for s in sets.values())]
    lists = " UNION ALL ".join(
        f"""SELECT '{key}' AS feature_set, query_id, query_label AS original, label AS detected, id,
        row_number() OVER (PARTITION BY query_id ORDER BY ({" + ".join("scaled_" + n for n in members)}) / {len(members)}, id) AS rank
        FROM s WHERE id != query_id"""
        for key, members in sets.items()
    )
    # features are scaled over complete rows, the query itself included
    return _all_pairs(names) + f""", s AS MATERIALIZED (SELECT * FROM scored), lists AS ({lists}),
found AS (SELECT * FROM lists WHERE rank <= {k})"""


QUERIES["cover_evaluation"] = cover_evaluation
SQL["cover_evaluation"] = _sets_sql(E.COVER_SETS, 5) + """, sizes AS (SELECT label AS original, count(*) - 1 AS others FROM embeddings GROUP BY label),
per AS (SELECT feature_set, query_id, original, count(*) FILTER (original = detected AND rank <= 1) AS h1,
count(*) FILTER (original = detected AND rank <= 5) AS h5 FROM found GROUP BY ALL)
SELECT feature_set, count(*) AS queries, sum(h1)::BIGINT AS hits_1, round(avg(h1 / 1), 6) AS precision_1, round(avg(h1 / others), 6) AS recall_1,
sum(h5)::BIGINT AS hits_5, round(avg(h5 / 5), 6) AS precision_5, round(avg(h5 / others), 6) AS recall_5
FROM per JOIN sizes USING (original) GROUP BY feature_set"""
QUERIES["genre_evaluation"] = genre_evaluation
SQL["genre_evaluation"] = _sets_sql(E.GENRE_SETS, 10) + """
SELECT feature_set, original, detected, count(*) AS n FROM found GROUP BY ALL"""

_SMALL = {"mfcc": ["mfcc"], "rp_mfcc": ["rp", "mfcc"]}


def every_track_evaluation(spark, sf_dir):
    """Every track against all others by one feature: class pairs and hits among the first five."""
    cat = B.tracks(spark, sf_dir)
    found = E.neighbours_of_all(cat, FEATURES["rh"], 16, 5)
    return E.pair_hits(E.with_classes(found, _classes(cat)), (1, 5))


QUERIES["every_track_evaluation"] = every_track_evaluation
SQL["every_track_evaluation"] = f"""WITH {B.TRACKS_SQL}
near AS (SELECT q.label AS original, c.label AS detected, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(c.rh, q.rh), c.id) AS rank
    FROM tracks q, tracks c WHERE c.id != q.id)
SELECT 'rh' AS feature_set, original, detected, count(*) FILTER (rank <= 1) AS hits_1, count(*) AS hits_5
FROM near WHERE rank <= 5 GROUP BY original, detected"""


def _labelled(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    return E.with_classes(E.neighbours_by_set(cat, cat, _SMALL, 10), _classes(cat))


def _small_sql():
    return _sets_sql(_SMALL, 10)


QUERIES["classes_per_query"] = lambda spark, sf_dir: E.detected_per_query(_labelled(spark, sf_dir))
SQL["classes_per_query"] = _small_sql() + " SELECT feature_set, query_id, original, detected, count(*) AS n FROM found GROUP BY ALL"


def confusion_table(spark, sf_dir):
    classes = learn.listed_classes(_classes(B.tracks(spark, sf_dir)), range(10))
    return E.confusion_table(_labelled(spark, sf_dir), classes)


QUERIES["confusion_table"] = confusion_table
SQL["confusion_table"] = _small_sql() + " SELECT feature_set, original, " + ", ".join(
    f'count(*) FILTER (detected = {c}) AS "{c}"' for c in range(10)
) + " FROM found GROUP BY feature_set, original"
QUERIES["confusion_rollup"] = lambda spark, sf_dir: E.confusion_rollup(_labelled(spark, sf_dir))
SQL["confusion_rollup"] = _small_sql() + """ SELECT feature_set, original, detected, count(*) AS n FROM found
GROUP BY ROLLUP (feature_set, original, detected)"""
QUERIES["precision_at_k"] = lambda spark, sf_dir: rounded(E.precision_at_k(_labelled(spark, sf_dir)), "precision")
SQL["precision_at_k"] = _small_sql() + """ SELECT feature_set, count(*) AS retrieved, count(*) FILTER (original = detected) AS hits,
round(avg((original = detected)::INT), 6) AS precision FROM found GROUP BY feature_set"""


def feature_correlation(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    features = features_of("all")
    rows = blocks.distance_rows(cat, B.query_list(cat), features)
    return rounded(E.correlation_matrix(rows.filter(D.all_usable(features)), [f.distance for f in features]), "correlation")


QUERIES["feature_correlation"] = feature_correlation
SQL["feature_correlation"] = distances_sql(list(FEATURES)) + " " + " UNION ALL ".join(
    f"SELECT 'd_{a}' AS a, 'd_{b}' AS b, round(corr(d_{a}, d_{b}), 6) AS correlation FROM d WHERE d_skl <= 10000"
    for a in FEATURES
    for b in FEATURES
)
