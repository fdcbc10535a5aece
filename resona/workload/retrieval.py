"""Distances, scaling, ranking and retrieval pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from resona.operators import blocks, ranking, scaling
from resona.operators import distances as D
from resona.operators.distances import PRESETS, Feature, features_of
from resona.plans import recommend as R
from resona.session import use_checkpoint_dir
from resona.workload import tables as B
from resona.workload.tables import distances_sql, rounded, scaled_sql, top_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

EIGHT = PRESETS["all"]


def _distance(spark, sf_dir, names, extra=()):
    cat = B.tracks(spark, sf_dir)
    features = features_of(names) + list(extra)
    rows = blocks.distance_rows(cat, B.query_list(cat), features)
    return rows.filter(D.all_usable(features)), [f.distance for f in features]


def _distance_query(names):
    def run(spark, sf_dir):
        rows, columns = _distance(spark, sf_dir, names)
        return rounded(rows, *columns)

    return run


def _distance_sql(names, cast=""):
    columns = ", ".join(f"round(d_{n}, 6) AS d_{n}" for n in names)
    return distances_sql(names) + f" SELECT query_id, id, {columns} FROM d"


for key, names in {
    "euclidean_rp_rh_bh": ["rp", "rh", "bh"],
    "euclidean_mfcc": ["mfcc"],
    "jensen_shannon": ["js"],
    "symmetric_kl": ["skl"],
    "chroma_correlation": ["chroma"],
    "distances_all_features": EIGHT,
}.items():
    QUERIES[key] = _distance_query(names)
    SQL[key] = _distance_sql(names)


def notes_levenshtein(spark, sf_dir):
    rows, _ = _distance(spark, sf_dir, ["notes"])
    return rows.withColumn("d_notes", F.col("d_notes").cast("int"))


QUERIES["notes_levenshtein"] = notes_levenshtein
SQL["notes_levenshtein"] = distances_sql(["notes"]) + " SELECT query_id, id, d_notes::INT AS d_notes FROM d"


def _chroma_variant(metric):
    def run(spark, sf_dir):
        feature = Feature("chroma", metric, "chroma")
        rows, columns = _distance(spark, sf_dir, [], [feature])
        return rounded(rows, *columns)

    return run


QUERIES["chroma_pitch_row"] = _chroma_variant("chroma_row")
QUERIES["chroma_same_2d"] = _chroma_variant("chroma_2d")
QUERIES["chroma_full_2d"] = _chroma_variant("chroma_full")

_PLANE = """
planes AS (SELECT query_id, id, la, lb, u.r, w.k, list_sum(list_transform(range(0, 12 * lb), lambda j: 
      CASE WHEN ({row_b}) + u.r BETWEEN 0 AND 11 AND ({col_b}) + w.k BETWEEN 0 AND la - 1
           THEN a[{at_a}] * b[j + 1] ELSE 0 END)) AS c
    FROM chroma_pairs, unnest(range({rows})) AS u(r), unnest(range({lags})) AS w(k))"""
_PAIRS = B.CHROMA_SQL[: B.CHROMA_SQL.index("chroma_lags AS")]
_HIGH_PASS = """list_max(list_transform(range(1, len(line) + 1), lambda n: list_sum(list_transform(range(1, n + 1), lambda j: 
    0.8632712640026805 * pow(0.726542528005361, n - j) * (line[j] - CASE WHEN j = 1 THEN {first} ELSE line[j - 1] END)))))"""
# rows first: cell j of b is (row j // lb, beat j % lb)
_ROWS_FIRST = dict(row_b="j // lb", col_b="j % lb", at_a="(j // lb + u.r) * la + (j % lb) + w.k + 1")
# beats first: cell j of b is (beat j // 12, row j % 12)
_BEATS_FIRST = dict(row_b="j % 12", col_b="j // 12", at_a="(j // 12 + w.k) * 12 + (j % 12) + u.r + 1")
_HEAD = "WITH " + B.TRACKS_SQL + B.QUERIES_SQL + _PAIRS

SQL["chroma_same_2d"] = (
    _HEAD
    + _PLANE.format(rows="-5, 7", lags="lb // 2 - (lb - 1), la + lb // 2 - (lb - 1)", **_ROWS_FIRST)
    + " SELECT query_id, id, round(max(c), 6) AS d_chroma FROM planes GROUP BY query_id, id"
)
SQL["chroma_full_2d"] = (
    _HEAD
    + _PLANE.format(rows="-11, 12", lags="1 - lb, la", **_BEATS_FIRST)
    + """, lines AS (SELECT query_id, id, r, max(c) AS top, list(c ORDER BY k) AS line FROM planes GROUP BY query_id, id, r),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY top DESC, r) AS place FROM lines)
SELECT query_id, id, round("""
    + _HIGH_PASS.format(first="0")
    + ", 6) AS d_chroma FROM best WHERE place = 1"
)
SQL["chroma_pitch_row"] = (
    _HEAD
    + _PLANE.format(rows="0, 1", lags="lb // 2 - (lb - 1), la + lb // 2 - (lb - 1)", **_BEATS_FIRST)
    + """, lines AS (SELECT query_id, id, list(c ORDER BY k) AS line FROM planes GROUP BY query_id, id)
SELECT query_id, id, round("""
    + _HIGH_PASS.format(first="line[1]")
    + ", 6) AS d_chroma FROM lines"
)


def query_lookup(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    return rounded(B.query_list(cat).select("id", "label", "key", "scale", "notes", "bpm"), "bpm")


QUERIES["query_lookup"] = query_lookup
SQL["query_lookup"] = (
    "WITH " + B.TRACKS_SQL + B.QUERIES_SQL + " z AS (SELECT 1) "
    "SELECT id, label, key, scale, notes, round(bpm, 6) AS bpm FROM queries"
)


def distance_statistics(spark, sf_dir):
    rows, columns = _distance(spark, sf_dir, EIGHT)
    stats = scaling.distance_stats(rows, features_of(EIGHT))
    return rounded(stats, *[c for c in stats.columns if c not in ("query_id", "n")])


QUERIES["distance_statistics"] = distance_statistics
SQL["distance_statistics"] = (
    distances_sql(EIGHT)
    + " SELECT query_id, count(*) AS n, "
    + ", ".join(
        f"round(min(d_{n}), 6) AS min_{n}, round(max(d_{n}), 6) AS max_{n}, "
        f"round(avg(d_{n}), 6) AS mean_{n}, round(stddev_samp(d_{n}), 6) AS stddev_{n}"
        for n in EIGHT
    )
    + " FROM d GROUP BY query_id"
)


def divergence_diagnostics(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    feature = D.FEATURES["js"]
    batch = D.query_batch(B.query_list(cat), [feature.column])
    counts = D.divergence_diagnostics(cat, batch, feature)
    # rounding decides the sign of a divergence of a track to itself, so those two go together
    state = F.when(F.col("status") == "negative", "ok").otherwise(F.col("status")).alias("status")
    return counts.groupBy("query_id", state).agg(F.sum("n").alias("n"))


QUERIES["divergence_diagnostics"] = divergence_diagnostics
SQL["divergence_diagnostics"] = (
    "WITH " + B.TRACKS_SQL + B.QUERIES_SQL + """
states AS (SELECT q.id AS query_id, CASE WHEN c.cxx > 0 AND c.cxx*c.cyy > c.cxy*c.cxy
    AND q.cxx > 0 AND q.cxx*q.cyy > q.cxy*q.cxy THEN 'ok' ELSE 'not_positive_definite' END AS status FROM tracks c, queries q)
SELECT query_id, status, count(*)::BIGINT AS n FROM states GROUP BY query_id, status"""
)


def gaussian_precompute(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    return cat.select("id", D.gaussian_summary("mfcc", 2).alias("g")).select(
        "id",
        F.col("g.status").alias("status"),
        F.round("g.log_det", 6).alias("log_det"),
        F.round(F.element_at("g.inverse", 1), 4).alias("inverse_xx"),
        F.round(F.element_at("g.inverse", 2), 4).alias("inverse_xy"),
    )


QUERIES["gaussian_precompute"] = gaussian_precompute
SQL["gaussian_precompute"] = (
    "WITH " + B.TRACKS_SQL + " dets AS (SELECT *, cxx*cyy - cxy*cxy AS det FROM tracks) "
    "SELECT id, CASE WHEN cxx > 0 AND det > 0 THEN 'ok' ELSE 'not_positive_definite' END AS status, "
    "round(ln(det), 6) AS log_det, round(cyy/det, 4) AS inverse_xx, round(-cxy/det, 4) AS inverse_xy FROM dets"
)

# Scaled, weighted, ranked ------------------------------------------------------------------

_KEEP = ["label"]


def _recommend(names, weights=None, k=10, scale_mode="after_join"):
    def run(spark, sf_dir):
        cat = B.tracks(spark, sf_dir)
        features = features_of(names, weights)
        out = R.recommend(cat, B.query_list(cat), features, k, scale_mode, keep=_KEEP)
        columns = [f.scaled for f in features]
        return rounded(out.select("query_id", "rank", "id", "label", *columns, "aggregated"), *columns, "aggregated")

    return run


def _recommend_sql(names, weights=None, k=10):
    columns = ["query_id", "rank", "id", "label"] + [f"round(scaled_{n}, 6) AS scaled_{n}" for n in names]
    return scaled_sql(names, weights) + top_sql(k, ", ".join(columns + ["round(aggregated, 6) AS aggregated"]))


for preset, names in PRESETS.items():
    QUERIES[f"recommend_{preset}"] = _recommend(names)
    SQL[f"recommend_{preset}"] = _recommend_sql(names)

_WEIGHTS = {"rp": 2.0, "notes": 0.5, "js": 1.5}


def recommend_stored_factors(spark, sf_dir):
    """The divergences from log-determinants and inverses that were written with the catalogue."""
    folder = f"{use_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    D.with_factors(B.tracks(spark, sf_dir), 2).drop("mfcc").write.parquet(folder)
    cat = spark.read.parquet(folder)
    features = features_of(["rp", "js", "skl"], stored=True)
    out = R.recommend(cat, B.query_list(cat), features, 10, keep=_KEEP)
    columns = [f.scaled for f in features]
    return rounded(out.select("query_id", "rank", "id", "label", *columns, "aggregated"), *columns, "aggregated")


QUERIES["recommend_stored_factors"] = recommend_stored_factors
SQL["recommend_stored_factors"] = _recommend_sql(["rp", "js", "skl"])

QUERIES["recommend_weighted"] = _recommend(["rp", "notes", "js"], _WEIGHTS)
SQL["recommend_weighted"] = _recommend_sql(["rp", "notes", "js"], _WEIGHTS)


def recommend_full_list(spark, sf_dir):
    """No k: the whole catalogue in order for one query."""
    cat = B.tracks(spark, sf_dir)
    out = R.recommend(cat, B.first_query(cat), features_of("fast"), keep=["key", "scale", "bpm"])
    return rounded(out.select("query_id", "id", "key", "scale", "bpm", "aggregated"), "aggregated", "bpm")


QUERIES["recommend_full_list"] = recommend_full_list
SQL["recommend_full_list"] = scaled_sql(PRESETS["fast"], source=B.FIRST_SQL) + (
    " SELECT query_id, s.id, key, scale, round(bpm, 6) AS bpm, round(aggregated, 6) AS aggregated "
    "FROM scored s JOIN tracks t ON t.id = s.id ORDER BY aggregated, s.id"
)


def _with_gaps(spark, sf_dir):
    """Tracks of class 3 without notes, of class 5 without rhythm pattern."""
    cat = B.tracks(spark, sf_dir)
    return cat.withColumns(
        {
            "notes": F.when(F.col("label") != 3, F.col("notes")),
            "rp": F.when(F.col("label") != 5, F.col("rp")),
        }
    )


def _gaps(missing, scale_mode):
    def run(spark, sf_dir):
        cat = _with_gaps(spark, sf_dir)
        features = features_of(["rp", "rh", "notes"])
        out = R.recommend(cat, B.query_list(cat), features, 20, scale_mode, missing, keep=_KEEP)
        return rounded(out.select("query_id", "rank", "id", "label", "aggregated"), "aggregated")

    return run


_GAP_HEAD = (
    distances_sql(["rp", "rh", "notes"])
    .replace("list_distance(c.rp, q.rp)", "CASE WHEN c.label != 5 AND q.label != 5 THEN list_distance(c.rp, q.rp) END")
    .replace(
        "levenshtein(c.notes, q.notes)::DOUBLE",
        "CASE WHEN c.label != 3 AND q.label != 3 THEN levenshtein(c.notes, q.notes)::DOUBLE END",
    )
)
_GAP_SCALES = ", ".join(
    f"(d_{n} - lo_{n}) / (hi_{n} - lo_{n}) AS s_{n}" for n in ["rp", "rh", "notes"]
)
_GAP_RANGES = ", ".join(f"min(d_{n}) AS lo_{n}, max(d_{n}) AS hi_{n}" for n in ["rp", "rh", "notes"])
_COMPLETE = "d_rp IS NOT NULL AND d_rh IS NOT NULL AND d_notes IS NOT NULL"


def _gap_sql(range_filter, row_filter, score):
    return f"""{_GAP_HEAD}, ranges AS (SELECT query_id, {_GAP_RANGES} FROM d WHERE {range_filter} GROUP BY query_id),
s AS (SELECT d.*, {_GAP_SCALES} FROM d JOIN ranges USING (query_id) WHERE {row_filter}),
scored AS (SELECT *, {score} AS aggregated FROM s)""" + top_sql(
        20, "query_id, rank, id, label, round(aggregated, 6) AS aggregated"
    )


_SUM = "(s_rp + s_rh + s_notes) / 3"
QUERIES["recommend_scaled_after_join"] = _gaps("drop", "after_join")
SQL["recommend_scaled_after_join"] = _gap_sql(_COMPLETE, _COMPLETE, _SUM)
QUERIES["recommend_scaled_before_join"] = _gaps("drop", "before_join")
SQL["recommend_scaled_before_join"] = _gap_sql("true", _COMPLETE, _SUM)
QUERIES["recommend_left_outer"] = _gaps("keep", "before_join")
SQL["recommend_left_outer"] = _gap_sql(
    "true",
    "true",
    "(coalesce(s_rp, 0) + s_rh + coalesce(s_notes, 0)) / (1 + (s_rp IS NOT NULL)::INT + (s_notes IS NOT NULL)::INT)",
)


def raw_feature_rankings(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    out = R.feature_rankings(cat, B.query_list(cat), features_of(["rp", "notes", "chroma", "skl"]), 5)
    return rounded(out.select("query_id", "feature", "rank", "id", "distance"), "distance")


QUERIES["raw_feature_rankings"] = raw_feature_rankings
SQL["raw_feature_rankings"] = distances_sql(["rp", "notes", "chroma", "skl"]) + """, long AS (
SELECT query_id, id, 'rp' AS feature, d_rp AS distance, d_rp AS o FROM d UNION ALL
SELECT query_id, id, 'notes', d_notes, d_notes FROM d UNION ALL
SELECT query_id, id, 'chroma', d_chroma, -d_chroma FROM d UNION ALL
SELECT query_id, id, 'skl', d_skl, d_skl FROM d WHERE d_skl <= 10000)
SELECT query_id, feature, rank, id, round(distance, 6) AS distance FROM (
SELECT *, row_number() OVER (PARTITION BY query_id, feature ORDER BY o, id)::INT AS rank FROM long) WHERE rank <= 5"""


def compare_feature_sets(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    out = R.feature_rankings(cat, B.query_list(cat), features_of(["rp", "rh", "notes"]), 10)
    lists = out.withColumnRenamed("feature", "feature_set")
    return ranking.side_by_side(lists, ["rp", "rh", "notes"], 10)


def feature_set_overlap(spark, sf_dir):
    cat = B.tracks(spark, sf_dir)
    out = R.feature_rankings(cat, B.query_list(cat), features_of(["rp", "rh", "notes"]), 50)
    return ranking.overlap_at_k(out.withColumnRenamed("feature", "feature_set"), 50)


_LISTS = distances_sql(["rp", "rh", "notes"]) + ", long AS (" + " UNION ALL ".join(
    f"SELECT query_id, id, '{n}' AS f, row_number() OVER (PARTITION BY query_id ORDER BY d_{n}, id)::INT AS rank FROM d"
    for n in ["rp", "rh", "notes"]
) + ")"
QUERIES["compare_feature_sets"] = compare_feature_sets
SQL["compare_feature_sets"] = _LISTS + """ SELECT query_id, rank, max(id) FILTER (f = 'rp') AS rp,
max(id) FILTER (f = 'rh') AS rh, max(id) FILTER (f = 'notes') AS notes FROM long WHERE rank <= 10 GROUP BY query_id, rank"""
QUERIES["feature_set_overlap"] = feature_set_overlap
SQL["feature_set_overlap"] = _LISTS + """ SELECT a.query_id, a.f AS set_a, b.f AS set_b, count(*) AS shared
FROM long a JOIN long b ON a.query_id = b.query_id AND a.id = b.id AND a.f < b.f
WHERE a.rank <= 50 AND b.rank <= 50 GROUP BY ALL"""


def recommend_every_track(spark, sf_dir):
    """Batch form: every track is a query against the whole catalogue."""
    cat = B.tracks(spark, sf_dir)
    out = R.recommend_many(cat, cat, features_of(["rp", "rh", "mfcc"]), 5)
    return rounded(out, "aggregated")


QUERIES["recommend_every_track"] = recommend_every_track
SQL["recommend_every_track"] = scaled_sql(["rp", "rh", "mfcc"], source="queries AS (SELECT * FROM tracks),") + top_sql(
    5, "query_id, rank, id, round(aggregated, 6) AS aggregated"
)
