"""The registered queries and their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from resona.workload import registry

# no SQL counterpart: classifiers
ROWS_ONLY = {"svm_classify", "svm_accuracy", "svm_cross_validation"}


def test_every_query_has_sql_but_the_listed():
    assert set(registry.queries()) - set(registry.oracle_sql()) == ROWS_ONLY
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 100
    assert df.columns[:4] == ["query_id", "rank", "id", "label"]


@pytest.mark.parametrize("name", ["recommend_precise", "recommend_scaled_before_join", "recommend_left_outer", "subset_of_size", "cover_evaluation", "build_catalogue", "beat_notes", "lsh_top_k", "knn_every_track", "stream_keeps_index", "genre_from_lists", "feature_text_round_trip"])
def test_some_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ours = entry.queries()[name](spark, sf)
    theirs = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    shape = lambda row, cols: tuple(round(row[c], 6) if isinstance(row[c], float) else row[c] for c in cols)
    a = sorted(str(shape(r.asDict(), sorted(names))) for r in ours.collect())
    b = sorted(str(shape(dict(zip(names, r)), sorted(names))) for r in theirs.fetchall())
    assert a == b
