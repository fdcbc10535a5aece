"""The whole pipeline on a small table, beside what a reader would keep."""

from __future__ import annotations

import random

import corpus_pipeline

GOOD, JUNK = [f"word{k}" for k in range(300)], [f"$${k}" for k in range(300)]


def _text(vocabulary: list[str], n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


def test_pipeline_end_to_end(spark, tmp_path):
    passage = _text(GOOD, 15, 1000)
    texts = {k: _text(GOOD, 120, k) for k in range(40)}
    texts |= {100 + k: _text(JUNK, 120, 200 + k) for k in range(40)}
    texts |= {200: texts[0], 201: texts[0], 202: "another start " + texts[1]}  # exact copies, a near copy
    texts |= {300: f"{_text(GOOD, 50, 301)} {passage.upper()} {_text(GOOD, 50, 302)}"}
    rows = [(k, t, "en", "web", len(t)) for k, t in texts.items()] + [(400, None, None, "web", None), (401, "", "en", "web", 0)]
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(k, int(k < 100), 0) for k in texts if k < 200], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, passage)], "item_id long, text string"),
    }
    for name, table in tables.items():
        table.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {r.doc_id: r.size for r in got}
    kept = {k for k, size in sizes.items() if size}
    assert kept >= set(range(2, 40)) and len(kept & {0, 200, 201}) == 1 and len(kept & {1, 202}) == 1
    assert not kept & {*range(100, 140), 300, 400, 401} and len(kept) == 40
    assert all(sizes[k] == 120 for k in range(2, 40))
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in got]
