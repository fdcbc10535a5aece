"""Headline queries on `$BENCH_SF_DIR` with `local[$BENCH_CPUS]`; prints one JSON line.

Seconds are those of the second run in one session ("warm"). Two parts:

* registered queries on the supplied tables;
* ranking a catalogue of `$BENCH_TRACKS` tracks (100,000 by default; 0 skips it) whose features
  have production widths (rp 1440, rh 60, bh 250, mfcc 13 + 169, notes, chroma 12 x 24). Spark
  derives it from `embeddings`, many altered copies per row. These are the numbers to hold
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from resona.functions import symbols, vectors  # noqa: E402
from resona.operators.distances import PRESETS, features_of  # noqa: E402
from resona.plans import evaluate, recommend, refine  # noqa: E402
from resona.session import local_session  # noqa: E402
from resona.workload import registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TRACKS = int(os.environ.get("BENCH_TRACKS", "100000"))

HEADLINE = [
    "distances_all_features",
    "recommend_all",
    "recommend_fast",
    "recommend_precise",
    "recommend_every_track",
    "filter_refine_bh_first",
    "prefilter_js",
    "knn_standardised",
    "lsh_top_k",
    "genre_evaluation",
    "gaussian_of_frames",
    "spectrogram",
    "beat_chroma",
    "seven_statistics",
    "build_catalogue",
    "star_join",
]

SETS = ["rh_bh_mfcc", "rh_mfcc_notes", "rp_js_chroma", "rp_skl_chroma", "all"]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def wide_catalogue(spark, rows: int, path: str):
    """`rows` tracks with features of production width, derived from `embeddings`."""
    base = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("e")
    )
    copies = -(-rows // base.count())
    many = base.repartition(32).select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    scale = 1 + F.col("copy") / 97.0
    turned = F.concat(
        F.slice("e", F.col("copy") % 64 + 1, F.lit(64)), F.slice("e", F.lit(1), F.col("copy") % 64)
    )
    v = F.transform(turned, lambda x: x * scale)
    many = many.select((F.col("vec_id") * copies + F.col("copy")).alias("id"), v.alias("v"))
    wide = F.flatten(F.array_repeat("v", 23))
    low = F.sequence(F.lit(0), F.lit(12))

    def cov_row(i):
        return F.transform(
            low,
            lambda j: F.element_at("v", i + 1) * F.element_at("v", j + 1)
            + F.when(i == j, 1.0 + F.abs(F.element_at("v", i + 14))).otherwise(0.0),
        )

    pitch = F.transform(F.slice(wide, 1, 300), lambda x: F.pmod(F.floor(x * 48).cast("int"), F.lit(12)))
    many.select(
        "id",
        F.slice(wide, 1, 1440).alias("rp"),
        F.slice(wide, 1, 60).alias("rh"),
        F.slice(wide, 1, 250).alias("bh"),
        F.concat(F.slice("v", 1, 13), F.flatten(F.transform(low, cov_row))).alias("mfcc"),
        symbols.letter_code(pitch).alias("notes"),
        F.transform(F.slice(wide, 1, 288), lambda x: F.abs(x)).alias("chroma"),
    ).filter(F.col("id") < rows).write.parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    spark = local_session(CPUS, "bench")
    registry.ship(spark)
    queries = registry.queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda name=name: drain(queries[name](spark, SF_DIR))
        timed(run)
        seconds[name] = timed(run)

    if TRACKS:
        path = os.path.join(tempfile.mkdtemp(prefix="resona-bench-"), "catalogue")
        seconds["derive_catalogue"] = timed(lambda: wide_catalogue(spark, TRACKS, path))
        wide = spark.read.parquet(path)
        one, other = recommend.find_queries(wide, "id", 0), recommend.find_queries(wide, "id", 1)
        for preset in SETS:
            features = features_of(PRESETS[preset])
            if preset == SETS[0]:
                seconds[f"rank_{TRACKS}_{preset}_cold"] = timed(
                    lambda: drain(recommend.recommend(wide, one, features, 100))
                )
            seconds[f"rank_{TRACKS}_{preset}"] = timed(
                lambda: drain(recommend.recommend(wide, other, features, 100))
            )
        fast = features_of("rh_bh_mfcc")
        seconds[f"refine_{TRACKS}_bh_first"] = timed(
            lambda: drain(refine.filter_refine(wide, one, features_of(["bh", "rh", "mfcc"]), 100))
        )
        batch = recommend.find_queries(wide, "id", *range(8))
        seconds[f"rank_{TRACKS}_rh_bh_mfcc_8_queries_one_job"] = timed(
            lambda: drain(recommend.recommend(wide, batch, fast, 100))
        )
        seconds[f"rank_{TRACKS}_rh_bh_mfcc_8_queries_loop"] = timed(
            lambda: [
                drain(recommend.recommend(wide, recommend.find_queries(wide, "id", i), fast, 100)) for i in range(8)
            ]
        )
        many = recommend.find_queries(wide, "id", *range(256))
        seconds[f"rank_{TRACKS}_rh_bh_mfcc_256_queries"] = timed(
            lambda: drain(recommend.recommend_many(wide, many, fast, 100))
        )
        for size, ranked in evaluate.size_sweep(wide, one, fast, 100, TRACKS, max(1, TRACKS // 4)):
            seconds[f"sweep_{size}_rh_bh_mfcc"] = timed(lambda: drain(ranked))

    headline = sum(seconds[n] for n in HEADLINE)
    print(
        json.dumps(
            {
                "metric": "sum of warm headline queries",
                "value": round(headline, 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                "cpus": CPUS,
                "tracks": TRACKS,
            }
        )
    )


if __name__ == "__main__":
    main()
