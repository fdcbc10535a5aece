"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm import (
    collocations, decontamination, hard_negatives, line_dedup, mixing, ngram_join, ordinal_quality, quality_rules, secret_scan,
    suffix_tree, token_counts, toxicity, url_filter,
)
from resona.llm.sql import SQL
from resona.workload.registry import ship


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _model(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_read(spark, sf_dir, "documents")).drop("rejected_by")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return suffix_tree.scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op3_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(_read(spark, sf_dir, "documents"))
    return mixing.in_order(mix).select(
        "doc_id", "size", "source_size", "target", "taken", "first_position"
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_deleted", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    scored = toxicity.scored(docs, labels, fold != 2)
    held_out = F.coalesce(fold == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_read(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), _model("piece_bpe_32k.model"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    graded = ordinal_quality.graded(docs.select("doc_id", "text"), labels)
    return graded.select("doc_id", "tail_1", "tail_2", "expected_grade", F.col("accepted").alias("kept"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, benchmark).drop("text_key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select("vec_id", label.alias("label"), whole.alias("vector"))
    return hard_negatives.mined(rows, F.col("vec_id") % 50 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES = {f.__name__: f for f in (
    op1_quality_rules,
    op2_suffix_tree,
    op3_curriculum_mixing,
    op4_line_dedup,
    op5_toxicity,
    op6_ngram_join,
    op7_url_filter,
    op8_token_counts,
    op9_ordinal_quality,
    op10_decontamination,
    op11_hard_negatives,
    op12_collocations,
    op13_secret_scan,
)}


def queries() -> dict:
    def shipped(run):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return run(spark, sf_dir)

        return query

    return {name: shipped(run) for name, run in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
