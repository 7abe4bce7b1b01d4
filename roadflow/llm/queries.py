"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, lines, lm, packing, pii, simhash, suffixes, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary; it is installed on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The explicit rules of the URL query.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS]
    whole = pii.ordered(F.concat("spans", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.ordered(F.col("spans")), 256).alias("base_sha256"), whole.alias("spans"), F.size("added").cast("long").alias("n_added"), pii.count_of(F.col("added"), pii.SECRET).alias("n_secret"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(found.fp).alias("fingerprint"), "component_id")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 9).alias("mean_log_score"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_counts(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(~toxicity.in_training(F.col("doc_id")), F.lit(True)).alias("held_out"),  # a row without an id is never learnt from
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_spans",
        "spans",
    )


def queries() -> dict:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_pii": op3_pii,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_line_dedup": op9_line_dedup,
        "op10_toxicity": op10_toxicity,
    }
