"""From raw documents to packed training sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a DataFrame, which is written as Parquet and reread as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadflow.llm import decontaminate, lines, packing, simhash, toxicity
from roadflow.llm.common import discard, discard_since, materialise, written
from roadflow.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores 0.5 or more go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go; so do documents that had no other text."""
    return lines.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised, go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all that is left, packed into sequences of 2048."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Forward-backward marginals, hashed neighbourhoods and byte-level BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of what the stages keep of ``documents``.

    Nulls in any column, empty and very long texts and repeated rows pass as each
    stage's operator states; rows with a null id are never compared and stay to
    the end; an empty table gives no pieces.  What a stage wrote on its way is
    deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = written(), docs
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_since(spark, mark, docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
