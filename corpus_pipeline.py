"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes null, empty and very long texts, ties, repeated rows, empty
tables and further columns: the docstring of its operator says what each
gives.  All but the last keep the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.language import accepted, train
from parlance.llm.mixing import mixed_documents
from parlance.llm.near_dedup import deduplicated
from parlance.llm.pieces import encode_documents
from parlance.llm.secrets import mask_secrets
from parlance.session import delete_scratch, scratch_path, scratch_scope


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that are mostly in a learned language; null texts and texts without letters go."""
    return accepted(docs, train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the least doc_id; rows of one doc_id and text are one."""
    return deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mask; ``n_chars`` follows where the column is there."""
    masked = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return masked.withColumn("n_chars", length)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights; equal rows count one by one."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; a null text has null ids."""
    return encode_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan),
          ("mixing", mixing), ("tokens", tokens)]

# No stage but mixing can be written in SQL.  The tests hold near_dedup, mixing and the ids of tokens against brute
# force, and each stage against its operator, whose own tests use brute force, round trips or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``.  A stage's scratch tables go once its result is written, and its
    input with them; the last result stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        delete_scratch(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
