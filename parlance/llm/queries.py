"""The opN queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import chat, decontaminate, filter_audit, hard_negatives, language, main_text, mixing, pieces, secrets, warc
from parlance.llm.embedding_dedup import near_vectors
from parlance.llm.near_dedup import near_duplicates
from parlance.llm.quality import quality
from parlance.plans.fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle() -> dict[str, str]:
    return dict(ORACLE)


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"))


@query("op2_mixing", mixing.MIXTURE_SQL)
def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"))


@query("op4_warc", warc.ARCHIVE_SQL)
def op4_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archived(table(spark, d, "pages"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality(table(spark, d, "documents"))


@query("op8_chat_format", chat.CHAT_SQL)
def op8_chat_format(spark: SparkSession, d: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_hostile(spark, table(spark, d, "conversations"))))


@query("op9_embedding_dedup")
def op9_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors(table(spark, d, "embeddings"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(table(spark, d, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(table(spark, d, "documents"))


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.token_digests(table(spark, d, "documents"))


@query("op5_main_text")
def op5_main_text(spark: SparkSession, d: str) -> DataFrame:
    return main_text.main_texts(table(spark, d, "pages"))


@query("op13_filter_audit", filter_audit.AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op11_decontamination", decontaminate.CONTAMINATION_SQL)
def op11_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op12_hard_negatives", hard_negatives.MINED_SQL)
def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return hard_negatives.mined(table(spark, d, "embeddings"))
