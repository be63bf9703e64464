"""Paragraph, manifest, span and logit views over the driver's tables.

Each Spark view has a SQL twin (a CTE body) used by the oracle.  The
mapping follows the blueprint: documents+labels stand in for the labelled
paragraph table, events for category spans, embeddings for model logits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.hashing import pick
from parlance.operators.labels import binarise

NUM_CATEGORIES = 7
NUM_MODELS = 6
# Category names in id order (Task 2).
CATEGORIES = ["Unbalanced_power_relations", "Shallow_solution", "Presupposition",
              "Authority_voice", "Metaphors", "Compassion", "The_poorer_the_merrier"]
# Event types of the span fixture in id order.
EVENT_CATEGORIES = ["click", "error", "purchase", "signup", "view"]


# Tables whose rows carry long texts, and the key used to spread them.
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a coarsely split scan into ``spark.parlance.spread``
    partitions (a single large row group reads as one task).  Unset, the
    default, the scan stays as it is."""
    n = df.sparkSession.conf.get("spark.parlance.spread", None)
    return df.repartition(int(n), key) if n else df


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _grade(df: DataFrame):
    return (2 * F.col("toxic") + (1 - F.col("quality"))).cast("string")


def paragraphs(spark: SparkSession, d: str, with_quality: bool = False, spread_text: bool = False,
               only: DataFrame | None = None) -> DataFrame:
    """Labelled paragraphs: row_idx, par_id, art_id, keyword, country, text, orig_label, label.
    ``spread_text`` lets ``spread`` deal out the documents (token-heavy profiling queries);
    ``only`` (doc_id) names the documents that are asked for."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    if only is not None:
        docs = docs.join(only, "doc_id", "left_semi")
    if spread_text:
        docs = spread(docs, "doc_id")
    labels = table(spark, d, "labels")
    j = docs.join(labels, "doc_id")
    cols = [F.col("doc_id").alias("row_idx"),
            F.col("doc_id").cast("string").alias("par_id"),
            F.pmod(F.col("doc_id"), F.lit(100)).cast("string").alias("art_id"),
            F.col("lang").alias("keyword"), F.col("source").alias("country"),
            F.col("text"), _grade(j).alias("orig_label"),
            binarise(_grade(j)).alias("label")]
    if with_quality:
        cols.append(F.col("quality"))
    return j.select(*cols)


def split_col(par_id="par_id"):
    """Seeded 80/20 train/dev assignment of a paragraph id."""
    return F.when(pick(5, F.col(par_id), "split") == 0, F.lit("dev")).otherwise(F.lit("train"))


def category_vector(par_id, toxic):
    """Fixture 7-way label: categories only on positive paragraphs."""
    return F.transform(F.sequence(F.lit(0), F.lit(NUM_CATEGORIES - 1)),
                       lambda c: F.when((toxic == 1) & (pick(3, par_id, c, "cat") == 0), 1)
                                  .otherwise(0))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Id manifest: m_idx (file position), par_id, split, label text "[a, b, ...]"."""
    labels = table(spark, d, "labels")
    pid = F.col("doc_id").cast("string")
    vec = category_vector(pid, F.col("toxic"))
    text = F.concat(F.lit("["), F.array_join(F.transform(vec, lambda v: v.cast("string")), ", "), F.lit("]"))
    return (labels.select(F.col("doc_id").alias("m_idx"), pid.alias("par_id"), text.alias("label"))
                  .withColumn("split", split_col("par_id")))


def messy_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest with every seventh id listed again at the end and every eleventh unknown to the corpus."""
    m = manifest(spark, d)
    unknown = F.when(pick(11, F.col("par_id"), "miss") == 0, F.concat(F.lit("x"), F.col("par_id"))).otherwise(F.col("par_id"))
    again = m.filter(pick(7, F.col("par_id"), "again") == 0).withColumn("m_idx", F.col("m_idx") + 10 ** 9)
    return m.unionByName(again).withColumn("par_id", unknown)


def unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label row: row_idx, par_id, art_id, keyword, country, text."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id")
    u = docs.join(labels, "doc_id", "left_anti")
    return u.select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("par_id"),
                    F.pmod(F.col("doc_id"), F.lit(100)).cast("string").alias("art_id"),
                    F.col("lang").alias("keyword"), F.col("source").alias("country"), "text")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """One row per span: row_idx, par_id, art_id, text, keyword, country, category."""
    ev = table(spark, d, "events")
    day = F.date_format(F.col("ts"), "yyyy-MM-dd")
    return ev.select(F.col("event_id").alias("row_idx"),
                     F.concat_ws("_", F.col("user_id").cast("string"), day).alias("par_id"),
                     F.col("user_id").cast("string").alias("art_id"),
                     day.alias("text"), F.lit("events").alias("keyword"), F.lit("all").alias("country"),
                     F.col("event_type").alias("category"), F.col("value"))


def logits(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, gold (0..9), m0..m5: six 10-way score vectors, mall: one 64-way vector (DOUBLE)."""
    e = table(spark, d, "embeddings")
    as_d = lambda a: F.transform(a, lambda v: v.cast("double"))
    return e.select("vec_id", F.col("label").alias("gold"),
                    *[as_d(F.slice("embedding", 10 * m + 1, 10)).alias(f"m{m}") for m in range(NUM_MODELS)],
                    as_d(F.col("embedding")).alias("mall"))


# ---------------------------------------------------------------- SQL twins

def sql_h(*parts: str) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws(':', {inner})), 1, 8))::BIGINT"


def sql_pick(n: str, *parts: str) -> str:
    return f"({sql_h(*parts)} % ({n}))"


def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_WS = r"'[\s\x{85}\x{A0}]+'"


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {SQL_WS}), lambda t: t <> '')"


def sql_token_count(text: str) -> str:
    return f"len({sql_tokens(text)})"


def sql_collapse(text: str) -> str:
    return f"array_to_string({sql_tokens(text)}, ' ')"


_GRADE = "CAST(2 * l.toxic + (1 - l.quality) AS VARCHAR)"
P_SQL = f"""P AS (
  SELECT d.doc_id AS row_idx, CAST(d.doc_id AS VARCHAR) AS par_id,
         CAST(d.doc_id % 100 AS VARCHAR) AS art_id, d.lang AS keyword, d.source AS country,
         d.text, {_GRADE} AS orig_label,
         CASE WHEN {_GRADE} IN ('0', '1') THEN 0 ELSE 1 END AS label, l.quality
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SPLIT_SQL = f"CASE WHEN {sql_pick('5', 'par_id', sql_lit('split'))} = 0 THEN 'dev' ELSE 'train' END"


def sql_category_vector(par_id: str, toxic: str) -> str:
    return (f"list_transform(range(0, {NUM_CATEGORIES}), lambda c: CASE WHEN {toxic} = 1 AND "
            f"{sql_pick('3', par_id, 'c', sql_lit('cat'))} = 0 THEN 1 ELSE 0 END)")


M_SQL = f"""M AS (
  SELECT m_idx, par_id, {SPLIT_SQL} AS split,
         '[' || array_to_string(list_transform(vec, lambda v: CAST(v AS VARCHAR)), ', ') || ']' AS label
  FROM (SELECT doc_id AS m_idx, CAST(doc_id AS VARCHAR) AS par_id,
               {sql_category_vector('CAST(doc_id AS VARCHAR)', 'toxic')} AS vec
        FROM labels))"""

MM_SQL = f"""MM AS (
  SELECT * REPLACE (CASE WHEN {sql_pick('11', 'par_id', sql_lit('miss'))} = 0 THEN 'x' || par_id ELSE par_id END AS par_id)
  FROM (SELECT * FROM M UNION ALL
        SELECT * REPLACE (m_idx + 1000000000 AS m_idx) FROM M WHERE {sql_pick('7', 'par_id', sql_lit('again'))} = 0))"""

U_SQL = """U AS (
  SELECT d.doc_id AS row_idx, CAST(d.doc_id AS VARCHAR) AS par_id,
         CAST(d.doc_id % 100 AS VARCHAR) AS art_id, d.lang AS keyword, d.source AS country, d.text
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"""

S_SQL = """S AS (
  SELECT event_id AS row_idx, CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS par_id,
         CAST(user_id AS VARCHAR) AS art_id, strftime(ts, '%Y-%m-%d') AS text,
         'events' AS keyword, 'all' AS country, event_type AS category, value
  FROM events)"""

L_SQL = f"""L AS (
  SELECT vec_id, label AS gold, {", ".join(
      f"list_transform(embedding[{10 * m + 1}:{10 * m + 10}], lambda v: CAST(v AS DOUBLE)) AS m{m}" for m in range(NUM_MODELS))},
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS mall
  FROM embeddings)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
