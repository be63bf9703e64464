"""Corpus profiles that are kept as sketches and merged.

A profile of one part of the corpus (a day, a file) is one row per group: row
and token counts, a HyperLogLog sketch of its distinct words and a KLL sketch
of its token counts per row.  Rows of several parts merge into one without
reading a text again, so a new part costs one pass over that part only.  A
part that is stored again replaces itself.

Both sketches have a bounded size.  Distinct words have a relative standard
error of 1.04 / sqrt(2^lg_k); the rank of a returned length is off by at most
about 2.3 / k^0.9 of the rows (99 %).  With fewer values than ``k`` a KLL
sketch is exact.
"""

from __future__ import annotations

import os
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import lower_tokens
from parlance.operators.profile import PERCENTILES

LG_K = 14
KLL_K = 400


def words_error(lg_k: int = LG_K) -> float:
    """Three standard errors of the number of distinct words, relative."""
    return 3 * 1.04 / sqrt(2 ** lg_k)


def rank_error(k: int = KLL_K) -> float:
    """Largest error of a quantile's rank that is to be expected (99 %)."""
    return 2.3 / k ** 0.9


def sketched(df: DataFrame, group: str, text: str = "text", lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """group, n_rows, n_tokens, words, lengths: one pass, one small state per group and task.

    A row's token count goes with its first word, so lengths and words share
    the pass; a null or empty text is a row of no tokens.
    """
    toks = df.select(group, lower_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    each = toks.select(group, F.size("_t").cast("bigint").alias("_n"), F.posexplode_outer("_t").alias("_i", "_w"))
    first = F.coalesce(F.col("_i"), F.lit(0)) == 0
    return each.groupBy(group).agg(
        F.count(F.when(first, 1)).alias("n_rows"), F.count("_w").alias("n_tokens"),
        F.hll_sketch_agg(F.coalesce("_w", F.lit("")), lg_k).alias("words"),
        F.count(F.when(F.col("_w").isNull(), 1)).alias("n_empty"),
        F.kll_sketch_agg_bigint(F.when(first, F.col("_n")), k).alias("lengths"))


def store_profile(df: DataFrame, path: str, part: str, group: str, text: str = "text", **sizes) -> None:
    """Write the sketches of one part under ``path``; the part's earlier sketches are replaced."""
    sketched(df, group, text, **sizes).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"part={part}"))


def merged_profile(spark: SparkSession, path: str, group: str, parts=None, percentiles=PERCENTILES) -> DataFrame:
    """scope ('group' or 'all'), group, n_rows, n_tokens, n_words, quantiles of all stored ``parts`` (default: all).

    Reads sketches only: one row per part and group.
    """
    # Part names are read as text, whatever they look like.
    held = spark.read.parquet(path).withColumn("part", F.regexp_extract("_metadata.file_path", r"/part=([^/]*)/", 1))
    if parts is not None:
        held = held.filter(F.col("part").isin(*parts))
    both = held.withColumn("_s", F.explode(F.array(F.lit("group"), F.lit("all"))))
    both = both.withColumn(group, F.when(F.col("_s") == "group", F.col(group)))
    merged = both.groupBy(F.col("_s").alias("scope"), group).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_empty").alias("_e"),
        F.hll_union_agg("words").alias("_w"), F.kll_merge_agg_bigint("lengths").alias("_l"))
    # The empty word stood in for texts without words.
    n_words = F.hll_sketch_estimate("_w") - F.when(F.col("_e") > 0, 1).otherwise(0)
    ps = F.array(*[F.lit(float(p)) for p in percentiles])
    return merged.select("scope", group, "n_rows", "n_tokens", n_words.alias("n_words"),
                         F.kll_sketch_get_quantile_bigint("_l", ps).alias("quantiles"))
