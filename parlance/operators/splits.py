"""Split reconstruction from id manifests, set operations, positional joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.labels import parse_category_list
from parlance.plans.ordering import index_by_order

SLIM = ("text", "label")
WIDE = ("text", "label", "orig_label", "art_id", "keyword", "country")


def first_per_id(corpus: DataFrame, manifest: DataFrame, key: str = "par_id", order: str = "row_idx") -> DataFrame:
    """(key, _first): the place of the first corpus row of every id of the
    manifest.  Two narrow columns, a hash aggregate; no other column is read."""
    wanted = corpus.select(key, order).join(manifest.select(key).distinct(), key, "left_semi")
    return wanted.groupBy(key).agg(F.min(order).alias("_first"))


def rebuild_split(corpus: DataFrame, manifest: DataFrame, cols=SLIM, key: str = "par_id",
                  order: str = "row_idx", on_missing: str = "null",
                  manifest_cols=("m_idx", "par_id")) -> DataFrame:
    """For every manifest row (repeats kept), the first corpus row with its id.

    ``order`` is unique in the corpus.  The rows are chosen on (key, order)
    alone; one join on the chosen places then fetches the columns, so a
    caller that selects ids and labels never reads a text.
    ``on_missing``: 'null' keeps the manifest row with NULL fields, 'drop'
    removes it, 'error' fails the job (the reference raises IndexError).
    """
    how = "inner" if on_missing == "drop" else "left"
    chosen = manifest.select(*manifest_cols).join(first_per_id(corpus, manifest, key, order), key, how)
    if on_missing == "error":
        chosen = chosen.withColumn("_first", F.coalesce(F.col("_first"), F.raise_error(
            F.concat(F.lit("id missing from corpus: "), F.col(key)))))
    rows = corpus.select(F.col(order).alias("_first"), *[F.col(c).alias(f"_c_{c}") for c in cols])
    return chosen.join(rows, "_first", "left").select(*manifest_cols, *[F.col(f"_c_{c}").alias(c) for c in cols])


def rebuild_split_multilabel(corpus: DataFrame, manifest: DataFrame, key: str = "par_id",
                             order: str = "row_idx") -> DataFrame:
    """Text from the corpus, label from the manifest ("[..]" -> ARRAY<INT>)."""
    m = manifest.select("m_idx", key, parse_category_list("label").alias("label"))
    return rebuild_split(corpus, m, ["text"], key, order, manifest_cols=("m_idx", key, "label")).select(
        "m_idx", key, "text", "label")


def missing_ids(manifest: DataFrame, corpus: DataFrame, key: str = "par_id") -> DataFrame:
    return manifest.join(corpus.select(key), key, "left_anti")


def join_on_text(t1: DataFrame, t2: DataFrame, on: str = "text") -> DataFrame:
    """Inner join on text; overlapping columns get _x / _y like pandas.merge.
    Duplicate texts multiply as in the reference; AQE's skew join splits a
    hot text across tasks.  The join key is the text's SHA-256, so the second
    table's texts are not shuffled, and the first table's only if selected."""
    common = (set(t1.columns) & set(t2.columns)) - {on}
    a = t1.select(*[F.col(c).alias(f"{c}_x" if c in common else c) for c in t1.columns])
    b = t2.select(*[F.col(c).alias(f"{c}_y" if c in common else c) for c in t2.columns])
    a, b = a.withColumn("_k", F.sha2(on, 256)), b.withColumn("_k", F.sha2(on, 256)).drop(on)
    return a.join(b, "_k", "inner").drop("_k")


def union_augmented(base: DataFrame, augmented: DataFrame, origin: str = "origin") -> DataFrame:
    """UNION ALL by column name; columns missing on one side become NULL."""
    a = base.withColumn(origin, F.lit("base"))
    b = augmented.withColumn(origin, F.lit("aug"))
    return a.unionByName(b, allowMissingColumns=True)


def concat_classes(first: DataFrame, second: DataFrame, part: str = "part") -> DataFrame:
    """``pd.concat([first, second])`` with the block number kept as a column."""
    return first.withColumn(part, F.lit(0)).unionByName(second.withColumn(part, F.lit(1)))


def align_by_position(gold: DataFrame, gold_order, preds: DataFrame, pred_pos: str = "line_no",
                      strict: bool = True) -> DataFrame:
    """Pair the i-th gold row (under ``gold_order``) with prediction line i.
    Strict mode fails the job when the two sides differ in length."""
    g = index_by_order(gold, gold_order, "pos").withColumn("_gold", F.lit(True))
    p = preds.withColumnRenamed(pred_pos, "pos").withColumn("_pred", F.lit(True))
    j = g.join(p, "pos", "full_outer" if strict else "inner")
    if strict:
        # The marks tell a missing row from one whose values are null.
        bad = F.col("_gold").isNull() | F.col("_pred").isNull()
        j = j.withColumn("pos", F.when(bad, F.raise_error(F.lit("prediction count differs from gold"))
                                        .cast("bigint")).otherwise(F.col("pos")))
    return j.drop("_gold", "_pred")
