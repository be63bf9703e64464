"""Operators over model scores: stacking, argmax, softmax, ensembles, losses.

Losses are evaluation operators over a scored table (no gradients).  Per-row
work stays in array expressions; ensembles aggregate the long (stacked)
form so each model's scores may come from a different table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.arrays import argmax, log_softmax_at, softmax

FOCAL_GAMMA = 2.0
BINARY_FOCAL_ALPHA = 0.25
REDUCTIONS = ("none", "mean", "sum")


def stack_models(tables: dict, key: str, scores: str = "logits") -> DataFrame:
    """UNION ALL of per-model score tables with a ``model_id`` column."""
    out = None
    for mid, df in tables.items():
        part = df.select(F.lit(mid).alias("model_id"), F.col(key), F.col(scores).alias("logits"))
        out = part if out is None else out.unionByName(part)
    return out


def explode_classes(df: DataFrame, keys, scores: str = "logits", out: str = "score") -> DataFrame:
    """(keys..., class_id, score) long form of a score vector."""
    return df.select(*keys, F.posexplode(scores).alias("class_id", out)) \
             .withColumn("class_id", F.col("class_id").cast("int"))


def top_k_classes(scores, k: int = 5) -> Column:
    """The k largest entries of a score vector as ARRAY<STRUCT<class_id, score>>,
    highest first, ties to the lower class id (array-local, no shuffle)."""
    pairs = F.transform(scores, lambda v, i: F.struct((-v).alias("neg"), i.alias("class_id")))
    top = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(top, lambda s: F.struct(s["class_id"].alias("class_id"), (-s["neg"]).alias("score")))


def ensemble_vote(stacked: DataFrame, key, num_classes: int, scores: str = "logits") -> DataFrame:
    """Mean over models of softmax(scores), then argmax (ties to the lower class).

    One aggregate keyed by example: the per-class means are C fixed
    columns, so partial aggregation applies and no second shuffle is needed.
    """
    keys = [key] if isinstance(key, str) else list(key)
    p = stacked.select(*keys, softmax(scores).alias("_p"))
    means = [F.avg(F.element_at("_p", c + 1)).alias(f"_c{c}") for c in range(num_classes)]
    agg = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), *means)
    probs = F.array(*[F.col(f"_c{c}") for c in range(num_classes)])
    return agg.select(*keys, "n_models", probs.alias("probs")).withColumn("pred", argmax("probs"))


def cross_entropy_rows(df: DataFrame, scores: str = "logits", target: str = "gold") -> DataFrame:
    return df.withColumn("loss", -log_softmax_at(scores, F.col(target)))


def cross_entropy(df: DataFrame, order: str, batch_size: int, scores: str = "logits",
                  target: str = "gold", weight: str | None = None) -> DataFrame:
    """Row mean, and the mean of per-batch means over batches of ``batch_size``
    consecutive rows of the dense position ``order`` (the reported dev loss)."""
    rows = cross_entropy_rows(df, scores, target).withColumn(
        "_b", F.floor(F.col(order) / batch_size))
    per_batch = rows.groupBy("_b").agg(F.avg("loss").alias("bl"), F.count(F.lit(1)).alias("bn"),
                                       F.sum("loss").alias("bs"))
    out = per_batch.agg(F.sum("bn").alias("n_rows"), F.count(F.lit(1)).alias("n_batches"),
                        (F.sum("bs") / F.sum("bn")).alias("loss_row_mean"),
                        F.avg("bl").alias("loss_batch_mean"))
    return out


def weighted_cross_entropy(df: DataFrame, weights: DataFrame, scores: str = "logits",
                           target: str = "gold") -> DataFrame:
    """sum(w_y * loss) / sum(w_y); ``weights`` is (target, weight), one row per class."""
    rows = cross_entropy_rows(df, scores, target).join(weights, target)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"),
                    (F.sum(F.col("weight") * F.col("loss")) / F.sum("weight")).alias("loss"))


def focal_loss_rows(df: DataFrame, alpha: float, gamma: float = FOCAL_GAMMA,
                    scores: str = "logits", target: str = "gold") -> DataFrame:
    """-alpha * (1 - p_t)^gamma * log p_t per row."""
    logp = log_softmax_at(scores, F.col(target))
    return df.withColumn("loss", -F.lit(alpha) * F.pow(1 - F.exp(logp), gamma) * logp)


def _log_sigmoid(x: Column) -> Column:
    """log(sigmoid(x)) without overflow: min(x, 0) - log1p(exp(-|x|))."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def binary_focal_loss_rows(df: DataFrame, logit: str, target: str, alpha: float = BINARY_FOCAL_ALPHA,
                           gamma: float = FOCAL_GAMMA) -> DataFrame:
    x = F.col(logit).cast("double")
    y = F.col(target).cast("double")
    s_pos = F.exp(_log_sigmoid(x))
    s_neg = F.exp(_log_sigmoid(-x))
    loss = (-F.lit(alpha) * F.pow(s_neg, gamma) * y * _log_sigmoid(x)
            - (1 - F.lit(alpha)) * F.pow(s_pos, gamma) * (1 - y) * _log_sigmoid(-x))
    return df.withColumn("loss", loss)


def reduce_loss(rows: DataFrame, reduction: str) -> DataFrame:
    if reduction not in REDUCTIONS:
        raise NotImplementedError(f"Invalid reduction mode: {reduction}")
    if reduction == "none":
        return rows
    fn = F.avg if reduction == "mean" else F.sum
    return rows.agg(fn("loss").alias("loss"))


def loss_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("loss").alias("loss_mean"),
                    F.sum("loss").alias("loss_sum"))
