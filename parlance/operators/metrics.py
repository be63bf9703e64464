"""Precision / recall / F1, confusion counts, slices, class weights.

All metrics are conditional sums in one aggregate (partial aggregation
first, so a slice holding a third of all rows is still one small row per
map task).  A zero denominator gives 0, as the published all-negative run
scored F1 = 0.0.  F1 is 2PR/(P+R), the form that reproduces the published
values to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.plans.ordering import fetch_one, lit_long


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def _prf_cols(tp: Column, pp: Column, gp: Column) -> list[Column]:
    p = _ratio(tp, pp)
    r = _ratio(tp, gp)
    f1 = F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def _counts(gold: str, pred: str, positive=1) -> list[Column]:
    g = F.col(gold) == positive
    p = F.col(pred) == positive
    return [F.count(F.when(g & p, 1)).alias("tp"), F.count(F.when(~g & p, 1)).alias("fp"),
            F.count(F.when(g & ~p, 1)).alias("fn"), F.count(F.when(~g & ~p, 1)).alias("tn")]


def prf1(df: DataFrame, gold: str = "label", pred: str = "pred", positive=1) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 for the positive class."""
    c = df.agg(*_counts(gold, pred, positive))
    return c.select("tp", "fp", "fn", "tn",
                    *_prf_cols(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))


def confusion_matrix(df: DataFrame, gold: str = "label", pred: str = "pred") -> DataFrame:
    """Long form (gold, pred, n) for the four binary cells, zero-filled."""
    c = df.agg(*_counts(gold, pred))
    return c.selectExpr("stack(4, 1, 1, tp, 0, 1, fp, 1, 0, fn, 0, 0, tn) AS (gold, pred, n)") \
            .select(F.col("gold").cast("int"), F.col("pred").cast("int"), "n")


def prf1_by_slice(df: DataFrame, slices: dict, gold: str = "label", pred: str = "pred", by=()) -> DataFrame:
    """P/R/F1 for every slice value of every slice expression, in one job;
    ``by`` names further group columns, such as a model name.

    ``slices`` maps a slice name to a column (expression).  Rows are
    expanded once per slice (what GROUPING SETS does) and aggregated once.
    """
    arr = F.array(*[F.struct(F.lit(name).alias("slice"), col.cast("string").alias("value"))
                    for name, col in slices.items()])
    x = df.select(*by, F.col(gold), F.col(pred), F.explode(arr).alias("_s")) \
          .select(*by, "_s.slice", "_s.value", gold, pred)
    c = x.groupBy(*by, "slice", "value").agg(F.count(F.lit(1)).alias("n"), *_counts(gold, pred)[:3])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, "slice", "value", "n", "tp", "fp", "fn", *_prf_cols(tp, tp + fp, tp + fn))


def multilabel_prf1(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Per-class P/R/F1 for multi-hot gold and prediction vectors of equal width."""
    z = df.select(F.posexplode(F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p")))
                  .alias("class_id", "z"))
    z = z.select("class_id", F.col("z.g").alias("g"), F.col("z.p").alias("p"))
    c = z.groupBy("class_id").agg(*_counts("g", "p")[:3], F.count(F.when(F.col("g") == 1, 1)).alias("support"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(F.col("class_id").cast("int"), "support", "tp", "fp", "fn",
                    *_prf_cols(tp, tp + fp, tp + fn))


def prediction_distribution(df: DataFrame, pred: str = "pred") -> DataFrame:
    return df.groupBy(pred).agg(F.count(F.lit(1)).alias("n"))


def balanced_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n_samples / (n_classes * n_c), as scikit-learn's 'balanced'."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    c = fetch_one(counts, total=F.sum("n"), k=F.count(F.lit(1)))
    return counts.select(label, "n", (lit_long(c["total"]) / (lit_long(c["k"]) * F.col("n"))).alias("weight"))


def split_sizes(parts: dict, label: str = "label") -> DataFrame:
    """Rows, positives and negatives per named split (one aggregate each)."""
    out = None
    for name, df in parts.items():
        a = df.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"),
                   F.count(F.when(F.col(label) == 0, 1)).alias("n_neg")) \
              .select(F.lit(name).alias("split"), "*")
        out = a if out is None else out.unionByName(a)
    return out
