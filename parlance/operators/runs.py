"""Run bookkeeping re-expressed as queries: per-epoch metric tables, the
best checkpoint with early stopping, and a leaderboard over run names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.plans.ordering import index_by_order

PATIENCE = 5
PATIENCE_INCONTEXT = 10
# Checkpoint name layout, model_seed_lr_epoch_f1_precision_recall.pt
RUN_NAME_PATTERN = r"^([^_]+)_([0-9]+)_([^_]+)_([0-9]+)_([0-9.]+)_([0-9.]+)_([0-9.]+)\.pt$"


def best_checkpoint(metrics: DataFrame, run: str = "run", epoch: str = "epoch", f1: str = "f1",
                    patience: int = PATIENCE, keep=("precision", "recall")) -> DataFrame:
    """Per run: the epoch that last strictly improved the best F1 (which
    starts at 0), and the epoch where ``patience`` epochs in a row failed to
    improve (training stops there; later epochs are ignored).

    Windows are partitioned by run, so each task holds one run's epochs.
    """
    by_run = Window.partitionBy(run).orderBy(epoch)
    before = by_run.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_run.rowsBetween(Window.unboundedPreceding, 0)
    x = metrics.withColumn("_imp", F.col(f1) > F.coalesce(F.max(f1).over(before), F.lit(0.0)))
    x = x.withColumn("_grp", F.sum(F.col("_imp").cast("int")).over(upto))
    in_grp = Window.partitionBy(run, "_grp").orderBy(epoch)
    x = x.withColumn("_streak", F.row_number().over(in_grp) - F.when(F.col("_grp") > 0, 1).otherwise(0))
    x = x.withColumn("_stop", F.min(F.when(F.col("_streak") >= patience, F.col(epoch)))
                     .over(Window.partitionBy(run)))
    ran = x.filter(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    payload = F.struct(F.col(epoch).alias("best_epoch"), F.col(f1).alias("best_f1"),
                       *[F.col(k).alias(f"best_{k}") for k in keep])
    agg = ran.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.max_by(F.when(F.col("_imp"), payload), F.when(F.col("_imp"), F.col(epoch))).alias("_b"),
        F.first("_stop").alias("stop_epoch"))
    return agg.select(run, "n_epochs", "_b.*", "stop_epoch")


def two_decimals(x) -> Column:
    """'0.56'-style text of a value in [0, 1]: the exact binary value rounded
    half to even, as Python's ``.2f`` does.  Scaling by 2**60 is exact for
    values from 1/256 up; smaller ones lose bits that cannot reach 0.005."""
    scaled = ((F.col(x) if isinstance(x, str) else x) * float(1 << 60)).cast("bigint").cast("decimal(38,0)") * 100
    unit, half = F.lit(1 << 60).cast("decimal(38,0)"), F.lit(1 << 59).cast("decimal(38,0)")
    rest = scaled % unit
    low = ((scaled - rest) / unit).cast("int")
    up = (rest > half) | ((rest == half) & (low % 2 == 1))
    pct = low + up.cast("int")
    return F.when(pct >= 100, F.lit("1.00")).otherwise(
        F.concat(F.lit("0."), F.lpad(pct.cast("string"), 2, "0")))


def run_name(model, seed, lr, epoch, f1, precision, recall) -> Column:
    """model_seed_lr_epoch_f1_p_r.pt with two-decimal metrics."""
    return F.concat(F.concat_ws("_", model, seed.cast("string"), lr, epoch.cast("string"),
                                two_decimals(f1), two_decimals(precision), two_decimals(recall)),
                    F.lit(".pt"))


def leaderboard(names: DataFrame, name: str = "name") -> DataFrame:
    """Parse checkpoint names and rank runs by F1 (then precision, then name).
    Positions come from the distributed index, not a single-task window."""
    g = lambda i: F.regexp_extract(F.col(name), RUN_NAME_PATTERN, i)
    parsed = names.select(name, g(1).alias("model"), g(2).cast("int").alias("seed"), g(3).alias("lr"),
                          g(4).cast("int").alias("epoch"), g(5).cast("double").alias("f1"),
                          g(6).cast("double").alias("precision"), g(7).cast("double").alias("recall"))
    order = [F.desc("f1"), F.desc("precision"), F.asc(name)]
    ranked = index_by_order(parsed, order, "_pos")
    return ranked.withColumn("rank", (F.col("_pos") + 1).cast("int")).drop("_pos")
