"""Streams with state: running metrics of scored rows, and runs that stop after their patience.

Both read the files of a folder to the end (available-now trigger) and write
one folder per micro-batch, so a batch that is repeated after a failure
replaces its own output.  State lives in the checkpoint: a job that is
restarted with the same folders goes on where it stopped.
"""

from __future__ import annotations

import os

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators.runs import PATIENCE
from parlance.plans.workers import with_package

SCORED = "pos BIGINT, label INT, pred INT, ts TIMESTAMP"
EPOCHS = "run BIGINT, epoch INT, precision DOUBLE, recall DOUBLE, f1 DOUBLE"
_RUNS = ("run BIGINT, n_epochs BIGINT, best_epoch INT, best_f1 DOUBLE, best_precision DOUBLE, best_recall DOUBLE, stop_epoch INT")
_RUN_COLUMNS = [c.split()[0] for c in _RUNS.split(", ")]
_STATE = ("n_epochs BIGINT, best_epoch INT, best_f1 DOUBLE, best_precision DOUBLE, best_recall DOUBLE, streak INT, stop_epoch INT")


def _run(out: DataFrame, mode: str, target: str, checkpoint: str) -> None:
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(target, f"batch={batch_id}"))
    q = (out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    q.awaitTermination()


def _read(spark: SparkSession, path: str, schema: str, max_files: int | None) -> DataFrame:
    rows = spark.readStream.schema(schema)
    return (rows.option("maxFilesPerTrigger", max_files) if max_files else rows).parquet(path)


def _latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last row written for every key."""
    rows = spark.read.parquet(out)
    cols = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_r")) if keys else \
        rows.agg(F.max_by(F.struct(*cols), "batch").alias("_r"))
    return last.filter(F.col("_r").isNotNull()).select("_r.*")


def stream_confusion(spark: SparkSession, path: str, out: str, checkpoint: str, delay: str = "1 hour",
                     max_files: int | None = None) -> DataFrame:
    """tp, fp, fn, tn of the scored rows (``SCORED``) that have come in so far, each position once.

    A position that comes again within ``delay`` of its first time does not
    count; the state of older positions is dropped, so it stays bounded by
    the rows of that time.
    """
    rows = _read(spark, path, SCORED, max_files).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["pos"])
    g, p = F.col("label") == 1, F.col("pred") == 1
    counts = rows.groupBy().agg(F.count(F.when(g & p, 1)).alias("tp"), F.count(F.when(~g & p, 1)).alias("fp"),
                                F.count(F.when(g & ~p, 1)).alias("fn"), F.count(F.when(~g & ~p, 1)).alias("tn"))
    _run(counts, "update", out, checkpoint)
    return _latest(spark, out, [])


def _advance(run: tuple, batches, state: GroupState, patience: int):
    """One run's state after more of its epochs, in order of the epoch."""
    n, best, f1, precision, recall, streak, stop = state.get if state.exists else (0, None, None, None, None, 0, None)
    # Plain numbers: a run has a few epochs, and a frame sorted for each run costs more than all else.
    came = sorted((row for b in batches for row in zip(b["epoch"].tolist(), b["f1"].tolist(), b["precision"].tolist(), b["recall"].tolist())),
                  key=lambda row: row[0])
    for epoch, f, p, r in came:
        if stop is not None:
            break
        n += 1
        if f > (f1 or 0.0):
            best, f1, precision, recall, streak = int(epoch), f, p, r, 0
        else:
            streak += 1
            if streak >= patience:
                stop = int(epoch)
    state.update((n, best, f1, precision, recall, streak, stop))
    yield pd.DataFrame([(run[0], n, best, f1, precision, recall, stop)], columns=_RUN_COLUMNS, dtype=object)


def stream_best_checkpoint(spark: SparkSession, path: str, out: str, checkpoint: str, patience: int = PATIENCE,
                           max_files: int | None = None) -> DataFrame:
    """``best_checkpoint`` of metric rows (``EPOCHS``) as they come in: one row per run.

    A run's epochs must come in order, some per micro-batch; within one they
    are sorted.  A run that has failed to improve ``patience`` times in a row
    is stopped: later epochs change nothing.  The state is one row per run.
    """
    with_package(spark)
    rows = _read(spark, path, EPOCHS, max_files)
    done = rows.groupBy("run").applyInPandasWithState(
        lambda run, batches, state: _advance(run, batches, state, patience), _RUNS, _STATE, "update", GroupStateTimeout.NoTimeout)
    _run(done, "update", out, checkpoint)
    return _latest(spark, out, ["run"])
