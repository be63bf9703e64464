"""Score a stream of documents with a static word-statistics model.

The reference has no streams; its stateless steps (label projections,
prompt rendering, scoring against a fitted model) run unchanged on
``readStream`` input.  Each micro-batch is a plain DataFrame scored by the
batch operator; output is written per batch id, so a replayed batch after a
failure overwrites its own folder (exactly-once at the sink).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.classify import nb_score
from parlance.session import scratch_path

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def freeze_model(spark: SparkSession, model: DataFrame, prior) -> tuple[DataFrame, float]:
    """Write the model table to the shared folder once and read it back, so
    micro-batches never recompute training; the prior becomes a literal."""
    path = scratch_path(spark, "nb-model")
    model.select("word", "lo").write.parquet(path)
    prior_value = spark.range(1).select(prior.alias("p")).first()["p"]
    return spark.read.parquet(path), prior_value


def model_mark(model: DataFrame, prior: float) -> str:
    """A short text that differs for another model: its words, a sum of hashes and the prior."""
    row = model.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("word", "lo").cast("decimal(20,0)")).alias("s")).first()
    return f"{row['n']}:{row['s']}:{prior!r}"


def _same_model(spark: SparkSession, checkpoint: str, mark: str) -> None:
    """Leave ``mark`` beside the checkpoint, or compare it with the one that lies there."""
    place = checkpoint.rstrip("/") + ".model"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        held = spark.read.text(place).first()["value"]
        if held != mark:
            raise ValueError(f"the checkpoint {checkpoint} belongs to another model")
    else:
        spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(place)


def score_stream(spark: SparkSession, path: str, model: DataFrame, prior: float,
                 exclude: DataFrame | None = None, out_dir: str | None = None,
                 checkpoint: str | None = None, max_files: int | None = None) -> str:
    """Run the stream over the files of ``path`` to completion (available-now
    trigger) and return the output folder (one sub-folder per micro-batch).

    ``out_dir`` and ``checkpoint`` named by the caller make a restarted job
    go on where it stopped; fresh folders are used otherwise.  A named
    checkpoint remembers its model and refuses another one, so that no folder
    holds scores of two models.  ``max_files``
    bounds the files of a micro-batch (default: no bound).  A source without
    files is an error.
    """
    out = out_dir or scratch_path(spark, "stream-scores")
    if checkpoint:
        _same_model(spark, checkpoint, model_mark(model, prior))
    docs = spark.readStream.schema(DOC_SCHEMA)
    if max_files:
        docs = docs.option("maxFilesPerTrigger", max_files)
    # A file source watches a folder: for a table that is one file, its folder with the name as filter.
    first = spark.read.schema(DOC_SCHEMA).parquet(path).select("_metadata.file_path").first()
    folder, _, name = path.rstrip("/").rpartition("/")
    if first and first["file_path"].rpartition("/")[2] == name:
        docs = docs.option("pathGlobFilter", name).parquet(folder)
    else:
        docs = docs.parquet(path)
    docs = docs.select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("par_id"), "text")
    if exclude is not None:
        docs = docs.join(exclude, "par_id", "left_anti")   # stream-static anti join

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        scored = nb_score(batch, model, F.lit(prior), keep=("par_id",))
        scored.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    q = (docs.writeStream.foreachBatch(per_batch)
             .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.lastProgress is None and checkpoint is None:
        raise FileNotFoundError(f"the stream found no file in {path}")
    return out
