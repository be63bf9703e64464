"""A corpus table bucketed and sorted by id, for splits that are rebuilt often.

The table is dealt into buckets once, when it is written; the first row of
every id is marked then.  Rebuilding a split from a manifest moves the
manifest's few columns to the buckets and reads the corpus where it lies:
neither the shuffle nor the choice of the first row is done again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.splits import SLIM
from parlance.session import scratch_path

FIRST = "is_first"


def write_bucketed(corpus: DataFrame, name: str | None = None, key: str = "par_id", order: str = "row_idx",
                   buckets: int | None = None, path: str | None = None) -> str:
    """Write ``corpus`` bucketed by ``key`` (default: as many buckets as shuffle partitions) and return the table's name.

    ``is_first`` marks the row of each id with the least ``order``, which is
    unique.  Files lie under ``path`` (default: a scratch folder).
    """
    spark = corpus.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"corpus_{uuid.uuid4().hex[:12]}"
    first = corpus.groupBy(key).agg(F.min(order).alias(order)).withColumn(FIRST, F.lit(True))
    rows = corpus.join(first, [key, order], "left").withColumn(FIRST, F.coalesce(FIRST, F.lit(False)))
    (rows.repartition(n, key).sortWithinPartitions(key, order).write.option("path", path or scratch_path(spark, name))
         .bucketBy(n, key).sortBy(key, order).saveAsTable(name))
    return name


def rebuild_bucketed(spark: SparkSession, table: str, manifest: DataFrame, cols=SLIM, key: str = "par_id",
                     on_missing: str = "null", manifest_cols=("m_idx", "par_id")) -> DataFrame:
    """``rebuild_split`` against a table of ``write_bucketed``: the corpus side has no exchange.

    ``on_missing`` as there: 'null', 'drop' or 'error'.
    """
    rows = spark.table(table).filter(FIRST).select(key, F.lit(True).alias("_found"), *[F.col(c).alias(f"_c_{c}") for c in cols])
    out = manifest.select(*manifest_cols).join(rows, key, "inner" if on_missing == "drop" else "left")
    if on_missing == "error":
        out = out.withColumn(key, F.when(F.col("_found"), F.col(key)).otherwise(
            F.raise_error(F.concat(F.lit("id missing from corpus: "), F.col(key)))))
    return out.select(*manifest_cols, *[F.col(f"_c_{c}").alias(c) for c in cols])
