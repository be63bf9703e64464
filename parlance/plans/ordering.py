"""Order-dependent building blocks that stay distributed.

pandas row order is data in the reference ("first N negatives", files
aligned by line).  A global ``row_number()`` without a partition moves all
rows into one task, so these helpers never use one over data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import scratch_path, shared_dir

_LOW33 = (1 << 33) - 1


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def fetch_one(df: DataFrame, **aggs) -> dict:
    """Evaluate several one-row aggregates in one job; return Python values.

    The row has a fixed size (one value per aggregate), so nothing that
    grows with the data reaches the driver.  The values then enter plans as
    literals: a scalar subquery referenced from several expressions is
    planned once per reference, each re-running its whole input.
    """
    return df.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict()


def lit_long(v) -> Column:
    """A fetched count as a BIGINT literal (sums of counts must not overflow INT)."""
    return F.lit(v).cast("bigint")


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read (counts, models) to
    the shared checkpoint folder once.  Without it each branch re-runs the
    scan and tokenisation: column pruning makes the branches' aggregates
    differ, so Spark cannot reuse the shuffle.  Reliable storage also cuts
    the lineage, so a lost executor does not re-run the upstream work."""
    return _written(df, "table")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    a new relation with new column ids (a checkpoint keeps its input's ids,
    which can make a later join with a related plan ambiguous)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def index_by_order(df: DataFrame, order_cols, out: str = "idx",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based position ``out`` following ``order_cols``.

    Range-partition and sort, stamp each row with its partition and its
    place inside it, and write that to the shared checkpoint folder so a
    lost executor cannot renumber rows.  Offsets are a prefix sum over one
    row per partition (size bounded by the partition count, broadcast).
    ``order_cols`` must be a total order for the result to be unique.
    """
    shared_dir(df.sparkSession)
    order = _cols(order_cols)
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    ranged = _written(ranged.sortWithinPartitions(*order)
                        .withColumn("_m", F.monotonically_increasing_id()), "index")
    part = F.shiftright(F.col("_m"), 33)
    counts = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), part == F.col("_p"))
                  .withColumn(out, (F.col("_off") + F.col("_m").bitwiseAND(F.lit(_LOW33))).cast("bigint"))
                  .drop("_m", "_p", "_off"))


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, rank_col: str | None = "rank") -> DataFrame:
    """Rows ranked 1..k inside each group under ``order_cols`` (a total order),
    for small k: Spark plans a partial group limit before the shuffle, so
    every map task forwards at most k rows per group.  That limit stops at
    ``spark.sql.optimizer.windowGroupLimitThreshold``; ``sampling`` draws
    larger samples by a threshold instead of a ranking."""
    name = rank_col or "_rank"
    ranked = F.row_number().over(Window.partitionBy(*_cols(group_cols)).orderBy(*_cols(order_cols)))
    out = df.withColumn(name, ranked).filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)


BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a table whose counted ``rows`` stay under ``limit``
    and whose strings and binaries hold at most ``max_bytes`` (one more small
    aggregate, run only if the rows are few enough); beyond it the join
    shuffles.  Other columns are a few numbers per row."""
    if rows > limit:
        return df
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    if wide:
        total = fetch_one(df, b=sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in wide), F.lit(0)))["b"]
        if total > max_bytes:
            return df
    return F.broadcast(df)
