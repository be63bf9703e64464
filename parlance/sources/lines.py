"""Line-numbered text scans that stay distributed.

Spark has no row order, but the formats here use it (header lines, files
aligned by line).  A line's number is rebuilt from where Spark read it:
file, split start and position inside the split.  Only one row per split
is ever gathered (a prefix sum over split sizes); each split is numbered
inside its own task.

The lines are read twice: to count the lines of the splits, and to number
them.  Both readings must cut and pack the files alike.  If settings or the
cluster change in between so that they do not, some line has no split, or a
place outside of it, and the job fails; numbers are never wrong in silence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stamped_lines(spark: SparkSession, path) -> DataFrame:
    """value, file, bs (start of the split), _f (short key of the file), _m (stamp that ascends within a split)."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.xxhash64("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("bs"), F.monotonically_increasing_id().alias("_m"))


def split_places(raw: DataFrame, header_lines: int = 0) -> DataFrame:
    """One row per split of ``stamped_lines``: _f, bs, _n (lines), _m0 (stamp of its first line; lines of a split are
    read in a row), _foff (lines before it in the file), _skip (header lines in it), _goff (data lines before it)."""
    sizes = raw.groupBy("file", "_f", "bs").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    # Part files follow their number, others their name.
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    part = F.regexp_extract("file", r"/part-([0-9]+)[^/]*$", 1).try_cast("bigint")
    prev_in_file = Window.partitionBy("file").orderBy("bs").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_foff", F.coalesce(F.sum("_n").over(prev_in_file), F.lit(0)))
    skipped = F.least(F.greatest(F.lit(header_lines) - F.col("_foff"), F.lit(0)), F.col("_n"))
    sizes = sizes.withColumn("_skip", skipped).withColumn("_data", F.col("_n") - F.col("_skip"))
    prev_all = Window.orderBy(folder, part, "file", "bs").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_goff", F.coalesce(F.sum("_data").over(prev_all), F.lit(0)))
    return sizes.select("_f", "bs", "_n", "_m0", "_foff", "_skip", "_goff")


def numbered_lines(raw: DataFrame, places: DataFrame) -> DataFrame:
    """file, line_no, row_idx, value of the lines of ``stamped_lines`` by ``split_places``; a line that has no place fails the job.

    As many lines as a split has, in a row, from another first stamp cannot
    all lie inside the split, and neither can more or fewer of them.
    """
    # Bounded by the number of input splits (input bytes / split size).  The
    # lines themselves are neither shuffled nor sorted.
    j = raw.join(F.broadcast(places), ["_f", "bs"], "left")
    local = F.col("_m") - F.col("_m0")
    local = F.when((local >= 0) & (local < F.col("_n")), local).otherwise(F.raise_error(F.concat(
        F.lit("two readings cut or packed the lines differently: "), "file")).cast("bigint"))
    j = j.withColumn("_local", local).filter(F.col("_local") >= F.col("_skip"))
    # The value depends on the join, so no later check of it can be moved in front of the header filter.
    value = F.when(F.col("_local") >= F.col("_skip"), F.col("value")).alias("value")
    return j.select("file", (F.col("_foff") + F.col("_local")).alias("line_no"),
                    (F.col("_goff") + F.col("_local") - F.col("_skip")).alias("row_idx"), value)


def indexed_lines(spark: SparkSession, path, header_lines: int = 0) -> DataFrame:
    """file, line_no (0-based inside its file), row_idx (0-based over the data
    lines of all files in path order), value.  The first ``header_lines`` lines
    of every file are dropped."""
    raw = stamped_lines(spark, path)
    return numbered_lines(raw, split_places(raw, header_lines))
