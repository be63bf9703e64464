"""Lines of text files as a Spark data source with its own byte ranges.

``spark.read.format("parlance_lines").load(path)`` gives file, range_start,
place, value: the reader cuts files into ranges of ``rangeBytes``, a line
belongs to the range that holds its first byte, and ``place`` is its number
inside the range.  The ranges follow from the option and the files' sizes
alone, so a second reading cuts alike whatever the cluster does, and line
numbers are a prefix sum over one row per range (``indexed_ranges``).

``readStream`` gives the lines that files gain, ``write`` writes one file per
task that becomes visible when all have succeeded.

The reader opens files itself: paths must be local to every worker, as on a
shared mounted folder.  Other stores are read by ``lines.indexed_lines``.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)

from parlance.plans.workers import with_package

NAME = "parlance_lines"
RANGE_BYTES = 64 << 20
# Bytes that a task reads if ranges are smaller, as far as there are PACKS tasks of that size.
PACK_BYTES, PACKS = 64 << 20, 64
_LINES = "file string, range_start bigint, place bigint, value string"
_COUNTS = "file string, range_start bigint, lines bigint"


def local_path(path: str) -> str:
    """``path`` for ``open``; a store that only Spark reads is an error."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{NAME} reads mounted folders, not {path}; use indexed_lines")
    return path


def files_of(path: str) -> list[str]:
    """The files of a file, folder or pattern in order of their names; hidden ones do not count."""
    found = sorted(glob.glob(local_path(path)))
    out = []
    for p in found:
        if os.path.isdir(p):
            out += [os.path.join(p, x) for x in sorted(os.listdir(p)) if x[0] not in "._" and os.path.isfile(os.path.join(p, x))]
        else:
            out.append(p)
    return out


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class RangePack(InputPartition):
    """Ranges that one task reads one after another."""

    ranges: list[ByteRange]


def packs_of(ranges: list[ByteRange]) -> list[RangePack]:
    """Consecutive ranges by the bytes of a task: small ranges number their lines apart but cost no task each."""
    total = sum(r.end - r.start for r in ranges)
    wanted = min(PACK_BYTES, -(-total // PACKS))
    out: list[RangePack] = []
    held = 0
    for r in ranges:
        if not out or held + r.end - r.start > wanted:
            out.append(RangePack([]))
            held = 0
        out[-1].ranges.append(r)
        held += r.end - r.start
    return out


def ranges_of(sizes: list[tuple[str, int, int]], step: int) -> list[ByteRange]:
    """Ranges of ``step`` bytes from ``start`` to ``end`` of every (file, start, end)."""
    return [ByteRange(file, a, min(a + step, end)) for file, start, end in sizes for a in range(start, end, step)]


def lines_of(part: ByteRange) -> Iterator[str]:
    """The lines that begin inside a range, without their ends (CR, LF or both)."""
    with open(part.file, "rb") as f:
        at = part.start
        if at > 0:
            # What the byte before begins belongs to the range before, up to its LF.
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < part.end:
            raw = f.readline()
            if not raw:
                return
            at += len(raw)
            raw = raw.removesuffix(b"\n").removesuffix(b"\r")
            for line in raw.split(b"\r"):
                yield line.decode("utf-8", errors="replace")


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.count = options.get("count", "false").lower() == "true"

    def partitions(self) -> list[RangePack]:
        return packs_of(ranges_of([(p, 0, os.path.getsize(p)) for p in files_of(self.path)], self.step))

    def read(self, partition: RangePack):
        for part in partition.ranges:
            if self.count:
                yield part.file, part.start, sum(1 for _ in lines_of(part))
                continue
            for i, line in enumerate(lines_of(part)):
                yield part.file, part.start, i, line


class LineStreamReader(DataSourceStreamReader):
    """Offsets are the files' sizes.  A file may grow by whole lines; it must not shrink."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"sizes": "{}"}

    def latestOffset(self) -> dict:
        return {"sizes": json.dumps({p: os.path.getsize(p) for p in files_of(self.path)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        before, now = json.loads(start["sizes"]), json.loads(end["sizes"])
        return ranges_of([(p, before.get(p, 0), n) for p, n in now.items() if n > before.get(p, 0)], self.step)

    def read(self, partition: ByteRange):
        for i, line in enumerate(lines_of(partition)):
            yield partition.file, partition.start, i, line

    def commit(self, end: dict) -> None:
        """Nothing is held for an offset."""


@dataclass
class Written(WriterCommitMessage):
    task: int
    file: str


class LineWriter(DataSourceWriter):
    """Tasks write under hidden names; ``commit`` gives them their names, ``abort`` removes them.

    A task that is tried again writes another file; only the files of the
    tasks that Spark reports are named.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = local_path(options["path"]), overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator) -> Written:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        os.makedirs(self.path, exist_ok=True)
        file = os.path.join(self.path, f".{self.job}-{task}-{uuid.uuid4().hex[:8]}")
        with open(file, "w", encoding="utf-8", newline="") as f:
            for row in iterator:
                line = "" if row[0] is None else row[0]
                if "\n" in line or "\r" in line:
                    raise ValueError("a line holds a line end")
                f.write(line + "\n")
        return Written(task, file)

    def commit(self, messages) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        old = files_of(self.path) if self.overwrite and os.path.isdir(self.path) else []
        for m in done:
            os.rename(m.file, os.path.join(self.path, f"part-{m.task:05d}-{self.job}.txt"))
        for p in old:
            os.remove(p)
        open(os.path.join(self.path, "_SUCCESS"), "w").close()

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _COUNTS if self.options.get("count", "false").lower() == "true" else _LINES

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))

    def streamReader(self, schema) -> LineStreamReader:
        return LineStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(dict(self.options), overwrite)


def register_lines(spark: SparkSession) -> None:
    """Make the format ``parlance_lines`` known to the session."""
    with_package(spark)
    spark.dataSource.register(LineSource)


def indexed_ranges(spark: SparkSession, path: str, header_lines: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, line_no, row_idx, value, as ``lines.indexed_lines`` gives them, through the data source.

    One pass counts the lines of every range; their prefix sums are one row
    per range and are broadcast.  Files that change between the two passes
    fail the job.
    """
    register_lines(spark)
    read = lambda: spark.read.format(NAME).option("rangeBytes", range_bytes)
    sizes = read().option("count", "true").load(path)
    folder, part = F.regexp_extract("file", r"^(.*)/[^/]*$", 1), F.regexp_extract("file", r"/part-([0-9]+)[^/]*$", 1).try_cast("bigint")
    in_file = Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_foff", F.coalesce(F.sum("lines").over(in_file), F.lit(0)))
    sizes = sizes.withColumn("_skip", F.least(F.greatest(F.lit(header_lines) - F.col("_foff"), F.lit(0)), F.col("lines")))
    overall = Window.orderBy(folder, part, "file", "range_start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_goff", F.coalesce(F.sum(F.col("lines") - F.col("_skip")).over(overall), F.lit(0)))
    j = read().load(path).join(F.broadcast(sizes), ["file", "range_start"], "left")
    place = F.when(F.col("place") < F.col("lines"), F.col("place")).otherwise(
        F.raise_error(F.concat(F.lit("the file changed between two readings: "), "file")).cast("bigint"))
    j = j.withColumn("place", place).filter(F.col("place") >= F.col("_skip"))
    value = F.when(F.col("place") >= F.col("_skip"), F.col("value")).alias("value")
    return j.select("file", (F.col("_foff") + F.col("place")).alias("line_no"),
                    (F.col("_goff") + F.col("place") - F.col("_skip")).alias("row_idx"), value)


def rejected_lines(lines: DataFrame, need: int, sep: str = "\t") -> DataFrame:
    """file, line_no, n_fields, value of the lines with fewer than ``need`` fields."""
    fields = F.size(F.split("value", sep, -1))
    return lines.select("file", "line_no", fields.alias("n_fields"), "value").filter(F.col("n_fields") < need)


def write_lines(df: DataFrame, path: str, column: str, mode: str = "append") -> str:
    """Write ``column`` as lines, one file per partition in order of the partitions; all files appear together."""
    register_lines(df.sparkSession)
    df.select(F.col(column).cast("string").alias("value")).write.format(NAME).mode(mode).save(path)
    return path
