"""Helpers for ``mapInArrow`` functions."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The consecutive rows with equal ``keys`` of a sorted stream, one table
    per run.  Only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols))
        a = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[a]:
                if last is not None and rows[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, i - a))
                last = rows[a]
                a = i
    if held:
        yield pa.Table.from_batches(held)


def rebatch(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of ``schema``."""
    buf: list[tuple] = []
    for r in rows:
        buf.append(r)
        if len(buf) >= size:
            yield _batch(buf, schema)
            buf = []
    if buf:
        yield _batch(buf, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def python_path(spark: SparkSession) -> None:
    """Put this package's folder on the Python path of the workers, so that
    they find it wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` by workers that find this package."""
    python_path(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``map_batches`` of a function from batches to row tuples."""
    schema = arrow_schema(ddl)

    def run(batches):
        yield from rebatch(fn(batches), schema)
    return map_batches(df, run, ddl)
