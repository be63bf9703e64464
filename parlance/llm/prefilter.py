"""Rows that may have a partner, told by a bit table before they are shuffled.

The keys of the smaller side set bits in a table whose size follows their
number up to a bound.  Rows whose bit is not set have no partner for certain;
the others are joined.  With more keys than the table is made for, it lets
more rows through, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per key, and the least and largest table as powers of two: 16 MB at most.
BITS_PER_KEY = 64
LEAST_BITS, MOST_BITS = 18, 27
_PAGE_BITS = 15


def bit_pages(keys: DataFrame, key: Column, n: int) -> tuple[DataFrame, int]:
    """(page, bits) of the ``n`` keys of ``keys``, at most 4,096 rows of 4 KB; and the number of bits as a power of two."""
    bits = min(max((max(n, 1) * BITS_PER_KEY).bit_length(), LEAST_BITS), MOST_BITS)
    at = keys.select(_place(key, bits).alias("_at"))
    return at.groupBy(F.shiftright("_at", _PAGE_BITS).alias("_page")).agg(
        F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit((1 << _PAGE_BITS) - 1))).alias("_bits")), bits


def _place(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))


def marked(df: DataFrame, key: Column, pages: DataFrame, bits: int, out: str) -> DataFrame:
    """``df`` with ``out``: whether ``key`` may be among the keys of ``pages`` (from ``bit_pages``)."""
    at = _place(key, bits)
    bit = at.bitwiseAND(F.lit((1 << _PAGE_BITS) - 1))
    held = df.withColumn("_at", bit).withColumn("_want", F.shiftright(at, _PAGE_BITS))
    held = held.join(F.broadcast(pages), F.col("_want") == F.col("_page"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(shiftright(_at, 3) as int) + 1, 1)")), 16, 10).cast("int")
    seen = F.expr("shiftleft(1, cast(_at & 7 as int))").bitwiseAND(byte) != 0
    return held.withColumn(out, F.coalesce(seen, F.lit(False))).drop("_at", "_want", "_page", "_bits")
