"""Seeded, partition-independent pseudo-random choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h32(*parts) -> Column:
    """First 32 bits of md5 over the ':'-joined parts, as a BIGINT >= 0.

    Same value for the same parts on any partitioning or engine, which is
    what makes draws reproducible (and checkable in SQL).
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    key = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def pick(n, *parts) -> Column:
    """Uniform draw in [0, n) keyed by ``parts``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(h32(*parts), n)
