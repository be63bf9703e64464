"""Connected components of a distributed edge table.

Alternating star contraction: every round links each node's larger
neighbours to the smallest node it knows, then its smaller ones.  The
rounds end when the edge table no longer changes and is then one star per
component.  Each round is written to the shared folder, so a lost executor
repeats one round at most; the driver sees two numbers per round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.plans.ordering import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(least, "u")
                .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(least, "u")
    return (linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"),
              F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from every node of ``edges``.

    Nodes are non-null longs.  Rows with a null or with both ends equal are
    no link; repeated and reversed rows count once.  An empty table gives an
    empty result; nodes without a link are not listed.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = materialize(e.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    before = _mark(e)
    while before[0]:
        e = materialize(_small_star(_large_star(e)))
        now = _mark(e)
        if now == before:
            break
        before = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
             .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
