"""Rebalancing and sampling: first-N downsampling, seeded few-shot draws,
demonstration draws.  Every draw is a hash of (id, seed), so the result does
not depend on partitioning, and no rows are capped beyond the feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.hashing import h32, pick
from parlance.operators.labels import any_category
from parlance.plans.ordering import broadcast_if_small, fetch_one, index_by_order, lit_long, materialize

# Defaults of the reference.
FINE_TUNE_RATIO = 2
PROMPT_RATIO = 4
MULTILABEL_RATIO = 0.5
FEW_SHOT_PER_LABEL = 2000
SEEDS = (13, 21, 42, 87, 100)


def first_n(df: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """The first ``n`` rows under the unique ``order`` column, without a
    global window: a range-partitioned index of the order column alone gives
    the value of the n-th row, and the rest is a filter."""
    idx = index_by_order(df.select(order), [order], "_i")
    last = fetch_one(idx.filter(F.col("_i") < n), m=F.max(order))["m"]
    return df.filter(F.col(order) <= F.lit(last)) if last is not None else df.limit(0)


def downsample_negatives(df: DataFrame, ratio: float = FINE_TUNE_RATIO, label: str = "label",
                         order: str = "row_idx") -> DataFrame:
    """All positives plus the first ratio * n_pos negatives in row order."""
    pos = df.filter(F.col(label) == 1)
    npos = fetch_one(pos, n=F.count(F.lit(1)))["n"]
    return pos.unionByName(first_n(df.filter(F.col(label) == 0), npos * ratio, order))


def downsample_multilabel(df: DataFrame, ratio: float = MULTILABEL_RATIO, label: str = "label",
                          order: str = "m_idx") -> DataFrame:
    """Rows with any category plus the first round-half-even(ratio * n_any)
    rows with none."""
    flag = any_category(label)
    some = df.filter(flag)
    n_any = fetch_one(some, n=F.count(F.lit(1)))["n"]
    return some.unionByName(first_n(df.filter(~flag), round(n_any * ratio), order))


def few_shot_samples(df: DataFrame, n: int, seeds, label: str = "label", key: str = "par_id",
                     order: str | None = None) -> DataFrame:
    """``df`` rows drawn per seed and label, with a ``seed`` column: the ``n``
    smallest (hash(key, seed), key, order) of each (seed, label).

    All seeds share two passes.  A histogram of the hash's upper 16 bits
    finds the bucket in which the n-th row falls; rows of earlier buckets
    are in, and only the rows of that one bucket are ranked.  So no label is
    sorted whole, whatever ``n`` and the size of the label.  With a unique
    ``order`` only (key, label, order) are multiplied by the seeds; they are
    written once for both passes, and other columns join the drawn places.
    """
    narrow = list(dict.fromkeys([key, label] + ([order] if order else [])))
    if order and narrow != df.columns:
        drawn = few_shot_samples(materialize(df.select(*narrow)), n, seeds, label, key, order)
        if set(df.columns) <= set(narrow):
            return drawn.select(*df.columns, "seed")
        return df.join(drawn.select(order, "seed"), order).select(*df.columns, "seed")
    drawn = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    drawn = drawn.withColumn("_h", h32(F.col(key), F.col("seed"))).withColumn("_b", F.shiftright("_h", 16))
    # At most 65,536 rows per (seed, label).
    hist = drawn.groupBy("seed", label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("seed", label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # One row per (seed, label): the bucket that n falls into, and how many it gives.
    edge = hist.filter(F.col("_before") < n).groupBy("seed", label).agg(
        F.max_by(F.struct(F.col("_b").alias("edge"), (F.lit(n) - F.col("_before")).alias("left")), "_b").alias("_e"))
    met = drawn.join(F.broadcast(edge.withColumnRenamed("seed", "_seed").withColumnRenamed(label, "_label")),
                     (F.col("seed") == F.col("_seed")) & F.col(label).eqNullSafe(F.col("_label")))
    cols = [*df.columns, "seed"]
    inside = met.filter(F.col("_b") < F.col("_e.edge")).select(*cols)
    ties = [F.col("_h"), F.col(key)] + ([F.col(order)] if order else [])
    last = met.filter(F.col("_b") == F.col("_e.edge")).withColumn(
        "_r", F.row_number().over(Window.partitionBy("seed", label).orderBy(*ties)))
    return inside.unionByName(last.filter(F.col("_r") <= F.col("_e.left")).select(*cols))


def few_shot_sample(df: DataFrame, n: int = FEW_SHOT_PER_LABEL, seed: int = 42,
                    label: str = "label", key: str = "par_id", order: str | None = None) -> DataFrame:
    """n rows per label without replacement, a seeded uniform draw."""
    return few_shot_samples(df, n, (seed,), label, key, order).drop("seed")


def number_rows(df: DataFrame, order: str = "row_idx", out: str = "k") -> DataFrame:
    return index_by_order(df, [order], out)


def attach_demonstrations(df: DataFrame, pool: DataFrame, seed: int = 42, key: str = "par_id",
                          label: str = "label", order: str = "row_idx",
                          cols=("par_id", "text")) -> DataFrame:
    """One positive and one negative pool row per input row, drawn uniformly
    with replacement (self-draws allowed).  Pool rows are numbered 0..n-1 on
    their order column alone; the draw k = hash(id, seed, side) mod n is an
    equi-join with those numbers, and the columns of the drawn rows are
    fetched by place.  All this is done once per id, on narrow rows; the
    input's own columns meet the drawn ones in one last join.  A side
    without rows in the pool is NULL."""
    places = materialize(pool.select(F.col(order).alias("_o"), F.col(label).alias("_y")))
    sides = {"pos": 1, "neg": 0}
    numbered, sizes = None, {}
    for side, cls in sides.items():
        own = number_rows(places.filter(F.col("_y") == cls).select("_o"), "_o", "_k").select(F.lit(side).alias("_side"), "_k", "_o")
        sizes[side] = fetch_one(own, n=F.count(F.lit(1)))["n"]
        numbered = own if numbered is None else numbered.unionByName(own)
    # One row per id and side; both sides are drawn, numbered and fetched together.
    draws = F.array(*[F.struct(F.lit(side).alias("side"), pick(lit_long(n), F.col(key), seed, side).alias("k"))
                      for side, n in sizes.items() if n])
    if not any(sizes.values()):
        draws = F.array().cast("array<struct<side:string,k:bigint>>")
    drawn = df.select(key).distinct().select(key, F.explode(draws).alias("_d")).select(
        key, F.col("_d.side").alias("_side"), F.col("_d.k").alias("_k"))
    rows = sum(sizes.values())
    drawn = drawn.join(broadcast_if_small(numbered, rows), ["_side", "_k"])
    # A small pool stands for few, often drawn rows: it is broadcast if its texts fit; a large one has no hot row.
    fetched = pool.select(F.col(order).alias("_o"), *[F.col(c).alias(f"_{c}") for c in cols])
    fetched = broadcast_if_small(fetched, rows)
    drawn = drawn.join(fetched, "_o")
    one = [F.first(F.when(F.col("_side") == side, F.col(f"_{c}")), ignorenulls=True).alias(f"{side}_{c}") for side in sides for c in cols]
    given = drawn.groupBy(F.col(key).alias("_key")).agg(*one)
    return df.join(given, df[key].eqNullSafe(given["_key"]), "left").drop("_key")
