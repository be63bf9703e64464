"""Hard negatives of anchors by certified walks of shared, bound-sorted lists.

Anchors are clustered by direction.  For a cluster with centre c whose
members lie within the angle r of c, no member a scores more than
|a| |v| cos(max(0, angle(c, v) - r)) with a candidate v.  So one list per
cluster, sorted by that bound, serves all its members: each walks it, with
exact integer products, and stops for certain when what it still lacks is out
of reach of everything behind.

Candidates are packed into blocks of one direction.  A cluster's list is the
order of the blocks by their best bound and, inside a block, of candidates by
their own.  The walk goes in rounds: the next blocks of a list meet the
members still walking, a task per block and some clusters, and return the
best few per member; then one row per member decides who goes on.  A round
takes twice the blocks of the one before, so there are few rounds.

Positives are walked for first; their scores set the bands in which the
second walk looks for negatives.  Of equal vectors with one label only the
first few ids can be among anyone's first few, so the others are left out
beforehand and no group of copies grows.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.arrow import map_rows, runs
from parlance.plans.ordering import fetch_one, lit_long, materialize

POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these hundredths of the positive's.
BAND = (30, 90, 100)
# Directions are learnt on at most this many anchors and bytes; they set the order of work, not results.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CENTRES = 4096, 16 << 20, 128
GROUP_ROWS, GROUP_BYTES = 256, 1 << 20
BLOCK_ROWS, BLOCK_BYTES = 32768, 8 << 20
LEAST_BLOCK, BLOCKS = 256, 64
CELL_GROUPS = 64
CENTRE_BYTES = 32 << 20
FIRST_BLOCKS = 4
TILE = 1024
# Longer vectors of whole numbers take no part: scores, and a hundred times them, fit a long.
_MOST_LENGTH = float(1 << 27)
# What rounding can take from a cosine that comes from an angle, with room to spare.
_SLACK = 1e-7
_FAR = 1 << 60

_ROWS = "vec_id long, label int, dim int, q binary, length double"
_PACKED = "key long, dim int, ids binary, labels binary, q binary, lengths binary"


def _whole(batches, scale: float):
    for batch in batches:
        for vec, label, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if vec is None or label is None or not values.is_valid or values.values.null_count:
                continue
            v = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.floor(scale * v)
                length = math.sqrt(float(np.dot(v, v)))
            if length < _MOST_LENGTH:
                yield vec, label, len(v), v.astype(np.int32).tobytes(), length


def whole_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, dim, q (int32 floor(scale * x)), length of the rows of ``vectors`` (vec_id, label, embedding) that take part.

    A row with a null id, label, vector or component, or a component that is
    not finite, takes no part; nor does one whose length as whole numbers is
    2^27 or more.  Of rows with one vec_id the least (label, vector) counts.
    """
    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                            F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(map_rows(narrow, lambda it: _whole(it, scale), _ROWS))
    again = rows.groupBy("vec_id").count().filter("count > 1")
    if again.isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "q", "length")).alias("r")).select("vec_id", "r.*")


def _centres(anchors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Unit directions per dimension, by k-means on a bounded sample of ``n`` anchors."""
    widest = anchors.agg(F.max("dim")).first()[0] or 1
    rows = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * widest)))
    sample = anchors.filter("length > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("dim", "q", "length").collect()
    out = {}
    for dim in {r["dim"] for r in sample}:
        x = np.array([np.frombuffer(r["q"], np.int32) / r["length"] for r in sample if r["dim"] == dim])
        c = x[:max(1, min(MOST_CENTRES, n // 32, len(x)))].copy()
        for _ in range(8):
            near = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            size = np.linalg.norm(total, axis=1)
            c[size > 0] = total[size > 0] / size[size > 0, None]
        out[dim] = c
    return out


def _assigned(batches, centres):
    for batch in batches:
        for vec, label, dim, q, length in zip(*(batch.column(i).to_pylist() for i in range(5))):
            c = centres.value.get(dim)
            yield vec, label, dim, q, length, int((c @ np.frombuffer(q, np.int32)).argmax()) if c is not None else 0


def _dealt(rows: DataFrame, centres, size) -> DataFrame:
    """``rows`` with ``key``: dimension, nearest centre and, where many rows share it, a part of about ``size`` rows."""
    near = materialize(map_rows(rows, lambda it: _assigned(it, centres), _ROWS + ", centre int"))
    parts = near.groupBy("dim", "centre").agg(F.count(F.lit(1)).alias("n"))
    parts = materialize(parts.select("dim", "centre", F.ceil(F.col("n") / size).cast("long").alias("parts")))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    key = F.shiftleft(F.col("dim").cast("long"), 40) + F.shiftleft(F.col("centre").cast("long"), 24) + part
    return near.join(parts, ["dim", "centre"]).select("vec_id", "label", "dim", "q", "length", key.alias("key"))


def _column(t, name: str, kind=None) -> np.ndarray:
    held = t.column(name).combine_chunks()
    return np.frombuffer(b"".join(held.to_pylist()), kind) if kind else held.to_numpy(zero_copy_only=False)


def _blocks(batches):
    for t in runs(batches, ["key"]):
        yield (t.column("key")[0].as_py(), t.column("dim")[0].as_py(), _column(t, "vec_id").tobytes(),
               _column(t, "label").astype(np.int32).tobytes(), _column(t, "q", np.int32).tobytes(),
               _column(t, "length").tobytes())


def _cones(batches):
    """(key, dim, members, centre, angle) of every group of anchors."""
    for t in runs(batches, ["key"]):
        dim, length = t.column("dim")[0].as_py(), _column(t, "length")
        x = _column(t, "q", np.int32).reshape(len(length), dim)[length > 0] / length[length > 0, None]
        c = x.sum(0)
        size = float(np.linalg.norm(c))
        c = c / size if size > 0 else np.full(dim, 1 / math.sqrt(dim) if dim else 0.0)
        angle = float(np.arccos(np.clip(x @ c, -1, 1)).max()) if len(x) else 0.0
        yield t.column("key")[0].as_py(), dim, len(length), c.tobytes(), angle


def _bounds(vectors: np.ndarray, lengths: np.ndarray, centres: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """For each centre (rows) the most that each vector can score with a member of length 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(lengths > 0, centres @ vectors.T / lengths, 1.0)
    angle = np.arccos(np.clip(cosine, -1, 1)) - angles[:, None]
    return lengths * (np.cos(np.maximum(angle, 0)) + _SLACK)


def _block_bounds(batches, cones):
    """(grp, block, bound): the best bound in every block for each group."""
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.frombuffer(row["lengths"], np.float64)
            vectors = np.frombuffer(row["q"], np.int32).reshape(len(lengths), row["dim"]).astype(np.float64)
            keys, centres, angles = cones.value.get(row["dim"], ((), None, None))
            for a in range(0, len(keys), 256):
                best = _bounds(vectors, lengths, centres[a:a + 256], angles[a:a + 256]).max(1)
                yield from ((k, row["key"], b) for k, b in zip(keys[a:a + 256], best.tolist()))


def _lists(spark: SparkSession, cones: DataFrame, blocks: DataFrame) -> DataFrame:
    """(grp, block, bound, place): the blocks of every group by falling bound, places from 1.

    The centres go to all tasks in parts of bounded size, one pass over the blocks each.
    """
    known = fetch_one(cones, n=F.count(F.lit(1)), width=F.max("dim"))
    step = max(1, CENTRE_BYTES // (8 * max(known["width"] or 1, 1) + 64))
    parts = max(1, -(-known["n"] // step))
    out = None
    for i in range(parts):
        held = cones.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i).select("key", "dim", "centre", "angle").collect()
        by_dim = {}
        for dim in {r["dim"] for r in held}:
            own = [r for r in held if r["dim"] == dim]
            by_dim[dim] = ([r["key"] for r in own],
                           np.array([np.frombuffer(r["centre"]) for r in own]).reshape(len(own), dim),
                           np.array([r["angle"] for r in own]))
        sent = spark.sparkContext.broadcast(by_dim)
        found = map_rows(blocks, lambda it, sent=sent: _block_bounds(it, sent), "grp long, block long, bound double")
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("bound"), "block"))
    return materialize(out.withColumn("place", place))


def _asked(batches):
    """One row per group: its members still walking, and what each looks for."""
    for t in runs(batches, ["grp"]):
        bands = t.column("bands").to_pylist()
        flat = np.array([(i, b["t"], b["low"], b["high"], b["floor"]) for i, own in enumerate(bands) for b in own], np.int64)
        yield (t.column("grp")[0].as_py(), t.column("dim")[0].as_py(), _column(t, "anchor").tobytes(),
               _column(t, "label").astype(np.int32).tobytes(), _column(t, "q", np.int32).tobytes(),
               _column(t, "length").tobytes(), flat.tobytes())


def _products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact whole products of rows; ``most`` bounds their size."""
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class _Pack:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int32)
        self.lengths = np.frombuffer(row["lengths"], np.float64)
        self.q = np.frombuffer(row["q"], np.int32).reshape(len(self.ids), row["dim"])


def _walked(block: _Pack, group: _Pack, wants: np.ndarray, centre: np.ndarray, angle: float, k: int, same: bool):
    """(member, want, candidate, score): the first ``k`` of a block for every want of a group's members."""
    bound = _bounds(block.q.astype(np.float64), block.lengths, centre[None], np.array([angle]))[0]
    order = np.argsort(-bound, kind="stable")
    member, low, high, floor = wants[:, 0], wants[:, 2], wants[:, 3], wants[:, 4].copy()
    reach = group.lengths[member]
    best = np.full((len(wants), k), -_FAR, np.int64)
    most = float(group.lengths.max(initial=0) * block.lengths.max(initial=0))
    found = []
    for at in range(0, len(order), TILE):
        live = np.flatnonzero((reach * bound[order[at]] >= floor) & (low <= high))
        if not len(live):
            break
        tile = order[at:at + TILE]
        rows, of = np.unique(member[live], return_inverse=True)
        score = _products(group.q[rows], block.q[tile], most)[of]
        fits = ((group.labels[rows][:, None] == block.labels[tile]) == same)[of]
        fits &= (group.ids[rows][:, None] != block.ids[tile])[of]
        fits &= (score >= floor[live, None]) & (score <= high[live, None])
        i, j = np.nonzero(fits)
        if not len(i):
            continue
        found.append((live[i], tile[j], score[i, j]))
        both = np.concatenate([best[live], np.where(fits, score, -_FAR)], 1)
        best[live] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
        floor[live] = np.maximum(floor[live], best[live].min(1))
    if not found:
        return
    want, cand, score = (np.concatenate(x) for x in zip(*found))
    use = score >= floor[want]
    want, cand, score = want[use], cand[use], score[use]
    ids = block.ids[cand]
    order = np.lexsort((ids, -score, want))
    want, ids, score = want[order], ids[order], score[order]
    first = np.searchsorted(want, want)
    use = np.arange(len(want)) - first < k
    yield from zip(group.ids[member[want[use]]].tolist(), wants[want[use], 1].tolist(), ids[use].tolist(), score[use].tolist())


def _cells(batches, k: int, same: bool):
    """The walks of all groups that meet one block."""
    for t in runs(batches, ["block", "salt"]):
        rows = t.to_pylist()
        block = _Pack(rows[0])
        for r in rows[1:]:
            yield from _walked(block, _Pack(r), np.frombuffer(r["wants"], np.int64).reshape(-1, 5),
                               np.frombuffer(r["centre"]), r["angle"], k, same)


def _meet(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, cones: DataFrame) -> DataFrame:
    """One row per block and CELL_GROUPS of the groups it meets, followed by these groups, in cells (block, salt)."""
    salt = F.floor((F.row_number().over(Window.partitionBy("block").orderBy("grp")) - 1) / CELL_GROUPS).cast("int")
    pairs = materialize(pairs.select("grp", "block").withColumn("salt", salt))
    held = pairs.select("block", "salt").distinct().join(blocks, F.col("block") == F.col("key")).select(
        "block", "salt", F.lit(-1).cast("long").alias("grp"), "dim", "ids", "labels", "q", "lengths",
        F.lit(None).cast("binary").alias("wants"), F.lit(None).cast("binary").alias("centre"), F.lit(None).cast("double").alias("angle"))
    sent = pairs.join(asked, "grp").join(cones.select(F.col("key").alias("grp"), "centre", "angle"), "grp").select(
        "block", "salt", "grp", "dim", "ids", "labels", "q", "lengths", "wants", "centre", "angle")
    return held.unionByName(sent).repartition("block", "salt").sortWithinPartitions("block", "salt", "grp")


def _walk(anchors: DataFrame, wants: DataFrame, blocks: DataFrame, cones: DataFrame, lists: DataFrame, n_blocks: int,
          k: int, same: bool) -> DataFrame:
    """(anchor, t, vec_id, score, rank): the first ``k`` for each of ``wants`` (anchor, t, low, high)."""
    first = F.row_number().over(Window.partitionBy("anchor", "t").orderBy(F.desc("score"), "vec_id"))
    members = anchors.select(F.col("vec_id").alias("anchor"), F.col("key").alias("grp"), "label", "dim", "q", "length")
    state, walking = None, materialize(wants.withColumn("floor", F.col("low")))
    at, step = 0, max(FIRST_BLOCKS, n_blocks // 16)
    while True:
        bands = walking.groupBy("anchor").agg(F.collect_list(F.struct("t", "low", "high", "floor")).alias("bands"))
        near = members.join(bands, "anchor").repartition("grp").sortWithinPartitions("grp", "anchor")
        asked = materialize(map_rows(near.select("grp", "dim", "anchor", "label", "q", "length", "bands"), _asked,
                                     "grp long, dim int, ids binary, labels binary, q binary, lengths binary, wants binary"))
        pairs = lists.filter((F.col("place") > at) & (F.col("place") <= at + step)).join(asked.select("grp"), "grp")
        cells = _meet(pairs, asked, blocks, cones)
        found = map_rows(cells, lambda it: _cells(it, k, same), "anchor long, t int, vec_id long, score long")
        if state is not None:
            found = found.unionByName(state.drop("rank"))
        state = materialize(found.withColumn("rank", first).filter(F.col("rank") <= k))
        at, step = at + step, 2 * step
        # Who goes on: the next block's bound can still reach what the member lacks.
        behind = lists.filter(F.col("place") == at + 1).select("grp", "bound")
        kth = state.filter(F.col("rank") == k).select("anchor", "t", F.col("score").alias("kth"))
        left = (walking.drop("floor").join(kth, ["anchor", "t"], "left")
                       .withColumn("floor", F.greatest("low", F.coalesce("kth", "low"))).drop("kth")
                       .join(members.select("anchor", "grp", "length"), "anchor").join(behind, "grp")
                       .filter(F.col("length") * F.col("bound") >= F.col("floor")))
        walking = materialize(left.select(*wants.columns, "floor"))
        if walking.isEmpty():
            return state


def hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   band: tuple[int, int, int] = BAND, group_rows: int = GROUP_ROWS, block_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` come from ``whole_vectors``; ``is_anchor`` is a condition on
    them.  Scores are inner products; higher come first, ties by smaller id.
    An anchor's positives are its first other rows with its label; negatives
    are the first rows of other labels with low * positive score <= unit *
    score <= high * positive score for band = (low, high, unit).  Only rows
    of one dimension meet.  A vector of zeros scores 0 with all.  Without
    anchors, positives or negatives there are no rows.
    """
    spark = rows.sparkSession
    rows = materialize(rows)
    anchors = rows.filter(is_anchor)
    copies = Window.partitionBy("label", "q").orderBy("vec_id")
    candidates = materialize(rows.withColumn("copy", F.row_number().over(copies))
                                 .filter(F.col("copy") <= max(positives, negatives) + 1).drop("copy"))
    known = fetch_one(candidates, n=F.count(F.lit(1)), width=F.max("dim"))
    n_anchors, width = anchors.count(), max(known["width"] or 1, 1)
    centres = spark.sparkContext.broadcast(_centres(anchors, n_anchors))
    deep = block_rows or min(BLOCK_ROWS, max(LEAST_BLOCK, known["n"] // BLOCKS))
    grouped = materialize(_dealt(anchors, centres, max(1, min(group_rows, GROUP_BYTES // (4 * width)))))
    order = lambda df: df.repartition("key").sortWithinPartitions("key", "vec_id")
    cones = materialize(map_rows(order(grouped), _cones, "key long, dim int, members long, centre binary, angle double"))
    placed = _dealt(candidates, centres, max(1, min(deep, BLOCK_BYTES // (4 * width))))
    blocks = materialize(map_rows(order(placed), _blocks, _PACKED))
    lists = _lists(spark, cones, blocks)
    n_blocks = blocks.count()

    everything = grouped.select(F.col("vec_id").alias("anchor"), F.lit(0).alias("t"), lit_long(-_FAR).alias("low"), lit_long(_FAR).alias("high"))
    near = _walk(grouped, everything, blocks, cones, lists, n_blocks, positives, True)
    near = near.select("anchor", F.col("rank").alias("t"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    low, high, unit = band
    bands = near.filter("positive_score >= 0").select(
        "anchor", "t", F.expr(f"({low} * positive_score + {unit - 1}) div {unit}").alias("low"),
        F.expr(f"({high} * positive_score) div {unit}").alias("high"))
    far = _walk(grouped, bands.filter("low <= high"), blocks, cones, lists, n_blocks, negatives, False)
    return near.join(far, ["anchor", "t"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def mined(vectors: DataFrame, every: int = 100) -> DataFrame:
    """``hard_negatives`` of ``vectors`` (vec_id, label, embedding) for the anchors with a vec_id divisible by ``every``.

    Labels move on by one (of ten) where vec_id is divisible by 7.  Rows that
    take no part are named at ``whole_vectors``; an empty table gives no rows.
    """
    rows = whole_vectors(vectors)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % every == 0)


MINED_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score
               AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
