"""Near-duplicate vectors by int8 tile products with quantisation bounds.

Equal vectors fall into one class first.  Every class vector is scaled to
length 1 and rounded to int8 once; the length of what rounding took away is
kept with it.  Classes are dealt into stripes of bounded size by the pivot
nearest to them, and a stripe knows the least and largest angle of its
vectors to every pivot.  Two vectors within the angle t of each other differ
by at most t in their angle to any pivot, so two stripes whose ranges for
some pivot lie further apart cannot hold a link and never meet.  The others
meet in one task a pair, and tiles of int8 codes are multiplied (exactly: the
sums fit a float).  The product and the two rounding lengths bound the cosine
from above; only pairs whose bound reaches the threshold are computed again
in double precision.  A task returns one count per linked vector and a
spanning forest of its links, never the pairs.

On vectors that gather around directions, the pivots leave each stripe few
partners.  On vectors that spread evenly over many dimensions no pivot rules
a pair of stripes out: then every stripe is sent to every other, and traffic
and products grow with the square of the distinct vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.arrow import map_batches, map_rows, runs
from parlance.llm.components import connected_components
from parlance.plans.ordering import materialize

COSINE = 0.95
STRIPE_BYTES = 4 << 20
TILE = 1024
# Sums of this many products of two int8 codes are exact in single precision.
_EXACT_DIMS = (1 << 24) // (127 * 127)
_RECOMPUTE = 1 << 16
_SLACK = 1e-9
# Pivots are chosen from at most this many vectors and bytes; they set who meets, not what is linked.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_PIVOTS = 2048, 16 << 20, 128
LEAST_STRIPE = 256
# Stripe ranges that are sent to the tasks at a time.
RANGE_BYTES = 32 << 20
# What rounding can take from an angle, with room to spare.
_ANGLE_SLACK = 1e-6


def quantise(v: np.ndarray) -> tuple[bytes, float, float]:
    """(int8 codes, step, length of the rounding error) of a vector scaled to length 1."""
    u = v / np.linalg.norm(v)
    step = float(np.abs(u).max()) / 127
    q = np.rint(u / step).astype(np.int8)
    return q.tobytes(), step, float(np.linalg.norm(u - step * q)) + _SLACK


def _keyed(batches):
    """vec_id, key, dim, vector bytes, codes, step, error; all null for a vector that links with nothing."""
    for batch in batches:
        for vec, values in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = None
            if vec is not None and values.is_valid and len(values.values) and not values.values.null_count:
                v = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                with np.errstate(over="ignore"):
                    length = float(np.dot(v, v))
                if not (np.isfinite(v).all() and 0 < length < np.inf):
                    v = _rescaled(v)
            if v is None:
                yield vec, None, None, None, None, None, None
            else:
                yield (vec, hashlib.blake2b(v.tobytes(), digest_size=16).digest(), len(v), v.tobytes(), *quantise(v))


def _rescaled(v: np.ndarray) -> np.ndarray | None:
    """A finite non-zero vector whose squared length leaves the range of doubles, scaled by its largest component."""
    top = float(np.abs(v).max()) if np.isfinite(v).all() else 0.0
    return v / top if top > 0 else None


_KEYED = "vec_id long, key binary, dim int, vector binary, codes binary, step double, error double"


class _Side:
    """The vectors of one stripe."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.copies = np.frombuffer(row["copies"], np.int64)
        n, dim = len(self.ids), row["dim"]
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, dim)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        self.step = np.frombuffer(row["steps"], np.float64)
        self.error = np.frombuffer(row["errors"], np.float64)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))

    def __len__(self):
        return len(self.ids)


def pivots(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` of the unit rows of ``x``, each as far as can be from those before."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _chosen_pivots(classes: DataFrame, sizes: list, rows_of) -> dict[int, np.ndarray]:
    """Pivots per dimension, as many as there are full stripes, from a bounded sample of ``classes``."""
    widest = max((r["dim"] for r in sizes), default=1)
    rows = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * widest)))
    sample = classes.select("dim", "key", "vector").orderBy("key").limit(rows).collect()
    out = {}
    count = {r["dim"]: r["n"] for r in sizes}
    for dim in {r["dim"] for r in sample}:
        x = np.array([np.frombuffer(r["vector"]) for r in sample if r["dim"] == dim])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        out[dim] = pivots(x, min(MOST_PIVOTS, -(-count[dim] // rows_of(dim))))
    return out


def _nearest(batches, centres):
    for batch in batches:
        names = batch.schema.names
        dims, vectors = batch.column(names.index("dim")).to_pylist(), batch.column(names.index("vector"))
        near = [int((centres.value[d] @ np.frombuffer(v.as_py())).argmax()) if d in centres.value else 0 for d, v in zip(dims, vectors)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*names, "pivot"])


def _packed(batches, centres):
    """One row per stripe: its vectors and the range of their angles to every pivot."""
    for t in runs(batches, ["stripe"]):
        dim = t.column("dim")[0].as_py()
        joined = lambda name: b"".join(t.column(name).to_pylist())
        x = np.frombuffer(joined("vector")).reshape(t.num_rows, dim)
        angles = np.zeros((t.num_rows, 0))
        if dim in centres.value:
            cosine = x @ centres.value[dim].T / np.linalg.norm(x, axis=1)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1))
        numbers = lambda name, kind: t.column(name).to_numpy().astype(kind).tobytes()
        yield (t.column("stripe")[0].as_py(), dim, numbers("node", np.int64), numbers("copies", np.int64), joined("codes"),
               x.tobytes(), numbers("step", np.float64), numbers("error", np.float64),
               angles.min(0).tobytes(), angles.max(0).tobytes())


_STRIPE = ("stripe long, dim int, ids binary, copies binary, codes binary, vectors binary, steps binary, errors binary, "
           "low binary, high binary")


def _partners(batches, ranges, reach: float):
    """(i, j), i <= j: pairs of stripes that no pivot keeps apart."""
    for batch in batches:
        for row in batch.to_pylist():
            others, low, high = ranges.value.get(row["dim"], ((), None, None))
            if not len(others):
                continue
            gap = np.maximum(np.frombuffer(row["low"]) - high, low - np.frombuffer(row["high"]))
            near = gap.max(1, initial=0.0) <= reach
            yield from ((row["stripe"], int(o)) for o in others[near & (others >= row["stripe"])])


def _meetings(spark, stripes: DataFrame, cosine: float) -> DataFrame:
    """Pairs of stripes that may hold a link; the ranges are held against all stripes in parts of bounded size."""
    narrow = materialize(stripes.select("stripe", "dim", "low", "high"))
    size = narrow.agg(F.sum(F.octet_length("low") + F.octet_length("high") + 64).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // RANGE_BYTES))
    reach, out = float(np.arccos(np.clip(cosine, -1, 1))) + _ANGLE_SLACK, None
    for i in range(parts):
        held = narrow.filter(F.pmod(F.xxhash64("stripe"), F.lit(parts)) == i).collect()
        by_dim = {}
        for dim in {r["dim"] for r in held}:
            own = [r for r in held if r["dim"] == dim]
            by_dim[dim] = (np.array([r["stripe"] for r in own]), np.array([np.frombuffer(r["low"]) for r in own]),
                           np.array([np.frombuffer(r["high"]) for r in own]))
        sent = spark.sparkContext.broadcast(by_dim)
        found = map_rows(narrow, lambda it, sent=sent: _partners(it, sent, reach), "i long, j long")
        out = found if out is None else out.unionByName(found)
    return materialize(out)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    if a.shape[1] <= _EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return a.astype(np.float64) @ b.astype(np.float64).T


def _tile_links(x: _Side, y: _Side, i0: int, j0: int, same: bool, cosine: float):
    """Confirmed links (row of x, row of y) of one tile."""
    i1, j1 = min(i0 + TILE, len(x)), min(j0 + TILE, len(y))
    p = _product(x.codes[i0:i1], y.codes[j0:j1])
    sx, sy, ex, ey = x.step[i0:i1], y.step[j0:j1], x.error[i0:i1], y.error[j0:j1]
    # A rounded vector is no longer than 1 + its error.  First a bound per row, then per pair.
    spare = (1 + ex) * ey.max() + (1 + ey.max()) * ex + ex * ey.max()
    rough = (cosine - spare - _SLACK) / (sx * (sy.max() if cosine - spare.max() > 0 else sy.min()))
    i, j = np.nonzero(p >= rough[:, None]) if cosine - spare.max() > 0 else np.nonzero(np.ones(p.shape, bool))
    if same and i0 == j0:
        i, j = i[i < j], j[i < j]
    bound = sx[i] * sy[j] * p[i, j] + (1 + ex[i]) * ey[j] + (1 + ey[j]) * ex[i] + ex[i] * ey[j]
    able = bound >= cosine - _SLACK
    i, j = i[able] + i0, j[able] + j0
    keep = np.zeros(len(i), bool)
    for c in range(0, len(i), _RECOMPUTE):
        a, b = i[c:c + _RECOMPUTE], j[c:c + _RECOMPUTE]
        keep[c:c + _RECOMPUTE] = np.einsum("ij,ij->i", x.vectors[a], y.vectors[b]) / (x.length[a] * y.length[b]) >= cosine
    return i[keep], j[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected index of each of ``n`` indices linked by ``a`` - ``b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _stripe_links(batches, cosine: float):
    """(a, b, n): link counts of a as (a, null, n), forest links as (a, b, null)."""
    for t in runs(batches, ["i", "j"]):
        rows = t.to_pylist()
        same = len(rows) == 1
        x = _Side(rows[0])
        y = x if same else _Side(rows[1])
        ids = x.ids if same else np.concatenate([x.ids, y.ids])
        shift = 0 if same else len(x)
        count = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        for i0 in range(0, len(x), TILE):
            for j0 in range(i0 if same else 0, len(y), TILE):
                i, j = _tile_links(x, y, i0, j0, same, cosine)
                if len(i):
                    np.add.at(count, i, y.copies[j])
                    np.add.at(count, j + shift, x.copies[i])
                    own = np.flatnonzero(label != np.arange(len(label)))
                    label = forest(len(ids), np.concatenate([i, own]), np.concatenate([j + shift, label[own]]))
        for k in np.flatnonzero(count):
            yield int(ids[k]), None, int(count[k])
        for k in np.flatnonzero(label != np.arange(len(label))):
            yield int(ids[k]), int(ids[label[k]]), None


def near_vectors(vectors: DataFrame, cosine: float = COSINE, stripe_bytes: int = STRIPE_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Rows are linked if their cosine in double precision is at least ``cosine``
    (above 0) and their embeddings have the same number of components.  A null, empty or
    zero embedding, one with a null or non-finite component, and a row with
    a null vec_id link with nothing (component_id is then vec_id).  Repeated
    rows are linked like any other copies; each gets its row.  An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    base = materialize(map_rows(vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                                               F.col("embedding").cast("array<double>").alias("embedding")),
                                _keyed, _KEYED))
    classes = base.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"),
        F.first("vector").alias("vector"), F.first("codes").alias("codes"), F.first("step").alias("step"),
        F.first("error").alias("error"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    # Small tables make stripes enough for all cores; the pairs of m stripes are m (m + 1) / 2.
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    total = classes.count()
    spread = -(-total // max(1, int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))))
    rows_of = lambda dim: max(1, min(stripe_bytes // (8 * max(dim, 1)), max(LEAST_STRIPE, spread)))
    seen = sizes.orderBy(F.desc("n"), "dim").limit(SAMPLE_ROWS).collect()
    centres = spark.sparkContext.broadcast(_chosen_pivots(classes, seen, rows_of) if total else {})
    near = materialize(map_batches(classes.select("dim", "node", "copies", "vector", "codes", "step", "error"),
                                   lambda it: _nearest(it, centres),
                                   "dim int, node long, copies long, vector binary, codes binary, step double, error double, pivot int"))
    full = F.greatest(F.lit(1), F.least(F.floor(F.lit(stripe_bytes) / (8 * F.greatest("dim", F.lit(1)))),
                                        F.lit(max(LEAST_STRIPE, spread))))
    cells = materialize(near.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / full).cast("long").alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    stripe = F.shiftleft(F.col("dim").cast("long"), 40) + F.shiftleft(F.col("pivot").cast("long"), 24) + part
    dealt = near.join(cells, ["dim", "pivot"]).withColumn("stripe", stripe).drop("pivot", "parts")
    stripes = materialize(map_rows(dealt.repartition("stripe").sortWithinPartitions("stripe", "node"),
                                   lambda it: _packed(it, centres), _STRIPE))
    pairs = _meetings(spark, stripes, cosine)
    held = stripes.drop("low", "high")
    sides = [pairs.select("i", "j", F.lit(0).alias("side"), F.col("i").alias("stripe")).join(held, "stripe"),
             pairs.filter("i < j").select("i", "j", F.lit(1).alias("side"), F.col("j").alias("stripe")).join(held, "stripe")]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(pairs.count(), 16 * spark.sparkContext.defaultParallelism))
    met = sides[0].unionByName(sides[1]).repartition(n, "i", "j").sortWithinPartitions("i", "j", "side")
    found = materialize(map_rows(met, lambda it: _stripe_links(it, cosine), "a long, b long, n long"))
    linked = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("more"))
    parts = connected_components(found.filter("b is not null"), "a", "b")
    rooted = (classes.select("key", "rep", "node", "copies").join(linked.withColumnRenamed("a", "node"), "node", "left")
                     .join(parts, "node", "left")
                     .select("key", "rep", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
                             F.coalesce("component", "node").alias("component")))
    named = rooted.join(rooted.groupBy("component").agg(F.min("rep").alias("component_id")), "component").drop(
        "component", "rep")
    return (base.select("vec_id", "key").join(named, "key", "left")
                .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                        F.coalesce("component_id", "vec_id").alias("component_id"))
                .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
