"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

1. Every text becomes the set of its five-word shingles (64-bit hashes) and
   keeps the ``k`` smallest as its sketch.  Texts with equal sets fall into
   one class first, so exact copies cost one row each from here on.
2. Inverted lists map a retained value to the classes that hold it.  Two
   sets at the threshold share at least ``min_shared`` of their retained
   values (for sets that fit into the sketch by arithmetic, for larger ones
   with the error stated at ``MIN_SHARED``), so a list only takes the
   ``k - min_shared + 1`` rarest values of each sketch: a passage that many
   texts repeat does not make a list of them all.
3. Each list names its most central member as leader.  Membership
   (leader, member) is one row per pair whatever the number of shared lists:
   two similar sets share a list and therefore a leader.
4. The members of a leader meet in blocks of bounded size, each with the
   leader: the sketch of the union of two sets estimates their similarity,
   whole sets confirm it.  Members of a large group that are not connected
   with its leader by then (strays) are dealt into blocks of their own; these
   meet one another and the blocks of the others.  A group without strays
   sends nothing more, and the others' work grows with their number of stray
   blocks.  A block returns a spanning forest of its links, never all pairs.
5. Connected components over the class graph; copies join by their class.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.arrow import map_rows, runs
from parlance.llm.components import connected_components
from parlance.llm.mixing import row_mark
from parlance.llm.prefilter import bit_pages, marked
from parlance.llm.words import row_slices, shingles, string_buffers, word_hashes
from parlance.plans.ordering import broadcast_if_small, materialize

SIMILARITY = (75, 100)
SHINGLE_WORDS = 5
SKETCH = 32
# Two sets of similarity 0.75 share fewer than 10 of 32 retained values with a
# probability below 1e-6 (binomial tail at 0.75; smaller above the threshold).
MIN_SHARED = 10
BLOCK_ROWS = 256
BLOCK_SHINGLES = 400_000
# Values of the union of two sets that estimate their similarity, and the probability with which the
# estimate may rule out a pair at the threshold (less above it).
UNION_SKETCH = 64
UNION_LOSS = 1e-6
# Pairs estimated at once, and bytes of text hashed at once: a worker needs some 20 MB for either.
_ESTIMATED_PAIRS = 1 << 12
_HASHED_BYTES = 1 << 18

_LAST = np.uint64((1 << 64) - 1)
_SETS = "doc_id long, n_shingles long, digest binary, sketch array<long>, text_mark long"


def _sets_of(batch: pa.RecordBatch, size: int):
    """(row, sorted shingle hashes) of a batch with columns doc_id, text."""
    for part in row_slices(batch, "text", _HASHED_BYTES):
        data, offsets = string_buffers(part.column(1))
        starts, hashes = word_hashes(data, offsets)
        cut = np.searchsorted(starts, offsets)
        ids = part.column(0).to_pylist()
        for i, doc in enumerate(ids):
            yield doc, shingles(hashes[cut[i]:cut[i + 1]], size)


def text_mark(text: Column) -> Column:
    """A 64-bit hash that tells apart the texts of rows with one doc_id."""
    return F.xxhash64(text.cast("string"))


def sketches(docs: DataFrame, k: int = SKETCH, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), sketch (its k smallest values), text_mark per row of ``docs``."""
    def rows(batches):
        for batch in batches:
            marks = batch.column(2).to_pylist()
            for (doc, s), mark in zip(_sets_of(batch, size), marks):
                yield (doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                       s[:k].view(np.int64).tolist(), mark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         text_mark(F.col("text")).alias("text_mark"))
    return map_rows(narrow, rows, _SETS)


def _memberships(classes: DataFrame, k: int, shared: int, num: int, den: int) -> DataFrame:
    """(leader, member) pairs: members of one inverted list with the list's most central member."""
    entries = classes.select("node", F.least(F.col("n"), F.lit(k)).alias("kept"), F.explode("sketch").alias("value"))
    often = (entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    common = materialize(entries.join(often, "value"))
    by_rep = Window.partitionBy("node")
    # Overlap that similar sets have at least; a set within the sketch is known whole.
    least = F.least(F.lit(shared), F.ceil(F.lit(num) * F.col("kept") / F.lit(den))).cast("long")
    ranked = common.select(
        "node", "value", "kept", "df",
        F.row_number().over(by_rep.orderBy("df", "value")).alias("rank"),
        F.count(F.lit(1)).over(by_rep).alias("n_common"),
        (F.sum(F.col("df") - 1).over(by_rep) / F.col("kept")).alias("central"))
    prefix = ranked.filter(F.col("kept") - F.col("n_common") + F.col("rank") <= F.col("kept") - least + 1)
    prefix = materialize(prefix.select("node", "value", "central"))
    # Smallest (-central, node) of a list leads it.
    lead = (prefix.groupBy("value").agg(F.min(F.struct((-F.col("central")).alias("c"), "node")).alias("l"),
                                        F.count(F.lit(1)).alias("size"))
                  .filter("size > 1").select("value", F.col("l.node").alias("leader")))
    pairs = prefix.join(lead, "value").select("leader", F.col("node").alias("member")).distinct()
    return materialize(pairs)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections between the sets of ``a`` and ``b`` (or of ``a`` itself)."""
    both = a if b is None else a + b
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    if not len(row):
        return np.zeros((len(a), len(a if b is None else b)), np.int64)
    values, inv, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    use = count[inv] > 1
    row, col = row[use], (np.cumsum(count > 1) - 1)[inv[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width, n = int((count > 1).sum()), len(both)
    out = np.zeros((len(a), len(a) if b is None else len(b)), np.float64)
    step = max(256, (4 << 20) // max(n, 1))
    for c in range(0, width, step):
        i, j = np.searchsorted(col, [c, c + step])
        m = np.zeros((n, min(step, width - c)), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        left = m[:len(a)]
        out += left @ (left if b is None else m[len(a):]).T
    return out.astype(np.int64)


@lru_cache(maxsize=1024)
def _floor(size: int, num: int, den: int) -> int:
    """The least shared values among ``size`` of a union that do not rule out the similarity num / den.

    Below it the binomial tail at the threshold stays under UNION_LOSS; drawing
    without replacement, as a sketch does, has a lighter tail still.
    """
    share, tail, c = num / den, 0.0, 0
    while c < size:
        tail += comb(size, c) * share ** c * (1 - share) ** (size - c)
        if tail > UNION_LOSS:
            break
        c += 1
    return c


def _union_shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (a[i], b[j]) of sorted sets: size of the sketch of the union, and how many of its values are in both.

    The k smallest values of two sets' k smallest are the k smallest of their
    union: a uniform sample of it.
    """
    def padded(sets):
        out = np.full((len(sets), k), _LAST, np.uint64)
        for r, s in enumerate(sets):
            out[r, :min(k, len(s))] = s[:k]
        return out
    pa = padded(a)
    pb = pa if b is a else padded(b)
    size, shared = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for c in range(0, len(i), _ESTIMATED_PAIRS):
        x = np.sort(np.concatenate([pa[i[c:c + _ESTIMATED_PAIRS]], pb[j[c:c + _ESTIMATED_PAIRS]]], 1), axis=1)
        real = x != _LAST
        again = np.zeros(x.shape, bool)
        again[:, 1:] = (x[:, 1:] == x[:, :-1]) & real[:, 1:]
        place = np.cumsum(real & ~again, axis=1)
        size[c:c + _ESTIMATED_PAIRS] = np.minimum(place[:, -1], k)
        shared[c:c + _ESTIMATED_PAIRS] = (again & (place <= k)).sum(1)
    return size, shared


def _estimate_allows(a: list[np.ndarray], b: list[np.ndarray] | None, apart: np.ndarray, num: int, den: int,
                     k: int = UNION_SKETCH) -> np.ndarray:
    """Which pairs of ``apart`` the sizes of the sets and the sketch of their union leave possible.

    All shared values of the two sketches bound those in the union's sketch;
    so only pairs that this lets through have the union's sketch formed.
    """
    na = np.array([len(s) for s in a])
    nb = na if b is None else np.array([len(s) for s in b])
    low, high = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
    # The sketch of the union holds at least as many values as the larger of the two.
    floors = np.array([_floor(n, num, den) for n in range(k + 1)])
    possible = apart & (low > 0) & (den * low >= num * high)
    possible &= _overlaps([s[:k] for s in a], None if b is None else [s[:k] for s in b]) >= floors[np.minimum(k, high)]
    i, j = np.nonzero(possible)
    size, shared = _union_shared(a, a if b is None else b, i, j, k)
    possible[i, j] = shared >= floors[size]
    return possible


def _links(a: list[np.ndarray], b: list[np.ndarray] | None, apart: np.ndarray, num: int, den: int):
    """Index pairs of confirmed links among pairs marked in ``apart``."""
    possible = _estimate_allows(a, b, apart, num, den)
    if not possible.any():
        return np.zeros((0, 2), np.int64)
    ia, ib = np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))
    if b is None:
        ia = ib = np.union1d(ia, ib)
    sub_a = [a[i] for i in ia]
    sub_b = None if b is None else [b[i] for i in ib]
    inter = _overlaps(sub_a, sub_b)
    na = np.array([len(s) for s in sub_a])
    nb = na if sub_b is None else np.array([len(s) for s in sub_b])
    union = na[:, None] + nb[None, :] - inter
    hit = (den * inter >= num * union) & possible[np.ix_(ia, ib)]
    i, j = np.nonzero(hit)
    return np.stack([ia[i], ib[j]], 1)


def spanning(pairs) -> list[tuple]:
    """A spanning forest of the graph given by ``pairs`` of hashable ends."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _with_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` with their shingles; few members go to the sets, so that the sets are not shuffled for this."""
    members = materialize(members)
    members = broadcast_if_small(members, members.count())
    return sets.join(members, sets["node"] == members["member"]).drop("node")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the whole set of each wanted class (rep, digest, node, copies), from its first document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = materialize(wanted)
    # Texts without a wanted class are left out before the shuffle.
    n = wanted.count()
    pages, bits = bit_pages(wanted, F.col("rep"), n)
    narrow = marked(narrow, F.col("doc_id"), materialize(pages), bits, "_may").filter("_may").drop("_may")
    wanted = broadcast_if_small(wanted, n)
    texts = narrow.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")

    def rows(batches):
        for batch in batches:
            marks, nodes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (_, s) in enumerate(_sets_of(batch.select([0, 1]), size)):
                # One doc_id may stand on several texts.
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == marks[i]:
                    yield nodes[i], s.tobytes()
    found = lambda cond: map_rows(texts.filter(cond).select("doc_id", "text", "digest", "node"), rows,
                                  "node long, shingles binary")
    # A class of one row is found once; only classes of several may have been found on equal rows of one document.
    return found("copies = 1").unionByName(found("copies > 1").dropDuplicates(["node"]))


def _block_edges(batches, num: int, den: int):
    """Spanning links inside each (leader, block)."""
    for t in runs(batches, ["leader", "block"]):
        ids = t.column("member").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        apart = np.triu(np.ones((len(ids), len(ids)), bool), 1)
        found = _links(sets, None, apart, num, den)
        yield from spanning((ids[i], ids[j]) for i, j in found)


def _cross_edges(batches, num: int, den: int):
    """Spanning links among unconnected members of each (leader, lo, hi): between its sides, or inside it if lo = hi."""
    for t in runs(batches, ["leader", "lo", "hi"]):
        ids = t.column("member").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        side = np.array(t.column("side").to_pylist())
        label = np.array(t.column("label").to_pylist())
        i0, i1 = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if t.column("lo")[0] == t.column("hi")[0]:
            apart = np.triu(label[:, None] != label[None, :], 1)
            found = _links(sets, None, apart, num, den)
            yield from spanning((ids[i], ids[j]) for i, j in found)
        elif len(i0) and len(i1):
            apart = label[i0][:, None] != label[i1][None, :]
            found = _links([sets[i] for i in i0], [sets[i] for i in i1], apart, num, den)
            yield from spanning((ids[i0[i]], ids[i1[j]]) for i, j in found)


def _meetings(state: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """(leader, lo, hi, side, member, label): who meets whom once blocks are done.

    ``state`` has leader, member, n, block, blocks and label of the members of
    groups of several blocks.  Strays, whose label is not their leader's, are
    dealt into blocks 0, 1, ... of their own; block b of the others has the
    number b behind these.  Groups without strays have no rows.
    """
    home = state.filter("member = leader").select("leader", F.col("label").alias("home"))
    state = state.join(home, "leader").withColumn("stray", F.col("label") != F.col("home"))
    # A few rows per large group, written apart: joins on a hot leader can broadcast or split.
    dealt = materialize(state.filter("stray").groupBy("leader").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("strays")))
    state = state.join(dealt, "leader")
    own = F.when(F.col("stray"), F.pmod(F.xxhash64("member"), F.col("strays")).cast("int")).otherwise(F.col("strays") + F.col("block"))
    others = F.when(F.col("stray"), F.sequence(F.lit(0), F.col("strays") + F.col("blocks") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("strays") - 1))
    each = state.select("leader", "member", "label", own.alias("own"), F.explode(others).alias("other"))
    return each.select("leader", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"), "member", "label")


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of the components ``labels`` once ``edges`` link some of them and some single nodes."""
    ends = edges
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        ends = ends.join(named, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    linked = materialize(connected_components(ends, "_a", "_b"))
    moved = linked.withColumnRenamed("component", "_to").withColumnRenamed("node", "component")
    single = linked.join(labels.select("node"), "node", "left_anti")
    return (labels.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
                  .unionByName(single.select("node", "component")))


def _across(wide: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int, block_rows: int,
            block_shingles: int) -> DataFrame:
    """``labels`` (node, component) once the strays of the groups ``wide`` have met the other blocks."""
    state = wide.join(labels.withColumnRenamed("node", "member"), "member", "left")
    state = materialize(state.withColumn("label", F.coalesce("component", "member")).drop("component"))
    met = _with_sets(_meetings(state, block_rows, block_shingles), sets)
    edges = materialize(map_rows(
        met.repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi", "side", "member"),
        lambda it: _cross_edges(it, num, den), "a long, b long"))
    return labels if edges.isEmpty() else _joined(labels, edges)


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, k: int = SKETCH,
                    min_shared: int = MIN_SHARED, size: int = SHINGLE_WORDS,
                    block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_shingles, component_id, kept, text_mark, one row per input row.
    Rows are linked if den * |intersection| >= num * |union| of their shingle
    sets; ``component_id`` is the smallest doc_id reachable, ``kept`` marks
    that document.  A null, empty or blank text has an empty set and links
    with nothing; so does a row without doc_id, which is kept with a null
    component.  Equal rows get equal results.  An empty table gives no rows.
    """
    num, den = similarity
    base = materialize(sketches(docs, k, size))
    usable = base.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = usable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    members = _memberships(classes, k, min_shared, num, den)
    wanted = classes.select("rep", "digest", "node", "copies").join(
        members.select(F.col("member").alias("node")).distinct(), "node", "left_semi")
    sets = materialize(_sets(docs, wanted.select("rep", "digest", "node", "copies"), size))

    sized = members.join(classes.select(F.col("node").alias("member"), "n"), "member")
    groups = sized.groupBy("leader").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
    groups = groups.select("leader", F.greatest(F.ceil(F.col("rows") / block_rows),
                                                F.ceil(F.col("total") / block_shingles)).cast("int").alias("blocks"))
    # Written apart, the few large groups are a table that a join on a hot leader can broadcast or split.
    large = materialize(groups.filter("blocks > 1"))
    placed = materialize(sized.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select(
        "leader", "member", "n", "blocks", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block")))

    # The leader stands in every block of its group.
    others = placed.filter("member != leader").select("leader", "block", "member")
    leaders = placed.filter("member = leader").select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "member")
    inside = _with_sets(others.unionByName(leaders), sets)
    edges = "a long, b long"
    first = materialize(map_rows(
        inside.repartition("leader", "block").sortWithinPartitions("leader", "block", "member"),
        lambda it: _block_edges(it, num, den), edges))
    labels = materialize(connected_components(first, "a", "b"))

    final = labels if large.isEmpty() else _across(placed.filter("blocks > 1"), labels, sets, num, den, block_rows, block_shingles)

    # Roots of the linked classes only, written apart: a large component meets one row of a small table.
    linked = materialize(classes.select("rep", "node").join(final, "node"))
    least = materialize(linked.groupBy("component").agg(F.min("rep").alias("least")))
    roots = linked.join(least, "component").select("node", F.col("least").alias("_root"))
    named = classes.select("digest", "rep", "node").join(roots, "node", "left").select(
        "digest", F.coalesce("_root", "rep").alias("root"))
    return (base.select("doc_id", "n_shingles", "digest", "text_mark").join(named, "digest", "left")
                .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id"))
                        .otherwise(F.col("doc_id")).alias("component_id"), "text_mark")
                .select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_mark"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, each (doc_id, text) once.

    Rows of one doc_id with different texts are told apart by their texts; of
    those with one text the row with the least hash stays, whatever the run.
    """
    found = materialize(near_duplicates(docs, **options).select("doc_id", "text_mark", "kept"))
    chosen = materialize(found.filter("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark"))
                              .agg(F.count(F.lit(1)).alias("_rows")))
    # Most ids have one row, and it stays: only those that may be among the others are joined.
    other = found.filter("not kept").select(F.col("doc_id").alias("_id")).unionByName(chosen.filter("_rows > 1").select("_id"))
    other = materialize(other.distinct())
    pages, bits = bit_pages(other, F.col("_id"), other.count())
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_doc"),
                       text_mark(docs["text"]).alias("_own"), row_mark(docs).alias("_whole"))
    held = marked(held, F.col("_doc"), materialize(pages), bits, "_may")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark"))
    out = held.filter("not _may").select("_row.*").unionByName(
        held.filter("_may").join(chosen.filter("_rows = 1"), same, "left_semi").select("_row.*"))
    again = chosen.filter("_rows > 1")
    if again.isEmpty():
        return out
    first = held.filter("_may").join(again, same, "left_semi").groupBy("_doc", "_own").agg(F.min_by("_row", "_whole").alias("_row"))
    return out.unionByName(first.select("_row.*"))
