"""Mixing sources to target weights by systematic sampling.

Sources share the corpus by weight; a source's target never exceeds
``max_copies`` times its size, and what it cannot take goes to the others by
weight.  Inside a source every document has the same expected number of
copies, target / size.  The expected copies are summed along the documents
in order of size, one random offset per source is added, and a document is
emitted once per whole number that its share of the running sum crosses.
Neighbours in that order have nearly the same size, so the words taken stay
within about one document of the target.  Equal rows stand one after another
and are counted one by one.

The running sum is a rank times a rate; ranks come from range partitions
written once to the shared folder and one count per (partition, source), so
no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.hashing import pick
from parlance.plans.fixtures import sql_pick
from parlance.plans.ordering import materialize

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 17
# Offsets are multiples of 1/65536: rank * rate + offset stays exact for whole rates.
_GRAIN = 65536
_WORD = r"[^\x20\x09-\x0D]+"
# Copies of one row that a task writes.
_COPIES = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def row_mark(docs: DataFrame) -> Column:
    """A 64-bit hash of a whole row."""
    read = lambda c, kind: F.to_json(docs[c]) if "map<" in kind else docs[c]
    return F.xxhash64(*[read(c, kind) for c, kind in docs.dtypes])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null text: 0), mark (of the row) of every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text").cast("string")).alias("size"), row_mark(docs).alias("mark"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target: one row per source.

    With sources in order of (cap / weight), the common level is the largest
    of (total - caps of a prefix) / (weights of the rest); a source gets
    level * weight or its cap, whichever is smaller.  The windows run over
    one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), turn + 1)
    per = per.select("source", "source_size", w.alias("w"), (F.col("source_size") * max_copies).alias("cap"))
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("_level", rest[0].cast("double") / rest[1].cast("double"))
    level = F.max("_level").over(everything)
    return per.select("source", "source_size",
                      F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"))


def _ranks(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``, the 0-based place inside the source by (size, doc_id, mark).

    Equal rows are told apart by where they were written, so that they too
    are dealt to several range partitions.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("_at")]
    placed = materialize(sizes.withColumn("_at", F.monotonically_increasing_id()))
    placed = materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_at")
                               .withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_m"), 33)
    runs = placed.groupBy(part.alias("_p"), F.col("source").alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    earlier = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_p", "_s", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return (placed.join(runs, (part == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
                  .select("doc_id", "source", "size", "mark", (F.col("_off") + F.col("_m") - F.col("_first")).alias("rank")))


def mix_plan(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, mark, source_size, target, copies: one row per row of ``sizes``."""
    ranked = _ranks(sizes)
    targets = source_targets(ranked, weights, max_copies).withColumnRenamed("source", "_src")
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_src")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    offset = pick(_GRAIN, seed, name).cast("double") / F.lit(float(_GRAIN))
    crossed = F.floor((F.col("rank") + 1) * rate + offset) - F.floor(F.col("rank") * rate + offset)
    return joined.select("doc_id", "source", "size", "mark", "source_size", "target", crossed.cast("long").alias("copies"))


def mixture(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source).

    ``taken`` is copies * size.  A null or blank text has size 0 and takes no
    words.  A null source is a source of its own, after all others.  Equal
    rows count one by one, in sizes, targets and the running sum; which of
    them is taken does not matter.  An empty table gives no rows.
    """
    plan = mix_plan(sized(docs), weights, max_copies, seed)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it.

    Rows are known by doc_id and a hash of the whole row.  Of equal rows one
    stands for all and is written as often as they are taken together, by
    tasks of a bounded number of copies.
    """
    plan = mix_plan(sized(docs), weights, max_copies, seed)
    plan = materialize(plan.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_copies")).filter("_copies > 0"))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_doc"),
                       row_mark(docs).alias("_own"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark"))
    out = (held.join(plan.filter("_rows = 1"), same)
               .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*"))
    repeated = plan.filter("_rows > 1")
    if repeated.isEmpty():
        return out
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / _COPIES))
    each = (held.join(repeated, same).dropDuplicates(["_doc", "_own"])
                .select("_row", "_doc", "_own", "_copies", F.explode(parts).alias("_part")).repartition("_doc", "_own", "_part"))
    more = each.select("_row", F.explode(F.sequence(F.col("_part") * _COPIES + 1,
                                                    F.least(F.col("_copies"), (F.col("_part") + 1) * _COPIES))))
    return out.unionByName(more.select("_row.*"))


MIXTURE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
  FROM d GROUP BY source),
weighed AS (SELECT source, source_size, [{', '.join(map(str, WEIGHTS))}][turn % {len(WEIGHTS)} + 1] AS w,
                   {MAX_COPIES} * source_size AS cap FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER f, 0))::DOUBLE
            / ((sum(w) OVER ()) - coalesce(sum(w) OVER f, 0))::DOUBLE AS lv
  FROM weighed WINDOW f AS (ORDER BY cap::DOUBLE / w, source NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (max(lv) OVER ()) * w) AS target FROM levels),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         {sql_pick(str(_GRAIN), f"'{SEED}'", "coalesce('s' || d.source, 'n')")}::DOUBLE / {_GRAIN}.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (floor((i + 1) * rate + u) - floor(i * rate + u))::BIGINT * size AS taken
FROM r
"""
