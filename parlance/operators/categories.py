"""Task-2 spans: one row per annotated span -> one row per paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.plans.ordering import fetch_one

SPAN_KEY = ("par_id", "art_id", "text", "keyword", "country")


def category_id(category, names, strict: bool = True) -> Column:
    """Name -> id through a literal map; unknown names fail the job when strict."""
    c = F.col(category) if isinstance(category, str) else category
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    cid = m[c]
    if strict:
        cid = F.coalesce(cid, F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(c, F.lit("NULL")))))
    return cid.cast("int")


def span_to_multihot(spans: DataFrame, num_classes: int, cid: str = "category_id",
                     keys=SPAN_KEY) -> DataFrame:
    """keys..., n_spans, label ARRAY<INT> (fixed width ``num_classes``).

    One aggregate with a max() per class: partial aggregation applies and
    no list of spans is ever gathered.
    """
    flags = [F.max(F.when(F.col(cid) == c, 1).otherwise(0)).alias(f"_c{c}") for c in range(num_classes)]
    agg = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spans"), *flags)
    return agg.select(*keys, "n_spans", F.array(*[F.col(f"_c{c}") for c in range(num_classes)]).alias("label"))


WORD_BITS = 32


def span_to_bitmap(spans: DataFrame, cid: str = "category_id", keys=SPAN_KEY) -> DataFrame:
    """keys..., n_spans, bits MAP<INT, BIGINT>: the classes of each key as words of WORD_BITS bits, by number of the word.

    Any number of classes is one expression: a bit is set by ``bit_or`` per
    (key, word), so a task sends at most one row per key and word, and only
    words with a class are held.  A null class counts as a span without one.
    """
    word = F.coalesce(F.floor(F.col(cid) / WORD_BITS), F.lit(-1)).cast("int")
    bit = F.when(F.col(cid).isNotNull(), F.expr(f"shiftleft(1L, cast(pmod({cid}, {WORD_BITS}) as int))"))
    per = spans.select(*keys, word.alias("_w"), bit.alias("_b")).groupBy(*keys, "_w").agg(
        F.bit_or("_b").alias("_b"), F.count(F.lit(1)).alias("_n"))
    held = F.filter(F.collect_list(F.struct("_w", "_b")), lambda e: e["_w"] >= 0)
    return per.groupBy(*keys).agg(F.sum("_n").alias("n_spans"), F.map_from_entries(held).alias("bits"))


def bitmap_to_multihot(bitmaps: DataFrame, num_classes: int, out: str = "label") -> DataFrame:
    """``bits`` as ``out`` ARRAY<INT> of width ``num_classes``; classes beyond it are left out."""
    # Eight classes a step: a byte of the words picks its row of the table of all bytes.
    table = F.array(*[F.array(*[F.lit(b >> i & 1) for i in range(8)]) for b in range(256)])
    per = WORD_BITS // 8
    word = lambda k: F.coalesce(F.element_at("bits", F.floor(k / per).cast("int")), F.lit(0).cast("bigint"))
    byte = lambda k: F.call_function("shiftright", word(k), F.pmod(k, F.lit(per)) * 8).bitwiseAND(255).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.lit((num_classes - 1) // 8)), lambda k: F.get(table, byte(k)))
    return bitmaps.withColumn(out, F.slice(F.flatten(steps), 1, num_classes)).drop("bits")


def bitmap_to_ids(bitmaps: DataFrame, out: str = "ids") -> DataFrame:
    """``bits`` as ``out`` ARRAY<INT>: the class ids in ascending order."""
    each = F.transform(F.map_entries("bits"), lambda e: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda i: F.getbit(e["value"], i) == 1),
        lambda i: e["key"] * WORD_BITS + i))
    return bitmaps.withColumn(out, F.array_sort(F.flatten(each))).drop("bits")


def observed_classes(multihot: DataFrame, num_classes: int, label: str = "label") -> DataFrame:
    """Drop never-active columns, as a binarizer fitted without ``classes`` does."""
    seen = fetch_one(multihot, **{f"c{c}": F.max(F.element_at(label, c + 1)) for c in range(num_classes)})
    keep = [c for c in range(num_classes) if seen[f"c{c}"] == 1]
    return multihot.withColumn(label, F.array(*[F.element_at(F.col(label), c + 1) for c in keep]).cast("array<int>"))


def span_to_ids(spans: DataFrame, num_classes: int, cid: str = "category_id", order: str = "row_idx",
                keys=SPAN_KEY) -> DataFrame:
    """keys..., label ARRAY<INT>: distinct category ids in first-seen order."""
    firsts = [F.min(F.when(F.col(cid) == c, F.col(order))).alias(f"_f{c}") for c in range(num_classes)]
    agg = spans.groupBy(*keys).agg(*firsts)
    pairs = F.array(*[F.struct(F.col(f"_f{c}").alias("first"), F.lit(c).alias("id")) for c in range(num_classes)])
    seen = F.array_sort(F.filter(pairs, lambda s: s["first"].isNotNull()))
    return agg.select(*keys, F.transform(seen, lambda s: s["id"]).alias("label"))
