"""Passages of benchmark items in documents, by a prefix-filtered set join.

An item stands in a document if a window of it does: ``width`` words in a
row, or the whole item where it is shorter.  A window is the set of its
``shingle``-word shingles, and all of them have to be found, so by the prefix
filter one shingle per window is enough to join on: the rarest.

1. Items become distinct windows.  One pass over the documents counts the
   shingles that windows use; a window with a shingle that no document has
   cannot occur and leaves here.  The others keep their rarest shingle.
2. A second pass marks the places of documents where such a shingle stands,
   each with the words around it that a window could take in.
3. Places and windows join on the shingle.  The window's place of the shingle
   fixes where it would begin: it must not begin before the text (positional
   bound) nor end after it (length bound).  What is left is compared word by
   word.

Both passes drop most places by a bit table of the wanted shingles.  Its size
follows the number of shingles up to 64 MB; beyond that it only lets more
places through to the join, which is exact.  Texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.arrow import map_rows
from parlance.llm.words import row_slices, string_buffers, window_hashes, word_hashes
from parlance.plans.ordering import fetch_one, materialize

WIDTH = 10
SHINGLE = 3
# Bits of the table per shingle, and its least and largest size as a power of two.
BITS_PER_SHINGLE = 4096
LEAST_BITS, MOST_BITS = 20, 29
# The windows to join with are broadcast up to this size; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

# Words of the contract: lower-cased a-z, digits and all that is not ASCII; every other byte parts them.
_KEPT = np.full(256, 0x20, np.uint8)
_KEPT[0x30:0x3A] = np.arange(0x30, 0x3A)
_KEPT[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEPT[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEPT[0x80:] = np.arange(0x80, 256)
# Stands for a word longer than any of the items; no word holds this character.
_TOO_LONG = b"!"


def _tokenised(batch: pa.RecordBatch, column: int):
    """(slice, bytes with one space for all that parts words, word starts, word hashes, first word of each row)."""
    for part in row_slices(batch, batch.schema.names[column]):
        data, offsets = string_buffers(part.column(column))
        folded = _KEPT[data]
        starts, hashes = word_hashes(folded, offsets, fold=False)
        yield part, folded, offsets, starts, hashes, np.searchsorted(starts, offsets)


def _windows(batches, width: int, shingle: int):
    """(item, window, words, hashes of its shingles) of every window of every item."""
    for batch in batches:
        for part, folded, offsets, starts, hashes, cut in _tokenised(batch, 1):
            for i, item in enumerate(part.column(0).to_pylist()):
                words = [w.decode(errors="replace") for w in folded[offsets[i]:offsets[i + 1]].tobytes().split()]
                n = min(width, len(words))
                size = min(shingle, n)
                if not n:
                    continue
                own = window_hashes(hashes[cut[i]:cut[i + 1]], size).view(np.int64)
                for a in range(len(words) - n + 1):
                    yield item, " ".join(words[a:a + n]), n, own[a:a + n - size + 1].tolist()


def _bit_table(tokens: DataFrame, n: int) -> np.ndarray:
    """Bits of the lower ends of the ``n`` hashes in ``tokens.token``: at most 64 MB, built by the executors."""
    bits = min(max((max(n, 1) * BITS_PER_SHINGLE).bit_length(), LEAST_BITS), MOST_BITS)
    at = F.col("token").bitwiseAND(F.lit((1 << bits) - 1))
    found = tokens.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("page")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for page, held in found.collect():
        table[page << 12:(page + 1) << 12] = np.frombuffer(held, np.uint8)
    return table


def _marked(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _places(hashes: np.ndarray, cut: np.ndarray, size: int, table: np.ndarray):
    """(word numbers, hashes) of the ``size``-word shingles inside one row that the table lets through."""
    found = window_hashes(hashes, size)
    at = np.flatnonzero(_marked(found, table))
    row_end = cut[np.searchsorted(cut, at, "right")] if len(at) else at
    at = at[at + size <= row_end]
    return at, found[at]


def _shingle_counts(batches, sizes: list[int], table):
    for batch in batches:
        for _, _, _, _, hashes, cut in _tokenised(batch, 0):
            for size in sizes:
                token, n = np.unique(_places(hashes, cut, size, table.value)[1], return_counts=True)
                yield from zip(token.view(np.int64).tolist(), n.tolist())


def _facts(batches, sizes: list[int], width: int, longest: int, table):
    """One row per document, then one per marked place of it with the words around."""
    for batch in batches:
        for part, folded, offsets, starts, hashes, cut in _tokenised(batch, 2):
            keys = part.column(0).to_pylist()
            for key, doc, a, b in zip(keys, part.column(1).to_pylist(), cut[:-1].tolist(), cut[1:].tolist()):
                yield key, doc, b - a, None, None, None, None, None
            for size in sizes:
                at, token = _places(hashes, cut, size, table.value)
                row = np.searchsorted(cut, at, "right") - 1
                low = np.maximum(cut[row], at - (width - size))
                high = np.minimum(cut[row + 1], at + width)
                end = np.where(high < cut[row + 1], starts[np.minimum(high, len(starts) - 1)], offsets[row + 1])
                for i in range(len(at)):
                    around = [w if len(w) <= longest else _TOO_LONG for w in folded[starts[low[i]]:end[i]].tobytes().split()]
                    yield (keys[row[i]], None, None, int(at[i] - cut[row[i]]), int(at[i] - low[i]), len(around),
                           int(token[i].view(np.int64)), b" ".join(around).decode(errors="replace"))


_FACTS = "row long, doc_id long, n_words long, place long, before int, around int, token long, context string"


def item_windows(benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """item_id, window, n, tokens: the windows of every item of ``benchmark`` (item_id, text)."""
    narrow = benchmark.filter("item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, lambda it: _windows(it, width, shingle),
                    "item_id string, window string, n int, tokens array<long>")


def _rarest(windows: DataFrame, texts: DataFrame, sizes: list[int]) -> DataFrame:
    """window_id, window, n, token, shift: the rarest shingle of every window whose shingles all occur in ``texts``."""
    each = windows.select("window_id", F.posexplode("tokens").alias("shift", "token"))
    tokens = materialize(each.select("token").distinct())
    table = texts.sparkSession.sparkContext.broadcast(_bit_table(tokens, tokens.count()))
    seen = map_rows(texts, lambda it: _shingle_counts(it, sizes, table), "token long, n long")
    seen = seen.groupBy("token").agg(F.sum("n").alias("often"))
    often = materialize(tokens.join(seen, "token", "left").select("token", F.coalesce("often", F.lit(0)).alias("often")))
    best = each.join(often, "token").groupBy("window_id").agg(F.min(F.struct("often", "token", "shift")).alias("best"))
    return windows.join(best.filter("best.often > 0"), "window_id").select(
        "window_id", "window", "n", F.col("best.token").alias("token"), F.col("best.shift").alias("shift"))


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE):
    """(documents, hits, owners): where windows of items stand in ``docs``.

    documents: row (a number per row of ``docs``), doc_id, n_words.
    hits: row, window_id, first, past (word numbers from 0), one per place of a window.
    owners: window_id, item_id.
    """
    spark = docs.sparkSession
    found = materialize(item_windows(benchmark, width, shingle))
    windows = materialize(found.groupBy("window").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
                               .withColumn("window_id", F.monotonically_increasing_id()))
    owners = materialize(found.select("window", "item_id").distinct().join(windows.select("window", "window_id"), "window")
                              .select("window_id", "item_id"))
    sizes = [r[0] for r in windows.select(F.least(F.col("n"), F.lit(shingle))).distinct().collect()]
    texts = docs.select(F.col("text").cast("string").alias("text"))
    wanted = materialize(_rarest(windows, texts, sizes))
    prefix = wanted.select("token").distinct()
    known = fetch_one(wanted, rows=F.count(F.lit(1)), bytes=F.sum(F.octet_length("window") + F.lit(48)),
                      longest=F.max(F.array_max(F.transform(F.split("window", " "), F.octet_length))))
    table = spark.sparkContext.broadcast(_bit_table(prefix, known["rows"]))
    longest = known["longest"] or 0
    # The number of a row comes from its place in the scan; it is written with the row and used from there only.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text").cast("string").alias("text"))
    facts = materialize(map_rows(numbered, lambda it: _facts(it, sizes, width, longest, table), _FACTS))
    documents = facts.filter("place is null").select("row", "doc_id", "n_words")
    places = facts.filter("place is not null").select("row", "place", "before", "around", "token", "context")
    small = (known["bytes"] or 0) <= BROADCAST_BYTES
    met = places.join(F.broadcast(wanted) if small else wanted, "token")
    met = met.filter("shift <= before and before - shift + n <= around")
    same = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("shift") + 1, F.col("n")), " ") == F.col("window")
    first = F.col("place") - F.col("shift")
    hits = met.filter(same).select("row", "window_id", first.alias("first"), (first + F.col("n")).alias("past"))
    return documents, materialize(hits), owners


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, items of every row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    ``n_hit`` counts the words inside any occurrence of a window, each word
    once; ``items`` lists the ids (as strings, sorted) of the items with such
    windows.  A null, empty or wordless text has no words, as a document and
    as an item.  Items without an id take no part; rows of one item_id are
    one item.  Repeated documents each get their row.  Other columns are
    ignored.  An empty benchmark hits nothing; an empty table of documents
    gives no rows.
    """
    documents, hits, owners = occurrences(docs, benchmark, width, shingle)
    # Words of a hit that no earlier hit of the row reaches.
    earlier = F.max("past").over(Window.partitionBy("row").orderBy("first", "past").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("past") - F.greatest("first", F.coalesce(earlier, F.lit(0)))
    words = hits.select("row", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("row", "window_id").distinct().join(owners, "window_id").select("row", "item_id").distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return (documents.join(words, "row", "left").join(named, "row", "left")
                     .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                             F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``decontaminated``."""
    return decontaminated(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# Every window of every document by length, compared as text.
CONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
m AS (SELECT item_id, w, least(len(w), {WIDTH}) AS n FROM b WHERE len(w) > 0),
i AS (SELECT item_id, n, unnest([array_to_string(w[p:p + n - 1], ' ') FOR p IN range(1, len(w) - n + 2)]) AS t FROM m),
l AS (SELECT DISTINCT n FROM i),
s AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d JOIN l ON len(w) >= n),
h AS (SELECT s.r, s.p, s.n, i.item_id FROM s JOIN i ON s.n = i.n AND array_to_string(s.w[s.p:s.p + s.n - 1], ' ') = i.t),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS x FROM h) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS g
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(g, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN k ON d.r = k.r
"""
