"""How filters overlap: truth-table survival words and positional popcounts.

Five filters fail a document or not.  A document that fails the set f
survives a subset S of the filters if f and S share nothing, so its whole
truth table is one 32-bit word: bit S says whether it survives S.  Whatever
the order of the filters, the documents left after k of them are those whose
bit for the first k is set.  Adding the words up bit by bit (a positional
popcount, by carry-save adders over blocks of words) gives the survivors of
all 32 subsets; the 120 orders are differences of these 32 numbers.

Each text is read once, for four filters and a digest.  The fifth (identical
to a text of a smaller doc_id) is a join of (digest, doc_id) with the
smallest doc_id per digest: that minimum is combined before the shuffle and
the join key holds the doc_id, so copies of one text never meet in one task.
"""

from __future__ import annotations

import hashlib
import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.arrow import map_rows
from parlance.llm.words import pieces, word_hashes
from parlance.plans.ordering import materialize

# Fixed values of the audit.
FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_SHARE = (65, 100)
UPPER_SHARE = (5, 100)
SYMBOLS = b"#$%&*|"

_UPPER = bytes(range(65, 91))
SUBSETS = 1 << len(FILTERS)
# The word of a document that fails the filters f: bit S is set if f & S is empty.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not f & s) for f in range(SUBSETS)], np.uint32)
# A text up to this size is split whole; of a longer one the distinct words are told by 64-bit hashes.
_WHOLE_TEXT = 4 << 20
_HELD_WORDS = 1 << 20


def _word_counts(raw: bytes) -> tuple[int, int]:
    """(words, distinct words) of a text."""
    if len(raw) <= _WHOLE_TEXT:
        words = raw.split()
        return len(words), len(set(words))
    data, total, seen = np.frombuffer(raw, np.uint8), 0, np.zeros(0, np.uint64)
    for a, b in pieces(data, np.array([0, len(data)]), _WHOLE_TEXT):
        _, hashes = word_hashes(data[a:b], np.array([0, b - a]), fold=False)
        total += len(hashes)
        seen = np.union1d(seen, hashes)
    return total, len(seen)


def failures(raw: bytes, length: int) -> int:
    """Which of A to D a text of ``length`` code points fails, as bits."""
    n, distinct = _word_counts(raw)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return ((n < MIN_WORDS)
            + 2 * (DISTINCT_SHARE[1] * distinct < DISTINCT_SHARE[0] * n)
            + 4 * (UPPER_SHARE[1] * upper > UPPER_SHARE[0] * length)
            + 8 * (len(raw.translate(None, SYMBOLS)) < len(raw)))


def _facts(batches):
    for batch in batches:
        texts = pc.fill_null(batch.column(2), "")
        lengths = pc.utf8_length(texts).to_pylist()
        for doc, part, raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                     texts.cast(pa.binary()), lengths):
            raw = raw.as_py()
            yield doc, part, hashlib.blake2b(raw, digest_size=16).digest(), failures(raw, n)


def truth_table(fails: Column) -> Column:
    """The survival word of a set of failed filters, as a long."""
    return F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in WORDS]), fails + 1)


def failed_filters(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of ABCDE, A lowest) per row of ``docs`` (doc_id, text, source)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                         F.col("text").cast("string").alias("text"))
    facts = materialize(map_rows(narrow, _facts, "doc_id long, part string, digest binary, fails int"))
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    first = first.withColumn("leads", F.lit(True))
    copy = F.col("leads").isNull() & F.col("doc_id").isNotNull()
    return facts.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("fails"))


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, fails, word, good, toxic: one row per row of ``docs``.

    ``word`` has bit S set if the document survives the filters of S.
    ``good`` and ``toxic`` say whether a row of ``labels`` (doc_id, quality,
    toxic) marks the document so; a document without a label is neither.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 1).alias("_good"),
                          (F.col("toxic") == 1).alias("_toxic")).groupBy("_id").agg(
        F.max("_good").alias("good"), F.max("_toxic").alias("toxic"))
    rows = failed_filters(docs)
    return rows.join(marks, rows["doc_id"] == marks["_id"], "left").select(
        "doc_id", "part", "fails", truth_table(F.col("fails")).alias("word"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set.

    Three words of one weight make one word of that weight (their sum
    without carries) and one of twice the weight (the carries), for all 32
    positions at once, until at most two words of each weight are left.
    """
    out = np.zeros(32, np.int64)
    place, weight = np.arange(32, dtype=np.uint32), 1
    while len(words):
        carries = []
        while len(words) > 2:
            k = len(words) // 3
            a, b, c = words[:k], words[k:2 * k], words[2 * k:3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * k:]])
        out += weight * ((words[:, None] >> place) & np.uint32(1)).sum(0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return out


def _counted(batches):
    """(part, label, counts of the 32 positions); label: 1 if good, plus 2 if toxic."""
    parts: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def flush():
        if not held:
            return
        keys, words = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, words = keys[order], words[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        names = list(parts)
        for a, b in zip(head, np.append(head[1:], len(keys))):
            yield names[keys[a] >> 2], int(keys[a] & 3), positional_counts(words[a:b]).tolist()

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        code = np.array([parts.setdefault(x, len(parts)) for x in coded.dictionary.to_pylist()], np.int64)
        label = (batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                 + 2 * batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64))
        if batch.num_rows:
            held.append((code[coded.indices.to_numpy()] * 4 + label,
                         batch.column(1).to_numpy().astype(np.uint32)))
            total += batch.num_rows
        if total >= _HELD_WORDS:
            yield from flush()
            parts, held, total = {}, [], 0
    yield from flush()


def subset_survivors(words: DataFrame) -> DataFrame:
    """part, survivors: an array over the 32 subsets of (documents, good, toxic) left by each."""
    counted = map_rows(words.select("part", "word", "good", "toxic"), _counted,
                       "part string, label int, counts array<long>")
    per = counted.select("part", "label", F.posexplode("counts").alias("subset", "n"))
    sums = per.groupBy("part", "subset").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("label").bitwiseAND(1) != 0, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("label").bitwiseAND(2) != 0, F.col("n")).otherwise(0)).alias("toxic"))
    # 32 rows per part.
    return sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("survivors"))


def _steps() -> str:
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k, "f": f,
                          "before": before, "after": before | 1 << f})
            before |= 1 << f
    return json.dumps(steps)


def _shapley(f: int, left) -> Column:
    """Documents that filter ``f`` removes, summed over all orders: a subset comes first in |S|! (4 - |S|)! of them."""
    terms = [F.lit(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) * (left(F.lit(s)) - left(F.lit(s | 1 << f)))
             for s in range(SUBSETS) if not s >> f & 1]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter removes at every place of every order, per part.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley: 600 rows per source of ``docs`` (doc_id,
    text, source).  A null or empty text is empty and fails A; a null source
    is the part of the empty string.  Equal rows count one by one: rows that
    share the smallest doc_id of a text are all first, and a row without
    doc_id is neither a copy nor first and has no label.  Labels repeated for one doc_id mark
    it if one row does.  Other columns are ignored.  An empty table gives no
    rows.
    """
    per = subset_survivors(survival_words(docs, labels))
    whole = F.lit(SUBSETS - 1)
    at = lambda s, field="n": F.get(F.col("survivors"), s)[field]
    shapley = F.array(*[_shapley(f, at) for f in range(len(FILTERS))])
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>")
    rows = per.select("part", "survivors", shapley.alias("shares"), F.explode(steps).alias("s")).select("part", "survivors", "shares", "s.*")
    lost = lambda field: at(F.col("before"), field) - at(F.col("after"), field)
    own = F.expr("shiftleft(1, f)")
    return rows.select(
        "part", "filter_order", "step", at(F.col("after")).alias("kept"), lost("n").alias("removed"),
        (at(F.lit(0)) - at(own) - lost("n")).alias("redundant"),
        (at(whole.bitwiseXOR(own)) - at(whole)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.get(F.col("shares"), F.col("f")).cast("long").alias("shapley"))


# Document by document: a filter removes what it fails and no earlier one of the order fails.
AUDIT_SQL = """
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lead FROM documents),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {A: len(w) < 50, B: 100 * len(list_distinct(w)) < 65 * len(w),
          C: 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          D: regexp_matches(t, '[#$%&*|]'), E: coalesce(d.doc_id > lead, false)} AS x
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (
  SELECT part, good, toxic, map {'A': x.A::INT, 'B': x.B::INT, 'C': x.C::INT, 'D': x.D::INT, 'E': x.E::INT} AS bad,
         count(*) AS n FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order
  FROM c a, c b, c d, c e, c f
  WHERE a.c <> b.c AND d.c NOT IN (a.c, b.c) AND e.c NOT IN (a.c, b.c, d.c) AND f.c NOT IN (a.c, b.c, d.c, e.c)),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (
  SELECT part, filter_order, step, good, toxic, n, substr(filter_order, step, 1) AS letter,
         bad[substr(filter_order, step, 1)] AS here,
         list_sum([bad[substr(filter_order, i, 1)] FOR i IN range(1, step)]) AS earlier,
         list_sum(map_values(bad)) AS fails
  FROM g, s),
t AS (
  SELECT part, filter_order, step, letter,
         sum(n) FILTER (coalesce(earlier, 0) = 0 AND here = 0) AS kept,
         sum(n) FILTER (coalesce(earlier, 0) = 0 AND here = 1) AS removed,
         sum(n) FILTER (earlier > 0 AND here = 1) AS redundant,
         sum(n) FILTER (here = 1 AND fails = 1) AS unique_fails,
         sum(n) FILTER (coalesce(earlier, 0) = 0 AND here = 1 AND good = 1) AS good_lost,
         sum(n) FILTER (coalesce(earlier, 0) = 0 AND here = 1 AND toxic = 1) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM t
"""
