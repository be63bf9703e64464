"""Registered queries: stored profiles, the line data source, the bucketed corpus, streams with state, wide class vectors."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from parlance.functions.hashing import pick
from parlance.functions.text import collapse_ws, token_count
from parlance.operators import categories as cat
from parlance.operators import labels as lb
from parlance.operators import metrics as mt
from parlance.operators import profile as pf
from parlance.operators import scores as sc
from parlance.operators import sketches as sk
from parlance.operators import splits as sl
from parlance.plans.fixtures import (L_SQL, NUM_MODELS, P_SQL, S_SQL, logits, manifest, paragraphs, spans, sql_collapse, sql_pick,
                                     sql_token_count, with_ctes)
from parlance.plans.ordering import materialize
from parlance.plans.q_metrics import X_SQL, _scored, sql_counts, sql_prf
from parlance.plans.q_scores import BC_CTES, _epoch_prf_from
from parlance.plans.q_splits import BASE
from parlance.plans.registry import register
from parlance.session import scratch_path
from parlance.sources import bucketed as bk
from parlance.sources import datasource as ds
from parlance.sources import readers as rd
from parlance.sources import sinks
from parlance.streaming import stateful as st

# ---------------------------------------------------------------- stored profiles

PARTS = 4


def stored_profile(spark, d) -> str:
    """The folder of a profile of the paragraphs in four parts, each stored by itself."""
    p = paragraphs(spark, d).select("par_id", "keyword", "text")
    path = scratch_path(spark, "profile")
    for k in range(PARTS):
        sk.store_profile(p.filter(pick(PARTS, F.col("par_id"), "part") == k), path, f"p{k}", "keyword")
    return path


@register("profile_sketches", with_ctes(P_SQL, f"""
T AS (SELECT keyword, {sql_token_count('text')} AS n FROM P)""", body="""
SELECT 'group' AS scope, keyword, count(*) AS n_rows, sum(n)::BIGINT AS n_tokens, true AS words_within, true AS lengths_within
FROM T GROUP BY keyword
UNION ALL SELECT 'all', NULL, count(*), sum(n)::BIGINT, true, true FROM T"""))
def q_profile_sketches(spark, d):
    """Merged sketches of all parts; the estimates are held against the exact rows and lie within the stated errors."""
    got = sk.merged_profile(spark, stored_profile(spark, d), "keyword")
    p = paragraphs(spark, d).select("keyword", "text")
    words = pf.vocab_summary(p, "keyword").select("keyword", "n_words")
    n = materialize(p.groupBy("keyword", token_count("text").alias("n")).agg(F.count(F.lit(1)).alias("c")))
    everything = n.groupBy("n").agg(F.sum("c").alias("c")).select(F.lit(None).cast("string").alias("keyword"), "n", "c")
    lengths = n.unionByName(everything)
    exact = words.withColumnRenamed("keyword", "_k").withColumnRenamed("n_words", "_words")
    met = got.join(exact, F.col("keyword").eqNullSafe(F.col("_k"))).drop("_k")
    each = met.select("*", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in pf.PERCENTILES]).alias("p"), F.col("quantiles").alias("v"))).alias("z"))
    rows = lengths.select(F.col("keyword").alias("_k"), "n", "c")
    ranked = each.join(rows, F.col("keyword").eqNullSafe(F.col("_k"))).groupBy(
        "scope", "keyword", "n_rows", "n_tokens", "n_words", "_words", "z").agg(
        (F.sum(F.when(F.col("n") < F.col("z.v"), F.col("c")).otherwise(0)) / F.sum("c")).alias("below"),
        (F.sum(F.when(F.col("n") <= F.col("z.v"), F.col("c")).otherwise(0)) / F.sum("c")).alias("upto"))
    err = sk.rank_error()
    fits = (F.col("z.p") >= F.col("below") - err) & (F.col("z.p") <= F.col("upto") + err)
    near = F.abs(F.col("n_words") - F.col("_words")) <= sk.words_error() * F.col("_words") + 1
    return ranked.groupBy("scope", "keyword", "n_rows", "n_tokens").agg(
        F.bool_and(near).alias("words_within"), F.bool_and(fits).alias("lengths_within"))


# ---------------------------------------------------------------- line data source

RANGE = 1 << 16


@register("src_datasource_lines", with_ctes(P_SQL, body=f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, par_id || chr(9) || {sql_collapse('text')} AS value FROM P"""))
def q_datasource_lines(spark, d):
    """Lines written by Spark's writer and numbered through the data source, in ranges smaller than the files."""
    line = F.concat_ws("\t", "par_id", collapse_ws("text"))
    path = sinks.write_lines(paragraphs(spark, d), line, scratch_path(spark, "lines"), ["row_idx"], header_lines=2)
    return ds.indexed_ranges(spark, path, header_lines=2, range_bytes=RANGE).select("row_idx", "value")


@register("src_rejected_lines", with_ctes(P_SQL, f"""
B AS (SELECT row_number() OVER (ORDER BY row_idx) - 1 AS line_no, par_id, art_id, keyword, {sql_pick('7', 'par_id', "'broken'")} AS k FROM P)""", body="""
SELECT line_no, k + 1 AS n_fields, CASE k WHEN 0 THEN par_id ELSE par_id || chr(9) || art_id END AS value FROM B WHERE k < 2"""))
def q_rejected_lines(spark, d):
    """Lines with too few fields as rows, with their numbers."""
    k = pick(7, F.col("par_id"), "broken")
    line = F.when(k == 0, F.col("par_id")).when(k == 1, F.concat_ws("\t", "par_id", "art_id")).otherwise(
        F.concat_ws("\t", "par_id", "art_id", "keyword", "country", collapse_ws("text"), "orig_label"))
    path = sinks.write_lines(paragraphs(spark, d), line, scratch_path(spark, "broken"), ["row_idx"])
    # Many files in order: a line's number is its place in all of them.
    lines = ds.indexed_ranges(spark, path, range_bytes=RANGE).withColumn("line_no", F.col("row_idx"))
    bad = ds.rejected_lines(lines, 5)
    return bad.select("line_no", "n_fields", "value")


@register("sink_datasource_lines", with_ctes(P_SQL, body=f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, {sql_collapse('text')} AS text FROM P"""))
def q_sink_datasource(spark, d):
    """Lines in order, written and read back through the data source."""
    p = paragraphs(spark, d).repartitionByRange("row_idx").sortWithinPartitions("row_idx").select(collapse_ws("text").alias("text"))
    path = ds.write_lines(p, scratch_path(spark, "sink-lines"), "text")
    return ds.indexed_ranges(spark, path, range_bytes=RANGE).select("row_idx", F.col("value").alias("text"))


# ---------------------------------------------------------------- bucketed corpus

@register("rebuild_split_bucketed", with_ctes(*BASE, body="""
SELECT m_idx, par_id, text, label, orig_label, art_id, keyword, country FROM TR UNION ALL
SELECT m_idx, par_id, text, label, orig_label, art_id, keyword, country FROM DV"""))
def q_rebuild_bucketed(spark, d):
    """Both splits from one bucketed corpus."""
    name = bk.write_bucketed(paragraphs(spark, d))
    m = manifest(spark, d)
    parts = [bk.rebuild_bucketed(spark, name, m.filter(F.col("split") == s), sl.WIDE) for s in ("train", "dev")]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- streams with state

CHUNKS = 3


@register("stream_confusion", with_ctes(P_SQL, X_SQL, body=f"SELECT {sql_counts()} FROM X"))
def q_stream_confusion(spark, d):
    """Running counts over a stream of scored rows in which a third of the rows comes twice."""
    x = _scored(spark, d).select(F.col("row_idx").alias("pos"), "label", "pred", F.timestamp_seconds(F.lit(86400) + F.pmod("row_idx", F.lit(60))).alias("ts"))
    path = scratch_path(spark, "scored")
    for k in range(CHUNKS):
        part = x.filter(F.pmod("pos", F.lit(CHUNKS)) == k)
        (part.unionByName(part) if k == 0 else part).write.parquet(os.path.join(path, f"chunk{k}"))
    return st.stream_confusion(spark, f"{path}/*", scratch_path(spark, "confusion"), scratch_path(spark, "confusion-ckpt"))


@register("stream_best_checkpoint", with_ctes(*BC_CTES, body="SELECT * FROM BC"))
def q_stream_best(spark, d):
    """``best_checkpoint`` with the epochs coming in three parts, one micro-batch at least for each."""
    em = materialize(_epoch_prf_from(spark, d)).select("run", "epoch", "precision", "recall", "f1")
    path, out, ckpt = (scratch_path(spark, f"epochs-{x}") for x in ("in", "out", "ckpt"))
    for k in range(CHUNKS):
        part = em.filter((F.col("epoch") >= 11 * k) & (F.col("epoch") < 11 * (k + 1)))
        part.write.mode("append").parquet(path)
        done = st.stream_best_checkpoint(spark, path, out, ckpt)
    return done


# ---------------------------------------------------------------- wide class vectors

WIDE_CLASSES = 1000
_WIDE_CID = sql_pick(str(WIDE_CLASSES), "row_idx", "'class'")


@register("span_to_multihot_wide", with_ctes(S_SQL, f"W AS (SELECT par_id, {_WIDE_CID} AS c FROM S)", f"""
V AS (SELECT par_id, count(*) AS n_spans, list(DISTINCT c) AS cs FROM W GROUP BY par_id)""", body=f"""
SELECT par_id, n_spans, array_to_string(list_transform(range(0, {WIDE_CLASSES}), lambda i: CAST(list_contains(cs, i) AS INTEGER)), ',') AS label
FROM V"""))
def q_wide(spark, d):
    """A thousand classes in one expression per word of bits."""
    s = spans(spark, d).select("par_id", pick(WIDE_CLASSES, F.col("row_idx"), "class").cast("int").alias("category_id"))
    wide = cat.bitmap_to_multihot(cat.span_to_bitmap(s, keys=("par_id",)), WIDE_CLASSES)
    return wide.select("par_id", "n_spans", lb.render_ints("label").alias("label"))


# ---------------------------------------------------------------- runs and predictions read back from files

@register("ensemble_stored_runs", with_ctes(L_SQL, f"""
S AS (SELECT m, vec_id, gold, i - 1 AS class_id,
             exp(x[i] - list_max(x)) / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) AS p
      FROM ({" UNION ALL ".join(f"SELECT {m} AS m, vec_id, gold, m{m} AS x FROM L" for m in range(NUM_MODELS))}), range(1, 11) r(i))""",
                                            "A AS (SELECT vec_id, gold, class_id, avg(p) AS p, count(*) AS n_models FROM S GROUP BY ALL)",
                                            "B AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_id) AS rn FROM A)",
                                            body="""
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, gold, n_models, CAST(class_id AS INTEGER) AS pred FROM B WHERE rn = 1"""))
def q_ensemble_stored(spark, d):
    """Each run's scores are a file of their own; the files are read back, averaged after softmax, and lined up with the gold labels."""
    lg = logits(spark, d)
    runs = {}
    for m in range(NUM_MODELS):
        path = sinks.write_score_lines(lg, scratch_path(spark, f"run{m}"), ["vec_id"], f"m{m}")
        runs[m] = rd.read_score_lines(spark, path, 10)
    voted = sc.ensemble_vote(sc.stack_models(runs, "row_idx"), "row_idx", 10).select("row_idx", "n_models", "pred")
    return sl.align_by_position(lg.select("vec_id", "gold"), ["vec_id"], voted, "row_idx").select("pos", "vec_id", "gold", "n_models", "pred")


_ERROR_SLICES = " UNION ALL ".join(
    f"SELECT '{name}' AS slice, CAST({expr} AS VARCHAR) AS value, label, pred FROM X"
    for name, expr in [("grade", "orig_label"), ("length", f"CASE WHEN {sql_token_count('text')} > 63 THEN 'long' ELSE 'short' END")])


@register("prediction_error_slices", with_ctes(
    P_SQL, X_SQL, f"SX AS ({_ERROR_SLICES})",
    f"C AS (SELECT slice, value, count(*) AS n, {sql_counts(with_tn=False)} FROM SX GROUP BY ALL)",
    body=f"SELECT slice, value, n, tp, fp, fn, {sql_prf()} FROM C"))
def q_error_slices(spark, d):
    """Stored predictions lined up with the gold rows by position, and their errors by grade and length band."""
    path = sinks.write_label_lines(_scored(spark, d), scratch_path(spark, "errors"))
    p = paragraphs(spark, d)
    gold = p.select("label", "row_idx", "orig_label", F.when(token_count("text") > 63, "long").otherwise("short").alias("band"))
    both = sl.align_by_position(gold, ["row_idx"], rd.read_label_lines(spark, path), "row_idx")
    return mt.prf1_by_slice(both, {"grade": F.col("orig_label"), "length": F.col("band")})
