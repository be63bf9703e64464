"""Registered queries for sources and sinks: each writes a table derived
from the inputs into the shared folder in the corpus format, reads it back
with the matching reader, and returns what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import prompts as pm
from parlance.operators import splits as sl
from parlance.plans.fixtures import (CATEGORIES, EVENT_CATEGORIES, M_SQL, P_SQL, S_SQL, U_SQL, manifest,
                                     paragraphs, spans, sql_collapse, sql_token_count, unlabelled, with_ctes)
from parlance.operators import classify as cl
from parlance.operators import metrics as mt
from parlance.operators import sampling as sp
from parlance.plans.ordering import materialize
from parlance.plans.q_classify import nb_sql
from parlance.plans.q_metrics import sql_counts, sql_prf
from parlance.plans.q_splits import BASE, _downsample_sql, _split
from parlance.plans.q_text import PCL_SQL
from parlance.plans.registry import register
from parlance.session import scratch_path
from parlance.sources import readers as rd
from parlance.sources import sinks as sk


@register("src_labelled_tsv", with_ctes(P_SQL, body=f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, par_id, art_id, keyword, country,
       {sql_collapse('text')} AS text, label, orig_label FROM P"""))
def q_src_labelled(spark, d):
    path = sk.write_labelled_tsv(paragraphs(spark, d), scratch_path(spark, "labelled"))
    return rd.read_labelled_tsv(spark, path)


@register("sink_labelled_tsv", with_ctes(P_SQL, body=f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, par_id, {sql_token_count('text')} AS n_tokens
FROM P WHERE {sql_token_count('text')} > 63"""))
def q_sink_labelled(spark, d):
    path = sk.write_labelled_tsv(paragraphs(spark, d), scratch_path(spark, "long"), long_only=True)
    r = rd.read_labelled_tsv(spark, path)
    return r.select("row_idx", "par_id", F.size(F.split("text", " ")).alias("n_tokens"))


def _span_rows(spark, d):
    s = spans(spark, d)
    name = F.element_at(F.array(*[F.lit(CATEGORIES[i]) for i in range(len(EVENT_CATEGORIES))]),
                        F.array_position(F.array(*[F.lit(e) for e in EVENT_CATEGORIES]), F.col("category")).cast("int"))
    return s.select("row_idx", "par_id", "art_id", "text", "keyword", "country",
                    F.lit("0").alias("start"), F.length("text").cast("string").alias("finish"),
                    F.col("text").alias("text_span"), name.alias("category"), F.lit("2").alias("num_annotators"))


_CAT_CASE = "CASE category " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(EVENT_CATEGORIES)) + " END"


@register("src_span_tsv", with_ctes(S_SQL, body=f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, par_id, art_id, text, keyword, country,
       {_CAT_CASE} AS category_id, '2' AS num_annotators FROM S"""))
def q_src_span(spark, d):
    path = sk.write_span_tsv(_span_rows(spark, d), scratch_path(spark, "spans"))
    r = rd.read_span_tsv(spark, path)
    return r.select("row_idx", "par_id", "art_id", "text", "keyword", "country", "category_id", "num_annotators")


@register("src_unlabelled_tsv", with_ctes(U_SQL, body=f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, par_id, art_id, keyword, country, {sql_collapse('text')} AS text
FROM U"""))
def q_src_unlabelled(spark, d):
    path = sk.write_unlabelled_tsv(unlabelled(spark, d), scratch_path(spark, "test"))
    return rd.read_unlabelled_tsv(spark, path)


@register("src_split_manifest", with_ctes(M_SQL, body="""
SELECT row_number() OVER (ORDER BY m_idx) - 1 AS m_idx, par_id, label FROM M"""))
def q_src_manifest(spark, d):
    path = sk.write_manifest_csv(manifest(spark, d), scratch_path(spark, "manifest"))
    return rd.read_split_manifest(spark, path)


@register("manifest_to_downsample", with_ctes(*BASE, body=_downsample_sql(
    "(SELECT * REPLACE (row_number() OVER (ORDER BY m_idx) - 1 AS m_idx) FROM TR)", 2)))
def q_manifest_chain(spark, d):
    """Manifest file, split rebuilt from it, negatives downsampled in file order."""
    m = manifest(spark, d).filter(F.col("split") == "train")
    path = sk.write_manifest_csv(m, scratch_path(spark, "manifest"))
    r = sl.rebuild_split(paragraphs(spark, d), rd.read_split_manifest(spark, path), ["label"])
    return sp.downsample_negatives(materialize(r.select("par_id", "label", "m_idx")), 2, order="m_idx")


@register("predict_file_eval", with_ctes(*BASE, *nb_sql("TR", "DV", "NB1"), f"""
C AS (SELECT {sql_counts('label', 'CAST(score > 0 AS INTEGER)')} FROM NB1SC)""", body=f"SELECT tp, fp, fn, tn, {sql_prf()} FROM C"))
def q_predict_file_eval(spark, d):
    """Train, predict the dev split, write one prediction per line, read the file back, align, evaluate."""
    train = materialize(_split(spark, d, "train").select("text", "label"))
    dev = _split(spark, d, "dev")
    path = sk.write_label_lines(cl.classify_binary(train, dev), scratch_path(spark, "dev_preds"), order=["m_idx"])
    gold = dev.select("par_id", "label", "m_idx")
    return mt.prf1(sl.align_by_position(gold, ["m_idx"], rd.read_label_lines(spark, path), "row_idx"))


@register("src_prompt_pairs", with_ctes(*BASE, body=f"""
SELECT row_number() OVER (ORDER BY m_idx) - 1 AS row_idx,
       {sql_collapse('text')} || ' </s> <mask> , this paragraph is ' || {PCL_SQL} || ' for ' || keyword || ' .' AS source,
       {sql_collapse('text')} || ' </s> ' || CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END || ' , this paragraph is '
            || {PCL_SQL} || ' for ' || keyword || ' .' AS target
FROM TR"""))
def q_src_prompt_pairs(spark, d):
    p = pm.prompt_pair(_split(spark, d, "train"))
    path = sk.write_prompts(p, scratch_path(spark, "prompts"), order=["m_idx"])
    return rd.read_prompt_pairs(spark, path)


@register("src_prompt_lines", with_ctes(U_SQL, body=f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx,
       {sql_collapse('text')} || ' </s> <mask> , this paragraph is not ' || {PCL_SQL} || ' for ' || keyword || ' .' AS text
FROM U"""))
def q_src_prompt_lines(spark, d):
    p = pm.prompt_test(unlabelled(spark, d))
    path = sk.write_prompts(p, scratch_path(spark, "test_prompts"), with_target=False)
    return rd.read_prompt_lines(spark, path)


@register("sink_text_lines", with_ctes(P_SQL, body=f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, {sql_collapse('text')} AS text FROM P"""))
def q_sink_text_lines(spark, d):
    path = sk.write_text_lines(paragraphs(spark, d), scratch_path(spark, "raw"))
    return rd.read_prompt_lines(spark, path)


@register("src_label_pairs", with_ctes(P_SQL, body="""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, label FROM P"""))
def q_src_label_pairs(spark, d):
    path = sk.write_text_label(paragraphs(spark, d), scratch_path(spark, "pairs"))
    return rd.read_label_pairs(spark, path)


@register("src_label_lines", with_ctes(P_SQL, body="""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, 1 - quality AS pred FROM P"""))
def q_src_label_lines(spark, d):
    p = paragraphs(spark, d, with_quality=True).withColumn("pred", (1 - F.col("quality")).cast("int"))
    path = sk.write_label_lines(p, scratch_path(spark, "preds"))
    return rd.read_label_lines(spark, path)


@register("sink_label_lines", with_ctes(M_SQL, body="""
SELECT row_number() OVER (ORDER BY m_idx) - 1 AS row_idx,
       replace(replace(replace(label, '[', ''), ']', ''), ' ', '') AS pred FROM M"""))
def q_sink_label_lines(spark, d):
    from parlance.operators.labels import parse_category_list
    m = manifest(spark, d).withColumn("pred", parse_category_list("label"))
    path = sk.write_label_lines(m, scratch_path(spark, "task2"), order=["m_idx"])
    from parlance.sources.lines import indexed_lines
    return indexed_lines(spark, path).select("row_idx", F.col("value").alias("pred"))


@register("align_predictions", with_ctes(P_SQL, body="""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS pos, par_id, label, 1 - quality AS pred FROM P"""))
def q_align(spark, d):
    p = paragraphs(spark, d, with_quality=True).withColumn("pred", (1 - F.col("quality")).cast("int"))
    path = sk.write_label_lines(p, scratch_path(spark, "preds"))
    preds = rd.read_label_lines(spark, path)
    gold = paragraphs(spark, d).select("par_id", "label", "row_idx")
    return sl.align_by_position(gold, ["row_idx"], preds, "row_idx").select("pos", "par_id", "label", "pred")


@register("sink_text_label", with_ctes(P_SQL, body=f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, {sql_collapse('text')} AS text, CAST(label AS VARCHAR) AS label
FROM P"""))
def q_sink_text_label(spark, d):
    path = sk.write_text_label(paragraphs(spark, d), scratch_path(spark, "sentences"))
    from parlance.sources.lines import indexed_lines
    f = F.split(F.col("value"), "\t", -1)
    return indexed_lines(spark, path).select("row_idx", F.get(f, 0).alias("text"), F.get(f, 1).alias("label"))


@register("sink_prompts", with_ctes(*BASE, body=f"""
SELECT row_number() OVER (ORDER BY m_idx) - 1 AS row_idx,
       {sql_collapse('text')} || ' </s> <mask> , this paragraph is ' || {PCL_SQL} || ' for ' || keyword || ' .' || chr(9) ||
       {sql_collapse('text')} || ' </s> ' || CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END || ' , this paragraph is '
            || {PCL_SQL} || ' for ' || keyword || ' .' AS line
FROM TR"""))
def q_sink_prompts(spark, d):
    p = pm.prompt_pair(_split(spark, d, "train"))
    path = sk.write_prompts(p, scratch_path(spark, "prompt_file"), order=["m_idx"])
    from parlance.sources.lines import indexed_lines
    return indexed_lines(spark, path).select("row_idx", F.col("value").alias("line"))
