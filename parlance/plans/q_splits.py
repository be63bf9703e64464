"""Registered queries: split reconstruction, set operations, rebalancing, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import labels as lb
from parlance.operators import metrics as mt
from parlance.operators import sampling as sp
from parlance.operators import splits as sl
from parlance.plans.fixtures import (M_SQL, MM_SQL, P_SQL, manifest, messy_manifest, paragraphs, sql_pick, table, with_ctes)
from parlance.plans.ordering import index_by_order, materialize
from parlance.plans.registry import register

FIRST_SQL = """FP AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY par_id ORDER BY row_idx) AS rn FROM P)
               WHERE rn = 1)"""
TR_SQL = """TR AS (SELECT M.m_idx, M.par_id, FP.text, FP.label, FP.orig_label, FP.art_id, FP.keyword, FP.country
               FROM M LEFT JOIN FP USING (par_id) WHERE M.split = 'train')"""
DV_SQL = TR_SQL.replace("TR AS", "DV AS").replace("'train'", "'dev'")
BASE = (P_SQL, M_SQL, FIRST_SQL, TR_SQL, DV_SQL)
# The same splits from a manifest that repeats and misses ids.
MESSY = (P_SQL, M_SQL, MM_SQL, FIRST_SQL, *(s.replace("FROM M ", "FROM MM ").replace("M.", "MM.") for s in (TR_SQL, DV_SQL)))


def _split(spark, d, name, cols=sl.WIDE, ids=manifest):
    m = ids(spark, d).filter(F.col("split") == name)
    return sl.rebuild_split(paragraphs(spark, d), m, cols)


def _narrow(spark, d, name, ids=manifest):
    """par_id, label, m_idx of a split, written once: what counts and draws read."""
    return materialize(_split(spark, d, name, ids=ids).select("par_id", "label", "m_idx"))


@register("rebuild_split", with_ctes(*BASE, body="SELECT m_idx, par_id, text, label FROM TR"))
def q_rebuild(spark, d):
    return _split(spark, d, "train", sl.SLIM)


@register("rebuild_split_wide", with_ctes(*BASE, body="""
SELECT m_idx, par_id, text, label, orig_label, art_id, keyword, country FROM DV"""))
def q_rebuild_wide(spark, d):
    return _split(spark, d, "dev")


ML_SQL = """ML AS (SELECT M.m_idx, M.par_id, FP.text, CAST(M.label AS INTEGER[]) AS label
               FROM M LEFT JOIN FP USING (par_id) WHERE M.split = 'train')"""


@register("rebuild_split_multilabel", with_ctes(*BASE, ML_SQL, body="""
SELECT m_idx, par_id, text, array_to_string(list_transform(label, lambda v: CAST(v AS VARCHAR)), ',') AS label FROM ML"""))
def q_rebuild_ml(spark, d):
    m = manifest(spark, d).filter(F.col("split") == "train")
    r = sl.rebuild_split_multilabel(paragraphs(spark, d), m)
    return r.withColumn("label", lb.render_ints("label"))


@register("missing_ids", with_ctes(P_SQL, body="""
SELECT doc_id AS m_idx, CAST(doc_id AS VARCHAR) AS par_id FROM documents
WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT par_id FROM P)"""))
def q_missing(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("m_idx"),
                                               F.col("doc_id").cast("string").alias("par_id"))
    return sl.missing_ids(docs, paragraphs(spark, d))


@register("join_tasks_on_text", with_ctes(*BASE, ML_SQL, body="""
SELECT P.par_id AS par_id_x, ML.par_id AS par_id_y, P.keyword, P.label AS label_x,
       array_to_string(list_transform(ML.label, lambda v: CAST(v AS VARCHAR)), ',') AS label_y, ML.m_idx
FROM P JOIN ML ON P.text = ML.text"""))
def q_join_text(spark, d):
    p = paragraphs(spark, d).select("par_id", "keyword", "text", "label")
    m = manifest(spark, d).filter(F.col("split") == "train")
    t2 = sl.rebuild_split_multilabel(paragraphs(spark, d), m)
    j = sl.join_on_text(p, t2)
    return j.select("par_id_x", "par_id_y", "keyword", "label_x", lb.render_ints("label_y").alias("label_y"), "m_idx")


@register("with_row_index", with_ctes(P_SQL, body="""
SELECT par_id, row_number() OVER (ORDER BY row_idx) - 1 AS idx FROM P"""))
def q_row_index(spark, d):
    return index_by_order(paragraphs(spark, d).select("par_id", "row_idx"), ["row_idx"], "idx").select("par_id", "idx")


@register("concat_classes", with_ctes(*BASE, body="""
SELECT par_id, 0 AS part, m_idx FROM TR WHERE label = 1
UNION ALL SELECT par_id, 1 AS part, m_idx FROM TR WHERE label = 0"""))
def q_concat(spark, d):
    tr = _narrow(spark, d, "train")
    c = sl.concat_classes(tr.filter("label = 1"), tr.filter("label = 0"))
    return c.select("par_id", "part", "m_idx")


def _downsample_sql(src, ratio):
    return f"""
SELECT par_id, label, m_idx FROM {src} WHERE label = 1
UNION ALL
SELECT par_id, label, m_idx FROM (SELECT *, row_number() OVER (ORDER BY m_idx) - 1 AS i FROM {src} WHERE label = 0)
WHERE i < {ratio} * (SELECT count(*) FROM {src} WHERE label = 1)"""


@register("downsample_negatives", with_ctes(*BASE, body=_downsample_sql("TR", 2)))
def q_downsample(spark, d):
    tr = _narrow(spark, d, "train")
    return sp.downsample_negatives(tr, sp.FINE_TUNE_RATIO, order="m_idx")


@register("downsample_negatives_prompt", with_ctes(*BASE, body=_downsample_sql("TR", 4)))
def q_downsample4(spark, d):
    tr = _narrow(spark, d, "train")
    return sp.downsample_negatives(tr, sp.PROMPT_RATIO, order="m_idx")


@register("downsample_multilabel", with_ctes(*BASE, ML_SQL, "MA AS (SELECT *, list_sum(label) > 0 AS has_any FROM ML)", body="""
SELECT par_id, has_any, m_idx FROM MA WHERE has_any
UNION ALL
SELECT par_id, has_any, m_idx FROM (SELECT *, row_number() OVER (ORDER BY m_idx) - 1 AS i FROM MA WHERE NOT has_any)
WHERE i < round_even(CAST((SELECT count(*) FROM MA WHERE has_any) * 0.5 AS DECIMAL(20, 4)), 0)"""))
def q_downsample_ml(spark, d):
    m = manifest(spark, d).filter(F.col("split") == "train")
    r = materialize(sl.rebuild_split_multilabel(paragraphs(spark, d), m).select("par_id", "label", "m_idx"))
    out = sp.downsample_multilabel(r, sp.MULTILABEL_RATIO, order="m_idx")
    return out.select("par_id", lb.any_category("label").alias("has_any"), "m_idx")


@register("split_sizes", with_ctes(*BASE, f"DS AS ({_downsample_sql('TR', 2)})", body="""
SELECT 'train' AS split, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_pos,
       count(*) FILTER (WHERE label = 0) AS n_neg FROM TR
UNION ALL SELECT 'dev', count(*), count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0) FROM DV
UNION ALL SELECT 'train_downsampled', count(*), count(*) FILTER (WHERE label = 1),
       count(*) FILTER (WHERE label = 0) FROM DS"""))
def q_split_sizes(spark, d):
    tr, dv = _narrow(spark, d, "train"), _split(spark, d, "dev").select("par_id", "label", "m_idx")
    ds = sp.downsample_negatives(tr, 2, order="m_idx")
    return mt.split_sizes({"train": tr, "dev": dv, "train_downsampled": ds})


def _few_shot_sql(n):
    return f"""
SELECT par_id, label, m_idx FROM (
  SELECT par_id, label, m_idx, row_number() OVER (
    PARTITION BY label ORDER BY {sql_pick('4294967296', 'par_id', "'42'")}, par_id, m_idx) AS rn
  FROM TR) WHERE rn <= {n}"""


@register("few_shot_sample", with_ctes(*BASE, body=_few_shot_sql(sp.FEW_SHOT_PER_LABEL)))
def q_few_shot(spark, d):
    tr = _narrow(spark, d, "train")
    return sp.few_shot_sample(tr, sp.FEW_SHOT_PER_LABEL, seed=42, order="m_idx")


SMALL_SHOT = 20


@register("few_shot_sample_small", with_ctes(*BASE, body=_few_shot_sql(SMALL_SHOT)))
def q_few_shot_small(spark, d):
    """A draw below the class sizes of every fixture."""
    tr = _narrow(spark, d, "train")
    return sp.few_shot_sample(tr, SMALL_SHOT, seed=42, order="m_idx")


@register("few_shot_sample_messy", with_ctes(*MESSY, body=_few_shot_sql(SMALL_SHOT)))
def q_few_shot_messy(spark, d):
    tr = _narrow(spark, d, "train", messy_manifest)
    return sp.few_shot_sample(tr, SMALL_SHOT, seed=42, order="m_idx")


@register("rebuild_split_messy", with_ctes(*MESSY, body="SELECT m_idx, par_id, text, label FROM TR"))
def q_rebuild_messy(spark, d):
    return _split(spark, d, "train", sl.SLIM, messy_manifest)


@register("rebuild_split_known", with_ctes(*MESSY, body="SELECT m_idx, par_id, text, label FROM TR WHERE text IS NOT NULL"))
def q_rebuild_known(spark, d):
    """As above, ids unknown to the corpus dropped."""
    m = messy_manifest(spark, d).filter(F.col("split") == "train")
    return sl.rebuild_split(paragraphs(spark, d), m, sl.SLIM, on_missing="drop")


def _demo_sql(seed):
    pools = []
    for side, cls in (("pos", 1), ("neg", 0)):
        pools.append(f"""{side.upper()} AS (SELECT par_id AS {side}_par_id, text AS {side}_text,
               row_number() OVER (ORDER BY m_idx) - 1 AS k FROM TR WHERE label = {cls})""")
    body = f"""
SELECT DV.par_id, POS.pos_par_id, NEG.neg_par_id FROM DV
LEFT JOIN POS ON POS.k = {sql_pick('(SELECT count(*) FROM POS)', 'DV.par_id', f"'{seed}'", "'pos'")}
LEFT JOIN NEG ON NEG.k = {sql_pick('(SELECT count(*) FROM NEG)', 'DV.par_id', f"'{seed}'", "'neg'")}"""
    return with_ctes(*BASE, *pools, body=body)


@register("attach_demonstrations", _demo_sql(42))
def q_demos(spark, d):
    tr = _split(spark, d, "train")
    dv = _split(spark, d, "dev").select("par_id")
    out = sp.attach_demonstrations(dv, tr, seed=42, order="m_idx")
    return out.select("par_id", "pos_par_id", "neg_par_id")
