"""Registered queries: metrics, confusion counts, slices, class weights, spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import token_count
from parlance.operators import categories as cat
from parlance.operators import labels as lb
from parlance.operators import metrics as mt
from parlance.plans.fixtures import (EVENT_CATEGORIES, M_SQL, NUM_CATEGORIES, P_SQL, S_SQL, manifest,
                                     paragraphs, spans, sql_token_count, with_ctes)
from parlance.plans.registry import register

# Baseline prediction of the metric fixtures: a low-quality flag.
X_SQL = "X AS (SELECT *, 1 - quality AS pred FROM P)"


def _scored(spark, d):
    p = paragraphs(spark, d, with_quality=True)
    return p.withColumn("pred", (1 - F.col("quality")).cast("int"))


def sql_prf(tp="tp", fp="fp", fn="fn"):
    p = f"CASE WHEN {tp} + {fp} = 0 THEN 0.0 ELSE {tp} / ({tp} + {fp}) END"
    r = f"CASE WHEN {tp} + {fn} = 0 THEN 0.0 ELSE {tp} / ({tp} + {fn}) END"
    f1 = f"CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"
    return f"{p} AS precision, {r} AS recall, {f1} AS f1"


def sql_counts(g="label", p="pred", with_tn=True):
    s = (f"count(*) FILTER (WHERE {g} = 1 AND {p} = 1) AS tp, count(*) FILTER (WHERE {g} <> 1 AND {p} = 1) AS fp, "
         f"count(*) FILTER (WHERE {g} = 1 AND {p} <> 1) AS fn")
    return s + (f", count(*) FILTER (WHERE {g} <> 1 AND {p} <> 1) AS tn" if with_tn else "")


@register("prf1", with_ctes(P_SQL, X_SQL, f"C AS (SELECT {sql_counts()} FROM X)",
                            body=f"SELECT tp, fp, fn, tn, {sql_prf()} FROM C"))
def q_prf1(spark, d):
    return mt.prf1(_scored(spark, d))


@register("confusion_matrix", with_ctes(P_SQL, X_SQL, f"C AS (SELECT {sql_counts()} FROM X)", body="""
SELECT 1 AS gold, 1 AS pred, tp AS n FROM C UNION ALL SELECT 0, 1, fp FROM C
UNION ALL SELECT 1, 0, fn FROM C UNION ALL SELECT 0, 0, tn FROM C"""))
def q_confusion(spark, d):
    return mt.confusion_matrix(_scored(spark, d))


_SLICE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS slice, CAST({expr} AS VARCHAR) AS value, label, pred FROM X"
    for name, expr in [("keyword", "keyword"), ("country", "country"), ("grade", "orig_label"),
                       ("length", f"CASE WHEN {sql_token_count('text')} > 63 THEN 'long' ELSE 'short' END")])


@register("prf1_by_slice", with_ctes(P_SQL, X_SQL, f"SX AS ({_SLICE_SQL})",
                                     f"C AS (SELECT slice, value, count(*) AS n, {sql_counts(with_tn=False)} FROM SX GROUP BY ALL)",
                                     body=f"SELECT slice, value, n, tp, fp, fn, {sql_prf()} FROM C"))
def q_prf1_slice(spark, d):
    x = paragraphs(spark, d, with_quality=True, spread_text=True).withColumn("pred", (1 - F.col("quality")).cast("int"))
    slices = {"keyword": F.col("keyword"), "country": F.col("country"), "grade": F.col("orig_label"),
              "length": F.when(token_count("text") > 63, "long").otherwise("short")}
    return mt.prf1_by_slice(x, slices)


@register("prf1_by_slice_model", with_ctes(P_SQL, """
X2 AS (SELECT 'labels' AS model, *, 1 - quality AS pred FROM P
       UNION ALL SELECT 'length' AS model, *, CAST(length(text) < 1000 AS INTEGER) AS pred FROM P)""", f"""
C AS (SELECT model, 'keyword' AS slice, keyword AS value, count(*) AS n, {sql_counts(with_tn=False)} FROM X2 GROUP BY ALL)""",
                                           body=f"SELECT model, slice, value, n, tp, fp, fn, {sql_prf()} FROM C"))
def q_prf1_slice_model(spark, d):
    """Per-slice scores of several models side by side, in one aggregate."""
    p = paragraphs(spark, d, with_quality=True)
    preds = F.array(F.struct(F.lit("labels").alias("model"), (1 - F.col("quality")).cast("int").alias("pred")),
                    F.struct(F.lit("length").alias("model"), (F.length("text") < 1000).cast("int").alias("pred")))
    x = p.select("label", "keyword", F.explode(preds).alias("m")).select("label", "keyword", "m.model", "m.pred")
    return mt.prf1_by_slice(x, {"keyword": F.col("keyword")}, by=("model",))


@register("prediction_distribution", with_ctes(P_SQL, X_SQL, body="SELECT pred, count(*) AS n FROM X GROUP BY pred"))
def q_pred_dist(spark, d):
    return mt.prediction_distribution(_scored(spark, d))


@register("balanced_class_weights", with_ctes(P_SQL, "C AS (SELECT label, count(*) AS n FROM P GROUP BY label)", body="""
SELECT label, n, (SELECT sum(n) FROM C) / ((SELECT count(*) FROM C) * n) AS weight FROM C"""))
def q_weights(spark, d):
    return mt.balanced_class_weights(paragraphs(spark, d))


# ---------------------------------------------------------------- spans

_EV_CASE = "CASE category " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(EVENT_CATEGORIES)) + " END"
SC_SQL = f"SC AS (SELECT *, {_EV_CASE} AS category_id FROM S)"
_KEYS = "par_id, art_id, text, keyword, country"


def _span_ids(spark, d):
    return spans(spark, d).withColumn("category_id", cat.category_id("category", EVENT_CATEGORIES))


def _flags_sql(cond="true"):
    return "[" + ", ".join(f"max(CASE WHEN category_id = {c} AND {cond} THEN 1 ELSE 0 END)"
                           for c in range(NUM_CATEGORIES)) + "]"


@register("span_to_multihot", with_ctes(S_SQL, SC_SQL, body=f"""
SELECT {_KEYS}, count(*) AS n_spans,
       array_to_string(list_transform({_flags_sql()}, lambda v: CAST(v AS VARCHAR)), ',') AS label
FROM SC GROUP BY {_KEYS}"""))
def q_multihot(spark, d):
    m = cat.span_to_multihot(_span_ids(spark, d), NUM_CATEGORIES)
    return m.withColumn("label", lb.render_ints("label"))


@register("span_to_ids", with_ctes(S_SQL, SC_SQL,
                                   f"F AS (SELECT {_KEYS}, category_id, min(row_idx) AS first FROM SC GROUP BY ALL)",
                                   body=f"""
SELECT {_KEYS}, string_agg(CAST(category_id AS VARCHAR), ',' ORDER BY first) AS label FROM F GROUP BY {_KEYS}"""))
def q_span_ids(spark, d):
    m = cat.span_to_ids(_span_ids(spark, d), NUM_CATEGORIES)
    return m.withColumn("label", lb.render_ints("label"))


# A "model" for the multi-label metric fixture: fires on high-value events.
HIGH_VALUE = 35.0


@register("multilabel_prf1", with_ctes(S_SQL, SC_SQL, f"""
V AS (SELECT {_KEYS}, {_flags_sql()} AS gold, {_flags_sql(f'value >= {HIGH_VALUE}')} AS pred
      FROM SC GROUP BY ALL)""", f"""
Z AS (SELECT c.range AS class_id, gold[c.range + 1] AS g, pred[c.range + 1] AS p
      FROM V, range({NUM_CATEGORIES}) c)""", f"""
C AS (SELECT class_id, {sql_counts('g', 'p', with_tn=False)}, count(*) FILTER (WHERE g = 1) AS support
      FROM Z GROUP BY class_id)""", body=f"""
SELECT CAST(class_id AS INTEGER) AS class_id, support, tp, fp, fn, {sql_prf()} FROM C"""))
def q_multilabel_prf1(spark, d):
    s = _span_ids(spark, d)
    # Gold and predicted vectors from one aggregate.
    flags = lambda cond: F.array(*[F.max(F.when((F.col("category_id") == c) & cond, 1).otherwise(0))
                                   for c in range(NUM_CATEGORIES)])
    both = s.groupBy(*cat.SPAN_KEY).agg(flags(F.lit(True)).alias("gold"), flags(F.col("value") >= HIGH_VALUE).alias("pred"))
    return mt.multilabel_prf1(both)


# ---------------------------------------------------------------- manifest labels

@register("parse_category_list", with_ctes(M_SQL, body="""
SELECT par_id, array_to_string(list_transform(CAST(label AS INTEGER[]), lambda v: CAST(v AS VARCHAR)), ',') AS label,
       CAST(list_sum(CAST(label AS INTEGER[])) AS INTEGER) AS n_active FROM M"""))
def q_parse_cats(spark, d):
    m = manifest(spark, d).select("par_id", lb.parse_category_list("label").alias("v"))
    return m.select("par_id", lb.render_ints("v").alias("label"),
                    F.aggregate("v", F.lit(0), lambda a, x: a + x).alias("n_active"))


@register("any_category", with_ctes(M_SQL, body="""
SELECT par_id, list_sum(CAST(label AS INTEGER[])) > 0 AS has_any FROM M"""))
def q_any_cat(spark, d):
    m = manifest(spark, d)
    return m.select("par_id", lb.any_category(lb.parse_category_list("label")).alias("has_any"))


@register("span_to_multihot_observed", with_ctes(S_SQL, SC_SQL, f"""
V AS (SELECT {_KEYS}, {_flags_sql()} AS v FROM SC GROUP BY {_KEYS})""", f"""
MX AS (SELECT [{", ".join(f"max(v[{c + 1}])" for c in range(NUM_CATEGORIES))}] AS mx FROM V)""", f"""
O AS (SELECT list_filter(range(0, {NUM_CATEGORIES}), lambda c: mx[c + 1] = 1) AS keep FROM MX)""", body=f"""
SELECT {_KEYS}, array_to_string(list_transform(keep, lambda c: CAST(v[c + 1] AS VARCHAR)), ',') AS label FROM V, O"""))
def q_multihot_observed(spark, d):
    """One-hot width from the classes present (a binarizer fitted without a class list)."""
    m = cat.span_to_multihot(_span_ids(spark, d), NUM_CATEGORIES).drop("n_spans")
    return cat.observed_classes(m, NUM_CATEGORIES).withColumn("label", lb.render_ints("label"))
