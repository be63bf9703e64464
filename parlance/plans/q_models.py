"""Registered queries: the caller's own scorer, label words at the mask of a prompt, the ML pipeline's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import classify as cl
from parlance.operators import labels as lb
from parlance.operators import mask_model as mm
from parlance.operators import metrics as mt
from parlance.operators import prompts as pm
from parlance.operators import scorer as us
from parlance.operators import splits as sl
from parlance.plans.fixtures import NUM_CATEGORIES, manifest, paragraphs, sql_tokens, unlabelled, with_ctes
from parlance.plans.ordering import fetch_one, materialize
from parlance.plans.q_classify import MLD_SQL, ORACLE_BATCH_SCORE, R6, _train_down
from parlance.plans.q_metrics import sql_counts, sql_prf
from parlance.plans.q_splits import BASE, ML_SQL, _split
from parlance.plans.registry import register


@register("batch_score_user", ORACLE_BATCH_SCORE)
def q_batch_score_user(spark, d):
    """``batch_score`` through the hook for the caller's model: a NumPy scorer in the workers, the same scores."""
    train = _train_down(spark, d)
    model = materialize(cl.nb_word_scores(train).select("word", "lo"))
    prior = fetch_one(spark.range(1), p=F.max(cl.nb_prior(train)))["p"]
    texts = unlabelled(spark, d).select("row_idx", "par_id", F.lower("text").alias("text"))
    out = us.user_scores(texts, us.word_table_scorer(model, prior), keep=("par_id",))
    return out.select("par_id", "row_idx", F.round("score", R6).alias("score"), (F.col("score") > 0).cast("int").alias("pred"))


# ---------------------------------------------------------------- label words at the mask

def _pairs_sql(src: str) -> str:
    toks = sql_tokens("lower(text || ' It was ')")
    return (f"SELECT m_idx, label, t[i] AS a, t[i + 1] AS b FROM (SELECT m_idx, label, t, unnest(range(1, len(t))) AS i "
            f"FROM (SELECT m_idx, label, {toks} AS t FROM {src}))")


_P1 = "(coalesce(C1.m{w}, 0) + {mu} * p{w}) / (coalesce(C1.m0 + C1.m1, 0) + {mu})"
_P2 = "(coalesce(C2.n{w}, 0) + {mu} * ({p1})) / (coalesce(C2.n0 + C2.n1, 0) + {mu})"


def _vote(w: int) -> str:
    p1 = _P1.format(w=w, mu=mm.MU)
    return f"ln(any_value(p{w})) + sum(ln(({_P2.format(w=w, mu=mm.MU, p1=p1)}) / p{w})) AS s{w}"


MASK_CTES = (
    f"TP AS ({_pairs_sql('TR')})", f"DP AS ({_pairs_sql('DV')})",
    "C2 AS (SELECT a, b, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM TP GROUP BY ALL)",
    "C1 AS (SELECT b, count(*) FILTER (label = 0) AS m0, count(*) FILTER (label = 1) AS m1 FROM TP GROUP BY ALL)",
    "P0 AS (SELECT (count(*) FILTER (label = 0) + 1) / (count(*) + 2) AS p0, (count(*) FILTER (label = 1) + 1) / (count(*) + 2) AS p1 FROM TR)",
    f"MS AS (SELECT m_idx, {_vote(0)}, {_vote(1)} FROM DP LEFT JOIN C2 ON DP.a = C2.a AND DP.b = C2.b LEFT JOIN C1 ON DP.b = C1.b, P0 GROUP BY m_idx)")


def _mask_scores(spark, d):
    """Prompts of the dev split scored by a model of the training split's prompts."""
    tr = pm.cloze_prompt(_split(spark, d, "train")).select("prompt", lb.verbalise("label").alias("answer"))
    model = mm.train_mask_model(materialize(tr), [lb.LABEL_WORDS[c] for c in sorted(lb.LABEL_WORDS)])
    dev = pm.cloze_prompt(_split(spark, d, "dev"))
    return mm.mask_word_scores(dev, model, keep=("par_id", "label"))


def _class_scores(spark, d):
    verbalizer = spark.createDataFrame(list(lb.LABEL_WORDS.items()), "class_id int, word string")
    return cl.verbaliser_scores(_mask_scores(spark, d), verbalizer, "m_idx")


@register("mask_word_scores", with_ctes(*BASE, *MASK_CTES, body=f"""
SELECT DV.m_idx, DV.par_id, w AS word, round(CASE w WHEN '{lb.LABEL_WORDS[0]}' THEN s0 ELSE s1 END, {R6}) AS score
FROM MS JOIN DV USING (m_idx), (VALUES ('{lb.LABEL_WORDS[0]}'), ('{lb.LABEL_WORDS[1]}')) t(w)"""))
def q_mask_words(spark, d):
    return _mask_scores(spark, d).select("m_idx", "par_id", "word", F.round("score", R6).alias("score"))


@register("verbaliser_prompt", with_ctes(*BASE, *MASK_CTES, body="""
SELECT m_idx, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS pred FROM MS"""))
def q_verbaliser_prompt(spark, d):
    """Prompt, scores at the mask, mean per class, argmax."""
    return mm.predicted_class(_class_scores(spark, d))


@register("verbaliser_prompt_eval", with_ctes(
    *BASE, *MASK_CTES, f"""C AS (SELECT {sql_counts('label', 'pred')} FROM (
        SELECT label, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS pred FROM MS JOIN DV USING (m_idx)))""",
    body=f"SELECT tp, fp, fn, tn, {sql_prf()} FROM C"))
def q_verbaliser_eval(spark, d):
    pred = mm.predicted_class(_class_scores(spark, d))
    return mt.prf1(_split(spark, d, "dev").select("m_idx", "label").join(pred, "m_idx"))


# ---------------------------------------------------------------- ML pipeline

@register("classify_ml_rows", with_ctes(*BASE, body="SELECT par_id, label, true AS is_class FROM DV"))
def q_classify_ml_rows(spark, d):
    """What is certain of ``classify_ml``: one prediction of a class per row, labels as they were (vocabulary of its own words)."""
    out = cl.classify_ml(_train_down(spark, d), _split(spark, d, "dev"), num_features=1 << 16, vocabulary=True)
    return out.select("par_id", "label", F.col("pred").isin(0, 1).alias("is_class"))


@register("classify_ml_multilabel_rows", with_ctes(*BASE, ML_SQL, MLD_SQL, body="""
SELECT par_id, array_to_string(list_transform(label, lambda v: CAST(v AS VARCHAR)), ',') AS gold, 7 AS width, true AS all_classes FROM MLD"""))
def q_classify_ml_multilabel_rows(spark, d):
    """What is certain of the learnt seven-way model: one vector of seven zeros and ones per row, labels as they were."""
    m = manifest(spark, d)
    tr = materialize(sl.rebuild_split_multilabel(paragraphs(spark, d), m.filter(F.col("split") == "train")))
    dv = sl.rebuild_split_multilabel(paragraphs(spark, d), m.filter(F.col("split") == "dev"))
    out = cl.classify_ml_multilabel(tr, dv, NUM_CATEGORIES, num_features=1 << 16)
    return out.select("par_id", lb.render_ints("label").alias("gold"), F.size("pred").alias("width"),
                      F.forall("pred", lambda v: v.isin(0, 1)).alias("all_classes"))
