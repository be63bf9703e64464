"""Registered queries: word-statistics classifiers and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import classify as cl
from parlance.operators import labels as lb
from parlance.operators import metrics as mt
from parlance.operators import sampling as sp
from parlance.operators import splits as sl
from parlance.plans.fixtures import (L_SQL, M_SQL, NUM_CATEGORIES, P_SQL, U_SQL, logits, manifest, messy_manifest, paragraphs,
                                     sql_pick, sql_tokens, unlabelled, with_ctes)
from parlance.plans.q_augment import AUG_ROUNDS, _aug_sql, augmented, train_split
from parlance.plans.q_metrics import sql_counts, sql_prf
from parlance.plans.q_splits import BASE, MESSY, ML_SQL, SMALL_SHOT, _downsample_sql, _split
from parlance.plans.ordering import materialize
from parlance.plans.registry import register

R6 = 6


def nb_sql(train: str, docs: str, p: str, doc_cols: str = "par_id, label", key: str = "m_idx") -> list[str]:
    """CTEs ``{p}LO`` (word model), ``{p}SC`` (key, doc_cols, score)."""
    return [
        f"{p}TW AS (SELECT label, unnest({sql_tokens('lower(text)')}) AS word FROM {train})",
        f"{p}NB AS (SELECT word, count(*) FILTER (WHERE label = 1) AS c1, count(*) FILTER (WHERE label = 0) AS c0 "
        f"FROM {p}TW GROUP BY word)",
        f"{p}K AS (SELECT sum(c1) AS n1, sum(c0) AS n0, count(*) AS v FROM {p}NB)",
        f"{p}LO AS (SELECT word, c1, c0, ln((c1 + 1) / (n1 + v)) - ln((c0 + 1) / (n0 + v)) AS lo FROM {p}NB, {p}K)",
        f"{p}PR AS (SELECT ln((count(*) FILTER (WHERE label = 1) + 1) / (count(*) FILTER (WHERE label = 0) + 1)) AS prior "
        f"FROM {train})",
        f"{p}DW AS (SELECT {key}, word, count(*) AS tf FROM (SELECT {key}, unnest({sql_tokens('lower(text)')}) AS word "
        f"FROM {docs}) GROUP BY ALL)",
        f"{p}DS AS (SELECT {key}, sum(tf * lo) AS s FROM {p}DW JOIN {p}LO USING (word) GROUP BY {key})",
        f"{p}SC AS (SELECT D.{key}, {doc_cols}, (SELECT prior FROM {p}PR) + coalesce(S.s, 0.0) AS score "
        f"FROM {docs} D LEFT JOIN {p}DS S USING ({key}))",
    ]


DS_SQL = f"TRD AS (SELECT * FROM TR WHERE par_id IN (SELECT par_id FROM ({_downsample_sql('TR', 2)})))"


def _train_down(spark, d):
    """The downsampled train split, written once: training, priors and
    the class counts all read it."""
    tr = _split(spark, d, "train")
    return materialize(sp.downsample_negatives(tr, sp.FINE_TUNE_RATIO, order="m_idx"))


@register("nb_word_scores", with_ctes(*BASE, DS_SQL, *nb_sql("TRD", "DV", "NB1"), body=f"""
SELECT word, c1, c0, round(lo, 9) AS lo FROM NB1LO"""))
def q_nb_words(spark, d):
    m = cl.nb_word_scores(_train_down(spark, d))
    return m.withColumn("lo", F.round("lo", 9))


def _scored_sql(p):
    return f"SELECT par_id, label, round(score, {R6}) AS score, CAST(score > 0 AS INTEGER) AS pred FROM {p}SC"


def _round_score(df):
    return df.select("par_id", "label", F.round("score", R6).alias("score"), "pred")


@register("classify_binary", with_ctes(*BASE, DS_SQL, *nb_sql("TRD", "DV", "NB1"), body=_scored_sql("NB1")))
def q_classify(spark, d):
    return _round_score(cl.classify_binary(_train_down(spark, d), _split(spark, d, "dev")))


@register("classify_binary_biased", with_ctes(*BASE, *nb_sql("TR", "DV", "NB1"), body=_scored_sql("NB1")))
def q_classify_biased(spark, d):
    train = materialize(_split(spark, d, "train").select("text", "label"))
    return _round_score(cl.classify_binary(train, _split(spark, d, "dev")))


@register("classify_binary_augmented", _aug_sql("insert", AUG_ROUNDS, _scored_sql("NB1"), more=(
    "TRA AS (SELECT text, label FROM TR UNION ALL SELECT array_to_string(t, ' ') AS text, label FROM {last})",
    *nb_sql("TRA", "DV", "NB1"))))
def q_classify_augmented(spark, d):
    """Training on the split together with the augmented copies of its positives."""
    tr = train_split(spark, d)
    union = sl.union_augmented(tr.select("text", "label"), augmented(tr).select("text", "label"))
    return _round_score(cl.classify_binary(materialize(union), _split(spark, d, "dev")))


@register("classify_binary_messy", with_ctes(*MESSY, *nb_sql("TR", "DV", "NB1"), body=f"""
SELECT m_idx, par_id, label, round(score, {R6}) AS score, CAST(score > 0 AS INTEGER) AS pred FROM NB1SC"""))
def q_classify_messy(spark, d):
    """Splits whose manifest repeats and misses ids: one score per manifest row."""
    train = materialize(_split(spark, d, "train", ids=messy_manifest).select("text", "label"))
    out = cl.classify_binary(train, _split(spark, d, "dev", ids=messy_manifest))
    return out.select("m_idx", "par_id", "label", F.round("score", R6).alias("score"), "pred")


@register("classify_binary_eval", with_ctes(*BASE, DS_SQL, *nb_sql("TRD", "DV", "NB1"),
                                            f"C AS (SELECT {sql_counts('label', 'CAST(score > 0 AS INTEGER)')} FROM NB1SC)",
                                            body=f"SELECT tp, fp, fn, tn, {sql_prf()} FROM C"))
def q_classify_eval(spark, d):
    return mt.prf1(cl.classify_binary(_train_down(spark, d), _split(spark, d, "dev")))


@register("batch_score", with_ctes(*BASE, U_SQL, DS_SQL, *nb_sql("TRD", "U", "NB1", "par_id", "row_idx"), body=f"""
SELECT par_id, row_idx, round(score, {R6}) AS score, CAST(score > 0 AS INTEGER) AS pred FROM NB1SC"""))
def q_batch_score(spark, d):
    train = _train_down(spark, d)
    out = cl.nb_score(unlabelled(spark, d), cl.nb_word_scores(train), cl.nb_prior(train), keep=("par_id",))
    return out.select("par_id", "row_idx", F.round("score", R6).alias("score"), "pred")


# ---------------------------------------------------------------- multi-label

MLD_SQL = ML_SQL.replace("ML AS", "MLD AS").replace("'train'", "'dev'")


def _ml_sql():
    ctes = [
        f"MW AS (SELECT c.range AS class_id, label[c.range + 1] AS y, unnest({sql_tokens('lower(text)')}) AS word "
        f"FROM ML, range({NUM_CATEGORIES}) c)",
        "MC AS (SELECT class_id, word, count(*) FILTER (WHERE y = 1) AS c1, count(*) FILTER (WHERE y = 0) AS c0 FROM MW GROUP BY ALL)",
        "MT AS (SELECT class_id, sum(c1) AS n1, sum(c0) AS n0 FROM MC GROUP BY class_id)",
        "MV AS (SELECT count(*) AS v FROM MC WHERE class_id = 0)",
        "MLO AS (SELECT class_id, word, ln((c1 + 1) / (n1 + v)) - ln((c0 + 1) / (n0 + v)) AS lo FROM MC JOIN MT USING (class_id), MV)",
        f"MP AS (SELECT c.range AS class_id, ln((count(*) FILTER (WHERE label[c.range + 1] = 1) + 1) / "
        f"(count(*) FILTER (WHERE label[c.range + 1] = 0) + 1)) AS prior FROM ML, range({NUM_CATEGORIES}) c GROUP BY ALL)",
        f"MDW AS (SELECT par_id, word, count(*) AS tf FROM (SELECT par_id, unnest({sql_tokens('lower(text)')}) AS word FROM MLD) GROUP BY ALL)",
        "MS AS (SELECT par_id, class_id, sum(tf * lo) AS s FROM MDW JOIN MLO USING (word) GROUP BY ALL)",
        f"MSC AS (SELECT D.par_id, D.label, c.range AS class_id, MP.prior + coalesce(MS.s, 0.0) AS score "
        f"FROM MLD D CROSS JOIN range({NUM_CATEGORIES}) c JOIN MP ON MP.class_id = c.range "
        f"LEFT JOIN MS ON MS.par_id = D.par_id AND MS.class_id = c.range)",
    ]
    return ctes


@register("classify_multilabel", with_ctes(*BASE, ML_SQL, MLD_SQL, *_ml_sql(), body="""
SELECT par_id, array_to_string(list_transform(any_value(label), lambda v: CAST(v AS VARCHAR)), ',') AS gold,
       string_agg(CAST(CAST(score > 0 AS INTEGER) AS VARCHAR), ',' ORDER BY class_id) AS pred
FROM MSC GROUP BY par_id"""))
def q_classify_ml(spark, d):
    m = manifest(spark, d)
    tr = materialize(sl.rebuild_split_multilabel(paragraphs(spark, d), m.filter(F.col("split") == "train")))
    dv = sl.rebuild_split_multilabel(paragraphs(spark, d), m.filter(F.col("split") == "dev"))
    out = cl.classify_multilabel(tr, dv, NUM_CATEGORIES)
    return out.select(
        "par_id", lb.render_ints("label").alias("gold"), lb.render_ints("pred").alias("pred"))


# ---------------------------------------------------------------- seed ensemble

def _ens_sql(n):
    ctes = []
    for s in sp.SEEDS:
        ctes.append(f"""F{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
            {sql_pick('4294967296', 'par_id', f"'{s}'")}, par_id) AS rn FROM TR) WHERE rn <= {n})""")
        ctes += nb_sql(f"F{s}", "DV", f"E{s}")
    union = " UNION ALL ".join(f"SELECT par_id, label, score FROM E{s}SC" for s in sp.SEEDS)
    ctes.append(f"ES AS ({union})")
    ctes.append("EP AS (SELECT par_id, label, count(*) AS n_models, avg(1 / (1 + exp(score))) AS p0, "
                "avg(exp(score - greatest(score, 0)) / (exp(-greatest(score, 0)) + exp(score - greatest(score, 0)))) AS p1 "
                "FROM ES GROUP BY ALL)")
    return ctes


_ENS_BODY = "SELECT par_id, label, n_models, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS pred FROM EP"


def _seed_ensemble(spark, d, n):
    tr = materialize(_split(spark, d, "train").select("m_idx", "par_id", "label", "text"))
    return cl.seed_ensemble(tr, _split(spark, d, "dev"), sp.SEEDS, n).select("par_id", "label", "n_models", "pred")


@register("seed_ensemble", with_ctes(*BASE, *_ens_sql(sp.FEW_SHOT_PER_LABEL), body=_ENS_BODY))
def q_seed_ensemble(spark, d):
    return _seed_ensemble(spark, d, sp.FEW_SHOT_PER_LABEL)


@register("seed_ensemble_small", with_ctes(*BASE, *_ens_sql(SMALL_SHOT), body=_ENS_BODY))
def q_seed_ensemble_small(spark, d):
    """Samples below the class sizes, so the five members differ."""
    return _seed_ensemble(spark, d, SMALL_SHOT)


# ---------------------------------------------------------------- verbaliser and ML pipeline

# Label words per class in the logit fixture (word j = score j): half of the words each.
VERBALIZER_ROWS = [(j // 32, f"w{j}") for j in range(64)]


@register("verbaliser_scores", with_ctes(L_SQL, body=f"""
SELECT vec_id, CAST(c AS INTEGER) AS class_id, round(avg(mall[32 * c + k]), 9) AS score
FROM L, range(0, 2) cc(c), range(1, 33) kk(k) GROUP BY vec_id, c"""))
def q_verbaliser(spark, d):
    lg = logits(spark, d)
    ws = lg.select("vec_id", F.posexplode("mall").alias("j", "score")) \
           .select("vec_id", F.concat(F.lit("w"), F.col("j").cast("string")).alias("word"), "score")
    verb = spark.createDataFrame(VERBALIZER_ROWS, "class_id int, word string")
    out = cl.verbaliser_scores(ws, verb, "vec_id")
    return out.select("vec_id", "class_id", F.round("score", 9).alias("score"))


@register("classify_ml")
def q_classify_pipeline(spark, d):
    return cl.classify_ml(_train_down(spark, d), _split(spark, d, "dev"))


@register("stream_batch_score", ORACLE_BATCH_SCORE := with_ctes(*BASE, U_SQL, DS_SQL,
                                                              *nb_sql("TRD", "U", "NB1", "par_id", "row_idx"), body=f"""
SELECT par_id, row_idx, round(score, {R6}) AS score, CAST(score > 0 AS INTEGER) AS pred FROM NB1SC"""))
def q_stream_score(spark, d):
    """batch_score over a file stream of the documents table (micro-batches
    scored against a model table frozen in the shared folder)."""
    from parlance.plans.fixtures import table
    from parlance.streaming.scoring import freeze_model, score_stream
    train = _train_down(spark, d)
    model, prior = freeze_model(spark, cl.nb_word_scores(train), cl.nb_prior(train))
    labelled = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("par_id"))
    out = score_stream(spark, f"{d}/documents.parquet", model, prior, exclude=labelled)
    res = spark.read.parquet(out)
    return res.select("par_id", "row_idx", F.round("score", R6).alias("score"), "pred")
