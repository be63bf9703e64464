"""Registered queries over model scores, losses and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.arrays import argmax, one_hot, softmax
from parlance.operators import labels as lb
from parlance.operators import metrics as mt
from parlance.operators import runs as rn
from parlance.operators import scores as sc
from parlance.plans.fixtures import L_SQL, NUM_MODELS, logits, table, with_ctes
from parlance.plans.ordering import index_by_order
from parlance.plans.q_metrics import sql_prf
from parlance.plans.registry import register

R9 = 9


def _long_sql(models=range(NUM_MODELS)):
    return " UNION ALL ".join(
        f"SELECT {m} AS model_id, vec_id, CAST(i - 1 AS INTEGER) AS class_id, m{m}[i] AS logit, gold "
        f"FROM L, range(1, 11) r(i)" for m in models)


def _stacked(spark, d):
    """Every model's vector as a row, from one scan."""
    each = F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"m{m}").alias("logits")) for m in range(NUM_MODELS)])
    return logits(spark, d).select("vec_id", "gold", F.explode(each).alias("m")).select(
        F.col("m.model_id"), "vec_id", "gold", F.col("m.logits"))


@register("stack_models", with_ctes(L_SQL, body=f"SELECT model_id, vec_id, class_id, logit FROM ({_long_sql()})"))
def q_stack(spark, d):
    return sc.explode_classes(_stacked(spark, d), ["model_id", "vec_id"], out="logit")


@register("argmax_class", with_ctes(L_SQL, body=" UNION ALL ".join(
    f"SELECT {m} AS model_id, vec_id, CAST(list_position(m{m}, list_max(m{m})) - 1 AS INTEGER) AS pred FROM L"
    for m in range(NUM_MODELS))))
def q_argmax(spark, d):
    return _stacked(spark, d).select("model_id", "vec_id", argmax("logits").alias("pred"))


SOFT_SQL = f"""SM AS (SELECT model_id, vec_id, class_id, gold,
       exp(logit - max(logit) OVER (PARTITION BY model_id, vec_id))
       / sum(exp(logit - max(logit) OVER (PARTITION BY model_id, vec_id))) OVER (PARTITION BY model_id, vec_id) AS p
  FROM ({_long_sql()}))"""


@register("softmax_scores", with_ctes(L_SQL, body=f"""
SELECT vec_id, CAST(i - 1 AS INTEGER) AS class_id,
       round(exp(mall[i] - list_max(mall)) / list_sum(list_transform(mall, lambda v: exp(v - list_max(mall)))), {R9}) AS prob
FROM L, range(1, 65) r(i)"""))
def q_softmax(spark, d):
    lg = logits(spark, d)
    s = sc.explode_classes(lg.select("vec_id", softmax("mall").alias("p")), ["vec_id"], "p", "prob")
    return s.withColumn("prob", F.round("prob", R9))


@register("ensemble_vote", with_ctes(L_SQL, f"""
S AS (SELECT m, vec_id, gold, i - 1 AS class_id,
             exp(x[i] - list_max(x)) / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) AS p
      FROM ({" UNION ALL ".join(f"SELECT {m} AS m, vec_id, gold, m{m} AS x FROM L" for m in range(NUM_MODELS))}), range(1, 11) r(i))""",
                                     "A AS (SELECT vec_id, gold, class_id, avg(p) AS p, count(*) AS n_models FROM S GROUP BY ALL)",
                                     body="""
SELECT vec_id, gold, n_models, CAST(class_id AS INTEGER) AS pred FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_id) AS rn FROM A) WHERE rn = 1"""))
def q_ensemble(spark, d):
    return sc.ensemble_vote(_stacked(spark, d), ["vec_id", "gold"], 10).select("vec_id", "gold", "n_models", "pred")


@register("top_k_classes", with_ctes(L_SQL, f"""
S AS (SELECT vec_id, i - 1 AS class_id,
             exp(mall[i] - list_max(mall)) / list_sum(list_transform(mall, lambda v: exp(v - list_max(mall)))) AS p
      FROM L, range(1, 65) r(i))""", body=f"""
SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(class_id AS INTEGER) AS class_id, round(p, {R9}) AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_id) AS rank FROM S) WHERE rank <= 5"""))
def q_topk_classes(spark, d):
    lg = logits(spark, d).select("vec_id", sc.top_k_classes(softmax("mall"), 5).alias("t"))
    x = lg.select("vec_id", F.posexplode("t").alias("rank", "c"))
    return x.select("vec_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("c.class_id").cast("int").alias("class_id"),
                    F.round("c.score", R9).alias("prob"))


LOGP = "(mall[gold + 1] - list_max(mall) - ln(list_sum(list_transform(mall, lambda v: exp(v - list_max(mall))))))"


@register("cross_entropy", with_ctes(L_SQL, f"""
CE AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, -{LOGP} AS loss FROM L)""",
                                     "B AS (SELECT pos // 32 AS b, avg(loss) AS bl, count(*) AS bn, sum(loss) AS bs FROM CE GROUP BY ALL)",
                                     body=f"""
SELECT CAST(sum(bn) AS BIGINT) AS n_rows, count(*) AS n_batches, round(sum(bs) / sum(bn), {R9}) AS loss_row_mean,
       round(avg(bl), {R9}) AS loss_batch_mean FROM B"""))
def q_ce(spark, d):
    lg = index_by_order(logits(spark, d).select("vec_id", "gold", F.col("mall").alias("logits")), ["vec_id"], "pos")
    out = sc.cross_entropy(lg, "pos", 32)
    return out.select("n_rows", "n_batches", F.round("loss_row_mean", R9).alias("loss_row_mean"),
                      F.round("loss_batch_mean", R9).alias("loss_batch_mean"))


@register("weighted_cross_entropy", with_ctes(L_SQL, """
W AS (SELECT gold, (SELECT count(*) FROM L) / ((SELECT count(DISTINCT gold) FROM L) * count(*)) AS weight FROM L GROUP BY gold)""",
                                              f"CE AS (SELECT gold, -{LOGP} AS loss FROM L)", body=f"""
SELECT count(*) AS n_rows, round(sum(weight * loss) / sum(weight), {R9}) AS loss FROM CE JOIN W USING (gold)"""))
def q_wce(spark, d):
    lg = logits(spark, d).select("vec_id", "gold", F.col("mall").alias("logits"))
    w = mt.balanced_class_weights(lg, "gold").select("gold", "weight")
    out = sc.weighted_cross_entropy(lg, w)
    return out.select("n_rows", F.round("loss", R9).alias("loss"))


FOCAL_ALPHA = 0.5


@register("focal_loss", with_ctes(L_SQL, f"""
FL AS (SELECT -{FOCAL_ALPHA} * pow(1 - exp({LOGP}), 2.0) * {LOGP} AS loss FROM L)""", body=f"""
SELECT count(*) AS n_rows, round(avg(loss), {R9}) AS loss_mean, round(sum(loss), {R9}) AS loss_sum FROM FL"""))
def q_focal(spark, d):
    lg = logits(spark, d).select("vec_id", "gold", F.col("mall").alias("logits"))
    s = sc.loss_summary(sc.focal_loss_rows(lg, FOCAL_ALPHA, 2.0))
    return s.select("n_rows", F.round("loss_mean", R9).alias("loss_mean"), F.round("loss_sum", R9).alias("loss_sum"))


def _lsig(x):
    return f"(least({x}, 0.0) - ln(1 + exp(-abs({x}))))"


@register("binary_focal_loss", with_ctes(L_SQL, f"""
BX AS (SELECT mall[i] AS x, CAST(gold = i - 1 AS INTEGER)::DOUBLE AS y FROM L, range(1, 65) r(i))""", f"""
FL AS (SELECT -0.25 * pow(exp({_lsig('-x')}), 2.0) * y * {_lsig('x')}
              - (1 - 0.25) * pow(exp({_lsig('x')}), 2.0) * (1 - y) * {_lsig('-x')} AS loss FROM BX)""", body=f"""
SELECT count(*) AS n_rows, round(avg(loss), {R9}) AS loss_mean, round(sum(loss), {R9}) AS loss_sum FROM FL"""))
def q_bfocal(spark, d):
    lg = sc.explode_classes(logits(spark, d).select("gold", "mall"), ["gold"], "mall", "x")
    lg = lg.select("x", (F.col("gold") == F.col("class_id")).cast("int").alias("y"))
    s = sc.loss_summary(sc.binary_focal_loss_rows(lg, "x", "y"))
    return s.select("n_rows", F.round("loss_mean", R9).alias("loss_mean"), F.round("loss_sum", R9).alias("loss_sum"))


@register("one_hot_label", with_ctes(L_SQL, body="""
SELECT vec_id, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i = gold THEN '1' ELSE '0' END), ',') AS one_hot
FROM L"""))
def q_one_hot(spark, d):
    return logits(spark, d).select("vec_id", lb.render_ints(one_hot("gold", 10)).alias("one_hot"))


# ---------------------------------------------------------------- run bookkeeping

def _epoch_prf(x):
    g, p = F.col("label") == 1, F.col("pred") == 1
    c = x.groupBy("run", "epoch").agg(F.count(F.when(g & p, 1)).alias("tp"), F.count(F.when(~g & p, 1)).alias("fp"),
                                      F.count(F.when(g & ~p, 1)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("run", "epoch", *mt._prf_cols(tp, tp + fp, tp + fn))


EM_SQL = f"""EM AS (SELECT run, epoch, {sql_prf()} FROM (
  SELECT user_id AS run, CAST(dayofmonth(ts) - 1 AS INTEGER) AS epoch,
         count(*) FILTER (WHERE event_type = 'purchase' AND value >= 35.0) AS tp,
         count(*) FILTER (WHERE event_type <> 'purchase' AND value >= 35.0) AS fp,
         count(*) FILTER (WHERE event_type = 'purchase' AND value < 35.0) AS fn
  FROM events GROUP BY ALL))"""

BC_CTES = (EM_SQL, """
X1 AS (SELECT *, f1 > coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS imp FROM EM)""", """
X2 AS (SELECT *, sum(CAST(imp AS INTEGER)) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM X1)""", """
X3 AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS streak FROM X2)""", """
X4 AS (SELECT *, min(CASE WHEN streak >= 5 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM X3)""", """
BC AS (SELECT run, count(*) AS n_epochs, max(epoch) FILTER (WHERE imp) AS best_epoch, max(f1) FILTER (WHERE imp) AS best_f1,
              arg_max(precision, epoch) FILTER (WHERE imp) AS best_precision, arg_max(recall, epoch) FILTER (WHERE imp) AS best_recall,
              any_value(stop_epoch) AS stop_epoch
       FROM X4 WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY run)""")


@register("best_checkpoint", with_ctes(*BC_CTES, body="SELECT * FROM BC"))
def q_best(spark, d):
    return rn.best_checkpoint(_epoch_prf_from(spark, d), patience=rn.PATIENCE)


def _epoch_prf_from(spark, d):
    ev = table(spark, d, "events")
    x = ev.select(F.col("user_id").alias("run"), (F.dayofmonth("ts") - 1).alias("epoch"),
                  (F.col("event_type") == "purchase").cast("int").alias("label"),
                  (F.col("value") >= 35.0).cast("int").alias("pred"))
    return _epoch_prf(x)


def _two(x):
    return f"printf('%.2f', {x})"


LB_NAME_SQL = (f"'events_' || CAST(run AS VARCHAR) || '_1e-05_' || CAST(best_epoch AS VARCHAR) || '_' || {_two('best_f1')}"
               f" || '_' || {_two('best_precision')} || '_' || {_two('best_recall')} || '.pt'")


@register("leaderboard", with_ctes(*BC_CTES, f"N AS (SELECT {LB_NAME_SQL} AS name FROM BC WHERE best_epoch IS NOT NULL)",
                                   """
PZ AS (SELECT name, split_part(name, '_', 1) AS model, CAST(split_part(name, '_', 2) AS INTEGER) AS seed,
              split_part(name, '_', 3) AS lr, CAST(split_part(name, '_', 4) AS INTEGER) AS epoch,
              CAST(split_part(name, '_', 5) AS DOUBLE) AS f1, CAST(split_part(name, '_', 6) AS DOUBLE) AS precision,
              CAST(replace(split_part(name, '_', 7), '.pt', '') AS DOUBLE) AS recall FROM N)""", body="""
SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, precision DESC, name) AS INTEGER) AS rank FROM PZ"""))
def q_leaderboard(spark, d):
    bc = rn.best_checkpoint(_epoch_prf_from(spark, d)).filter(F.col("best_epoch").isNotNull())
    names = bc.select(rn.run_name(F.lit("events"), F.col("run"), F.lit("1e-05"), F.col("best_epoch"),
                                  F.col("best_f1"), F.col("best_precision"), F.col("best_recall")).alias("name"))
    return rn.leaderboard(names)


@register("focal_loss_rows", with_ctes(L_SQL, body=f"""
SELECT vec_id, round(-{FOCAL_ALPHA} * pow(1 - exp({LOGP}), 2.0) * {LOGP}, {R9}) AS loss FROM L"""))
def q_focal_rows(spark, d):
    lg = logits(spark, d).select("vec_id", "gold", F.col("mall").alias("logits"))
    rows = sc.reduce_loss(sc.focal_loss_rows(lg, FOCAL_ALPHA, 2.0), "none")
    return rows.select("vec_id", F.round("loss", R9).alias("loss"))
