"""Registered queries: prompts, truncation, vocabulary, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.operators import encode as en
from parlance.operators import prompts as pm
from parlance.operators import sampling as sp
from parlance.plans.fixtures import P_SQL, U_SQL, manifest, messy_manifest, paragraphs, sql_pick, sql_tokens, unlabelled, with_ctes
from parlance.plans.q_splits import BASE, MESSY, _demo_sql, _split
from parlance.plans.registry import register

PCL_SQL = f"(['patronizing', 'condescending'][{sql_pick('2', 'par_id', chr(39) + '42' + chr(39), chr(39) + 'pcl' + chr(39))} + 1])"


@register("prompt_pair", with_ctes(*BASE, body=f"""
SELECT par_id, text || ' </s> <mask> , this paragraph is ' || {PCL_SQL} || ' for ' || keyword || ' .' AS prompt,
       text || ' </s> ' || CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END || ' , this paragraph is ' || {PCL_SQL}
            || ' for ' || keyword || ' .' AS target
FROM TR"""))
def q_prompt_pair(spark, d):
    return pm.prompt_pair(_split(spark, d, "train")).select("par_id", "prompt", "target")


@register("prompt_test", with_ctes(U_SQL, body=f"""
SELECT par_id, text || ' </s> <mask> , this paragraph is not ' || {PCL_SQL} || ' for ' || keyword || ' .' AS prompt FROM U"""))
def q_prompt_test(spark, d):
    return pm.prompt_test(unlabelled(spark, d)).select("par_id", "prompt")


@register("cloze_prompt", with_ctes(*BASE, body="""
SELECT par_id, label, keyword, country, text || ' It was <mask> .' AS prompt FROM DV"""))
def q_cloze(spark, d):
    return pm.cloze_prompt(_split(spark, d, "dev")).select("par_id", "label", "meta.keyword", "meta.country", "prompt")


def _incontext_sql():
    base = _demo_sql(42)
    head, _, _ = base.rpartition("\nSELECT DV.par_id")
    return head + """
SELECT DV.par_id, DV.text || ' It was <mask> </s> ' || POS.pos_text || ' It was patronizing . </s> ' || NEG.neg_text
       || ' It was respectful .' AS prompt FROM DV
""" + base.rpartition("FROM DV")[2]


@register("incontext_prompt", _incontext_sql())
def q_incontext(spark, d):
    tr = _split(spark, d, "train")
    dv = _split(spark, d, "dev").select("par_id", "text")
    x = sp.attach_demonstrations(dv, tr, seed=42, order="m_idx")
    return pm.incontext_prompt(x).select("par_id", "prompt")


@register("truncate_head", with_ctes(P_SQL, f"T AS (SELECT par_id, {sql_tokens('text')} AS t FROM P)", body="""
SELECT par_id, len(t[1:128]) AS n_kept, array_to_string(t[1:128], ' ') AS text_tail,
       array_to_string(CASE WHEN len(t) > 128 THEN t[len(t) - 127:len(t)] ELSE t END, ' ') AS text_head FROM T"""))
def q_truncate(spark, d):
    p = paragraphs(spark, d).select("par_id", tokens("text").alias("t"))
    return p.select("par_id", F.size(en.truncate("t", 128, "tail")).alias("n_kept"),
                    F.array_join(en.truncate("t", 128, "tail"), " ").alias("text_tail"),
                    F.array_join(en.truncate("t", 128, "head"), " ").alias("text_head"))


V_SQL = f"""V AS (SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) + 3 AS INTEGER) AS id FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest({sql_tokens('lower(text)')}) AS word FROM TR) GROUP BY word))"""


@register("build_vocab", with_ctes(*BASE, V_SQL, body="SELECT word, n, id FROM V"))
def q_vocab(spark, d):
    return en.build_vocab(_split(spark, d, "train"))


ENC_CTES = (V_SQL, f"""
ET AS (SELECT m_idx, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS word FROM (
  SELECT m_idx, {sql_tokens('lower(text)')}[1:126] AS t FROM DV))""", """
EI AS (SELECT m_idx, i, coalesce(V.id, 3) AS id FROM ET LEFT JOIN V USING (word))""", """
ES AS (SELECT D.m_idx, D.par_id, list_concat([1], coalesce(list(EI.id ORDER BY EI.i) FILTER (WHERE EI.id IS NOT NULL), []), [2]) AS q
       FROM DV D LEFT JOIN EI USING (m_idx) GROUP BY D.m_idx, D.par_id)""", "EW AS (SELECT max(len(q)) AS w FROM ES)")


_ENC_BODY = """
SELECT m_idx, par_id, array_to_string(list_concat(q, list_transform(range(w - len(q)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(list_transform(range(len(q)), lambda x: 1), list_transform(range(w - len(q)), lambda x: 0)), ',')
         AS attention_mask
FROM ES, EW"""


def _encoded(spark, d, ids):
    vocab = en.build_vocab(_split(spark, d, "train", ids=ids))
    return en.encode_pad(_split(spark, d, "dev", ids=ids), vocab), vocab


def _as_text(e):
    as_s = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return e.select("m_idx", "par_id", as_s("input_ids").alias("input_ids"), as_s("attention_mask").alias("attention_mask"))


@register("encode_pad", with_ctes(*BASE, *ENC_CTES, body=_ENC_BODY))
def q_encode(spark, d):
    return _as_text(_encoded(spark, d, manifest)[0])


@register("encode_pad_messy", with_ctes(*MESSY, *ENC_CTES, body=_ENC_BODY))
def q_encode_messy(spark, d):
    """A manifest that repeats and misses ids: one sequence per manifest row."""
    return _as_text(_encoded(spark, d, messy_manifest)[0])


_DEC_BODY = """
SELECT D.m_idx, D.par_id, coalesce(string_agg(CASE WHEN EI.id = 3 THEN '<unk>' ELSE V.word END, ' ' ORDER BY EI.i), '') AS text
FROM DV D LEFT JOIN EI USING (m_idx) LEFT JOIN V ON V.id = EI.id GROUP BY D.m_idx, D.par_id"""


@register("decode_ids", with_ctes(*BASE, *ENC_CTES, body=_DEC_BODY))
def q_decode(spark, d):
    return en.decode_ids(*_encoded(spark, d, manifest))


@register("decode_ids_messy", with_ctes(*MESSY, *ENC_CTES, body=_DEC_BODY))
def q_decode_messy(spark, d):
    return en.decode_ids(*_encoded(spark, d, messy_manifest))


# ---------------------------------------------------------------- prompts of the other sides

def _incontext_train_sql():
    sql = _incontext_sql()
    head, _, tail = sql.rpartition("\nSELECT DV.par_id")
    return head + ("\nSELECT DV.par_id" + tail).replace("DV.", "TR.").replace("FROM DV", "FROM TR")


@register("incontext_prompt_train", _incontext_train_sql())
def q_incontext_train(spark, d):
    """Training rows with demonstrations from their own split (self-draws allowed)."""
    tr = _split(spark, d, "train")
    x = sp.attach_demonstrations(tr.select("par_id", "text"), tr, seed=42, order="m_idx")
    return pm.incontext_prompt(x).select("par_id", "prompt")


def _incontext_test_sql():
    sql = _incontext_train_sql().replace("WITH ", f"WITH {U_SQL},\n", 1)
    head, _, tail = sql.rpartition("\nSELECT TR.par_id")
    return head + ("\nSELECT TR.par_id" + tail).replace("TR.", "U.").replace("FROM TR", "FROM U")


@register("incontext_prompt_test", _incontext_test_sql())
def q_incontext_test(spark, d):
    """Unlabelled rows with demonstrations from the training split."""
    x = sp.attach_demonstrations(unlabelled(spark, d).select("par_id", "text"), _split(spark, d, "train"), seed=42, order="m_idx")
    return pm.incontext_prompt(x).select("par_id", "prompt")


@register("cloze_prompt_test", with_ctes(U_SQL, body="""
SELECT par_id, keyword, country, text || ' It was <mask> .' AS prompt FROM U"""))
def q_cloze_test(spark, d):
    u = unlabelled(spark, d).withColumn("label", F.lit(None).cast("int"))
    return pm.cloze_prompt(u).select("par_id", "meta.keyword", "meta.country", "prompt")
