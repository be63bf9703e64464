"""Registered queries: label projections, filters and corpus profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import lower_tokens, token_count
from parlance.operators import labels as lb
from parlance.operators import profile as pr
from parlance.plans.fixtures import P_SQL, paragraphs, sql_token_count, sql_tokens, with_ctes
from parlance.plans.ordering import materialize
from parlance.plans.registry import register

PT = f"""PT AS (SELECT *, {sql_token_count('text')} AS n_tokens FROM P)"""


def _pt(spark, d):
    return pr.with_token_count(paragraphs(spark, d, spread_text=True))


@register("binarise_label", with_ctes(P_SQL, body="""
SELECT par_id, orig_label, CASE WHEN orig_label IN ('0', '1') THEN 0 ELSE 1 END AS label FROM P"""))
def q_binarise(spark, d):
    p = paragraphs(spark, d)
    return p.select("par_id", "orig_label", lb.binarise("orig_label").alias("label"))


@register("filter_class", with_ctes(P_SQL, body="""
SELECT par_id, keyword, country, label FROM P WHERE label = 1"""))
def q_filter_class(spark, d):
    return lb.filter_class(paragraphs(spark, d), 1).select("par_id", "keyword", "country", "label")


@register("filter_grade", with_ctes(P_SQL, body="""
SELECT par_id, orig_label, label FROM P WHERE orig_label = '2'"""))
def q_filter_grade(spark, d):
    return lb.filter_grade(paragraphs(spark, d), "2").select("par_id", "orig_label", "label")


@register("filter_long_text", with_ctes(P_SQL, PT, body="""
SELECT par_id, n_tokens, label FROM PT WHERE n_tokens > 63"""))
def q_filter_long(spark, d):
    p = lb.filter_long_text(paragraphs(spark, d, spread_text=True))
    return p.select("par_id", token_count("text").alias("n_tokens"), "label")


@register("filter_group", with_ctes(P_SQL, body="""
SELECT par_id, keyword, country, label FROM P WHERE keyword = 'fr'"""))
def q_filter_group(spark, d):
    return lb.filter_group(paragraphs(spark, d), "keyword", "fr").select("par_id", "keyword", "country", "label")


@register("project_text_label", with_ctes(P_SQL, body="""
SELECT CAST(text AS VARCHAR) AS text, CAST(label AS INTEGER) AS label FROM P"""))
def q_project(spark, d):
    return lb.project_text_label(paragraphs(spark, d))


@register("verbalise_label", with_ctes(P_SQL, body="""
SELECT par_id, label, CASE label WHEN 0 THEN 'respectful' WHEN 1 THEN 'patronizing' END AS label_word,
       CASE CASE label WHEN 0 THEN 'respectful' WHEN 1 THEN 'patronizing' END
            WHEN 'respectful' THEN 0 WHEN 'patronizing' THEN 1 END AS label_back FROM P"""))
def q_verbalise(spark, d):
    p = paragraphs(spark, d).select("par_id", "label", lb.verbalise("label").alias("label_word"))
    return p.withColumn("label_back", lb.unverbalise("label_word"))


@register("class_distribution", with_ctes(P_SQL, body="""
SELECT label, count(*) AS n FROM P GROUP BY label"""))
def q_class_dist(spark, d):
    return pr.class_distribution(paragraphs(spark, d))


@register("grade_distribution", with_ctes(P_SQL, body="""
SELECT g.orig_label, CAST(count(P.par_id) AS BIGINT) AS n
FROM (VALUES ('0'), ('1'), ('2'), ('3'), ('4')) g(orig_label) LEFT JOIN P USING (orig_label)
GROUP BY g.orig_label"""))
def q_grade_dist(spark, d):
    return pr.grade_distribution(paragraphs(spark, d))


def _class_by_sql(col):
    return with_ctes(P_SQL, body=f"""
SELECT k.{col}, c.label, CAST(count(P.par_id) AS BIGINT) AS n
FROM (SELECT DISTINCT {col} FROM P) k CROSS JOIN (VALUES (0), (1)) c(label)
LEFT JOIN P ON P.{col} = k.{col} AND P.label = c.label
GROUP BY k.{col}, c.label""")


@register("class_by_keyword", _class_by_sql("keyword"))
def q_class_kw(spark, d):
    return pr.class_by_group(paragraphs(spark, d), "keyword")


@register("class_by_country", _class_by_sql("country"))
def q_class_co(spark, d):
    return pr.class_by_group(paragraphs(spark, d), "country")


@register("distinct_groups", with_ctes(P_SQL, body="""
SELECT DISTINCT 'keyword' AS dimension, keyword AS value FROM P
UNION SELECT DISTINCT 'country' AS dimension, country AS value FROM P"""))
def q_distinct_groups(spark, d):
    return pr.distinct_groups(paragraphs(spark, d))


@register("token_count", with_ctes(P_SQL, PT, body="SELECT par_id, n_tokens FROM PT"))
def q_token_count(spark, d):
    return paragraphs(spark, d, spread_text=True).select("par_id", token_count("text").alias("n_tokens"))


@register("lower_tokens", with_ctes(P_SQL, body=f"""
SELECT par_id, array_to_string({sql_tokens('lower(text)')}, ' ') AS tokens FROM P"""))
def q_lower_tokens(spark, d):
    return paragraphs(spark, d, spread_text=True).select("par_id", F.array_join(lower_tokens("text"), " ").alias("tokens"))


@register("token_length_stats", with_ctes(P_SQL, PT, body="""
SELECT label, count(*) AS n_rows, avg(n_tokens) AS mean_len, round(stddev_pop(n_tokens), 6) AS std_len,
       min(n_tokens) AS min_len, max(n_tokens) AS max_len
FROM PT GROUP BY ROLLUP (label)"""))
def q_len_stats(spark, d):
    s = pr.token_length_stats(_pt(spark, d))
    return s.withColumn("std_len", F.round("std_len", 6))


@register("token_length_percentile", with_ctes(P_SQL, PT, body="""
SELECT 'all' AS scope, 0.45::DOUBLE AS p, round(quantile_cont(n_tokens, 0.45), 9) AS value FROM PT
UNION ALL
SELECT 'all' AS scope, 0.9::DOUBLE AS p, round(quantile_cont(n_tokens, 0.9), 9) AS value FROM PT
UNION ALL
SELECT 'all' AS scope, 0.98::DOUBLE AS p, round(quantile_cont(n_tokens, 0.98), 9) AS value FROM PT
UNION ALL
SELECT 'positive' AS scope, 0.9::DOUBLE AS p, round(quantile_cont(n_tokens, 0.9), 9) AS value FROM PT WHERE label = 1"""))
def q_len_pct(spark, d):
    pt = materialize(_pt(spark, d).select("label", "n_tokens"))
    a = pr.token_length_percentiles(pt).select(F.lit("all").alias("scope"), "p", "value")
    b = pr.token_length_percentiles(pt.filter("label = 1"), percentiles=(0.9,)) \
          .select(F.lit("positive").alias("scope"), "p", "value")
    return a.unionByName(b).withColumn("value", F.round("value", 9))


@register("token_length_extremes", with_ctes(P_SQL, PT, body="""
SELECT 'max' AS which, n_tokens, row_idx, par_id, label, text FROM PT
WHERE row_idx = (SELECT first(row_idx ORDER BY n_tokens DESC, row_idx) FROM PT)
UNION ALL
SELECT 'min' AS which, n_tokens, row_idx, par_id, label, text FROM PT
WHERE row_idx = (SELECT first(row_idx ORDER BY n_tokens, row_idx) FROM PT)"""))
def q_len_extremes(spark, d):
    return pr.token_length_extremes(_pt(spark, d))


@register("length_histogram", with_ctes(P_SQL, PT, """
R AS (SELECT CASE WHEN min(n_tokens) = max(n_tokens) THEN min(n_tokens) - 0.5 ELSE CAST(min(n_tokens) AS DOUBLE) END AS lo,
             CASE WHEN min(n_tokens) = max(n_tokens) THEN max(n_tokens) + 0.5 ELSE CAST(max(n_tokens) AS DOUBLE) END AS hi
      FROM PT)""", """
B AS (SELECT CAST(least(floor((n_tokens - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bin, count(*) AS n
      FROM PT, R GROUP BY ALL)""", body="""
SELECT CAST(b.range AS INTEGER) AS bin, lo + b.range * ((hi - lo) / 100) AS lo,
       lo + (b.range + 1) * ((hi - lo) / 100) AS hi, coalesce(B.n, 0) AS n
FROM range(100) b CROSS JOIN R LEFT JOIN B ON B.bin = b.range"""))
def q_hist(spark, d):
    return pr.length_histogram(_pt(spark, d))


@register("length_histogram_by_class", with_ctes(P_SQL, PT, """
B AS (SELECT label, CAST(least(floor(n_tokens / 2.0), 99) AS INTEGER) AS bin, count(*) AS n
      FROM PT WHERE n_tokens >= 0 AND n_tokens <= 200 GROUP BY ALL)""", body="""
SELECT c.label, CAST(b.range AS INTEGER) AS bin, coalesce(B.n, 0) AS n
FROM range(100) b CROSS JOIN (VALUES (0), (1)) c(label)
LEFT JOIN B ON B.bin = b.range AND B.label = c.label"""))
def q_hist_cls(spark, d):
    return pr.length_histogram_by_class(_pt(spark, d))


W_SQL = f"""W AS (SELECT label, keyword, country, unnest({sql_tokens('lower(text)')}) AS word FROM P)"""


@register("word_frequency", with_ctes(P_SQL, W_SQL, body="""
SELECT word, count(*) AS n, count(*) / (SELECT count(*) FROM W) AS freq FROM W GROUP BY word"""))
def q_word_freq(spark, d):
    return pr.word_frequency(paragraphs(spark, d, spread_text=True))


@register("vocab_summary", with_ctes(P_SQL, W_SQL, body="""
SELECT keyword, count(DISTINCT word) AS n_words, CAST(count(*) AS BIGINT) AS n_tokens
FROM W GROUP BY ROLLUP (keyword)"""))
def q_vocab_summary(spark, d):
    return pr.vocab_summary(paragraphs(spark, d, spread_text=True), "keyword")


def _pmi_sql(group):
    return with_ctes(P_SQL, W_SQL, f"""
GW AS (SELECT label, {group}, word, count(*) AS c_gw FROM W GROUP BY ALL)""", f"""
WW AS (SELECT label, word, sum(c_gw) AS c_w FROM GW GROUP BY ALL)""", f"""
G AS (SELECT label, {group}, sum(c_gw) AS t_g FROM GW GROUP BY ALL)""", """
T AS (SELECT label, sum(t_g) AS t FROM G GROUP BY ALL)""", f"""
S AS (SELECT label, {group}, word, c_gw, ln((c_gw / t_g) / (c_w / t)) AS pmi
      FROM GW JOIN WW USING (label, word) JOIN G USING (label, {group}) JOIN T USING (label))""", f"""
R AS (SELECT *, row_number() OVER (PARTITION BY label, {group} ORDER BY round(pmi, 9) DESC, word) AS rank FROM S)""",
                     body=f"""
SELECT label, {group}, CAST(rank AS INTEGER) AS rank, word, c_gw, round(pmi, 9) AS pmi FROM R WHERE rank <= 100""")


def _pmi(spark, d, group):
    t = pr.pmi_top_words(paragraphs(spark, d, spread_text=True), group)
    return t.withColumn("pmi", F.round("pmi", 9))


@register("pmi_top_words_keyword", _pmi_sql("keyword"))
def q_pmi_kw(spark, d):
    return _pmi(spark, d, "keyword")


@register("pmi_top_words_country", _pmi_sql("country"))
def q_pmi_co(spark, d):
    return _pmi(spark, d, "country")


@register("filter_short_text", with_ctes(P_SQL, PT, body="""
SELECT par_id, n_tokens, label FROM PT WHERE NOT (n_tokens > 63)"""))
def q_filter_short(spark, d):
    p = lb.filter_long_text(paragraphs(spark, d, spread_text=True), long=False)
    return p.select("par_id", token_count("text").alias("n_tokens"), "label")
