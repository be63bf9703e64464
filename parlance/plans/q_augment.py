"""Registered queries: augmentation edits, the augmented union and its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import token_count, tokens
from parlance.operators import augment as ag
from parlance.operators import splits as sl
from parlance.plans.fixtures import manifest, messy_manifest, sql_h, sql_tokens, with_ctes
from parlance.plans.ordering import broadcast_if_small, fetch_one, materialize
from parlance.plans.q_splits import BASE, MESSY, _split
from parlance.plans.registry import register
from parlance.session import scratch_path
from parlance.sources import readers as rd
from parlance.sources import sinks as sk

P30 = int(round(100 * ag.AUG_P))
AUG_ROUNDS = ag.ROUNDS


def _hit(op, i):
    return f"({sql_h('par_id', 'rnd', repr(op), i)} % 100 < {P30})"


def sql_swap(t):
    o = f"({sql_h('par_id', 'rnd', repr('swap'))} % 2)"
    rel = f"(i - 1 - {o})"
    j = f"({rel} // 2)"
    return (f"list_transform({t}, lambda x, i: CASE WHEN {rel} >= 0 AND {o} + 2 * {j} + 1 < len({t}) AND {_hit('swap', j)} "
            f"THEN {t}[CASE WHEN {rel} % 2 = 0 THEN i + 1 ELSE i - 1 END] ELSE x END)")


def sql_delete(t):
    kept = f"list_filter({t}, lambda x, i: NOT {_hit('del', '(i - 1)')})"
    return f"CASE WHEN len({kept}) = 0 AND len({t}) > 0 THEN {t}[1:1] ELSE {kept} END"


BIGRAM_CTES = (
    f"BT AS (SELECT {sql_tokens('text')} AS t FROM TR)",
    "BP AS (SELECT t[i] AS l, t[i + 1] AS nx FROM (SELECT t, unnest(range(1, len(t))) AS i FROM BT))",
    "BG AS (SELECT l, first(nx ORDER BY c DESC, nx) AS succ FROM (SELECT l, nx, count(*) AS c FROM BP GROUP BY ALL) GROUP BY l)",
)


def sql_bigram_step(src, dst, op):
    """CTEs turning ``src``(par_id, rnd, t) into ``dst`` with substitute/insert applied."""
    look = "t[i0]" if op == "sub" else "t[i0 + 1]"
    cond = f"i0 >= 1 AND {_hit('sub', 'i0')}" if op == "sub" else _hit("ins", "i0")
    piece = ("CASE WHEN BG.succ IS NOT NULL THEN BG.succ ELSE x END" if op == "sub"
             else "CASE WHEN BG.succ IS NOT NULL THEN [x, BG.succ] ELSE [x] END")
    agg = f"list({'[' + piece + ']' if op == 'sub' else piece} ORDER BY i0)"
    return (
        f"{dst}X AS (SELECT m_idx, rnd, i0, t[i0 + 1] AS x, CASE WHEN {cond} THEN {look} END AS lk "
        f"FROM (SELECT m_idx, par_id, rnd, t, unnest(range(len(t))) AS i0 FROM {src}))",
        f"{dst} AS (SELECT S.*, coalesce(flatten(N.nt), []) AS nt FROM {src} S LEFT JOIN ("
        f"SELECT m_idx, rnd, {agg} AS nt FROM {dst}X LEFT JOIN BG ON BG.l = {dst}X.lk GROUP BY m_idx, rnd) N "
        f"USING (m_idx, rnd))",
    )


def _aug_ctes(rounds, through):
    src = ("A0 AS (SELECT par_id, art_id, keyword, country, orig_label, label, m_idx, r.range AS rnd, "
           f"{sql_tokens('text')} AS t FROM TR, range(1, {rounds + 1}) r WHERE label = 1)")
    ctes = [src]
    ctes.append(f"A1 AS (SELECT * REPLACE ({sql_swap('t')} AS t) FROM A0)")
    if through == "swap":
        return ctes, "A1"
    ctes.append(f"A2 AS (SELECT * REPLACE ({sql_delete('t')} AS t) FROM A1)")
    if through == "delete":
        return ctes, "A2"
    s3 = sql_bigram_step("A2", "A3R", "sub")
    ctes += [*s3, "A3 AS (SELECT * EXCLUDE (nt) REPLACE (nt AS t) FROM A3R)"]
    if through == "substitute":
        return ctes, "A3"
    s4 = sql_bigram_step("A3", "A4R", "ins")
    ctes += [*s4, "A4 AS (SELECT * EXCLUDE (nt) REPLACE (nt AS t) FROM A4R)"]
    return ctes, "A4"


def _aug_sql(through, rounds, body, base=BASE, more=()):
    ctes, last = _aug_ctes(rounds, through)
    more = [c.replace("{last}", last) for c in more]
    return with_ctes(*base, *BIGRAM_CTES, *ctes, *more, body=body.replace("{last}", last))


def train_split(spark, d, ids=manifest):
    """The training split, written once: positives, bigrams and the union read it."""
    return materialize(_split(spark, d, "train", ids=ids))


def _pos(tr):
    return tr.filter(F.col("label") == 1).select("par_id", "art_id", "keyword", "country", "orig_label", "label", "m_idx", "text")


def augmented(tr):
    return ag.augment_positives(_pos(tr), ag.written_bigrams(tr))


def _edited(spark, d, through, rounds):
    tr = train_split(spark, d) if through in ("substitute", "insert") else _split(spark, d, "train")
    x = _pos(tr).select("m_idx", "par_id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), tokens("text").alias("_t"))
    k, r = F.col("par_id"), F.col("round")
    x = x.withColumn("_t", ag.swap_words(F.col("_t"), k, r))
    if through in ("delete", "substitute", "insert"):
        x = x.withColumn("_t", ag.delete_words(F.col("_t"), k, r))
    if through in ("substitute", "insert"):
        big = ag.written_bigrams(tr)
        x = ag.substitute_words(x, ("m_idx", "round"), "_t", big)
        if through == "insert":
            x = ag.insert_words(x, ("m_idx", "round"), "_t", big)
    return x.select("par_id", "round", F.array_join("_t", " ").alias("text"))


_EDIT_BODY = "SELECT par_id, CAST(rnd AS INTEGER) AS round, array_to_string(t, ' ') AS text FROM {last}"

for _op in ("swap", "delete", "substitute", "insert"):
    def _mk(op):
        def q(spark, d):
            return _edited(spark, d, op, 1)
        return q
    register(f"aug_{_op}_words", _aug_sql(_op, 1, _EDIT_BODY))(_mk(_op))


@register("bigram_successors", with_ctes(*BASE, *BIGRAM_CTES, body="SELECT l AS left, succ FROM BG"))
def q_bigrams(spark, d):
    return ag.bigram_table(_split(spark, d, "train"))


_AUG_BODY = ("SELECT par_id, art_id, keyword, country, orig_label, label, m_idx, CAST(rnd AS INTEGER) AS round, "
             "array_to_string(t, ' ') AS text, 'aug' AS origin FROM {last}")


@register("augment_positives", _aug_sql("insert", ag.ROUNDS, _AUG_BODY))
def q_augment(spark, d):
    return augmented(train_split(spark, d))


@register("augment_positives_messy", _aug_sql("insert", ag.ROUNDS, _AUG_BODY, MESSY))
def q_augment_messy(spark, d):
    """A manifest that repeats and misses ids: copies per manifest row."""
    return augmented(train_split(spark, d, messy_manifest))


@register("union_augmented", _aug_sql("insert", ag.ROUNDS, """
SELECT par_id, 'base' AS origin, label, keyword, CAST(NULL AS INTEGER) AS round, text FROM TR
UNION ALL
SELECT par_id, 'aug' AS origin, label, keyword, CAST(rnd AS INTEGER) AS round, array_to_string(t, ' ') AS text FROM {last}"""))
def q_union_aug(spark, d):
    tr = train_split(spark, d)
    aug = augmented(tr).select("par_id", "label", "keyword", "round", "text")
    return sl.union_augmented(tr.select("par_id", "label", "keyword", "text"), aug).select("par_id", "origin", "label", "keyword", "round", "text")


@register("sink_augmented_tsv", _aug_sql("insert", ag.ROUNDS, f"""
SELECT row_number() OVER (ORDER BY m_idx, rnd) - 1 AS row_idx, par_id, array_to_string(t, ' ') AS text, orig_label,
       CASE WHEN orig_label IN ('0', '1') THEN 0 ELSE 1 END AS label FROM {{last}}"""))
def q_sink_aug(spark, d):
    aug = augmented(train_split(spark, d))
    path = sk.write_augmented_tsv(aug, scratch_path(spark, "augment"), order=["m_idx", "round"])
    return rd.read_labelled_tsv(spark, path).select("row_idx", "par_id", "text", "orig_label", "label")


# ---------------------------------------------------------------- candidate ranking

from parlance.operators import candidates as cd  # noqa: E402
from parlance.plans.fixtures import paragraphs, table  # noqa: E402


def _cand_inputs(spark, d):
    """The positives of train, written once, and all documents. Other documents' texts are not joined for the first."""
    ids = _split(spark, d, "train", ("label",)).filter(F.col("label") == 1).select(F.col("par_id").cast("bigint").alias("doc_id"))
    ids = materialize(ids.distinct())
    ids = broadcast_if_small(ids, fetch_one(ids, n=F.count(F.lit(1)))["n"])
    listed = manifest(spark, d).filter(F.col("split") == "train").join(ids, F.col("m_idx") == F.col("doc_id"), "left_semi")
    src = materialize(_pos(sl.rebuild_split(paragraphs(spark, d, only=ids), listed, sl.WIDE)).select(
        F.col("par_id").alias("src_id"), "keyword", "text"))
    corpus = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("cand_id"),
                                                 F.col("lang").alias("keyword"), "text")
    return src, corpus


def _cand_ctes(adequacy, fluency):
    return tuple(c.replace(f"adequacy >= {cd.ADEQUACY_MIN}", f"adequacy >= {adequacy}")
                  .replace(f", 0.0) >= {cd.FLUENCY_MIN}", f", 0.0) >= {fluency}") for c in CAND_CTES)


CAND_CTES = (
    f"SRC AS (SELECT par_id AS src_id, keyword, text, list_distinct({sql_tokens('lower(text)')}) AS sa FROM TR WHERE label = 1)",
    f"CORP AS (SELECT CAST(doc_id AS VARCHAR) AS cand_id, lang AS keyword, text, list_distinct({sql_tokens('lower(text)')}) AS sb, "
    f"{sql_tokens('lower(text)')} AS tb FROM documents)",
    "BG2 AS (SELECT tb[i] AS a, tb[i + 1] AS b FROM (SELECT tb, unnest(range(1, len(tb))) AS i FROM CORP))",
    "BC2 AS (SELECT a, b, count(*) AS c FROM BG2 GROUP BY ALL)",
    f"ADQ AS (SELECT * FROM (SELECT src_id, cand_id, len(list_intersect(sa, sb)) / len(sa) AS adequacy FROM SRC JOIN CORP USING (keyword) "
    f"WHERE cand_id <> src_id) WHERE adequacy >= {cd.ADEQUACY_MIN})",
    "FL AS (SELECT cand_id, count(*) FILTER (WHERE c >= 2) / count(*) AS fluency FROM (SELECT cand_id, tb[i] AS a, tb[i + 1] AS b FROM ("
    "SELECT cand_id, tb, unnest(range(1, len(tb))) AS i FROM CORP WHERE cand_id IN (SELECT cand_id FROM ADQ))) JOIN BC2 USING (a, b) "
    "GROUP BY cand_id)",
    f"V AS (SELECT ADQ.*, coalesce(FL.fluency, 0.0) AS fluency FROM ADQ LEFT JOIN FL USING (cand_id) "
    f"WHERE coalesce(FL.fluency, 0.0) >= {cd.FLUENCY_MIN})",
)


@register("candidate_pairs", with_ctes(*BASE, *CAND_CTES, body="""
SELECT src_id, cand_id, round(adequacy, 9) AS adequacy, round(fluency, 9) AS fluency FROM V"""))
def q_candidate_pairs(spark, d):
    src, corpus = _cand_inputs(spark, d)
    r = cd.candidate_pairs(src, corpus)
    return r.select("src_id", "cand_id", F.round("adequacy", 9).alias("adequacy"), F.round("fluency", 9).alias("fluency"))


LOOSE = 0.55


@register("candidate_pairs_loose", with_ctes(*BASE, *_cand_ctes(LOOSE, LOOSE), body="""
SELECT src_id, cand_id, round(adequacy, 9) AS adequacy, round(fluency, 9) AS fluency FROM V"""))
def q_candidate_pairs_loose(spark, d):
    """Thresholds that many pairs reach, one of them awkward in floating point."""
    src, corpus = _cand_inputs(spark, d)
    r = cd.candidate_pairs(src, corpus, LOOSE, LOOSE)
    return r.select("src_id", "cand_id", F.round("adequacy", 9).alias("adequacy"), F.round("fluency", 9).alias("fluency"))


ASCII_ADEQUACY = 0.35
_AS_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '?', 'g')"


def _ascii_ctes():
    return tuple(c.replace("FROM TR WHERE", f"FROM (SELECT * REPLACE ({_AS_ASCII} AS text) FROM TR) WHERE")
                  .replace("AS tb FROM documents)", f"AS tb FROM (SELECT * REPLACE ({_AS_ASCII} AS text) FROM documents))")
                 for c in _cand_ctes(ASCII_ADEQUACY, 0.0))


@register("rank_candidates_ascii", with_ctes(*BASE, *_ascii_ctes(), """
R AS (SELECT V.*, levenshtein(SRC.text, CORP.text) AS distance FROM V JOIN SRC USING (src_id) JOIN CORP USING (cand_id))""", body=f"""
SELECT src_id, CAST(rank AS INTEGER) AS rank, cand_id, round(adequacy, 9) AS adequacy, round(fluency, 9) AS fluency,
       CAST(distance AS INTEGER) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY distance DESC, cand_id) AS rank FROM R) WHERE rank <= {cd.MAX_CANDIDATES}"""))
def q_rank_ascii(spark, d):
    """Ranks and the cap at a loose threshold, on texts whose other characters are replaced, so that SQL can measure them."""
    plain = lambda df: df.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    src, corpus = (plain(x) for x in _cand_inputs(spark, d))
    r = cd.rank_candidates(src, corpus, ASCII_ADEQUACY, 0.0)
    return r.select("src_id", "rank", "cand_id", F.round("adequacy", 9).alias("adequacy"), F.round("fluency", 9).alias("fluency"), "distance")


@register("rank_candidates")
def q_rank_candidates(spark, d):
    """Rows-only in the driver: SQL engines at hand measure Levenshtein in
    bytes, this one in characters; tests compare with a brute force."""
    src, corpus = _cand_inputs(spark, d)
    r = cd.rank_candidates(src, corpus)
    return r.select("src_id", "rank", "cand_id", F.round("adequacy", 9).alias("adequacy"),
                    F.round("fluency", 9).alias("fluency"), "distance")
