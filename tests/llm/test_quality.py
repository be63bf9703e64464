import re
import unicodedata

import numpy as np

from conftest import SF_SMALL
from helpers import DOCS, WORD, documents
from parlance.llm import quality as q


def _brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at: dict = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark):
    rows = documents(8)
    rows += [(900 + i, t, "en", "a", 0) for i, t in enumerate([
        "a a a a a", "a b c a b c a b", "x\n\nx\n x\nx", "é|*é #\x0b&\r\n", "w " * 30_000, "a b c d\na b c d\n", "  a b"])]
    got = q.quality(spark.createDataFrame(rows, DOCS)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        n = _brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["p_good"] <= 1


def test_given_documents_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in q.quality(docs).collect()}
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()
    judged = [(r["quality"], got[r["doc_id"]]["kept"]) for r in labels if not got[r["doc_id"]]["base_failed"]]
    assert all(kept for good, kept in judged if good)
    assert sum(not kept for good, kept in judged if not good) >= 0.9 * sum(not good for good, _ in judged)


def test_posterior_column_equals_the_model(spark):
    patterns = [((1, 1, 1), 900), ((-1, 1, 1), 60), ((1, -1, -1), 30), ((0, 0, 1), 10)]
    model = q.fit_voters(patterns, 3)
    df = spark.createDataFrame([(list(v),) for v, _ in patterns], "votes array<tinyint>")
    for r in df.select("votes", q.posterior(model).alias("p")).collect():
        assert abs(r["p"] - model.posteriors(r["votes"])[0]) < 1e-9
    assert model.posteriors((1, 1, 1))[0] > 0.9 and model.posteriors((-1, 1, 1))[0] < 0.5
    assert q.fit_voters([], 2).weight[0] > 0.8


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = q.with_votes(q.text_statistics(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _brute_votes(text):
    """Votes of the seven rules on one text, by plain counting."""
    text = text or ""
    n, chars, symbols, dup, repeat = _brute(text)
    w = WORD.findall(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    capitals = sum(unicodedata.category(c) == "Lu" for c in text)
    stops = len(re.findall(r"[.,;:!?](?![^\x20\x09-\x0D])", text))
    if not n:
        return [0] * 7
    bad_good = [(100 * symbols > 10 * n, 100 * symbols <= 2 * n), (100 * dup > 45 * lines, 100 * dup <= 10 * lines),
                (100 * repeat > 40 * n, 100 * repeat <= 10 * n), (100 * capitals > 30 * chars, 100 * capitals <= 10 * chars),
                (100 * stops > 60 * n, 2 * n <= 100 * stops <= 40 * n),
                (chars > 12 * n or chars < 2 * n, 3 * n <= chars <= 9 * n),
                (n >= 20 and 100 * len(set(w)) < 20 * n, 100 * len(set(w)) >= 35 * n)]
    return [-1 if bad else 1 if good else 0 for bad, good in bad_good]


def _brute_posteriors(votes):
    """Expectation-maximisation text by text: one class of good texts, one of bad ones per rule."""
    v = np.array(votes)
    rules = v.shape[1]
    weight = np.array([0.85] + [0.15 / rules] * rules)
    says = np.full((rules + 1, rules), 0.2)
    says[0] = 0.002
    says[np.arange(1, rules + 1), np.arange(rules)] = 0.9
    weight0, says0 = weight.copy(), says.copy()

    def share():
        log = np.log(weight) + (v < 0) @ np.log(says).T + (v > 0) @ np.log(1 - says).T
        e = np.exp(log - log.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    for _ in range(60):
        p = share()
        says = (p.T @ (v < 0) + 10 * says0) / (p.T @ (v != 0) + 10)
        says = np.clip(says, 1e-6, 1 - 1e-6)
        says[0] = np.minimum(says[0], 0.01)
        own = (np.arange(1, rules + 1), np.arange(rules))
        says[own] = np.maximum(says[own], 0.5)
        weight = np.clip((p.sum(0) + 10 * weight0) / (len(v) + 10), 1e-6, 1 - 1e-6)
    return share()[:, 0]


def test_kept_equals_a_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10 ** 6, None), (10 ** 6 + 1, ""), (10 ** 6 + 2, "a b " * 60)]
    got = {r["doc_id"]: r for r in q.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    p = _brute_posteriors([_brute_votes(t) for _, t in rows])
    assert len(got) == len(rows)
    for (doc, text), good in zip(rows, p):
        n, _, _, _, repeat = _brute(text)
        assert abs(got[doc]["p_good"] - good) < 1e-6, doc
        assert got[doc]["kept"] == (n >= 50 and 100 * repeat <= 50 * n and good >= 0.5)
