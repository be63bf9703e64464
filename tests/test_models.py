"""The caller's scorer, the mask model and the bounded ranking against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from parlance.operators import candidates as cd
from parlance.operators import mask_model as mm
from parlance.operators import scorer as us


def test_scorer_is_built_once_per_worker_and_batches_are_bounded(spark):
    rows = [(i, f"p{i % 3}", None if i % 10 == 0 else "é" * (i % 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_idx long, par_id string, text string").repartition(3)

    def make():
        return lambda texts: np.array([[len(t), 0, sum(len(x) for x in texts)] for t in texts], float).reshape(len(texts), 3)
    got = us.user_scores(df, make, keep=("par_id",), width=3, batch_bytes=300).collect()
    assert sorted((r["row_idx"], r["par_id"], r["scores"][0]) for r in got) == sorted((i, p, float(len(t or ""))) for i, p, t in rows)
    # A call holds at most 300 bytes (150 of these characters) and one text more.
    assert max(r["scores"][2] for r in got) <= 150
    one = us.user_scores(df, lambda: (lambda texts: [float(len(t)) for t in texts]))
    assert one.columns == ["row_idx", "score"] and one.agg(F.sum("score")).first()[0] == sum(len(t or "") for _, _, t in rows)
    assert us.user_scores(df.limit(0), lambda: (lambda texts: np.zeros(len(texts)))).count() == 0


def test_models_are_kept_by_worker_and_bounded():
    us._models.clear()
    built = []
    for token in ("a", "a", "b", "a", "c", "b"):
        us._model(token, lambda t=token: built.append(t) or t)
    assert built == ["a", "b", "c", "b"] and len(us._models) == us.KEPT_MODELS


def test_scorer_of_a_wrong_shape_fails(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_idx long, text string").coalesce(1)
    with pytest.raises(Exception, match="the scorer returned shape"):
        us.user_scores(df, lambda: (lambda texts: np.zeros(len(texts) + 1))).collect()


def test_word_table_scorer_refuses_large_tables(spark, monkeypatch):
    model = spark.createDataFrame([("a", 0.5), ("b", -1.0)], "word string, lo double")
    score = us.word_table_scorer(model, 0.25)()
    assert score(["a b a", "", "z"]).tolist() == [0.25, 0.25, 0.25]
    monkeypatch.setattr(us, "MODEL_WORDS", 1)
    with pytest.raises(ValueError, match="too many"):
        us.word_table_scorer(model, 0.0)


def _mask_scores(train, prompts, words, mu):
    before = lambda p: p.split("<mask>")[0].lower().split()
    n2, n1 = Counter(), Counter()
    for p, w in train:
        t = before(p)
        for a, b in zip(t, t[1:]):
            n2[a, b, w] += 1
            n1[b, w] += 1
    p0 = {w: (sum(x == w for _, x in train) + 1) / (len(train) + len(words)) for w in words}
    out = {}
    for key, p in prompts:
        t = before(p or "")
        for w in words:
            s = math.log(p0[w])
            for a, b in zip(t, t[1:]):
                p1 = (n1[b, w] + mu * p0[w]) / (sum(n1[b, x] for x in words) + mu)
                s += math.log((n2[a, b, w] + mu * p1) / (sum(n2[a, b, x] for x in words) + mu) / p0[w])
            out[key, w] = s
    return out


def test_mask_scores_equal_the_formula(spark):
    rng = random.Random(3)
    words = ["respectful", "patronizing", "great"]
    text = lambda: " ".join(rng.choice("Aa b c d e f g".split()) for _ in range(rng.randrange(0, 12)))
    train = [(f"{text()} It was <mask> .", rng.choice(words[:2])) for _ in range(60)]
    prompts = [(i, f"{text()} zz {text()} It was <mask> .") for i in range(30)] + [(100, None), (101, "<mask>"), (102, "one <mask>")]
    model = mm.train_mask_model(spark.createDataFrame(train + [(None, "great"), ("a b <mask>", "other")], "prompt string, answer string"), words)
    got = mm.mask_word_scores(spark.createDataFrame(prompts, "m_idx long, prompt string"), model).collect()
    want = _mask_scores(train, prompts, words, mm.MU)
    assert len(got) == len(want) and all(abs(r["score"] - want[r["m_idx"], r["word"]]) < 1e-9 for r in got)


def test_bounds_hold_the_distance(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcé\n ", k=rng.randrange(0, 14)))
    rows = [(word(), word()) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", F.length("a").alias("la"), F.length("b").alias("lb"), cd._letters("a").alias("ca"), cd._letters("b").alias("cb"))
    least, most = cd.distance_bounds(F.col("la"), F.col("ca"), F.col("lb"), F.col("cb"))
    for r in df.select("a", "b", least.alias("least"), most.alias("most"), F.levenshtein("a", "b").alias("d")).collect():
        assert r["least"] <= r["d"] <= r["most"] and cd.edit_distance(r["a"], r["b"]) == r["d"]


def test_most_pairs_are_never_measured(spark, monkeypatch):
    """200 candidates of one source: lengths settle nearly all of them."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(20)]
    rows = [("s", "k", " ".join(base))]
    rows += [(f"c{i:03d}", "k", " ".join(base + [rng.choice("xyz") * rng.randrange(1, 4) for _ in range(i)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "cand_id string, keyword string, text string")
    src = docs.filter("cand_id = 's'").withColumnRenamed("cand_id", "src_id")
    counted = []
    real = cd.measured
    monkeypatch.setattr(cd, "measured", lambda pairs, *a: counted.append(pairs.count()) or real(pairs, *a))
    got = cd.rank_candidates(src, docs, adequacy_min=1.0, fluency_min=0.0).orderBy("rank").collect()
    d = sorted(((-cd.edit_distance(rows[0][2], t), c) for c, _, t in rows[1:]))[:10]
    assert [(r["cand_id"], r["distance"]) for r in got] == [(c, -x) for x, c in d]
    assert sum(counted) <= 60, counted


def test_hot_tokens_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(cd, "HOT_POSTINGS", 3)
    rows = [(str(i), "k", "same words here " + f"t{i % 4}") for i in range(20)]
    docs = spark.createDataFrame(rows, "cand_id string, keyword string, text string")
    got = cd.candidate_pairs(docs.withColumnRenamed("cand_id", "src_id"), docs, 0.75, 0.0)
    assert got.count() == 20 * 19 and got.distinct().count() == 20 * 19
