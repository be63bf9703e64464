"""Word-statistics classifiers that stand in for the fine-tuned models.

Training is one aggregate over (word) -- or (class, word) for the 7-way
task -- with conditional sums; scoring pre-aggregates each document to
(doc, word, tf) before the join with the model table, which is broadcast
if its counted words are few enough; rows are keyed by their unique
position, so ids may repeat.
Scores: s = ln((N1+1)/(N0+1)) + sum tf * lo(w),
lo(w) = ln((c1+1)/(n1+V)) - ln((c0+1)/(n0+V)); predict 1 when s > 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import PY_WS_RUN, lower_tokens
from parlance.operators.scores import ensemble_vote
from parlance.plans.ordering import broadcast_if_small, fetch_one, lit_long, materialize


def doc_terms(df: DataFrame, key: str = "par_id", text: str = "text", keep=()) -> DataFrame:
    """(key, keep..., word, tf) with tf = occurrences of the word in the text;
    a text without words gives one row with a NULL word, so every row of
    ``df`` stays and the kept columns need no second read.  ``key`` is unique,
    so a row's words are sorted and counted where it is read: no shuffle."""
    w = df.select(key, *keep, F.array_sort(lower_tokens(text)).alias("_w"))
    n = F.coalesce(F.size("_w"), F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    w = w.select("*", F.filter(places, lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1))).alias("_at"))
    each = F.transform("_at", lambda i, k: F.struct(
        F.get("_w", i).alias("word"), (F.coalesce(F.get("_at", k + 1), F.size("_w")) - i).cast("bigint").alias("tf")))
    return w.select(key, *keep, F.explode_outer(each).alias("_e")).select(
        key, *keep, F.col("_e.word").alias("word"), F.coalesce("_e.tf", F.lit(1).cast("bigint")).alias("tf"))


def nb_word_scores(train: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """word, c1, c0, lo -- smoothed log-odds per word of the training rows."""
    w = train.select(F.col(label).alias("_y"), F.explode(lower_tokens(text)).alias("word"))
    counts = materialize(w.groupBy("word").agg(F.count(F.when(F.col("_y") == 1, 1)).alias("c1"),
                                               F.count(F.when(F.col("_y") == 0, 1)).alias("c0")))
    tot = fetch_one(counts, n1=F.sum("c1"), n0=F.sum("c0"), v=F.count(F.lit(1)))
    lo = _log_odds(F.col("c1"), lit_long(tot["n1"]), F.col("c0"), lit_long(tot["n0"]), lit_long(tot["v"]))
    return broadcast_if_small(counts.select("word", "c1", "c0", lo.alias("lo")), tot["v"])


def nb_prior(train: DataFrame, label: str = "label"):
    """Scalar column ln((N1+1)/(N0+1)) over training documents."""
    p = fetch_one(train, p=F.log((F.count(F.when(F.col(label) == 1, 1)) + 1)
                                / (F.count(F.when(F.col(label) == 0, 1)) + 1)))["p"]
    return F.lit(p)


def nb_score(docs: DataFrame, model: DataFrame, prior, key: str = "row_idx", text: str = "text",
             keep=()) -> DataFrame:
    """key, keep..., score, pred for every document (unseen words add 0).

    ``key`` is the unique position of a row; ids that may repeat travel in ``keep``.
    """
    terms = doc_terms(docs, key, text, keep).join(model.select("word", "lo"), "word", "left")
    out = terms.groupBy(key, *keep).agg(F.sum(F.col("tf") * F.coalesce("lo", F.lit(0.0))).alias("_s"))
    score = prior + F.col("_s")
    return out.select(key, *keep, score.alias("score"), (score > 0).cast("int").alias("pred"))


def classify_binary(train: DataFrame, docs: DataFrame, key: str = "m_idx", keep=("par_id", "label")) -> DataFrame:
    model = nb_word_scores(train)
    return nb_score(docs, model, nb_prior(train), key, keep=keep)


def _log_odds(c1, n1, c0, n0, v):
    return F.log((c1 + 1) / (n1 + v)) - F.log((c0 + 1) / (n0 + v))


def nb_multilabel_model(train: DataFrame, num_classes: int, text: str = "text",
                        label: str = "label") -> tuple[DataFrame, list]:
    """(word, lo ARRAY<DOUBLE>) one-vs-rest for every class, and the class
    priors.  One aggregate over words with a conditional sum per class: a
    token is counted for class c when its document has label[c] = 1, and
    c0 = all tokens of the word - c1."""
    w = train.select(F.col(label).alias("_y"), F.explode(lower_tokens(text)).alias("word"))
    counts = materialize(w.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.element_at("_y", c + 1)).alias(f"c{c}") for c in range(num_classes)]))
    tot = fetch_one(counts, n=F.sum("n"), v=F.count(F.lit(1)),
                    **{f"c{c}": F.sum(f"c{c}") for c in range(num_classes)})
    lo = [_log_odds(F.col(f"c{c}"), lit_long(tot[f"c{c}"]), F.col("n") - F.col(f"c{c}"),
                    lit_long(tot["n"] - tot[f"c{c}"]), lit_long(tot["v"]))
          for c in range(num_classes)]
    model = broadcast_if_small(counts.select("word", F.array(*lo).alias("lo")), tot["v"])
    docs = train.select(F.col(label).alias("_y"))
    pri = fetch_one(docs, **{f"p{c}": F.log((F.count(F.when(F.element_at("_y", c + 1) == 1, 1)) + 1)
                                            / (F.count(F.when(F.element_at("_y", c + 1) == 0, 1)) + 1))
                             for c in range(num_classes)})
    return model, [F.lit(pri[f"p{c}"]) for c in range(num_classes)]


def score_arrays(docs: DataFrame, model: DataFrame, priors: list, key: str = "m_idx", keep=()) -> DataFrame:
    """key, keep..., scores ARRAY<DOUBLE>: prior_c + sum tf * lo[c] for every
    class c, one join of (doc, word, tf) with the model and one aggregate."""
    terms = doc_terms(docs, key, keep=keep).join(model, "word", "left")
    zero = F.lit(0.0)
    s = terms.groupBy(key, *keep).agg(*[F.sum(F.col("tf") * F.coalesce(F.get("lo", F.lit(c)), zero)).alias(f"_s{c}")
                                        for c in range(len(priors))])
    return s.select(key, *keep, F.array(*[p + F.col(f"_s{c}") for c, p in enumerate(priors)]).alias("scores"))


def classify_multilabel(train: DataFrame, docs: DataFrame, num_classes: int, key: str = "m_idx",
                        keep=("par_id", "label")) -> DataFrame:
    """key, keep..., scores and pred ARRAY<INT> (width ``num_classes``, 1 when score > 0)."""
    model, priors = nb_multilabel_model(train, num_classes)
    s = score_arrays(docs, model, priors, key, keep)
    return s.withColumn("pred", F.transform("scores", lambda v: (v > 0).cast("int")))


def seed_members(train: DataFrame, seeds, n_per_label: int, key: str = "m_idx", by: str = "par_id") -> DataFrame:
    """(key, label, _ms): the places in ``seeds`` whose sample holds the row; rows in no sample are left out."""
    from parlance.operators.sampling import few_shot_samples

    drawn = few_shot_samples(train.select(key, by, "label"), n_per_label, seeds, key=by, order=key)
    place = F.create_map(*[v for i, s in enumerate(seeds) for v in (F.lit(int(s)), F.lit(i))])
    return drawn.groupBy(key, "label").agg(F.collect_set(place[F.col("seed")]).alias("_ms"))


def seed_ensemble(train: DataFrame, docs: DataFrame, seeds, n_per_label: int, key: str = "m_idx",
                  keep=("par_id", "label")) -> DataFrame:
    """One binary model per seeded few-shot sample of ``train``, all trained
    in one aggregate and applied in one join; logits [0, score] per seed;
    softmax mean; argmax.

    All samples are drawn in one pass over narrow columns and folded into a
    membership list per document (at most one entry per seed), so every
    training text is tokenised once whatever the number of seeds.
    """
    member = materialize(seed_members(train, seeds, n_per_label, key))
    tagged = train.select(key, "text").join(member, key)
    w = tagged.select("_ms", F.col("label").alias("_y"), F.explode(lower_tokens("text")).alias("word"))
    m = len(seeds)
    counts = materialize(w.groupBy("word").agg(
        *[F.count(F.when(F.array_contains("_ms", i) & (F.col("_y") == y), 1)).alias(f"c{y}_{i}")
          for i in range(m) for y in (0, 1)]))
    # Each member's vocabulary is its own words, as if it had been trained alone.
    own = [F.count(F.when(F.col(f"c1_{i}") + F.col(f"c0_{i}") > 0, 1)) for i in range(m)]
    tot = fetch_one(counts, v=F.count(F.lit(1)), **{f"v{i}": own[i] for i in range(m)},
                    **{f"c{y}_{i}": F.sum(f"c{y}_{i}") for i in range(m) for y in (0, 1)})
    lo = [F.when(F.col(f"c1_{i}") + F.col(f"c0_{i}") > 0,
                 _log_odds(F.col(f"c1_{i}"), lit_long(tot[f"c1_{i}"]), F.col(f"c0_{i}"), lit_long(tot[f"c0_{i}"]),
                           lit_long(tot[f"v{i}"]))).otherwise(F.lit(0.0)) for i in range(m)]
    model = broadcast_if_small(counts.select("word", F.array(*lo).alias("lo")), tot["v"])
    pri = fetch_one(member, **{f"p{i}": F.log((F.count(F.when(F.array_contains("_ms", i) & (F.col("label") == 1), 1)) + 1)
                                              / (F.count(F.when(F.array_contains("_ms", i) & (F.col("label") == 0), 1)) + 1))
                               for i in range(m)})
    scored = score_arrays(docs, model, [F.lit(pri[f"p{i}"]) for i in range(m)], key, keep)
    stacked = scored.select(key, *keep, F.posexplode("scores").alias("model_id", "_s")) \
                    .select(key, *keep, "model_id", F.array(F.lit(0.0), F.col("_s")).alias("logits"))
    return ensemble_vote(stacked, [key, *keep], 2)


def verbaliser_scores(word_scores: DataFrame, verbalizer: DataFrame, key: str) -> DataFrame:
    """(key, class_id, score): mean over a class's label words of the score at
    the mask.  ``word_scores`` is (key, word, score); ``verbalizer`` (class_id, word)."""
    j = word_scores.join(verbalizer, "word")
    return j.groupBy(key, "class_id").agg(F.avg("score").alias("score"))


def classify_ml(train: DataFrame, docs: DataFrame, num_features: int = 1 << 18, key: str = "par_id",
                max_iter: int = 50, vocabulary: bool = False):
    """pyspark.ml pipeline: tokenizer, term counts, IDF, class-weighted
    logistic regression.  Returns (key, label, pred) for ``docs``.

    Counts are hashed to ``num_features`` places: with more distinct words
    than that, words share a weight, so raise it with the vocabulary.  With
    ``vocabulary`` the ``num_features`` most frequent words of the training
    rows each have a weight of their own and the others none; the vocabulary
    is then held by the driver, so ``num_features`` bounds it.
    ``max_iter`` bounds the optimiser's passes over the training rows.  A
    training set of one class predicts that class.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, RegexTokenizer

    c = fetch_one(train, n=F.count(F.lit(1)), npos=F.count(F.when(F.col("label") == 1, 1)))
    n, npos = c["n"], c["npos"]
    if npos in (0, n):
        return docs.select(key, "label", F.lit(1 if n and npos == n else 0).alias("pred"))
    w = F.when(F.col("label") == 1, n / (2 * npos)).otherwise(n / (2 * (n - npos)))
    tr = train.select("text", F.col("label").cast("double").alias("label"), w.alias("w"))
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tok", pattern=PY_WS_RUN, toLowercase=True),
        CountVectorizer(inputCol="tok", outputCol="tf", vocabSize=num_features) if vocabulary
        else HashingTF(inputCol="tok", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=max_iter, regParam=0.01),
    ])
    model = pipe.fit(tr)
    out = model.transform(docs.select(key, "text", "label"))
    return out.select(key, "label", F.col("prediction").cast("int").alias("pred"))


def classify_ml_multilabel(train: DataFrame, docs: DataFrame, num_classes: int, num_features: int = 1 << 18, key: str = "m_idx",
                           keep=("par_id", "label"), max_iter: int = 50) -> DataFrame:
    """key, keep..., pred ARRAY<INT>: learnt weights for several labels, one class-weighted logistic regression per class.

    ``label`` is ARRAY<INT> of width ``num_classes``.  Texts are turned into
    features once, for training and for ``docs``; both are written, so every
    fit reads features.  A class that all or no training rows have is
    predicted for all or none.  A null text has no words.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    count = fetch_one(train, n=F.count(F.lit(1)), **{f"c{c}": F.count(F.when(F.get("label", F.lit(c)) == 1, 1)) for c in range(num_classes)})
    texts = lambda df, *cols: df.select(*cols, F.coalesce("text", F.lit("")).alias("text"))
    pipe = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="tok", pattern=PY_WS_RUN, toLowercase=True),
                            HashingTF(inputCol="tok", outputCol="tf", numFeatures=num_features),
                            IDF(inputCol="tf", outputCol="features")])
    tr = texts(train, "label")
    read = pipe.fit(tr) if count["n"] else None
    if read is None:
        return docs.select(key, *keep, F.array_repeat(F.lit(0), num_classes).alias("pred"))
    learn = materialize(read.transform(tr).select("label", "features"))
    out = materialize(read.transform(texts(docs, key, *keep)).select(key, *keep, "features"))
    preds = []
    for c in range(num_classes):
        n, npos = count["n"], count[f"c{c}"]
        if npos in (0, n):
            preds.append(F.lit(int(npos > 0)))
            continue
        y = (F.get("label", F.lit(c)) == 1).cast("double")
        w = F.when(y == 1, n / (2 * npos)).otherwise(n / (2 * (n - npos)))
        fit = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", maxIter=max_iter, regParam=0.01,
                                 rawPredictionCol=f"_r{c}", probabilityCol=f"_p{c}", predictionCol=f"_d{c}")
        out = fit.fit(learn.select("features", y.alias("_y"), w.alias("_w"))).transform(out).drop(f"_r{c}", f"_p{c}")
        preds.append(F.col(f"_d{c}").cast("int"))
    return out.select(key, *keep, F.array(*preds).alias("pred"))
