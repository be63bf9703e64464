"""Scores of label words at the mask of a prompt, from an n-gram model.

The original work asks a masked language model for the words at ``<mask>``.
Here the words before the mask vote: for every pair (a, b) of neighbouring
words there, P2(w | a, b) is the share of label word w at the mask of the
training prompts that hold the pair, interpolated with P1(w | b), which is
interpolated with P0(w):

    P1(w | b)    = (n(b, w) + mu P0(w)) / (n(b) + mu)
    P2(w | a, b) = (n(a, b, w) + mu P1(w | b)) / (n(a, b) + mu)

An unseen pair backs off to P1, an unseen word to P0.  A prompt's score for w
is ln P0(w) + sum over its pairs of ln(P2(w | a, b) / P0(w)).

The counts are tables keyed by context; a prompt is first reduced to one row
per pair and then joined with them.  A pair's row in the table carries the
counts of its last word too, so that only unseen pairs need the second table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import lower_tokens
from parlance.operators.prompts import MASK
from parlance.plans.ordering import broadcast_if_small, fetch_one, materialize

MU = 2.0


@dataclass
class MaskModel:
    """words: the label words; p0: their shares; pairs: (a, b, n2, n1); singles: (b, m1); counts are arrays by label word."""

    words: list[str]
    p0: list[float]
    pairs: DataFrame
    singles: DataFrame
    mu: float = MU


def contexts(df: DataFrame, keep=(), prompt: str = "prompt") -> DataFrame:
    """(keep..., a, b, tf): neighbouring lower-cased words before the mask, once per row of ``keep``.

    A prompt with fewer than two words there gives one row with null words.
    """
    before = F.element_at(F.split(F.col(prompt), MASK), 1)
    toks = df.select(*keep, lower_tokens(before).alias("_t"))
    n = F.greatest(F.size("_t") - 1, F.lit(0))
    each = toks.select(*keep, F.explode_outer(F.arrays_zip(F.slice("_t", 1, n).alias("a"), F.slice("_t", 2, n).alias("b"))).alias("_p"))
    return each.groupBy(*keep, F.col("_p.a").alias("a"), F.col("_p.b").alias("b")).agg(F.count(F.lit(1)).alias("tf"))


def train_mask_model(train: DataFrame, words, prompt: str = "prompt", answer: str = "answer", mu: float = MU) -> MaskModel:
    """Counts over training prompts whose mask stands for ``answer``, one of the label ``words``; other rows are left out."""
    words = list(words)
    rows = train.filter(F.col(answer).isin(*words) & F.col(prompt).isNotNull())
    size = fetch_one(rows, **{f"w{i}": F.count(F.when(F.col(answer) == w, 1)) for i, w in enumerate(words)})
    total = sum(size.values())
    p0 = [(size[f"w{i}"] + 1) / (total + len(words)) for i in range(len(words))]
    met = contexts(rows, (answer,), prompt).filter("b is not null")
    counts = lambda: F.array(*[F.coalesce(F.sum(F.when(F.col(answer) == w, F.col("tf"))), F.lit(0)) for w in words])
    pairs = materialize(met.groupBy("a", "b").agg(counts().alias("n2")))
    by_word = [F.sum(F.get("n2", F.lit(i))) for i in range(len(words))]
    singles = materialize(pairs.groupBy("b").agg(F.array(*by_word).alias("m1")))
    known = fetch_one(singles, n=F.count(F.lit(1)))["n"]
    singles = broadcast_if_small(singles, known)
    pairs = pairs.join(singles, "b").select("a", "b", "n2", F.col("m1").alias("n1"))
    return MaskModel(words, p0, materialize(pairs), singles, mu)


def _share(n: Column, i: int, rest: Column, mu: float) -> Column:
    total = F.aggregate(n, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return (F.get(n, F.lit(i)) + F.lit(mu) * rest) / (total + F.lit(mu))


def mask_word_scores(prompts: DataFrame, model: MaskModel, key: str = "m_idx", prompt: str = "prompt", keep=()) -> DataFrame:
    """key, keep..., word, score: one row per prompt and label word.  ``key`` is unique; a null prompt scores ln P0."""
    met = contexts(prompts, (key, *keep), prompt).join(model.pairs, ["a", "b"], "left")
    met = met.join(model.singles, "b", "left")
    none = F.array(*[F.lit(0).cast("bigint") for _ in model.words])
    two, one = F.coalesce("n2", none), F.coalesce("n1", "m1", none)
    votes = []
    for i, p in enumerate(model.p0):
        p2 = _share(two, i, _share(one, i, F.lit(p), model.mu), model.mu)
        votes.append(F.log(F.lit(p)) + F.sum(F.when(F.col("b").isNotNull(), F.col("tf") * F.log(p2 / F.lit(p))).otherwise(0.0)))
    scored = met.groupBy(key, *keep).agg(F.array(*votes).alias("_s"))
    names = F.array(*[F.lit(w) for w in model.words])
    return scored.select(key, *keep, F.explode(F.arrays_zip(names.alias("word"), F.col("_s").alias("score"))).alias("_z")).select(
        key, *keep, "_z.word", "_z.score")


def predicted_class(class_scores: DataFrame, key: str = "m_idx") -> DataFrame:
    """key, pred: the class with the highest score, ties to the smaller class."""
    return class_scores.groupBy(key).agg(F.max_by("class_id", F.struct("score", -F.col("class_id"))).cast("int").alias("pred"))
