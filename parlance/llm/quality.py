"""Quality rules by weak supervision, in DataFrame functions only.

Statistics of a text become votes: every rule says good, bad or abstains.
The corpus is reduced to one count per vote pattern (at most 3 to the number
of rules), expectation-maximisation on those counts estimates how often each
rule says bad on good and on bad texts, and a text is kept if its posterior
probability of being good reaches the threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.plans.ordering import materialize

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = "[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
ROUNDS = 60
MAX_FALSE = 0.01

# Votes by rule: bad if the first condition holds, good if the second does,
# else the rule abstains.  Shares are per hundred of the named base.
RULES = {
    "symbols": ("100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    "dup_lines": ("100 * n_dup_lines > 45 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
    "repeats": ("100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "capitals": ("100 * n_capitals > 30 * word_chars", "100 * n_capitals <= 10 * word_chars"),
    "stops": ("100 * n_stops > 60 * n_words", "100 * n_stops between 2 * n_words and 40 * n_words"),
    "word_length": ("word_chars > 12 * n_words or word_chars < 2 * n_words",
                    "word_chars between 3 * n_words and 9 * n_words"),
    "variety": ("n_words >= 20 and 100 * n_distinct < 20 * n_words", "100 * n_distinct >= 35 * n_words"),
}


def _repeat_words(keys: str) -> Column:
    """Words inside windows that occur twice or more, from the window hashes in time order.

    ``keys`` holds (hash, place) sorted by hash: equal neighbours repeat.
    The places are sorted again, and each covers its words up to the next.
    """
    s = F.col(keys)
    again = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(places, start, lambda acc, x: F.struct(
        x.alias("last"), (acc["total"] + F.least(F.lit(3), x - acc["last"])).alias("total")), lambda acc: acc["total"])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, one row per row of ``docs`` (null text: no words).

    Windows are compared by a 64-bit hash of their three words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(_WORD)))
    d = d.select("doc_id", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"), lines.alias("lines"),
                 F.char_length(F.regexp_replace("text", _SPACE, "")).cast("long").alias("word_chars"),
                 F.regexp_count("text", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
                 F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
                 F.regexp_count("text", F.lit(r"[.,;:!?](?![^\x20\x09-\x0D])")).cast("long").alias("n_stops"))
    plain = ["doc_id", "word_chars", "n_symbols", "n_capitals", "n_stops"]
    n = F.size("words")
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    d = d.select(*plain, n.cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.when(n >= 4, hashed).otherwise(F.array().cast("array<bigint>")).alias("keys"))
    plain += ["n_words", "n_distinct", "n_lines", "n_dup_lines"]
    paired = F.sort_array(F.transform(F.col("keys"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select(*plain, F.when(F.size(F.array_distinct("keys")) < F.size("keys"), paired)
                 .otherwise(nothing).alias("keys"))
    return d.select(*plain, F.coalesce(_repeat_words("keys"), F.lit(0)).cast("long").alias("n_repeat_words"))


def with_votes(stats: DataFrame, rules: dict = RULES) -> DataFrame:
    """``stats`` with ``votes``, one of -1 (bad), 0 (abstains), 1 (good) per rule; a text without words abstains."""
    cast = [F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("tinyint")
            for bad, good in rules.values()]
    return stats.withColumn("votes", F.array(*cast))


@dataclass(frozen=True)
class Voters:
    """A mixture: class 0 are good texts, class r + 1 the bad texts of the kind
    that rule r is written for.  ``weight`` per class; ``says_bad[c][r]`` is
    how often rule r says bad on class c when it votes."""

    weight: list[float]
    says_bad: list[list[float]]

    def scores(self, votes) -> list[float]:
        """Log weight of every class together with ``votes``."""
        return [math.log(w) + sum(math.log(p if v < 0 else 1 - p) for v, p in zip(votes, says) if v)
                for w, says in zip(self.weight, self.says_bad)]

    def posteriors(self, votes) -> list[float]:
        x = self.scores(votes)
        top = max(x)
        e = [math.exp(v - top) for v in x]
        return [v / sum(e) for v in e]


def start_voters(n_rules: int) -> Voters:
    """Rules seldom call a good text bad, mostly their own kind, now and then another kind."""
    own = lambda c, r: 0.002 if c == 0 else 0.9 if c == r + 1 else 0.2
    return Voters([0.85] + [0.15 / n_rules] * n_rules,
                  [[own(c, r) for r in range(n_rules)] for c in range(n_rules + 1)])


def fit_voters(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> Voters:
    """Expectation-maximisation over (votes, count) pairs.

    Pseudo-counts of the start keep an empty or one-sided table defined.  A
    kind of bad texts that one rule alone sees cannot be told from that
    rule's errors on good texts by counts; so a rule calls at most MAX_FALSE
    of the good texts bad, and at least half of its own kind.
    """
    first = model = start_voters(n_rules)
    pseudo = 10.0
    total = sum(c for _, c in patterns)
    cut = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    for _ in range(rounds):
        held = [pseudo * w for w in first.weight]
        bad = [[pseudo * p for p in row] for row in first.says_bad]
        voted = [[pseudo] * n_rules for _ in first.weight]
        for votes, count in patterns:
            for c, share in enumerate(model.posteriors(votes)):
                held[c] += count * share
                for r, v in enumerate(votes):
                    if v:
                        voted[c][r] += count * share
                        bad[c][r] += count * share * (v < 0)
        says = [[cut(b / n) for b, n in zip(*rows)] for rows in zip(bad, voted)]
        for r in range(n_rules):
            says[0][r] = min(says[0][r], MAX_FALSE)
            says[r + 1][r] = max(says[r + 1][r], 0.5)
        model = Voters([cut(h / (total + pseudo)) for h in held], says)
    return model


def learn_voters(voted: DataFrame, n_rules: int = len(RULES)) -> Voters:
    """The voters of a table: at most 3 ** n_rules pattern counts reach the driver."""
    rows = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_voters(sorted((tuple(r["votes"]), r["n"]) for r in rows), n_rules)


def posterior(model: Voters) -> Column:
    """Probability that a row with ``votes`` is good."""
    def score(c: int) -> Column:
        x = F.lit(math.log(model.weight[c]))
        for r, p in enumerate(model.says_bad[c]):
            v = F.col("votes")[r]
            x = x + F.when(v < 0, F.lit(math.log(p))).when(v > 0, F.lit(math.log(1 - p))).otherwise(F.lit(0.0))
        return x
    good = score(0)
    worse = [F.exp(score(c) - good) for c in range(1, len(model.weight))]
    return 1 / (1 + sum(worse[1:], worse[0]))


def quality(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Counts, posterior and decision of every row of ``docs`` (doc_id, text).

    ``base_failed`` if the text has fewer than 50 words or more than half of
    them in repeated windows; ``kept`` if not, and the posterior is at least
    ``keep_at``.  A null, empty or blank text has no words, all rules abstain
    and the base fails.  Equal rows get equal results; an empty table gives
    no rows (the start values then stand for the voters).
    """
    voted = materialize(with_votes(text_statistics(docs)))
    model = learn_voters(voted)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & (posterior(model) >= keep_at)).alias("kept"),
                        posterior(model).alias("p_good"))
