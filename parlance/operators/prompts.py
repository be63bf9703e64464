"""Prompt rendering: pair prompts with targets, test prompts, cloze and
in-context templates.  Pure column expressions; random choices are seeded
hashes of the paragraph id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.hashing import pick
from parlance.operators.labels import LABEL_WORDS

# Template tokens and word lists of the prompt files.
MASK = "<mask>"
SEP = "</s>"
ANSWER_WORDS = ["No", "Yes"]
PCL_WORDS = ["patronizing", "condescending"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pcl_word(key, seed: int = 42) -> Column:
    """One of PCL_WORDS drawn per row."""
    return F.element_at(F.array(*[F.lit(w) for w in PCL_WORDS]), (pick(len(PCL_WORDS), _c(key), seed, "pcl") + 1).cast("int"))


def prompt_pair(df: DataFrame, seed: int = 42, key: str = "par_id") -> DataFrame:
    """prompt: '{text} </s> <mask> , this paragraph is {pcl} for {keyword} .'
    target: the same with Yes/No in place of the mask."""
    pcl = pcl_word(key, seed)
    tail = F.concat(F.lit(" , this paragraph is "), pcl, F.lit(" for "), F.col("keyword"), F.lit(" ."))
    answer = F.element_at(F.array(*[F.lit(w) for w in ANSWER_WORDS]), F.col("label").cast("int") + 1)
    prompt = F.concat(F.col("text"), F.lit(f" {SEP} {MASK}"), tail)
    target = F.concat(F.col("text"), F.lit(f" {SEP} "), answer, tail)
    return df.withColumn("prompt", prompt).withColumn("target", target)


def prompt_test(df: DataFrame, seed: int = 42, key: str = "par_id") -> DataFrame:
    """'{text} </s> <mask> , this paragraph is not {pcl} for {keyword} .'"""
    pcl = pcl_word(key, seed)
    return df.withColumn("prompt", F.concat(F.col("text"), F.lit(f" {SEP} {MASK} , this paragraph is not "), pcl,
                                            F.lit(" for "), F.col("keyword"), F.lit(" .")))


def cloze_prompt(df: DataFrame) -> DataFrame:
    """'{text} It was <mask> .' plus meta (keyword, country)."""
    return df.withColumn("prompt", F.concat(F.col("text"), F.lit(f" It was {MASK} ."))) \
             .withColumn("meta", F.struct("keyword", "country"))


def incontext_prompt(df: DataFrame) -> DataFrame:
    """'{text} It was <mask> </s> {pos} It was patronizing . </s> {neg} It was respectful .'
    on rows carrying pos_text / neg_text (see ``attach_demonstrations``)."""
    return df.withColumn("prompt", F.concat(
        F.col("text"), F.lit(f" It was {MASK} {SEP} "), F.col("pos_text"), F.lit(f" It was {LABEL_WORDS[1]} . {SEP} "),
        F.col("neg_text"), F.lit(f" It was {LABEL_WORDS[0]} .")))
