"""Label projections: binarise, verbalise, category lists, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import LONG_TEXT_TOKENS, token_count

# Graded labels counted as negative; every other grade
# (including unknown or missing ones) is positive.
NEGATIVE_GRADES = ["0", "1"]
# Verbalizer words per class id.
LABEL_WORDS = {0: "respectful", 1: "patronizing"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binarise(grade, strict: bool = False) -> Column:
    """'0'/'1' -> 0, anything else -> 1; ``strict`` fails on grades outside 0..4."""
    g = _c(grade)
    out = F.when(g.isin(*NEGATIVE_GRADES), F.lit(0)).otherwise(F.lit(1))
    if strict:
        out = F.when(g.isin("0", "1", "2", "3", "4"), out).otherwise(
            F.raise_error(F.concat(F.lit("unknown grade: "), F.coalesce(g, F.lit("NULL")))))
    return out.cast("int")


def filter_class(df: DataFrame, label: int, col: str = "label") -> DataFrame:
    return df.filter(F.col(col) == label)


def filter_grade(df: DataFrame, grade: str, col: str = "orig_label") -> DataFrame:
    return df.filter(F.col(col) == grade)


def filter_group(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.filter(F.col(col) == value)


def filter_long_text(df: DataFrame, text: str = "text", threshold: int = LONG_TEXT_TOKENS,
                     long: bool = True) -> DataFrame:
    """Rows with more than ``threshold`` whitespace tokens (or the rest)."""
    cond = token_count(text) > threshold
    return df.filter(cond if long else ~cond)


def parse_category_list(text) -> Column:
    """'[1, 0, 0, ...]' -> ARRAY<INT>."""
    return F.from_json(_c(text), "array<int>")


def any_category(labels) -> Column:
    """True when a multi-hot vector has at least one active class."""
    return F.aggregate(_c(labels), F.lit(0), lambda acc, v: acc + v) > 0


def render_ints(arr, sep: str = ",") -> Column:
    """ARRAY<INT> -> 'a,b,c' (the multi-label prediction file format)."""
    return F.array_join(_c(arr).cast("array<string>"), sep)


def verbalise(label) -> Column:
    m = F.create_map(*[x for k, v in LABEL_WORDS.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(label)]


def unverbalise(word) -> Column:
    m = F.create_map(*[x for k, v in LABEL_WORDS.items() for x in (F.lit(v), F.lit(k))])
    return m[_c(word)]


def project_text_label(df: DataFrame) -> DataFrame:
    """``df[['text', 'label']]`` with text as string and label as int (nulls kept)."""
    return df.select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
