"""Readers for the corpus formats (paths may be files, folders or globs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import py_strip
from parlance.operators.categories import category_id
from parlance.operators.labels import binarise
from parlance.plans.fixtures import CATEGORIES
from parlance.sources.lines import indexed_lines

HEADER_LINES = 4
TAB = "\t"


def _fields(c: Column) -> Column:
    return F.split(c, TAB, -1)


def _check(df: DataFrame, fields: str, need: int, mode: str) -> DataFrame:
    """strict: fail on lines with fewer than ``need`` fields (the reference
    raises IndexError); permissive: keep them with a ``_corrupt_record`` column.
    The check wraps the parsed fields, so it cannot be pruned away."""
    short = F.size(fields) < need
    if mode == "strict":
        return df.withColumn(fields, F.when(short, F.raise_error(
            F.concat(F.lit(f"line has fewer than {need} fields: "), F.col("value")))).otherwise(F.col(fields)))
    if mode == "permissive":
        return df.withColumn("_corrupt_record", F.when(short, F.col("value")))
    raise ValueError(mode)


def read_labelled_tsv(spark: SparkSession, path, header_lines: int = HEADER_LINES,
                      mode: str = "strict", strict_grades: bool = False) -> DataFrame:
    """row_idx, par_id, art_id, keyword, country, text, label, orig_label.
    Fields come from the stripped line; the grade is the last field."""
    lines = indexed_lines(spark, path, header_lines)
    lines = lines.withColumn("_f", _fields(py_strip("value")))
    lines = _check(lines, "_f", 5, mode)
    f = F.col("_f")
    grade = F.element_at(f, -1)
    out = lines.select("row_idx", *[F.get(f, i).alias(n) for i, n in enumerate(("par_id", "art_id", "keyword", "country", "text"))],
                       binarise(grade, strict_grades).alias("label"), grade.alias("orig_label"),
                       *(["_corrupt_record"] if mode == "permissive" else []))
    return out


def read_span_tsv(spark: SparkSession, path, header_lines: int = HEADER_LINES,
                  categories=CATEGORIES) -> DataFrame:
    """One row per span: row_idx, par_id, art_id, text, keyword, country, start,
    finish, text_span, category, category_id, num_annotators.  Ids come from the
    stripped line, text/keyword/country/offsets from the raw line, the
    category is the second-last field; unknown categories fail the job."""
    lines = indexed_lines(spark, path, header_lines)
    s = _fields(py_strip("value"))
    r = _fields(F.col("value"))
    x = lines.select("row_idx", s.alias("s"), r.alias("r"), "value")
    x = _check(x, "s", 7, "strict")
    return x.select("row_idx", F.get(F.col("s"), 0).alias("par_id"), F.get(F.col("s"), 1).alias("art_id"),
                    F.get(F.col("r"), 2).alias("text"), F.get(F.col("r"), 3).alias("keyword"), F.get(F.col("r"), 4).alias("country"),
                    F.get(F.col("r"), 5).alias("start"), F.get(F.col("r"), 6).alias("finish"), F.get(F.col("r"), 7).alias("text_span"),
                    F.element_at("s", -2).alias("category"),
                    category_id(F.element_at("s", -2), categories).alias("category_id"),
                    F.element_at("s", -1).alias("num_annotators"))


def read_unlabelled_tsv(spark: SparkSession, path) -> DataFrame:
    """row_idx, par_id, art_id, keyword, country, text (no header lines)."""
    lines = indexed_lines(spark, path, 0).withColumn("_f", _fields(py_strip("value")))
    f = F.col("_f")
    return lines.select("row_idx", *[F.get(f, i).alias(n) for i, n in enumerate(("par_id", "art_id", "keyword", "country", "text"))])


def read_split_manifest(spark: SparkSession, path) -> DataFrame:
    """m_idx (0-based place in the file), par_id (integer in the file, returned
    as text), label (text of a list).  Every file has one header line; a line
    that is no such record fails the job."""
    lines = indexed_lines(spark, path, 1).withColumn(
        "_r", F.from_csv("value", "par_id BIGINT, label STRING", {"mode": "FAILFAST"}))
    return lines.select(F.col("row_idx").alias("m_idx"), F.col("_r.par_id").cast("string").alias("par_id"), "_r.label")


def read_prompt_pairs(spark: SparkSession, path) -> DataFrame:
    """row_idx, source, target: 'source<TAB>target' per stripped line; a line with one field fails the job."""
    lines = _check(indexed_lines(spark, path, 0).withColumn("_f", _fields(py_strip("value"))), "_f", 2, "strict")
    return lines.select("row_idx", F.get(F.col("_f"), 0).alias("source"), F.get(F.col("_f"), 1).alias("target"))


def read_prompt_lines(spark: SparkSession, path) -> DataFrame:
    """row_idx, text: one stripped line per row."""
    return indexed_lines(spark, path, 0).select("row_idx", py_strip("value").alias("text"))


def read_label_lines(spark: SparkSession, path) -> DataFrame:
    """row_idx, pred: one integer per line, position kept."""
    return indexed_lines(spark, path, 0).select("row_idx", py_strip("value").cast("int").alias("pred"))


def read_label_pairs(spark: SparkSession, path) -> DataFrame:
    """row_idx, label: the label is field 0 of a one-field line, else field 1."""
    lines = indexed_lines(spark, path, 0).withColumn("_f", _fields(py_strip("value")))
    lab = F.when(F.size("_f") == 1, F.get(F.col("_f"), 0)).otherwise(F.get(F.col("_f"), 1))
    return lines.select("row_idx", lab.cast("int").alias("label"))


def read_score_lines(spark: SparkSession, path, num_classes: int | None = None) -> DataFrame:
    """row_idx, logits ARRAY<DOUBLE>: numbers joined by commas, one line per row.  A line with another number of
    scores than ``num_classes`` (if named) fails the job, and so does what is no number."""
    lines = indexed_lines(spark, path, 0).select("row_idx", F.split(py_strip("value"), ",").cast("array<double>").alias("logits"), "value")
    if num_classes is not None:
        lines = lines.withColumn("logits", F.when(F.size("logits") == num_classes, F.col("logits")).otherwise(
            F.raise_error(F.concat(F.lit(f"line has not {num_classes} scores: "), F.col("value")))))
    return lines.select("row_idx", "logits")
