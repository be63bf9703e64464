"""Writers: ordered line files with optional header lines per file.

Rows are range-partitioned on the order key and sorted inside each
partition, so part files follow the order by name and line.  Header lines
are generated in front of the first row of each partition (a narrow
generator, no extra job), so every file reads back the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import LONG_TEXT_TOKENS, collapse_ws, token_count
from parlance.operators.labels import render_ints

HEADER_LINES = 4
_LOW33 = (1 << 33) - 1


def _ranged(df: DataFrame, num_files: int | None, order) -> DataFrame:
    """Range partitions by ``order``; their number is Spark's choice unless the caller names it."""
    return df.repartitionByRange(num_files, *order) if num_files else df.repartitionByRange(*order)


def write_lines(df: DataFrame, line: Column, path: str, order, header_lines: int = 0,
                num_files: int | None = None, mode: str = "error") -> str:
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    x = (_ranged(df, num_files, order).sortWithinPartitions(*order)
           .select(line.alias("_line"), F.monotonically_increasing_id().alias("_m")))
    if header_lines:
        first = F.col("_m").bitwiseAND(F.lit(_LOW33)) == 0
        lines = F.when(first, F.concat(F.array_repeat(F.lit(""), header_lines), F.array(F.col("_line")))) \
                 .otherwise(F.array(F.col("_line")))
        x = x.select(F.explode(lines).alias("_line"))
    x.select(F.col("_line").alias("value")).write.mode(mode).text(path)
    return path


def _tsv(*cols) -> Column:
    return F.concat_ws("\t", *[c if isinstance(c, Column) else F.col(c) for c in cols])


def write_labelled_tsv(df: DataFrame, path: str, order=("row_idx",), header_lines: int = HEADER_LINES,
                       long_only: bool = False, **kw) -> str:
    """par_id, art_id, keyword, country, text, orig_label; whitespace in text
    collapsed to single spaces.  ``long_only`` keeps rows with more than 63
    tokens (what the reference's writer always does)."""
    if long_only:
        df = df.filter(token_count("text") > LONG_TEXT_TOKENS)
    line = _tsv("par_id", "art_id", "keyword", "country", collapse_ws("text"), "orig_label")
    return write_lines(df, line, path, order, header_lines, **kw)


def write_augmented_tsv(df: DataFrame, path: str, order=("row_idx",), header_lines: int = HEADER_LINES, **kw) -> str:
    """As the labelled writer.  header_lines=4 (default) reads back losslessly;
    0 reproduces the reference, whose reader then drops the first 4 rows."""
    return write_labelled_tsv(df, path, order, header_lines, **kw)


def write_span_tsv(df: DataFrame, path: str, order=("row_idx",), header_lines: int = HEADER_LINES, **kw) -> str:
    line = _tsv("par_id", "art_id", collapse_ws("text"), "keyword", "country", "start", "finish",
                collapse_ws("text_span"), "category", "num_annotators")
    return write_lines(df, line, path, order, header_lines, **kw)


def write_unlabelled_tsv(df: DataFrame, path: str, order=("row_idx",), **kw) -> str:
    return write_lines(df, _tsv("par_id", "art_id", "keyword", "country", collapse_ws("text")), path, order, 0, **kw)


def write_text_label(df: DataFrame, path: str, order=("row_idx",), **kw) -> str:
    return write_lines(df, _tsv(collapse_ws("text"), F.col("label").cast("string")), path, order, 0, **kw)


def write_text_lines(df: DataFrame, path: str, text: str = "text", order=("row_idx",), **kw) -> str:
    return write_lines(df, collapse_ws(text), path, order, 0, **kw)


def write_label_lines(df: DataFrame, path: str, pred: str = "pred", order=("row_idx",), **kw) -> str:
    """One prediction per line; array predictions are comma-joined."""
    t = dict(df.dtypes)[pred]
    line = render_ints(pred) if t.startswith("array") else F.col(pred).cast("string")
    return write_lines(df, line, path, order, 0, **kw)


def write_prompts(df: DataFrame, path: str, order=("row_idx",), with_target: bool = True, **kw) -> str:
    line = _tsv(collapse_ws("prompt"), collapse_ws("target")) if with_target else collapse_ws("prompt")
    return write_lines(df, line, path, order, 0, **kw)


def write_manifest_csv(df: DataFrame, path: str, order=("m_idx",), **kw) -> str:
    """par_id,label CSV with a header, in manifest order."""
    (_ranged(df, kw.get("num_files"), order).sortWithinPartitions(*order)
       .select(F.col("par_id").cast("bigint").alias("par_id"), "label")
       .write.mode(kw.get("mode", "error")).option("header", True).csv(path))
    return path


def write_score_lines(df: DataFrame, path: str, order=("row_idx",), scores: str = "logits", **kw) -> str:
    """One line per row: the scores joined by commas, in digits that read back as the same numbers."""
    line = F.array_join(F.transform(F.col(scores), lambda v: v.cast("double").cast("string")), ",")
    return write_lines(df, line, path, order, **kw)
