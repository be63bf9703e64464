"""Whitespace tokenisation and text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split()/str.strip() treat as
# whitespace: \t \n \x0b \x0c \r \x1c-\x1f space \x85 \xa0 \u1680
# \u2000-\u200a \u2028 \u2029 \u202f \u205f \u3000.
PY_WS_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
PY_WS_RUN = PY_WS_CLASS + "+"

# Threshold of the long-text filter (strictly more tokens than this).
LONG_TEXT_TOKENS = 63


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """``text.split()``: split on whitespace runs, drop empty pieces."""
    return F.filter(F.split(_c(text), PY_WS_RUN), lambda t: t != F.lit(""))


def lower_tokens(text) -> Column:
    """``text.lower().split()``."""
    return tokens(F.lower(_c(text)))


def token_count(text) -> Column:
    return F.size(tokens(text))


def py_strip(text) -> Column:
    """``str.strip()``: remove leading/trailing Python whitespace."""
    return F.regexp_replace(_c(text), f"^{PY_WS_RUN}|{PY_WS_RUN}$", "")


def collapse_ws(text) -> Column:
    """One space for every whitespace run, no outer blanks (safe TSV field)."""
    return F.array_join(tokens(text), " ")
