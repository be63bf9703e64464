"""Score-vector expressions: argmax, softmax, log-softmax, one-hot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(x) -> Column:
    """0-based index of the largest entry; ties go to the lowest index."""
    x = _c(x)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def log_sum_exp(x) -> Column:
    x = _c(x)
    m = F.array_max(x)
    return m + F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))


def softmax(x) -> Column:
    """Stable softmax: exp(x - max) / sum(exp(x - max))."""
    x = _c(x)
    m = F.array_max(x)
    z = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))
    return F.transform(x, lambda v: F.exp(v - m) / z)


def log_softmax_at(x, idx) -> Column:
    """log softmax(x)[idx] in the stable form."""
    x = _c(x)
    return F.element_at(x, _c(idx) + 1).cast("double") - log_sum_exp(x)


def one_hot(label, num_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)),
                       lambda i: (i == _c(label)).cast("int"))


def doubles(x) -> Column:
    return F.transform(_c(x), lambda v: v.cast("double"))
