"""Registry of named queries: a Spark builder and (when SQL can say it) its
DuckDB twin.  Modules under ``parlance.plans.q_*`` register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    import importlib
    for mod in ("q_profile", "q_metrics", "q_splits", "q_scores", "q_text", "q_classify", "q_io", "q_augment", "q_models", "q_store"):
        importlib.import_module(f"parlance.plans.{mod}")
