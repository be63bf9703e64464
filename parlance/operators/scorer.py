"""Scoring with the caller's own model.

The word-statistics scorers are plans of built-in functions.  A model of the
caller (an ONNX session, a NumPy matrix, a tagger) is Python code, so this is
the one place of the library's core where a Python worker is right: texts
come in Arrow batches, cut to a bounded number of rows and bytes, and the
model is built once per worker process and kept for all its tasks.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.plans.ordering import fetch_one
from parlance.plans.workers import bounded, map_arrow

Scorer = Callable[[Sequence[str]], np.ndarray]

BATCH_ROWS = 4096
BATCH_BYTES = 4 << 20
# Models that a worker process keeps; the one used longest ago goes first.
KEPT_MODELS = 2
# Words and bytes of a word table that every worker may hold.
MODEL_WORDS, MODEL_BYTES = 2_000_000, 128 << 20

_models: OrderedDict[str, Scorer] = OrderedDict()


def _model(token: str, make: Callable[[], Scorer]) -> Scorer:
    if token not in _models:
        _models[token] = make()
        while len(_models) > KEPT_MODELS:
            _models.popitem(last=False)
    _models.move_to_end(token)
    return _models[token]


def user_scores(docs: DataFrame, make_scorer: Callable[[], Scorer], key: str = "row_idx", text: str = "text", keep=(),
                width: int | None = None, batch_rows: int = BATCH_ROWS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """key, keep..., score DOUBLE of every row (or scores ARRAY<DOUBLE> of length ``width``).

    ``make_scorer`` runs once per worker process and returns a function from
    a list of texts to one number per text (or one row of ``width`` numbers).
    It is sent to the workers, so it should load large models itself, from a
    place that all of them see, or read them from a Spark broadcast.  A null
    text is the empty text.  A scorer that returns another shape fails the
    job.  No call gets more than ``batch_rows`` texts or, unless one text
    alone is longer, ``batch_bytes`` bytes of them.
    """
    out = "score" if width is None else "scores"
    kind = T.DoubleType() if width is None else T.ArrayType(T.DoubleType(), False)
    rows = docs.select(key, *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, kind, False)])
    arrow, token = to_arrow_schema(schema), uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            for part in bounded(batch, "_text", batch_bytes, batch_rows):
                texts = part.column(part.num_columns - 1).to_pylist()
                got = np.asarray(_model(token, make_scorer)(texts), np.float64)
                want = (len(texts),) if width is None else (len(texts), width)
                if got.shape != want:
                    raise ValueError(f"the scorer returned shape {got.shape}, not {want}")
                scored = pa.array(got if width is None else list(got), arrow.field(out).type)
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(part.columns[:-1], arrow)], scored], schema=arrow)
    return map_arrow(rows, run, schema)


def word_table_scorer(model: DataFrame, prior: float) -> Callable[[], Scorer]:
    """A NumPy scorer for a (word, lo) table: prior + sum of lo over a text's words, unseen words 0.

    Texts are split like ``str.split``.  The table is sent to every worker,
    so it is counted first: more than MODEL_WORDS words or MODEL_BYTES bytes
    are an error (``nb_score`` joins tables of any size).
    """
    spark = model.sparkSession
    size = fetch_one(model, n=F.count(F.lit(1)), b=F.sum(F.octet_length("word")))
    if size["n"] > MODEL_WORDS or (size["b"] or 0) > MODEL_BYTES:
        raise ValueError(f"{size['n']} words of {size['b']} bytes are too many for every worker")
    rows = model.select("word", "lo").toArrow()
    held = spark.sparkContext.broadcast((rows.column("word").to_pylist(), rows.column("lo").to_numpy()))

    def make() -> Scorer:
        words, lo = held.value
        place = {w: i for i, w in enumerate(words)}
        weights = np.append(lo, 0.0)

        def score(texts: Sequence[str]) -> np.ndarray:
            split = [t.split() for t in texts]
            at = np.fromiter((place.get(w, len(words)) for ws in split for w in ws), np.int64)
            row = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
            return prior + np.bincount(row, weights[at], len(split))
        return score
    return make
