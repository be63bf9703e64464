import numpy as np
import pytest

from conftest import SF_SMALL
from helpers import components
from parlance.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>"


def _expected(rows, cosine):
    ids, x = [r[0] for r in rows], [r[1] for r in rows]

    def usable(i):
        v = x[i]
        return ids[i] is not None and v and None not in v and np.isfinite(v).all() and any(v)

    def linked(i, j):
        if not (usable(i) and usable(j)) or len(x[i]) != len(x[j]):
            return False
        a, b = np.array(x[i], np.float32).astype(float), np.array(x[j], np.float32).astype(float)
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    comp = components([float("inf") if d is None else d for d in ids], linked)
    return sorted(((d, k, None if d is None else c, d == c or d is None) for d, k, c in zip(ids, n, comp)), key=str)


def _rows():
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for _ in range(25):
        base = rng.normal(size=16)
        for scale in (0.0, 0.01, 0.08, 0.1, 0.3):
            rows.append((i, (base * rng.uniform(0.1, 9) + scale * rng.normal(size=16)).astype(np.float32).tolist()))
            i += 1
    hot = rng.normal(size=16).astype(np.float32).tolist()
    rows += [(1000 + k, hot) for k in range(40)] + [(1000, hot)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] * 16),
             (2005, [float("inf")] + [0.0] * 15), (2006, [1.0, 0.0]), (2007, [2.0, 0.0]), (None, hot), (2008, [-0.0, 1.0]),
             (2009, [0.0, 1.0]), (3, [0.0, -1.0])]
    return rows


@pytest.mark.parametrize("stripe", [4 << 20, 2000])
def test_links_equal_brute_force(spark, stripe, monkeypatch):
    rows = _rows()
    got = ed.near_vectors(spark.createDataFrame(rows, SCHEMA), stripe_bytes=stripe).collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows, ed.COSINE)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, ed.near_vectors(df, 0.3).collect()), key=str) == _expected(rows, 0.3)


def test_bound_is_rigorous():
    rng = np.random.default_rng(2)
    for _ in range(500):
        a, b = rng.normal(size=(2, 24)) * rng.choice([1, 100], 24)
        (qa, sa, ea), (qb, sb, eb) = ed.quantise(a), ed.quantise(b)
        product = sa * sb * float(np.frombuffer(qa, np.int8).astype(int) @ np.frombuffer(qb, np.int8).astype(int))
        exact = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        assert exact <= product + (1 + ea) * eb + (1 + eb) * ea + ea * eb


def test_empty_table(spark):
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clustered_vectors_meet_few_stripes(spark, monkeypatch):
    """Twenty narrow clusters: links as by brute force, and pivots keep most stripes apart."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] * (1 + i % 3) + 0.12 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(400)]
    met = []
    real = ed._meetings
    monkeypatch.setattr(ed, "_meetings", lambda *a: met.append((real(*a), a[1])) or met[-1][0])
    monkeypatch.setattr(ed, "LEAST_STRIPE", 1)
    got = ed.near_vectors(spark.createDataFrame(rows, SCHEMA), stripe_bytes=8 * 24 * 10).collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows, ed.COSINE)
    pairs, stripes = met[-1]
    n = stripes.count()
    assert n >= 20 and pairs.count() < 0.35 * n * (n + 1) / 2


def test_stripes_of_ranges_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ed, "RANGE_BYTES", 100)
    monkeypatch.setattr(ed, "LEAST_STRIPE", 1)
    rows = _rows()
    got = ed.near_vectors(spark.createDataFrame(rows, SCHEMA), stripe_bytes=1000).collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows, ed.COSINE)


def test_pivot_angles_differ_by_at_most_the_angle_between():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = ed.pivots(x, 12)
    angle = np.arccos(np.clip(x @ p.T, -1, 1))
    between = np.arccos(np.clip(x @ x.T, -1, 1))
    assert len(p) == 12 and (np.abs(angle[:, None] - angle[None]).max(2) <= between + ed._ANGLE_SLACK).all()
