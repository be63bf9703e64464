import math

import numpy as np

from pyspark.sql import functions as F

from parlance.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(seed: int, n: int = 500, dim: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = centres[i % 5] + 0.4 * rng.normal(size=dim)
        rows.append((i * 10, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4))))
    for i in range(60):  # copies and ties
        rows.append((20000 + i * 25, rows[7][1], i % 2))
    rows += [(30000, [0.0] * dim, 1), (30100, [0.0] * dim, 1), (30001, [0.0] * dim, 2), (30200, [-x for x in rows[3][1]], 9)]
    odd = [(None, rows[0][1], 1), (40000, None, 1), (40100, rows[0][1], None), (40200, [math.nan] + rows[0][1][1:], 1),
           (40300, [None] + rows[0][1][1:], 1), (40400, [math.inf] + rows[0][1][1:], 1), (40500, [1.0, 2.0], 1), (40600, [1.0, 2.5], 1),
           (40700, [2.0, 2.5], 2), (40701, [1.5, 0.5], 2), (40800, [1e30] * dim, 1), (40900, [], 1), (40901, [], 1), (40902, [], 2)]
    return rows + odd + [rows[11], rows[11]]


def _expected(rows, positives=5, negatives=10):
    e = {}
    for vec, v, label in rows:
        if vec is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2 ** 54:
            e[vec] = ((label + 1) % 10 if vec % 7 == 0 else label, q)
    out = []
    for a, (label, q) in e.items():
        if a % 100:
            continue
        s = sorted(((-sum(x * y for x, y in zip(q, w)), i, m) for i, (m, w) in e.items() if i != a and len(w) == len(q)))
        for ps, p, _ in [x for x in s if x[2] == label][:positives]:
            fits = [(i, -ns) for ns, i, m in s if m != label and 30 * -ps <= 100 * -ns <= 90 * -ps]
            out += [(a, p, r, i, -ps, ns) for r, (i, ns) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def test_mined_against_all_pairs(spark):
    rows = _vectors(1, 400)
    assert sorted(map(tuple, hn.mined(spark.createDataFrame(rows, VECTORS).repartition(6)).collect())) == _expected(rows)


def test_short_blocks_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE", 8)
    monkeypatch.setattr(hn, "CELL_GROUPS", 2)
    monkeypatch.setattr(hn, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(hn, "CENTRE_BYTES", 400)
    rows = [r for r in _vectors(3) if r[0] is None or r[0] < 40000]
    whole = hn.whole_vectors(spark.createDataFrame(rows, VECTORS))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hn.hard_negatives(whole.withColumn("label", moved), F.col("vec_id") % 100 == 0, group_rows=8, block_rows=16)
    assert sorted(map(tuple, got.collect())) == _expected(rows)


def _pack(ids, labels, x):
    q = np.floor(256 * x).astype(np.int32)
    return hn._Pack({"ids": np.array(ids, np.int64).tobytes(), "labels": np.array(labels, np.int32).tobytes(), "q": q.tobytes(),
                     "lengths": np.linalg.norm(q.astype(float), axis=1).tobytes(), "dim": x.shape[1]})


def test_walk_ends_before_the_list(monkeypatch):
    """Members of a narrow cluster stop once the bound of the rest is below what they hold."""
    rng = np.random.default_rng(5)
    axis = np.eye(16)[0]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    group = _pack(range(8), [0] * 8, unit(axis + 0.02 * rng.normal(size=(8, 16))))
    near, rest = unit(axis + 0.05 * rng.normal(size=(600, 16))), unit(rng.normal(size=(8000, 16)))
    block = _pack(range(100, 8700), [0] * 8600, np.concatenate([near, rest]))
    seen = []
    real = hn._products
    monkeypatch.setattr(hn, "_products", lambda a, b, most: seen.append(a.shape[0] * b.shape[0]) or real(a, b, most))
    centre = unit(group.q.sum(0, keepdims=True).astype(float))[0]
    angle = float(np.arccos(unit(group.q.astype(float)) @ centre).max())
    wants = np.array([(i, 0, -hn._FAR, hn._FAR, -hn._FAR) for i in range(8)], np.int64)
    got = sorted(hn._walked(block, group, wants, centre, angle, 5, True))
    scores = group.q.astype(np.int64) @ block.q.astype(np.int64).T
    want = []
    for i in range(8):
        first = sorted(range(8600), key=lambda j: (-scores[i, j], j))[:5]
        want += [(i, 0, 100 + j, int(scores[i, j])) for j in first]
    assert got == sorted(want)
    assert sum(seen) <= 8 * 2 * hn.TILE


def test_long_whole_numbers_stay_exact():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(-10 ** 6, 10 ** 6, (5, 64)).astype(np.int32) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    most = float(np.linalg.norm(a.astype(float), axis=1).max() * np.linalg.norm(b.astype(float), axis=1).max())
    assert hn._products(a, b, most).tolist() == want
    assert hn._products(a, b, 2.0 ** 60).tolist() == want


def test_empty_tables_and_clashing_columns(spark):
    rows = _vectors(4, 60)
    v = spark.createDataFrame(rows, VECTORS)
    for c in ("key", "dim", "q", "length", "copy", "centre", "part", "grp", "t", "rank", "anchor", "score", "block", "n"):
        v = v.withColumn(c, v["label"])
    assert sorted(map(tuple, hn.mined(v).collect())) == _expected(rows)
    assert hn.mined(v.limit(0)).collect() == []
    assert hn.mined(v.filter("vec_id % 100 = 1")).collect() == []
