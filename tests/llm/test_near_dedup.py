import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from helpers import DOCS, components, documents, shingle_set
from parlance.llm import near_dedup as nd
from parlance.llm.components import connected_components
from parlance.llm.words import pieces, shingles, string_buffers, word_hashes, word_spans


def _expected(rows):
    sets = [shingle_set(r[1]) for r in rows]
    same = lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    comp = components([r[0] for r in rows], same)
    return sorted((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, comp))


def _got(df):
    return sorted(tuple(r)[:4] for r in df.collect())


@pytest.mark.parametrize("blocks", [(256, 400_000), (6, 400_000), (256, 500)])
def test_components_equal_brute_force(spark, blocks):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS)
    got = nd.near_duplicates(df, block_rows=blocks[0], block_shingles=blocks[1])
    assert _got(got) == _expected(rows)


def test_kept_rows(spark):
    rows = documents(3)
    df = spark.createDataFrame(rows, DOCS)
    kept = {r[0] for r in _expected(rows) if r[3]}
    out = nd.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(kept)


def test_equal_keys_keep_one_row_whatever_the_run(spark):
    rows = [(1, "a b c d e f", "en", "x", 1), (1, "a b c d e f", "fr", "y", 2), (1, "q r s t u v", "en", "x", 1), (2, "z", None, None, None)]
    df = spark.createDataFrame(rows + rows, DOCS).selectExpr("*", "1 as _own", "'a' as _id", "2 as _row", "3 as _mark")
    got = [sorted(map(tuple, nd.deduplicated(df.repartition(n)).collect())) for n in (1, 5)]
    assert got[0] == got[1] and nd.deduplicated(df).columns == df.columns
    assert sorted((r[0], r[1]) for r in got[0]) == [(1, "a b c d e f"), (1, "q r s t u v"), (2, "z")]


def test_union_sketch_counts_the_smallest_values_of_the_union():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 5, 40, 200, 400, 900)]
    i, j = (x.ravel() for x in np.meshgrid(range(6), range(6)))
    size, shared = nd._union_shared(sets, sets, i, j, 64)
    for a, b, n, m in zip(i, j, size, shared):
        union = np.union1d(sets[a], sets[b])[:64]
        assert n == len(union) and m == len(np.intersect1d(union, np.intersect1d(sets[a], sets[b])))
    binomial_tail = lambda n, p, c: sum(math.comb(n, x) * p ** x * (1 - p) ** (n - x) for x in range(c + 1))
    for n in (1, 8, 32, 64):
        c = nd._floor(n, 75, 100)
        assert binomial_tail(n, 0.75, c - 1) <= nd.UNION_LOSS < binomial_tail(n, 0.75, c)


def test_union_estimate_rules_out_distant_pairs_only():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    sets = []
    for k in range(120):
        new = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[:600 - 4 * k], new[:4 * k]])))
    apart = np.triu(np.ones((120, 120), bool), 1)
    allowed = nd._estimate_allows(sets, None, apart, 75, 100)
    inter = nd._overlaps(sets, None)
    size = np.array([len(s) for s in sets])
    similar = inter / (size[:, None] + size[None, :] - inter)
    assert allowed[(similar >= 0.75) & apart].all()
    ruled_out = 1 - allowed[(similar < 0.3) & apart].mean()
    assert ruled_out > 0.95, ruled_out


def _peak_mb(call) -> float:
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1] / 2 ** 20
    finally:
        tracemalloc.stop()


def test_a_worker_estimates_and_hashes_in_small_parts():
    """A full block of near copies, and 8 MB of texts: 110 and 83 MB at once before they were cut smaller."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sets = []
    for _ in range(nd.BLOCK_ROWS + 1):
        new = base.copy()
        new[rng.integers(0, 1000, 20)] = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        sets.append(np.unique(new))
    apart = np.triu(np.ones((len(sets), len(sets)), bool), 1)
    assert _peak_mb(lambda: nd._estimate_allows(sets, None, apart, 75, 100)) < 40
    batch = pa.record_batch([pa.array(range(4000)), pa.array([f"w{i} " * 300 + "a b c d e f g " * 40 for i in range(4000)])],
                            names=["doc_id", "text"])
    assert _peak_mb(lambda: sum(len(s) for _, s in nd._sets_of(batch, 5))) < 40


def _group(n: int, strays: int) -> list[tuple]:
    """Members similar to member 0, and strays that share a third of its words each."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base), "en", "a", 0)]
    for k in range(1, n):
        w = list(base)
        w[rng.randrange(400)] = f"e{k}"
        rows.append((k, " ".join(w), "en", "a", 0))
    for k in range(strays):
        rows.append((10 ** 6 + k, " ".join(base[:150] + [f"s{k}_{i}" for i in range(200)]), "en", "a", 0))
    return rows


def test_a_large_group_sends_sets_only_to_strays(spark, monkeypatch):
    """20 blocks of one leader: without strays nothing is sent again, with some the rows grow with their blocks."""
    sent = []
    real = nd._meetings
    monkeypatch.setattr(nd, "_meetings", lambda *a: sent.append(real(*a)) or sent[-1])
    for strays in (0, 3):
        rows = _group(160, strays)
        df = spark.createDataFrame(rows, DOCS)
        got = _got(nd.near_duplicates(df, block_rows=8))
        assert got == _expected(rows)
        # Each of the others once per stray block, each stray once per block.
        most = max([r["count"] for r in sent[-1].groupBy("leader").count().collect()], default=0)
        assert most == 0 if not strays else most <= 160 + strays * (21 + 1)


def test_strays_that_link_with_one_another(spark):
    rows = _group(40, 0)
    rng = random.Random(2)
    far = [f"w{i}" for i in range(230)] + [f"q{i}" for i in range(170)]
    for k in range(30):
        w = list(far)
        w[380 + rng.randrange(20)] = f"z{k}"
        rows.append((500 + k, " ".join(w), "en", "a", 0))
    got = _got(nd.near_duplicates(spark.createDataFrame(rows, DOCS), block_rows=6))
    assert got == _expected(rows)


def test_ids_on_several_texts_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (3, "q r s t u v"), (None, None), (2, "x")]
    got = {tuple(r)[:4] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2, 1, True), (None, 2, 1, False), (3, 2, 1, False), (None, 0, None, True), (2, 1, 2, True)}


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3), (5, 6), (6, 5)]
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 5: 5, 6: 5}


def test_word_pieces_do_not_change_words():
    texts = ["a b", "", "  x", None, "long" * 50 + " tail", "\x0b\x0cé \x85x y", "z"]
    data, offsets = string_buffers(pa.array(texts))
    whole = word_hashes(data, offsets)
    starts, ends = word_spans(data, offsets)
    words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in (t or "").encode().split()]
    for size in (1, 3, 7):
        cuts = list(pieces(data, offsets, size))
        assert cuts[0][0] == 0 and cuts[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert len(whole[0]) == len(words)


def test_shingles_of_short_texts():
    h = np.arange(1, 5, dtype=np.uint64)
    assert len(shingles(h[:0])) == 0 and len(shingles(h)) == 1
    assert len(shingles(np.arange(9, dtype=np.uint64))) == 5
