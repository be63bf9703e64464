import math
from collections import Counter, defaultdict

from helpers import DOCS, WORD, documents
from parlance.llm import mixing


def _targets(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    """Targets by filling: who is above the cap stops, the rest share again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(w[s] for s in rest), 1)
        over = [s for s in rest if level * w[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = documents(5)
    got = mixing.mixture(spark.createDataFrame(rows, DOCS)).collect()
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    per = defaultdict(int)
    for r, n in zip(rows, size):
        per[r[3]] += n
    want = _targets(per)
    assert Counter((g["doc_id"], g["size"], g["source_size"]) for g in got) == Counter(
        (r[0], n, per[r[3]]) for r, n in zip(rows, size))
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for g in got:
        assert math.isclose(g["target"], want[source[g["doc_id"]]], rel_tol=1e-12)
        assert g["taken"] <= 3 * g["size"]
        taken[source[g["doc_id"]]] += g["taken"]
    for s in per:
        assert abs(taken[s] - want[s]) <= 3 * max(size) + 1


def test_targets_stop_at_three_times_the_size(spark):
    sizes = {"a": 10, "b": 5000, "c": 0, None: 40}
    df = spark.createDataFrame([(1, s, n) for s, n in sizes.items()], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == _targets(sizes) and got["a"] == 30 and got["c"] == 0


def test_emitted_rows_are_the_copies(spark):
    rows = documents(6)
    df = spark.createDataFrame(rows, DOCS)
    plan = mixing.mixture(df).collect()
    words = Counter()
    for g in plan:
        words[g["doc_id"]] += g["taken"]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    seen = Counter()
    for r in out.collect():
        seen[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert +seen == +words


def test_equal_rows_count_one_by_one(spark):
    """500 equal rows and 500 others of one source: the words taken come near the target."""
    text = " ".join(["w"] * 10)
    rows = [(1, text, "en", "a", 0)] * 500 + [(10 + i, text, "en", "a", 0) for i in range(500)]
    rows += [(5000 + i, text, "en", "b", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = mixing.mixture(df).collect()
    assert len(got) == len(rows)
    for part in (lambda r: r["doc_id"] < 5000, lambda r: r["doc_id"] >= 5000):
        own = [r for r in got if part(r)]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10
        assert max(r["taken"] for r in own) <= 3 * 10
    words = Counter({i: n for i, n in sum((Counter({r["doc_id"]: r["taken"] // 10}) for r in got), Counter()).items()})
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(df).collect()) == words


def test_many_copies_of_one_row_are_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_COPIES", 7)
    rows = [(1, "a b", "en", "a", 0)] * 50 + [(1, "a c", "en", "a", 0)] * 3 + [(None, "a d", None, None, None)] * 4
    df = spark.createDataFrame(rows, DOCS)
    taken = sum(r["taken"] for r in mixing.mixture(df).collect())
    out = mixing.mixed_documents(df).collect()
    assert 2 * len(out) == taken and {r["text"] for r in out} <= {"a b", "a c", "a d"}


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(documents(7), DOCS)
    a = sorted(map(tuple, mixing.mixture(df.repartition(1)).collect()))
    assert a == sorted(map(tuple, mixing.mixture(df.repartition(7)).collect()))
