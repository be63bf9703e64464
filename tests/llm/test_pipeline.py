"""Stages of the pipeline against plain Python on a small fixture."""

import math
from collections import Counter, defaultdict

import corpus_pipeline
from helpers import DOCS, WORD, components, documents, shingle_set
from parlance.llm import pieces
from test_mixing import _targets

STAGE = dict(corpus_pipeline.STAGES)


def _rows():
    rows = documents(11)
    # One id on two texts, and one (id, text) with two sources.
    return rows + [(rows[10][0], "another text of the same number one two three", "en", "b", 1), (rows[12][0], rows[12][1], "xx", "zz", 2)]


def _pairs(df) -> Counter:
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_dedup_keeps_the_least_id_of_every_group(spark):
    rows = _rows()
    sets = [shingle_set(r[1]) for r in rows]
    same = lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    comp = components([r[0] for r in rows], same)
    want = {(r[0], r[1]) for r, c in zip(rows, comp) if r[0] == c}
    got = [STAGE["near_dedup"](spark, spark.createDataFrame(rows, DOCS).repartition(n), "").collect() for n in (2, 5)]
    assert sorted(got[0], key=repr) == sorted(got[1], key=repr)
    seen = Counter((r["doc_id"], r["text"]) for r in got[0])
    assert max(seen.values()) == 1 and {k for k in seen if k[1]} == {k for k in want if k[1]}


def test_mixing_crosses_whole_numbers_of_the_running_sum(spark):
    rows = _rows()
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    per = defaultdict(int)
    for r, n in zip(rows, size):
        per[r[3]] += n
    target = _targets(per)
    want = {}
    for source in per:
        rate = target[source] / per[source] if per[source] else 0.0
        want[source] = (rate, sum(r[3] == source for r in rows))
    out = STAGE["mixing"](spark, spark.createDataFrame(rows, DOCS), "").collect()
    written = Counter(map(tuple, out))
    there = Counter(rows)
    assert set(written) <= set(there)
    for source, (rate, n) in want.items():
        copies = [c for r, c in written.items() if r[3] == source]
        # A whole number of copies on each side of the rate per row, and as many in all as the sum crosses.
        assert abs(sum(copies) - rate * n) <= 1
        for r, c in written.items():
            if r[3] == source:
                assert math.floor(rate) * there[r] <= c <= math.ceil(rate) * there[r]


def test_tokens_read_back(spark):
    rows = _rows()
    out = STAGE["tokens"](spark, spark.createDataFrame(rows, DOCS), "")
    back = pieces.decode_documents(out.select("doc_id", "ids"))
    assert _pairs(back) == Counter((r[0], r[1]) for r in rows)


def test_run_leaves_its_result_only(spark, tmp_path):
    import os

    from parlance.session import shared_dir
    spark.createDataFrame(_rows(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    place = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(place))
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert n >= 0
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(place)) - before] == ["pipeline-tokens"]
