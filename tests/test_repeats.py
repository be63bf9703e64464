"""Repeated and missing ids, draws, file order and plan shapes."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from conftest import SF_SMALL
from parlance.operators import augment as ag
from parlance.operators import candidates as cd
from parlance.operators import classify as cl
from parlance.operators import encode as en
from parlance.operators import runs as rn
from parlance.operators import sampling as sp
from parlance.operators import splits as sl
from parlance.plans import q_splits
from parlance.sources.lines import indexed_lines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_per_row_with_repeated_ids(spark):
    train = spark.createDataFrame([("good fine", 1), ("bad poor", 0)], "text string, label int")
    docs = spark.createDataFrame([(0, "a", "good good", 1), (1, "a", "good good", 1), (2, "b", "", None), (3, "c", None, 0)],
                                 "m_idx long, par_id string, text string, label int")
    got = {r.m_idx: r for r in cl.classify_binary(train, docs).collect()}
    assert len(got) == 4 and got[0].score == got[1].score > 0 == got[2].score == got[3].score
    both = train.withColumn("label", F.array("label", 1 - F.col("label")))
    many = cl.classify_multilabel(both, docs.withColumn("label", F.array("label")), 2).collect()
    assert sorted(r.m_idx for r in many) == [0, 1, 2, 3]
    assert {tuple(r.pred) for r in many if r.par_id == "a"} == {(1, 0)}


def test_encode_and_decode_with_repeated_ids(spark):
    docs = spark.createDataFrame([(0, "a", "x y z x"), (1, "a", "x y z x"), (2, "b", "y q"), (3, "c", None)],
                                 "m_idx long, par_id string, text string")
    vocab = en.build_vocab(docs.filter("m_idx != 2"))
    coded = en.encode_pad(docs, vocab, max_len=5)
    ids = {r.m_idx: r.input_ids for r in coded.collect()}
    assert ids[0] == ids[1] and len({len(v) for v in ids.values()}) == 1 and ids[3] == [1, 2, 0, 0, 0]
    back = {r.m_idx: r.text for r in en.decode_ids(coded, vocab).collect()}
    assert back == {0: "x y z", 1: "x y z", 2: "y <unk>", 3: ""}


def test_augment_with_repeated_ids(spark):
    rows = [(i, f"p{i // 2}", "one two three four five six seven") for i in range(8)]
    docs = spark.createDataFrame(rows, "m_idx long, par_id string, text string")
    out = ag.augment_positives(docs, ag.bigram_table(docs), rounds=2).collect()
    assert len(out) == 16
    texts = {}
    for r in out:
        texts.setdefault((r.par_id, r["round"]), set()).add(r.text)
    assert all(len(t) == 1 for t in texts.values())


def test_few_shot_equals_a_sort(spark):
    rng = random.Random(1)
    rows = [(i, f"p{rng.randrange(300)}", rng.choice([0, 0, 0, 1])) for i in range(900)]
    df = spark.createDataFrame(rows, "m_idx long, par_id string, label int")
    hashed = {r.m_idx: {s: r[f"h{s}"] for s in (1, 2)} for r in df.select(
        "m_idx", *[sp.h32(F.col("par_id"), s).alias(f"h{s}") for s in (1, 2)]).collect()}
    for n in (1, 7, 150, 5000):
        got = {(r.seed, r.m_idx) for r in sp.few_shot_samples(df, n, (1, 2), order="m_idx").collect()}
        want = set()
        for s in (1, 2):
            for y in (0, 1):
                own = sorted((hashed[m][s], p, m) for m, p, v in rows if v == y)
                want |= {(s, m) for _, _, m in own[:n]}
        assert got == want


def test_ensemble_members_differ(spark):
    tr = q_splits._split(spark, SF_SMALL, "train").select("m_idx", "par_id", "label")
    members = cl.seed_members(tr, sp.SEEDS, 5).collect()
    sets = [frozenset(r.m_idx for r in members if i in r._ms) for i in range(len(sp.SEEDS))]
    assert len(set(sets)) == len(sets) and all(len(s) <= 10 for s in sets)


def test_narrow_split_reads_no_text_and_sorts_nothing(spark):
    plan = _plan(q_splits._split(spark, SF_SMALL, "train").select("par_id", "label"))
    assert "text" not in plan and "SortAggregate" not in plan
    assert len(re.findall(r"Scan parquet", plan)) <= 8


def test_rebuild_with_repeats_and_unknown_ids(spark):
    corpus = spark.createDataFrame([(0, "7", "first"), (1, "7", "second"), (2, "8", "x")], "row_idx long, par_id string, text string")
    man = spark.createDataFrame([(0, "7"), (1, "9"), (2, "7")], "m_idx long, par_id string")
    got = sorted((r.m_idx, r.text) for r in sl.rebuild_split(corpus, man, ["text"]).collect())
    assert got == [(0, "first"), (1, None), (2, "first")]


def test_threshold_with_awkward_rounding_finds_the_pair(spark):
    shared, own = [f"s{i}" for i in range(55)], [f"a{i}" for i in range(45)]
    src = spark.createDataFrame([("1", "k", " ".join(shared + own))], "src_id string, keyword string, text string")
    corpus = spark.createDataFrame([("1", "k", " ".join(shared + own)), ("2", "k", " ".join(shared)), ("3", "k", " ".join(shared[1:]))],
                                   "cand_id string, keyword string, text string")
    got = cd.candidate_pairs(src, corpus, adequacy_min=0.55, fluency_min=0.0).collect()
    assert [r.cand_id for r in got] == ["2"]


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    from parlance.streaming.scoring import freeze_model, score_stream
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    path = f"{tmp_path}/documents.parquet"
    docs.repartition(3).write.parquet(path)
    train = docs.select("text", F.pmod("doc_id", F.lit(2)).alias("label"))
    model, prior = freeze_model(spark, cl.nb_word_scores(train), cl.nb_prior(train))
    out, ckpt = f"{tmp_path}/out", f"{tmp_path}/ckpt"
    for _ in range(2):   # the second run resumes and finds nothing new
        score_stream(spark, path, model, prior, out_dir=out, checkpoint=ckpt, max_files=2)
        assert spark.read.parquet(out).count() == docs.count()


@pytest.mark.parametrize("value", [0.0, 0.005, 0.015, 0.125, 0.29, 0.295, 0.555, 0.625, 0.995, 0.9949, 1.0, 1 / 3, 0.004999])
def test_two_decimals_as_python_formats_them(spark, value):
    got = spark.createDataFrame([(value,)], "x double").select(rn.two_decimals("x").alias("t")).first().t
    assert got == f"{value:.2f}"


def test_lines_are_numbered_without_a_shuffle_of_their_text(spark, tmp_path):
    for i in (2, 10, 100000, 99999):
        (tmp_path / f"part-{i:05d}.txt").write_text("".join(f"h\n{i}-{k}\n" for k in range(1)) + f"{i}-x\n")
    df = indexed_lines(spark, str(tmp_path), 1)
    assert [r.value for r in df.orderBy("row_idx").collect()] == [
        f"{i}-{k}" for i in (2, 10, 99999, 100000) for k in ("0", "x")]
    # Only the per-split counts are exchanged.
    moved = [x for x in _plan(df).split("\n") if "Exchange" in x and "value" in x]
    assert not moved


def test_wide_queries_are_registered():
    assert {"classify_binary_augmented", "incontext_prompt_train", "incontext_prompt_test", "predict_file_eval",
            "prf1_by_slice_model", "manifest_to_downsample", "seed_ensemble_small"} <= set(ent.queries())


def test_scratch_scope_deletes_its_tables(spark):
    import os

    from parlance.plans.ordering import materialize
    from parlance.session import scratch_scope, shared_dir
    base = shared_dir(spark).removeprefix("file:")
    kept = materialize(spark.range(3))
    before = set(os.listdir(base))
    with scratch_scope(spark):
        assert materialize(spark.range(5)).count() == 5
        assert set(os.listdir(base)) > before
    assert set(os.listdir(base)) == before and kept.count() == 3
