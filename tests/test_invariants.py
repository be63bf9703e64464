"""Same results on any partitioning; brute-force checks; plan shape."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from conftest import SF_SMALL
from parlance.operators import runs as rn
from parlance.plans.ordering import index_by_order, top_k_per_group

STABLE = ["downsample_negatives", "few_shot_sample", "attach_demonstrations", "with_row_index",
          "pmi_top_words_keyword", "build_vocab", "src_labelled_tsv"]


@pytest.mark.parametrize("name", STABLE)
def test_partition_count_invariance(spark, name):
    q = ent.queries()[name]
    results = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(sorted(map(tuple, q(spark, SF_SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_index_by_order_matches_sort(spark):
    rows = [(random.Random(i).randint(0, 50), f"w{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "n int, w string")
    got = index_by_order(df, [F.desc("n"), F.asc("w")], "i").orderBy("i").collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.n, r.w) for r in got] == want and [r.i for r in got] == list(range(500))


def test_top_k_per_group_matches_pandas(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.random(), i) for i in range(2000)]
    rows += [("hot", rng.random(), 10000 + i) for i in range(3000)]   # one group holds most rows
    df = spark.createDataFrame(rows, "g string, s double, id int")
    got = top_k_per_group(df, ["g"], [F.desc("s"), F.asc("id")], 25)
    got = sorted((r.g, r.rank, r.id) for r in got.collect())
    p = pd.DataFrame(rows, columns=["g", "s", "id"]).sort_values(["g", "s", "id"], ascending=[True, False, True])
    p["rank"] = p.groupby("g").cumcount() + 1
    want = sorted((g, r, i) for g, r, i in p[p["rank"] <= 25][["g", "rank", "id"]].itertuples(index=False))
    assert got == want


def _simulate(f1s, patience):
    best, best_epoch, stop, streak = 0.0, None, None, 0
    for e, f in enumerate(f1s):
        if best < f:
            best, best_epoch, streak = f, e, 0
        else:
            streak += 1
            if streak >= patience:
                stop = e
                break
    return best_epoch, (best if best_epoch is not None else None), stop


def test_best_checkpoint_matches_training_loop(spark):
    rng = random.Random(3)
    runs = {r: [round(rng.random() * 0.3 + 0.01 * e * (r % 3), 2) for e in range(rng.randint(3, 25))] for r in range(60)}
    runs[99] = [0.0] * 8   # never improves over 0: no checkpoint
    rows = [(r, e, f, f, f) for r, fs in runs.items() for e, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "run int, epoch int, f1 double, precision double, recall double")
    got = {r.run: (r.best_epoch, r.best_f1, r.stop_epoch) for r in rn.best_checkpoint(df, patience=5).collect()}
    assert got == {r: _simulate(fs, 5) for r, fs in runs.items()}


CORE = ["pmi_top_words_country", "prf1_by_slice", "classify_binary", "attach_demonstrations",
        "downsample_negatives", "encode_pad", "ensemble_vote", "seed_ensemble"]


@pytest.mark.parametrize("name", CORE)
def test_plan_has_no_cartesian_or_python(spark, name):
    df = ent.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan, (name, bad)
