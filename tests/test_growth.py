"""What grows with the input: draws, shuffles, tasks and steps per row."""

import random

import pandas as pd

from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.operators import augment as ag
from parlance.operators import categories as cat
from parlance.operators import classify as cl
from parlance.sources import datasource as ds
from parlance.streaming import stateful as st


def test_a_draw_for_a_whole_text_is_made_once(spark):
    df = spark.createDataFrame([("a", 1, "one two three four five")], "k string, r int, text string").select("k", "r", tokens("text").alias("t"))
    plan = df.select(ag.swap_words(F.col("t"), F.col("k"), F.col("r")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    # One for the offset, one for the pair.
    assert plan.count("md5(") == 2


def test_rows_are_written_between_table_edits(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"p{i}", "one two three four five six seven") for i in range(6)], "m_idx int, par_id string, text string")
    written = []
    real = ag.materialize
    monkeypatch.setattr(ag, "materialize", lambda x: written.append(x.columns) or real(x))
    out = ag.augment_positives(df, ag.bigram_table(df))
    assert len(written) == 2 and all("_t" in c and "round" in c for c in written)
    assert out.count() == 6 * ag.ROUNDS


def test_terms_of_a_row_are_counted_without_a_shuffle(spark):
    texts = ["b a B c a", "", None, "  ", "x"]
    df = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(texts)], "row_idx int, par_id string, text string")
    terms = cl.doc_terms(df, "row_idx", keep=("par_id",))
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    want = [(0, "p0", "a", 2), (0, "p0", "b", 2), (0, "p0", "c", 1), (1, "p1", None, 1), (2, "p2", None, 1), (3, "p3", None, 1), (4, "p4", "x", 1)]
    assert sorted((tuple(r) for r in terms.collect()), key=str) == sorted(want, key=str)


def test_rejected_lines_are_not_written_by_one_task(spark, monkeypatch):
    from conftest import SF_SMALL
    from parlance.plans import q_store
    asked = []
    real = q_store.sinks.write_lines
    monkeypatch.setattr(q_store.sinks, "write_lines", lambda *a, **kw: asked.append(kw) or real(*a, **(kw | {"num_files": 5})))
    got = q_store.q_rejected_lines(spark, SF_SMALL).collect()
    assert asked and not any(kw.get("num_files") for kw in asked)
    # The numbers go on from file to file.
    assert len({r["line_no"] for r in got}) == len(got) > 10


def test_small_ranges_share_tasks(tmp_path):
    lines = [f"line {i}" for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:2000]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[2000:]) + "\n")
    reader = ds.LineReader({"path": str(tmp_path), "rangebytes": "10"})
    packs = reader.partitions()
    assert len(packs) <= 2 * ds.PACKS and sum(len(p.ranges) for p in packs) > 1000
    assert [row[3] for p in packs for row in reader.read(p)] == lines
    count = ds.LineReader({"path": str(tmp_path), "rangebytes": "10", "count": "true"})
    assert sum(n for p in packs for _, _, n in count.read(p)) == 3000
    assert ds.LineReader({"path": str(tmp_path / "none")}).partitions() == []


def test_wide_vectors_take_a_step_per_eight_classes(spark):
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(1000), rng.randrange(1, 60))) for _ in range(20)] + [[31, 32, 63, 64, 999]]
    s = spark.createDataFrame([(i, c) for i, x in enumerate(sets) for c in x], "par_id int, category_id int")
    for n in (1000, 999, 33, 8, 1):
        wide = cat.bitmap_to_multihot(cat.span_to_bitmap(s, keys=("par_id",)), n)
        assert {r["par_id"]: r["label"] for r in wide.collect()} == {i: [int(c in set(x)) for c in range(n)] for i, x in enumerate(sets)}
    assert f"sequence(0, {999 // 8}" in wide_plan(spark, s) and "sequence(0, 999" not in wide_plan(spark, s)


def wide_plan(spark, s):
    return cat.bitmap_to_multihot(cat.span_to_bitmap(s, keys=("par_id",)), 1000)._jdf.queryExecution().analyzed().toString()


def test_a_run_advances_without_frames_of_its_own(monkeypatch):
    class State:
        exists, held = False, None

        @property
        def get(self):
            return self.held

        def update(self, held):
            self.exists, self.held = True, held
    monkeypatch.setattr(pd, "concat", None)
    state = State()
    cols = ["epoch", "precision", "recall", "f1"]
    first = [pd.DataFrame([(2, 0.1, 0.2, 0.4), (0, 0.5, 0.5, 0.3)], columns=cols), pd.DataFrame([(1, 0.3, 0.3, 0.2)], columns=cols)]
    (out,) = st._advance((7,), first, state, 2)
    assert out.iloc[0].tolist() == [7, 3, 2, 0.4, 0.1, 0.2, None]
    (out,) = st._advance((7,), [pd.DataFrame([(4, 0, 0, 0.1), (3, 0, 0, 0.0), (5, 1, 1, 1.0)], columns=cols)], state, 2)
    assert out.iloc[0].tolist() == [7, 5, 2, 0.4, 0.1, 0.2, 4]
