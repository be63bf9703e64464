"""Stored profiles, the line data source, the bucketed corpus, stateful streams, bitmaps, and numbers that fail loudly."""

import os
import random

import pytest

from pyspark.sql import functions as F

from parlance.operators import augment as ag
from parlance.operators import categories as cat
from parlance.operators import profile as pf
from parlance.operators import runs as rn
from parlance.operators import sampling as sp
from parlance.operators import sketches as sk
from parlance.operators import splits as sl
from parlance.plans.ordering import broadcast_if_small
from parlance.sources import bucketed as bk
from parlance.sources import datasource as ds
from parlance.sources import lines as ln
from parlance.streaming import stateful as st


# ---------------------------------------------------------------- line numbers

def test_two_packings_fail_loudly_or_give_equal_rows(spark, tmp_path):
    """Counts of one packing, lines of another: never wrong numbers."""
    for k in range(6):
        (tmp_path / f"part-{k:05d}.txt").write_text("".join(f"{k}:{i}\n" for i in range(50 * (k + 1))))
    want = sorted((int(r["value"].split(":")[0]), int(r["value"].split(":")[1])) for r in spark.read.text(str(tmp_path)).collect())
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    seen = set()
    try:
        for a, b in (("1m", "1m"), ("400", "1m"), ("1m", "400"), ("700", "400"), ("1500", "900")):
            spark.conf.set(key, a)
            places = ln.split_places(ln.stamped_lines(spark, str(tmp_path)))
            places = spark.createDataFrame(places.collect(), places.schema)
            spark.conf.set(key, b)
            try:
                rows = ln.numbered_lines(ln.stamped_lines(spark, str(tmp_path)), places).collect()
                seen.add("equal")
                assert sorted((int(os.path.basename(r["file"])[5:10]), r["line_no"]) for r in rows) == want
                assert all(int(r["value"].split(":")[1]) == r["line_no"] for r in rows)
            except Exception as e:
                assert "cut or packed" in str(e)
                seen.add("failed")
    finally:
        spark.conf.set(key, before)
    assert seen == {"equal", "failed"}


def test_empty_table_has_empty_bins(spark):
    got = pf.length_histogram(spark.createDataFrame([], "n_tokens int"), bins=4).orderBy("bin").collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in got] == [(0.0, 0.25, 0), (0.25, 0.5, 0), (0.5, 0.75, 0), (0.75, 1.0, 0)]


def test_null_predictions_are_rows(spark):
    gold = spark.createDataFrame([(10, None), (11, 1)], "row_idx long, label int").select("label", "row_idx")
    preds = spark.createDataFrame([(0, None), (1, 0)], "line_no long, pred int").select("pred", "line_no")
    got = sl.align_by_position(gold, ["row_idx"], preds).orderBy("pos").collect()
    assert [(r["row_idx"], r["pred"]) for r in got] == [(10, None), (11, 0)]
    with pytest.raises(Exception, match="prediction count differs"):
        sl.align_by_position(gold, ["row_idx"], preds.limit(1)).collect()


def test_broadcast_counts_bytes(spark):
    few = spark.createDataFrame([("x" * 1000, 1)], "word string, n int")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(few, 1)) and not hinted(broadcast_if_small(few, 1, max_bytes=999))
    assert not hinted(broadcast_if_small(few, 10 ** 7))


# ---------------------------------------------------------------- draws

def test_demonstrations_of_repeated_ids_and_empty_sides(spark):
    pool = spark.createDataFrame([(i, f"p{i}", f"t{i}", int(i < 3)) for i in range(10)], "m_idx long, par_id string, text string, label int")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "par_id string, x int")
    got = {r["x"]: r for r in sp.attach_demonstrations(df, pool, order="m_idx").collect()}
    assert len(got) == 4 and got[1]["pos_text"] == got[2]["pos_text"] and got[1]["neg_text"] == got[2]["neg_text"]
    assert all(r["pos_par_id"] in ("p0", "p1", "p2") and r["neg_text"] == "t" + r["neg_par_id"][1:] for r in got.values())
    alone = sp.attach_demonstrations(df, pool.filter("label = 0"), order="m_idx").collect()
    assert all(r["pos_text"] is None and r["neg_text"] is not None for r in alone)
    none = sp.attach_demonstrations(df, pool.limit(0), order="m_idx").collect()
    assert len(none) == 4 and all(r["pos_text"] is None and r["neg_text"] is None for r in none)


def test_draws_of_wide_rows_equal_those_of_narrow_ones(spark):
    rows = [(i, f"p{i % 40}", i % 2, f"text {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "m_idx long, par_id string, label int, text string")
    wide = sp.few_shot_samples(df, 7, (1, 2), order="m_idx")
    assert wide.columns == [*df.columns, "seed"]
    narrow = sp.few_shot_samples(df.select("par_id", "label", "m_idx"), 7, (1, 2), order="m_idx")
    assert sorted((r["seed"], r["m_idx"]) for r in wide.collect()) == sorted((r["seed"], r["m_idx"]) for r in narrow.collect())


def test_a_word_before_several_chosen_places_is_looked_up_once(spark):
    df = spark.createDataFrame([(1, "p", "a b a b a c a b " * 5)], "m_idx long, par_id string, text string")
    out = [ag.augment_positives(df, b, rounds=3).orderBy("round").collect() for b in (ag.bigram_table(df), ag.written_bigrams(df))]
    assert [r["text"] for r in out[0]] == [r["text"] for r in out[1]] and len(out[0]) == 3


# ---------------------------------------------------------------- stored profiles

def test_profiles_merge_and_parts_replace_themselves(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), " ".join(f"W{rng.randrange(3000)}" for _ in range(rng.randrange(0, 60)))) for _ in range(900)]
    rows += [("a", None), ("c", "")]
    path = str(tmp_path / "profile")
    df = lambda part: spark.createDataFrame(part, "g string, text string")
    sk.store_profile(df(rows[:10]), path, "2024-01-01", "g")
    sk.store_profile(df(rows[300:]), path, "2024-01-02", "g")
    sk.store_profile(df(rows[:300]), path, "2024-01-01", "g")
    got = {(r["scope"], r["g"]): r for r in sk.merged_profile(spark, path, "g", percentiles=(0.5,)).collect()}
    assert set(got) == {("group", g) for g in ("a", "b", "c", None)} | {("all", None)}
    for (scope, g), r in got.items():
        own = [(t or "").lower().split() for x, t in rows if scope == "all" or x == g]
        words = {w for t in own for w in t}
        assert r["n_rows"] == len(own) and r["n_tokens"] == sum(map(len, own))
        assert abs(r["n_words"] - len(words)) <= sk.words_error() * len(words) + 1
        v, n = r["quantiles"][0], sorted(map(len, own))
        err = sk.rank_error() * len(n)
        assert sum(x < v for x in n) - err <= 0.5 * len(n) <= sum(x <= v for x in n) + err
    first = sk.merged_profile(spark, path, "g", parts=["2024-01-01"]).filter("scope = 'all'").first()
    assert first["n_rows"] == 300


# ---------------------------------------------------------------- line data source

ODD = b"h1\nh2\r\na\rb\n\nlong " + b"x" * 300 + b"\r\r\nlast \xc3\xa9\tq"


def test_ranges_give_the_lines_of_the_text_reader(spark, tmp_path):
    (tmp_path / "part-00001.txt").write_bytes(b"second\nfile\n")
    (tmp_path / "part-00000.txt").write_bytes(ODD)
    (tmp_path / "part-00002.txt").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    name = lambda f: os.path.basename(f)
    for header in (0, 1, 3):
        want = sorted((r["row_idx"], name(r["file"]), r["line_no"], r["value"]) for r in ln.indexed_lines(spark, str(tmp_path), header).collect())
        for step in (1, 7, 64, 1 << 20):
            got = ds.indexed_ranges(spark, str(tmp_path), header, range_bytes=step).collect()
            assert sorted((r["row_idx"], name(r["file"]), r["line_no"], r["value"]) for r in got) == want, (header, step)
    bad = ds.rejected_lines(ds.indexed_ranges(spark, str(tmp_path)), 2).collect()
    assert sorted(r["value"] for r in bad) == sorted(r["value"] for r in ln.indexed_lines(spark, str(tmp_path)).collect() if "\t" not in r["value"])
    assert all(r["n_fields"] == 1 for r in bad)


def test_lines_of_a_range_hold_each_line_once(tmp_path):
    p = tmp_path / "f"
    p.write_bytes(ODD)
    whole = list(ds.lines_of(ds.ByteRange(str(p), 0, len(ODD))))
    for step in range(1, 40):
        parts = [x for r in ds.ranges_of([(str(p), 0, len(ODD))], step) for x in ds.lines_of(r)]
        assert parts == whole


def test_written_lines_appear_together_and_failures_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("v"))
    ds.write_lines(df, path, "v")
    read = lambda: [r["value"] for r in ds.indexed_ranges(spark, path).orderBy("row_idx").collect()]
    assert read() == [str(i) for i in range(100)]
    broken = df.withColumn("v", F.when(F.col("v") == "99", "two\nlines").otherwise(F.col("v")))
    with pytest.raises(Exception, match="line end"):
        ds.write_lines(broken, path, "v")
    assert read() == [str(i) for i in range(100)]
    ds.write_lines(df.limit(3), path, "v", mode="overwrite")
    assert len(read()) == 3
    with pytest.raises(Exception, match="mounted folders"):
        spark.read.format(ds.NAME).load("hdfs://h/x").collect()


def test_line_stream_reads_what_files_gain(spark, tmp_path):
    ds.register_lines(spark)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    os.makedirs(src)

    def run():
        q = (spark.readStream.format(ds.NAME).load(src).select("value").writeStream.format("parquet")
                  .option("checkpointLocation", ck).trigger(once=True).start(out))
        q.awaitTermination()
        return sorted(r["value"] for r in spark.read.parquet(out).collect())
    with open(f"{src}/a", "w") as f:
        f.write("1\n2\n")
    assert run() == ["1", "2"]
    with open(f"{src}/a", "a") as f:
        f.write("3\n")
    with open(f"{src}/b", "w") as f:
        f.write("4\n")
    assert run() == ["1", "2", "3", "4"]


# ---------------------------------------------------------------- bucketed corpus

def test_bucketed_rebuild_moves_no_corpus_row(spark):
    rows = [(i, f"p{i % 60}", f"text {i}", i % 2) for i in range(100)]
    corpus = spark.createDataFrame(rows, "row_idx long, par_id string, text string, label int")
    manifest = spark.createDataFrame([(0, "p3"), (1, "p59"), (2, "nobody"), (3, "p3")], "m_idx long, par_id string")
    name = bk.write_bucketed(corpus, buckets=4)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "4", "false")):
            spark.conf.set(k, v)
        got = bk.rebuild_bucketed(spark, name, manifest)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # The one exchange moves the manifest; the scan of the corpus reads its buckets.
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "Exchange" not in plan[plan.index("FileScan"):]
        assert "FileScan" not in plan[plan.index("Exchange"):plan.index("Sort", plan.index("Exchange")) if "Sort" in plan[plan.index("Exchange"):] else None]
        want = sl.rebuild_split(corpus, manifest).select("m_idx", "par_id", "text", "label").collect()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)
        assert bk.rebuild_bucketed(spark, name, manifest, on_missing="drop").count() == 3
        with pytest.raises(Exception, match="id missing"):
            bk.rebuild_bucketed(spark, name, manifest, on_missing="error").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


# ---------------------------------------------------------------- streams with state

def test_runs_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(r, e, 0.5, 0.5, round(rng.random() * (0.2 if r == 3 else 1), 2)) for r in range(5) for e in range(24)]
    rows += [(9, e, 0.1, 0.1, 0.0) for e in range(8)]
    em = spark.createDataFrame(rows, st.EPOCHS)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for a, b in ((0, 7), (7, 15), (15, 24)):
        em.filter((F.col("epoch") >= a) & (F.col("epoch") < b)).write.mode("append").parquet(src)
        got = st.stream_best_checkpoint(spark, src, out, ck)
    want = rn.best_checkpoint(em)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_confusion_counts_positions_once(spark, tmp_path):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, label int, pred int").withColumn("ts", F.timestamp_seconds(F.lit(10 ** 6) + F.col("pos")))
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(3):
        df.filter(F.col("pos") % 3 == k).union(df.filter(F.col("pos") < 10)).write.mode("append").parquet(src)
        got = st.stream_confusion(spark, src, out, ck).first()
    count = lambda g, p: sum(x[1:] == (g, p) for x in rows)
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (count(1, 1), count(0, 1), count(1, 0), count(0, 0))


# ---------------------------------------------------------------- wide class vectors

def test_bitmaps_equal_the_narrow_vectors(spark):
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(20)}", rng.choice([None, 0, 31, 32, 63, 64, 5, 99])) for _ in range(120)]
    s = spark.createDataFrame(rows, "par_id string, category_id int")
    wide = cat.bitmap_to_multihot(cat.span_to_bitmap(s, keys=("par_id",)), 100)
    narrow = cat.span_to_multihot(s, 100, keys=("par_id",))
    key = lambda df: sorted((r["par_id"], r["n_spans"], tuple(r["label"])) for r in df.collect())
    assert key(wide) == key(narrow)
    ids = {r["par_id"]: r["ids"] for r in cat.bitmap_to_ids(cat.span_to_bitmap(s, keys=("par_id",))).collect()}
    assert ids == {p: sorted({c for q, c in rows if q == p and c is not None}) for p, _ in rows}


def test_plan_does_not_grow_with_the_classes(spark):
    s = spark.createDataFrame([("p", 1)], "par_id string, category_id int")
    size = [len(cat.bitmap_to_multihot(cat.span_to_bitmap(s, keys=("par_id",)), n)._jdf.queryExecution().optimizedPlan().toString())
            for n in (10, 10_000)]
    assert size[1] < size[0] + 200


def test_a_checkpoint_refuses_another_model(spark, tmp_path):
    from parlance.streaming.scoring import score_stream
    docs = spark.createDataFrame([(i, f"a b{i % 3}", "en", "s", 4) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    path, out, ck = (str(tmp_path / x) for x in ("docs", "out", "ck"))
    docs.write.parquet(path)
    model = spark.createDataFrame([("a", 0.5)], "word string, lo double")
    for _ in range(2):
        score_stream(spark, path, model, 0.1, out_dir=out, checkpoint=ck)
    assert spark.read.parquet(out).count() == 6
    with pytest.raises(ValueError, match="another model"):
        score_stream(spark, path, spark.createDataFrame([("a", 0.6)], "word string, lo double"), 0.1, out_dir=out, checkpoint=ck)
