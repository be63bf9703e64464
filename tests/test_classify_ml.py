"""The pyspark.ml pipeline: rows, a learnable split, one-class training."""

from pyspark.sql import functions as F

from parlance.operators import classify as cl


def _rows(spark, n, start=0):
    return spark.createDataFrame([(str(start + i), f"{'bad poor sad' if i % 3 == 0 else 'good fine glad'} w{i % 7}", int(i % 3 == 0))
                                  for i in range(n)], "par_id string, text string, label int")


def test_learns_a_clear_split(spark):
    out = cl.classify_ml(_rows(spark, 60), _rows(spark, 30, 100), num_features=1 << 10).collect()
    assert sorted(r.par_id for r in out) == sorted(str(100 + i) for i in range(30))
    assert all(r.pred == r.label for r in out)


def test_one_class_and_empty_training(spark):
    train, docs = _rows(spark, 12), _rows(spark, 5)
    ones = cl.classify_ml(train.withColumn("label", F.lit(1)), docs).collect()
    none = cl.classify_ml(train.limit(0), docs).collect()
    assert {r.pred for r in ones} == {1} and {r.pred for r in none} == {0} and len(ones) == len(none) == 5


def test_seven_way_weights_learn_their_words(spark):
    rows = [(i, f"p{i}", f"word{i % 3} common text", [int(i % 3 == 0), int(i % 3 == 1), 0, 1]) for i in range(60)]
    df = spark.createDataFrame(rows, "m_idx long, par_id string, text string, label array<int>")
    docs = spark.createDataFrame([(100, "a", "word0 text", [0, 0, 0, 0]), (101, "b", "word1 common", [0, 0, 0, 0]), (102, "c", None, [0, 0, 0, 0])], df.schema)
    got = {r["m_idx"]: r["pred"] for r in cl.classify_ml_multilabel(df, docs, 4, num_features=1 << 10).collect()}
    assert got[100] == [1, 0, 0, 1] and got[101] == [0, 1, 0, 1] and got[102][2:] == [0, 1]
    assert cl.classify_ml_multilabel(df.limit(0), docs, 4).first()["pred"] == [0, 0, 0, 0]


def test_vocabulary_counts(spark):
    rows = [(f"p{i}", "good fine" if i % 2 else "bad awful", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "par_id string, text string, label int")
    got = cl.classify_ml(df, df, num_features=16, vocabulary=True)
    assert got.filter("label = pred").count() == 40
