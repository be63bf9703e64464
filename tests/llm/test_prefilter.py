from pyspark.sql import functions as F

from parlance.llm import prefilter as pf


def test_no_key_is_lost_and_most_others_are(spark, monkeypatch):
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    rows = spark.range(0, 30000).select(F.when(F.col("id") % 1000 == 999, None).otherwise(F.col("id")).alias("id"))
    for most in (27, 10):
        monkeypatch.setattr(pf, "MOST_BITS", most)
        monkeypatch.setattr(pf, "LEAST_BITS", 5)
        pages, bits = pf.bit_pages(keys, F.col("k"), 1000)
        got = {r["id"]: r["may"] for r in pf.marked(rows, F.col("id"), pages, bits, "may").collect()}
        assert all(got[k] for k in range(0, 3000, 3) if k % 1000 != 999)
        let = sum(got.values())
        assert let < 2200 if most == 27 else let > 10000
    pages, bits = pf.bit_pages(keys.limit(0), F.col("k"), 0)
    assert pf.marked(rows, F.col("id"), pages, bits, "may").filter("may").count() == 0
