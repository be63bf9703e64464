"""Readers and writers on small files, including the traps of the formats."""

import os

import pytest
from pyspark.sql import functions as F

from parlance.sources import readers as rd
from parlance.sources import sinks as sk
from parlance.sources.lines import indexed_lines

HEADER = "\n\n\n\n"


def write(tmp_path, name, text, newline="\n"):
    p = tmp_path / name
    p.write_bytes(text.replace("\n", newline).encode("utf-8"))
    return str(p)


def test_labelled_tsv_traps(spark, tmp_path):
    body = HEADER + "\n".join([
        "1\ta1\tk\tc\tsome text\t3",          # regular
        "2\ta2\tk\tc\ttext\twith tab\t0",     # extra tab: text is field 4, grade last
        "3\ta3\tk\tc\tfive",                  # exactly 5 fields: grade == text
        "4\ta4\tk\tc\tunknown grade\t5",      # unknown grade counts as positive
        "  5\ta5\tk\tc\tblanks\t1  ",         # outer blanks stripped
        "6\ta6\tk\tc\tnbsp\t1 ",         # non-ASCII blank stripped like str.strip
    ]) + "\n"
    path = write(tmp_path, "pcl.tsv", body)
    rows = {r.par_id: r for r in rd.read_labelled_tsv(spark, path).collect()}
    assert rows["1"].label == 1 and rows["1"].orig_label == "3" and rows["1"].text == "some text"
    assert rows["2"].text == "text" and rows["2"].orig_label == "0" and rows["2"].label == 0
    assert rows["3"].text == "five" and rows["3"].orig_label == "five" and rows["3"].label == 1
    assert rows["4"].label == 1
    assert rows["5"].label == 0 and rows["5"].orig_label == "1"
    assert rows["6"].orig_label == "1"
    assert sorted(r.row_idx for r in rows.values()) == list(range(6))


def test_labelled_tsv_short_line(spark, tmp_path):
    path = write(tmp_path, "bad.tsv", HEADER + "1\ta\tk\tc\tt\t0\n2\ta\tk\n")
    with pytest.raises(Exception):
        rd.read_labelled_tsv(spark, path).collect()
    got = rd.read_labelled_tsv(spark, path, mode="permissive").collect()
    assert [r._corrupt_record for r in sorted(got, key=lambda r: r.row_idx)] == [None, "2\ta\tk"]


def test_crlf_and_header_per_file(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for i in range(3):
        write(d, f"part-{i}.tsv", HEADER + f"{i}0\ta\tk\tc\tt\t0\n{i}1\ta\tk\tc\tt\t2\n", newline="\r\n")
    got = rd.read_labelled_tsv(spark, str(d)).orderBy("row_idx").collect()
    assert [r.par_id for r in got] == ["00", "01", "10", "11", "20", "21"]
    assert [r.row_idx for r in got] == list(range(6))
    assert [r.orig_label for r in got] == ["0", "2"] * 3


def test_line_numbers_across_splits(spark, tmp_path):
    n = 20000
    path = write(tmp_path, "big.txt", "".join(f"{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        df = indexed_lines(spark, path, header_lines=3)
        got = df.select("line_no", "row_idx", F.col("value").cast("int").alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == n - 3
    assert all(r.v == r.line_no and r.row_idx == r.line_no - 3 for r in got)


def test_span_tsv(spark, tmp_path):
    lines = [
        "p1\ta1\tpar one\tk\tc\t0\t3\tpar\tShallow_solution\t2",
        "p1\ta1\tpar one\tk\tc\t4\t7\tone\tUnbalanced_power_relations\t1",
        "p1\ta1\tpar one\tk\tc\t0\t3\tpar\tShallow_solution\t2",   # same category twice
        "p2\ta2\tpar two\tk\tc\t0\t3\tpar\tCompassion\t3",
    ]
    path = write(tmp_path, "cats.tsv", HEADER + "\n".join(lines) + "\n")
    from parlance.operators.categories import span_to_ids, span_to_multihot
    spans = rd.read_span_tsv(spark, path)
    ids = {r.par_id: r.label for r in span_to_ids(spans, 7).collect()}
    assert ids == {"p1": [1, 0], "p2": [5]}
    hot = {r.par_id: r.label for r in span_to_multihot(spans, 7).collect()}
    assert hot["p1"] == [1, 1, 0, 0, 0, 0, 0] and hot["p2"] == [0, 0, 0, 0, 0, 1, 0]
    bad = write(tmp_path, "bad.tsv", HEADER + "p\ta\tt\tk\tc\t0\t1\tx\tNoSuchCategory\t1\n")
    with pytest.raises(Exception):
        rd.read_span_tsv(spark, bad).collect()


def test_manifest_and_rebuild(spark, tmp_path):
    path = write(tmp_path, "ids.csv", "par_id,label\n7,\"[1, 0]\"\n007,\"[0, 1]\"\n9,\"[0, 0]\"\n7,\"[1, 0]\"\n")
    m = rd.read_split_manifest(spark, path)
    assert [r.par_id for r in m.collect()] == ["7", "7", "9", "7"]   # leading zeros dropped as in pandas
    corpus = spark.createDataFrame([(0, "7", "first", 1), (1, "7", "second", 0), (2, "8", "x", 0)],
                                   "row_idx long, par_id string, text string, label int")
    from parlance.operators.splits import missing_ids, rebuild_split
    man = m.withColumn("m_idx", F.monotonically_increasing_id())
    got = rebuild_split(corpus, man).collect()
    assert sorted((r.par_id, r.text) for r in got) == [("7", "first")] * 3 + [("9", None)]
    assert [r.par_id for r in missing_ids(man, corpus).collect()] == ["9"]
    with pytest.raises(Exception):
        rebuild_split(corpus, man, on_missing="error").collect()


def test_unlabelled_and_prompt_readers(spark, tmp_path):
    p = write(tmp_path, "test.tsv", "1\ta\tk\tc\thello world\n2\tb\tk\tc\tbye\n")
    assert [r.text for r in rd.read_unlabelled_tsv(spark, p).orderBy("row_idx").collect()] == ["hello world", "bye"]
    q = write(tmp_path, "pairs.txt", "src one\ttgt one\nsrc two\ttgt two\n")
    assert [(r.source, r.target) for r in rd.read_prompt_pairs(spark, q).orderBy("row_idx").collect()] == \
        [("src one", "tgt one"), ("src two", "tgt two")]
    lp = write(tmp_path, "labels.txt", "a text\t1\n0\n")
    assert [r.label for r in rd.read_label_pairs(spark, lp).orderBy("row_idx").collect()] == [1, 0]


def test_sink_header_lines_quirk(spark, tmp_path):
    """Written without header lines and read with the skip, the first four
    rows are lost (the reference's augmented file); the default keeps them."""
    df = spark.createDataFrame([(i, str(i), "a", "k", "c", f"text {i}", "2") for i in range(10)],
                               "row_idx long, par_id string, art_id string, keyword string, country string, text string, orig_label string")
    lossless = sk.write_augmented_tsv(df, str(tmp_path / "aug4"), num_files=3)
    assert rd.read_labelled_tsv(spark, lossless).count() == 10
    lossy = sk.write_augmented_tsv(df, str(tmp_path / "aug0"), header_lines=0, num_files=1)
    assert rd.read_labelled_tsv(spark, lossy).count() == 6


def test_label_lines_roundtrip_multilabel(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 0, 1]), (1, [0, 0, 0])], "row_idx long, pred array<int>")
    path = sk.write_label_lines(df, str(tmp_path / "task2"))
    assert [r.value for r in indexed_lines(spark, path).orderBy("row_idx").collect()] == ["1,0,1", "0,0,0"]
