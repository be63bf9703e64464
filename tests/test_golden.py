"""Golden values from the reference's published figures."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import metrics as mt
from parlance.operators import scores as sc

# (published F1, predicted positives PP, true positives TP) on the 2,094-row dev set.
RUNS = [(0.48253968253968244, 431, 152), (0.46412213740458014, 456, 152),
        (0.4925619834710743, 406, 149), (0.5685279187817258, 195, 112),
        (0.5802816901408451, 156, 103), (0.0, 0, 0)]
N, GOLD_POS = 2094, 199


@pytest.mark.parametrize("f1,pp,tp", RUNS)
def test_prf1_reproduces_published_f1(spark, f1, pp, tp):
    df = spark.range(N).select(
        (F.col("id") < GOLD_POS).cast("int").alias("label"),
        ((F.col("id") < tp) | ((F.col("id") >= GOLD_POS) & (F.col("id") < GOLD_POS + pp - tp))).cast("int").alias("pred"))
    r = mt.prf1(df).first()
    assert (r.tp, r.tp + r.fp, r.tp + r.fn) == (tp, pp, GOLD_POS)
    assert r.f1 == f1


def test_binary_focal_loss_doc_example(spark):
    df = spark.createDataFrame([(6.325, 1.0), (5.26, 1.0), (87.49, 0.0)], "x double, y double")
    rows = sc.binary_focal_loss_rows(df, "x", "y", alpha=0.25, gamma=2.0)
    assert sc.reduce_loss(rows, "mean").first().loss == pytest.approx(21.8725, abs=1e-4)
    with pytest.raises(NotImplementedError):
        sc.reduce_loss(rows, "median")


def test_focal_loss_gamma_zero_is_scaled_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], 1), ([3.0, -1.0, 0.0], 2)], "logits array<double>, gold int")
    fl = sc.focal_loss_rows(df, alpha=0.5, gamma=0.0).select("loss").collect()
    ce = sc.cross_entropy_rows(df).select("loss").collect()
    assert [a.loss for a in fl] == pytest.approx([0.5 * b.loss for b in ce])
