"""Objectives against published values."""

import pytest

from quarry.functions import metrics as m

G1 = ([0, 0, 0, 0, 0, 1, 1, 1, 0, 1, 1], [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1])
G2 = ([0, 1, 0, 2, 0, 1, 2, 1, 2, 0, 2], [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2])
G3 = ([0, 1, 1, 0, 0, 1, 1, 1, 0, 1, 1], [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1])
G7 = ([1.5, 2, 3, 1, 0.5, 1, 2.5, 2.5, 1, 0.5, 2], [1.5, 2.5, 2, 1, 0.5, 1, 3, 2.25, 0.75, 0.25, 1.75])


def frame(spark, pair, kind="int"):
    return spark.createDataFrame([tuple(map(float, x)) for x in zip(*pair, strict=True)], "y double, p double").selectExpr(f"cast(y as {kind}) y", f"cast(p as {kind}) p")


def close(got, want):
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k


def test_binary(spark):
    close(m.binary_scores(frame(spark, G1), "y", "p").first(), {"AccuracyBinary": 0.6363636, "BalancedAccuracyBinary": 0.60})
    close(m.binary_scores(frame(spark, G3), "y", "p").first(), {"F1": 0.25, "Precision": 1.0, "Recall": 0.1428571, "MCCBinary": 0.2390457})
    close(m.auc(frame(spark, G3), "y", "p").first(), {"AUC": 0.5714285, "Gini": 0.1428571})


def test_log_loss(spark):
    from pyspark.sql import functions as F

    f = frame(spark, G3, "double")
    got = f.agg(m.log_loss(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))).alias("v")).first()
    assert got.v == pytest.approx(19.6601745, abs=1e-4)


def test_multiclass(spark):
    close(m.multiclass_scores(frame(spark, G2), "y", "p").first(), {
        "AccuracyMulticlass": 0.5454545, "BalancedAccuracyMulticlass": 0.5555555, "F1Micro": 0.5454545, "F1Macro": 0.5476190, "F1Weighted": 0.5454545,
        "PrecisionMicro": 0.5454545, "PrecisionMacro": 0.5555555, "PrecisionWeighted": 0.5606060, "RecallMacro": 0.5555555, "RecallWeighted": 0.5454545, "MCCMulticlass": 0.325,
    })


def test_multiclass_auc(spark):
    y = [0, 1, 2, 0, 2, 1]
    g5 = [[0.7, 0.2, 0.1], [0.1, 0.0, 0.9], [0.1, 0.3, 0.6], [0.9, 0.1, 0.0], [0.6, 0.1, 0.3], [0.5, 0.5, 0.0]]
    g4 = [[0.7, 0.2, 0.1], [0.3, 0.5, 0.2], [0.1, 0.3, 0.6], [0.9, 0.1, 0.0], [0.3, 0.1, 0.6], [0.5, 0.5, 0.0]]
    make = lambda g: spark.createDataFrame([(a, *b) for a, b in zip(y, g, strict=True)], "y int, p0 double, p1 double, p2 double")
    probas = {0: "p0", 1: "p1", 2: "p2"}
    assert m.multiclass_auc(make(g5), "y", probas).first()["AUCMacro"] == pytest.approx(0.75)
    assert m.multiclass_auc(make(g4), "y", probas).first()["AUCMicro"] == pytest.approx(0.9861111, abs=1e-6)


def test_regression(spark):
    close(m.regression_scores(frame(spark, G7, "double"), "y", "p").first(), {
        "RootMeanSquaredError": 0.3988620, "RootMeanSquaredLogError": 0.13090204, "MeanSquaredLogError": 0.0171353, "R2": 0.7638036, "MAE": 0.2727272,
        "MAPE": 15.9848484, "SMAPE": 18.13652589, "MSE": 0.1590909, "MedianAE": 0.25, "MaxError": 1.0, "ExpVariance": 0.7760736,
    })


def test_mase(spark):
    train = spark.createDataFrame(list(enumerate([5.0, 0.5, 4.0, 6.0, 3.0, 5.0, 2.0])), "t long, v double")
    test = spark.createDataFrame(list(zip([3.0, -0.5, 2.0, 7.0, 2.0], [2.5, 0.0, 2.0, 8.0, 1.25], strict=True)), "y double, p double")
    assert m.mase(test, "y", "p", train, "v", "t").first()["MASE"] == pytest.approx(0.18333333333333335)


def test_percent_better():
    assert m.objective("F1").percent_better(0.6, 0.5) == pytest.approx(10.0)
    assert m.objective("MAE").percent_better(1.0, 2.0) == pytest.approx(50.0)
