import math

import pytest

from strandweave.operators import metrics as M


@pytest.fixture(scope="module")
def cases(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.8, 1), ("a", 0.1, 0), ("one", 0.5, 0), ("one", 0.7, 0)]
    return spark.createDataFrame(rows, "stratum string, predicted double, label int")


def test_ranking(cases):
    got = {r["stratum"]: r for r in M.ranking_metrics(cases, ["stratum"]).collect()}
    a = got["a"]
    assert a["roc_auc"] == pytest.approx((1 + 1 + 1 + 0.5) / 4) and a["pr_auc"] == pytest.approx(0.5 + 0.5 * 2 / 3) and a["top_k_accuracy"] == pytest.approx((1 + 0.5) / 2)
    assert got["one"]["roc_auc"] == got["one"]["pr_auc"] == got["one"]["pr_auc_skill"] == got["one"]["top_k_accuracy"] == 0


def test_threshold_degenerate(cases):
    got = {r["stratum"]: r for r in M.threshold_metrics(cases, ["stratum"]).collect()}
    assert got["one"]["mcc"] == 0 and got["one"]["brier_skill"] == 0
    assert got["a"]["mcc"] == pytest.approx((2 * 1 - 1 * 0) / math.sqrt(3 * 2 * 2 * 1))


def test_flat_regression_and_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "predicted double, measured double")
    r = M.regression(df, []).first()
    assert (r["slope"], r["intercept"]) == (0.0, 3.0)
    assert M.pearson(df, [], "predicted", "measured").first()["pearson"] == 0.0


def test_conformal_infinite_when_few(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "residual double")
    assert math.isinf(M.conformal(df, [], "residual", 0.9).first()["q"])
    r = M.conformal(df, [], "residual", 0.5).first()
    assert r["q"] == 2.0 and r["covered"] == pytest.approx(0.6)


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0.05, 0), (0.95, 1), (1.0, 1)], "predicted double, label int")
    assert sorted(r["bin"] for r in M.reliability(df, [], 10).collect()) == [0, 9]


def test_sign_test_and_bootstrap(spark):
    assert M.sign_test(0, 0) == 1.0 and M.sign_test(5, 0) == pytest.approx(2 / 32)
    df = spark.createDataFrame([(g, float(i), float(i + g % 2)) for g in range(6) for i in range(8)], "group long, x double, y double")
    lo, hi = M.cluster_bootstrap(df, lambda c, by: M.pearson(c, by, "x", "y").select("pearson"), 40)
    assert lo <= hi <= 1.0
