"""Infinities, NaN and odd names in statistics and evaluation tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    x = [float(v) for v in rng.normal(10, 2, 200)] + [40.0]
    return x, spark.createDataFrame([(v,) for v in x + [INF, -INF, NAN, None]], "`a.b` double")


def test_zscore_and_summary_over_finite_values(values):
    from vigil.operators.outliers import outlier_summary, outliers_zscore
    x, df = values
    z = (np.array(x) - np.mean(x)) / np.std(x)
    got = outliers_zscore(df, ["a.b"]).collect()
    assert [(r["value"], pytest.approx(r["z"])) for r in got] == [(v, t) for v, t in zip(x, z) if abs(t) > 3]
    rows = {r["method"]: r for r in outlier_summary(df, ["a.b"], with_iforest=False).collect()}
    assert rows["zscore"]["n_outliers"] == 1 and rows["zscore"]["pct_outliers"] == pytest.approx(100 / 203)
    assert rows["iqr"]["n_outliers"] >= 3


def test_kde_and_numeric_stage(values):
    from vigil.ml.features import NumericStage
    from vigil.operators.profile import kde
    x, df = values
    got = kde(df, "a.b").collect()
    assert len(got) == 200 and all(np.isfinite(r["x"]) and np.isfinite(r["density"]) for r in got)
    step = got[1]["x"] - got[0]["x"]
    assert sum(r["density"] for r in got) * step == pytest.approx(1, abs=0.02)
    m = NumericStage(inputCols=["a.b"], outputCols=["s"]).fit(df)
    med = float(np.median(x))
    filled = np.array(x + [med] * 4)
    want = (filled - filled.mean()) / filled.std()
    assert sorted(r["s"] for r in m.transform(df).collect()) == pytest.approx(sorted(want))


def test_scores_and_labels_that_are_missing(spark):
    from vigil.operators.evaluate import calibration_curve, decile_table, pr_curve, roc_auc, roc_curve
    good = [(1.0, 0.9), (0.0, 0.2), (1.0, 0.6), (0.0, 0.7), (1.0, 0.95), (0.0, 0.1)]
    bad = [(1.0, NAN), (0.0, NAN), (None, 0.99), (None, 0.01), (NAN, 0.5), (1.0, None), (None, None)]
    schema = "`y.t` double, `p.s` double"
    clean, holed = (spark.createDataFrame(rows, schema) for rows in (good, good + bad))
    for f in (roc_curve, roc_auc, pr_curve, calibration_curve):
        a, b = (sorted((tuple(r) for r in f(d, "y.t", "p.s").collect()), key=str) for d in (clean, holed))
        assert a == b, f
    d = decile_table(holed.where("`y.t` is not null"), "classification", "y.t", probability="p.s")
    assert d.agg(F.sum("n")).first()[0] == len(good) + 1


def test_dotted_names(spark):
    from vigil.operators.bivariate import corr_matrix
    from vigil.operators.evaluate import classification_metrics, prediction_range, qq_fit, regression_metrics, residual_histogram
    rng = np.random.default_rng(2)
    rows = [(float(a), float(a + b), None if a > 1.5 else float(b)) for a, b in rng.normal(size=(80, 2))]
    odd, plain = (spark.createDataFrame(rows, s) for s in ("`x.1` double, `y 2` double, `z``3` double", "a double, b double, c double"))
    names = dict(zip(odd.columns, plain.columns))
    for method in ("pearson", "spearman", "kendall"):
        got = {(names[r["col_a"]], names[r["col_b"]]): r["corr"] for r in corr_matrix(odd, method=method).collect()}
        want = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_matrix(plain, method=method).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for f in (regression_metrics, prediction_range, residual_histogram, qq_fit):
        assert f(odd, "x.1", "y 2").collect() == f(plain, "a", "b").collect()
    classes = spark.createDataFrame([("a", "a"), ("b", "a")], "`t.t` string, `p.p` string")
    assert classification_metrics(classes, "t.t", "p.p").first()["accuracy"] == 0.5
