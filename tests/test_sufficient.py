"""Learning curves and cross-validation from one aggregate against separate fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vigil.ml.compare import _score, cross_val, predictions
from vigil.ml.explain import learning_curve
from vigil.ml.models import make_estimator
from vigil.ml.sufficient import fold_scores

FOLDS, SEED = 3, 42


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"k": range(n), "a": rng.normal(1e4, 3, n), "b": rng.normal(size=n), "c": rng.integers(0, 3, n).astype(float)})
    pdf["y"] = 2 * (pdf["a"] - 1e4) - pdf["b"] + rng.normal(scale=2, size=n)
    pdf["cls"] = np.clip(np.round(pdf["b"] + rng.normal(scale=0.6, size=n)) + 1, 0, 2)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf))


@pytest.mark.parametrize("name, task, label", [("naive_bayes", "classification", "cls"), ("linear_regression", "regression", "y"), ("ridge", "regression", "y")])
def test_equal_to_separate_fits(data, name, task, label):
    d = data.withColumn("label", F.col(label))
    fractions = [0.1, 0.55, 1.0]
    got = {(s, f): rest for s, f, *rest in fold_scores(d, name, "k", FOLDS, fractions, SEED)}
    marked = d.withColumn("fold", F.pmod(F.xxhash64("k", F.lit(SEED)), F.lit(FOLDS))).withColumn("u", F.pmod(F.xxhash64("k", F.lit(SEED + 1)), F.lit(1_000_003)) / 1_000_003.0)
    primary = "accuracy" if task == "classification" else "r2"
    assert len(got) == 9
    for s, frac in enumerate(fractions):
        for fold in range(FOLDS):
            tr, va = marked.where((F.col("fold") != fold) & (F.col("u") < frac + 1e-12)), marked.where(F.col("fold") == fold)
            m = make_estimator(name, task, tr, n_classes=3).fit(tr)
            n, train, val = got[(s, fold)]
            assert n == tr.count()
            assert train == pytest.approx(_score(predictions(m, tr, None), task)[primary], abs=1e-6)
            assert val == pytest.approx(_score(predictions(m, va, None), task)[primary], abs=1e-6)
    curve = learning_curve(d, name, task, "k", folds=FOLDS, sizes=3, seed=SEED).toPandas()
    last = [got[(2, f)] for f in range(FOLDS)]
    assert curve["val_mean"].iloc[-1] == pytest.approx(np.mean([v for _, _, v in last])) and curve["train_rows"].iloc[-1] == pytest.approx(np.mean([n for n, _, _ in last]))
    assert cross_val(d, name, task, "k", folds=FOLDS, seed=SEED) == pytest.approx(np.mean([v for _, _, v in last]))


def test_two_scans_whatever_the_number_of_fits(data, monkeypatch):
    calls = []
    cls = type(data)
    run = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda self, *a, **b: (calls.append(1), run(self, *a, **b))[1])
    learning_curve(data.withColumn("label", F.col("cls")), "naive_bayes", "classification", "k", folds=5, sizes=10).collect()
    assert len(calls) == 2


def test_repeated_and_constant_features(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(x), 1.0, float(2 * x + 1)) for i, x in enumerate(rng.normal(size=90))]
    d = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows, "k long, a double, b double, c double, label double"))
    assert cross_val(d, "linear_regression", "regression", "k", folds=3) == pytest.approx(1.0)
    assert cross_val(d, "ridge", "regression", "k", folds=3) > 0.99
