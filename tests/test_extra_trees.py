"""Extra trees: random cuts on all rows, independent of partitions; saving of models that hold tables."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

import vigil.ml.extra_trees as E


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(c), float(a + b > 0.2), float(3 * a - b + rng.normal() * 0.01)) for a, b, c in rng.normal(size=(400, 3))]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, a double, b double, c double, cls double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(d)


def check_tree(tree, x, y, classes):
    """Every node holds the statistics of exactly the rows that reach it; cuts lie inside the node's values."""
    f, c, left, right, stats = tree
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        want = np.bincount(y[rows].astype(int), minlength=classes) if classes else [len(rows), y[rows].sum(), (y[rows] ** 2).sum()]
        assert stats[node] == pytest.approx(want)
        if f[node] < 0:
            assert len(np.unique(y[rows])) == 1 or len(rows) < 2 or classes == 0 or len(np.unique(x[rows], axis=0)) == 1
            continue
        v = x[rows, f[node]]
        assert v.min() <= c[node] < v.max()
        todo += [(left[node], rows[v <= c[node]]), (right[node], rows[v > c[node]])]


@pytest.mark.parametrize("task, label", [("classification", "cls"), ("regression", "label")])
def test_grown_on_all_rows_and_stable(table, task, label):
    pdf = table.toPandas()
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf[label].to_numpy()
    fit = lambda d: E.ExtraTrees(task, n_estimators=4, max_depth=30 if task == "classification" else 6, labelCol=label).fit(d)
    m = fit(table)
    for t in m.grown:
        check_tree(t, x, y, 2 if task == "classification" else 0)
    again = fit(table.repartition(7))
    for a, b in zip(m.grown, again.grown):
        assert all(np.array_equal(u, v, equal_nan=True) for u, v in zip(a[:4], b[:4]))
    assert len({tuple(np.nan_to_num(t[1]).tolist()) for t in m.grown}) == 4  # the trees differ
    out = m.transform(table).toPandas()
    if task == "classification":
        assert (out["prediction"] == y).mean() == 1.0  # grown until pure, on every row
        assert np.allclose(np.stack(out["probability"].map(lambda v: v.toArray())).sum(1), 1)
    else:
        assert np.corrcoef(out["prediction"], y)[0, 1] > 0.95
    imp = m.featureImportances.toArray()
    assert imp.sum() == pytest.approx(1) and imp[0] > imp[2]


def test_thresholds_are_uniform(spark):
    d = VectorAssembler(inputCols=["v"], outputCol="features").transform(spark.createDataFrame([(float(v), float(v > 3)) for v in range(11)], "v double, label double"))
    cuts = [t[1][0] for t in E.ExtraTrees(n_estimators=200, max_depth=1).fit(d).grown]
    assert np.mean(cuts) == pytest.approx(5, abs=0.7) and np.std(cuts) == pytest.approx(10 / 12**0.5, abs=0.5)


def test_edges(spark):
    va = VectorAssembler(inputCols=["v"], outputCol="features")
    same = va.transform(spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (1.0, 1.0)], "v double, label double"))
    m = E.ExtraTrees(n_estimators=2).fit(same)
    assert [r["prediction"] for r in m.transform(same).collect()] == [1.0] * 3
    assert m.transform(same.where("v > 5")).collect() == []
    with pytest.raises(ValueError):
        E.ExtraTrees().fit(same.where("v > 5"))


@pytest.mark.parametrize("name", ["extra_trees", "knn", "adaboost", "target_encoder"])
def test_saved_inside_a_pipeline(spark, table, tmp_path, name):
    from vigil.ml.boosting import AdaBoost
    from vigil.ml.features import TargetEncoderStage
    from vigil.ml.neighbors import KNN
    stage = {"extra_trees": lambda: E.ExtraTrees(n_estimators=3, labelCol="cls"), "knn": lambda: KNN(k=3, labelCol="cls"),
             "adaboost": lambda: AdaBoost(n_estimators=2, labelCol="cls"),
             "target_encoder": lambda: TargetEncoderStage(inputCols=["s"], outputCols=["prediction"], labelCol="cls")}[name]()
    d = table.selectExpr("k", "a", "b", "c", "cls", "string(k % 7) AS s")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), stage]).fit(d)
    path = str(tmp_path / name)
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    for m in (model, again):
        m.rows = [tuple(r) for r in m.transform(d).orderBy("k").select("k", "prediction").collect()]
    assert model.rows == again.rows and len(model.rows) == 400


def test_attributions_of_extra_trees(table):
    from vigil.ml.tree_shap import tree_attributions
    m = E.ExtraTrees("regression", n_estimators=3, max_depth=4).fit(table)
    for r in tree_attributions(m, m.transform(table), ["prediction"]).collect():
        assert r["base"] + sum(r["phi"]) == pytest.approx(r["prediction"], abs=1e-9)


def test_knn_needs_k_rows(spark, table):
    from vigil.ml.neighbors import KNN
    with pytest.raises(ValueError):
        KNN(k=5, labelCol="cls").fit(table.limit(4))
