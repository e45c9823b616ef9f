"""Exact tree Shapley values against enumeration of all coalitions, and additivity on Spark's models."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

import vigil.ml.tree_shap as S


def random_tree(rng, dim, depth):
    rows = []

    def grow(level, cover):
        i = len(rows)
        rows.append(None)
        if level == depth or rng.random() < 0.15 and level:
            rows[i] = (-1, np.nan, -1, -1, cover, rng.normal(), None)
            return i
        part = rng.integers(1, 10) / 10
        f, sets = int(rng.integers(dim)), frozenset(rng.choice(4, 2, replace=False).tolist()) if rng.random() < 0.3 else None
        a, b = grow(level + 1, cover * part), grow(level + 1, cover * (1 - part))
        rows[i] = (f, np.nan if sets else rng.integers(0, 4) + 0.5, a, b, cover, 0.0, sets)
        return i

    grow(0, 100.0)
    c = list(zip(*rows))
    return S.Tree(*(np.array(v) for v in c[:6]), categories={i: s for i, s in enumerate(c[6]) if s})


def expectation(t, x, known, node=0):
    f = t.feature[node]
    if f < 0:
        return t.value[node]
    a, b = t.left[node], t.right[node]
    if f in known:
        left = x[f] in t.categories[node] if node in t.categories else x[f] <= t.threshold[node]
        return expectation(t, x, known, a if left else b)
    total = t.cover[a] + t.cover[b]
    return (t.cover[a] * expectation(t, x, known, a) + t.cover[b] * expectation(t, x, known, b)) / total


def brute(trees, x, dim):
    phi = np.zeros(dim)
    game = {s: sum(expectation(t, x, s) for t in trees) for r in range(dim + 1) for s in map(frozenset, itertools.combinations(range(dim), r))}
    for i in range(dim):
        for s, v in game.items():
            if i not in s:
                phi[i] += math.factorial(len(s)) * math.factorial(dim - len(s) - 1) / math.factorial(dim) * (game[s | {i}] - v)
    return phi, game[frozenset()]


@pytest.mark.parametrize("dim, depth, cells", [(1, 2, 10**6), (4, 5, 10**6), (5, 7, 40), (6, 3, 1)])
def test_equal_to_enumeration(monkeypatch, dim, depth, cells):
    monkeypatch.setattr(S, "CELLS", cells)
    rng = np.random.default_rng(dim)
    trees = [random_tree(rng, dim, depth) for _ in range(3)]
    x = rng.integers(0, 4, (7, dim)).astype(float)
    leaves = S.Leaves(trees, dim)
    got = leaves.explain(x)
    for row, phi in zip(x, got):
        want, base = brute(trees, row, dim)
        assert phi == pytest.approx(want, abs=1e-10) and leaves.base == pytest.approx(base)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), float(rng.integers(0, 3)), c) for a, b, c in zip(rng.normal(size=300), rng.integers(0, 5, 300), rng.choice(list("pqrs"), 300))]
    d = spark.createDataFrame(rows, "a double, b double, c double, s string")
    d = StringIndexer(inputCol="s", outputCol="si").fit(d).transform(d)  # a categorical feature
    d = VectorAssembler(inputCols=["a", "b", "c", "si"], outputCol="features").transform(d)
    y = F.col("a") * 2 + F.col("b") * F.col("c") + F.when(F.col("s") == "p", 3).otherwise(0)
    return d.withColumn("label", y).withColumn("cls", (y > 4).cast("double"))


@pytest.mark.parametrize("est, options, out", [
    (DecisionTreeRegressor, {"maxDepth": 6}, "prediction"), (RandomForestRegressor, {"numTrees": 4, "maxDepth": 4, "seed": 1}, "prediction"),
    (GBTRegressor, {"maxIter": 4, "maxDepth": 3}, "prediction"), (DecisionTreeClassifier, {"labelCol": "cls", "maxDepth": 5}, "probability"),
    (RandomForestClassifier, {"labelCol": "cls", "numTrees": 5, "maxDepth": 5, "seed": 2}, "probability"),
    (GBTClassifier, {"labelCol": "cls", "maxIter": 3, "maxDepth": 2}, "rawPrediction")])
def test_additive_on_spark_models(table, est, options, out):
    est = est(**options)
    model = est.fit(table)
    f = F.col("prediction") if out == "prediction" else vector_to_array(out)[1]
    got = S.tree_attributions(model, model.transform(table).withColumn("f", f), ["f"]).collect()
    assert len(got) == 300
    for r in got:
        assert r["base"] + sum(r["phi"]) == pytest.approx(r["f"], abs=1e-9)


def test_importance_weighs_repeats_and_orders(spark, table):
    model = DecisionTreeRegressor(maxDepth=4).fit(table)
    twice = table.union(table.where("a > 0")).repartition(5)
    phi = np.array([r["phi"] for r in S.tree_attributions(model, twice).collect()])
    want = sorted(zip(-np.abs(phi).mean(0), "abcs"))
    got = S.shapley_trees(model, twice, list("abcs")).collect()
    assert [(r["feature"], pytest.approx(r["importance"])) for r in got] == [(n, -v) for v, n in want]
    assert S.shapley_trees(model, twice, list("abcs"), top=2).count() == 2
    assert S.shapley_trees(model, twice.where("a > 99"), list("abcs")).count() == 0


def test_a_leaf_alone(spark):
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, label double"))
    got = S.tree_attributions(DecisionTreeRegressor().fit(d), d).collect()
    assert [(r["base"], r["phi"]) for r in got] == [(2.0, [0.0])] * 2
