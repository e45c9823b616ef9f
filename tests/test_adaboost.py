"""AdaBoost on cached blocks against the same rounds with Spark's trees."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vigil.ml import boosting
from vigil.ml.boosting import AdaBoost


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    label = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=600) > 0.4).astype(float)
    pdf = pd.DataFrame({"k": range(600), "a": x[:, 0], "b": x[:, 1], "c": np.round(x[:, 2]), "label": label, "three": label + (x[:, 2] > 1)})
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf)).cache()


def with_spark_trees(d, label, rounds):
    """SAMME as it was: a Spark tree of depth 1 a round on a column of weights."""
    k, n = d.select(label).distinct().count(), d.count()
    out, d = [], d.withColumn("w", F.lit(1.0 / n))
    for m in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=1, weightCol="w", labelCol=label, predictionCol="p", seed=42 + m).fit(d)
        p = tree.transform(d).drop("rawPrediction", "probability")
        miss = (F.col("p") != F.col(label)).cast("double")
        err, total = p.agg(F.sum(F.col("w") * miss), F.sum("w")).first()
        err /= total
        alpha = math.log((1 - err) / err) + math.log(k - 1)
        root = tree._call_java("rootNode")
        cut = (root.split().featureIndex(), root.split().threshold()) if root.subtreeDepth() else (0, None)
        out.append((*cut, alpha))
        p = p.withColumn("w", F.col("w") * F.exp(F.lit(alpha) * miss)).drop("p")
        total = p.agg(F.sum("w")).first()[0]
        d = p.withColumn("w", F.col("w") / F.lit(total)).cache()
    return out


@pytest.mark.parametrize("label", ["label", "three"])
def test_rounds_equal_those_of_spark_trees(table, label):
    m = AdaBoost(n_estimators=5, labelCol=label).fit(table)
    want = with_spark_trees(table, label, 5)
    assert [s[:2] for s in m.stumps] == [w[:2] for w in want]
    assert m.alphas == pytest.approx([w[2] for w in want], rel=1e-9)


def test_a_round_is_one_pass(spark, table):
    sc = spark.sparkContext
    sc.setJobGroup("boost", "boost")
    try:
        m = AdaBoost(n_estimators=12).fit(table)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(m.stumps) == 12
    assert len(sc.statusTracker().getJobIdsForGroup("boost")) <= 3 * 12 + 12  # over ten a round before


def test_quantile_places_and_repartitioning(table, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 64)
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    few, many = (AdaBoost(n_estimators=4).fit(d) for d in (table, table.repartition(9)))
    assert few.stumps == many.stumps
    monkeypatch.setattr(boosting, "EXACT", 50)  # approximate quantiles: a partition may move an end by a value
    monkeypatch.setattr(boosting, "RANGES", 128)
    coarse = AdaBoost(n_estimators=4).fit(table.repartition(9))
    exact_right, right = (m.transform(table).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] for m in (few, coarse))
    assert right > exact_right - 0.03


def test_one_class_no_cut_and_no_rows(spark, table):
    one = AdaBoost().fit(table.withColumn("label", F.lit(1.0)))
    assert {r[0] for r in one.transform(table).select("prediction").collect()} == {1.0}
    flat = table.where("a > 0").drop("features").withColumns({c: F.lit(2.0) for c in "abc"})
    flat = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(flat)
    most = flat.groupBy("label").count().orderBy(F.desc("count")).first()["label"]
    assert {r[0] for r in AdaBoost().fit(flat).transform(flat).select("prediction").collect()} == {most}
    with pytest.raises(ValueError):
        AdaBoost().fit(table.where("k < 0"))
    with pytest.raises(ValueError):
        AdaBoost().fit(table.withColumn("label", F.when(F.col("k") > 0, F.col("label"))))
