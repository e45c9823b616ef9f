"""Model queries whose work must not grow faster than their input (findings of round 3)."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F


def _points(spark, n, dim=3):
    cols = [F.pmod(F.xxhash64("id", F.lit(j)), F.lit(40)).cast("double") for j in range(dim)]
    return spark.range(n).select("id", array_to_vector(F.array(*cols)).alias("features"), F.pmod(F.xxhash64("id", F.lit(99)), F.lit(2)).cast("double").alias("label"))


def test_prepared_rows_are_computed_once(spark):
    from vigil.ml.compare import prepare_features
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    d = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("label"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
                                counted(F.col("id").cast("double")).alias("x"))
    _, data, _ = prepare_features(d)
    data.agg(F.sum(F.size(F.split("split", "")))).collect()
    assert data.count() == 200 and seen.value == 200


def test_nearest_rows_are_the_nearest():
    from vigil.ml.neighbors import nearest_rows, squared
    r = np.random.default_rng(5)
    for n, m in ((3, 4), (400, 200), (3000, 150)):
        x, q, tid = r.integers(0, 20, (n, 3)).astype(float), r.integers(0, 20, (m, 3)).astype(float), r.permutation(n)
        query, row, _ = nearest_rows(x, tid, q, np.full(m, np.inf), 5)
        d = squared(q, x)
        want = np.lexsort((np.broadcast_to(tid, d.shape), d), axis=1)[:, :5]
        assert all(row[query == i].tolist() == want[i].tolist() for i in range(m))


@pytest.mark.parametrize("part_rows", [20_000, 50])
def test_knn_sends_k_rows_a_query_and_group(spark, monkeypatch, part_rows):
    """Exact neighbours, also where cells and their queries are dealt into parts."""
    from vigil.ml import neighbors
    monkeypatch.setattr(neighbors, "PART_ROWS", part_rows)
    d = _points(spark, 1500).checkpoint()
    train, test = d.where("id % 5 > 0"), d.where("id % 5 = 0")
    got = {r["id"]: r["prediction"] for r in neighbors.KNN(k=1, pivots=4).fit(train).transform(test).collect()}
    x, y = (np.array([r[c] if c == "label" else r[c].toArray() for r in train.orderBy("id").collect()]) for c in ("features", "label"))
    assert len(got) == 300
    for r in test.collect():
        d2 = ((x - r["features"].toArray()) ** 2).sum(axis=1)
        assert got[r["id"]] in set(y[d2 == d2.min()])


def test_extra_trees_send_a_row_a_node_and_task():
    from vigil.ml.extra_trees import left_sums, node_ranges
    grown = [(np.array([-1]), np.array([np.nan]), np.array([-1]), np.array([-1]))]
    batches = [pa.RecordBatch.from_arrays([pa.array([0.0, 1.0]), pa.array([[float(i), 5.0], [float(-i), 7.0]])], names=["y", "x"]) for i in range(4)]
    ranges = list(node_ranges(iter(batches), grown, {0: [(0, None)]}, 2))
    assert sum(len(b) for b in ranges) == 1 and list(ranges[0].to_pylist()[0].values()) == [0, 0, -3.0, 5.0, 3.0, 7.0]
    sums = list(left_sums(iter(batches), grown, {0: [(0, [(1, 6.0)])]}, 2))
    assert sum(len(b) for b in sums) == 1 and list(sums[0].to_pylist()[0].values()) == [0, 0, 0, 4.0, 0.0]


def test_sampled_shapley_shuffles_no_walk(spark):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from vigil.ml.explain import shapley_importance
    d = _points(spark, 120).withColumn("label", (F.pmod(F.xxhash64("id", F.lit(0)), F.lit(40)) > 20).cast("double")).checkpoint()
    for model in (DecisionTreeClassifier(maxDepth=3).fit(d), LogisticRegression(maxIter=5).fit(d)):
        imp = shapley_importance(model, d, ["a", "b", "c"], n_perm=4, binary=True)
        plan = imp._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
        assert imp.first()["feature"] == "a"


def test_tree_output_is_the_models(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from vigil.ml.tree_shap import tree_output, tree_tables
    d = _points(spark, 300).checkpoint()
    model = DecisionTreeClassifier(maxDepth=4).fit(d)
    rows = model.transform(d).collect()
    got = tree_output(tree_tables(model), np.array([r["features"].toArray() for r in rows]))
    assert got.tolist() == [r["probability"][1] for r in rows]


def test_distinct_vectors_keep_their_partitions(spark):
    from vigil.ml.tree_shap import distinct_vectors
    d = _points(spark, 500)
    rows = distinct_vectors(d.union(d))
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert rows.agg(F.sum("weight")).first()[0] == 1000


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_machines_of_many_vectors_stay_a_table(spark, monkeypatch, task, tmp_path):
    """The same decisions, whether the vectors are held by every task or meet the rows in groups."""
    from vigil.ml import kernel_svm as S
    monkeypatch.setattr(S, "BLOCK_ROWS", 60)
    monkeypatch.setattr(S, "MOST_ROWS", 60)
    monkeypatch.setattr(S, "PART_ROWS", 70)
    d = _points(spark, 300).withColumn("label", F.when(F.lit(task == "regression"), F.col("label") * 1000.0 + F.col("id")).otherwise(F.col("label"))).checkpoint()
    held = S.KernelMachines(task).fit(d)
    want = {r["id"]: r["f"][0] for r in held.decisions(d, "f").collect()}
    parts = {r["id"]: r["prediction"] for r in held.transform(d).collect()}
    monkeypatch.setattr(S, "MOST_VECTORS", 100)
    model = S.KernelMachines(task).fit(d)
    assert model.machines[0][0] is None and model.far.count() == len(held.machines[0][0])
    model.write().overwrite().save(str(tmp_path / "m"))
    for m in (model, S.KernelMachinesModel.read().load(str(tmp_path / "m"))):
        got = {r["id"]: r["f"][0] for r in m.decisions(d, "f").collect()}
        assert got == pytest.approx(want, abs=1e-9)
        out = m.transform(d)
        assert {r["id"]: r["prediction"] for r in out.collect()} == pytest.approx(parts)


@pytest.mark.parametrize("query", ["compare_models", "compare_regression"])
def test_registered_comparisons_fit_the_whole_catalogue(monkeypatch, query):
    from vigil.ml import compare
    from vigil.plans import all_queries, extra_queries, ml_queries
    seen = {}
    monkeypatch.setattr(compare, "compare_models", lambda df, task, models=None, **kw: seen.update(models=models, **kw) or _Dropped())
    monkeypatch.setattr(ml_queries, "_prepared", lambda *a: (None, "classification"))
    monkeypatch.setattr(extra_queries, "_price_regression", lambda *a: (None, "regression"))
    all_queries()[query](None, "")
    assert seen["models"] is None and not seen.get("params") and not seen.get("fast")


class _Dropped:
    def drop(self, *names):
        return self
