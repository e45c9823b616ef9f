"""Same answer at every size, order and partitioning; edge values; names with dots or underscores."""

import os
import subprocess
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.sources.fixtures import RULES_SCHEMA

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
INF = float("inf")


def _frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@pytest.mark.parametrize("values", [
    [1.0] * 10 + [INF] * 10, [-INF, -INF, 1.0, 2.0, INF], [-INF, INF], list(range(20)) + [INF] * 20, [5.0], [2.0, 2.0, 2.0], list(np.random.default_rng(0).normal(size=501))])
@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_quantiles_have_one_arithmetic(spark, values, buckets):
    from vigil.functions.ranking import _quantiles_ranked, exact_quantiles
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([(float(v), "g") for v in values], "x double, g string")
    v = np.sort(np.array(values, float))
    want = {}
    for p in probs:
        h = p * (len(v) - 1)
        lo, hi = v[int(np.floor(h))], v[min(int(np.floor(h)) + 1, len(v) - 1)]
        want[p] = float(lo) if lo == hi or h == np.floor(h) else float(lo) + (h - np.floor(h)) * (float(hi) - float(lo))
    counts = df.groupBy("g", "x").agg(F.count("*").alias("cnt"))
    for out in (exact_quantiles(df, "x", probs, buckets=buckets), exact_quantiles(df, "x", probs, ["g"], ["g"], buckets),
                exact_quantiles(df, "x", probs, ["g"], buckets=buckets), _quantiles_ranked(counts, "x", probs, ["g"], None, buckets)):
        assert {r.p: r.q for r in out.collect()} == pytest.approx(want, nan_ok=True)


def test_quantiles_of_groups_and_nulls(spark):
    from vigil.functions.ranking import exact_quantiles
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", 4.0), ("b", 6.0), (None, 9.0)], "g string, x double")
    got = {r.g: r.q for r in exact_quantiles(df, "x", [0.5], ["g"], ["g"]).collect()}
    assert got == {"a": 1.0, "b": 5.0, None: 9.0}
    assert exact_quantiles(df.where("g = 'z'"), "x", [0.5], ["g"], ["g"]).collect() == []


def _shapiro_w(x):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, rs = (m * m).sum(), 1 / np.sqrt(n)
    a = np.empty(n)
    a[-1] = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / np.sqrt(mm)], rs)
    a[-2] = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / np.sqrt(mm)], rs)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[2:-2] = m[2:-2] / np.sqrt(phi)
    a[0], a[1] = -a[-1], -a[-2]
    return float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())


@pytest.mark.parametrize("n,ties", [(30, False), (700, True), (6500, True)])
def test_shapiro_reads_every_row(spark, n, ties, monkeypatch):
    import vigil.operators.normality as N
    monkeypatch.setattr(N, "BLOCK", 100)
    x = np.random.default_rng(n).gamma(2.0, size=n)
    x = np.where(np.arange(n) % 3 == 0, 1.0, np.round(x, 1)) if ties else x
    df = _frame(spark, x=x, g=["a", "b"] * (n // 2), c=[7.0] * n)
    r = {k.column_name: k for k in N.shapiro(df, ["x", "c"]).collect()}
    assert r["x"].n == n and r["x"].w == pytest.approx(_shapiro_w(x), abs=1e-9)
    assert (r["x"].p_value is None) == (n > 5000) == (r["x"].normal is None)
    assert r["c"].w == 1.0
    by = {k.g: k.w for k in N.shapiro(df.repartition(5), ["x"], by=["g"]).collect()}
    assert by == {"a": pytest.approx(_shapiro_w(x[::2]), abs=1e-9), "b": pytest.approx(_shapiro_w(x[1::2]), abs=1e-9)}


def test_shapiro_small_groups(spark):
    from vigil.operators.normality import shapiro
    r = {k.column_name: k for k in shapiro(_frame(spark, x=[1.0, 2.0, None, np.nan], y=[1.0, 2.0, 4.0, INF], z=[1.0, 2.0, 3.0, 7.0])).collect()}
    assert r["x"].n == 2 and r["x"].w is None
    assert r["y"].w == pytest.approx(0.9642857, abs=1e-6) and r["z"].p_value > 0.05


def test_indicators_default_call(spark):
    from vigil.operators.profile import indicators
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert indicators(li, ["l_quantity", "l_discount"]).count() == 2


def test_kendall_counts_are_exact_decimals(spark):
    from vigil.operators.kendall import kendall_tau
    r = kendall_tau(_frame(spark, x=[1.0, 2, 3, 3], y=[1.0, 3, 2, 2]), "x", "y")
    assert dict(r.dtypes)["n_concordant"] == "decimal(38,0)"
    assert (int(r.first().n_concordant), int(r.first().n_discordant)) == (3, 2)


def test_linregress_degenerate(spark):
    from vigil.operators.bivariate import linregress
    line = linregress(_frame(spark, x=[1.0, 2, 3, 4], y=[2.0, 4, 6, 8]), "x", "y").first()
    assert line.slope == pytest.approx(2.0) and line.p_value < 1e-6 and line.stderr < 1e-6
    flat = linregress(_frame(spark, x=[1.0, 2, 3], y=[5.0, 5, 5]), "x", "y").first()
    assert (flat.slope, flat.r, flat.p_value) == (0.0, 0.0, pytest.approx(1.0))
    assert np.isnan(linregress(_frame(spark, x=[1.0, 1, 1], y=[5.0, 6, 7]), "x", "y").first().slope)


def test_roc_of_one_class_and_next_points(spark):
    from vigil.operators.evaluate import roc_auc, roc_curve
    one = _frame(spark, label=[1.0, 1.0], probability=[0.2, 0.7])
    assert np.isnan(roc_auc(one).first().auc)
    rng = np.random.default_rng(0)
    s, y = np.round(rng.uniform(size=400), 2), rng.integers(0, 2, 400).astype(float)
    df = _frame(spark, label=y, probability=s)
    every = [(r.threshold, r.fpr, r.tpr) for r in roc_curve(df, drop_intermediate=False).orderBy("idx").collect()]
    kept = [(r.threshold, r.fpr, r.tpr) for r in roc_curve(df).orderBy("idx").collect()]
    cut = sorted(set(s), reverse=True)
    tp = [int(((s == t) & (y == 1)).sum()) for t in cut]
    fp = [int(((s == t) & (y == 0)).sum()) for t in cut]
    stay = [i for i in range(len(cut)) if i in (0, len(cut) - 1) or (tp[i + 1], fp[i + 1]) != (tp[i], fp[i])]
    assert [t for t, _, _ in every[1:]] == cut and [t for t, _, _ in kept[1:]] == [cut[i] for i in stay]


def test_histogram_with_infinities_and_far_values(spark):
    from vigil.operators.profile import MAX_BINS, histogram, histograms
    h = histogram(_frame(spark, x=[1.0, 2.0, 3.0, INF, -INF]), "x", 2).orderBy("bin").collect()
    assert [(r.lo, r.hi, r.n) for r in h] == [(1.0, 2.0, 1), (2.0, 3.0, 2)]
    far = histogram(_frame(spark, x=[float(i % 50) for i in range(2000)] + [1e13]), "x")
    assert far.count() <= MAX_BINS and far.agg(F.sum("n")).first()[0] == 2001
    many = spark.range(10).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(9)])
    assert histograms(many, bins=2).select("column_name").distinct().count() == 9


def test_names_with_dots_and_underscores(spark):
    from vigil.operators.correct import apply_rule_actions
    from vigil.operators.rules import detect_anomalies
    df = spark.createDataFrame([(1, "x", 5, 1.0), (2, "7", 6, 2.0)], "k long, `a.b` string, __mine int, v double")
    blank = {f.name: None for f in RULES_SCHEMA.fields}
    names = [f.name for f in RULES_SCHEMA.fields]
    from vigil.sources.fixtures import dirty_rules
    example = [r.asDict() for r in dirty_rules(spark).collect()]
    num = next(r for r in example if r[names[0]] == "price_txt")
    rules = spark.createDataFrame([tuple(({**blank, **num, names[0]: "a.b"})[n] for n in names)], RULES_SCHEMA)
    assert {r.anomaly for r in detect_anomalies(df, rules, key="k").collect()} >= {"not_numeric"}
    fixed, _ = apply_rule_actions(df, rules, key="k")
    assert fixed.columns == df.columns


def test_missing_overview_of_an_empty_table(spark):
    from vigil.operators.report import preprocessing_section
    from vigil.operators.rules import missing_overview
    empty = spark.createDataFrame([], "a int, b double")
    assert {(r.n_cells, r.n_missing, r.pct_missing) for r in missing_overview(empty).collect()} == {(0, 0, 0.0)}
    assert {r.value for r in preprocessing_section(empty, empty)["summary"].collect()} == {0.0}


def test_split_of_repeated_keys(spark):
    from vigil.ml.features import split
    df = spark.createDataFrame([(i // 5, i) for i in range(300)], "k long, v long")
    a, b = ({(r.k, r.v) for r in split(d, "k", 0.2).where("split = 'test'").collect()} for d in (df.repartition(2), df.repartition(9, "v")))
    assert a == b and len(a) == 60


def test_row_key_of_several_files(spark, tmp_path):
    from vigil.sources.files import with_row_key
    for i, n in enumerate((5, 4000, 50)):
        spark.createDataFrame([(f"{i}-{k:05d}",) for k in range(n)], "s string").coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = with_row_key(spark.read.parquet(*[str(tmp_path / f"f{i}") for i in (2, 0, 1)])).orderBy("row_key").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.row_key for r in got] == list(range(1, 4056)) and [r.s for r in got] == sorted(r.s for r in got)


def test_delimited_text_with_quotes(spark, tmp_path):
    from vigil.sources.files import scan_delimited
    (tmp_path / "a.csv").write_text('a,b\n1,"x,y"\n2,z\n3,q,extra\n4\n"5","say ""hi, you"""\n')
    good, bad = scan_delimited(spark, str(tmp_path / "a.csv"))
    assert sorted((r.a, r.b) for r in good.collect() if r.b) == [(1, "x,y"), (2, "z"), (5, 'say "hi, you"')]
    assert good.count() == 4 and [r.line for r in bad.collect()] == ["3,q,extra"]
    (tmp_path / "b.csv").write_text('a,b\n1,"two\nlines"\n2,z\n')
    assert [r.b for r in scan_delimited(spark, str(tmp_path / "b.csv"), multi_line=True)[0].orderBy("a").collect()] == ["two\nlines", "z"]


def _learnable(spark, n=240):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    return _frame(spark, k=range(n), x1=x[:, 0], x2=x[:, 1], y=3 * x[:, 0] - x[:, 1])


def test_key_is_no_feature(spark):
    from vigil.ml.compare import prepare_features
    from vigil.ml.features import prepare
    d, _ = prepare(_learnable(spark), "y", key="k", task="regression")
    assert prepare_features(d)[2]["numeric"] == ["x1", "x2"]


def test_extra_trees_differ(spark):
    from vigil.ml.compare import fit_model
    from vigil.ml.features import prepare
    d, t = prepare(_learnable(spark), "y", key="k", task="regression")
    model = fit_model(d, "extra_trees", t, {"n_estimators": 6, "max_depth": 4})[0].stages[-1]
    assert len({tuple(np.nan_to_num(thresholds).tolist()) for _, thresholds, *_ in model.grown}) == 6


def test_forest_does_not_depend_on_partitions(spark):
    from vigil.operators.iforest import outliers_iforest
    df = _frame(spark, k=range(3000), x=np.random.default_rng(1).normal(size=3000))
    a, b = (sorted(r.value for r in outliers_iforest(df.repartition(p), ["x"], trees=20).collect()) for p in (2, 7))
    assert a == b and a


def test_shapley_weighs_copies(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from vigil.ml.explain import shapley_importance, shapley_linear
    d = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(_learnable(spark, 40)).withColumn("label", F.col("y"))
    model = LinearRegression().fit(d)
    one = {r.feature: r.importance for r in shapley_importance(model, d, ["x1", "x2"], n_perm=6).collect()}
    four = {r.feature: r.importance for r in shapley_importance(model, d.union(d).union(d).union(d), ["x1", "x2"], n_perm=6).collect()}
    assert four == pytest.approx(one) and len(one) == 2
    exact = {r.feature: r.importance for r in shapley_linear(model.coefficients.toArray().tolist(), ["x1", "x2"], d).collect()}
    assert one["x1"] == pytest.approx(exact["x1"], rel=0.3)


def test_qq_with_a_hot_residual(spark):
    from vigil.operators.evaluate import qq_table
    y = [0.0] * 30 + [1.0, -2.0, 5.0]
    t = qq_table(_frame(spark, label=y, prediction=[0.0] * 33)).orderBy("i").collect()
    assert [r.i for r in t] == list(range(1, 34)) and [r.ordered for r in t] == sorted(y)


def test_contingency_of_many_levels(spark):
    import vigil.operators.bivariate as B
    df = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") % 15_000).alias("b"))
    assert B.contingency(df, "a", "b", zeros=False).count() == 20_000
    with pytest.raises(ValueError):
        B.contingency(df, "a", "b")


def test_selections(spark):
    from vigil.operators.frame import drop_columns, drop_missing_rows, preview, sample_rows, split_xy
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan"))], "k long, `v.x` double")
    x, y = split_xy(df, "v.x")
    assert x.columns == ["k"] and y.columns == ["v.x"]
    kept, log = drop_missing_rows(df)
    assert kept.count() == 1 and tuple(log.first()) == (3, 1, 2)
    kept, log = drop_columns(df, ["v.x", "none"])
    assert kept.columns == ["k"] and [tuple(r) for r in log.collect()] == [("v.x", True), ("none", False)]
    assert [r.k for r in preview(df, 2, "k").collect()] == [1, 2]
    big = spark.range(5000)
    a, b = (sorted(r.id for r in sample_rows(big.repartition(p), 0.1, ["id"]).collect()) for p in (1, 6))
    assert a == b and 400 < len(a) < 600


def test_workers_import_the_package(tmp_path):
    """Started from another folder without a search path, Python workers still find the package."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as E
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("rows", E.queries()["linregress"](s, "/root/testdata/sf0.001").count(), len(E.queries()["outliers_iforest"](s, "/root/testdata/sf0.001").take(1)))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1 1" in out.stdout, out.stderr[-2000:]
