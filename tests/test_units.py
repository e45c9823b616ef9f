"""Unit and property tests on hand-made frames (reference defects of SURVEY 2.12 included)."""

import itertools
import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.functions.exprs import strptime_to_spark
from vigil.sources.fixtures import RULES_SCHEMA


def rules(spark, rows):
    return spark.createDataFrame(rows, RULES_SCHEMA)


def test_strptime_translation():
    assert strptime_to_spark("%Y-%m-%d") == "yyyy-M-d"
    assert strptime_to_spark("%d/%m/%Y %H:%M") == "d/M/yyyy H:m"


def test_custom_regex_keeps_case(spark):
    from vigil.operators.rules import detect_anomalies
    df = spark.createDataFrame([(1, "ABc"), (2, "abc")], "k long, code string")
    r = rules(spark, [("code", "texte", "non", None, None, None, "^[A-Z]+", "ignorer")])
    out = {x["row_key"] for x in detect_anomalies(df, r, key="k").collect()}
    assert out == {2}


def test_category_compares_string_form(spark):
    from vigil.operators.rules import detect_anomalies
    df = spark.createDataFrame([(1, 1), (2, 5)], "k long, code int")
    r = rules(spark, [("code", "categorique", "non", "1,2", None, None, None, "ignorer")])
    assert [x["row_key"] for x in detect_anomalies(df, r, key="k").collect()] == [2]


def test_bad_date_bound_raises(spark):
    from vigil.operators.rules import detect_anomalies
    df = spark.createDataFrame([(1, "2020-01-01")], "k long, d string")
    r = rules(spark, [("d", "date", "non", None, "abc", None, None, "ignorer")])
    with pytest.raises(ValueError):
        detect_anomalies(df, r, key="k")


def test_empty_result_has_schema(spark):
    from vigil.operators.rules import ANOMALY_SCHEMA, detect_anomalies
    df = spark.createDataFrame([(1, 5.0)], "k long, x double")
    r = rules(spark, [("x", "numerique", "oui", None, "0", "10", None, "ignorer")])
    out = detect_anomalies(df, r, key="k")
    assert out.count() == 0 and out.schema == ANOMALY_SCHEMA


def test_numeric_text_strict(spark):
    from vigil.operators.rules import detect_anomalies
    df = spark.createDataFrame([(1, "1d"), (2, " 12 "), (3, "1e3"), (4, "inf"), (5, "nan")], "k long, v string")
    r = rules(spark, [("v", "numerique", "non", None, None, None, None, "ignorer")])
    bad = sorted(x["row_key"] for x in detect_anomalies(df, r, key="k").collect())
    assert bad == [1, 5]


def test_rule_validation_and_normalisation(spark):
    from vigil.operators.rules import normalize_rules, validate_rules
    r = rules(spark, [
        ("a", "Numerique ", "YES", None, "1,5", "abc", None, "Imputer_Moyenne"),
        ("b", "bogus", "maybe", "X", None, None, None, "nope"),
        (None, None, None, None, None, None, None, None),
        ("c", "numerique", "non", None, "5", "1", None, "ignorer"),
        ("d", "categorique", "non", "only", None, None, None, "ignorer"),
    ])
    errs = {(x["line"], x["error"]) for x in validate_rules(r).collect()}
    assert (2, "max_not_number") in errs
    assert (3, "invalid_type") in errs and (3, "invalid_required") in errs and (3, "invalid_action") in errs
    assert (4, "empty_column_name") in errs and (4, "missing_type") in errs
    assert (5, "min_not_below_max") in errs
    assert (6, "single_allowed_value") in errs
    n = normalize_rules(r).collect()[0]
    assert (n["Type"], n["Obligatoire"], n["Min"], n["Action_Si_Anomalie"]) == ("numerique", "oui", "1.5", "imputer_moyenne")
    missing = validate_rules(spark.createDataFrame([("a",)], "Colonne string")).collect()
    assert {x["column_name"] for x in missing} >= {"Type", "Min"}


def test_correct_then_detect_leaves_nothing(spark):
    from vigil.operators.correct import apply_rule_actions
    from vigil.operators.rules import detect_anomalies
    df = spark.createDataFrame([(1, -5.0, "x"), (2, 3.0, "ok"), (3, None, "bad!")], "k long, v double, t string")
    r = rules(spark, [("v", "numerique", "non", None, "0", None, None, "mettre_vide"),
                      ("t", "texte", "non", None, None, None, "^[a-z]+$", "supprimer_ligne")])
    fixed, log = apply_rule_actions(df, r, key="k")
    assert detect_anomalies(fixed, r, key="k").count() == 0
    assert fixed.count() == 2 and log.count() == 2


def test_mode_is_smallest_on_ties(spark):
    from vigil.operators.correct import column_modes
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    assert column_modes(df, ["s"]) == {"s": "a"}


def test_exact_quantiles_match_numpy(spark):
    from vigil.functions.ranking import exact_quantiles
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=997), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "x", probs, buckets=7).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(x, p), abs=1e-9)


def test_running_sum_distributed_equals_cumsum(spark):
    from vigil.functions.ranking import running_sum
    pdf = pd.DataFrame({"v": np.arange(500, dtype=float)[::-1], "c": np.arange(500) % 7})
    out = running_sum(spark.createDataFrame(pdf), "v", ["c"], buckets=9).toPandas().sort_values("v")
    assert (out["c_cum"].to_numpy() == np.cumsum(out["c"].to_numpy())).all()


def _kendall_brute(x, y):
    c = d = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        c += s > 0
        d += s < 0
    n0 = len(x) * (len(x) - 1) / 2
    t1 = sum(v * (v - 1) / 2 for v in pd.Series(x).value_counts())
    t2 = sum(v * (v - 1) / 2 for v in pd.Series(y).value_counts())
    return (c - d) / math.sqrt((n0 - t1) * (n0 - t2))


def test_kendall_against_brute_force(spark):
    from vigil.operators.kendall import kendall_tau
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, 120).astype(float)
    y = (x + rng.integers(0, 5, 120)).astype(float)
    got = kendall_tau(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", buckets=3).first()["tau"]
    assert got == pytest.approx(_kendall_brute(x, y), abs=1e-12)


def test_spearman_invariant_under_monotone_map(spark):
    from vigil.operators.bivariate import corr_matrix
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = x + rng.normal(size=200)
    a = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    b = spark.createDataFrame(pd.DataFrame({"x": np.exp(x), "y": y ** 3}))
    ra = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_matrix(a, ["x", "y"], "spearman").collect()}
    rb = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_matrix(b, ["x", "y"], "spearman").collect()}
    assert ra[("x", "y")] == pytest.approx(rb[("x", "y")], abs=1e-12)
    assert -1 <= ra[("x", "y")] <= 1


def test_shapiro_published_example(spark):
    from vigil.operators.normality import shapiro
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = shapiro(spark.createDataFrame(pd.DataFrame({"x": np.array(x, float)})), ["x"]).first()
    assert r["w"] == pytest.approx(0.79, abs=0.005)
    assert r["p_value"] < 0.05 and not r["normal"]


def test_auc_equals_pair_count(spark):
    from vigil.operators.evaluate import roc_auc
    rng = np.random.default_rng(7)
    s = np.round(rng.uniform(size=300), 1)
    y = (rng.uniform(size=300) < s).astype(float)
    pos, neg = s[y == 1], s[y == 0]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(pd.DataFrame({"label": y, "probability": s}))
    assert roc_auc(df).first()["auc"] == pytest.approx(pairs, abs=1e-12)


def test_deciles_tied_numbers(spark):
    from vigil.operators.evaluate import _bin_expr, quantile_edges
    df = spark.createDataFrame(pd.DataFrame({"p": [1.0, 1, 1, 1, 1, 2, 3, 4, 5, 6]}))
    edges = quantile_edges(df, "p")
    got = [r[0] for r in df.select(_bin_expr("p", edges)).collect()]
    assert got == [0, 0, 0, 0, 0, 1, 2, 3, 4, 5]


def test_split_exact_and_stable(spark):
    from vigil.ml.features import split
    df = spark.range(1, 1001).withColumnRenamed("id", "k")
    a = split(df, "k", 0.2)
    b = split(df.repartition(7), "k", 0.2)
    ta = {r["k"] for r in a.where("split = 'test'").collect()}
    tb = {r["k"] for r in b.where("split = 'test'").collect()}
    assert len(ta) == 200 and ta == tb


def test_row_key_follows_file_order(spark):
    from vigil.sources.files import with_row_key
    df = spark.createDataFrame([(c,) for c in "abcdefghij"], "s string").repartition(1)
    got = [r["s"] for r in with_row_key(df).orderBy("row_key").collect()]
    assert got == list("abcdefghij")


def test_bad_lines_csv(spark, tmp_path):
    from vigil.sources.files import scan_delimited
    p = tmp_path / "bad_lines.csv"
    p.write_bytes(b"a;b\n1;x\n2;y;z\n3\n4;caf\xe9\n")
    good, bad = scan_delimited(spark, str(p), sep=";")
    rows = sorted((r["a"], r["b"]) for r in good.collect())
    assert rows == [(1, "x"), (3, None), (4, "caf")]
    assert bad.count() == 1


def test_model_round_trip(spark, tmp_path):
    from vigil.ml.compare import fit_model
    from vigil.ml.features import prepare
    from vigil.sources.files import load_model, save_model
    pdf = pd.DataFrame({"k": range(200), "x": np.linspace(0, 1, 200), "c": ["a", "b"] * 100,
                        "y": (np.linspace(0, 1, 200) > 0.5).astype(int)})
    d, task = prepare(spark.createDataFrame(pdf), "y", key="k", task="classification")
    model, pred = fit_model(d, "logistic_regression", task)
    path = str(tmp_path / "m")
    save_model(model, path)
    again = load_model(path)
    a = model.transform(d).select("prediction").collect()
    b = again.transform(d).select("prediction").collect()
    assert a == b and pred.count() == 40


def test_adaboost_learns_a_step(spark):
    from pyspark.ml.feature import VectorAssembler
    from vigil.ml.boosting import AdaBoost
    pdf = pd.DataFrame({"x": np.linspace(0, 1, 100), "label": (np.linspace(0, 1, 100) > 0.6).astype(float)})
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(pdf))
    m = AdaBoost(n_estimators=3).fit(d)
    acc = m.transform(d).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    # Spark trees cut continuous features at binned candidate thresholds (maxBins), so
    # the cut may sit one point away from 0.6
    assert acc >= 0.98


def test_iforest_flags_the_far_value(spark):
    from vigil.operators.iforest import outliers_iforest
    vals = list(np.random.default_rng(1).normal(size=300)) + [25.0]
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    out = outliers_iforest(df, ["x"], trees=20)
    flagged = [r["value"] for r in out.collect()]
    assert 25.0 in flagged and len(flagged) <= 40


def test_streaming_matches_batch(spark):
    from vigil.operators.rules import detect_anomalies
    from vigil.sources import fixtures as fx
    from vigil.streaming.anomalies import anomaly_counts_by_window, run_to_table
    from conftest import SF_SMALL
    s = fx.events_stream(spark, SF_SMALL)
    counts = run_to_table(spark, anomaly_counts_by_window(s, fx.events_rules(spark), "event_id", "ts"))
    batch = detect_anomalies(fx.table(spark, SF_SMALL, "events"), fx.events_rules(spark), key="event_id")
    assert counts.agg(F.sum("n")).first()[0] == batch.count()


def test_knn_exact_against_brute_force(spark):
    from pyspark.ml.feature import VectorAssembler
    from vigil.ml.neighbors import KNN
    rng = np.random.default_rng(11)
    tr = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300)})
    tr["label"] = (tr["a"] + tr["b"] > 0).astype(float)
    te = pd.DataFrame({"a": rng.normal(size=50), "b": rng.normal(size=50), "qid": range(50)})
    va = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    model = KNN(task="regression", k=5, pivots=8).fit(va.transform(spark.createDataFrame(tr)))
    got = model.transform(va.transform(spark.createDataFrame(te))).select("qid", "prediction").toPandas()
    got = got.sort_values("qid")["prediction"].to_numpy()
    x, q = tr[["a", "b"]].to_numpy(), te[["a", "b"]].to_numpy()
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    want = np.array([tr["label"].to_numpy()[np.argsort(row, kind="stable")[:5]].mean() for row in d])
    assert np.allclose(got, want)


def test_sinks_and_report(spark, tmp_path):
    from vigil.ml.features import split
    from vigil.operators.report import data_section, evaluation_section, write_report
    from vigil.sources import fixtures as fx
    from vigil.sources.files import write_csv, write_split
    from conftest import SF_SMALL
    orders = fx.table(spark, SF_SMALL, "orders")
    write_csv(orders.limit(10), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10
    path = write_split(split(orders, "o_orderkey"), "o status/x:y", str(tmp_path))
    assert path.endswith("o_status_x_y")
    back = spark.read.parquet(path)
    assert back.where("split = 'test'").count() == math.ceil(orders.count() * 0.2)
    tables = {"data": data_section(orders, order_by="o_orderkey"),
              "evaluation": evaluation_section(fx.scored_events(spark, SF_SMALL), "classification")}
    target = write_report(tables, str(tmp_path), title="My report: v1")
    rep = spark.read.parquet(target)
    assert {r["section"] for r in rep.select("section").distinct().collect()} == {"data", "evaluation"}


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_every_catalogue_model_fits(spark, task):
    from vigil.ml.compare import compare_models
    from vigil.ml.features import prepare
    rng = np.random.default_rng(4)
    n = 240
    pdf = pd.DataFrame({"k": range(n), "x1": rng.normal(size=n), "x2": rng.normal(size=n),
                        "c": rng.choice(["a", "b", "c"], size=n)})
    pdf["y"] = (pdf["x1"] + 0.5 * pdf["x2"] > 0).astype(int) if task == "classification" else \
        3.0 * pdf["x1"] - pdf["x2"] + rng.normal(scale=0.1, size=n)
    d, t = prepare(spark.createDataFrame(pdf), "y", key="k", task=task)
    res = compare_models(d, t, fast=True, key="k", params={"random_forest": {"n_estimators": 5},
                                                            "extra_trees": {"n_estimators": 5},
                                                            "gradient_boosting": {"n_estimators": 5},
                                                            "adaboost": {"n_estimators": 3}})
    rows = res.collect()
    failed = [(r["model"], r["error"]) for r in rows if r["status"] != "success"]
    assert not failed
    primary = "accuracy" if task == "classification" else "r2"
    assert max(r[primary] for r in rows) > 0.8


@pytest.mark.parametrize("task,model", [("classification", "logistic_regression"), ("regression", "linear_regression")])
def test_learning_curve_matches_separate_fits(spark, task, model):
    """The fused train/validation scoring equals fitting and scoring every
    (size, fold) cell on its own."""
    from vigil.ml.compare import _score, n_classes, predictions, prepare_features
    from vigil.ml.explain import learning_curve
    from vigil.ml.features import prepare
    from vigil.ml.models import make_estimator
    rng = np.random.default_rng(9)
    n = 300
    pdf = pd.DataFrame({"k": range(n), "x1": rng.normal(size=n), "x2": rng.normal(size=n)})
    pdf["y"] = (pdf["x1"] - pdf["x2"] + rng.normal(scale=0.8, size=n) > 0).astype(int) if task == "classification" \
        else 2.0 * pdf["x1"] + rng.normal(scale=0.5, size=n)
    d, t = prepare(spark.createDataFrame(pdf), "y", key="k", task=task)
    _, data, _ = prepare_features(d)
    data = data.where("split = 'train'")
    got = learning_curve(data, model, t, "k", folds=3, sizes=3).toPandas()
    seed, folds = 42, 3
    dd = data.withColumn("__fold", F.pmod(F.xxhash64(F.col("k"), F.lit(seed)), F.lit(folds))) \
        .withColumn("__u", F.pmod(F.xxhash64(F.col("k"), F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003.0)
    primary = "accuracy" if t == "classification" else "r2"
    for _, row in got.iterrows():
        frac, trs, vas, ns = row["fraction"], [], [], []
        for k in range(folds):
            tr = dd.where((F.col("__fold") != k) & (F.col("__u") < frac + 1e-12))
            va = dd.where(F.col("__fold") == k)
            m = make_estimator(model, t, tr, None, True,
                               n_classes=n_classes(tr) if t == "classification" else 2).fit(tr)
            trs.append(_score(predictions(m, tr, None), t)[primary])
            vas.append(_score(predictions(m, va, None), t)[primary])
            ns.append(tr.count())
        assert row["train_rows"] == pytest.approx(np.mean(ns))
        assert row["train_mean"] == pytest.approx(np.mean(trs), rel=1e-9)
        assert row["val_mean"] == pytest.approx(np.mean(vas), rel=1e-9)
        assert row["val_std"] == pytest.approx(np.std(vas), rel=1e-9, abs=1e-12)
