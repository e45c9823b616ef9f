"""Fitting and comparing models.

The preprocessing pipeline is fitted once on the train rows and its output is
persisted, so N model fits read one prepared table; fits run concurrently from a
driver thread pool (each fit is itself a distributed Spark job).
"""

from __future__ import annotations

import time
import traceback
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.evaluate import classification_metrics, regression_metrics
from ..session import ensure_checkpoint_dir
from .features import build_preprocessor
from .models import CLASSIFICATION, CLASSIFIERS, REGRESSION, REGRESSORS, canonical, make_estimator

RESULT_SCHEMA = ("position int, model string, task string, status string, error string, fit_seconds double, "
                 "accuracy double, f1_weighted double, precision_weighted double, recall_weighted double, "
                 "r2 double, rmse double, mse double, cv_score double")


def predictions(fitted, data: DataFrame, key: str | None = "key", label: str = "label") -> DataFrame:
    """(key, label, prediction, probability) from a fitted model's output; the
    probability is the positive-class column when the model has one (binary)."""
    out = fitted.transform(data)
    cols = [F.col(key)] if key and key in out.columns else []
    cols += [F.col(label).alias("label"), F.col("prediction").cast("double").alias("prediction")]
    if "probability" in out.columns:
        arr = vector_to_array(F.col("probability"))
        cols.append(F.when(F.size(arr) == 2, arr[1]).alias("probability"))
    else:
        cols.append(F.lit(None).cast("double").alias("probability"))
    return out.select(*cols)


def n_classes(df: DataFrame, label: str = "label") -> int:
    return df.select(label).distinct().count()


def prepare_features(df: DataFrame, target_col: str = "label", scale: bool = True, target_encoding: bool = True,
                     split_col: str = "split"):
    """Fit the F4 preprocessor on train rows, transform every row; returns
    (PipelineModel, transformed DataFrame, routing). The split rows and the transformed ones are
    checkpointed: every stage and every pass of a model reads them, not the split and the joins again."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    pipe, routing = build_preprocessor(df.drop(split_col), target_col, scale, target_encoding)
    train = df.where(F.col(split_col) == "train")
    pre = pipe.fit(train)
    out = pre.transform(df)
    stage_cols = [c for c in out.columns if c.startswith("__")]  # inputs of the assembled vector
    return pre, out.drop(*stage_cols).checkpoint(eager=True), routing


def fit_model(df: DataFrame, name: str, task: str, params: dict | None = None, fast: bool = False,
              scale: bool = True, target_encoding: bool = True, key: str | None = None, split_col: str = "split"):
    """Preprocessing + one model fitted on the train rows; returns
    (PipelineModel, predictions on the test rows)."""
    pre, data, _ = prepare_features(df, "label", scale, target_encoding, split_col)
    model, pred = fit_prepared(data, name, task, params, fast, key, split_col)
    return PipelineModel(stages=list(pre.stages) + [model]), pred


def fit_prepared(data: DataFrame, name: str, task: str, params: dict | None = None, fast: bool = False, key: str | None = None,
                 split_col: str = "split"):
    """One model fitted on the train rows of ``prepare_features``; returns (model, predictions on the test rows)."""
    train = data.where(F.col(split_col) == "train")
    test = data.where(F.col(split_col) == "test")
    est = make_estimator(name, task, train, params, fast, n_classes=n_classes(train) if task == CLASSIFICATION else 2)
    model = est.fit(train)
    return model, predictions(model, test, key)


def _score(pred: DataFrame, task: str) -> dict:
    if task == CLASSIFICATION:
        r = classification_metrics(pred).first()
        return {k: r[k] for k in ("accuracy", "f1_weighted", "precision_weighted", "recall_weighted")}
    r = regression_metrics(pred).first()
    return {"r2": r["r2"], "rmse": r["rmse"], "mse": r["mse"]}


def cross_val(data: DataFrame, name: str, task: str, key: str, folds: int = 5, seed: int = 42, params=None,
              fast: bool = False) -> float:
    """Mean k-fold score (accuracy / R2) of a model on prepared rows
    (``features``, ``label``). Fold = pmod(xxhash64(key, seed), k): fixed under
    repartitioning. Naive Bayes, linear and ridge regression take all folds from one aggregate
    (``sufficient``), the k fits of other models run concurrently."""
    if not 3 <= folds <= 10:
        raise ValueError("folds must be within [3, 10]")
    from .sufficient import MODELS, fold_scores
    if canonical(name) in MODELS and (task == CLASSIFICATION) == (canonical(name) == "naive_bayes"):
        scores = [va for *_, va in fold_scores(data, canonical(name), key, folds, [1.0], seed, params) if va is not None]
        return float(sum(scores) / len(scores))
    d = data.withColumn("__fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)))

    folds_of = {}

    def one(k):
        tr, va = d.where(F.col("__fold") != k), d.where(F.col("__fold") == k)
        # classes of the k-1 training folds, from the (class, fold) table
        nc = len({c for c, f in folds_of if f != k}) if task == CLASSIFICATION else 2
        m = make_estimator(name, task, tr, params, fast, n_classes=nc).fit(tr)
        s = _score(predictions(m, va, None), task)
        return s["accuracy"] if task == CLASSIFICATION else s["r2"]

    d = d.persist(StorageLevel.MEMORY_AND_DISK)  # read by all k fits
    try:
        if task == CLASSIFICATION:
            # one row per (class, fold): bounded by the number of classes
            folds_of.update({(r["label"], r["__fold"]): True for r in d.select("label", "__fold").distinct().collect()})
        with ThreadPoolExecutor(max_workers=min(folds, 4)) as ex:
            scores = list(ex.map(one, range(folds)))
    finally:
        d.unpersist()
    return float(sum(scores) / len(scores))


def compare_models(df: DataFrame, task: str, models: list[str] | None = None, fast: bool = False,
                   cv: int | None = None, key: str | None = None, scale: bool = True, target_encoding: bool = True,
                   params: dict | None = None, split_col: str = "split", max_workers: int = 4,
                   decimals: int = 4) -> DataFrame:
    """Fit every model on the train rows, score the test rows; one row per
    model with metrics (4 decimals), fit time, status and error text; sorted by
    accuracy (classification) or R2 (regression), best first. Failures are rows too."""
    spark = df.sparkSession
    names = models or (CLASSIFIERS if task == CLASSIFICATION else REGRESSORS)
    pre, data, _ = prepare_features(df, "label", scale, target_encoding, split_col)
    cols = ["features", "label", split_col] + ([key] if key else [])
    data = data.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    train = data.where(F.col(split_col) == "train")
    test = data.where(F.col(split_col) == "test")
    k = n_classes(train) if task == CLASSIFICATION else 2

    def run(item):
        pos, name = item
        t0 = time.time()
        try:
            est = make_estimator(name, task, train, (params or {}).get(name), fast, n_classes=k)
            m = est.fit(train)
            secs = time.time() - t0
            s = _score(predictions(m, test, None), task)
            cvs = cross_val(train, name, task, key, cv, params=(params or {}).get(name), fast=fast) if cv and key else None
            return (pos, canonical(name), task, "success", None, secs, s.get("accuracy"), s.get("f1_weighted"),
                    s.get("precision_weighted"), s.get("recall_weighted"), s.get("r2"), s.get("rmse"), s.get("mse"), cvs)
        except Exception as exc:  # noqa: BLE001 - a failed model is reported, the others go on
            msg = f"{type(exc).__name__}: {exc}".splitlines()[0][:500]
            return (pos, name, task, "error", msg, time.time() - t0, None, None, None, None, None, None, None, None)

    try:
        with ThreadPoolExecutor(max_workers=max_workers) as ex:
            rows = list(ex.map(run, enumerate(names)))
    finally:
        data.unpersist()
    res = spark.createDataFrame(rows, RESULT_SCHEMA)
    metric_cols = ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "r2", "rmse", "mse", "cv_score",
                   "fit_seconds"]
    res = res.select(*[F.round(c, decimals).alias(c) if c in metric_cols else F.col(c) for c in res.columns])
    primary = "accuracy" if task == CLASSIFICATION else "r2"
    return res.orderBy(F.desc_nulls_last(primary), F.asc("position"))


def best_model(results: DataFrame, task: str) -> DataFrame:
    """The successful model with the highest primary metric; the first one in
    catalogue order wins a tie."""
    primary = "accuracy" if task == CLASSIFICATION else "r2"
    ok = results.where((F.col("status") == "success") & F.col(primary).isNotNull())
    return ok.agg(F.min_by("model", F.struct(-F.col(primary), F.col("position"))).alias("model"),
                  F.max(primary).alias(primary))


def feature_importance(model, names: list[str], top: int | None = None) -> DataFrame:
    """Tree feature importances sorted descending (the first ``top`` if given) with their share
    of the total (%). ``model`` is a fitted tree model or a PipelineModel ending in one."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    if not hasattr(m, "featureImportances"):
        return spark.createDataFrame([], "rank int, feature string, importance double, share_pct double")
    imp = m.featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda t: -t[1])
    total = sum(v for _, v in rows) or 1.0
    out = [(i + 1, n, float(v), float(v / total * 100.0)) for i, (n, v) in enumerate(rows[:top])]
    return spark.createDataFrame(out, "rank int, feature string, importance double, share_pct double")
