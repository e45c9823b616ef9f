"""Model catalogue (M1-M14) mapped onto distributed ``pyspark.ml`` estimators.

Parameter mappings (library defaults of the reference's estimators are stated where
the reference passes none):

- random forest: numTrees = n_estimators (100; fast 50), maxDepth None -> 30 (Spark's
  maximum; fast 10), seed 42
- gradient boosting: maxIter 100 (fast 50), maxDepth 3, stepSize 0.1; multi-class
  through OneVsRest (no probability column then)
- logistic regression: L2 with C = 1 -> regParam = 1 / n, no standardisation
- ridge (alpha 1): regParam = alpha * s_y / n, lasso: regParam = alpha, elasticNet
  (alpha 1, l1_ratio 0.5): regParam = a*r + a*(1-r)*s_y, elasticNetParam = a*r/regParam
  (all without standardisation; these reproduce the closed forms)
- decision tree: maxDepth None -> 30 (fast 10), min_samples_split s ->
  minInstancesPerNode = max(1, s // 2)
- extra trees: sqrt (classification) / all (regression) features per split, one random threshold each, every
  tree sees every row (``extra_trees``)
- SVM / SVR: kernel machines solved over all rows through pivots of the kernel matrix (``kernel_svm``)
- Gaussian naive Bayes: NaiveBayes(modelType="gaussian")
- AdaBoost (SAMME / AdaBoost.R2) and k-nearest neighbours are own estimators
  (``boosting``, ``neighbors``).
"""

from __future__ import annotations

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSIFICATION = "classification"
REGRESSION = "regression"
MAX_DEPTH = 30

# Model names as the reference lists them, with the aliases it uses in
# other places (one table, so every name resolves).
MODEL_ALIASES = {
    "random forest": "random_forest", "random_forest": "random_forest",
    "gradient boosting": "gradient_boosting", "gradient_boosting": "gradient_boosting",
    "logistic regression": "logistic_regression", "logistic_regression": "logistic_regression",
    "linear regression": "linear_regression", "linear_regression": "linear_regression",
    "ridge": "ridge", "lasso": "lasso", "elasticnet": "elastic_net", "elastic_net": "elastic_net",
    "decision tree": "decision_tree", "decision_tree": "decision_tree",
    "adaboost": "adaboost", "extra trees": "extra_trees", "extra_trees": "extra_trees",
    "k-nearest neighbors": "knn", "knn": "knn", "svm": "svm", "svr": "svr",
    "naive bayes": "naive_bayes", "naive_bayes": "naive_bayes",
}
CLASSIFIERS = ["random_forest", "gradient_boosting", "logistic_regression", "decision_tree", "adaboost",
               "extra_trees", "knn", "svm", "naive_bayes"]
REGRESSORS = ["random_forest", "gradient_boosting", "linear_regression", "ridge", "lasso", "decision_tree",
              "adaboost", "extra_trees", "knn", "svr"]


def canonical(name: str) -> str:
    key = name.strip().lower()
    if key not in MODEL_ALIASES:
        raise KeyError(f"unknown model {name!r}")
    return MODEL_ALIASES[key]


def _depth(d):
    return MAX_DEPTH if d in (None, 0) else min(int(d), MAX_DEPTH)


def _label_std(train: DataFrame, label: str = "label") -> float:
    return float(train.agg(F.stddev_pop(label)).first()[0] or 1.0)


def make_estimator(name: str, task: str, train: DataFrame, params: dict | None = None, fast: bool = False,
                   features: str = "features", label: str = "label", n_classes: int = 2):
    """An unfitted estimator (or Pipeline of feature map + estimator) for ``name``."""
    name = canonical(name)
    p = dict(params or {})
    cls = task == CLASSIFICATION
    common = {"featuresCol": features, "labelCol": label}
    if name == "random_forest":
        kw = dict(numTrees=int(p.get("n_estimators", 50 if fast else 100)),
                  maxDepth=_depth(p.get("max_depth", 10 if fast else None)), seed=int(p.get("random_state", 42)),
                  cacheNodeIds=True, **common)  # else every level walks every row down all trees from their roots
        return RandomForestClassifier(**kw) if cls else RandomForestRegressor(**kw)
    if name == "extra_trees":
        from .extra_trees import ExtraTrees
        return ExtraTrees(task=task, n_estimators=int(p.get("n_estimators", 50 if fast else 100)),
                          max_depth=_depth(p.get("max_depth", 10 if fast else None)), min_samples_split=int(p.get("min_samples_split", 2)),
                          seed=int(p.get("random_state", 42)), featuresCol=features, labelCol=label)
    if name == "gradient_boosting":
        kw = dict(maxIter=int(p.get("n_estimators", 50 if fast else 100)), maxDepth=_depth(p.get("max_depth", 3)),
                  stepSize=float(p.get("learning_rate", 0.1)), seed=int(p.get("random_state", 42)), **common)
        if not cls:
            return GBTRegressor(**kw)
        gbt = GBTClassifier(**kw)
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt, **common)
    if name == "decision_tree":
        s = int(p.get("min_samples_split", 2))
        kw = dict(maxDepth=_depth(p.get("max_depth", 10 if fast else None)), minInstancesPerNode=max(1, s // 2),
                  seed=int(p.get("random_state", 42)), **common)
        return DecisionTreeClassifier(**kw) if cls else DecisionTreeRegressor(**kw)
    n = train.count()
    if name == "logistic_regression":
        c = float(p.get("C", 1.0))
        return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
                                  maxIter=int(p.get("max_iter", 500 if fast else 1000)), **common)
    if name == "linear_regression":
        return LinearRegression(regParam=0.0, **common)
    if name == "ridge":
        a = float(p.get("alpha", 1.0))
        return LinearRegression(regParam=a * _label_std(train, label) / n, elasticNetParam=0.0, standardization=False,
                                **common)
    if name == "lasso":
        a = float(p.get("alpha", 1.0))
        return LinearRegression(regParam=a, elasticNetParam=1.0, standardization=False,
                                maxIter=int(p.get("max_iter", 500 if fast else 1000)), **common)
    if name == "elastic_net":
        a, r = float(p.get("alpha", 1.0)), float(p.get("l1_ratio", 0.5))
        big_r = a * r + a * (1 - r) * _label_std(train, label)
        return LinearRegression(regParam=big_r, elasticNetParam=(a * r / big_r) if big_r > 0 else 0.0,
                                standardization=False, **common)
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian", **common)
    if name in ("svm", "svr"):
        from .kernel_svm import KernelMachines
        gamma = p.get("gamma")
        return KernelMachines(task=task, c=float(p.get("C", 1.0)), kind=p.get("kernel", "rbf"), gamma=None if gamma in (None, "scale") else float(gamma),
                              degree=int(p.get("degree", 3)), epsilon=float(p.get("epsilon", 0.1)), seed=int(p.get("random_state", 42)),
                              featuresCol=features, labelCol=label)
    if name == "adaboost":
        from .boosting import AdaBoost
        return AdaBoost(task=task, n_estimators=int(p.get("n_estimators", 30 if fast else 50)),
                        learning_rate=float(p.get("learning_rate", 1.0)), seed=int(p.get("random_state", 42)),
                        featuresCol=features, labelCol=label)
    if name == "knn":
        from .neighbors import KNN
        return KNN(task=task, k=int(p.get("n_neighbors", 5)), featuresCol=features, labelCol=label)
    raise KeyError(name)
