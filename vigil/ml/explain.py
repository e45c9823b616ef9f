"""E13 learning curves and E14 feature attributions.

Learning curve: folds by ``pmod(xxhash64(key, seed), k)``; nested training subsets
by a second seeded hash (subset f keeps the fold's training rows with u < f, so the
subsets grow into each other). Naive Bayes, linear and ridge regression take all fits from one aggregate
(``sufficient``); of other models every (size, fold) fit runs from a driver thread pool, each fit
distributed. Scores: accuracy (classification) or R2.

Attributions: permutation-sampling Shapley values (Strumbelj & Kononenko 2014). For
each explained row and permutation, a background row is walked towards the row one
feature at a time; the d+1 intermediate vectors of all (row, permutation) pairs are
scored by ONE distributed ``model.transform`` (decision trees: by their node tables, in the task that makes
the walks) and the successive differences are the contributions, summed in that task: no walk is shuffled. All distinct rows are explained, each weighted by its count; permutations and
background rows are the sampling. The work is rows x permutations x (d + 1) model calls.
For linear models the exact value w_j (x_j - E[x_j]) is available too.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .tree_shap import distinct_vectors, tree_output, tree_tables

CLASSIFICATION = "classification"


def learning_curve(data: DataFrame, name: str, task: str, key: str, folds: int = 5, sizes: int = 10, seed: int = 42,
                   params: dict | None = None, fast: bool = True, max_workers: int = 4) -> DataFrame:
    """E13 on prepared rows (``features``, ``label``, key). Output: one row per size:
    fraction, train_rows (mean over folds), train_mean, train_std, val_mean, val_std
    (population std over folds), verdict (from the largest size: train - validation
    > 0.1 overfitting, < -0.05 underfitting, else balanced)."""
    from .compare import _score, predictions
    from .models import canonical, make_estimator
    from .sufficient import MODELS, fold_scores
    if canonical(name) in MODELS and (task == CLASSIFICATION) == (canonical(name) == "naive_bayes"):
        fractions = [round(float(f), 6) for f in np.linspace(0.1, 1.0, sizes)]
        res = [(fractions[size], *rest) for size, *rest in fold_scores(data, canonical(name), key, folds, fractions, seed, params)]
        return _curve(data.sparkSession, res)
    d = data.withColumn("__fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds))) \
        .withColumn("__u", (F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003.0))
    fractions = [round(float(f), 6) for f in np.linspace(0.1, 1.0, sizes)]
    primary = "accuracy" if task == CLASSIFICATION else "r2"

    classes = {}

    def run(job):
        frac, k = job
        in_tr = (F.col("__fold") != k) & (F.col("__u") < frac + 1e-12)
        in_va = F.col("__fold") == k
        tr = d.where(in_tr)
        nc = 2
        if task == CLASSIFICATION:
            # classes present in this training subset, from the labels x folds minima
            nc = sum(1 for (_, f), u in classes.items() if f != k and u < frac + 1e-12)
        m = make_estimator(name, task, tr, params, fast, n_classes=nc).fit(tr)
        out = m.transform(d.where(in_tr | in_va).withColumn("__va", in_va))
        if "__va" not in out.columns:
            # a model whose output drops pass-through columns: score each side on its own
            s_tr = _score(predictions(m, tr, None), task)[primary]
            s_va = _score(predictions(m, d.where(in_va), None), task)[primary]
            return frac, k, tr.count(), s_tr, s_va
        # train and validation scores and the train size in one aggregate over both sides
        y, yhat = F.col("label").cast("double"), F.col("prediction").cast("double")
        if task == CLASSIFICATION:
            score = F.avg(F.when(y == yhat, 1.0).otherwise(0.0))
        else:
            vy = F.var_pop(y)
            score = F.when(vy > 0, F.lit(1.0) - F.avg((y - yhat) * (y - yhat)) / vy).otherwise(F.lit(float("nan")))
        r = {row["__va"]: row for row in out.groupBy("__va").agg(F.count(F.lit(1)).alias("n"), score.alias("s")).collect()}
        tr_row, va_row = r.get(False), r.get(True)
        return (frac, k, tr_row["n"] if tr_row else 0, tr_row["s"] if tr_row else None,
                va_row["s"] if va_row else None)

    jobs = [(f, k) for f in fractions for k in range(folds)]
    d = d.persist(StorageLevel.MEMORY_AND_DISK)  # read by every one of the size x fold fits
    try:
        if task == CLASSIFICATION:
            # one row per (class, fold): bounded by the number of classes
            classes.update({(r["label"], r["__fold"]): r["u"] for r in
                            d.groupBy("label", "__fold").agg(F.min("__u").alias("u")).collect()})
        with ThreadPoolExecutor(max_workers=max_workers) as ex:
            res = list(ex.map(run, jobs))
    finally:
        d.unpersist()
    return _curve(data.sparkSession, res)


def _curve(spark, res: list[tuple]) -> DataFrame:
    pdf = pd.DataFrame(res, columns=["fraction", "fold", "n", "train", "val"]).astype({"train": float, "val": float})
    g = pdf.groupby("fraction")
    out = pd.DataFrame({"fraction": g["n"].mean().index, "train_rows": g["n"].mean().values,
                        "train_mean": g["train"].mean().values, "train_std": g["train"].std(ddof=0).values,
                        "val_mean": g["val"].mean().values, "val_std": g["val"].std(ddof=0).values})
    gap = out["train_mean"].iloc[-1] - out["val_mean"].iloc[-1]
    out["verdict"] = "overfitting" if gap > 0.1 else ("underfitting" if gap < -0.05 else "balanced")
    return spark.createDataFrame(out)


def verdict(train_score: float, val_score: float) -> str:
    gap = train_score - val_score
    return "overfitting" if gap > 0.1 else ("underfitting" if gap < -0.05 else "balanced")


def shapley_importance(model, data: DataFrame, names: list[str], n_rows: int | None = None, n_perm: int = 20,
                       n_background: int = 100, top: int | None = None, seed: int = 42, features: str = "features",
                       binary: bool = False) -> DataFrame:
    """Mean |Shapley value| per feature over all rows of ``data`` (a hash sample of ``n_rows`` distinct
    vectors if given), the first ``top`` features if given. ``model`` scores a vector column ``features``;
    for binary classifiers (``binary``) the positive-class probability is explained, otherwise the
    prediction. Equal vectors are explained once and weigh as often as they occur."""
    arr = distinct_vectors(data, features)
    rows = arr if n_rows is None else arr.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(n_rows)
    bg = np.array([r["x"] for r in arr.orderBy(F.xxhash64("x", F.lit(seed + 7)), "x").limit(n_background).collect()], float)
    if not len(bg):
        return data.sparkSession.createDataFrame([], "feature string, importance double")
    dim = bg.shape[1]
    rows = rows.select("x", "weight")
    kind = type(model).__name__
    if kind == "DecisionTreeRegressionModel" or (kind == "DecisionTreeClassificationModel" and binary):
        trees = data.sparkSession.sparkContext.broadcast(tree_tables(model))  # scored where the walks are made

        def scored_walks(batches):
            return _mean_contributions(((perm, weight, tree_output(trees.value, v.reshape(-1, dim)).reshape(v.shape[:3]))
                                        for perm, weight, v in _walks(batches, bg, n_perm, seed)), dim)

        sums = rows.mapInArrow(scored_walks, SUMS)
    else:
        def walked(batches):
            for perm, weight, v in _walks(batches, bg, n_perm, seed):
                feat = np.concatenate([np.full((*perm.shape[:2], 1), -1), perm], axis=2)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(weight, n_perm * (dim + 1))), pa.array(feat.ravel()), flat], names=["weight", "feat", "v"])

        scored = model.transform(rows.mapInArrow(walked, "weight long, feat long, v array<double>").withColumn(features, array_to_vector("v")))
        f = vector_to_array("probability")[1] if binary and "probability" in scored.columns else F.col("prediction").cast("double")
        # scoring keeps the order of a task's rows, so the steps of a walk still follow each other
        sums = scored.select("weight", "feat", f.alias("f")).mapInArrow(lambda batches: _mean_contributions(_regrouped(batches, n_perm, dim), dim), SUMS)
    imp = sums.groupBy("feat").agg((F.sum("s") / F.sum("n")).alias("importance"))
    name_map = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    out = imp.select(name_map[F.col("feat")].alias("feature"), "importance").orderBy(F.desc("importance"), "feature")
    return out if top is None else out.limit(top)


SUMS = "feat long, s double, n long"
WALK_VALUES = 2_000_000  # numbers of the walks made at once


def _walks(batches, bg: np.ndarray, n_perm: int, seed: int):
    """(features in the order they change, weights, vectors) of blocks of rows: rows x permutations x (d + 1) steps."""
    dim = bg.shape[1]
    step = max(1, WALK_VALUES // (n_perm * (dim + 1) * dim))
    for b in batches:
        whole, weights = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), dim), b.column(1).to_numpy()
        for i in range(0, len(b), step):
            x = whole[i:i + step]
            perm, start = np.zeros((len(x), n_perm, dim), np.int64), np.zeros((len(x), n_perm), np.int64)
            for k, row in enumerate(x):
                # drawn by the vector itself, so equal draws on every run
                rng = np.random.default_rng([seed, int(hashlib.md5(row.tobytes()).hexdigest()[:15], 16)])
                for p in range(n_perm):
                    perm[k, p] = rng.permutation(dim)
                    start[k, p] = rng.integers(len(bg))
            changed = np.argsort(perm, axis=2)[:, :, None, :] < np.arange(dim + 1)[:, None]
            yield perm, weights[i:i + step], np.where(changed, x[:, None, None, :], bg[start][:, :, None, :])


def _regrouped(batches, n_perm: int, dim: int):
    """Scored steps as (features, weights, scores) of whole rows; the steps of a row may lie in two batches."""
    size, rest = n_perm * (dim + 1), []
    for b in batches:
        rest.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        if sum(len(r[0]) for r in rest) < size:
            continue
        weight, feat, f = (np.concatenate([r[i] for r in rest]) for i in range(3))
        end = len(f) // size * size
        rest = [[weight[end:], feat[end:], f[end:]]]
        yield feat[:end].reshape(-1, n_perm, dim + 1)[:, :, 1:], weight[:end:size], f[:end].reshape(-1, n_perm, dim + 1)
    if any(len(r[0]) for r in rest):
        raise ValueError("the steps of a walk were parted")


def _mean_contributions(scored, dim: int):
    """Weighted sums of a task's |mean contribution| of every feature: a row a feature."""
    total, n = np.zeros(dim), 0
    for perm, weight, f in scored:
        c = np.zeros(perm.shape)
        np.put_along_axis(c, perm, np.diff(f, axis=2), axis=2)
        total += weight @ np.abs(c.mean(axis=1))
        n += int(weight.sum())
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total), pa.array(np.full(dim, n))], names=["feat", "s", "n"])


def shapley_linear(coefficients: list[float], names: list[str], data: DataFrame, features: str = "features",
                   top: int | None = None) -> DataFrame:
    """E14, exact for linear models: phi_j = w_j (x_j - mean_j); importance =
    |w_j| * mean |x_j - mean_j| over the rows."""
    x = vector_to_array(features)
    d = len(coefficients)
    means = data.agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(d)]).first()
    agg = data.agg(*[F.avg(F.abs(x[i] - F.lit(means[f"m{i}"]))).alias(f"a{i}") for i in range(d)]).first()
    rows = [(names[i], abs(float(coefficients[i])) * float(agg[f"a{i}"])) for i in range(d)]
    rows.sort(key=lambda t: (-t[1], t[0]))
    return data.sparkSession.createDataFrame(rows[:top], "feature string, importance double")
