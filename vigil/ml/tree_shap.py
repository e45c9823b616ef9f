"""Exact Shapley values of tree models (path-dependent, Lundberg et al. 2018).

A tree is the sum of its leaves, and a leaf's game factors over the features on its path: a feature in the
coalition contributes 1 or 0 (the row follows the path's splits on it or not), one outside it the share of
training rows that does. The Shapley weight k! (d - 1 - k)! / d! is the integral of t^k (1 - t)^(d - 1 - k), so a
leaf gives feature i the integral over t in [0, 1] of a product of d - 1 factors (1 - t) share + t follows, times
(follows - share) and the leaf's value: a polynomial, integrated exactly by Gauss-Legendre nodes. Rows are
explained in Arrow batches against the model's node tables; nothing is sampled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions

CELLS = 2_000_000  # numbers of one array while a batch is explained


@dataclass
class Tree:
    """Nodes of a tree, the root first. A row goes left if its feature is at most the threshold, or, where
    ``categories`` has an entry for the node, one of them; leaves have no feature (-1)."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    categories: dict[int, frozenset]


def tree_tables(model, target_class: int = 1) -> list[Tree]:
    """Node tables of a fitted tree model of Spark ML (read from its saved form), or of this library's extra trees. Leaf
    values sum over the trees to the explained output: the prediction of a regressor, the probability of
    ``target_class`` for a classifier, the margin of class 1 for boosted classifiers."""
    if hasattr(model, "trees_as_tables"):
        return model.trees_as_tables(target_class)
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    single = "treeID" not in data.columns
    rows = data.select(*([F.lit(0).alias("treeID"), "*"] if single else ["treeID", "nodeData.*"])).orderBy("treeID", "id").collect()  # the model itself
    boosted = type(model).__name__.startswith("GBT")
    classes = type(model).__name__.endswith("ClassificationModel") and not boosted
    weights = [1.0] if single else list(model.treeWeights)
    if not boosted and not single:
        weights = [1.0 / len(weights)] * len(weights)
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    out = []
    for t, nodes in sorted(by_tree.items()):
        at = {r["id"]: i for i, r in enumerate(nodes)}
        stats = [np.asarray(r["impurityStats"], float) for r in nodes]
        # class weights for classifiers; (count, sum, sum of squares) otherwise
        cover = np.array([s.sum() if classes else s[0] for s in stats])
        leaf = np.array([r["leftChild"] < 0 for r in nodes])
        value = np.array([(s[target_class] / s.sum() if target_class < len(s) else 0.0) if classes else r["prediction"] for s, r in zip(stats, nodes)])
        split = [r["split"] for r in nodes]
        sets = {i: frozenset(int(c) for c in s["leftCategoriesOrThreshold"]) for i, s in enumerate(split) if not leaf[i] and s["numCategories"] >= 0}
        out.append(Tree(
            feature=np.array([-1 if end else s["featureIndex"] for end, s in zip(leaf, split)]),
            threshold=np.array([np.nan if end or i in sets else s["leftCategoriesOrThreshold"][0] for i, (end, s) in enumerate(zip(leaf, split))]),
            left=np.array([at.get(r["leftChild"], -1) for r in nodes]), right=np.array([at.get(r["rightChild"], -1) for r in nodes]),
            cover=cover, value=value * weights[t], categories=sets))
    return out


def tree_output(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Sum of the trees' leaf values of every row."""
    total = np.zeros(len(x))
    for t in trees:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[t.feature[at[rows]] >= 0]
            node = at[rows]
            v = x[rows, t.feature[node]]
            left = v <= t.threshold[node]
            for n, inside in t.categories.items():
                mine = node == n
                if mine.any():
                    left[mine] = np.isin(v[mine], list(inside))
            at[rows] = np.where(left, t.left[node], t.right[node])
        total += t.value[at]
    return total


class Leaves:
    """The leaves of all trees, grouped by the number of features on their paths."""

    def __init__(self, trees: list[Tree], dim: int):
        self.dim, self.base = dim, 0.0
        paths: dict[int, list] = {}
        for t in trees:
            todo = [(0, {})]
            while todo:
                node, path = todo.pop()
                f = int(t.feature[node])
                if f < 0:
                    share = float(np.prod([p[2] for p in path.values()]))
                    self.base += float(t.value[node]) * share
                    if path:
                        paths.setdefault(len(path), []).append((float(t.value[node]), path))
                    continue
                below = {int(t.left[node]): 0, int(t.right[node]): 1}
                total = sum(float(t.cover[c]) for c in below)
                for child, side in below.items():
                    part = float(t.cover[child]) / total if total > 0 else 0.5
                    lo, hi, share, sets = path.get(f, (-np.inf, np.inf, 1.0, ()))
                    if node in t.categories:
                        sets = (*sets, (t.categories[node], side == 0))
                    elif side:
                        lo = max(lo, float(t.threshold[node]))
                    else:
                        hi = min(hi, float(t.threshold[node]))
                    todo.append((child, {**path, f: (lo, hi, share * part, sets)}))
        self.groups = []
        for k, found in sorted(paths.items()):
            value = np.array([v for v, _ in found])
            feat = np.array([list(p) for _, p in found])
            lo, hi, share = (np.array([[c[i] for c in p.values()] for _, p in found]) for i in range(3))
            sets = {(g, j): c[3] for g, (_, p) in enumerate(found) for j, c in enumerate(p.values()) if c[3]}
            node, weight = np.polynomial.legendre.leggauss((k + 1) // 2)
            self.groups.append((value, feat, lo, hi, share, sets, (node + 1) / 2, weight / 2))

    def explain(self, x: np.ndarray) -> np.ndarray:
        """Shapley values (rows x features)."""
        phi = np.zeros((len(x), self.dim))
        for value, feat, lo, hi, share, sets, node, weight in self.groups:
            n, k = feat.shape
            leaves = max(1, min(n, CELLS // max(1, k * len(node))))
            for a in range(0, n, leaves):
                z = share[a:a + leaves, :, None] * (1 - node)  # factor of a feature that the row does not follow
                spread = np.zeros((min(leaves, n - a) * k, self.dim))
                spread[np.arange(len(spread)), feat[a:a + leaves].ravel()] = 1.0
                rows = max(1, CELLS // z.size)
                for b in range(0, len(x), rows):
                    part = x[b:b + rows]
                    v = part[:, feat[a:a + leaves]]
                    follows = (v > lo[a:a + leaves]) & (v <= hi[a:a + leaves])
                    for (g, j), tests in sets.items():
                        if a <= g < a + leaves:
                            for categories, inside in tests:
                                follows[:, g - a, j] &= np.isin(part[:, feat[g, j]], list(categories)) == inside
                    factor = z + follows[..., None] * node
                    whole = factor.prod(axis=2)
                    # node 0 of the rule lies inside (0, 1): a factor is 0 only if no training row went this way
                    rest = np.divide(whole[:, :, None], factor, out=np.zeros_like(factor), where=factor > 0) @ weight
                    part_phi = value[a:a + leaves, None] * (follows - share[a:a + leaves]) * rest
                    phi[b:b + rows] += part_phi.reshape(len(part), -1) @ spread
        return phi


def _tree_model(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def _leaves(model, data: DataFrame, features: str, target_class: int):
    first = data.select(F.size(vector_to_array(features)).alias("d")).first()
    if first is None:
        return None
    return data.sparkSession.sparkContext.broadcast(Leaves(tree_tables(_tree_model(model), target_class), first["d"]))  # as large as the model


def tree_attributions(model, data: DataFrame, keep: list[str] = (), features: str = "features", target_class: int = 1) -> DataFrame:
    """(``keep`` columns, base, phi array<double>) for every row: base plus the sum of phi is the model's output for the row
    (see ``tree_tables``), base its mean over the training rows that the trees saw."""
    leaves = _leaves(model, data, features, target_class)
    kept = [F.col(f"`{c}`") for c in keep]
    src = data.select(*kept, vector_to_array(features).alias("__x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    schema += (", " if schema else "") + "base double, phi array<double>"
    if leaves is None:
        return data.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = leaves.value
        for b in batches:
            phi = g.explain(_matrix(b.column(b.num_columns - 1), g.dim))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(len(b), g.base)), pa.array(list(phi), pa.list_(pa.float64()))],
                                             names=[*b.schema.names[:-1], "base", "phi"])

    return src.mapInArrow(run, schema)


def distinct_vectors(data: DataFrame, features: str = "features") -> DataFrame:
    """(x, weight): the distinct vectors and how often they occur. Their number of partitions is given, so that few bytes a
    row do not put the work of explaining them into few tasks."""
    sc = data.sparkSession.sparkContext
    parts = max(4 * sc.defaultParallelism, shuffle_partitions(data.sparkSession))
    return data.select(vector_to_array(features).alias("x")).repartition(parts, "x").groupBy("x").agg(F.count(F.lit(1)).alias("weight"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def shapley_trees(model, data: DataFrame, names: list[str], top: int | None = None, features: str = "features",
                  target_class: int = 1) -> DataFrame:
    """Mean |Shapley value| per feature over all rows of ``data`` (equal vectors are explained once and weigh as often as
    they occur), largest first, the first ``top`` if given. Output: feature, importance."""
    leaves = _leaves(model, data, features, target_class)
    if leaves is None:
        return data.sparkSession.createDataFrame([], "feature string, importance double")
    rows = distinct_vectors(data, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, total, n = leaves.value, 0.0, 0
        for b in batches:
            w = b.column(1).to_numpy()
            total, n = total + w @ np.abs(g.explain(_matrix(b.column(0), g.dim))), n + int(w.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.dim)), pa.array(total), pa.array(np.full(g.dim, n))], names=["feat", "s", "n"])

    sums = rows.mapInArrow(run, "feat long, s double, n long").groupBy("feat").agg((F.sum("s") / F.sum("n")).alias("importance"))
    out = sums.select(F.element_at(F.lit(list(names)), (F.col("feat") + 1).cast("int")).alias("feature"), "importance").orderBy(F.desc("importance"), "feature")
    return out if top is None else out.limit(top)
