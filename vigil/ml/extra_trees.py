"""Extremely randomized trees (Geurts, Ernst & Wehenkel 2006), grown level by level.

Every tree sees every row. At a node each feature that varies there draws ONE threshold, uniformly between its least
and largest value in the node; the best of these random cuts (Gini or variance) splits it. A level takes two
aggregates over the rows: the ranges of all features in all open nodes of all trees, then the label statistics left
of the drawn thresholds; a task sums up all its rows before it sends a row a node. Rows find their nodes by walking the trees grown so far, which are as large as the
model; no row is moved, copied or sampled. Draws are hashes of (seed, tree, node, feature), so the trees do not
depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .tables import SideTables
from .tree_shap import Tree

CLASSIFICATION = "classification"


def uniform(*keys) -> np.ndarray:
    """Numbers in [0, 1) fixed by the (broadcast) ``keys``: a chain of splitmix64 steps."""
    z = np.uint64(0)
    with np.errstate(over="ignore"):
        for k in keys:
            z = (z ^ np.asarray(k, np.int64).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


class _Grown:
    """Nodes of one tree as growing lists; leaves have feature -1."""

    def __init__(self, stats: np.ndarray):
        self.feature, self.threshold, self.left, self.right, self.stats = [-1], [np.nan], [-1], [-1], [stats]

    def split(self, node: int, feature: int, threshold: float, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        for side in (left, right):
            self.feature.append(-1)
            self.threshold.append(np.nan)
            self.left.append(-1)
            self.right.append(-1)
            self.stats.append(side)
        a = len(self.feature) - 2
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, a, a + 1
        return a, a + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right)


def walk(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Node (a leaf of what has grown) of every row."""
    feature, threshold, left, right = tree
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while len(rows):
        node = at[rows]
        f = feature[node]
        inner = f >= 0
        rows, node, f = rows[inner], node[inner], f[inner]
        at[rows] = np.where(x[rows, f] <= threshold[node], left[node], right[node])
    return at


def _impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Gini of class counts, or variance of (count, sum, sum of squares), times the count."""
    if classes:
        n = stats.sum(axis=-1)
        return n - np.divide((stats**2).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0)
    n, s, ss = stats[..., 0], stats[..., 1], stats[..., 2]
    return np.maximum(ss - np.divide(s * s, n, out=np.zeros_like(n), where=n > 0), 0)


class ExtraTrees(Estimator):
    def __init__(self, task: str = CLASSIFICATION, n_estimators: int = 100, max_depth: int = 30, max_features: int | None = None,
                 min_samples_split: int = 2, seed: int = 42, featuresCol: str = "features", labelCol: str = "label"):
        """``max_features``: varying features that draw a threshold at a node; by default the root of their number for
        classes, all for numbers."""
        super().__init__()
        self.task, self.trees, self.depth, self.most, self.least, self.seed = task, n_estimators, max_depth, max_features, min_samples_split, seed
        self.features, self.label = featuresCol, labelCol

    def _fit(self, df: DataFrame):
        rows = df.select(F.col(self.label).cast("double").alias("y"), vector_to_array(self.features).alias("x"))
        rows = rows.where(F.col("y").isNotNull() & ~F.isnan("y")).persist(StorageLevel.MEMORY_AND_DISK)  # read twice a level
        try:
            return self._grow(rows)
        finally:
            rows.unpersist()

    def _grow(self, rows: DataFrame):
        first = rows.agg(F.count("*").alias("n"), F.max("y").alias("top"), F.max(F.size("x")).alias("d"), F.avg("y").alias("mean")).first()
        if not first["n"]:
            raise ValueError("no row to learn from")
        dim, classes = first["d"], int(first["top"]) + 1 if self.task == CLASSIFICATION else 0
        shift = 0.0 if classes else first["mean"]  # sums of squares are taken around the mean
        rows = rows.withColumn("y", F.col("y") - F.lit(shift))
        if classes:
            counts = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}  # a row a class
            root = np.array([counts.get(c, 0) for c in range(classes)], float)
        else:
            sums = rows.agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss")).first()
            root = np.array([first["n"], sums["s"], sums["ss"]], float)
        self._tiny = 1e-10 * _impurity(root, classes) / first["n"]  # impurity of a row that counts as none
        most = self.most or (max(1, int(np.sqrt(dim))) if classes else dim)
        trees, importance = [_Grown(root) for _ in range(self.trees)], np.zeros((self.trees, dim))
        open_ = {(t, 0) for t in range(self.trees)} if self._splits(root, classes) else set()
        for _ in range(self.depth):
            if not open_:
                break
            cuts = self._draw(self._ranges(rows, trees, open_, dim), most)
            if not cuts:
                break
            stats = self._left_stats(rows, trees, cuts, classes)
            open_ = set()
            for (t, node), drawn in cuts.items():
                whole, left = trees[t].stats[node], stats[(t, node)]
                gain = _impurity(whole, classes) - _impurity(left, classes) - _impurity(whole - left, classes)
                # cuts that part the rows alike have equal gains: the first one drawn, not the one that rounding favours
                best = int(np.flatnonzero(gain >= gain.max() - 1e-9 * _impurity(whole, classes))[0])
                f, threshold = drawn[best]
                sides = left[best], whole - left[best]
                importance[t, f] += gain[best]
                for child, side in zip(trees[t].split(node, f, threshold, *sides), sides):
                    if self._splits(side, classes):
                        open_.add((t, child))
        total = importance.sum(axis=1, keepdims=True)
        importance = np.divide(importance, total, out=np.zeros_like(importance), where=total > 0).mean(axis=0)
        grown = []
        for t in trees:
            stats = np.array(t.stats)
            if not classes:
                n, s = stats[:, 0], stats[:, 1]
                stats = np.column_stack([n, s + n * shift, stats[:, 2] + 2 * shift * s + n * shift * shift])
            grown.append((*t.arrays(), stats))
        return ExtraTreesModel(self.task, grown, importance / (importance.sum() or 1.0), self.features)

    def _splits(self, stats: np.ndarray, classes: int) -> bool:
        n = stats.sum() if classes else stats[0]
        return n >= max(2, self.least) and _impurity(stats, classes) > self._tiny * n

    def _ranges(self, rows: DataFrame, trees: list[_Grown], open_: set, dim: int) -> dict:
        """Least and largest value of every feature in every open node."""
        shared = rows.sparkSession.sparkContext.broadcast(([t.arrays() for t in trees], _by_tree({k: None for k in open_})))
        names = [f"{side}{i}" for side in ("a", "b") for i in range(dim)]
        found = rows.mapInArrow(lambda batches: node_ranges(batches, *shared.value, dim), "tree long, node long, " + ", ".join(f"{n} double" for n in names))
        ends = [F.min(f"a{i}").alias(f"a{i}") for i in range(dim)] + [F.max(f"b{i}").alias(f"b{i}") for i in range(dim)]
        got = found.groupBy("tree", "node").agg(*ends).collect()  # a row an open node: no more than the model
        return {(r[0], r[1]): (np.array(r[2:2 + dim]), np.array(r[2 + dim:])) for r in got}

    def _draw(self, ranges: dict, most: int) -> dict:
        """Per open node (feature, threshold) of the first ``most`` varying features in hashed order."""
        keys = sorted(ranges)
        if not keys:
            return {}
        low, high = (np.array([ranges[k][i] for k in keys]) for i in (0, 1))
        tree, node = (np.array(v)[:, None] for v in zip(*keys))
        feature = np.arange(low.shape[1])[None]
        varies = high > low
        order = np.argsort(np.where(varies, uniform(self.seed, tree, node, feature, 0), 2.0), axis=1, kind="stable")[:, :most]
        cut = low + uniform(self.seed, tree, node, feature, 1) * (high - low)
        cut = np.where(cut < high, cut, low)
        take = lambda m: np.take_along_axis(m, order, axis=1).tolist()
        return {k: d for k, fs, cs, ok in zip(keys, order.tolist(), take(cut), take(varies)) if (d := [(f, c) for f, c, v in zip(fs, cs, ok) if v])}

    def _left_stats(self, rows: DataFrame, trees: list[_Grown], cuts: dict, classes: int) -> dict:
        """Label statistics of the rows that go left, a row of the array for each threshold of a node."""
        shared = rows.sparkSession.sparkContext.broadcast(([t.arrays() for t in trees], _by_tree(cuts)))
        width = classes or 3
        found = rows.mapInArrow(lambda batches: left_sums(batches, *shared.value, classes),
                                "tree long, node long, cut long, " + ", ".join(f"s{k} double" for k in range(width)))
        got = found.groupBy("tree", "node", "cut").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).collect()
        out = {key: np.zeros((len(drawn), width)) for key, drawn in cuts.items()}
        for r in got:
            out[(r[0], r[1])][r[2]] = r[3:]
        return out


def _by_tree(wanted: dict) -> dict[int, list]:
    """{tree: [(node, what is wanted of it)]}, nodes ascending."""
    out: dict[int, list] = {}
    for (t, node), what in sorted(wanted.items(), key=lambda kv: kv[0]):
        out.setdefault(t, []).append((node, what))
    return out


def _places(tree: tuple[np.ndarray, ...], nodes: np.ndarray) -> np.ndarray:
    """Place of every node of ``tree`` in ``nodes``, -1 for the others; small numbers, which numpy sorts by radix."""
    place = np.full(len(tree[0]), -1, np.int16 if len(nodes) < 2**15 else np.int64)
    place[nodes] = np.arange(len(nodes))
    return place


def node_ranges(batches: Iterator[pa.RecordBatch], grown: list, open_: dict[int, list], dim: int) -> Iterator[pa.RecordBatch]:
    """Ranges of all features in the open nodes that a task has rows of: a row a node, once for all batches."""
    nodes = {t: np.array([n for n, _ in wanted]) for t, wanted in open_.items()}
    places = {t: _places(grown[t], n) for t, n in nodes.items()}
    low = {t: np.full((len(n), dim), np.inf) for t, n in nodes.items()}
    high = {t: np.full((len(n), dim), -np.inf) for t, n in nodes.items()}
    seen = {t: np.zeros(len(n), bool) for t, n in nodes.items()}
    for x, _ in _matrices(batches, dim):
        for t, place in places.items():
            at = place[walk(grown[t], x)]
            mine = np.flatnonzero(at >= 0)
            if not len(mine):
                continue
            order = mine[np.argsort(at[mine], kind="stable")]
            first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
            here, values = at[order][first], x[order]
            low[t][here] = np.minimum(low[t][here], np.minimum.reduceat(values, first, axis=0))
            high[t][here] = np.maximum(high[t][here], np.maximum.reduceat(values, first, axis=0))
            seen[t][here] = True
    for t, n in nodes.items():
        keep = seen[t]
        if keep.any():
            cols = [np.full(int(keep.sum()), t), n[keep], *low[t][keep].T, *high[t][keep].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tree", "node", *[f"{side}{i}" for side in ("a", "b") for i in range(dim)]])


def left_sums(batches: Iterator[pa.RecordBatch], grown: list, cuts: dict[int, list], classes: int) -> Iterator[pa.RecordBatch]:
    """Label statistics left of the drawn thresholds over all rows of a task: a row a threshold that has any, once for all batches."""
    width, drawn = classes or 3, {}
    for t, wanted in cuts.items():
        nodes, deep = np.array([n for n, _ in wanted]), max(len(d) for _, d in wanted)
        feature, threshold = np.zeros((len(wanted), deep), np.int64), np.full((len(wanted), deep), -np.inf)
        for i, (_, d) in enumerate(wanted):
            feature[i, :len(d)], threshold[i, :len(d)] = zip(*d)
        drawn[t] = nodes, _places(grown[t], nodes), feature, threshold, np.zeros((len(wanted), deep, width))
    for x, y in _matrices(batches, None):
        label = np.eye(classes)[y.astype(np.int64)] if classes else np.stack([np.ones_like(y), y, y * y], axis=1)
        for t, (nodes, place, feature, threshold, sums) in drawn.items():
            at = place[walk(grown[t], x)]
            mine = np.flatnonzero(at >= 0)
            node = at[mine].astype(np.int64)
            for c in range(feature.shape[1]):
                goes = x[mine, feature[node, c]] <= threshold[node, c]
                for k in range(width):
                    sums[:, c, k] += np.bincount(node[goes], label[mine[goes], k], len(nodes))
    for t, (nodes, _, _, _, sums) in drawn.items():
        w, c = np.nonzero(sums.sum(axis=2) if classes else sums[..., 0])
        if len(w):
            cols = [np.full(len(w), t), nodes[w], c, *sums[w, c].T]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["tree", "node", "cut", *[f"s{k}" for k in range(width)]])


def _matrices(batches: Iterator[pa.RecordBatch], dim: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if len(b):
            yield b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1), b.column(0).to_numpy()


class ExtraTreesModel(Model, SideTables):
    """Mean of the trees' leaf distributions (classification: ``probability``, ``prediction``) or leaf means."""

    def __init__(self, task: str = CLASSIFICATION, grown: list | None = None, importance: np.ndarray | None = None, features: str = "features"):
        super().__init__()
        self.task, self.grown, self.importance, self.features = task, grown or [], importance, features

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importance)

    def _outputs(self) -> list[np.ndarray]:
        """Leaf values of every tree: class shares, or a column of means."""
        if self.task == CLASSIFICATION:
            return [s / s.sum(axis=1, keepdims=True) for *_, s in self.grown]
        return [s[:, 1:2] / s[:, :1] for *_, s in self.grown]

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(([t[:4] for t in self.grown], self._outputs()))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def score(features):
            import pandas as pd
            trees, values = shared.value
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.stack(features.to_numpy())
            return pd.Series(list(sum(v[walk(t, x)] for t, v in zip(trees, values)) / len(trees)))

        out = df.withColumn("__score", score(vector_to_array(self.features)))
        if self.task == CLASSIFICATION:
            best = F.array_position("__score", F.array_max("__score")) - 1
            return out.withColumns({"probability": array_to_vector("__score"), "prediction": best.cast("double")}).drop("__score")
        return out.withColumn("prediction", F.col("__score")[0]).drop("__score")

    def trees_as_tables(self, target_class: int = 1) -> list[Tree]:
        n, column = len(self.grown), target_class if self.task == CLASSIFICATION else 0
        return [Tree(f, c, a, b, s.sum(axis=1) if self.task == CLASSIFICATION else s[:, 0], v[:, column] / n, {})
                for (f, c, a, b, s), v in zip(self.grown, self._outputs())]

    # ---- persistence: the nodes as a table
    def side_tables(self, spark) -> tuple[dict, dict[str, DataFrame]]:
        rows = [(t, i, int(f[i]), float(c[i]), int(a[i]), int(b[i]), s[i].tolist()) for t, (f, c, a, b, s) in enumerate(self.grown) for i in range(len(f))]
        nodes = spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, stats array<double>")
        return {"task": self.task, "importance": self.importance.tolist(), "features": self.features}, {"nodes": nodes}

    @classmethod
    def from_tables(cls, meta: dict, tables: dict[str, DataFrame]):
        by: dict[int, list] = {}
        for r in tables["nodes"].orderBy("tree", "node").collect():  # the model itself
            by.setdefault(r["tree"], []).append(r)
        grown = [tuple(np.array([r[c] for r in nodes]) for c in ("feature", "threshold", "left", "right", "stats")) for _, nodes in sorted(by.items())]
        return cls(meta["task"], grown, np.array(meta["importance"]), meta["features"])
