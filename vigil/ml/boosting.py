"""M9: AdaBoost.

Classification: SAMME (Zhu, Zou, Rosset & Hastie 2009) with depth-1 trees. The rows are turned once into places on a grid
of every feature's values, two bytes a value in blocks that stay cached. A round is one pass over the blocks: a row's
weight follows from the stumps so far, a task sums weights by feature, place and class, and the driver picks the
stump among 31 candidate thresholds a feature of about equal weight (Spark's rule for ``maxBins`` = 32), so no round
writes rows or weights. The grid holds all values of a feature up to ``EXACT`` distinct ones, else ``RANGES`` approximate quantiles
of all rows (their last digits may depend on the partitions). Attributes with categories are compared as numbers.
Regression: AdaBoost.R2 (Drucker 1997) with depth-3 trees, linear loss, weighted median of the rounds. Sample weights
are a DataFrame column (``weightCol``), every round is one distributed tree fit plus aggregates, and the weighted table is
checkpointed every few rounds so the lineage stays short (and a lost executor recomputes from the checkpoint, not from
round one). Departure: R2 fits on weights instead of sklearn's weighted bootstrap resample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..session import ensure_checkpoint_dir
from .tables import SideTables

CHECKPOINT_EVERY = 5
EXACT, RANGES = 10_000, 4096  # places of a feature's grid: its distinct values, or quantiles
BINS = 32
BLOCK = 1 << 16  # rows
FAN_IN = 256


def value_grid(rows: DataFrame, dim: int) -> list[tuple[np.ndarray, bool]]:
    """Per feature the ascending upper ends of its places, and whether each is the only value of its place."""
    x = [F.col("x")[i] for i in range(dim)]
    about = rows.agg(*[F.approx_count_distinct(v).alias(f"n{i}") for i, v in enumerate(x)]).first()
    exact = [about[i] <= EXACT for i in range(dim)]
    steps = F.array(*[F.lit(j / RANGES) for j in range(RANGES + 1)])
    ends = rows.agg(*[(F.collect_set(v) if e else F.percentile_approx(v, steps, 4 * RANGES)).alias(f"e{i}")
                      for i, (v, e) in enumerate(zip(x, exact))]).first()
    out = []
    for found, e in zip(ends, exact):
        found = np.unique(np.array(found, float))
        found = found[~np.isnan(found)]
        out.append((found if len(found) else np.zeros(1), e))
    return out


def blocks_of(rows: DataFrame, grid: list[np.ndarray], classes: list[float]) -> DataFrame:
    """(y, x): class numbers of up to ``BLOCK`` rows and their places, feature by feature, as 16-bit numbers."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block():
            y, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
            return pa.RecordBatch.from_pydict({"y": [y.tobytes()], "x": [x.tobytes()]})

        for b in batches:
            if not len(b):
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            places = [np.minimum(np.searchsorted(e, x[:, f]), len(e) - 1) for f, e in enumerate(grid)]
            held.append((np.searchsorted(classes, b.column(0).to_numpy()).astype(np.uint16), np.stack(places).astype(np.uint16)))
            n += len(b)
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    return rows.mapInArrow(pack, "y binary, x binary")


def weight_sums(blocks: DataFrame, tasks: int, sizes: list[int], k: int, first: float, rounds: list) -> list[np.ndarray]:
    """Per feature the weights of all rows by (place, class). ``rounds``: (feature, place, factors), a row's weight is
    multiplied by ``factors[lies above the place, class]`` of every round."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(m * k) for m in sizes]
        for b in batches:
            for y, x in zip(b.column(0), b.column(1)):
                y = np.frombuffer(y.as_buffer(), np.uint16).astype(np.int64)
                x = np.frombuffer(x.as_buffer(), np.uint16).reshape(len(sizes), -1)
                w = np.full(len(y), first)
                for f, place, factors in rounds:
                    w *= factors.ravel()[(x[f] > place) * k + y]
                for f, t in enumerate(total):
                    t += np.bincount(x[f] * np.int64(k) + y, w, len(t))
        lane = TaskContext.get().partitionId() // FAN_IN
        if any(t.any() for t in total):
            yield pa.RecordBatch.from_pydict({"feature": pa.array(range(len(sizes)), pa.int32()), "lane": pa.array([lane] * len(sizes), pa.int64()),
                                              "sums": [t.tobytes() for t in total]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["sums"])
        return pd.DataFrame({"feature": pdf["feature"].iloc[:1].values, "lane": [pdf["lane"].iloc[0] // FAN_IN], "sums": [total.tobytes()]})

    schema = "feature int, lane long, sums binary"
    parts, lanes = blocks.mapInArrow(sums, schema), -(-tasks // FAN_IN)
    while True:  # a tree of merges: no group holds more than FAN_IN tasks
        parts = parts.groupBy("feature", "lane").applyInPandas(merge, schema)
        if lanes <= 1:
            break
        lanes = -(-lanes // FAN_IN)
    got = {r["feature"]: np.frombuffer(r["sums"]) for r in parts.collect()}  # a grid a feature
    return [got[f].reshape(m, k) for f, m in enumerate(sizes)]


def candidate_cuts(weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` numbers of places after which a cut may lie, about equal weights apart."""
    at = np.flatnonzero(weights > 0)
    if len(at) <= most + 1:
        return at[:-1]
    stride = weights.sum() / (most + 1)
    cuts, target, run = [], stride, 0.0
    for i, w in zip(at, weights[at].tolist()):
        before, run = run, run + w
        if before and abs(before - target) < abs(run - target):
            cuts.append(last)
            target += stride
        last = i
    return np.array(cuts, np.int64)


def best_stump(sums: list[np.ndarray], most: int) -> tuple[int, int, int, int, np.ndarray, np.ndarray] | None:
    """(feature, place, class below, class above, weights below, weights above) with the largest Gini gain, None without any."""
    def gini(c: np.ndarray) -> np.ndarray:
        t = c.sum(axis=-1, keepdims=True)
        return 1.0 - (np.divide(c, t, out=np.zeros_like(c), where=t > 0) ** 2).sum(axis=-1)

    best, top = None, 0.0
    for f, s in enumerate(sums):
        cuts = candidate_cuts(s.sum(axis=1), most)
        if not len(cuts):
            continue
        below = np.cumsum(s, axis=0)[cuts]
        above = np.cumsum(s[::-1], axis=0)[::-1][cuts + 1]
        whole, share = below + above, below.sum(axis=1) / (below + above).sum(axis=1)
        gain = gini(whole) - share * gini(below) - (1 - share) * gini(above)
        i = int(gain.argmax())
        if gain[i] > top:
            top, best = gain[i], (f, int(cuts[i]), int(below[i].argmax()), int(above[i].argmax()), below[i], above[i])
    return best


class AdaBoost(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    def __init__(self, task: str = "classification", n_estimators: int = 50, learning_rate: float = 1.0,
                 seed: int = 42, featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.task, self.n_estimators, self.learning_rate, self.seed = task, n_estimators, learning_rate, seed
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol="prediction")

    def _fit(self, df: DataFrame):
        ensure_checkpoint_dir(df.sparkSession)
        return self._boost_stumps(df) if self.task == "classification" else self._boost_trees(df)

    def _boost_stumps(self, df: DataFrame):
        fc, lc = self.getFeaturesCol(), self.getLabelCol()
        rows = df.select(F.col(lc).cast("double").alias("y"), vector_to_array(fc).alias("x"))
        counts = {r["y"]: (r["n"], r["d"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).collect()}
        if not counts or any(y is None or math.isnan(y) for y in counts):  # a row a class
            raise ValueError("AdaBoost needs rows, and a label in each")
        classes, n, dim = sorted(counts), sum(c for c, _ in counts.values()), max(d for _, d in counts.values())
        k, most = len(classes), min(BINS, n) - 1
        grid = value_grid(rows, dim)
        sizes = [len(e) for e, _ in grid]
        blocks = blocks_of(rows, [e for e, _ in grid], classes).persist(StorageLevel.MEMORY_AND_DISK)  # read by every round
        stumps, alphas, rounds, tasks = [], [], [], blocks.rdd.getNumPartitions()
        try:
            for _ in range(self.n_estimators):
                sums = weight_sums(blocks, tasks, sizes, k, 1.0 / n, rounds)
                found = best_stump(sums, most)
                if found:
                    f, place, low, high, below, above = found
                    ends, exact = grid[f]
                    cut = float((ends[place] + ends[place + 1]) / 2 if exact else ends[place])
                else:  # no cut parts the weights: one class for all
                    below = sums[0].sum(axis=0)
                    above, f, place, cut = np.zeros(k), 0, sizes[0], None
                    low = high = int(below.argmax())
                missed = np.delete(below, low).sum() + np.delete(above, high).sum()
                whole = below.sum() + above.sum()
                err = missed / whole
                stump = (f, cut, classes[low], classes[high]) if low != high else (0, None, classes[low], classes[low])
                if err <= 0 or err >= 1.0 - 1.0 / k:
                    if err <= 0 or not stumps:
                        stumps.append(stump)
                        alphas.append(1.0)
                    break
                alpha = self.learning_rate * (math.log((1 - err) / err) + math.log(k - 1))
                stumps.append(stump)
                alphas.append(alpha)
                grown = math.exp(alpha)
                factors = np.full((2, k), grown)
                factors[0, low] = factors[1, high] = 1.0
                rounds.append((f, place, factors / (whole - missed + grown * missed)))
        finally:
            blocks.unpersist()
        return AdaBoostModel(self.task, [], alphas, fc, classes, stumps)

    def _boost_trees(self, df: DataFrame):
        fc, lc = self.getFeaturesCol(), self.getLabelCol()
        d = df.select(fc, F.col(lc).cast("double").alias(lc))
        n = d.count()
        d = d.withColumn("__w", F.lit(1.0 / n)).checkpoint(eager=True)
        trees, alphas = [], []
        for m in range(self.n_estimators):
            est = DecisionTreeRegressor(maxDepth=3, weightCol="__w", featuresCol=fc, labelCol=lc,
                                        predictionCol="__p", seed=self.seed + m)
            tree = est.fit(d)
            p = tree.transform(d).select(fc, lc, "__w", "__p")
            e = F.abs(F.col("__p") - F.col(lc))
            mx = p.agg(F.max(e)).first()[0] or 0.0
            if mx <= 0:
                trees.append(tree)
                alphas.append(1.0)
                break
            lin = e / F.lit(mx)
            err = p.agg((F.sum(F.col("__w") * lin) / F.sum("__w")).alias("e")).first()["e"]
            if err >= 0.5:
                if not trees:
                    trees.append(tree)
                    alphas.append(1.0)
                break
            beta = err / (1 - err) if err > 0 else 1e-300
            alpha = self.learning_rate * math.log(1.0 / beta)
            new_w = F.col("__w") * F.pow(F.lit(beta), (F.lit(1.0) - lin) * F.lit(self.learning_rate))
            trees.append(tree)
            alphas.append(alpha)
            nd = p.select(fc, lc, new_w.alias("__w"))
            tot = nd.agg(F.sum("__w")).first()[0]
            prev = d
            d = nd.withColumn("__w", F.col("__w") / F.lit(tot))
            if (m + 1) % CHECKPOINT_EVERY == 0:
                d = d.checkpoint(eager=True)      # reliable copy in the shared folder
            else:
                d = d.persist(StorageLevel.MEMORY_AND_DISK)
                d.count()
            prev.unpersist()
        return AdaBoostModel(self.task, trees, alphas, fc)


class AdaBoostModel(Model, HasFeaturesCol, HasPredictionCol, SideTables):
    def __init__(self, task: str, trees: list, alphas: list[float], featuresCol: str = "features",
                 classes: list[float] | None = None, stumps: list[tuple] | None = None):
        """``stumps``: (feature, threshold or None, class up to it, class above it) a round, for classification."""
        super().__init__()
        self.task, self.trees, self.alphas, self.classes = task, trees, alphas, list(classes or [])
        self.stumps = [tuple(s) for s in stumps or []]
        self._set(featuresCol=featuresCol, predictionCol="prediction")

    def _vote(self, df: DataFrame) -> DataFrame:
        """The class with the largest sum of alphas, the smallest one on ties."""
        stumps, alphas, classes = self.stumps, self.alphas, np.array(self.classes)

        @F.pandas_udf(T.DoubleType())
        def vote(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=float)
            x = np.stack(features.to_numpy())
            score = np.zeros((len(x), len(classes)))
            for (f, cut, low, high), alpha in zip(stumps, alphas):
                is_low = np.ones(len(x), bool) if cut is None else x[:, f] <= cut
                score[:, np.searchsorted(classes, low)] += np.where(is_low, alpha, 0.0)
                score[:, np.searchsorted(classes, high)] += np.where(is_low, 0.0, alpha)
            return pd.Series(classes[score.argmax(axis=1)])

        return df.withColumn(self.getPredictionCol(), vote(vector_to_array(self.getFeaturesCol())))

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.stumps:
            return self._vote(df)
        out = df
        names = []
        for i, t in enumerate(self.trees):
            t2 = t.copy()
            t2.setPredictionCol(f"__ab{i}")
            if hasattr(t2, "setProbabilityCol"):
                t2.setProbabilityCol(f"__abp{i}").setRawPredictionCol(f"__abr{i}")
            out = t2.transform(out)
            drop = [c for c in (f"__abp{i}", f"__abr{i}") if c in out.columns]
            out = out.drop(*drop)
            names.append(f"__ab{i}")
        alphas = list(self.alphas)
        if self.task == "classification":
            # argmax over classes of the alpha-weighted votes (smallest class on ties)
            items = []
            for c in self.classes:
                score = sum((F.when(F.col(n) == F.lit(c), F.lit(al)).otherwise(F.lit(0.0)) for n, al in zip(names, alphas)),
                            F.lit(0.0))
                items.append(F.struct(score.alias("s"), F.lit(-c).alias("k")))
            pred = -F.array_max(F.array(*items)).getField("k")
        else:
            a = np.asarray(alphas)

            @F.pandas_udf(T.DoubleType())
            def weighted_median(preds: pd.Series) -> pd.Series:
                x = np.vstack(preds.to_numpy()) if len(preds) else np.zeros((0, len(a)))
                order = np.argsort(x, axis=1)
                cw = np.cumsum(a[order], axis=1)
                idx = (cw >= 0.5 * cw[:, -1:]).argmax(axis=1)
                return pd.Series(x[np.arange(len(x)), order[np.arange(len(x)), idx]])

            pred = weighted_median(F.array(*[F.col(n) for n in names]))
        return out.withColumn(self.getPredictionCol(), pred).drop(*names)

    # ---- persistence: the stumps in the settings, the rounds' trees as models beside them
    def side_tables(self, spark):
        return {"task": self.task, "alphas": [float(a) for a in self.alphas], "classes": self.classes, "features": self.getFeaturesCol(),
                "stumps": [list(s) for s in self.stumps]}, {}

    def side_models(self):
        return {f"tree{i:04d}": t for i, t in enumerate(self.trees)}

    @classmethod
    def from_tables(cls, meta, tables, models=None):
        models = models or {}
        return cls(meta["task"], [models[k] for k in sorted(models)], meta["alphas"], meta["features"], meta["classes"], meta.get("stumps"))
