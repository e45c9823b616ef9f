"""Exact k-nearest neighbours without comparing every test row with every
training row.

Pivot pruning (metric-tree style, triangle inequality):
1. ``P`` pivots (default sqrt(n), between 16 and 1024) are drawn from the training
   rows (seeded hash order; P x d numbers on the driver, bounded by the cap). Every training row goes to the cell of
   its nearest pivot; each cell keeps its radius (largest member distance) and size.
2. For a query q, the nearest cells (by pivot distance) holding at least k members
   are searched exactly first; their k-th smallest distance U bounds the k-th
   neighbour distance.
3. Only cells with d(q, p_c) - r_c <= U can hold a neighbour; the query is joined
   with the members of those cells only, one group a cell (large cells: several), where boxes of near queries are
   held against boxes of near members; the k smallest are kept per query and group.
Exact: no candidate is dropped that could be a neighbour. Distance: Euclidean.
Prediction: majority label (smallest on ties) or mean of the k labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .tables import SideTables


BLOCK_VALUES = 4_000_000
LEAF_ROWS = 64  # rows of a box inside a cell
PART_ROWS = 20_000  # rows of a cell, and queries of it, that one task group holds; larger cells are dealt into parts


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all pivots) of blocks of rows."""
    step = max(1, BLOCK_VALUES // pivots.size)  # rows x pivots x features held at once
    for i in range(0, len(x), step):
        yield i, np.sqrt(((x[i:i + step, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def _nearest_cell(pivots: np.ndarray):
    @F.pandas_udf("cell int, r double")
    def nearest(col: pd.Series) -> pd.DataFrame:
        cell, r = np.zeros(len(col), np.int32), np.zeros(len(col))
        if len(col):
            for i, d in pivot_distances(np.vstack(col.to_numpy()), pivots):
                cell[i:i + len(d)], r[i:i + len(d)] = d.argmin(axis=1), d.min(axis=1)
        return pd.DataFrame({"cell": cell, "r": r})
    return nearest


def leaves_of(x: np.ndarray, most: int = LEAF_ROWS) -> list[np.ndarray]:
    """Row numbers of boxes of at most ``most`` rows, by halving at the median of the widest side."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        wide = np.ptp(x[at], axis=0) if len(at) > most else np.zeros(1)
        if len(at) <= most or not wide.max() > 0:  # equal rows stay in blocks
            out.extend(at[i:i + most] for i in range(0, len(at), most))
            continue
        half = len(at) // 2
        order = np.argpartition(x[at, int(wide.argmax())], half)
        todo += [at[order[half:]], at[order[:half]]]
    return out


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        d = q[:, j, None] - x[None, :, j]
        out += d * d
    return out


def nearest_rows(x: np.ndarray, tid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the at most ``k`` nearest rows of every query within its squared ``bound``, ties to the
    smaller ``tid``. Boxes of queries are held against boxes of rows; only boxes that can hold a neighbour are compared."""
    order = np.argsort(tid, kind="stable")
    leaves = [order[np.sort(at)] for at in leaves_of(x[order])]
    low, high = np.array([x[at].min(axis=0) for at in leaves]), np.array([x[at].max(axis=0) for at in leaves])
    size, found = np.array([len(at) for at in leaves]), []
    for block in leaves_of(q):
        mine = q[block]
        gap = np.maximum(np.maximum(low - mine.max(axis=0), mine.min(axis=0) - high), 0)
        away = (gap * gap).sum(axis=1)
        near = np.argsort(away, kind="stable")
        first = near[:int(np.searchsorted(np.cumsum(size[near]), k)) + 1]
        d = squared(mine, x[np.concatenate([leaves[i] for i in first])])
        most = bound[block]
        if d.shape[1] >= k:
            most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
        most = most * (1 + 1e-9) + 1e-18
        chosen = np.flatnonzero(away <= most.max())
        if not len(chosen):
            continue
        rows = np.concatenate([leaves[i] for i in chosen])
        rows = rows[np.argsort(tid[rows], kind="stable")]
        d = squared(mine, x[rows])
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        d = np.take_along_axis(d, top, axis=1)
        here, at = np.nonzero(d <= most[:, None])
        found.append((block[here], rows[top[here, at]], d[here, at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


class KNN(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    def __init__(self, task: str = "classification", k: int = 5, pivots: int | None = None, seed: int = 42,
                 featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        if not 1 <= k <= 50:
            raise ValueError("k must be within [1, 50]")
        self.task, self.k, self.n_pivots, self.seed = task, k, pivots, seed
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol="prediction")

    def _fit(self, df: DataFrame):
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        fc, lc = self.getFeaturesCol(), self.getLabelCol()
        d = df.select(vector_to_array(fc).alias("x"), F.col(lc).cast("double").alias("y"))
        n = d.count()
        if n < self.k:
            raise ValueError(f"{self.k} neighbours asked of {n} rows")
        n_piv = self.n_pivots or int(min(1024, max(16, n ** 0.5)))
        piv = (d.withColumn("__h", F.xxhash64(F.col("x"), F.lit(self.seed))).orderBy("__h")
               .limit(n_piv).select("x").collect())
        pivots = np.unique(np.array([r["x"] for r in piv], dtype=float), axis=0)
        train = d.withColumn("__d", _nearest_cell(pivots)(F.col("x"))).select("x", "y", "__d.cell", "__d.r")
        train = train.withColumn("tid", F.monotonically_increasing_id()).checkpoint(eager=True)
        cells = train.groupBy("cell").agg(F.max("r").alias("radius"), F.count(F.lit(1)).alias("size")).collect()
        radius = np.full(len(pivots), -np.inf)
        size = np.zeros(len(pivots), dtype=np.int64)
        for r in cells:
            radius[r["cell"]] = r["radius"]
            size[r["cell"]] = r["size"]
        return KNNModel(self.task, self.k, pivots, radius, size, train, fc, self.getPredictionCol())


ASKED = "__qid long, qx array<double>, cell int, bound double"


def _asked(b: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    at = pa.array(at)
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at).cast(pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(bound, pa.float64())],
                                      names=["__qid", "qx", "cell", "bound"])


def _k_nearest(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("__qid").orderBy("d2", "tid")
    return pairs.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


class KNNModel(Model, HasFeaturesCol, HasPredictionCol, SideTables):
    def __init__(self, task, k, pivots, radius, size, train, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self.task, self.k, self.pivots, self.radius, self.size, self.train = task, k, pivots, radius, size, train
        self._set(featuresCol=featuresCol, predictionCol=predictionCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        k = self.k
        radius, size, pivots = self.radius, self.size, self.pivots
        dim, live = pivots.shape[1], size > 0
        q = df.withColumn("__qid", F.monotonically_increasing_id()).checkpoint(eager=True)

        def covering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Nearest cells (by pivot distance) that together hold at least k rows."""
            for b in batches:
                for i, d in pivot_distances(_rows(b.column(1), dim), pivots):
                    d[:, ~live] = np.inf
                    order = np.argsort(d, axis=1, kind="stable")
                    held = np.cumsum(size[order], axis=1)
                    last = np.minimum((held < k).sum(axis=1), int(live.sum()) - 1)
                    at, nth = np.nonzero(np.arange(d.shape[1]) <= last[:, None])
                    yield _asked(b, i + at, order[at, nth], np.full(len(at), np.inf))

        def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Other cells that can hold a row within the bound (triangle inequality)."""
            for b in batches:
                bound = b.column(2).to_numpy()
                seen = [set(c) for c in b.column(3).to_pylist()]
                for i, d in pivot_distances(_rows(b.column(1), dim), pivots):
                    at, cell = np.nonzero(live & (d - np.where(live, radius, 0) <= np.sqrt(bound[i:i + len(d), None]) + 1e-9))
                    new = np.array([c not in seen[i + a] for a, c in zip(at.tolist(), cell.tolist())], bool)
                    yield _asked(b, i + at[new], cell[new], bound[i + at[new]])

        qx = q.select("__qid", vector_to_array(self.getFeaturesCol()).alias("qx"))
        # phase 1: the k nearest among the covering cells -> tight bound per query
        asked = qx.mapInArrow(covering, ASKED).checkpoint(eager=True)
        first = self._searched(asked, k).checkpoint(eager=True)
        bound = first.groupBy("__qid").agg(F.max("d2").alias("bound"))
        cells = asked.groupBy("__qid").agg(F.collect_list("cell").alias("cells"))  # at most k cells a query
        # phase 2: every cell that can hold a row within the bound
        more = qx.join(bound, "__qid").join(cells, "__qid").select("__qid", "qx", "bound", "cells").mapInArrow(reaching, ASKED).checkpoint(eager=True)
        top = _k_nearest(first.unionByName(self._searched(more, k)), k)
        if self.task == "classification":
            votes = top.groupBy("__qid", "y").agg(F.count(F.lit(1)).alias("n"))
            pred = votes.groupBy("__qid").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("__pred"))
        else:
            pred = top.groupBy("__qid").agg(F.avg("y").alias("__pred"))
        return q.join(pred, "__qid", "left").withColumn(self.getPredictionCol(), F.col("__pred")) \
            .drop("__pred", "__qid")

    def _searched(self, asked: DataFrame, k: int) -> DataFrame:
        """The k nearest rows (__qid, tid, y, d2) of every query in the cells it asks for. A large cell is dealt into parts, and so are
        the queries of a cell; each part of the one meets each part of the other."""
        dim = self.pivots.shape[1]
        wanted = np.zeros(len(self.pivots), np.int64)
        for r in asked.groupBy("cell").count().collect():  # a row a pivot
            wanted[r["cell"]] = r["count"]
        parts, shares = (F.lit([max(1, -(-int(n) // PART_ROWS)) for n in v])[F.col("cell")] for v in (self.size, wanted))
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        rows = self.train.select("cell", F.pmod(F.xxhash64("tid"), parts).cast("int").alias("part"), each(shares).alias("share"), "x", "y", "tid")
        queries = asked.select("cell", each(parts).alias("part"), F.pmod(F.xxhash64("__qid"), shares).cast("int").alias("share"), "__qid", "qx", "bound")

        def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
            if not rows.num_rows or not queries.num_rows:
                return pa.table({"__qid": pa.array([], pa.int64()), "tid": pa.array([], pa.int64()), "y": pa.array([], pa.float64()), "d2": pa.array([], pa.float64())})
            rows, queries = rows.combine_chunks(), queries.combine_chunks()
            tid = rows["tid"].to_numpy()
            at, row, d2 = nearest_rows(_rows(rows["x"].combine_chunks(), dim), tid, _rows(queries["qx"].combine_chunks(), dim), queries["bound"].to_numpy(), k)
            return pa.table({"__qid": queries["__qid"].to_numpy()[at], "tid": tid[row], "y": rows["y"].take(pa.array(row)), "d2": d2})

        keys = ["cell", "part", "share"]
        found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "__qid long, tid long, y double, d2 double")
        return _k_nearest(found, k)

    # ---- persistence: the training rows with their cells, and the cells
    def side_tables(self, spark):
        cells = spark.createDataFrame([(i, p.tolist(), float(r), int(n)) for i, (p, r, n) in enumerate(zip(self.pivots, self.radius, self.size))],
                                      "cell int, pivot array<double>, radius double, size long")
        return {"task": self.task, "k": self.k, "features": self.getFeaturesCol(), "prediction": self.getPredictionCol()}, {"train": self.train, "cells": cells}

    @classmethod
    def from_tables(cls, meta, tables):
        cells = tables["cells"].orderBy("cell").collect()  # a row a pivot
        pivots, radius, size = (np.array([r[c] for r in cells]) for c in ("pivot", "radius", "size"))
        return cls(meta["task"], meta["k"], pivots, radius, size, tables["train"], meta["features"], meta["prediction"])
