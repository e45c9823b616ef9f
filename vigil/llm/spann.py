"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a balanced hierarchical clustering of a bounded sample and are held in memory as a
navigable graph. Every distinct vector is posted to the list of its nearest centroid, and a boundary
vector to further lists whose centroids are nearly as near and not hidden behind a chosen one. A
query walks the graph for the centroids within a distance ratio of its nearest one and reads only
those lists. Equal vectors are one posting, oversized lists are cut into parts, and queries meet
lists in a shuffled join, so no copy group or crowded list lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MAX_LISTS = 4096
SAMPLE_VALUES = 8_000_000  # numbers in the training sample: rows x dimensions
PART_ROWS = 5_000
GROUP_ROWS = 20_000  # postings that are scanned together
SLOTS = 1 << 30


def balanced_clusters(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """About ``lists`` centroids of equally large groups: every group is halved at the median of the
    difference of its distances to two centres."""
    rng = np.random.default_rng(seed)
    groups, size = [np.arange(len(x))], max(1, len(x) / lists)
    done = []
    while groups:
        g = groups.pop()
        if len(g) < 2 or len(g) <= 1.4 * size:
            done.append(g)
            continue
        v = x[g]
        a, b = v[rng.choice(len(g), 2, replace=False)]
        for _ in range(6):
            near_a = v @ (a - b) - (a @ a - b @ b) / 2
            order = np.argsort(-near_a, kind="stable")
            half = len(g) // 2
            a, b = v[order[:half]].mean(0), v[order[half:]].mean(0)
        groups += [g[order[half:]], g[order[:half]]]
    return np.array([x[g].mean(0) for g in done])


class CentroidGraph:
    """Nearest-neighbour graph over centroids, searched best-first for many queries at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.c = centroids
        n = len(centroids)
        self.sq = (centroids ** 2).sum(1)
        degree = min(degree, max(1, n - 1))
        near = np.empty((n, degree + 2), np.int64)
        for i in range(0, n, 512):
            d = self.sq[None] - 2 * centroids[i:i + 512] @ centroids.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i:i + 512, :degree] = np.argsort(d, axis=1)[:, :degree]
        # neighbours in clustering order close a ring: every centroid can be reached
        near[:, degree], near[:, degree + 1] = (np.arange(n) + 1) % n, (np.arange(n) - 1) % n
        self.near = near
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, q: np.ndarray, ratio: float, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the centroids within ``ratio`` of the nearest one found, nearest first, and their
        distances; the walk goes on from every centroid within the ratio, and from the ``least`` best."""
        out = []
        for i in range(0, len(q), 256):
            out += self._walk(q[i:i + 256], ratio, least)
        return out

    def _walk(self, q: np.ndarray, ratio: float, least: int):
        n, m = len(self.c), len(q)
        rows, least = np.arange(m), min(least, n)
        dist = np.full((m, n), np.inf)
        open_ = np.zeros((m, n), bool)
        qq = (q ** 2).sum(1)

        def reach(r, c):
            new = ~np.isfinite(dist[r, c])
            r, c = r[new], c[new]
            d = np.sqrt(np.maximum(qq[r] + self.sq[c] - 2 * np.einsum("ij,ij->i", q[r], self.c[c]), 0))
            dist[r, c], open_[r, c] = d, True

        reach(np.repeat(rows, len(self.entries)), np.tile(self.entries, m))
        while True:
            bound = np.maximum(dist.min(1) * ratio, np.partition(dist, least - 1, axis=1)[:, least - 1])
            r, c = np.nonzero(open_ & (dist <= bound[:, None]))
            if not len(r):
                break
            open_[r, c] = False
            pairs = np.unique(np.repeat(r, self.near.shape[1]) * n + self.near[c].ravel())
            reach(pairs // n, pairs % n)
        out = []
        for d in dist:
            at = np.flatnonzero(d <= np.nanmin(d) * ratio)
            if len(at) < least:
                at = np.argpartition(d, least - 1)[:least]
            at = at[np.isfinite(d[at])]
            at = at[np.lexsort((at, d[at]))]
            out.append((at, d[at]))
        return out

    def posting(self, found: tuple[np.ndarray, np.ndarray], ratio: float, most: int, hide: float = 0.5) -> list[int]:
        """Lists of a vector: its nearest, and up to ``most`` in all within ``ratio`` that no chosen centroid
        hides by being nearer to them than ``hide`` times the vector's distance."""
        ids, d = found
        chosen = [int(ids[0])]
        for j, dj in zip(ids[1:].tolist(), d[1:].tolist()):
            if len(chosen) == most or dj > ratio * d[0]:
                break
            if ((self.c[chosen] - self.c[j]) ** 2).sum(1).min() > (hide * dj) ** 2:
                chosen.append(j)
        return chosen


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components that is not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def number_cells(rows_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(parts, first cell) of every list, and the number of groups. A cell is a part of a list; cells are numbered
    from the largest to the smallest and cell c is in group c % groups, so a group holds no more
    than the average, GROUP_ROWS at most, and one cell of about PART_ROWS."""
    parts = np.maximum(1, -(-rows_of // PART_ROWS))
    order = np.argsort(-rows_of / parts, kind="stable")
    first = np.empty_like(parts)
    first[order] = np.cumsum(parts[order]) - parts[order]
    return parts, first, int(max(1, -(-rows_of.sum() // GROUP_ROWS)))


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
                       list_rows: int = 64, search_ratio: float = 1.15, boundary_ratio: float = 1.1, replicas: int = 4,
                       least_lists: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` that satisfies ``queries`` its ``k`` nearest
    other rows by Euclidean distance, computed in double precision on the original vectors, nearest
    first, ties to the smaller id; all others if there are fewer than ``k``.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with
    a null id or vectors of another length than the most frequent one (ties: the longest). Rows that
    repeat an id and a vector are one row; a query is no candidate of itself, by id. Other columns are
    not read; an empty table gives an empty result.

    The index is fitted on at most ``SAMPLE_VALUES`` numbers: vectors chosen by a hash, about
    ``SAMPLE_VALUES`` / dimension of them; every vector is posted. There are about n / ``list_rows`` lists,
    ``MAX_LISTS`` at most; beyond that, lists grow and are cut into parts of ``PART_ROWS``.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
                         F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = src.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths["w"]
    rows = materialize(src.where(F.size("v") == width).groupBy("id", "v").agg(F.max("asks").alias("asks")), "vectors")
    # equal vectors are one posting that carries its k + 1 smallest ids: no result can need more
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = rows.select("id", "v").withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.select(F.col("ids")[0].alias("cls"), "v", "ids"), "classes")
    n = classes.count()
    lists = max(1, min(MAX_LISTS, n // list_rows))
    slots = int(SLOTS * min(1.0, SAMPLE_VALUES / width / n))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column(0)) for b in batches if len(b)]
        if parts:
            c = balanced_clusters(np.concatenate(parts), lists)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(list(c), pa.list_(pa.float64()))], names=["list", "v"])

    sample = classes.where(F.pmod(F.xxhash64("v"), F.lit(SLOTS)) <= slots).select("v").repartition(1)  # only the sample moves; bounded by SAMPLE_VALUES
    table = materialize(sample.mapInArrow(fit, "list long, v array<double>"), "centroids")
    centroids = np.array([r["v"] for r in table.orderBy("list").collect()])  # MAX_LISTS rows at most
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for b in batches:
            if not len(b):
                continue
            found = g.search(_matrix(b.column(1)), boundary_ratio, 2)
            chosen = [g.posting(f, boundary_ratio, replicas) for f in found]
            at = np.repeat(np.arange(len(b)), [len(c) for c in chosen])
            to = pa.array(np.concatenate(chosen).astype(np.int64))
            yield pa.RecordBatch.from_arrays([to, *(b.column(i).take(pa.array(at)) for i in range(3))], names=["list", "cls", "v", "ids"])

    postings = materialize(classes.select("cls", "v", "ids").mapInArrow(post, "list long, cls long, v array<double>, ids array<long>"), "postings")
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # MAX_LISTS rows at most
    rows_of = np.array([sizes.get(i, 0) for i in range(len(centroids))])
    parts_of, cell_of, groups = number_cells(rows_of)
    stats = spark.sparkContext.broadcast((rows_of, parts_of, cell_of))
    of_list = lambda x: F.get(F.lit([int(v) for v in x]).cast("array<long>"), F.col("list").cast("int"))
    cell = of_list(cell_of) + F.pmod(F.xxhash64("cls"), of_list(parts_of))
    parted = postings.select(cell.alias("cell"), "v", "ids").withColumn("grp", (F.col("cell") % groups).cast("int"))

    # a query vector is searched once, however many query rows share it
    asked = materialize(rows.where("asks").select("id", "v").join(classes.select("cls", "v"), "v").select("id", "cls", "v"), "asked")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, (size, parts, first) = graph.value, stats.value
        for b in batches:
            if not len(b):
                continue
            q, grp, cells = [], [], []
            for i, (ids, d) in enumerate(g.search(_matrix(b.column(1)), search_ratio, least_lists)):
                if size[ids].sum() < 4 * (k + 1):  # too few rows to answer with: read all lists
                    ids = np.arange(len(size))
                ids = ids[size[ids] > 0]
                n = parts[ids]
                cell = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for j in np.unique(cell % groups).tolist():
                    q.append(i)
                    grp.append(j)
                    cells.append(cell[cell % groups == j])
            at = pa.array(np.array(q, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array(cells, pa.list_(pa.int64())), *(b.column(i).take(at) for i in range(2))],
                                             names=["grp", "cells", "cls", "v"])

    probes = asked.groupBy("cls").agg(F.first("v").alias("v")).mapInArrow(probe, "grp int, cells array<long>, cls long, v array<double>")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        asks, near, dist = [], [], []
        if left.num_rows and right.num_rows:
            order = np.argsort(right["cell"].to_numpy(), kind="stable")
            cell, x, ids = right["cell"].to_numpy()[order], _matrix(right["v"])[order], right["ids"].to_pylist()
            for cls, v, mine in zip(left["cls"].to_pylist(), _matrix(left["v"]), left["cells"].to_pylist()):
                a, b = np.searchsorted(cell, mine, "left"), np.searchsorted(cell, mine, "right")
                rows = np.concatenate([np.arange(i, j) for i, j in zip(a, b)])
                if not len(rows):
                    continue
                d = np.sqrt(((x[rows] - v) ** 2).sum(1))
                most = (k + 1) * replicas  # a vector may stand in that many lists
                least = np.partition(d, most - 1)[most - 1] if len(d) > most else d.max()
                best = np.flatnonzero(d <= least)  # with ties
                pairs = {i: dj for j, dj in zip(best.tolist(), d[best].tolist()) for i in ids[order[rows[j]]]}  # a replica counts once
                found = sorted((dj, i) for i, dj in pairs.items())[:k + 1]
                asks += [cls] * len(found)
                near += [i for _, i in found]
                dist += [dj for dj, _ in found]
        return pa.table({"cls": pa.array(asks, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(dist, pa.float64())})

    hits = probes.groupBy("grp").cogroup(parted.groupBy("grp")).applyInArrow(scan, "cls long, vec_id long, score double")
    hits = hits.groupBy("cls", "vec_id").agg(F.min("score").alias("score"))
    place = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("score", "vec_id"))
    best = hits.withColumn("nth", place("cls")).where(F.col("nth") <= k + 1).drop("nth")
    found = asked.select(F.col("id").alias("query_id"), "cls").join(best, "cls").where("query_id <> vec_id")
    return found.withColumn("rank", place("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
