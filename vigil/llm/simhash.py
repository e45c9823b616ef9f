"""SimHash near-duplicates linked through a Gray-order hierarchical index.

Distinct fingerprints are range-partitioned by Gray rank (fingerprints that follow each other in
Gray order differ in few bits, so neighbours share long bit patterns). Each range becomes one index:
the sorted fingerprints are cut into groups, a node holds the bits that all its fingerprints share
and that no node above holds already, and a search walks down adding up the differences; a group is
left as soon as the sum passes the limit, and taken whole when its open bits cannot pass it.
The ranges themselves are the leaves of a small index of the same kind, which tells each fingerprint
which ranges it has to visit. A range returns a spanning forest of its links, never its pairs; the
forests are joined by ``connected_components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .components import connected_components

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
SEED = 42
MAX_RANGES = 4096


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())),
                       np.uint64, len(words) - shingle + 1)


def simhash(text: str | None, shingle: int) -> int:
    """64-bit SimHash as a signed long; zero for a text without words."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i:i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray order."""
    r = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class Forest:
    """Union-find over positions, merged in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            self.parent[a], self.parent[b] = ra, rb
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


class GrayIndex:
    """Hierarchy over groups of fingerprints; ``mask``/``pattern`` are the bits each group shares."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray, fan: int = 16):
        # levels[0] are the given leaves; every level above groups `fan` nodes of the one below
        masks, patterns = [mask], [pattern & mask]
        while len(masks[-1]) > 1:
            m, p, cut = masks[-1], patterns[-1], np.arange(0, len(masks[-1]), fan)
            low = np.bitwise_and.reduceat(p | ~m, cut)  # bits that are one in all
            high = np.bitwise_or.reduceat(p, cut)
            shared = np.bitwise_and.reduceat(m, cut) & ~(low ^ high)
            masks.append(shared)
            patterns.append(high & shared)
        self.fan, self.masks, self.patterns = fan, masks, patterns
        self.own = [m & ~np.repeat(up, fan)[:len(m)] for m, up in zip(masks, masks[1:])] + [masks[-1]]
        self.open = [64 - popcount(m) for m in masks]

    @classmethod
    def of(cls, sorted_fps: np.ndarray, fan: int = 16) -> GrayIndex:
        return cls(np.full(len(sorted_fps), FULL), sorted_fps, fan)

    def search(self, queries: np.ndarray, limit: int, whole: bool = True, budget: int = 1 << 21):
        """Yield (query position, leaf position) arrays of leaves within ``limit``; with ``whole`` a
        group that lies within the limit altogether yields its first leaf only."""
        todo = [(len(self.masks) - 1, np.arange(len(queries)), np.zeros(len(queries), np.int64),
                 np.zeros(len(queries), np.int16))]
        while todo:
            level, q, node, acc = todo.pop()
            if len(q) > budget:
                half = len(q) // 2
                todo += [(level, q[half:], node[half:], acc[half:]), (level, q[:half], node[:half], acc[:half])]
                continue
            acc = acc + popcount((queries[q] ^ self.patterns[level][node]) & self.own[level][node])
            keep = acc <= limit
            q, node, acc = q[keep], node[keep], acc[keep]
            if level == 0:
                yield q, node
                continue
            if whole:
                all_in = acc + self.open[level][node] <= limit
                if all_in.any():
                    yield q[all_in], node[all_in] * self.fan ** level
                    q, node, acc = q[~all_in], node[~all_in], acc[~all_in]
            n = len(self.masks[level - 1])
            kids = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            ok = kids < n
            todo.append((level - 1, np.repeat(q, self.fan)[ok], kids[ok], np.repeat(acc, self.fan)[ok]))

    def tight_groups(self, limit: int):
        """(first leaf, leaf) pairs of groups whose leaves are all within ``limit`` of each other."""
        n = len(self.masks[0])
        for level in range(1, len(self.masks)):
            size = self.fan ** level
            tight = np.flatnonzero(self.open[level] <= limit)
            if len(tight):
                leaf = (tight[:, None] * size + np.arange(size)).ravel()
                first = np.repeat(tight * size, size)
                yield first[leaf < n], leaf[leaf < n]


def local_forest(owned: np.ndarray, visiting: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) rows, root <> fingerprint, that span all links between ``visiting`` (which
    holds ``owned``) and ``owned``; arrays of distinct uint64."""
    owned = owned[np.argsort(gray_rank(owned))]
    nodes = np.unique(np.concatenate([owned, visiting]))
    at = np.searchsorted(nodes, owned)
    forest, index = Forest(len(nodes)), GrayIndex.of(owned)
    for a, b in index.tight_groups(limit):
        forest.link(at[a], at[b])
    for i in range(0, len(visiting), 1 << 14):
        part = visiting[i:i + (1 << 14)]
        mine = np.searchsorted(nodes, part)
        for q, leaf in index.search(part, limit):
            forest.link(mine[q], at[leaf])
    root = forest.roots(np.arange(len(nodes)))
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def _signed_rank(x: np.ndarray) -> np.ndarray:
    return (gray_rank(x) ^ np.uint64(1 << 63)).view(np.int64)


def hamming_links(classes: DataFrame, limit: int, per_range: int = 100_000) -> DataFrame:
    """(u, v) edges whose components are those of all pairs of ``classes.fp`` (distinct longs) that
    differ in at most ``limit`` bits."""
    spark = classes.sparkSession

    def ranked(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(_signed_rank(fp.view(np.uint64)))], names=["fp", "rank"])

    ranks = materialize(classes.select("fp").mapInArrow(ranked, "fp long, rank long"), "gray")
    n = ranks.count()
    if n < 2:
        return spark.createDataFrame([], "u long, v long")
    ranges = min(MAX_RANGES, -(-n // per_range))
    cuts = sorted({int(c) for c in ranks.approxQuantile("rank", [i / ranges for i in range(1, ranges)], 0.1 / ranges)}) \
        if ranges > 1 else []
    home = F.lit(0)
    if cuts:
        home = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c <= F.col("rank")))
    placed = ranks.select("fp", home.alias("home"))
    top = placed.groupBy("home").agg(F.expr("bit_and(fp)").alias("low"), F.expr("bit_or(fp)").alias("high")) \
        .orderBy("home").collect()  # one row a range, at most MAX_RANGES
    homes = np.array([r["home"] for r in top])
    low, high = (np.array([r[k] for r in top], np.int64).view(np.uint64) for k in ("low", "high"))
    shared = spark.sparkContext.broadcast((homes, ~(low ^ high), high))

    def route(batches):
        ids, mask, pattern = shared.value
        index = GrayIndex(mask, pattern)
        for b in batches:
            fp, own = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for q, leaf in index.search(fp.view(np.uint64), limit, whole=False):
                yield pa.RecordBatch.from_arrays([pa.array(fp[q]), pa.array(ids[leaf].astype(np.int32)),
                                                  pa.array(ids[leaf] == own[q])], names=["fp", "part", "owned"])

    def link(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        u, v = local_forest(fp[table["owned"].to_numpy(zero_copy_only=False)], fp, limit)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    visits = placed.mapInArrow(route, "fp long, part int, owned boolean")
    return visits.groupBy("part").applyInArrow(link, "u long, v long")


def simhash_components(docs: DataFrame, shingle: int = 3, limit: int = 2, id_col: str = "doc_id",
                       text_col: str = "text", per_range: int = 100_000) -> DataFrame:
    """One row per input row: ``id_col`` (long), ``fingerprint`` (16 hex digits), ``component_id``.

    The fingerprint covers the whole text: A-Z lower-cased, words of ``[^\\x20\\x09-\\x0D]+``, shingles of
    ``shingle`` words with repeats (a shorter text is one shingle; no word: fingerprint zero, linked like
    any other). A bit is one if more than half of the hashes have it. Fingerprints link at ``limit`` or
    fewer differing bits; ``component_id`` is the smallest id reachable over any number of links. Null text
    is a text without words; null ids are kept and never smallest (a component of null ids only has a
    null ``component_id``); repeated rows come back once each; other columns are not read.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    return rows.join(_components(rows, limit, per_range), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(rows: DataFrame, limit: int, per_range: int) -> DataFrame:
    """(fp, root, component_id) of the fingerprints in ``rows``; two components may share their smallest id, not their root."""
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    linked = connected_components(hamming_links(classes, limit, per_range))
    labelled = materialize(classes.join(linked, F.col("fp") == F.col("node"), "left")
                           .select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(least, "root").select("fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2, id_col: str = "doc_id",
                         text_col: str = "text", per_range: int = 100_000) -> DataFrame:
    """``docs`` with one document of each SimHash component: that with the smallest id (of rows of the component that
    share that id, one). Rows with a null id all stay: no id could name the one to keep. Columns stay as they are."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    component = materialize(_components(rows, limit, per_range), "components")
    keep, fp, root, least = fresh(docs.columns, "keep", "fp", "root", "component_id")
    named = rows.join(component, "fp").groupBy(F.col("id").alias(keep)).agg(
        F.count("*").alias("rows"), F.max(F.col("id") == F.col("component_id")).alias("keeps"))
    keepers = materialize(named.where("keeps").select(keep, "rows"), "keepers")
    doc_id = F.col(f"`{id_col}`")
    kept = docs.join(keepers.where("rows = 1"), doc_id == F.col(keep), "left_semi")
    if keepers.where("rows > 1").limit(1).count():  # an id names several rows: each is judged by its own text

        @F.pandas_udf("long")
        def print_of(texts: pd.Series) -> pd.Series:
            return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

        shared = docs.join(keepers.where("rows > 1"), doc_id == F.col(keep), "left_semi").withColumn(fp, print_of(F.col(f"`{text_col}`")))
        shared = shared.join(component.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(least)), fp)
        kept = kept.unionByName(shared.where(doc_id == F.col(least)).dropDuplicates([id_col, root]).drop(fp, root, least))
    return kept.unionByName(docs.where(doc_id.isNull()))
