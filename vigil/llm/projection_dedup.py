"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are sorted lexicographically by the concatenation of random hyperplane hashes and
compared with the next ones in a bounded window; verified pairs of all passes are united into components.
The number of passes follows from the number of vectors, so that a pair at the threshold is missed by
all of them with a small, stated probability. Links are then counted exactly inside every component,
however crowded: around its mean direction most pairs of a crowded component are decided by the
triangle inequality, and only the blocks between are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

KEY_BITS = 63
RANGE_ROWS = 50_000  # rows of all passes that are sorted together
PASSES_AT_ONCE = 4  # passes that are shuffled in one job
BLOCK_ROWS = 2_000  # vectors of a component that are compared at once
BINS = 16  # steps of the angle to the mean direction, per threshold angle
EDGE = "u long, v long"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as double precision, each scaled by a power of two so that no square overflows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    _, power = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -power[:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at ``threshold`` has met with probability ``recall``: it meets when it shares the
    hashes that leave about ``window`` of ``n`` vectors together."""
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    met = same ** math.ceil(math.log2(max(1.0, n / window)))
    return 1 if met >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-met)))


def hash_keys(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Concatenated signs of ``x`` on the random directions of pass ``number``, first hash first."""
    planes = np.random.default_rng((seed, number)).standard_normal((x.shape[1], KEY_BITS))
    return ((x @ planes) > 0) @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the edges ``u`` - ``v``, for all nodes that are not the smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[at], nodes[label[at]]


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit vectors of ``x`` and ``y`` have a cosine of at least ``threshold``; products too near to it to trust a
    matrix product are taken again as in ``cosines``."""
    dots = x @ y.T
    hit = dots >= threshold
    i, j = np.nonzero(np.abs(dots - threshold) < 1e-9)
    if len(i):
        hit[i, j] = cosines(x[i], y[j]) >= threshold
    return hit


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def window_edges(number: np.ndarray, cls: np.ndarray, x: np.ndarray, window: int, threshold: float, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Components, as stars, of the verified pairs of each row of ``x`` (unit vectors) with the next ``window`` rows of its
    pass; pairs among the first ``old`` rows are left out."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(max(0, old - window), len(cls), window):
        b, end = min(a + window, len(cls)), min(a + 2 * window, len(cls))
        apart = np.arange(a, end)[None] - np.arange(a, b)[:, None]
        able = (apart > 0) & (apart <= window) & (number[a:b, None] == number[None, a:end]) & (np.arange(a, end) >= old)[None]
        i, j = np.nonzero(near(x[a:b], x[a:end], threshold) & able)
        u.append(cls[a + i])
        v.append(cls[a + j])
    return stars(np.concatenate(u), np.concatenate(v))


def _pass_edges(classes: DataFrame, n: int, numbers: range, window: int, threshold: float, seed: int) -> DataFrame:
    """Links (u, v) that unite the verified pairs of the passes ``numbers``, stars of each batch."""
    kind = classes.schema["v"].dataType.simpleString()

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = matrix(b.column(1))
                for p in numbers:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), p, np.int32)), pa.array(hash_keys(x, p, seed)), b.column(0), b.column(1)],
                                                     names=["number", "key", "cls", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, seen = TaskContext.get().partitionId(), None, 0

        def rows(part, at, number, cls, v, to):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(to), part, np.int32)), pa.array(at, pa.int64()), number, cls, v, to],
                                              names=["part", "at", "number", "cls", "v", "to"])

        for b in batches:
            if not len(b):
                continue
            if seen < window:  # the first rows also meet the end of the range before
                head = b.slice(0, window - seen)
                at = np.arange(seen, seen + len(head))
                yield rows(part, at, *head.columns[:1], *head.columns[2:], pa.nulls(len(head), pa.int64()))
            both = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks().to_batches()[0]
            cls = both.column(2).to_numpy()
            u, v = window_edges(both.column(0).to_numpy(), cls, unit(matrix(both.column(3))), window, threshold, len(both) - len(b))
            none = len(u)
            yield rows(part, np.zeros(none, np.int64), pa.nulls(none, pa.int32()), pa.array(u), pa.nulls(none, both.column(3).type), pa.array(v))
            seen += len(b)
            held = both.slice(max(0, len(both) - window))
        if held is not None:
            yield rows(part, np.arange(seen - len(held), seen) - seen, held.column(0), held.column(2), held.column(3), pa.nulls(len(held), pa.int64()))

    ranges = max(1, -(-n * len(numbers) // RANGE_ROWS))
    keyed = classes.select("cls", "v").mapInArrow(key, f"number int, key long, cls long, v {kind}")
    dealt = keyed.repartitionByRange(ranges, "number", "key", "cls").sortWithinPartitions("number", "key", "cls")
    found = materialize(dealt.mapInArrow(compare, f"part int, at long, number int, cls long, v {kind}, to long"), "passes")
    border = found.where("to is null")
    parts = sorted(r["part"] for r in border.select("part").distinct().collect())  # a number a range
    if len(parts) > 1:
        nth = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(parts, range(len(parts))) for x in pair]), F.col("part"))
        meet = border.select(F.when(F.col("at") < 0, nth).otherwise(nth - 1).alias("meet"), "at", "number", "cls", "v")

        def across(t: pa.Table) -> pa.Table:  # at most 2 * window rows
            t = t.take(pa.array(np.argsort(t["at"].to_numpy(), kind="stable")))
            old = int((t["at"].to_numpy() < 0).sum())
            x, number, cls = unit(matrix(t["v"])), t["number"].to_numpy(), t["cls"].to_numpy()
            u, v = window_edges(number, cls, x, window, threshold, old)
            return pa.table({"u": pa.array(u), "v": pa.array(v)})

        edges = meet.groupBy("meet").applyInArrow(across, EDGE)
        return found.where("to is not null").select(F.col("cls").alias("u"), F.col("to").alias("v")).union(edges)
    return found.where("to is not null").select(F.col("cls").alias("u"), F.col("to").alias("v"))


def _small_counts(members: DataFrame, groups: int, threshold: float) -> DataFrame:
    """(cls, linked) of components of at most BLOCK_ROWS members: many of them a task."""
    def count(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["root"].to_numpy(), kind="stable")))
        root, copies = t["root"].to_numpy(), t["copies"].to_numpy().astype(np.float64)
        x = unit(matrix(t["v"]))
        linked = np.zeros(len(root))
        cuts = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            linked[a:b] = near(x[a:b], x[a:b], threshold) @ copies[a:b]
        return pa.table({"cls": t["cls"], "linked": pa.array((linked - copies).astype(np.int64))})

    return members.withColumn("deal", F.pmod(F.xxhash64("root"), F.lit(groups))).groupBy("deal").applyInArrow(count, "cls long, linked long")


def _large_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(cls, linked) of components of more than BLOCK_ROWS members.

    Members are binned by their angle to the component's mean direction. Two bins whose outer angles sum to
    less than the threshold's angle hold only linked pairs, two that lie further apart than it hold none;
    the blocks of the bins between are compared, a pair of blocks a group.
    """
    limit = math.acos(min(1.0, max(-1.0, threshold)))
    step = max(limit, 1e-6) / BINS
    kind = members.schema["v"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, roots = unit(matrix(b.column(1))), b.column(0).to_numpy()
            for r in np.unique(roots).tolist():
                s = x[roots == r].sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(s)), pa.array(np.arange(len(s))), pa.array(s)], names=["root", "dim", "s"])

    means = members.select("root", "v").mapInArrow(sums, "root long, dim long, s double").groupBy("root", "dim").agg(F.sum("s").alias("s"))
    means = means.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "s"))), lambda p: p["s"]).alias("mean"))

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                mean = matrix(b.column(4))
                zero = ~mean.any(axis=1)
                mean[zero, 0] = 1.0  # any direction serves
                at = np.arccos(np.clip(cosines(matrix(b.column(2)), mean), -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array((at / step).astype(np.int32))], names=["root", "cls", "v", "copies", "bin"])

    # members of few large components beside a row a component: AQE splits the crowded ones
    binned = members.join(means, "root").select("root", "cls", "v", "copies", "mean").mapInArrow(
        angle, f"root long, cls long, v {kind}, copies long, bin int")
    binned = materialize(binned, "angles")
    bins = binned.groupBy("root", "bin").agg(F.count("*").alias("rows"), F.sum("copies").alias("total"))
    bins = materialize(bins.withColumn("parts", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")), "bins")
    a, b = bins.alias("a"), bins.alias("b")
    pairs = a.join(b, F.col("a.root") == F.col("b.root")).select(F.col("a.root").alias("root"), F.col("a.bin").alias("bin"), F.col("b.bin").alias("other"),
                                                                 F.col("a.parts").alias("parts"), F.col("b.parts").alias("others"), F.col("b.total").alias("total"))
    # an angle in bin i lies in [i, i + 1] steps; one step more on both sides covers its rounding
    sure = F.col("bin") + F.col("other") + 3 <= BINS
    apart = F.abs(F.col("bin") - F.col("other")) > BINS + 2
    certain = pairs.where(sure).groupBy("root", "bin").agg(F.sum("total").alias("sure"))
    blocks = pairs.where(~sure & ~apart).select(
        "root", "bin", "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "others").select(
        "root", "bin", "part", "other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("mate"))
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    sides = binned.join(bins.select("root", "bin", "parts"), ["root", "bin"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    left = sides.join(blocks.select("root", "bin", "part", "block"), ["root", "bin", "part"]).select("block", "cls", "v")
    right = sides.join(blocks.select("root", F.col("other").alias("bin"), F.col("mate").alias("part"), "block"), ["root", "bin", "part"]).select(
        F.col("block").alias("against"), F.col("v").alias("mate_v"), F.col("copies").alias("mate_copies"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = unit(matrix(left["v"])), unit(matrix(right["mate_v"]))
        n, c = np.zeros(len(x)), right["mate_copies"].to_numpy().astype(np.float64)
        for i in range(0, len(x) if len(y) else 0, 1000):
            n[i:i + 1000] = near(x[i:i + 1000], y, threshold) @ c
        return pa.table({"cls": left["cls"], "linked": pa.array(n.astype(np.int64))})

    compared = left.groupBy("block").cogroup(right.groupBy("against")).applyInArrow(count, "cls long, linked long")
    known = binned.join(certain, ["root", "bin"]).select("cls", F.col("sure").alias("linked"))
    own = binned.select("cls", (-F.col("copies")).alias("linked"))
    return compared.union(known).union(own).groupBy("cls").agg(F.sum("linked").alias("linked"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, window: int = 128, recall: float = 0.99, seed: int = 0,
                           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``id_col``, n_links, component_id, kept) for every row of ``vectors``.

    Two rows are linked if the cosine of their vectors, in double precision, is at least ``threshold`` (above 0).
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that links lead
    to, the row's own included, and ``kept`` says that the row's id is that one. No link below the
    threshold is made. A pair at the threshold joins one component with probability ``recall`` at least, nearer
    pairs and pairs with common neighbours more surely; inside a component every link is counted.

    Equal vectors are one class and are linked without being paired. Vectors that are null, zero, or hold null or
    non-finite components, and those of another length than the most frequent one (ties: the longest),
    link with nothing. Rows that repeat an id are rows of their own; a null id is never a component's id
    unless all its ids are null, and such rows are not kept. Other columns are not read; an empty table gives an
    empty result.
    """
    from .spann import usable
    kind = vectors.schema[vector_col].dataType.simpleString()
    held = F.col(f"`{vector_col}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector_col}`").cast("array<double>")
    rows = materialize(vectors.select(F.col(f"`{id_col}`").alias("id"), held.alias("v")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    fine = rows.where(usable(F.col("v").cast("array<double>")))
    widths = fine.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    width = widths["w"] if widths else 0
    takes_part = fine.where(F.size("v") == width)
    classes = materialize(takes_part.groupBy("v").agg(F.min("rid").alias("cls"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    total = passes_for(n, threshold, window, recall) if n > 1 else 0
    edges = vectors.sparkSession.createDataFrame([], EDGE)
    for first in range(0, total, PASSES_AT_ONCE):
        numbers = range(first, min(total, first + PASSES_AT_ONCE))
        found = _pass_edges(classes, n, numbers, window, threshold, seed)
        edges = materialize(edges.union(found).distinct(), "edges")
    roots = materialize(connected_components(edges).select(F.col("node").alias("cls"), "root").distinct(), "roots")
    members = classes.join(roots, "cls").select("root", "cls", "v", "copies")
    sizes = roots.groupBy("root").count()
    sizes = materialize(sizes, "sizes")
    crowded = sizes.where(F.col("count") > BLOCK_ROWS).select("root")
    # a member is always shuffled beside the slim table of sizes; AQE splits crowded roots
    small = materialize(members.join(sizes.where(F.col("count") <= BLOCK_ROWS).select("root"), "root"), "small")
    links = _small_counts(small, max(1, -(-small.count() // BLOCK_ROWS)), threshold)
    if crowded.head(1):
        links = links.union(_large_counts(materialize(members.join(crowded, "root"), "large"), threshold))
    links = materialize(links, "links")
    # per class: its root, its linked rows; per row: the class by its vector
    of_class = classes.join(roots, "cls", "left").join(links, "cls", "left").select(
        "v", F.coalesce("root", "cls").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = materialize(takes_part.join(of_class, "v").select("rid", "id", "root", "n_links"), "placed")
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    inside = placed.join(least, "root").select("rid", "id", "n_links", "component_id")
    outside = rows.join(placed.select("rid"), "rid", "left_anti").select("rid", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return inside.union(outside).select(F.col("id").alias(id_col), "n_links", "component_id",
                                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
