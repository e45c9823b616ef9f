"""G1: distributed running sums, ranks and exact quantiles.

``Window.orderBy`` without ``partitionBy`` moves every row into one task. Here the
order key is first cut into ranges by literal split points taken from one
``percentile_approx`` pass (a bounded list collected to the driver), the running sum
is a window *inside* a range, and each range gets the total of the ranges before it
from a small per-range table. Ranges are fixed by literals, so the result does not
depend on how Spark sampled or partitioned the input.

Callers pre-aggregate heavy ties (``groupBy(value).count()``) before calling, so one
hot value becomes one row and cannot overload a range.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..session import shuffle_partitions

_BUCKET = "__g1_bucket"


def _bucket_tree(x: Column, splits: Sequence) -> Column:
    """Balanced CASE tree: number of splits strictly below ``x`` (values equal to a
    split stay in the lower range). Depth log2(len(splits)), pure codegen."""
    if not splits:
        return F.lit(0)

    def build(lo: int, hi: int) -> Column:
        # index range [lo, hi] of result values
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2  # splits[mid] separates result mid and mid+1
        return F.when(x <= F.lit(splits[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(splits))


def split_points(df: DataFrame, order_col: str, buckets: int, groups: Sequence[str] = ()) -> dict:
    """Approximate quantile split points of ``order_col`` (per low-cardinality group).

    Returns {group tuple: sorted distinct split list}. The result has at most
    ``buckets - 1`` values per group and is collected to the driver; ``groups`` must
    therefore be a low-cardinality key (e.g. a column name after an unpivot).
    """
    if buckets <= 1:
        return {}
    probs = [i / buckets for i in range(1, buckets)]
    agg = F.percentile_approx(F.col(order_col), probs, 10000).alias("s")
    rows = (df.groupBy(*groups).agg(agg) if groups else df.agg(agg)).collect()
    out = {}
    for r in rows:
        key = tuple(r[g] for g in groups)
        vals = [v for v in (r["s"] or []) if v is not None]
        out[key] = sorted(set(vals))
    return out


def default_buckets(df: DataFrame) -> int:
    return max(1, 4 * shuffle_partitions(df.sparkSession))


def running_sum(df: DataFrame, order_col: str, sum_cols: Sequence[str], partition_cols: Sequence[str] = (),
                descending: bool = False, buckets: int | None = None, split_groups: Sequence[str] | None = None,
                splits: dict | None = None, suffix_incl: str = "_cum", suffix_excl: str = "_before",
                lead_cols: Sequence[str] = ()) -> DataFrame:
    """Add inclusive (``<c>_cum``) and exclusive (``<c>_before``) running sums of
    ``sum_cols`` ordered by ``order_col`` inside ``partition_cols``.

    Order values should be unique inside a partition (pre-aggregate ties); rows with
    equal order values are summed in an arbitrary but fixed order otherwise.

    ``split_groups``: subset of ``partition_cols`` whose values get their own split
    points (use when partitions have different value ranges, e.g. one per column);
    default: one global set of split points. ``splits`` may be given directly.
    ``lead_cols``: also the next row's value (``<c>_next``, NULL on a partition's last row).
    """
    buckets = buckets or default_buckets(df)
    partition_cols = list(partition_cols)
    split_groups = list(split_groups or [])
    if splits is None:
        splits = split_points(df, order_col, buckets, split_groups)
    x = F.col(order_col)
    if split_groups and splits:
        bucket = None
        for key, sp in splits.items():
            cond = None
            for g, v in zip(split_groups, key):
                c = F.col(g).eqNullSafe(F.lit(v))
                cond = c if cond is None else (cond & c)
            tree = _bucket_tree(x, sp)
            bucket = F.when(cond, tree) if bucket is None else bucket.when(cond, tree)
        bucket = bucket.otherwise(F.lit(0))
        nmax = F.lit(max((len(v) for v in splits.values()), default=0))
    else:
        sp = splits.get((), []) if splits else []
        bucket = _bucket_tree(x, sp)
        nmax = F.lit(len(sp))
    if descending:
        bucket = nmax - bucket
    base = df.withColumn(_BUCKET, bucket)

    order = x.desc() if descending else x.asc()
    w = Window.partitionBy(*partition_cols, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = {c + "__in": F.sum(F.col(c)).over(w) for c in sum_cols}
    inner |= {c + "__lead": F.lead(c).over(Window.partitionBy(*partition_cols, _BUCKET).orderBy(order)) for c in lead_cols}
    d = base.withColumns(inner)

    # per-range totals straight from the input (partial aggregation, no second window
    # evaluation): at most (#partitions x buckets) rows
    totals = base.groupBy(*partition_cols, _BUCKET).agg(*[F.sum(F.col(c)).alias(c + "__tot") for c in sum_cols],
                                                          *[(F.max_by if descending else F.min_by)(c, order_col).alias(c + "__first") for c in lead_cols])
    wt = Window.partitionBy(*partition_cols).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*partition_cols, _BUCKET,
                            *[F.coalesce(F.sum(c + "__tot").over(wt), F.lit(0)).alias(c + "__off") for c in sum_cols],
                            *[F.lead(c + "__first").over(Window.partitionBy(*partition_cols).orderBy(_BUCKET)).alias(c + "__then") for c in lead_cols])
    if not partition_cols:
        # bounded by ``buckets`` rows: safe to broadcast
        offsets = F.broadcast(offsets)
    d = d.join(offsets, on=[*partition_cols, _BUCKET], how="inner")
    out_cols = []
    for c in sum_cols:
        out_cols.append((F.col(c + "__off") + F.col(c + "__in")).alias(c + suffix_incl))
        out_cols.append((F.col(c + "__off") + F.col(c + "__in") - F.col(c)).alias(c + suffix_excl))
    out_cols += [F.coalesce(c + "__lead", c + "__then").alias(c + "_next") for c in lead_cols]
    keep = [F.col(f"`{n}`") for n in df.columns]
    return d.select(*keep, *out_cols)


def row_number(df: DataFrame, order_col: str, partition_cols: Sequence[str] = (), name: str = "rn",
               descending: bool = False, buckets: int | None = None,
               split_groups: Sequence[str] | None = None) -> DataFrame:
    """1-based row number over unique order values, distributed."""
    d = df.withColumn("__one", F.lit(1).cast("long"))
    d = running_sum(d, order_col, ["__one"], partition_cols, descending, buckets, split_groups)
    return d.withColumnRenamed("__one_cum", name).drop("__one", "__one_before")


def value_ranks(df: DataFrame, value_col: str, partition_cols: Sequence[str] = (),
                split_groups: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Distinct values with their count and average rank (ties get the mean rank).

    Output: partition_cols, value_col, cnt, rank_lo (1-based first rank), avg_rank.
    """
    counts = df.where(F.col(value_col).isNotNull()).groupBy(*partition_cols, value_col).agg(F.count(F.lit(1)).alias("cnt"))
    return ranks_from_counts(counts, value_col, partition_cols, split_groups, buckets)


def ranks_from_counts(counts: DataFrame, value_col: str, partition_cols: Sequence[str] = (),
                      split_groups: Sequence[str] | None = None, buckets: int | None = None,
                      splits: dict | None = None) -> DataFrame:
    """``value_ranks`` on an already counted table (partition_cols, value_col, cnt) with
    one row per distinct non-NULL value; lets a caller persist the counts once and
    take split points, sizes and ranks from it."""
    r = running_sum(counts, value_col, ["cnt"], partition_cols, False, buckets, split_groups, splits=splits)
    return r.select(*partition_cols, value_col, "cnt",
                    (F.col("cnt_before") + 1).alias("rank_lo"),
                    (F.col("cnt_before") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))


def interpolate(v_lo, v_hi, weight) -> Column:
    """Linear interpolation between two order statistics. Equal neighbours are returned as they
    are, so infinite values never meet in a subtraction."""
    return F.when(v_lo == v_hi, v_lo).when(weight == 0, v_lo).otherwise(v_lo + weight * (v_hi - v_lo))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], partition_cols: Sequence[str] = (),
                    split_groups: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy/pandas default, DuckDB ``quantile_cont``,
    Spark ``percentile``). Output: partition_cols, p (double), q (double).

    One path at every size: value counts (map-side combined, a hot value is one row), then
    the order statistics around (n-1)p. Groups that can be listed (no partition columns, or all of
    them in ``split_groups``) go through ``quantiles_from_counts``; otherwise running counts
    over all values are joined with the wanted positions."""
    partition_cols = list(partition_cols)
    clean = df.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
    counts = clean.groupBy(*partition_cols, value_col).agg(F.count(F.lit(1)).alias("cnt"))
    if not partition_cols or set(partition_cols) <= set(split_groups or ()):
        counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return quantiles_from_counts(counts, value_col, probs, partition_cols, buckets)
        finally:
            counts.unpersist()
    return _quantiles_ranked(counts, value_col, probs, partition_cols, split_groups, buckets)


def quantiles_from_counts(counts: DataFrame, value_col: str, probs: Sequence[float], groups: Sequence[str] = (),
                          buckets: int | None = None) -> DataFrame:
    """Quantiles of few, listable groups from a counted table (groups, value_col, cnt), which is read
    three times (persist it): split points, totals per range (groups x buckets rows to the driver),
    and the sort of only those ranges that hold a wanted position."""
    spark, groups = counts.sparkSession, list(groups)
    schema = T.StructType([counts.schema[g] for g in groups] + [T.StructField("p", T.DoubleType()), T.StructField("q", T.DoubleType())])
    buckets = buckets or default_buckets(counts)
    splits = split_points(counts, value_col, buckets, groups)
    ranged = counts.withColumn(_BUCKET, _bucket_of(F.col(value_col), splits, groups))
    totals: dict = {}
    for r in ranged.groupBy(*groups, _BUCKET).agg(F.sum("cnt").alias("t")).collect():
        totals.setdefault(tuple(r[g] for g in groups), {})[r[_BUCKET]] = r["t"]
    wanted, ranges = [], {}  # (group, p, weight, position), and per range the rows before it
    for g, by in totals.items():
        n, before, starts = sum(by.values()), 0, []
        for b in sorted(by):
            starts.append((before, b))
            before += by[b]
        for p in probs:
            h = float(p) * (n - 1)
            lo = min(int(math.floor(h)), n - 1)
            for pos in {lo, min(lo + 1, n - 1)}:
                start, b = starts[bisect.bisect_right(starts, (pos, math.inf)) - 1]
                ranges[(g, b)] = start
            wanted.append((g, float(p), h - lo, lo, min(lo + 1, n - 1)))
    if not wanted:
        return spark.createDataFrame([], schema)
    hit = spark.createDataFrame([(*g, b, int(s)) for (g, b), s in ranges.items()],
                                T.StructType([counts.schema[g] for g in groups] + [T.StructField(_BUCKET, T.IntegerType()), T.StructField("__start", T.LongType())]))
    keys = [*groups, _BUCKET]
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"h.{k}"))
    # at most two ranges a group and probability: a bounded broadcast
    near = ranged.alias("a").join(F.broadcast(hit).alias("h"), cond).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{value_col}").alias(value_col), "cnt", "__start")
    w = Window.partitionBy(*keys).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__end", F.col("__start") + F.sum("cnt").over(w))
    spots = sorted({(g, pos) for g, _, _, lo, hi in wanted for pos in (lo, hi)}, key=str)
    spot = F.broadcast(spark.createDataFrame([(*g, int(pos)) for g, pos in spots],
                                             T.StructType([counts.schema[g] for g in groups] + [T.StructField("__pos", T.LongType())])))
    cond = (F.col("__pos") < F.col("__end")) & (F.col("__pos") >= F.col("__end") - F.col("cnt"))
    for g in groups:
        cond = cond & F.col(f"n.{g}").eqNullSafe(F.col(f"s.{g}"))
    found = {}
    for r in near.alias("n").join(spot.alias("s"), cond).select(*[F.col(f"s.{g}").alias(g) for g in groups], "__pos", F.col(value_col).cast("double").alias("__v")).collect():
        found[(tuple(r[g] for g in groups), r["__pos"])] = r["__v"]
    rows = []
    for g, p, weight, lo, hi in wanted:
        a, b = found[(g, lo)], found[(g, hi)]
        rows.append((*g, p, a if a == b or weight == 0 else a + weight * (b - a)))
    return spark.createDataFrame(rows, schema)


def _bucket_of(x: Column, splits: dict, groups: Sequence[str]) -> Column:
    """Range of ``x`` by the split points of its group."""
    if not groups:
        return _bucket_tree(x, splits.get((), []))
    bucket = F.lit(0)
    for key, sp in splits.items():
        cond = F.lit(True)
        for g, v in zip(groups, key):
            cond = cond & F.col(g).eqNullSafe(F.lit(v))
        bucket = F.when(cond, _bucket_tree(x, sp)).otherwise(bucket)
    return bucket


def _quantiles_ranked(counts: DataFrame, value_col: str, probs: Sequence[float], partition_cols: Sequence[str],
                      split_groups: Sequence[str] | None, buckets: int | None) -> DataFrame:
    r = running_sum(counts, value_col, ["cnt"], partition_cols, False, buckets, split_groups)
    targets = counts.groupBy(*partition_cols).agg(F.sum("cnt").alias("n")).select(
        *partition_cols, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    targets = targets.withColumn("h", F.col("p") * (F.col("n") - 1)).withColumn("lo", F.floor("h").cast("long"))
    # 0-based positions lo and hi; a value covers positions [cnt_before, cnt_cum-1]. Both sides are
    # shuffled by the group: its wanted positions are few, and AQE splits a group with many values
    gk = [f"__g{i}" for i in range(len(partition_cols))]
    pos = targets.select(*[F.col(c).alias(g) for c, g in zip(partition_cols, gk)], "p", "h", "lo",
                         F.explode(F.array_distinct(F.array("lo", F.least(F.col("lo") + 1, F.col("n") - 1)))).alias("pos"))
    cond = (F.col("pos") >= F.col("cnt_before")) & (F.col("pos") < F.col("cnt_cum"))
    for c, g in zip(partition_cols, gk):
        cond = cond & F.col(g).eqNullSafe(F.col(c))
    rr = r.select(*partition_cols, F.col(value_col).cast("double").alias("__v"), "cnt_before", "cnt_cum")
    hit = pos.join(rr, on=cond).select(*[F.col(g).alias(c) for c, g in zip(partition_cols, gk)], "p", "h", "lo", "pos", F.col("__v").alias("v"))
    res = hit.groupBy(*partition_cols, "p").agg(F.first("h").alias("h"), F.first("lo").alias("lo"),
                                                F.min_by("v", "pos").alias("v_lo"), F.max_by("v", "pos").alias("v_hi"))
    return res.select(*partition_cols, "p", interpolate(F.col("v_lo"), F.col("v_hi"), F.col("h") - F.col("lo")).alias("q"))
