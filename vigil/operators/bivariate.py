"""Bivariate analysis (B1-B6, B8); Kendall's tau (B7) lives in ``kendall``."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..functions.exprs import nan_to_null, numeric_columns, q
from ..functions.normal import t_two_sided_p
from ..functions.ranking import default_buckets, exact_quantiles, ranks_from_counts

BROADCAST_ROWS = 200_000  # size check before a broadcast hint on a derived table


# --------------------------------------------------------------------------- B1
MAX_LEVELS = 10_000  # levels of a column that may become columns or zero cells


def _levels(d: DataFrame, c: str) -> list:
    """Distinct values of ``c``, refused beyond ``MAX_LEVELS``: a key is no category."""
    found = [r[0] for r in d.select(c).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels; use the long form without zero cells")
    return sorted(found)


def contingency(df: DataFrame, a: str, b: str, wide: bool = False, zeros: bool = True) -> DataFrame:
    """B1: cross tabulation of two columns, NULL pairs excluded.

    Long: (a, b, n) from one grouped count; with ``zeros`` also the level pairs that never
    occur (the levels of ``b``, at most ``MAX_LEVELS``, are listed). Wide: one row per
    level of ``a``, one column per level of ``b``. ``zeros=False`` takes columns of any size."""
    d = df.where(q(a).isNotNull() & q(b).isNotNull()).select(q(a).alias("a"), q(b).cast("string").alias("b"))
    counts = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    if not wide and not zeros:
        return counts.select(F.col("a").alias(a), F.col("b").alias(b), "n")
    levels = _levels(d, "b")
    w = counts.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))  # at most MAX_LEVELS entries a row
    cell = lambda lv: F.coalesce(F.col("m")[F.lit(lv)], F.lit(0).cast("long"))
    if wide:
        return w.select(F.col("a").alias(a), *[cell(lv).alias(lv) for lv in levels])
    every = w.select("a", "m", F.explode(F.lit(levels).cast("array<string>")).alias("b"))
    return every.select(F.col("a").alias(a), F.col("b").alias(b), F.coalesce(F.col("m")[F.col("b")], F.lit(0).cast("long")).alias("n"))


# --------------------------------------------------------------------------- B2
def box_stats(df: DataFrame, cat: str, num: str) -> DataFrame:
    """B2: per category q1, median, q3 (linear interpolation), whiskers (most extreme
    values inside 1.5 IQR), number of outliers and n."""
    x = nan_to_null(q(num).cast("double"), T.DoubleType())
    d = df.where(q(cat).isNotNull() & x.isNotNull()).select(q(cat).alias("cat"), x.alias("x"))
    qs = exact_quantiles(d, "x", [0.25, 0.5, 0.75], ["cat"])
    fences = qs.groupBy("cat").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                     for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    fences = fences.withColumn("lo_f", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
                   .withColumn("hi_f", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = d.join(fences, "cat")  # AQE broadcasts it by its measured size, or splits hot categories
    inside_lo = F.col("x") >= F.col("lo_f")
    inside_hi = F.col("x") <= F.col("hi_f")
    return j.groupBy("cat").agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.min(F.when(inside_lo, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside_hi, F.col("x"))).alias("whisker_high"),
        F.sum(F.when(~inside_lo | ~inside_hi, 1).otherwise(0)).cast("long").alias("n_outliers"),
    ).withColumnRenamed("cat", cat)


# --------------------------------------------------------------------------- B3
def scatter_points(df: DataFrame, x: str, y: str, n: int | None = None, seed: int = 42, key: str | None = None) -> DataFrame:
    """The points of a scatter plot, all pair-complete rows. With ``n`` a reproducible sample
    of that many: the rows with the smallest seeded hash (top-k, no full sort)."""
    cols = [q(x), q(y)] + ([q(key)] if key else [])
    pts = df.select(*cols).where(q(x).isNotNull() & q(y).isNotNull())
    if n is None:
        return pts
    h = F.xxhash64(*(cols if key is None else [q(key)]), F.lit(seed))
    return pts.withColumn("__h", h).orderBy("__h", *cols).limit(n).drop("__h")


# --------------------------------------------------------------------------- B4
def linregress(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x over pair-complete rows: n, slope, intercept,
    r, r2, stderr (slope), intercept_stderr, p_value (two-sided t-test of slope = 0). A perfect line
    has p = 0, a constant y r = 0 and p = 1; without two different x all but n are NaN."""
    xs = nan_to_null(q(x).cast("double"), T.DoubleType())
    ys = nan_to_null(q(y).cast("double"), T.DoubleType())
    d = df.select(xs.alias("x"), ys.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    a = d.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("sxy"), F.var_pop("x").alias("sxx"),
              F.var_pop("y").alias("syy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    a = a.withColumn("slope", F.try_divide("sxy", "sxx")).withColumn("r", F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))))
    a = a.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    nan, dof = F.lit(float("nan")), F.col("n") - 2
    line = (F.col("n") >= 2) & (F.col("sxx") > 0)
    r = F.when(F.col("syy") == 0, F.lit(0.0)).otherwise(F.least(F.greatest(F.col("r"), F.lit(-1.0)), F.lit(1.0)))
    rest = (F.lit(1.0) - r) * (F.lit(1.0) + r)
    se = F.when(dof <= 0, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(F.try_divide(rest * F.col("syy"), F.col("sxx")), dof)))
    t = F.when(rest <= 0, F.signum(r) * float("inf")).otherwise(r * F.sqrt(F.try_divide(dof.cast("double"), rest)))
    two = F.when(F.col("syy") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    p = F.when(dof <= 0, two).when(rest <= 0, F.lit(0.0)).otherwise(t_two_sided_p(F.when(rest > 0, t), dof.cast("double")))
    only = lambda c: F.when(line, c).otherwise(nan)
    return a.select(
        F.col("n").cast("long").alias("n"), only(F.col("slope")).alias("slope"), only(F.col("intercept")).alias("intercept"),
        only(r).alias("r"), only(r * r).alias("r2"), only(se).alias("stderr"),
        only(se * F.sqrt(F.col("sxx") + F.col("mx") * F.col("mx"))).alias("intercept_stderr"), only(p).alias("p_value"))


# --------------------------------------------------------------------------- B5 / B6
def _pairs(cols: Sequence[str]):
    return list(itertools.combinations(cols, 2))


def _pearson_long(d: DataFrame, cols: Sequence[str], names=None) -> DataFrame:
    names = names or {c: c for c in cols}
    pairs = _pairs(cols)
    if not pairs:
        return d.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    a = d.agg(*[F.corr(q(u), q(v)).alias(f"p{i}") for i, (u, v) in enumerate(pairs)])
    items = []
    for i, (u, v) in enumerate(pairs):
        items.append(F.struct(F.lit(names[u]).alias("col_a"), F.lit(names[v]).alias("col_b"), F.col(f"p{i}").alias("corr")))
        items.append(F.struct(F.lit(names[v]).alias("col_a"), F.lit(names[u]).alias("col_b"), F.col(f"p{i}").alias("corr")))
    for c in cols:
        items.append(F.struct(F.lit(names[c]).alias("col_a"), F.lit(names[c]).alias("col_b"), F.lit(1.0).cast("double").alias("corr")))
    return a.select(F.inline(F.array(*items)))


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Correlation matrix in long form (col_a, col_b, corr), pairwise complete.

    pearson: one aggregate over all pairs. spearman: Pearson on average ranks; ranks
    come from the distributed value-rank table of each column, joined back on the
    value. kendall: tau-b per pair (``kendall.kendall_tau``)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    d = df.select(*[nan_to_null(q(c).cast("double"), T.DoubleType()).alias(c) for c in cols])
    if method == "pearson":
        return _pearson_long(d, cols)
    if method == "spearman":
        plain = [f"c{i}" for i in range(len(cols))]  # any name is allowed in the input
        return _spearman_long(d.toDF(*plain), plain, dict(zip(plain, cols)))
    if method == "kendall":
        from .kendall import kendall_tau
        out = None
        for u, v in _pairs(cols):
            t = kendall_tau(d, u, v).select("tau")
            r = t.select(F.inline(F.array(F.struct(F.lit(u).alias("col_a"), F.lit(v).alias("col_b"), F.col("tau").alias("corr")),
                                          F.struct(F.lit(v).alias("col_a"), F.lit(u).alias("col_b"), F.col("tau").alias("corr")))))
            out = r if out is None else out.unionByName(r)
        diag = d.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "col_a string, col_b string, corr double")
        return diag if out is None else out.unionByName(diag)
    raise ValueError(f"unknown method {method!r}")


def _rank_columns(d: DataFrame, cols: Sequence[str], ranks: DataFrame, sizes: dict) -> DataFrame:
    """Replace every column by its average rank among the rows (ties share the mean)."""
    out = d
    for c in cols:
        rc = ranks.where(F.col("column_name") == c).select(F.col("x").alias(f"__v_{c}"), F.col("avg_rank").alias(f"__r_{c}"))
        # rank tables have one row per distinct value: broadcast only when counted small
        rc = F.broadcast(rc) if sizes.get(c, 0) <= BROADCAST_ROWS else rc
        out = out.join(rc, F.col(c) == F.col(f"__v_{c}"), "left").drop(f"__v_{c}")
    return out.select(*[F.col(f"__r_{c}").alias(c) for c in cols])


def _spearman_pairs(d: DataFrame, cols: Sequence[str]) -> list[tuple[str, str, float]]:
    """Spearman coefficients of all column pairs of ``d`` (no NULLs inside ``d``)."""
    items = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x")) for c in cols]
    lv = d.select(F.inline(F.array(*items))).where(F.col("x").isNotNull())
    # distinct values are counted once (one shuffle); split points, sizes and ranks all
    # read the persisted counts, and the rank table is read once per column
    counts = (lv.groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("cnt"))
              .persist(StorageLevel.MEMORY_AND_DISK))
    ranks = None
    try:
        # split points and rank-table sizes per column in one aggregate (one row per column)
        b = default_buckets(counts)
        stats = counts.groupBy("column_name").agg(
            F.percentile_approx("x", [i / b for i in range(1, b)], 10000).alias("s"),
            F.count(F.lit(1)).alias("n")).collect()
        splits = {(r["column_name"],): sorted({v for v in (r["s"] or []) if v is not None}) for r in stats} if b > 1 else {}
        sizes = {r["column_name"]: r["n"] for r in stats}
        ranks = ranks_from_counts(counts, "x", ["column_name"], ["column_name"], splits=splits
                                  ).persist(StorageLevel.MEMORY_AND_DISK)
        rk = _rank_columns(d, cols, ranks, sizes)
        pairs = _pairs(cols)
        row = rk.agg(*[F.corr(q(u), q(v)).alias(f"p{i}") for i, (u, v) in enumerate(pairs)]).first()
        return [(u, v, row[f"p{i}"]) for i, (u, v) in enumerate(pairs)]
    finally:
        if ranks is not None:
            ranks.unpersist()
        counts.unpersist()


def _spearman_long(d: DataFrame, cols: Sequence[str], names: dict) -> DataFrame:
    """Spearman matrix over ``names`` of the columns; the k x k coefficients (an aggregate) come back to the driver,
    which lets the shared rank table be persisted and released within the call."""
    nulls = d.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in cols]).first()
    if all(not nulls[c] for c in cols):
        res = _spearman_pairs(d, cols)
    else:
        # some NULLs: rank each pair on its own pair-complete rows
        res = []
        for u, v in _pairs(cols):
            sub = d.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(u, v)
            res += _spearman_pairs(sub, [u, v])
    rows = [(names[c], names[c], 1.0) for c in cols]
    for u, v, r in res:
        rows += [(names[u], names[v], r), (names[v], names[u], r)]
    return d.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


# --------------------------------------------------------------------------- B8
def corr_wide(m: DataFrame, decimals: int = 3, lower_triangle: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """Long correlation table -> square matrix, rounded."""
    names = list(order) if order is not None else [r[0] for r in m.select("col_a").distinct().orderBy(1).collect()]
    mm = m
    if lower_triangle:
        pos = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
        mm = m.where(pos[F.col("col_b")] <= pos[F.col("col_a")])
    w = mm.groupBy("col_a").pivot("col_b", names).agg(F.first(F.round("corr", decimals)))
    return w.select(F.col("col_a").alias("variable"), *[F.col(f"`{n}`") for n in names])
