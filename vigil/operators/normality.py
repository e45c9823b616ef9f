"""Shapiro-Wilk W and p-value for many columns (and groups) at once.

Royston (1995), Algorithm AS R94: coefficients from normal scores of the sorted
values, W = squared correlation between coefficients and ordered values, p-value by
Royston's normalising transformation. Every value takes part:

- values are counted (a hot value is one row) and ranked with the distributed running
  counts of ``functions.ranking``;
- above ``MAX_N_FOR_P`` values, where the published p-value ends, ``shapiro_blocks`` tests disjoint random
  blocks that together hold every value;
- the ranks a value covers are expanded in blocks that are dealt out anew, each rank
  gets its normal score, and one map-side combined aggregate per group gathers the sums
  that W needs.

Fixed values: the polynomial coefficients below are the published constants of
AS R94 (Royston 1995, Applied Statistics 44(4)).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.exprs import numeric_columns, q
from ..functions.normal import add_inv_normal, add_norm_sf
from ..functions.ranking import ranks_from_counts

C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
C6 = [-0.4803, -0.082676, 0.0030302]
G = [-2.273, 0.459]


def _poly(cc, x: Column) -> Column:
    acc = F.lit(cc[-1])
    for c in reversed(cc[:-1]):
        acc = acc * x + F.lit(c)
    return acc


MAX_N_FOR_P = 5000  # the published p-value polynomials were fitted up to this sample size
BLOCK = 1 << 16  # ranks of one value that are expanded together


def shapiro(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (), min_n: int = 3,
            alpha: float = 0.05) -> DataFrame:
    """Output: column_name, *by, n, w, p_value, normal (p > alpha). W covers all finite
    values of a column (and group). ``p_value`` and ``normal`` are NULL above ``MAX_N_FOR_P``
    values, where the published approximation ends; groups with fewer than ``min_n`` (at least
    3) values have NULL statistics; a constant sample has w = 1 and p = 1."""
    by, min_n = list(by), max(3, min_n)
    parts = ["column_name", *by]
    counts = _counted(df, cols, by).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        g = _statistics(counts, ranks_from_counts(counts, "x", parts, ["column_name"]), parts, min_n)
        if not by:  # one row a column: brought back, so the counts can be released
            rows = g.collect()
            return df.sparkSession.createDataFrame(_labelled(df.sparkSession.createDataFrame(rows, g.schema), parts, alpha).collect(),
                                                   "column_name string, n long, w double, p_value double, normal boolean")
    finally:
        if not by:
            counts.unpersist()
    return _labelled(g, parts, alpha)


def shapiro_blocks(df: DataFrame, cols: Sequence[str] | None = None, block_rows: int = 4000, alpha: float = 0.05) -> DataFrame:
    """Shapiro-Wilk with p-values at any table size: all finite values of a column, dealt at random into disjoint
    blocks of about ``block_rows``, each tested. Output: column_name, block, n, w, p_value, normal (p > alpha).

    A column of at most ``MAX_N_FOR_P`` values is one block. The blocks are simple random samples of the column, the same
    ones however the table is partitioned: a value's place in the sorted column is hashed."""
    dealt = _dealt(df, cols, block_rows)
    parts = ["column_name", "block"]
    place = F.row_number().over(Window.partitionBy(*parts).orderBy("x")).cast("long")  # a block is about block_rows rows
    ranks = dealt.select(*parts, "x", F.lit(1).cast("long").alias("cnt"), place.alias("rank_lo"))
    counts = dealt.groupBy(*parts, "x").agg(F.count(F.lit(1)).alias("cnt"))
    return _labelled(_statistics(counts, ranks, parts, 3), parts, alpha)


def normality_verdict(df: DataFrame, cols: Sequence[str] | None = None, block_rows: int = 4000, alpha: float = 0.05) -> DataFrame:
    """One row a column: column_name, n, n_blocks, n_rejected (blocks with p <= alpha), p_value, normal.

    ``p_value`` is the smallest of the blocks' p-values times their number, 1 at most (Bonferroni): the chance that any of the
    disjoint blocks of a normal column looks as far from normal as the worst one does."""
    blocks = shapiro_blocks(df, cols, block_rows, alpha)
    p = F.least(F.min("p_value") * F.count("p_value"), F.lit(1.0))
    return blocks.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_blocks"), F.count_if(F.col("p_value") <= alpha).alias("n_rejected"),
        p.alias("p_value"), (p > alpha).alias("normal"))


def _dealt(df: DataFrame, cols: Sequence[str] | None, block_rows: int) -> DataFrame:
    """(column_name, block, x): every finite value of the columns in its block."""
    counts = _counted(df, cols, [])
    n = F.sum("cnt")
    blocks = F.when(n <= MAX_N_FOR_P, F.lit(1)).otherwise(F.ceil(n / block_rows)).cast("long")
    size = counts.groupBy("column_name").agg(blocks.alias("blocks"))  # a row a column
    each = _each_rank(ranks_from_counts(counts, "x", ["column_name"], ["column_name"]), ["column_name"])
    block = F.pmod(F.xxhash64("column_name", "i"), F.col("blocks"))
    return each.join(F.broadcast(size), "column_name").select("column_name", block.alias("block"), "x")


def _counted(df: DataFrame, cols: Sequence[str] | None, by: Sequence[str]) -> DataFrame:
    """(column_name, *by, x, cnt): the finite values of the columns with their frequency."""
    items = []
    for c in numeric_columns(df) if cols is None else cols:
        x = q(c).cast("double")
        items.append(F.struct(F.lit(c).alias("column_name"), F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias("x")))
    values = df.select(*[q(b) for b in by], F.inline(F.array(*items))).where(F.col("x").isNotNull())
    return values.groupBy("column_name", *by, "x").agg(F.count(F.lit(1)).alias("cnt"))


def _each_rank(ranks: DataFrame, parts: list[str]) -> DataFrame:
    """(parts, x, i): one row for every rank that a counted value covers; those of a hot value are dealt out in blocks."""
    blocks = ranks.select(*parts, "x", "rank_lo", "cnt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cnt") - 1) / BLOCK))).alias("part"))
    first = F.col("rank_lo") + F.col("part") * BLOCK
    last = F.least(first + BLOCK - 1, F.col("rank_lo") + F.col("cnt") - 1)
    return blocks.repartition(*parts, "x", "part").select(*parts, "x", F.explode(F.sequence(first, last)).alias("i"))


def _statistics(counts: DataFrame, ranks: DataFrame, parts: list[str], min_n: int) -> DataFrame:
    """(parts, n, w) of every group of a counted table (parts, x, cnt) and its ranks (parts, x, cnt, rank_lo)."""
    size = counts.groupBy(*parts).agg(F.sum("cnt").alias("n"), (F.sum(F.col("x") * F.col("cnt")) / F.sum("cnt")).alias("mean"))
    s = _each_rank(ranks, parts).join(size.where(F.col("n") >= min_n), parts).withColumn("u", F.col("x") - F.col("mean"))
    s = add_inv_normal(s.withColumn("p", (F.col("i") - 0.375) / (F.col("n").cast("double") + 0.25)), "p", "m")
    at = lambda r, c: F.max(F.when(F.col("i") == r, F.col(c)))
    g = s.groupBy(*parts, "n").agg(
        F.sum(F.col("m") * F.col("m")).alias("summ2"), F.sum(F.col("m") * F.col("u")).alias("smu"), F.sum(F.col("u") * F.col("u")).alias("sse"),
        at(F.lit(1), "u").alias("u1"), at(F.lit(2), "u").alias("u2"), at(F.col("n") - 1, "u").alias("v2"), at(F.col("n"), "u").alias("v1"),
        at(F.lit(1), "m").alias("m1"), at(F.lit(2), "m").alias("m2"))
    rsn = F.lit(1.0) / F.sqrt(F.col("n").cast("double"))
    g = g.withColumns({"a1": _poly(C1, rsn) - F.col("m1") / F.sqrt("summ2"), "a2": _poly(C2, rsn) - F.col("m2") / F.sqrt("summ2")})
    ends1 = F.col("m1") * (F.col("u1") - F.col("v1"))  # the scores are antisymmetric
    ends2 = F.col("m2") * (F.col("u2") - F.col("v2"))
    wide1, wide2 = F.col("a1") * (F.col("v1") - F.col("u1")), F.col("a2") * (F.col("v2") - F.col("u2"))
    fac2 = F.sqrt((F.col("summ2") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * F.col("a1") ** 2 - 2 * F.col("a2") ** 2))
    fac1 = F.sqrt((F.col("summ2") - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("a1") ** 2))
    num = (F.when(F.col("n") == 3, F.lit(math.sqrt(0.5)) * (F.col("v1") - F.col("u1")))
           .when(F.col("n") <= 5, F.try_divide(F.col("smu") - ends1, fac1) + wide1)
           .otherwise(F.try_divide(F.col("smu") - ends1 - ends2, fac2) + wide1 + wide2))
    w = F.when(F.col("v1") == F.col("u1"), F.lit(1.0)).otherwise(F.least(F.try_divide(num * num, F.col("sse")), F.lit(1.0)))
    return size.select(*parts, "n").join(g.select(*parts, w.alias("w")), parts, "left")


def _labelled(g: DataFrame, parts: list[str], alpha: float) -> DataFrame:
    nn = F.col("n").cast("double")
    gamma, ln = _poly(G, nn), F.log(nn)
    g = g.withColumn("__y", F.log(F.when(F.col("w") < 1.0, F.lit(1.0) - F.col("w"))))
    z_small = F.try_divide(-F.log(F.when(gamma > F.col("__y"), gamma - F.col("__y"))) - _poly(C3, nn), F.exp(_poly(C4, nn)))
    z_big = (F.col("__y") - _poly(C5, ln)) / F.exp(_poly(C6, ln))
    g = add_norm_sf(g.withColumn("__z", F.when(F.col("n") <= 11, z_small).otherwise(z_big)), "__z", "__pz")
    p3 = F.greatest(F.lit(1.90985931710274) * (F.asin(F.sqrt(F.col("w"))) - F.lit(1.04719755119660)), F.lit(0.0))
    p = (F.when((F.col("n") > MAX_N_FOR_P) | F.col("w").isNull(), F.lit(None).cast("double"))
         .when(F.col("n") == 3, p3).when(F.col("w") >= 1.0, F.lit(1.0))
         .when((F.col("n") <= 11) & (F.col("__y") >= gamma), F.lit(1e-99)).otherwise(F.col("__pz")))
    p = F.when(p > 1.0, F.lit(1.0)).otherwise(p)
    return g.select(*parts, F.col("n").cast("long").alias("n"), "w", p.alias("p_value"), (p > alpha).alias("normal"))
