"""O3: isolation forest per numeric column (Liu, Ting & Zhou 2008), 1-D.

1. Samples: for every (column, tree) ``sample`` values are drawn in one pass: each
   value draws a random slot, a slot feeds one tree and holds ~3 * sample candidates,
   of which ``sample`` are kept. Draws are hashes of the whole row and the seed, so
   the forest does not depend on the partitioning.
2. Trees: one isolation tree per (column, tree) grown in ``groupBy(...).applyInPandas``
   (at most ``sample`` values per group). A 1-D tree cuts the line into intervals;
   each tree is returned as its sorted cut points with the path length of every
   interval (depth + c(leaf size)). Size: trees x sample numbers per column, set by
   the parameters, not by the data.
3. Scores: every value gets 2^(-E[h] / c(sample)) in a pandas UDF (binary search in
   each tree). Flagged: score above the (1 - contamination) exact quantile.
Columns with at most ``min_rows`` values are skipped, as in the reference.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null, numeric_columns, q
from ..functions.ranking import exact_quantiles

EULER = 0.5772156649015329


def avg_path(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Return (cuts, heights): sorted cut points and the path length of each interval."""
    out = []  # (lo_cut_index_placeholder) -> collect leaves as (lo, hi, h)

    def rec(v, depth, lo, hi):
        if depth >= max_depth or len(v) <= 1 or v.min() == v.max():
            out.append((lo, hi, depth + avg_path(len(v))))
            return
        s = rng.uniform(v.min(), v.max())
        rec(v[v <= s], depth + 1, lo, s)
        rec(v[v > s], depth + 1, s, hi)

    rec(values, 0, -np.inf, np.inf)
    out.sort(key=lambda t: t[0])
    cuts = [t[1] for t in out[:-1]]
    heights = [t[2] for t in out]
    return cuts, heights


def _forest(df_long: DataFrame, trees: int, sample: int, seed: int) -> DataFrame:
    max_depth = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        col = pdf["column_name"].iloc[0]
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, t, zlib.crc32(col.encode())])
        cuts, heights = _grow(pdf["x"].to_numpy(dtype=float), rng, max_depth)
        return pd.DataFrame({"column_name": [col], "tree": [t], "cuts": [cuts], "heights": [heights]})

    return df_long.groupBy("column_name", "tree").applyInPandas(
        grow, "column_name string, tree int, cuts array<double>, heights array<double>")


def outliers_iforest(df: DataFrame, cols: Sequence[str] | None = None, contamination: float = 0.1, trees: int = 100,
                     sample: int = 256, seed: int = 42, min_rows: int = 100) -> DataFrame:
    """Output (long): column_name, value, score for the flagged values."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column_name string, value double, score double")
    if not cols:
        return empty
    items = [F.struct(F.lit(c).alias("column_name"), nan_to_null(q(c).cast("double"), T.DoubleType()).alias("x"))
             for c in cols]
    row = F.xxhash64(*[q(c) for c in df.columns])
    lv = df.select(row.alias("__row"), F.inline(F.array(*items))).where(F.col("x").isNotNull())
    counts = {r["column_name"]: r["n"] for r in lv.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = [c for c in cols if counts.get(c, 0) > min_rows]
    if not keep:
        return empty
    lv = lv.where(F.col("column_name").isin(keep))
    # 1. per-tree samples. Every value draws a slot in [0, M) with M = n / (3 * sample),
    #    so each slot holds ~3 * sample candidates; slot s of copy r feeds tree r * M + s.
    #    Copies r = ceil(trees / M): rows generated ~ max(n, 3 * trees * sample), never
    #    n * trees. The first ``sample`` candidates (random order) of a tree are kept.
    slots = {c: max(1, counts[c] // (3 * sample)) for c in keep}
    copies = {c: int(math.ceil(trees / slots[c])) for c in keep}
    m_map = F.create_map(*[x for c in keep for x in (F.lit(c), F.lit(slots[c]))])
    r_map = F.create_map(*[x for c in keep for x in (F.lit(c), F.lit(copies[c]))])
    offered = lv.withColumn("__m", m_map[F.col("column_name")]) \
        .select("column_name", "x", "__row", "__m", F.explode(F.sequence(F.lit(0), r_map[F.col("column_name")] - 1)).alias("__r"))
    offered = offered.withColumn("__u", F.shiftrightunsigned(F.xxhash64("__row", "column_name", "__r", F.lit(seed)), 11) / float(1 << 53)) \
        .withColumn("tree", (F.col("__r") * F.col("__m") + F.floor(F.col("__u") * F.col("__m"))).cast("long")) \
        .where(F.col("tree") < trees).withColumn("tree", F.col("tree").cast("int"))
    w = Window.partitionBy("column_name", "tree").orderBy("__u", "x")
    samp = offered.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= sample) \
        .select("column_name", "tree", "x")
    forest = _forest(samp, trees, sample, seed).collect()  # trees x sample numbers per column: bounded
    by_col: dict[str, list] = {}
    for r in forest:
        by_col.setdefault(r["column_name"], []).append((np.asarray(r["cuts"], float), np.asarray(r["heights"], float)))
    norm = {c: avg_path(min(sample, counts[c])) for c in keep}

    @F.pandas_udf(T.DoubleType())
    def score(col: pd.Series, x: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        xs = x.to_numpy(dtype=float)
        cs = col.to_numpy()
        for c in np.unique(cs):
            m = cs == c
            fs = by_col.get(c, [])
            h = np.zeros(m.sum())
            for cuts, heights in fs:
                h += heights[np.searchsorted(cuts, xs[m], side="left")]
            out[m] = 2.0 ** (-(h / max(len(fs), 1)) / norm[c])
        return pd.Series(out)

    scored = lv.withColumn("score", score(F.col("column_name"), F.col("x")))
    thr = exact_quantiles(scored, "score", [1.0 - contamination], ["column_name"], split_groups=["column_name"]).collect()
    t = {r["column_name"]: r["q"] for r in thr}
    tm = F.create_map(*[x for c, v in t.items() for x in (F.lit(c), F.lit(v))])
    return scored.where(F.col("score") > tm[F.col("column_name")]).select("column_name", F.col("x").alias("value"), "score")
