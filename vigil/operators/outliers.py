"""Outlier detection.

Fences come from one aggregate job (exact quartiles or mean/std for all columns at
once); the scalars are then literals in a single filtering/counting pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import is_inf, nan_to_null, numeric_columns, q


def _x(c: str):
    return nan_to_null(q(c).cast("double"), T.DoubleType())


def _finite(c: str):
    """The value, NULL for a missing or infinite one: an infinity has no z-score, and in a mean it would leave none to
    the others (NaN is above every threshold in Spark)."""
    return F.when(~is_inf(_x(c)), _x(c))


def iqr_fences(df: DataFrame, cols: Sequence[str]) -> dict:
    from .profile import quantile_table
    rows = quantile_table(df, cols, [0.25, 0.75]).collect()
    qs: dict = {}
    for r in rows:
        qs.setdefault(r["column_name"], {})[r["p"]] = r["q"]
    out = {}
    for c in cols:
        if c in qs:
            q1, q3 = qs[c][0.25], qs[c][0.75]
            out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def zscore_bounds(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> dict:
    """Mean and population std of the finite values of every column, one aggregate."""
    a = df.agg(*[F.avg(_finite(c)).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(_finite(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (a[f"m{i}"], a[f"s{i}"]) for i, c in enumerate(cols)}


def _flag_iqr(c, fences):
    lo, hi = fences[c]
    return (_x(c) < lo) | (_x(c) > hi)


def _flag_z(c, bounds, threshold):
    m, s = bounds[c]
    if s is None or s == 0:
        return F.lit(False)
    return F.abs((_finite(c) - F.lit(m)) / F.lit(s)) > threshold


def outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """O1: values strictly outside [q1 - 1.5 IQR, q3 + 1.5 IQR] (linear quartiles).
    Output (long): column_name, value."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    fences = iqr_fences(df, cols)
    items = [F.when(_flag_iqr(c, fences), F.struct(F.lit(c).alias("column_name"), _x(c).alias("value")))
             for c in cols if c in fences]
    return df.select(F.inline(F.filter(F.array(*items), lambda s: s.isNotNull())))


def outliers_zscore(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """O2: |x - mean| / std > 3 with the population std (std = 0 -> none), over the finite values; infinite ones
    have no z-score (``profile`` counts them, ``fix_infinite`` replaces them).
    Output (long): column_name, value, z."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    b = zscore_bounds(df, cols)
    items = []
    for c in cols:
        m, s = b[c]
        if s is None or s == 0:
            continue
        z = (_finite(c) - F.lit(m)) / F.lit(s)
        items.append(F.when(F.abs(z) > threshold, F.struct(F.lit(c).alias("column_name"), _x(c).alias("value"),
                                                            z.alias("z"))))
    if not items:
        return df.sparkSession.createDataFrame([], "column_name string, value double, z double")
    return df.select(F.inline(F.filter(F.array(*items), lambda s: s.isNotNull())))


def outlier_summary(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 3.0,
                    with_iforest: bool = True) -> DataFrame:
    """Per column x method (iqr, zscore, isolation_forest): count and % of the
    non-missing values. IQR and z-score counts come from one counting pass."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    fences = iqr_fences(df, cols)
    bounds = zscore_bounds(df, cols, threshold)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(_x(c)).alias(f"n{i}"),
                 F.sum(F.when(_flag_iqr(c, fences), 1).otherwise(0) if c in fences else F.lit(0)).alias(f"i{i}"),
                 F.sum(F.when(_flag_z(c, bounds, threshold), 1).otherwise(0)).alias(f"z{i}")]
    a = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        for method, col in (("iqr", f"i{i}"), ("zscore", f"z{i}")):
            items.append(F.struct(F.lit(c).alias("column_name"), F.lit(method).alias("method"),
                                  F.col(col).cast("long").alias("n_outliers"),
                                  F.when(F.col(f"n{i}") > 0, F.col(col) / F.col(f"n{i}") * 100.0).alias("pct_outliers")))
    out = a.select(F.inline(F.array(*items)))
    if with_iforest:
        from .iforest import outliers_iforest
        iso = outliers_iforest(df, cols)
        cnt = iso.groupBy("column_name").agg(F.count(F.lit(1)).alias("k"))
        tot = a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"))
                                          for i, c in enumerate(cols)])))
        iso_rows = tot.join(cnt, "column_name", "left").select(
            "column_name", F.lit("isolation_forest").alias("method"),
            F.coalesce(F.col("k"), F.lit(0)).cast("long").alias("n_outliers"),
            F.when(F.col("n") > 0, F.coalesce(F.col("k"), F.lit(0)) / F.col("n") * 100.0).alias("pct_outliers"))
        out = out.unionByName(iso_rows)
    return out
