"""Row and column selections as operators (P2, P9, P10, P12, P13), each with what it removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalize_missing, q


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(features, target) of a table; a target that does not exist raises."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r}")
    return df.select(*[q(c) for c in df.columns if c != target]), df.select(q(target))


def drop_missing_rows(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without a missing value (NULL or NaN) in ``cols`` (all by default), and a one-row log
    (rows_before, rows_after, rows_removed)."""
    d = normalize_missing(df)
    cols = list(cols) if cols is not None else d.columns
    whole = F.lit(True)
    for c in cols:
        whole = whole & q(c).isNotNull()
    kept = F.coalesce(F.sum(F.when(whole, 1).otherwise(0)), F.lit(0)).cast("long")
    log = d.agg(F.count(F.lit(1)).alias("rows_before"), kept.alias("rows_after")) \
        .withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
    return d.where(whole), log


def drop_columns(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """P10: the table without ``cols``, and a log (column_name, dropped): a name that does not exist is
    logged and skipped."""
    gone = set(cols)
    log = df.sparkSession.createDataFrame([(c, c in df.columns) for c in cols], "column_name string, dropped boolean")
    return df.select(*[q(c) for c in df.columns if c not in gone]), log


def preview(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows, by ``order_by`` if given."""
    return (df.orderBy(q(order_by)) if order_by else df).limit(n)


def sample_rows(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """The rows whose seeded hash of ``key`` falls below ``fraction``: the same rows on every run and
    partitioning, without a shuffle."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(q(c).cast("string"), F.lit("")) for c in key])
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return df.where(u < fraction)
