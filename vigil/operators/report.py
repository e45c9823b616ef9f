"""Report tables.

Each section is a dict of DataFrames; ``to_long`` turns any of them into the long
layout (section, item, row_no, key, value) so all sections can be written as one
table partitioned by section. Section tables are small (aggregates, previews, top-k),
except the correction log, which is written as it is (it is already long).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import q

SECTIONS = ["data", "preprocessing", "model", "evaluation"]


def _metric_rows(spark, items: Sequence[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in items], "metric string, value double")


# --------------------------------------------------------------------------- R1
def data_section(df: DataFrame, order_by: str | None = None, n_preview: int = 5) -> dict[str, DataFrame]:
    """Table size and missing cells, first rows, describe, missing by column."""
    from .profile import describe
    from .rules import missing_overview
    mo = missing_overview(df)
    summary = mo.where(F.col("column_name") == "*").select(
        F.inline(F.array(
            F.struct(F.lit("rows").alias("metric"), (F.col("n_cells") / F.lit(max(len(df.columns), 1))).alias("value")),
            F.struct(F.lit("columns").alias("metric"), F.lit(float(len(df.columns))).alias("value")),
            F.struct(F.lit("missing_cells").alias("metric"), F.col("n_missing").cast("double").alias("value")),
            F.struct(F.lit("missing_pct").alias("metric"), F.col("pct_missing").cast("double").alias("value")))))
    preview = (df.orderBy(q(order_by)) if order_by else df).limit(n_preview)
    return {"summary": summary, "preview": preview, "describe": describe(df),
            "missing": mo.where(F.col("column_name") != "*")}


# --------------------------------------------------------------------------- R2
def preprocessing_section(before: DataFrame, after: DataFrame, log: DataFrame | None = None) -> dict[str, DataFrame]:
    """R2: rows before/after, rows removed and their share, plus the correction log."""
    # both counts from one aggregate over the tagged union (no join of two scalars)
    tagged = before.select(F.lit(1).alias("__b")).unionByName(after.select(F.lit(0).alias("__b")))
    a = tagged.agg(F.coalesce(F.sum("__b"), F.lit(0)).alias("b"), F.coalesce(F.sum(1 - F.col("__b")), F.lit(0)).alias("a"))
    summary = a.select(F.inline(F.array(
        F.struct(F.lit("rows_before").alias("metric"), F.col("b").cast("double").alias("value")),
        F.struct(F.lit("rows_after").alias("metric"), F.col("a").cast("double").alias("value")),
        F.struct(F.lit("rows_removed").alias("metric"), (F.col("b") - F.col("a")).cast("double").alias("value")),
        F.struct(F.lit("rows_removed_pct").alias("metric"),
                 F.coalesce(F.round(F.try_divide(F.col("b") - F.col("a"), F.col("b")) * 100.0, 2), F.lit(0.0)).alias("value")))))
    out = {"summary": summary}
    if log is not None:
        out["log"] = log
    return out


# --------------------------------------------------------------------------- R3
def model_section(name: str, task: str, data: DataFrame, importance: DataFrame | None = None,
                  split_col: str = "split") -> dict[str, DataFrame]:
    """Model name, task, split sizes, top-10 importance."""
    spark = data.sparkSession
    info = spark.createDataFrame([("model", name), ("task", task)], "item string, value string")
    sizes = data.groupBy(split_col).agg(F.count(F.lit(1)).cast("long").alias("n"))
    out = {"info": info, "split_sizes": sizes}
    if importance is not None:
        out["importance"] = importance
    return out


# --------------------------------------------------------------------------- R4
def evaluation_section(pred: DataFrame, task: str) -> dict[str, DataFrame]:
    """Metrics, plus the confusion matrix (classification) or the residual
    histogram and prediction range (regression)."""
    from .evaluate import (classification_metrics, confusion_matrix, prediction_range, regression_metrics,
                           residual_histogram)
    if task == "classification":
        return {"metrics": classification_metrics(pred), "confusion": confusion_matrix(pred)}
    return {"metrics": regression_metrics(pred), "residual_histogram": residual_histogram(pred),
            "range": prediction_range(pred)}


# --------------------------------------------------------------------------- R5
def to_long(section: str, item: str, df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per (table row, column): section, item, row_no, key, value (string).
    Meant for the small report tables; the row number comes from a distributed rank
    over the given order (or the first column)."""
    from ..functions.ranking import row_number
    cols = df.columns
    k = q(order_by[0]).cast("double") if order_by else F.xxhash64(*[q(c) for c in cols]).cast("double")
    d = row_number(df.withColumn("__k", k), "__k", name="row_no")
    items = [F.struct(F.lit(c).alias("key"), q(c).cast("string").alias("value")) for c in cols]
    return d.select(F.lit(section).alias("section"), F.lit(item).alias("item"), F.col("row_no").cast("long"),
                    F.inline(F.array(*items)))


def report_table(tables: Mapping[str, Mapping[str, DataFrame]], sections: Sequence[str] | None = None) -> DataFrame:
    """The chosen sections as one long table."""
    out = None
    for sec in sections or SECTIONS:
        for item, df in tables.get(sec, {}).items():
            part = to_long(sec, item, df)
            out = part if out is None else out.unionByName(part)
    return out


def safe_title(title: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", title).strip("_") or "report"


def write_report(tables: Mapping[str, Mapping[str, DataFrame]], path: str, sections: Sequence[str] | None = None,
                 title: str = "report", fmt: str = "parquet") -> str:
    """Write the long table partitioned by section under ``path/<safe title>``."""
    target = f"{path.rstrip('/')}/{safe_title(title)}"
    report_table(tables, sections).write.mode("overwrite").partitionBy("section").format(fmt) \
        .option("header", True).save(target)
    return target
