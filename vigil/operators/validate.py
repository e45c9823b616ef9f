"""Table, target and split validation (V1-V9).

Each check is an aggregate over the table (one pass) whose single result row is
turned into one row per check with ``inline``; nothing row-level reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import is_float_type, is_inf, is_missing, is_numeric_type, nan_to_null, q, to_numeric

CLASSIFICATION = "classification"
REGRESSION = "regression"
HIGH_CARDINALITY = 100


def _check(name: str, passed: Column, value: Column, threshold) -> Column:
    return F.struct(F.lit(name).alias("check"), passed.alias("passed"), value.cast("double").alias("value"),
                    F.lit(threshold).cast("double").alias("threshold"))


def validate_table(df: DataFrame, min_rows: int = 1, min_cols: int = 1) -> DataFrame:
    """V1: enough rows, enough columns, not entirely NULL. Output: check, passed,
    value, threshold."""
    fields = df.schema.fields
    non_null = sum((F.count(nan_to_null(q(f.name), f.dataType)) for f in fields), F.lit(0))
    a = df.agg(F.count(F.lit(1)).alias("n"), non_null.alias("nn"))
    return a.select(F.inline(F.array(
        _check("min_rows", F.col("n") >= min_rows, F.col("n"), min_rows),
        _check("min_columns", F.lit(len(fields) >= min_cols), F.lit(len(fields)), min_cols),
        _check("not_all_null", F.col("nn") > 0, F.col("nn"), 1))))


def validate_target(df: DataFrame, target: str) -> DataFrame:
    """V2: target exists, is not all NULL and has at least two distinct values."""
    spark = df.sparkSession
    schema = "check string, passed boolean, value double, threshold double"
    if target not in df.columns:
        return spark.createDataFrame([("target_exists", False, 0.0, 1.0)], schema)
    dt = df.schema[target].dataType
    x = nan_to_null(q(target), dt)
    # distinct count through a groupBy (partial aggregation map-side)
    d = df.groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    a = d.agg(F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("nn"), F.count("v").alias("nd"))
    return a.select(F.inline(F.array(
        _check("target_exists", F.lit(True), F.lit(1), 1),
        _check("target_not_all_null", F.coalesce(F.col("nn"), F.lit(0)) > 0, F.coalesce(F.col("nn"), F.lit(0)), 1),
        _check("target_two_classes", F.col("nd") >= 2, F.col("nd"), 2))))


def validate_split(df: DataFrame, label: str = "label", split_col: str = "split",
                   features: Sequence[str] | None = None) -> DataFrame:
    """V3: train and test non-empty, every row has a label, no +/-inf in train numeric
    features."""
    feats = list(features) if features is not None else [
        f.name for f in df.schema.fields if f.name not in (label, split_col) and is_float_type(f.dataType)]
    train = F.col(split_col) == "train"
    test = F.col(split_col) == "test"
    inf_any = F.lit(False)
    for c in feats:
        inf_any = inf_any | F.coalesce(is_inf(q(c)), F.lit(False))
    a = df.agg(F.sum(F.when(train, 1).otherwise(0)).alias("ntr"), F.sum(F.when(test, 1).otherwise(0)).alias("nte"),
               F.sum(F.when(q(label).isNull(), 1).otherwise(0)).alias("nol"),
               F.sum(F.when(train & inf_any, 1).otherwise(0)).alias("ninf"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.select(F.inline(F.array(
        _check("train_not_empty", z("ntr") > 0, z("ntr"), 1),
        _check("test_not_empty", z("nte") > 0, z("nte"), 1),
        _check("labels_match_rows", z("nol") == 0, z("nol"), 0),
        _check("train_no_infinite", z("ninf") == 0, z("ninf"), 0))))


def _missing_and_infinite(df: DataFrame) -> DataFrame:
    """column_name, n_rows, n_missing, n_infinite of every column, from one aggregate; no row for an empty table."""
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema.fields):
        c = q(f.name)
        aggs += [F.count_if(is_missing(c, f.dataType)).alias(f"m{i}"),
                 (F.count_if(is_inf(c)) if is_float_type(f.dataType) else F.lit(0).cast("long")).alias(f"i{i}")]
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.col("n").alias("n_rows"),
                             F.col(f"m{i}").alias("n_missing"), F.col(f"i{i}").alias("n_infinite")))
    return df.agg(*aggs).where("n > 0").select(F.inline(F.array(*rows)))


def quality_flags(df: DataFrame, high_cardinality: int = HIGH_CARDINALITY) -> DataFrame:
    """V4: has_missing, has_duplicates, has_high_cardinality (string column with more
    than 100 distinct values) and the missing % of every column (sorted desc).
    Output: flag, column_name, value."""
    from .profile import count_duplicates, distinct_at_most
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    high = any(n > high_cardinality for n in distinct_at_most(df, high_cardinality, strings).values())
    ndup = count_duplicates(df).first()["n_duplicates"]
    cols = _missing_and_infinite(df)
    per_col = cols.select(F.lit("pct_missing").alias("flag"), "column_name",
                          F.round(F.col("n_missing") / F.col("n_rows") * 100.0, 2).alias("value"))

    def flag(name, value):
        return F.struct(F.lit(name).alias("flag"), F.lit(None).cast("string").alias("column_name"), value.cast("double").alias("value"))

    filled = cols.agg(F.max(F.col("n_missing") > 0).alias("m"))
    table = filled.select(F.inline(F.array(
        flag("has_missing", F.col("m")), flag("has_duplicates", F.lit(ndup > 0)),
        flag("has_high_cardinality", F.when(F.col("m").isNotNull(), F.lit(high))))))
    return table.unionByName(per_col)


def premodel_checks(df: DataFrame, target: str, high_cardinality: int = HIGH_CARDINALITY) -> DataFrame:
    """V5: errors (no feature, empty target) and warnings (columns with missing
    values, string columns with > 100 distinct values, columns with +/-inf).
    Output: level, check, column_name, value."""
    spark = df.sparkSession
    schema = "level string, check string, column_name string, value bigint"
    feats = [c for c in df.columns if c != target]
    errors = []
    if not feats:
        errors.append(("error", "no_features", None, 0))
    if target not in df.columns:
        errors.append(("error", "no_target", target, 0))
        return spark.createDataFrame(errors, schema)
    from .profile import distinct_at_most, distinct_counts
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != target]
    dc = _missing_and_infinite(df)
    # only the columns that are named with their count are counted in full
    many = [c for c, n in distinct_at_most(df, high_cardinality, strings).items() if n > high_cardinality]
    if many:
        full = distinct_counts(df.select(*[q(c) for c in many])).select("column_name", "n_distinct")
        dc = dc.join(F.broadcast(full), "column_name", "left")  # a row a column
    else:
        dc = dc.withColumn("n_distinct", F.lit(0).cast("long"))
    out = dc.select(F.inline(F.array(
        F.when((F.col("column_name") == target) & (F.col("n_rows") - F.col("n_missing") == 0),
               F.struct(F.lit("error").alias("level"), F.lit("empty_target").alias("check"),
                        F.col("column_name"), F.lit(0).cast("long").alias("value"))),
        F.when((F.col("column_name") != target) & (F.col("n_missing") > 0),
               F.struct(F.lit("warning").alias("level"), F.lit("missing_values").alias("check"), F.col("column_name"),
                        F.col("n_missing").cast("long").alias("value"))),
        F.when(F.col("column_name").isin(many) & (F.col("n_distinct") > high_cardinality) if many else F.lit(False),
               F.struct(F.lit("warning").alias("level"), F.lit("high_cardinality").alias("check"), F.col("column_name"),
                        F.col("n_distinct").cast("long").alias("value"))),
        F.when((F.col("column_name") != target) & (F.col("n_infinite") > 0),
               F.struct(F.lit("warning").alias("level"), F.lit("infinite_values").alias("check"), F.col("column_name"),
                        F.col("n_infinite").cast("long").alias("value"))),
    ))).where(F.col("level").isNotNull())
    if errors:
        out = out.unionByName(spark.createDataFrame(errors, schema))
    return out


def clean_target(df: DataFrame, target: str, action: str = "drop") -> DataFrame:
    """V6: rows with a missing target dropped (``drop``) or filled with the mean
    (numeric) / mode (other) (``impute``); +/-inf targets replaced by the median."""
    from .correct import column_means, column_medians, column_modes
    dt = df.schema[target].dataType
    c = q(target)
    if action == "drop":
        out = df.where(~is_missing(c, dt))
    elif action == "impute":
        if is_numeric_type(dt):
            v = column_means(df, [target])[target]
        else:
            v = column_modes(df, [target])[target]
        out = df.withColumn(target, F.when(is_missing(c, dt), F.lit(v).cast(dt)).otherwise(c)) if v is not None else df
    else:
        raise ValueError("action must be 'drop' or 'impute'")
    if is_float_type(dt):
        has_inf = out.where(is_inf(q(target))).limit(1).count() > 0
        if has_inf:
            finite = out.withColumn(target, F.when(~is_inf(q(target)), q(target)))
            med = column_medians(finite, [target])[target]
            out = out.withColumn(target, F.when(is_inf(q(target)), F.lit(med).cast(dt)).otherwise(q(target)))
    return out


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """V7: string target, or <= 20 distinct values with distinct/rows < 0.1 ->
    classification, else regression. Output: one row (task, n_distinct, n_rows)."""
    dt = df.schema[target].dataType
    x = nan_to_null(q(target), dt)
    d = df.groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    a = d.agg(F.count("v").alias("nd"), F.sum("c").alias("n"))
    is_text = not is_numeric_type(dt)
    cls = F.lit(is_text) | ((F.col("nd") <= 20) & (F.col("nd") / F.col("n") < 0.1))
    return a.select(F.when(cls, F.lit(CLASSIFICATION)).otherwise(F.lit(REGRESSION)).alias("task"),
                    F.col("nd").cast("long").alias("n_distinct"), F.col("n").cast("long").alias("n_rows"))


def detect_eval_task(df: DataFrame, y: str) -> DataFrame:
    """V8: string, or numeric with < 20 distinct values all integral ->
    classification. Output: one row (task, n_distinct, all_integral)."""
    dt = df.schema[y].dataType
    x = nan_to_null(q(y), dt)
    d = df.groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    if is_numeric_type(dt):
        integral = F.coalesce(F.bool_and(F.when(F.col("v").isNotNull(), F.col("v").cast("double") % 1 == 0)), F.lit(True))
    else:
        integral = F.lit(False)
    a = d.agg(F.count("v").alias("nd"), integral.alias("ai"))
    cls = F.lit(not is_numeric_type(dt)) | ((F.col("nd") < 20) & F.col("ai"))
    return a.select(F.when(cls, F.lit(CLASSIFICATION)).otherwise(F.lit(REGRESSION)).alias("task"),
                    F.col("nd").cast("long").alias("n_distinct"), F.col("ai").alias("all_integral"))


def target_summary(df: DataFrame, target: str, task: str) -> DataFrame:
    """V9: valid rows, distinct values, and the mean (numeric regression target) or
    the mode (smallest on ties). Output: one row (n_valid, n_distinct, statistic, value)."""
    dt = df.schema[target].dataType
    x = nan_to_null(q(target), dt)
    d = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    if task == REGRESSION and is_numeric_type(dt):
        stat, val = F.lit("mean"), (F.sum(F.col("v").cast("double") * F.col("c")) / F.sum("c")).cast("string")
    else:
        stat, val = F.lit("mode"), F.min_by(F.col("v"), F.struct(-F.col("c"), F.col("v"))).cast("string")
    return d.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n_valid"),
                 F.count("v").cast("long").alias("n_distinct"), stat.alias("statistic"), val.alias("value"))
