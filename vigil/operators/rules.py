"""Data-dictionary rules: validation (D1), normalisation (D2), one-pass anomaly
detection (D3-D9), summaries (D10-D12).

The rule table is small (one row per rule); it is collected once and compiled into
Column expressions. The data table is scanned once: every row builds an array of
anomaly structs (NULL where a check passes), the NULLs are filtered out and the array
is exploded. No per-rule scan, no join.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (EMAIL_PATTERN, is_missing, in_set, matches, q, to_date_fmt, to_numeric,
                               value_text, is_numeric_type, is_float_type)
from ..sources.fixtures import RULE_COLUMNS

# Dictionary vocabulary (the data format of the rule table).
RULE_TYPES = ["numerique", "categorique", "texte", "date"]
REQUIRED_VALUES = ["oui", "non", "yes", "no", "1", "0", "true", "false"]
REQUIRED_YES = ["oui", "yes", "1", "true", "o", "y"]
REQUIRED_NO = ["non", "no", "0", "false", "n"]
ACTIONS = ["imputer_moyenne", "imputer_mediane", "imputer_mode", "mettre_vide", "supprimer_ligne", "ignorer"]
DEFAULT_DATE_FORMAT = "%Y-%m-%d"

ANOMALY_SCHEMA = T.StructType([
    T.StructField("row_key", T.LongType(), True),
    T.StructField("column_name", T.StringType(), True),
    T.StructField("anomaly", T.StringType(), True),
    T.StructField("actual_value", T.StringType(), True),
    T.StructField("expected", T.StringType(), True),
    T.StructField("action", T.StringType(), True),
])

RULE_ERROR_SCHEMA = T.StructType([
    T.StructField("line", T.LongType(), True),
    T.StructField("column_name", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
])

_NUM_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


# --------------------------------------------------------------------------- D1
def _with_line(rules: DataFrame) -> DataFrame:
    """Rule line number as in the spreadsheet: header is line 1, first rule line 2.
    The rule table is small (one row per rule), so a window over its file order
    (``monotonically_increasing_id`` grows with partition and row position) is fine."""
    if "line" in rules.columns:
        return rules
    w = Window.orderBy("__mid")
    return (rules.withColumn("__mid", F.monotonically_increasing_id())
            .withColumn("line", (F.row_number().over(w) + 1).cast("long")).drop("__mid"))


def validate_rules(rules: DataFrame) -> DataFrame:
    """One row per problem found in the rule table (empty when the table is fine)."""
    spark = rules.sparkSession
    missing = [c for c in RULE_COLUMNS if c not in rules.columns]
    if missing:
        return spark.createDataFrame([(None, c, "missing_rule_column", None) for c in missing], RULE_ERROR_SCHEMA)
    r = _with_line(rules)
    name = F.col("Colonne")
    typ = F.lower(F.trim(F.col("Type")))
    req = F.lower(F.trim(F.col("Obligatoire")))
    act = F.lower(F.trim(F.col("Action_Si_Anomalie")))
    mn = F.regexp_replace(F.col("Min"), ",", ".")
    mx = F.regexp_replace(F.col("Max"), ",", ".")
    allowed = F.trim(F.col("Valeurs_Autorisées"))
    is_num = typ == "numerique"
    is_date = typ == "date"
    mn_d, mx_d = F.trim(mn).try_cast("double"), F.trim(mx).try_cast("double")
    mn_t = F.try_to_timestamp(F.trim(F.col("Min")))
    mx_t = F.try_to_timestamp(F.trim(F.col("Max")))

    def err(cond: Column, code: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(code).alias("error"), value.cast("string").alias("value")))

    checks = [
        err(name.isNull(), "empty_column_name", F.lit(None)),
        err(F.col("Type").isNull(), "missing_type", F.lit(None)),
        err(F.col("Type").isNotNull() & ~typ.isin(RULE_TYPES), "invalid_type", F.col("Type")),
        err(F.col("Obligatoire").isNull(), "missing_required", F.lit(None)),
        err(F.col("Obligatoire").isNotNull() & ~req.isin(REQUIRED_VALUES), "invalid_required", F.col("Obligatoire")),
        err(F.col("Action_Si_Anomalie").isNull(), "missing_action", F.lit(None)),
        err(F.col("Action_Si_Anomalie").isNotNull() & ~act.isin(ACTIONS), "invalid_action", F.col("Action_Si_Anomalie")),
        err(is_num & F.col("Min").isNotNull() & ~mn.rlike(_NUM_TEXT), "min_not_number", F.col("Min")),
        err(is_num & F.col("Max").isNotNull() & ~mx.rlike(_NUM_TEXT), "max_not_number", F.col("Max")),
        err(is_num & mn.rlike(_NUM_TEXT) & mx.rlike(_NUM_TEXT) & (mn_d >= mx_d), "min_not_below_max",
            F.concat_ws(" >= ", F.col("Min"), F.col("Max"))),
        err(is_date & F.col("Min").isNotNull() & mn_t.isNull(), "min_not_date", F.col("Min")),
        err(is_date & F.col("Max").isNotNull() & mx_t.isNull(), "max_not_date", F.col("Max")),
        err(is_date & (mn_t >= mx_t), "min_not_below_max", F.concat_ws(" >= ", F.col("Min"), F.col("Max"))),
        err((typ == "categorique") & allowed.isNotNull() & (F.length(allowed) > 0) & ~allowed.contains(","),
            "single_allowed_value", allowed),
    ]
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return (r.select(F.col("line").cast("long").alias("line"), name.alias("column_name"), F.inline(arr))
            .select("line", "column_name", "error", "value"))


# --------------------------------------------------------------------------- D2
def normalize_rules(rules: DataFrame) -> DataFrame:
    """lower/trim type and action, yes/no vocabulary -> oui/non, decimal comma ->
    dot, trimmed list items and format. Unrecognised values are kept as they are."""
    req = F.lower(F.trim(F.col("Obligatoire")))
    items = F.transform(F.split(F.col("Valeurs_Autorisées"), ","), lambda v: F.trim(v))
    out = {
        "Colonne": F.col("Colonne"),
        "Type": F.lower(F.trim(F.col("Type"))),
        "Obligatoire": F.when(req.isin(REQUIRED_YES), F.lit("oui")).when(req.isin(REQUIRED_NO), F.lit("non"))
                        .otherwise(F.col("Obligatoire")),
        "Valeurs_Autorisées": F.when(F.col("Valeurs_Autorisées").isNotNull(), F.array_join(items, ",")),
        "Min": F.regexp_replace(F.col("Min"), ",", "."),
        "Max": F.regexp_replace(F.col("Max"), ",", "."),
        "Format": F.trim(F.col("Format")),
        "Action_Si_Anomalie": F.lower(F.trim(F.col("Action_Si_Anomalie"))),
    }
    extra = [F.col(f"`{c}`") for c in rules.columns if c not in out]
    return rules.select(*[v.alias(k) for k, v in out.items()], *extra)


# --------------------------------------------------------------------------- compile
@dataclass
class Rule:
    column: str
    type: str | None
    required: bool
    allowed: list[str] | None
    min: str | None
    max: str | None
    format: str | None
    action: str | None
    position: int = 0


@dataclass
class Check:
    column: str
    code: str
    cond: Column
    actual: Column
    expected: str
    action: str | None
    rule: Rule = field(repr=False, default=None)


def load_rule_list(rules: DataFrame | list) -> list[Rule]:
    """Collect the (small) normalised rule table into Rule objects, in table order."""
    if isinstance(rules, list):
        return rules
    # the rule table is collected once (tens of rows); file order kept by the row id
    rows = normalize_rules(rules).withColumn("__mid", F.monotonically_increasing_id()).collect()
    rows.sort(key=lambda r: r["__mid"])
    out = []
    for i, r in enumerate(rows):
        allowed = r["Valeurs_Autorisées"]
        out.append(Rule(
            column=r["Colonne"], type=r["Type"], required=(r["Obligatoire"] == "oui"),
            allowed=[v.strip() for v in allowed.split(",")] if allowed is not None else None,
            min=r["Min"], max=r["Max"], format=r["Format"], action=r["Action_Si_Anomalie"], position=i))
    return out


def _fmt_float(s: str) -> str:
    return repr(float(s))


def _parse_date_literal(s: str) -> _dt.datetime:
    s = s.strip()
    try:
        return _dt.datetime.fromisoformat(s)
    except ValueError as exc:
        raise ValueError(f"date rule bound {s!r} is not a date") from exc


def compile_checks(df: DataFrame, rules: list[Rule]) -> tuple[list[Check], list[Rule]]:
    """Rule list -> row-level checks on ``df``; also returns rules whose column is absent."""
    checks: list[Check] = []
    absent: list[Rule] = []
    for rule in rules:
        if rule.column is None:
            continue
        if rule.column not in df.columns:
            absent.append(rule)
            continue
        dt = df.schema[rule.column].dataType
        c = q(rule.column)
        present = ~is_missing(c, dt)
        shown = value_text(c, dt)
        typ = (rule.type or "").lower()

        def add(code, cond, expected, actual=shown):
            checks.append(Check(rule.column, code, cond, actual, expected, rule.action, rule))

        if rule.required:
            add("missing", is_missing(c, dt), "required value", F.lit(None).cast("string"))
        if typ == "numerique":
            pre = f"__num__{rule.column}"
            num = q(pre) if pre in df.columns else to_numeric(c, dt)
            if not is_numeric_type(dt):
                add("not_numeric", present & num.isNull(), "numeric value")
            if rule.min is not None:
                add("below_min", num < F.lit(float(rule.min)), f">= {_fmt_float(rule.min)}")
            if rule.max is not None:
                add("above_max", num > F.lit(float(rule.max)), f"<= {_fmt_float(rule.max)}")
        elif typ == "categorique":
            if rule.allowed is not None:
                add("not_allowed", present & ~in_set(c, rule.allowed), "one of: " + ", ".join(rule.allowed))
        elif typ == "texte":
            fmt = rule.format
            if fmt is not None:
                if fmt.lower() == "email":
                    add("bad_format", present & ~c.cast("string").rlike(EMAIL_PATTERN), "format: email")
                elif fmt.startswith("^"):
                    add("bad_format", present & ~matches(c, fmt), f"format: {fmt}")
        elif typ == "date":
            fmt = rule.format or DEFAULT_DATE_FORMAT
            pre = f"__dt__{rule.column}"
            parsed = q(pre) if pre in df.columns else to_date_fmt(c, dt, fmt)
            add("bad_date", present & parsed.isNull(), f"format: {fmt}")
            # bounds are validated on the driver and compared as session-time-zone
            # timestamps, like the parsed values
            if rule.min is not None:
                lo = _parse_date_literal(rule.min).isoformat(sep=" ")
                add("date_below_min", parsed < F.to_timestamp(F.lit(lo)), f">= {rule.min}")
            if rule.max is not None:
                hi = _parse_date_literal(rule.max).isoformat(sep=" ")
                add("date_above_max", parsed > F.to_timestamp(F.lit(hi)), f"<= {rule.max}")
    return checks, absent


def add_typed_values(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the numeric / parsed-date form of every checked column once per row
    (``__num__<col>``, ``__dt__<col>``); the checks then read these columns instead
    of re-parsing the text in every check."""
    new = {}
    for rule in rules:
        if rule.column is None or rule.column not in df.columns:
            continue
        dt = df.schema[rule.column].dataType
        typ = (rule.type or "").lower()
        if typ == "numerique" and (rule.min is not None or rule.max is not None or not is_numeric_type(dt)):
            new[f"__num__{rule.column}"] = to_numeric(q(rule.column), dt)
        elif typ == "date":
            new[f"__dt__{rule.column}"] = to_date_fmt(q(rule.column), dt, rule.format or DEFAULT_DATE_FORMAT)
    return df.withColumns(new) if new else df


def _anomaly_struct(ch: Check) -> Column:
    return F.struct(F.lit(ch.column).alias("column_name"), F.lit(ch.code).alias("anomaly"),
                    ch.actual.cast("string").alias("actual_value"), F.lit(ch.expected).alias("expected"),
                    F.lit(ch.action).cast("string").alias("action"))


def anomaly_array(checks: list[Check]) -> Column:
    if not checks:
        return F.array().cast(T.ArrayType(ANOMALY_SCHEMA[1:]))
    return F.filter(F.array(*[F.when(ch.cond, _anomaly_struct(ch)) for ch in checks]), lambda x: x.isNotNull())


def key_column(df: DataFrame, key) -> tuple[DataFrame, Column]:
    """Row key as bigint: given column(s) (first one used as the key value) or the
    1-based file line from ``with_row_key``."""
    if key is None:
        from ..sources.files import with_row_key
        df = with_row_key(df, name="__row_key")
        return df, F.col("__row_key")
    if isinstance(key, (list, tuple)):
        key = key[0]
    return df, q(key).cast("long")


# --------------------------------------------------------------------------- D9
def detect_anomalies(df: DataFrame, rules: DataFrame | list, key=None) -> DataFrame:
    """All rules in one scan, long output (row_key, column_name, anomaly,
    actual_value, expected, action). Fixed schema, also when nothing is found."""
    rule_list = load_rule_list(rules)
    d, k = key_column(df, key)
    d = add_typed_values(d, rule_list)
    checks, absent = compile_checks(d, rule_list)
    found = (d.select(k.alias("row_key"), F.inline(anomaly_array(checks)))
             if checks else d.sparkSession.createDataFrame([], ANOMALY_SCHEMA))
    if absent:
        # D3: one anomaly per rule whose column does not exist
        extra = d.sparkSession.createDataFrame(
            [(None, r.column, "missing_column", None, "column required", "add_column") for r in absent], ANOMALY_SCHEMA)
        found = found.unionByName(extra)
    return found.select(*[F.col(f.name).cast(f.dataType) for f in ANOMALY_SCHEMA.fields])


# --------------------------------------------------------------------------- D10
def anomaly_summary(anoms: DataFrame) -> DataFrame:
    """Counts per anomaly type and per column in one aggregation
    (GROUPING SETS). Output: dimension ('anomaly'|'column'), value, n."""
    g = anoms.groupBy(F.col("anomaly"), F.col("column_name")).agg(F.count(F.lit(1)).alias("n"))
    # second level over the tiny (type x column) result instead of a re-scan
    by_type = g.groupBy("anomaly").agg(F.sum("n").alias("n")).select(
        F.lit("anomaly").alias("dimension"), F.col("anomaly").alias("value"), F.col("n").cast("long").alias("n"))
    by_col = g.groupBy("column_name").agg(F.sum("n").alias("n")).select(
        F.lit("column").alias("dimension"), F.col("column_name").alias("value"), F.col("n").cast("long").alias("n"))
    return by_type.unionByName(by_col)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts, descending (ties by value). NULL excluded as pandas does."""
    return (df.where(q(col).isNotNull()).groupBy(q(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")))


# --------------------------------------------------------------------------- D11
def quality_stats(df: DataFrame, rules: DataFrame | list) -> DataFrame:
    """Rows, columns, anomalies, success rate, share of clean rows and
    completeness % per column, from one aggregate pass over ``df``.
    Output: metric, column_name, value (double)."""
    rule_list = load_rule_list(rules)
    d = add_typed_values(df, rule_list)
    checks, absent = compile_checks(d, rule_list)
    n_found = F.size(anomaly_array(checks))
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum(n_found).alias("n_anom"),
            F.sum(F.when(n_found == 0, 1).otherwise(0)).alias("n_clean")]
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.sum(F.when(is_missing(q(f.name), f.dataType), 0).otherwise(1)).alias(f"c{i}"))
    a = d.agg(*aggs)
    n = F.col("n").cast("double")
    n_anom = F.coalesce(F.col("n_anom"), F.lit(0)) + F.lit(len(absent))
    def row(metric, column, value):
        return F.struct(F.lit(metric).alias("metric"), F.lit(column).cast("string").alias("column_name"),
                        value.cast("double").alias("value"))

    rows = [
        row("total_rows", None, n),
        row("total_columns", None, F.lit(float(len(df.columns)))),
        row("total_anomalies", None, n_anom),
        row("success_rate_pct", None, F.round((F.lit(1.0) - F.try_divide(n_anom.cast("double"), n)) * 100.0, 2)),
        row("clean_rows_pct", None, F.round(F.try_divide(F.coalesce(F.col("n_clean"), F.lit(0)).cast("double"), n) * 100.0, 2)),
    ]
    for i, f in enumerate(df.schema.fields):
        rows.append(row("completeness_pct", f.name, F.round(F.try_divide(F.col(f"c{i}").cast("double"), n) * 100.0, 2)))
    return a.select(F.inline(F.array(*rows)))


# --------------------------------------------------------------------------- D12
def missing_overview(df: DataFrame) -> DataFrame:
    """Missing cells per column (count and %, sorted desc) plus a '*' row for the
    whole table. Output: column_name, n_cells, n_missing, pct_missing."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        aggs.append(F.sum(F.when(is_missing(q(f.name), f.dataType), 1).otherwise(0)).alias(f"m{i}"))
    a = df.agg(*aggs)
    n = F.col("n").cast("long")
    missing = [F.coalesce(F.col(f"m{i}"), F.lit(0)).cast("long") for i in range(len(fields))]
    total_missing = sum(missing, F.lit(0).cast("long"))
    def row(name, cells, missing):
        return F.struct(F.lit(name).alias("column_name"), cells.alias("n_cells"), missing.alias("n_missing"))

    rows = [row("*", n * len(fields), total_missing)]
    for i, f in enumerate(fields):
        rows.append(row(f.name, n, missing[i]))
    out = a.select(F.inline(F.array(*rows)))
    return (out.withColumn("pct_missing", F.coalesce(F.round(F.try_divide(F.col("n_missing"), F.col("n_cells")) * 100.0, 2), F.lit(0.0)))
            .orderBy(F.desc("n_missing"), F.asc("column_name")))


def filter_anomalies(anoms: DataFrame, types=None, columns=None) -> DataFrame:
    """Keep anomalies of the given types and columns (None = all)."""
    cond = F.lit(True)
    if types is not None:
        cond = cond & F.col("anomaly").isin(list(types))
    if columns is not None:
        cond = cond & F.col("column_name").isin(list(columns))
    return anoms.where(cond)
