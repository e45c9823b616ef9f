"""Profiling and aggregate statistics.

Wide aggregates are computed in one pass (``agg`` of many expressions, then the single
result row is turned into rows with ``inline``). Exact distinct counts over many columns
use an unpivot to (column, value) and a two-level ``groupBy`` instead of many
``count(DISTINCT)`` (which Spark plans as an ``Expand`` of every row per column); where only
"more than k?" is asked, ``distinct_at_most`` moves k + 1 values a column and task.
Exact quantiles use the distributed order statistics of ``functions.ranking``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (is_float_type, is_integral_type, is_missing, is_numeric_type, nan_to_null,
                               numeric_columns, q)
from ..functions.ranking import exact_quantiles


def _to_rows(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*structs)))


def long_values(df: DataFrame, cols: Sequence[str] | None = None, as_double: bool = True) -> DataFrame:
    """Unpivot to (column_name, x): numeric columns as double (NaN -> NULL) or every
    column as its string form (NaN -> NULL, -0.0 -> 0.0) for distinct counting."""
    fields = [f for f in df.schema.fields if cols is None or f.name in set(cols)]
    value = (lambda f: nan_to_null(q(f.name).cast("double"), T.DoubleType())) if as_double else _text_form
    return df.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column_name"), value(f).alias("x")) for f in fields])))


def _text_form(f: T.StructField) -> Column:
    """A column as text for distinct counting: NaN -> NULL, -0.0 -> 0.0."""
    c = q(f.name)
    if is_float_type(f.dataType):
        c = F.when(~F.isnan(c), F.when(c == 0, F.lit(0.0)).otherwise(c))
    return c.cast("string")


def distinct_at_most(df: DataFrame, limit: int, cols: Sequence[str] | None = None) -> dict[str, int]:
    """Number of distinct values of each column, ``limit`` + 1 where there are more.

    Answers "more than ``limit``?" without moving the values: a task keeps ``limit`` + 1 values a column at most and
    reads a column no further once it holds them, so at most that many values a column and task are shuffled. NULL
    and NaN are no values."""
    names = set(df.columns if cols is None else cols)
    fields = [f for f in df.schema.fields if f.name in names]
    if not fields:
        return {}

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [set() for _ in fields]
        for b in batches:
            for held, column in zip(seen, b.columns):
                if len(held) <= limit:
                    new = (v for v in pc.unique(column).to_pylist() if v is not None and v not in held)
                    held.update(islice(new, limit + 1 - len(held)))
        at = [i for i, held in enumerate(seen) for _ in held]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([v for held in seen for v in held], pa.string())], names=["i", "x"])

    texts = df.select(*[_text_form(f).alias(f"c{i}") for i, f in enumerate(fields)])
    found = texts.mapInArrow(bounded, "i int, x string").distinct().groupBy("i").count().collect()  # a row a column
    counts = {r["i"]: min(r["count"], limit + 1) for r in found}
    return {f.name: counts.get(i, 0) for i, f in enumerate(fields)}


# --------------------------------------------------------------------------- A5
def count_duplicates(df: DataFrame) -> DataFrame:
    """A5: number of rows that repeat an earlier row (pandas ``duplicated().sum()``).
    One ``groupBy`` over all columns; a heavy repeated row collapses map-side."""
    g = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__cnt"))
    return g.agg(F.coalesce(F.sum(F.col("__cnt") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: n_rows, n_missing, n_distinct, n_infinite (one job)."""
    fields = df.schema.fields
    float_cols = [f.name for f in fields if is_float_type(f.dataType)]
    if approx:
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(fields):
            c = q(f.name)
            aggs += [F.sum(F.when(is_missing(c, f.dataType), 1).otherwise(0)).alias(f"m{i}"),
                     F.approx_count_distinct(nan_to_null(c, f.dataType)).alias(f"d{i}"),
                     (F.sum(F.when(F.abs(c) == float("inf"), 1).otherwise(0)) if is_float_type(f.dataType)
                      else F.lit(0)).alias(f"i{i}")]
        a = df.agg(*aggs)
        return _to_rows(a, [F.struct(F.lit(f.name).alias("column_name"), F.col("n").cast("long").alias("n_rows"),
                                     F.col(f"m{i}").cast("long").alias("n_missing"),
                                     F.col(f"d{i}").cast("long").alias("n_distinct"),
                                     F.col(f"i{i}").cast("long").alias("n_infinite"))
                            for i, f in enumerate(fields)])
    lv = long_values(df, as_double=False)
    per_value = lv.groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("cnt"))
    is_inf_txt = F.col("column_name").isin(float_cols) & F.col("x").isin("Infinity", "-Infinity")
    return per_value.groupBy("column_name").agg(
        F.sum("cnt").cast("long").alias("n_rows"),
        F.sum(F.when(F.col("x").isNull(), F.col("cnt")).otherwise(0)).cast("long").alias("n_missing"),
        F.count("x").cast("long").alias("n_distinct"),
        F.sum(F.when(is_inf_txt, F.col("cnt")).otherwise(0)).cast("long").alias("n_infinite"))


# --------------------------------------------------------------------------- A1
def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """A1: per column n_rows, n_missing, pct_missing, n_distinct, n_infinite,
    is_constant, is_high_cardinality (distinct > 50 % of rows), table n_duplicates."""
    dtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dc = distinct_counts(df, approx)
    n_dup = count_duplicates(df).first()["n_duplicates"]
    dtype = F.create_map(*[x for k, v in dtypes.items() for x in (F.lit(k), F.lit(v))])
    return dc.select(
        "column_name", dtype[F.col("column_name")].alias("dtype"), "n_rows", "n_missing",
        F.round(F.col("n_missing") / F.col("n_rows") * 100.0, 2).alias("pct_missing"),
        "n_distinct", "n_infinite",
        (F.col("n_distinct") == 1).alias("is_constant"),
        (F.col("n_distinct") > F.col("n_rows") * 0.5).alias("is_high_cardinality"),
        F.lit(n_dup).cast("long").alias("n_duplicates"))


# --------------------------------------------------------------------------- A4
def variable_types(df: DataFrame, max_int_levels: int = 10) -> DataFrame:
    """A4: numeric vs categorical; integer columns with < 10 distinct values are
    categorical; strings, booleans, dates are categorical."""
    ints = [f.name for f in df.schema.fields if is_integral_type(f.dataType)]
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    nd = distinct_at_most(df, max_int_levels - 1, ints)
    rows = []
    for f in df.schema.fields:
        if is_numeric_type(f.dataType):
            kind = "categorical" if (f.name in nd and nd[f.name] < max_int_levels) else "numeric"
        else:
            kind = "categorical"
        rows.append((f.name, dtypes[f.name].simpleString(), kind))
    return df.sparkSession.createDataFrame(rows, "column_name string, dtype string, var_type string")


# --------------------------------------------------------------------------- A2
QUARTILES = [0.25, 0.5, 0.75]


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Exact quantiles of several numeric columns: column_name, p, q. The columns are unpivoted and
    counted by value once (map-side combined); no aggregate holds a column's values in one task."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, p double, q double")
    return exact_quantiles(long_values(df, cols), "x", probs, ["column_name"], split_groups=["column_name"])


def _wide_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    qt = quantile_table(df, cols, probs)
    return qt.groupBy("column_name").agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(f"q{int(round(p * 100))}") for p in probs])


def describe(df: DataFrame, cols: Sequence[str] | None = None, decimals: int = 4) -> DataFrame:
    """A2: count, mean, std (ddof=1), min, quartiles, max of numeric columns."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = nan_to_null(q(c).cast("double"), T.DoubleType())
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    fields = lambda i, c: [F.lit(c).alias("column_name"), F.col(f"n{i}").cast("long").alias("count"),
                           F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
                           F.col(f"hi{i}").alias("max")]
    r = lambda c: F.round(F.col(c), decimals)
    out = ["column_name", "count", r("mean").alias("mean"), r("std").alias("std"), r("min").alias("min"),
           r("q25").alias("q25"), r("q50").alias("q50"), r("q75").alias("q75"), r("max").alias("max")]
    mom = _to_rows(df.agg(*aggs), [F.struct(*fields(i, c)) for i, c in enumerate(cols)])
    qs = _wide_quantiles(df, cols, QUARTILES)
    # both sides have one row per column: a tiny join
    j = mom.join(F.broadcast(qs), "column_name", "left")
    return j.select(*out)


def table_profile(df: DataFrame) -> DataFrame:
    """A3: shape, missing, dtype and variable type per column."""
    p = profile(df)
    vt = variable_types(df)
    return p.join(F.broadcast(vt.select("column_name", "var_type")), "column_name", "left") \
        .withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


# --------------------------------------------------------------------------- A6
def indicators(df: DataFrame, cols: Sequence[str] | None = None, with_normality: bool = True) -> DataFrame:
    """Mean, median, std, min, max, skewness and excess kurtosis (population),
    coefficient of variation (inf when mean = 0), IQR outlier count and %, and the
    Shapiro-Wilk p-value with its label (A7) when ``with_normality``."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = nan_to_null(q(c).cast("double"), T.DoubleType())
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.skewness(x).alias(f"g{i}"),
                 F.kurtosis(x).alias(f"k{i}")]
    mom = _to_rows(df.agg(*aggs), [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").cast("long").alias("n"),
                 F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
                 F.col(f"hi{i}").alias("max"), F.col(f"g{i}").alias("skewness"), F.col(f"k{i}").alias("kurtosis"))
        for i, c in enumerate(cols)])
    qs = _wide_quantiles(df, cols, QUARTILES).collect()
    fences = {r["column_name"]: (r["q25"], r["q50"], r["q75"]) for r in qs}
    cnt = []
    for i, c in enumerate(cols):
        q1, _, q3 = fences.get(c, (None, None, None))
        if q1 is None:
            cnt.append(F.lit(0).alias(f"o{i}"))
            continue
        iqr = q3 - q1
        x = q(c).cast("double")
        cnt.append(F.sum(F.when((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr), 1).otherwise(0)).alias(f"o{i}"))
    outl = _to_rows(df.agg(*cnt), [F.struct(F.lit(c).alias("column_name"), F.col(f"o{i}").cast("long").alias("n_outliers_iqr"))
                                   for i, c in enumerate(cols)])
    med = F.create_map(*[x for c, v in fences.items() for x in (F.lit(c), F.lit(v[1]))]) if fences else None
    out = mom.join(F.broadcast(outl), "column_name")
    out = out.select(
        "column_name", "n", "mean",
        (med[F.col("column_name")] if med is not None else F.lit(None).cast("double")).alias("median"),
        "std", "min", "max", "skewness", "kurtosis",
        F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(F.lit(float("inf"))).alias("cv"),
        "n_outliers_iqr",
        F.when(F.col("n") > 0, F.col("n_outliers_iqr") / F.col("n") * 100.0).alias("pct_outliers_iqr"))
    if with_normality:
        from .normality import shapiro
        sw = shapiro(df, cols).select("column_name", F.col("p_value").alias("shapiro_p"), "normal")
        out = out.join(F.broadcast(sw), "column_name", "left")
    return out


# --------------------------------------------------------------------------- A8
MAX_BINS = 10_000


def _bin_count_auto(n: int, lo: float, hi: float, q25: float, q75: float) -> int:
    """numpy ``bins='auto'``: the smaller of the Sturges and Freedman-Diaconis widths."""
    ptp = hi - lo
    if n == 0 or ptp == 0:
        return 1
    sturges = ptp / (math.log2(n) + 1.0)
    iqr = q75 - q25
    fd = 2.0 * iqr * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil(min(ptp / width, MAX_BINS))))


def histogram(df: DataFrame, col: str, bins="auto") -> DataFrame:
    """Equal-width histogram of one numeric column, zero bins kept.

    Output: bin (0-based), lo, hi, n. Last bin is closed on the right. Infinite values lie in
    no bin and are left out; ``auto`` makes at most ``MAX_BINS`` bins (an outlier far from the
    rest widens the bins, it does not multiply them)."""
    raw = q(col).cast("double")
    x = F.when(~F.isnan(raw) & (F.abs(raw) < float("inf")), raw)
    st = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    n, lo, hi = st["n"], st["lo"], st["hi"]
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "bin int, lo double, hi double, n long")
    if bins == "auto":
        qs = {r["p"]: r["q"] for r in exact_quantiles(df.select(x.alias("x")).where(F.col("x").isNotNull()), "x",
                                                      [0.25, 0.75]).collect()}
        nb = _bin_count_auto(n, lo, hi, qs[0.25], qs[0.75])
    else:
        nb = int(bins)
    if hi == lo:
        lo_e, hi_e = lo - 0.5, hi + 0.5  # numpy widens a zero range
    else:
        lo_e, hi_e = lo, hi
    b = F.floor((x - F.lit(lo_e)) * F.lit(float(nb)) / F.lit(hi_e - lo_e)).cast("int")
    b = F.least(F.greatest(b, F.lit(0)), F.lit(nb - 1))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi_e - lo_e) / nb
    grid = spark.range(nb).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo_e) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo_e) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def histograms(df: DataFrame, cols: Sequence[str] | None = None, bins="auto", max_cols: int | None = None) -> DataFrame:
    """A8 for several columns: all numeric columns by default, the first ``max_cols`` if given."""
    cols = list(cols) if cols is not None else numeric_columns(df)[:max_cols]
    out = None
    for c in cols:
        h = histogram(df, c, bins).select(F.lit(c).alias("column_name"), "*")
        out = h if out is None else out.unionByName(h)
    return out


# --------------------------------------------------------------------------- A9
def kde(df: DataFrame, col: str, grid: int = 200, fine_bins: int = 2048, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on a grid, Scott bandwidth (std * n^(-1/5)).

    Binned KDE: the data is reduced to ``fine_bins`` bin centres with counts, the
    (bins x grid) sum runs on those counts, so the cost does not grow with n. Infinite
    values are left out. Output: x, density."""
    raw = q(col).cast("double")
    x = F.when(~F.isnan(raw) & (F.abs(raw) < float("inf")), raw)
    st = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("s")).first()
    n, lo, hi, s = st["n"], st["lo"], st["hi"], st["s"]
    spark = df.sparkSession
    if not n or not s:
        return spark.createDataFrame([], "x double, density double")
    bw = s * n ** (-1.0 / 5.0)
    w = (hi - lo) / fine_bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)).cast("int"), F.lit(fine_bins - 1))
    fine = (df.where(x.isNotNull()).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"))
            .select((F.lit(lo) + (F.col("b") + 0.5) * F.lit(w)).alias("centre"), "c"))
    g_lo, g_hi = lo - cut * bw, hi + cut * bw
    step = (g_hi - g_lo) / (grid - 1)
    # every fine bin (at most ``fine_bins`` rows) spreads its count over the grid
    prod = fine.select("centre", "c", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("gi")) \
        .withColumn("x", F.lit(g_lo) + F.col("gi") * F.lit(step))
    z = (F.col("x") - F.col("centre")) / F.lit(bw)
    dens = F.sum(F.col("c") * F.exp(-0.5 * z * z)) / F.lit(n * bw * math.sqrt(2 * math.pi))
    return prod.groupBy("x").agg(dens.alias("density")).orderBy("x")
