"""Named queries over the driver tables and their DuckDB oracle SQL.

Every query reads whole tables (or fixtures Spark derives from them, see
``sources.fixtures``); each ``SQL`` text recomputes the same result independently in
DuckDB. Floating results are rounded in both to the same number of digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _round(df: DataFrame, digits: int = 6, cols=None) -> DataFrame:
    from ..functions.exprs import is_float_type
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if is_float_type(f.dataType) and (cols is None or f.name in cols):
            c = F.round(c, digits)
        out.append(c.alias(f.name))
    return df.select(*out)


DIRTY = "WITH " + fx.dirty_orders_sql()
NUM_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
EMAIL_RE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# ---------------------------------------------------------------- dictionary checks
DQ_DETECT_SQL = DIRTY + f""",
a AS (
  SELECT o_orderkey AS row_key, 'o_orderkey' AS column_name, 'missing' AS anomaly, CAST(NULL AS VARCHAR) AS actual_value,
         'required value' AS expected, 'ignorer' AS action FROM dirty_orders WHERE o_orderkey IS NULL
  UNION ALL SELECT o_orderkey, 'o_orderkey', 'below_min', CAST(o_orderkey AS VARCHAR), '>= 0.0', 'ignorer'
    FROM dirty_orders WHERE o_orderkey < 0
  UNION ALL SELECT o_orderkey, 'price', 'missing', NULL, 'required value', 'imputer_mediane'
    FROM dirty_orders WHERE price IS NULL OR isnan(price)
  UNION ALL SELECT o_orderkey, 'price', 'below_min', CAST(CAST(price AS DECIMAL(20,2)) AS VARCHAR), '>= 0.0', 'imputer_mediane'
    FROM dirty_orders WHERE price < 0 AND NOT isnan(price)
  UNION ALL SELECT o_orderkey, 'price', 'above_max', CAST(CAST(price AS DECIMAL(20,2)) AS VARCHAR), '<= 1000000.0', 'imputer_mediane'
    FROM dirty_orders WHERE price > 1000000 AND NOT isnan(price)
  UNION ALL SELECT o_orderkey, 'price_txt', 'not_numeric', price_txt, 'numeric value', 'mettre_vide'
    FROM dirty_orders WHERE price_txt IS NOT NULL AND NOT regexp_matches(price_txt, '{NUM_RE}')
  UNION ALL SELECT o_orderkey, 'price_txt', 'below_min', price_txt, '>= 20000.0', 'mettre_vide'
    FROM dirty_orders WHERE regexp_matches(price_txt, '{NUM_RE}') AND TRY_CAST(trim(price_txt) AS DOUBLE) < 20000
  UNION ALL SELECT o_orderkey, 'status', 'missing', NULL, 'required value', 'imputer_mode'
    FROM dirty_orders WHERE status IS NULL
  UNION ALL SELECT o_orderkey, 'status', 'not_allowed', status, 'one of: F, O, P', 'imputer_mode'
    FROM dirty_orders WHERE status IS NOT NULL AND status NOT IN ('F', 'O', 'P')
  UNION ALL SELECT o_orderkey, 'date_txt', 'missing', NULL, 'required value', 'supprimer_ligne'
    FROM dirty_orders WHERE date_txt IS NULL
  UNION ALL SELECT o_orderkey, 'date_txt', 'bad_date', date_txt, 'format: %Y-%m-%d', 'supprimer_ligne'
    FROM dirty_orders WHERE date_txt IS NOT NULL AND try_strptime(date_txt, '%Y-%m-%d') IS NULL
  UNION ALL SELECT o_orderkey, 'date_txt', 'date_above_max', date_txt, '<= 1998-06-30', 'supprimer_ligne'
    FROM dirty_orders WHERE try_strptime(date_txt, '%Y-%m-%d') > TIMESTAMP '1998-06-30 00:00:00'
  UNION ALL SELECT o_orderkey, 'email', 'bad_format', email, 'format: email', 'mettre_vide'
    FROM dirty_orders WHERE email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL_RE}')
  UNION ALL SELECT CAST(NULL AS BIGINT), 'segment', 'missing_column', NULL, 'column required', 'add_column'
)"""


def _detect(spark, sf_dir):
    from ..operators.rules import detect_anomalies
    return detect_anomalies(fx.dirty_orders(spark, sf_dir), fx.dirty_rules(spark), key="o_orderkey")


@register("dq_detect", DQ_DETECT_SQL + "\nSELECT * FROM a")
def q_dq_detect(spark, sf_dir):
    return _detect(spark, sf_dir)


@register("dq_summary", DQ_DETECT_SQL + """
SELECT 'anomaly' AS dimension, anomaly AS value, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY anomaly
UNION ALL
SELECT 'column' AS dimension, column_name AS value, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY column_name""")
def q_dq_summary(spark, sf_dir):
    from ..operators.rules import anomaly_summary
    return anomaly_summary(_detect(spark, sf_dir))


_COLS = ["o_orderkey", "o_custkey", "price", "price_txt", "status", "date_txt", "email", "ratio", "constant_col", "priority"]
_FLOAT_COLS = {"price", "ratio"}


def _present(c):
    return f"({c} IS NOT NULL AND NOT isnan({c}))" if c in _FLOAT_COLS else f"({c} IS NOT NULL)"


def _missing(c):
    return f"({c} IS NULL OR isnan({c}))" if c in _FLOAT_COLS else f"({c} IS NULL)"


_ROW_ANOMS = f"""(
    (CASE WHEN {_missing('price')} THEN 1 ELSE 0 END)
  + (CASE WHEN price < 0 AND NOT isnan(price) THEN 1 ELSE 0 END)
  + (CASE WHEN price > 1000000 AND NOT isnan(price) THEN 1 ELSE 0 END)
  + (CASE WHEN price_txt IS NOT NULL AND NOT regexp_matches(price_txt, '{NUM_RE}') THEN 1 ELSE 0 END)
  + (CASE WHEN regexp_matches(price_txt, '{NUM_RE}') AND TRY_CAST(trim(price_txt) AS DOUBLE) < 20000 THEN 1 ELSE 0 END)
  + (CASE WHEN status IS NULL THEN 1 ELSE 0 END)
  + (CASE WHEN status IS NOT NULL AND status NOT IN ('F', 'O', 'P') THEN 1 ELSE 0 END)
  + (CASE WHEN date_txt IS NULL THEN 1 ELSE 0 END)
  + (CASE WHEN date_txt IS NOT NULL AND try_strptime(date_txt, '%Y-%m-%d') IS NULL THEN 1 ELSE 0 END)
  + (CASE WHEN try_strptime(date_txt, '%Y-%m-%d') > TIMESTAMP '1998-06-30 00:00:00' THEN 1 ELSE 0 END)
  + (CASE WHEN email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL_RE}') THEN 1 ELSE 0 END))"""

DQ_STATS_SQL = DIRTY + f""",
s AS (SELECT count(*) AS n, sum({_ROW_ANOMS}) + 1 AS n_anom,
        sum(CASE WHEN {_ROW_ANOMS} = 0 THEN 1 ELSE 0 END) AS n_clean,
        {', '.join(f"sum(CASE WHEN {_present(c)} THEN 1 ELSE 0 END) AS c_{c}" for c in _COLS)}
      FROM dirty_orders)
SELECT 'total_rows' AS metric, CAST(NULL AS VARCHAR) AS column_name, CAST(n AS DOUBLE) AS value FROM s
UNION ALL SELECT 'total_columns', NULL, {float(len(_COLS))} FROM s
UNION ALL SELECT 'total_anomalies', NULL, CAST(n_anom AS DOUBLE) FROM s
UNION ALL SELECT 'success_rate_pct', NULL, round((1.0 - n_anom / n) * 100.0, 2) FROM s
UNION ALL SELECT 'clean_rows_pct', NULL, round(n_clean / n * 100.0, 2) FROM s
""" + "\n".join(f"UNION ALL SELECT 'completeness_pct', '{c}', round(c_{c} / n * 100.0, 2) FROM s" for c in _COLS)


@register("dq_stats", DQ_STATS_SQL)
def q_dq_stats(spark, sf_dir):
    from ..operators.rules import quality_stats
    return quality_stats(fx.dirty_orders(spark, sf_dir), fx.dirty_rules(spark))


MISSING_SQL = DIRTY + f""",
s AS (SELECT count(*) AS n, {', '.join(f"sum(CASE WHEN {_missing(c)} THEN 1 ELSE 0 END) AS m_{c}" for c in _COLS)}
      FROM dirty_orders),
r AS (
  SELECT '*' AS column_name, CAST(n * {len(_COLS)} AS BIGINT) AS n_cells, CAST({' + '.join(f'm_{c}' for c in _COLS)} AS BIGINT) AS n_missing FROM s
""" + "\n".join(f"  UNION ALL SELECT '{c}', CAST(n AS BIGINT), CAST(m_{c} AS BIGINT) FROM s" for c in _COLS) + """
)
SELECT column_name, n_cells, n_missing, round(n_missing / n_cells * 100.0, 2) AS pct_missing FROM r"""


@register("missing_overview", MISSING_SQL)
def q_missing_overview(spark, sf_dir):
    from ..operators.rules import missing_overview
    return missing_overview(fx.dirty_orders(spark, sf_dir))
