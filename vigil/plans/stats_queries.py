"""Catalogue part 2: corrections, profiling and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from .catalog import DIRTY, DQ_DETECT_SQL, EMAIL_RE, NUM_RE, _COLS, _FLOAT_COLS, _missing, _round, register

# ---------------------------------------------------------------- C1-C3
_DELETE = ("(date_txt IS NULL OR try_strptime(date_txt, '%Y-%m-%d') IS NULL "
           "OR try_strptime(date_txt, '%Y-%m-%d') > TIMESTAMP '1998-06-30 00:00:00')")
_STATS = """,
med AS (SELECT quantile_cont(price, 0.5) AS m FROM dirty_orders WHERE price IS NOT NULL AND NOT isnan(price)),
cnt AS (SELECT status AS v, count(*) AS n FROM dirty_orders WHERE status IS NOT NULL GROUP BY status),
md AS (SELECT v AS m FROM cnt ORDER BY n DESC, v LIMIT 1)"""

DQ_CORRECT_SQL = DIRTY + _STATS + f"""
SELECT o_orderkey, o_custkey,
  CASE WHEN price IS NULL OR isnan(price) OR price < 0 OR price > 1000000 THEN (SELECT m FROM med) ELSE price END AS price,
  CASE WHEN (price_txt IS NOT NULL AND NOT regexp_matches(price_txt, '{NUM_RE}'))
         OR (regexp_matches(price_txt, '{NUM_RE}') AND TRY_CAST(trim(price_txt) AS DOUBLE) < 20000) THEN NULL
       ELSE price_txt END AS price_txt,
  CASE WHEN status IS NULL OR status NOT IN ('F', 'O', 'P') THEN (SELECT m FROM md) ELSE status END AS status,
  date_txt,
  CASE WHEN NOT regexp_matches(email, '{EMAIL_RE}') THEN NULL ELSE email END AS email,
  ratio, constant_col, priority
FROM dirty_orders
WHERE NOT {_DELETE}"""


def _correct(spark, sf_dir):
    from ..operators.correct import apply_rule_actions
    return apply_rule_actions(fx.dirty_orders(spark, sf_dir), fx.dirty_rules(spark), key="o_orderkey")


@register("dq_correct", DQ_CORRECT_SQL)
def q_dq_correct(spark, sf_dir):
    return _correct(spark, sf_dir)[0]


DQ_LOG_SQL = DQ_DETECT_SQL + _STATS + """
SELECT row_key, column_name, anomaly, actual_value AS value_before,
  CASE action WHEN 'imputer_mediane' THEN printf('%.2f', (SELECT m FROM med))
              WHEN 'imputer_mode' THEN (SELECT m FROM md)
              WHEN 'mettre_vide' THEN NULL
              WHEN 'supprimer_ligne' THEN 'row deleted'
              WHEN 'ignorer' THEN 'ignored' ELSE 'unknown action' END AS value_after,
  action, TIMESTAMP '2000-01-01 00:00:00' AS run_ts
FROM a WHERE row_key IS NOT NULL"""


@register("dq_log", DQ_LOG_SQL)
def q_dq_log(spark, sf_dir):
    return _correct(spark, sf_dir)[1]


# ---------------------------------------------------------------- A1 / A5 / C5
_DTYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "price": "double", "price_txt": "string", "status": "string",
           "date_txt": "string", "email": "string", "ratio": "double", "constant_col": "string", "priority": "string"}


def _distinct_expr(c):
    return f"count(DISTINCT CASE WHEN NOT isnan({c}) THEN {c} END)" if c in _FLOAT_COLS else f"count(DISTINCT {c})"


def _inf_expr(c):
    return f"sum(CASE WHEN abs({c}) = 'Infinity'::DOUBLE THEN 1 ELSE 0 END)" if c in _FLOAT_COLS else "0"


PROFILE_SQL = DIRTY + """,
dup AS (SELECT (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS d),
p AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT '{c}' AS column_name, '{_DTYPES[c]}' AS dtype, count(*) AS n_rows, "
    f"sum(CASE WHEN {_missing(c)} THEN 1 ELSE 0 END) AS n_missing, {_distinct_expr(c)} AS n_distinct, "
    f"{_inf_expr(c)} AS n_infinite FROM dirty_orders" for c in _COLS) + """
)
SELECT column_name, dtype, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_missing AS BIGINT) AS n_missing,
  round(n_missing / n_rows * 100.0, 2) AS pct_missing, CAST(n_distinct AS BIGINT) AS n_distinct,
  CAST(n_infinite AS BIGINT) AS n_infinite, n_distinct = 1 AS is_constant, n_distinct > n_rows * 0.5 AS is_high_cardinality,
  CAST((SELECT d FROM dup) AS BIGINT) AS n_duplicates
FROM p"""


@register("profile", PROFILE_SQL)
def q_profile(spark, sf_dir):
    from ..operators.profile import profile
    return profile(fx.dirty_orders(spark, sf_dir))


@register("count_duplicates", DIRTY + """
SELECT CAST((SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS BIGINT)
  AS n_duplicates""")
def q_count_duplicates(spark, sf_dir):
    from ..operators.profile import count_duplicates
    return count_duplicates(fx.dirty_orders(spark, sf_dir))


PROPOSE_SQL = DIRTY + """,
dup AS (SELECT (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS d),
p AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT '{c}' AS column_name, count(*) AS n_rows, "
    f"sum(CASE WHEN {_missing(c)} THEN 1 ELSE 0 END) AS n_missing, {_distinct_expr(c)} AS n_distinct, "
    f"{_inf_expr(c)} AS n_infinite FROM dirty_orders" for c in _COLS) + """
),
r AS (
  SELECT column_name,
    list_concat(
      CASE WHEN n_missing > 0 THEN [CAST(n_missing AS VARCHAR) || ' missing values'] ELSE [] END,
      CASE WHEN n_distinct = 1 THEN ['constant column'] ELSE [] END,
      CASE WHEN n_distinct > n_rows * 0.5 THEN ['high cardinality'] ELSE [] END,
      CASE WHEN n_infinite > 0 THEN [CAST(n_infinite AS VARCHAR) || ' infinite values'] ELSE [] END) AS anomalies,
    list_concat(
      CASE WHEN n_missing > 0 THEN ['impute_mean', 'impute_median', 'impute_mode', 'drop_rows', 'drop_column'] ELSE [] END,
      CASE WHEN n_distinct = 1 THEN ['drop_column'] ELSE [] END,
      CASE WHEN n_distinct > n_rows * 0.5 THEN ['alternative_encoding'] ELSE [] END,
      CASE WHEN n_infinite > 0 THEN ['replace_inf_impute', 'drop_rows'] ELSE [] END) AS all_proposals
  FROM p)
SELECT column_name, anomalies,
  list_filter(all_proposals, lambda x, i: list_position(all_proposals, x) = i) AS proposals
FROM r WHERE len(anomalies) > 0
UNION ALL
SELECT 'DOUBLONS', [CAST(d AS VARCHAR) || ' exact duplicate rows'], ['drop_duplicates', 'keep'] FROM dup WHERE d > 0"""


@register("propose", PROPOSE_SQL)
def q_propose(spark, sf_dir):
    from ..operators.correct import propose_corrections
    from ..operators.profile import profile
    return propose_corrections(profile(fx.dirty_orders(spark, sf_dir)))


_AUTO_COLS = ["price", "price_txt", "status", "date_txt", "ratio"]  # columns with missing cells
AUTO_CLEAN_SQL = DIRTY + """,
med AS (SELECT
  (SELECT quantile_cont(price, 0.5) FROM dirty_orders WHERE NOT isnan(price)) AS price,
  (SELECT quantile_cont(ratio, 0.5) FROM dirty_orders WHERE NOT isnan(ratio)) AS ratio),
""" + ",\n".join(
    f"m_{c} AS (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c}) "
    f"ORDER BY n DESC, v LIMIT 1)" for c in ["price_txt", "status", "date_txt"]) + """
SELECT o_orderkey, o_custkey,
  CASE WHEN price IS NULL OR isnan(price) THEN (SELECT price FROM med) ELSE price END AS price,
  coalesce(price_txt, (SELECT v FROM m_price_txt)) AS price_txt,
  coalesce(status, (SELECT v FROM m_status)) AS status,
  coalesce(date_txt, (SELECT v FROM m_date_txt)) AS date_txt,
  email,
  CASE WHEN ratio IS NULL OR isnan(ratio) THEN (SELECT ratio FROM med) ELSE ratio END AS ratio,
  constant_col, priority
FROM dirty_orders"""


@register("auto_clean", AUTO_CLEAN_SQL)
def q_auto_clean(spark, sf_dir):
    from ..operators.correct import auto_clean
    return auto_clean(fx.dirty_orders(spark, sf_dir))[0]


AUTO_LOG_SQL = DIRTY + ",\n" + ",\n".join(
    f"m_{c} AS (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c}) "
    f"ORDER BY n DESC, v LIMIT 1)" for c in ["price_txt", "status", "date_txt"]) + """
SELECT 'price' AS column_name, 'impute_median' AS correction,
       CAST(sum(CASE WHEN price IS NULL OR isnan(price) THEN 1 ELSE 0 END) AS BIGINT) AS n_modified, 'done' AS status FROM dirty_orders
UNION ALL SELECT 'price_txt', 'impute_mode (' || (SELECT v FROM m_price_txt) || ')',
       CAST(sum(CASE WHEN price_txt IS NULL THEN 1 ELSE 0 END) AS BIGINT), 'done' FROM dirty_orders
UNION ALL SELECT 'status', 'impute_mode (' || (SELECT v FROM m_status) || ')',
       CAST(sum(CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS BIGINT), 'done' FROM dirty_orders
UNION ALL SELECT 'date_txt', 'impute_mode (' || (SELECT v FROM m_date_txt) || ')',
       CAST(sum(CASE WHEN date_txt IS NULL THEN 1 ELSE 0 END) AS BIGINT), 'done' FROM dirty_orders
UNION ALL SELECT 'ratio', 'impute_median',
       CAST(sum(CASE WHEN ratio IS NULL OR isnan(ratio) THEN 1 ELSE 0 END) AS BIGINT), 'done' FROM dirty_orders"""


@register("auto_clean_log", AUTO_LOG_SQL)
def q_auto_clean_log(spark, sf_dir):
    from ..operators.correct import auto_clean
    return auto_clean(fx.dirty_orders(spark, sf_dir))[1]


# apply_corrections with a choice map covering every correction family
CHOICES = {"DOUBLONS": "drop_duplicates", "price": "impute_mean", "ratio": "replace_inf_impute",
           "status": "impute_mode", "date_txt": "drop_rows", "constant_col": "drop_column",
           "o_custkey": "alternative_encoding"}

APPLY_SQL = DIRTY + """,
d0 AS (SELECT DISTINCT * FROM dirty_orders),
mean_p AS (SELECT avg(price) FILTER (WHERE NOT isnan(price)) AS m FROM d0),
d1 AS (SELECT o_orderkey, o_custkey, CASE WHEN price IS NULL OR isnan(price) THEN (SELECT m FROM mean_p) ELSE price END AS price,
              price_txt, status, date_txt, email, ratio, constant_col, priority FROM d0),
md AS (SELECT v FROM (SELECT status AS v, count(*) AS n FROM d1 WHERE status IS NOT NULL GROUP BY status) ORDER BY n DESC, v LIMIT 1),
d2 AS (SELECT o_orderkey, o_custkey, price, price_txt, coalesce(status, (SELECT v FROM md)) AS status, date_txt, email, ratio,
              constant_col, priority FROM d1),
d3 AS (SELECT * FROM d2 WHERE date_txt IS NOT NULL),
med_r AS (SELECT quantile_cont(ratio, 0.5) AS m FROM d3 WHERE NOT isnan(ratio) AND abs(ratio) <> 'Infinity'::DOUBLE)
SELECT o_orderkey, o_custkey, round(price, 6) AS price, price_txt, status, date_txt, email,
  CASE WHEN ratio IS NULL OR isnan(ratio) OR abs(ratio) = 'Infinity'::DOUBLE THEN (SELECT m FROM med_r) ELSE ratio END AS ratio,
  priority
FROM d3"""


def _apply(spark, sf_dir):
    from ..operators.correct import apply_corrections
    return apply_corrections(fx.dirty_orders(spark, sf_dir), CHOICES)


@register("apply_corrections", APPLY_SQL)
def q_apply_corrections(spark, sf_dir):
    return _round(_apply(spark, sf_dir)[0], 6, ["price"])


APPLY_LOG_SQL = DIRTY + """,
d0 AS (SELECT DISTINCT * FROM dirty_orders),
n AS (SELECT count(*) FILTER (WHERE price IS NULL OR isnan(price)) AS price, count(*) FILTER (WHERE status IS NULL) AS status,
             count(*) FILTER (WHERE date_txt IS NULL) AS date_txt,
             count(*) FILTER (WHERE date_txt IS NOT NULL AND (ratio IS NULL OR isnan(ratio) OR isinf(ratio))) AS ratio, count(*) AS rows FROM d0)
SELECT 'DOUBLONS' AS column_name, 'drop_duplicates' AS correction,
       CAST((SELECT count(*) FROM dirty_orders) - rows AS BIGINT) AS n_modified, 'done' AS status FROM n
UNION ALL SELECT 'price', 'impute_mean', CAST(price AS BIGINT), 'done' FROM n
UNION ALL SELECT 'status', 'impute_mode', CAST(status AS BIGINT), 'done' FROM n
UNION ALL SELECT 'date_txt', 'drop_rows', CAST(date_txt AS BIGINT), 'done' FROM n
UNION ALL SELECT 'ratio', 'replace_inf_impute', CAST(ratio AS BIGINT), 'done' FROM n
UNION ALL SELECT 'constant_col', 'drop_column', NULL, 'column dropped'
UNION ALL SELECT 'o_custkey', 'alternative_encoding', 0, 'logged only'"""


@register("apply_corrections_log", APPLY_LOG_SQL)
def q_apply_corrections_log(spark, sf_dir):
    return _apply(spark, sf_dir)[1]


@register("drop_duplicates", DIRTY + "\nSELECT DISTINCT * FROM dirty_orders")
def q_drop_duplicates(spark, sf_dir):
    from ..operators.correct import drop_duplicates
    return drop_duplicates(fx.dirty_orders(spark, sf_dir))[0]


@register("fix_infinite", DIRTY + """,
m AS (SELECT quantile_cont(ratio, 0.5) AS m FROM dirty_orders WHERE NOT isnan(ratio) AND abs(ratio) <> 'Infinity'::DOUBLE)
SELECT o_orderkey, o_custkey, price, price_txt, status, date_txt, email,
  CASE WHEN ratio IS NULL OR isnan(ratio) OR abs(ratio) = 'Infinity'::DOUBLE THEN (SELECT m FROM m) ELSE ratio END AS ratio,
  constant_col, priority
FROM dirty_orders""")
def q_fix_infinite(spark, sf_dir):
    from ..operators.correct import fix_infinite
    return fix_infinite(fx.dirty_orders(spark, sf_dir), ["ratio"])[0]


# ---------------------------------------------------------------- A2 / A4 / A6 / A8 / A9 / A11
_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

DESCRIBE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
    f"round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, "
    f"round(quantile_cont({c}, 0.75), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM lineitem"
    for c in _LI_NUM)


@register("describe", DESCRIBE_SQL)
def q_describe(spark, sf_dir):
    from ..operators.profile import describe
    return describe(fx.table(spark, sf_dir, "lineitem"))


_IND = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
INDICATORS_SQL = "WITH " + ",\n".join(
    f"""m_{c} AS (SELECT avg({c}) AS mu, count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS md,
        quantile_cont({c}, 0.75) AS q3 FROM lineitem),
r_{c} AS (SELECT '{c}' AS column_name, n, mu AS mean, md AS median, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
        CAST(max({c}) AS DOUBLE) AS max,
        avg(pow({c} - mu, 3)) / pow(avg(pow({c} - mu, 2)), 1.5) AS skewness,
        avg(pow({c} - mu, 4)) / pow(avg(pow({c} - mu, 2)), 2) - 3 AS kurtosis,
        sum(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS n_out
        FROM lineitem, m_{c} GROUP BY n, mu, md, q1, q3)""" for c in _IND) + "\n" + "\nUNION ALL\n".join(
    f"""SELECT column_name, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
  round(min, 6) AS min, round(max, 6) AS max, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis,
  round(CASE WHEN mean <> 0 THEN std / mean ELSE 'Infinity'::DOUBLE END, 6) AS cv, CAST(n_out AS BIGINT) AS n_outliers_iqr,
  round(n_out / n * 100.0, 6) AS pct_outliers_iqr, CASE WHEN n > 5000 THEN CAST(NULL AS DOUBLE) END AS shapiro_p,
  CASE WHEN n > 5000 THEN CAST(NULL AS BOOLEAN) END AS normal FROM r_{c}""" for c in _IND)


@register("indicators", INDICATORS_SQL)
def q_indicators(spark, sf_dir):
    from ..operators.profile import indicators
    return _round(indicators(fx.table(spark, sf_dir, "lineitem"), _IND), 6)


_LI_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
             "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
             "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
VARTYPES_SQL = "\nUNION ALL\n".join(
    (f"SELECT '{c}' AS column_name, '{t}' AS dtype, CASE WHEN count(DISTINCT {c}) < 10 THEN 'categorical' "
     f"ELSE 'numeric' END AS var_type FROM lineitem") if t in ("bigint", "int") else
    (f"SELECT '{c}', '{t}', '{'numeric' if t == 'double' else 'categorical'}'")
    for c, t in _LI_TYPES.items())


@register("variable_types", VARTYPES_SQL)
def q_variable_types(spark, sf_dir):
    from ..operators.profile import variable_types
    return variable_types(fx.table(spark, sf_dir, "lineitem"))


HIST_SQL = """WITH s AS (SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
    quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
b AS (SELECT n, lo, hi, CAST(ceil((hi - lo) / least(2.0 * (q3 - q1) * pow(n, -1.0 / 3.0), (hi - lo) / (log2(n) + 1.0))) AS BIGINT) AS nb FROM s),
c AS (SELECT least(greatest(CAST(floor((l_extendedprice - lo) * CAST(nb AS DOUBLE) / (hi - lo)) AS BIGINT), 0), nb - 1) AS bin,
        count(*) AS n FROM lineitem, b GROUP BY 1),
g AS (SELECT unnest(generate_series(0, nb - 1)) AS bin, lo, hi, nb FROM b)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / nb), 6) AS lo,
       round(lo + (g.bin + 1) * ((hi - lo) / nb), 6) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c ON g.bin = c.bin"""


@register("histogram", HIST_SQL)
def q_histogram(spark, sf_dir):
    from ..operators.profile import histogram
    return _round(histogram(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice"), 6)


KDE_SQL = """WITH s AS (SELECT count(l_quantity) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi,
      stddev_samp(l_quantity) AS sd FROM lineitem),
p AS (SELECT n, lo, hi, sd * pow(n, -0.2) AS bw, (hi - lo) / 2048 AS w FROM s),
fine AS (SELECT least(CAST(floor((l_quantity - lo) / w) AS BIGINT), 2047) AS b, count(*) AS c FROM lineitem, p GROUP BY 1),
cent AS (SELECT lo + (b + 0.5) * w AS centre, c FROM fine, p),
grid AS (SELECT (lo - 3.0 * bw) + i * (((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199) AS x FROM p, range(200) r(i))
SELECT round(x, 4) AS x, round(sum(c * exp(-0.5 * ((x - centre) / bw) * ((x - centre) / bw))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM grid, cent, p GROUP BY x, n, bw"""


@register("kde", KDE_SQL)
def q_kde(spark, sf_dir):
    from ..operators.profile import kde
    d = kde(fx.table(spark, sf_dir, "lineitem"), "l_quantity")
    return d.select(F.round("x", 4).alias("x"), F.round("density", 6).alias("density"))


@register("value_counts", """SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n FROM orders
GROUP BY o_orderpriority""")
def q_value_counts(spark, sf_dir):
    from ..operators.rules import value_counts
    return value_counts(fx.table(spark, sf_dir, "orders"), "o_orderpriority")
