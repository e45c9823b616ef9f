"""Catalogue part 3: validation, bivariate statistics, outliers, evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from .catalog import DIRTY, _COLS, _FLOAT_COLS, _missing, _round, register

SE = "WITH " + fx.scored_events_sql()
SL = "WITH " + fx.scored_lines_sql()
_LI4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _events(spark, sf_dir):
    return fx.scored_events(spark, sf_dir)


def _lines(spark, sf_dir):
    return fx.scored_lines(spark, sf_dir)


# ---------------------------------------------------------------- V1-V9
@register("validate_table", """
SELECT 'min_rows' AS "check", count(*) >= 10 AS passed, CAST(count(*) AS DOUBLE) AS value, 10.0 AS threshold FROM orders
UNION ALL SELECT 'min_columns', true, 6.0, 2.0
UNION ALL SELECT 'not_all_null', count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice)
  + count(o_orderdate) + count(o_orderpriority) > 0, CAST(count(o_orderkey) + count(o_custkey) + count(o_orderstatus)
  + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority) AS DOUBLE), 1.0 FROM orders""")
def q_validate_table(spark, sf_dir):
    from ..operators.validate import validate_table
    return validate_table(fx.table(spark, sf_dir, "orders"), min_rows=10, min_cols=2)


@register("validate_target", """
SELECT 'target_exists' AS "check", true AS passed, 1.0 AS value, 1.0 AS threshold
UNION ALL SELECT 'target_not_all_null', count(status) > 0, CAST(count(status) AS DOUBLE), 1.0 FROM (""" + DIRTY + """
  SELECT * FROM dirty_orders)
UNION ALL SELECT 'target_two_classes', count(DISTINCT status) >= 2, CAST(count(DISTINCT status) AS DOUBLE), 2.0 FROM (""" + DIRTY + """
  SELECT * FROM dirty_orders)""")
def q_validate_target(spark, sf_dir):
    from ..operators.validate import validate_target
    return validate_target(fx.dirty_orders(spark, sf_dir), "status")


def _q_flags_sql():
    strings = [c for c in _COLS if c not in _FLOAT_COLS and c not in ("o_orderkey", "o_custkey")]
    miss = " OR ".join(f"sum(CASE WHEN {_missing(c)} THEN 1 ELSE 0 END) > 0" for c in _COLS)
    high = " OR ".join(f"count(DISTINCT {c}) > 100" for c in strings)
    per = "\nUNION ALL ".join(
        f"SELECT 'pct_missing', '{c}', round(sum(CASE WHEN {_missing(c)} THEN 1 ELSE 0 END) / count(*) * 100.0, 2) FROM dirty_orders"
        for c in _COLS)
    return DIRTY + f"""
SELECT 'has_missing' AS flag, CAST(NULL AS VARCHAR) AS column_name, CAST(({miss}) AS DOUBLE) AS value FROM dirty_orders
UNION ALL SELECT 'has_duplicates', NULL, CAST((SELECT count(*) FROM dirty_orders) > (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS DOUBLE)
UNION ALL SELECT 'has_high_cardinality', NULL, CAST(({high}) AS DOUBLE) FROM dirty_orders
UNION ALL {per}"""


@register("quality_flags", _q_flags_sql())
def q_quality_flags(spark, sf_dir):
    from ..operators.validate import quality_flags
    return quality_flags(fx.dirty_orders(spark, sf_dir))


def _premodel_sql():
    feats = [c for c in _COLS if c != "status"]
    strings = ["price_txt", "date_txt", "email", "constant_col", "priority"]
    parts = []
    for c in feats:
        parts.append(f"SELECT 'warning' AS level, 'missing_values' AS \"check\", '{c}' AS column_name, "
                     f"CAST(sum(CASE WHEN {_missing(c)} THEN 1 ELSE 0 END) AS BIGINT) AS value FROM dirty_orders "
                     f"HAVING sum(CASE WHEN {_missing(c)} THEN 1 ELSE 0 END) > 0")
    for c in strings:
        parts.append(f"SELECT 'warning', 'high_cardinality', '{c}', CAST(count(DISTINCT {c}) AS BIGINT) FROM dirty_orders "
                     f"HAVING count(DISTINCT {c}) > 100")
    for c in _FLOAT_COLS:
        parts.append(f"SELECT 'warning', 'infinite_values', '{c}', CAST(sum(CASE WHEN abs({c}) = 'Infinity'::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) "
                     f"FROM dirty_orders HAVING sum(CASE WHEN abs({c}) = 'Infinity'::DOUBLE THEN 1 ELSE 0 END) > 0")
    parts.append("SELECT 'error', 'empty_target', 'status', CAST(0 AS BIGINT) FROM dirty_orders HAVING count(status) = 0")
    return DIRTY + "\n" + "\nUNION ALL ".join(parts)


@register("premodel_checks", _premodel_sql())
def q_premodel_checks(spark, sf_dir):
    from ..operators.validate import premodel_checks
    return premodel_checks(fx.dirty_orders(spark, sf_dir), "status")


@register("clean_target", DIRTY + "\nSELECT * FROM dirty_orders WHERE status IS NOT NULL")
def q_clean_target(spark, sf_dir):
    from ..operators.validate import clean_target
    return clean_target(fx.dirty_orders(spark, sf_dir), "status", "drop")


@register("clean_target_impute", DIRTY + """,
m AS (SELECT avg(price) FILTER (WHERE NOT isnan(price)) AS m FROM dirty_orders)
SELECT o_orderkey, o_custkey, round(CASE WHEN price IS NULL OR isnan(price) THEN (SELECT m FROM m) ELSE price END, 6) AS price,
  price_txt, status, date_txt, email, ratio, constant_col, priority FROM dirty_orders""")
def q_clean_target_impute(spark, sf_dir):
    from ..operators.validate import clean_target
    return _round(clean_target(fx.dirty_orders(spark, sf_dir), "price", "impute"), 6, ["price"])


@register("detect_task", """SELECT CASE WHEN count(DISTINCT try_cast(o_orderstatus AS DOUBLE)) = 0 THEN 'classification' ELSE 'regression' END AS task,
  CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_distinct, CAST(count(*) AS BIGINT) AS n_rows FROM orders""")
def q_detect_task(spark, sf_dir):
    from ..operators.validate import detect_task
    return detect_task(fx.table(spark, sf_dir, "orders"), "o_orderstatus")


@register("detect_task_numeric", """SELECT CASE WHEN count(DISTINCT o_totalprice) <= 20
  AND count(DISTINCT o_totalprice) / count(*) < 0.1 THEN 'classification' ELSE 'regression' END AS task,
  CAST(count(DISTINCT o_totalprice) AS BIGINT) AS n_distinct, CAST(count(*) AS BIGINT) AS n_rows FROM orders""")
def q_detect_task_numeric(spark, sf_dir):
    from ..operators.validate import detect_task
    return detect_task(fx.table(spark, sf_dir, "orders"), "o_totalprice")


@register("detect_eval_task", """SELECT CASE WHEN count(DISTINCT l_linenumber) < 20 AND bool_and(l_linenumber % 1 = 0)
  THEN 'classification' ELSE 'regression' END AS task, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS n_distinct,
  bool_and(l_linenumber % 1 = 0) AS all_integral FROM lineitem""")
def q_detect_eval_task(spark, sf_dir):
    from ..operators.validate import detect_eval_task
    return detect_eval_task(fx.table(spark, sf_dir, "lineitem"), "l_linenumber")


@register("target_summary", """WITH c AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST((SELECT sum(n) FROM c) AS BIGINT) AS n_valid, CAST((SELECT count(*) FROM c) AS BIGINT) AS n_distinct,
  'mode' AS statistic, (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS value""")
def q_target_summary(spark, sf_dir):
    from ..operators.validate import target_summary
    return target_summary(fx.table(spark, sf_dir, "orders"), "o_orderstatus", "classification")


@register("target_summary_regression", """SELECT CAST(count(o_totalprice) AS BIGINT) AS n_valid,
  CAST(count(DISTINCT o_totalprice) AS BIGINT) AS n_distinct, 'mean' AS statistic,
  CAST(round(avg(o_totalprice), 4) AS VARCHAR) AS value FROM orders""")
def q_target_summary_regression(spark, sf_dir):
    from ..operators.validate import target_summary
    d = target_summary(fx.table(spark, sf_dir, "orders"), "o_totalprice", "regression")
    return d.withColumn("value", F.round(F.col("value").cast("double"), 4).cast("string"))


# ---------------------------------------------------------------- B1-B8
@register("contingency", """WITH a AS (SELECT DISTINCT l_returnflag FROM lineitem), b AS (SELECT DISTINCT l_linestatus FROM lineitem),
c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.l_returnflag, b.l_linestatus, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM a CROSS JOIN b LEFT JOIN c ON a.l_returnflag = c.l_returnflag AND b.l_linestatus = c.l_linestatus""")
def q_contingency(spark, sf_dir):
    from ..operators.bivariate import contingency
    return contingency(fx.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register("box_stats", """WITH f AS (SELECT o_orderpriority AS cat, quantile_cont(o_totalprice, 0.25) AS q1,
    quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3, count(*) AS n FROM orders GROUP BY 1)
SELECT f.cat AS o_orderpriority, CAST(f.n AS BIGINT) AS n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN o_totalprice >= q1 - 1.5 * (q3 - q1) THEN o_totalprice END), 6) AS whisker_low,
  round(max(CASE WHEN o_totalprice <= q3 + 1.5 * (q3 - q1) THEN o_totalprice END), 6) AS whisker_high,
  CAST(sum(CASE WHEN o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM orders JOIN f ON orders.o_orderpriority = f.cat GROUP BY f.cat, f.n, q1, median, q3""")
def q_box_stats(spark, sf_dir):
    from ..operators.bivariate import box_stats
    return _round(box_stats(fx.table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), 6)


@register("linregress", """WITH t AS (SELECT count(*) - 2 AS v, least(40, abs(corr(l_quantity, l_extendedprice)) * sqrt((count(*) - 2)
    / (1 - pow(corr(l_quantity, l_extendedprice), 2)))) AS t FROM lineitem),
simpson AS (SELECT v, t * i / 4000 AS x, t / 12000 * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM t, range(0, 4001) r(i))
SELECT CAST(count(*) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r,
  round(corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice), 6) AS r2,
  round(sqrt((1 - corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice)) * var_pop(l_extendedprice)
    / var_pop(l_quantity) / (count(*) - 2)), 6) AS stderr,
  round(sqrt((1 - corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice)) * var_pop(l_extendedprice)
    / var_pop(l_quantity) / (count(*) - 2)) * sqrt(var_pop(l_quantity) + avg(l_quantity) * avg(l_quantity)), 6) AS intercept_stderr,
  round((SELECT 1 - 2 * sum(w * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + x * x / v, -(v + 1) / 2)) FROM simpson), 6) AS p_value
FROM lineitem""")
def q_linregress(spark, sf_dir):
    from ..operators.bivariate import linregress
    d = linregress(fx.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return _round(d, 6)


def _corr_sql(rank: bool):
    src = "lineitem"
    if rank:
        sel = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _LI4)
        src = f"(SELECT {sel} FROM lineitem)"
    parts = []
    for a in _LI4:
        for b in _LI4:
            if a == b:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, 1.0 AS corr")
            else:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM {src}")
    return "\nUNION ALL ".join(parts)


@register("corr_pearson", _corr_sql(False))
def q_corr_pearson(spark, sf_dir):
    from ..operators.bivariate import corr_matrix
    return _round(corr_matrix(fx.table(spark, sf_dir, "lineitem"), _LI4, "pearson"), 6)


@register("corr_spearman", _corr_sql(True))
def q_corr_spearman(spark, sf_dir):
    from ..operators.bivariate import corr_matrix
    return _round(corr_matrix(fx.table(spark, sf_dir, "lineitem"), _LI4, "spearman"), 6)


@register("corr_kendall", """WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, row_number() OVER () AS id FROM part),
pr AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s FROM p a JOIN p b ON a.id < b.id),
t AS (SELECT sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) AS d FROM pr),
n AS (SELECT count(*) AS n FROM p),
tx AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT count(*) AS k FROM p GROUP BY x)),
ty AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT count(*) AS k FROM p GROUP BY y))
SELECT CAST(n AS BIGINT) AS n, CAST(c AS DECIMAL(38,0)) AS n_concordant, CAST(d AS DECIMAL(38,0)) AS n_discordant,
  round((c - d) / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS tau
FROM t, n, tx, ty""")
def q_corr_kendall(spark, sf_dir):
    from ..operators.kendall import kendall_tau
    return _round(kendall_tau(fx.table(spark, sf_dir, "part"), "p_size", "p_retailprice"), 6)


# ---------------------------------------------------------------- O1-O4
# prices of the dirty orders: some are negative, some a hundred times too large
_PRICES = DIRTY + """,
x AS (SELECT price AS v FROM dirty_orders WHERE price IS NOT NULL AND NOT isnan(price)),
f AS (SELECT quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS lo,
             quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS hi,
             avg(v) AS m, stddev_pop(v) AS s FROM x)"""


def _prices(spark, sf_dir):
    return fx.dirty_orders(spark, sf_dir).select("o_orderkey", "price")


@register("outliers_iqr", _PRICES + "\nSELECT 'price' AS column_name, v AS value FROM x, f WHERE v < lo OR v > hi")
def q_outliers_iqr(spark, sf_dir):
    from ..operators.outliers import outliers_iqr
    return outliers_iqr(_prices(spark, sf_dir), ["price"])


@register("outliers_zscore", _PRICES + """
SELECT 'price' AS column_name, v AS value, round((v - m) / s, 6) AS z FROM x, f WHERE abs((v - m) / s) > 3""")
def q_outliers_zscore(spark, sf_dir):
    from ..operators.outliers import outliers_zscore
    return _round(outliers_zscore(_prices(spark, sf_dir), ["price"]), 6)


@register("outlier_summary", _PRICES + """
SELECT 'price' AS column_name, 'iqr' AS method, CAST(count(*) FILTER (WHERE v < lo OR v > hi) AS BIGINT) AS n_outliers,
  round(count(*) FILTER (WHERE v < lo OR v > hi) / count(*) * 100.0, 6) AS pct_outliers FROM x, f
UNION ALL SELECT 'price', 'zscore', CAST(count(*) FILTER (WHERE abs((v - m) / s) > 3) AS BIGINT),
  round(count(*) FILTER (WHERE abs((v - m) / s) > 3) / count(*) * 100.0, 6) FROM x, f""")
def q_outlier_summary(spark, sf_dir):
    from ..operators.outliers import outlier_summary
    return _round(outlier_summary(_prices(spark, sf_dir), ["price"], with_iforest=False), 6)


@register("outlier_summary_forest", _PRICES + """
SELECT 'isolation_forest' AS method, CAST(count(*) AS BIGINT) AS n_values, true AS share_in_range, true AS counts_agree FROM x""")
def q_outlier_summary_forest(spark, sf_dir):
    """Invariants of the forest row: about its share of the values at most is flagged, and the summary counts what the
    operator returns."""
    from ..operators.iforest import outliers_iforest
    from ..operators.outliers import outlier_summary
    d = _prices(spark, sf_dir)
    row = outlier_summary(d, ["price"]).where("method = 'isolation_forest'")
    flagged = outliers_iforest(d, ["price"]).agg(F.count(F.lit(1)).alias("k"))
    return row.join(F.broadcast(flagged)).select("method", F.round(F.col("n_outliers") / F.col("pct_outliers") * 100.0).cast("long").alias("n_values"),
                                                 F.col("pct_outliers").between(0.0, 10.5).alias("share_in_range"),
                                                 (F.col("n_outliers") == F.col("k")).alias("counts_agree"))


@register("shapiro")
def q_shapiro(spark, sf_dir):
    from ..operators.normality import shapiro
    return shapiro(fx.table(spark, sf_dir, "lineitem"), _LI4)


# ---------------------------------------------------------------- E1-E12
_CM = """, cm AS (SELECT label, prediction, count(*) AS n FROM scored_events GROUP BY 1, 2),
cls AS (SELECT label AS c FROM cm UNION SELECT prediction FROM cm),
per AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE label = c), 0) AS support,
               coalesce((SELECT sum(n) FROM cm WHERE prediction = c), 0) AS npred,
               coalesce((SELECT sum(n) FROM cm WHERE label = c AND prediction = c), 0) AS tp FROM cls),
pr AS (SELECT support, tp, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS p,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM per)"""


@register("cls_metrics", SE + _CM + """
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 6) AS f1_weighted,
  round(sum(p * support) / sum(support), 6) AS precision_weighted, round(sum(r * support) / sum(support), 6) AS recall_weighted
FROM pr""")
def q_cls_metrics(spark, sf_dir):
    from ..operators.evaluate import classification_metrics
    return _round(classification_metrics(_events(spark, sf_dir)), 6)


@register("confusion", SE + """, cm AS (SELECT CAST(label AS VARCHAR) AS label, CAST(prediction AS VARCHAR) AS prediction,
  count(*) AS n FROM scored_events GROUP BY 1, 2),
cls AS (SELECT label AS c FROM cm UNION SELECT prediction FROM cm)
SELECT a.c AS label, b.c AS prediction, CAST(coalesce(cm.n, 0) AS BIGINT) AS n
FROM cls a CROSS JOIN cls b LEFT JOIN cm ON cm.label = a.c AND cm.prediction = b.c""")
def q_confusion(spark, sf_dir):
    from ..operators.evaluate import confusion_matrix
    d = _events(spark, sf_dir)
    # display form of the classes as DuckDB casts doubles (1.0 -> '1.0')
    return confusion_matrix(d)


@register("reg_metrics", SL + """
SELECT round(avg((label - prediction) * (label - prediction)), 4) AS mse,
  round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS rmse,
  round(1 - avg((label - prediction) * (label - prediction)) / var_pop(label), 6) AS r2 FROM scored_lines""")
def q_reg_metrics(spark, sf_dir):
    from ..operators.evaluate import regression_metrics
    d = regression_metrics(_lines(spark, sf_dir))
    return d.select(F.round("mse", 4).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


_ROC_BASE = SE + """, g AS (SELECT probability AS threshold, sum(CASE WHEN label = 1.0 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN label = 1.0 THEN 0 ELSE 1 END) AS fp FROM scored_events GROUP BY 1),
c AS (SELECT threshold, tp, fp, sum(tp) OVER (ORDER BY threshold DESC) AS tps, sum(fp) OVER (ORDER BY threshold DESC) AS fps,
    row_number() OVER (ORDER BY threshold DESC) AS idx,
    lead(tp) OVER (ORDER BY threshold DESC) AS tp_next, lead(fp) OVER (ORDER BY threshold DESC) AS fp_next FROM g),
tot AS (SELECT sum(tp) AS P, sum(fp) AS N, count(*) AS k FROM g)"""


@register("roc", _ROC_BASE + """
SELECT CAST(0 AS BIGINT) AS idx, 'Infinity'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT CAST(idx AS BIGINT), round(threshold, 6), round(fps / N, 6), round(tps / P, 6) FROM c, tot
WHERE idx = 1 OR idx = k OR tp_next <> tp OR fp_next <> fp""")
def q_roc(spark, sf_dir):
    from ..operators.evaluate import roc_curve
    return _round(roc_curve(_events(spark, sf_dir)), 6)


@register("roc_auc", _ROC_BASE + """
SELECT round(sum(fp * (tps + tps - tp)) / (2.0 * max(P) * max(N)), 6) AS auc FROM c, tot""")
def q_roc_auc(spark, sf_dir):
    from ..operators.evaluate import roc_auc
    return _round(roc_auc(_events(spark, sf_dir)), 6)


@register("pr", _ROC_BASE + """
SELECT round(threshold, 6) AS threshold, round(CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0 END, 6) AS precision,
  round(tps / P, 6) AS recall FROM c, tot
UNION ALL SELECT NULL, 1.0, 0.0""")
def q_pr(spark, sf_dir):
    from ..operators.evaluate import pr_curve
    return _round(pr_curve(_events(spark, sf_dir)), 6)


def _decile_sql(fixture_sql, score):
    return fixture_sql + f""", e AS (SELECT list_sort(list_distinct(quantile_cont({score}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q
    FROM {'scored_events' if 'events' in fixture_sql else 'scored_lines'}),
d AS (SELECT s.*, len(list_filter(e.q[2:len(e.q) - 1], lambda v: {score} > v)) AS decile
    FROM {'scored_events' if 'events' in fixture_sql else 'scored_lines'} s, e)"""


@register("deciles_cls", _decile_sql(SE, "probability") + """
SELECT CAST(decile AS INTEGER) AS decile, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN label = 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
  round(avg(CASE WHEN label = 1.0 THEN 1 ELSE 0 END), 4) AS positive_rate, round(avg(probability), 4) AS mean_probability,
  round(min(probability), 4) AS min_probability, round(max(probability), 4) AS max_probability FROM d GROUP BY decile""")
def q_deciles_cls(spark, sf_dir):
    from ..operators.evaluate import decile_table
    return decile_table(_events(spark, sf_dir), "classification")


@register("deciles_reg", _decile_sql(SL, "prediction") + """
SELECT CAST(decile AS INTEGER) AS decile, round(avg(label), 4) AS true_mean, round(stddev_samp(label), 4) AS true_std,
  round(avg(prediction), 4) AS pred_mean, round(stddev_samp(prediction), 4) AS pred_std,
  round(avg(abs(label - prediction)), 4) AS error_mean, round(stddev_samp(abs(label - prediction)), 4) AS error_std
FROM d GROUP BY decile""")
def q_deciles_reg(spark, sf_dir):
    from ..operators.evaluate import decile_table
    return decile_table(_lines(spark, sf_dir), "regression")


@register("calibration", SE + """
SELECT CAST(len(list_filter([0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9],
  lambda v: probability > v)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(probability), 6) AS mean_predicted,
  round(avg(CASE WHEN label = 1.0 THEN 1.0 ELSE 0.0 END), 6) AS fraction_positive FROM scored_events GROUP BY 1""")
def q_calibration(spark, sf_dir):
    from ..operators.evaluate import calibration_curve
    return _round(calibration_curve(_events(spark, sf_dir)), 6)


@register("residual_hist", SL + """, r AS (SELECT label - prediction AS x FROM scored_lines),
s AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
c AS (SELECT least(greatest(CAST(floor((x - lo) * 30.0 / (hi - lo)) AS BIGINT), 0), 29) AS bin, count(*) AS n FROM r, s GROUP BY 1),
g AS (SELECT unnest(generate_series(0, 29)) AS bin, lo, hi FROM s)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / 30), 6) AS lo, round(lo + (g.bin + 1) * ((hi - lo) / 30), 6) AS hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c ON g.bin = c.bin""")
def q_residual_hist(spark, sf_dir):
    from ..operators.evaluate import residual_histogram
    return _round(residual_histogram(_lines(spark, sf_dir)), 6)


@register("prediction_range", SL + """
SELECT min(label) AS y_min, max(label) AS y_max, min(prediction) AS pred_min, max(prediction) AS pred_max FROM scored_lines""")
def q_prediction_range(spark, sf_dir):
    from ..operators.evaluate import prediction_range
    return prediction_range(_lines(spark, sf_dir))


@register("residuals", SL + "\nSELECT key, label, prediction, round(label - prediction, 6) AS residual FROM scored_lines")
def q_residuals(spark, sf_dir):
    from ..operators.evaluate import residuals
    return _round(residuals(_lines(spark, sf_dir)), 6, ["residual"])


@register("qq")
def q_qq(spark, sf_dir):
    from ..operators.evaluate import qq_table
    return qq_table(_lines(spark, sf_dir))


# ---------------------------------------------------------------- R1-R5
@register("report_preprocessing", DIRTY + """,
after AS (SELECT count(*) AS a FROM dirty_orders WHERE NOT (date_txt IS NULL OR try_strptime(date_txt, '%Y-%m-%d') IS NULL
    OR try_strptime(date_txt, '%Y-%m-%d') > TIMESTAMP '1998-06-30 00:00:00')),
b AS (SELECT count(*) AS b FROM dirty_orders)
SELECT 'rows_before' AS metric, CAST(b AS DOUBLE) AS value FROM b
UNION ALL SELECT 'rows_after', CAST(a AS DOUBLE) FROM after
UNION ALL SELECT 'rows_removed', CAST(b - a AS DOUBLE) FROM b, after
UNION ALL SELECT 'rows_removed_pct', round((b - a) / b * 100.0, 2) FROM b, after""")
def q_report_preprocessing(spark, sf_dir):
    from ..operators.correct import apply_rule_actions
    from ..operators.report import preprocessing_section
    d = fx.dirty_orders(spark, sf_dir)
    fixed, log = apply_rule_actions(d, fx.dirty_rules(spark), key="o_orderkey")
    return preprocessing_section(d, fixed, log)["summary"]


@register("report_data", DIRTY + """, s AS (SELECT count(*) AS n, """ + " + ".join(
    f"sum(CASE WHEN {_missing(c)} THEN 1 ELSE 0 END)" for c in _COLS) + """ AS m FROM dirty_orders)
SELECT 'rows' AS metric, CAST(n AS DOUBLE) AS value FROM s
UNION ALL SELECT 'columns', 10.0
UNION ALL SELECT 'missing_cells', CAST(m AS DOUBLE) FROM s
UNION ALL SELECT 'missing_pct', round(m / (n * 10.0) * 100.0, 2) FROM s""")
def q_report_data(spark, sf_dir):
    from ..operators.report import data_section
    return data_section(fx.dirty_orders(spark, sf_dir), order_by="o_orderkey")["summary"]


@register("report")
def q_report(spark, sf_dir):
    from ..operators.report import data_section, evaluation_section, report_table
    tables = {"data": data_section(fx.table(spark, sf_dir, "orders"), order_by="o_orderkey"),
              "evaluation": evaluation_section(_events(spark, sf_dir), "classification")}
    return report_table(tables)


# ---------------------------------------------------------------- streaming
@register("stream_anomaly_counts", """WITH a AS (
  SELECT ts, 'value' AS column_name, 'missing' AS anomaly FROM events WHERE value IS NULL OR isnan(value)
  UNION ALL SELECT ts, 'value', 'below_min' FROM events WHERE value < 0
  UNION ALL SELECT ts, 'value', 'above_max' FROM events WHERE value > 300
  UNION ALL SELECT ts, 'event_type', 'missing' FROM events WHERE event_type IS NULL
  UNION ALL SELECT ts, 'event_type', 'not_allowed' FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')
  UNION ALL SELECT ts, 'props', 'bad_format' FROM events WHERE NOT regexp_matches(props, '^\\{"k": \\d+\\}$'))
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, column_name, anomaly,
  CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1, 2, 3, 4""")
def q_stream_anomaly_counts(spark, sf_dir):
    from ..streaming.anomalies import anomaly_counts_by_window, run_to_table
    s = fx.events_stream(spark, sf_dir)
    return run_to_table(spark, anomaly_counts_by_window(s, fx.events_rules(spark), "event_id", "ts"))
