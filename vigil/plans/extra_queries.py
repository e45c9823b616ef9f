"""Catalogue part 5: scalar-function operators (P), remaining validation, bivariate,
profile, imputation and model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from .catalog import DIRTY, DQ_DETECT_SQL, _round, register

_LI4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DIRTY_COLS = "o_orderkey, o_custkey, price, price_txt, status, date_txt, email, ratio, constant_col, priority"


# ---------------------------------------------------------------- P1-P15
@register("normalize_missing", DIRTY + """
SELECT o_orderkey, o_custkey, CASE WHEN isnan(price) THEN NULL ELSE price END AS price,
  CASE WHEN price_txt = 'n/a?' THEN NULL ELSE price_txt END AS price_txt, status, date_txt, email,
  CASE WHEN isnan(ratio) THEN NULL ELSE ratio END AS ratio, constant_col, priority FROM dirty_orders""")
def q_normalize_missing(spark, sf_dir):
    from ..functions.exprs import normalize_missing
    return normalize_missing(fx.dirty_orders(spark, sf_dir), tokens=["n/a?"])


@register("select_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                            "l_discount, l_tax FROM lineitem")
def q_select_numeric(spark, sf_dir):
    from ..functions.exprs import select_numeric
    return select_numeric(fx.table(spark, sf_dir, "lineitem"))


@register("select_categorical", "SELECT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def q_select_categorical(spark, sf_dir):
    from ..functions.exprs import select_categorical
    return select_categorical(fx.table(spark, sf_dir, "lineitem"))


@register("split_xy", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def q_split_xy(spark, sf_dir):
    from ..operators.frame import split_xy
    return split_xy(fx.table(spark, sf_dir, "orders"), "o_orderstatus")[0]


@register("drop_missing_rows", DIRTY + """
SELECT o_orderkey, o_custkey, price, price_txt, status, date_txt, email,
  CASE WHEN isnan(ratio) THEN NULL ELSE ratio END AS ratio, constant_col, priority
FROM dirty_orders WHERE price IS NOT NULL AND NOT isnan(price) AND status IS NOT NULL""")
def q_drop_missing_rows(spark, sf_dir):
    from ..operators.frame import drop_missing_rows
    return drop_missing_rows(fx.dirty_orders(spark, sf_dir), ["price", "status"])[0]


@register("drop_missing_rows_log", DIRTY + """
SELECT CAST(count(*) AS BIGINT) AS rows_before,
  CAST(count(*) FILTER (WHERE price IS NOT NULL AND NOT isnan(price) AND status IS NOT NULL) AS BIGINT) AS rows_after,
  CAST(count(*) - count(*) FILTER (WHERE price IS NOT NULL AND NOT isnan(price) AND status IS NOT NULL) AS BIGINT) AS rows_removed
FROM dirty_orders""")
def q_drop_missing_rows_log(spark, sf_dir):
    from ..operators.frame import drop_missing_rows
    return drop_missing_rows(fx.dirty_orders(spark, sf_dir), ["price", "status"])[1]


@register("drop_columns", DIRTY + """
SELECT o_orderkey, o_custkey, price, price_txt, status, date_txt, email, ratio, priority FROM dirty_orders""")
def q_drop_columns(spark, sf_dir):
    from ..operators.frame import drop_columns
    return drop_columns(fx.dirty_orders(spark, sf_dir), ["constant_col"])[0]


@register("filter_anomalies", DQ_DETECT_SQL + """
SELECT * FROM a WHERE anomaly IN ('missing', 'bad_format') AND column_name IN ('price', 'email', 'status')""")
def q_filter_anomalies(spark, sf_dir):
    from ..operators.rules import detect_anomalies, filter_anomalies
    a = detect_anomalies(fx.dirty_orders(spark, sf_dir), fx.dirty_rules(spark), key="o_orderkey")
    return filter_anomalies(a, ["missing", "bad_format"], ["price", "email", "status"])


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def q_preview(spark, sf_dir):
    from ..operators.frame import preview
    return preview(fx.table(spark, sf_dir, "orders"), 5, "o_orderkey")


@register("sample_for_profile", """SELECT * FROM lineitem WHERE CAST('0x' || substr(md5('42:' || l_orderkey || ':' || l_linenumber), 1, 13) AS BIGINT)
  / 4503599627370496.0 < 0.1""")
def q_sample_for_profile(spark, sf_dir):
    from ..operators.frame import sample_rows
    return sample_rows(fx.table(spark, sf_dir, "lineitem"), 0.1, ["l_orderkey", "l_linenumber"])


@register("format_metrics", DIRTY + """
SELECT o_orderkey, CASE WHEN isnan(ratio) OR isinf(ratio) THEN ratio ELSE round(ratio, 3) END AS ratio FROM dirty_orders""")
def q_format_metrics(spark, sf_dir):
    from ..functions.exprs import format_metrics
    return format_metrics(fx.dirty_orders(spark, sf_dir).select("o_orderkey", "ratio"), 3)


@register("cats_to_string", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""")
def q_cats_to_string(spark, sf_dir):
    from ..functions.exprs import cats_to_string
    return cats_to_string(fx.table(spark, sf_dir, "orders"))


# ---------------------------------------------------------------- V3, A3, B3, B8, C7-C9
@register("validate_split", """WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS t FROM orders)
SELECT 'train_not_empty' AS "check", n - t > 0 AS passed, CAST(n - t AS DOUBLE) AS value, 1.0 AS threshold FROM n
UNION ALL SELECT 'test_not_empty', t > 0, CAST(t AS DOUBLE), 1.0 FROM n
UNION ALL SELECT 'labels_match_rows', count(o_orderstatus) = count(*), CAST(count(*) - count(o_orderstatus) AS DOUBLE), 0.0 FROM orders
UNION ALL SELECT 'train_no_infinite', count(*) FILTER (WHERE isinf(o_totalprice)) = 0,
  CAST(count(*) FILTER (WHERE isinf(o_totalprice)) AS DOUBLE), 0.0 FROM orders""")
def q_validate_split(spark, sf_dir):
    from ..ml.features import split
    from ..operators.validate import validate_split
    d = split(fx.table(spark, sf_dir, "orders"), "o_orderkey").withColumnRenamed("o_orderstatus", "label")
    return validate_split(d, label="label")


@register("table_profile", DIRTY + """,
dup AS (SELECT (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS d)
SELECT column_name, dtype, n_rows, n_missing, pct_missing, n_distinct, n_infinite, n_distinct = 1 AS is_constant,
  n_distinct > n_rows * 0.5 AS is_high_cardinality, CAST((SELECT d FROM dup) AS BIGINT) AS n_duplicates, var_type,
  CAST(10 AS BIGINT) AS n_columns
FROM (
  SELECT 'o_orderkey' AS column_name, 'bigint' AS dtype, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_missing,
    0.0 AS pct_missing, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_distinct, CAST(0 AS BIGINT) AS n_infinite,
    CASE WHEN count(DISTINCT o_orderkey) < 10 THEN 'categorical' ELSE 'numeric' END AS var_type FROM dirty_orders
  UNION ALL SELECT 'o_custkey', 'bigint', count(*), 0, 0.0, count(DISTINCT o_custkey), 0,
    CASE WHEN count(DISTINCT o_custkey) < 10 THEN 'categorical' ELSE 'numeric' END FROM dirty_orders
  UNION ALL SELECT 'price', 'double', count(*), sum(CASE WHEN price IS NULL OR isnan(price) THEN 1 ELSE 0 END),
    round(sum(CASE WHEN price IS NULL OR isnan(price) THEN 1 ELSE 0 END) / count(*) * 100.0, 2),
    count(DISTINCT CASE WHEN NOT isnan(price) THEN price END), 0, 'numeric' FROM dirty_orders
  UNION ALL SELECT 'price_txt', 'string', count(*), count(*) - count(price_txt), round((count(*) - count(price_txt)) / count(*) * 100.0, 2),
    count(DISTINCT price_txt), 0, 'categorical' FROM dirty_orders
  UNION ALL SELECT 'status', 'string', count(*), count(*) - count(status), round((count(*) - count(status)) / count(*) * 100.0, 2),
    count(DISTINCT status), 0, 'categorical' FROM dirty_orders
  UNION ALL SELECT 'date_txt', 'string', count(*), count(*) - count(date_txt), round((count(*) - count(date_txt)) / count(*) * 100.0, 2),
    count(DISTINCT date_txt), 0, 'categorical' FROM dirty_orders
  UNION ALL SELECT 'email', 'string', count(*), 0, 0.0, count(DISTINCT email), 0, 'categorical' FROM dirty_orders
  UNION ALL SELECT 'ratio', 'double', count(*), sum(CASE WHEN ratio IS NULL OR isnan(ratio) THEN 1 ELSE 0 END),
    round(sum(CASE WHEN ratio IS NULL OR isnan(ratio) THEN 1 ELSE 0 END) / count(*) * 100.0, 2),
    count(DISTINCT CASE WHEN NOT isnan(ratio) THEN ratio END),
    sum(CASE WHEN abs(ratio) = 'Infinity'::DOUBLE THEN 1 ELSE 0 END), 'numeric' FROM dirty_orders
  UNION ALL SELECT 'constant_col', 'string', count(*), 0, 0.0, count(DISTINCT constant_col), 0, 'categorical' FROM dirty_orders
  UNION ALL SELECT 'priority', 'string', count(*), 0, 0.0, count(DISTINCT priority), 0, 'categorical' FROM dirty_orders
) p""")
def q_table_profile(spark, sf_dir):
    from ..operators.profile import table_profile
    return table_profile(fx.dirty_orders(spark, sf_dir))


@register("scatter_points", """SELECT l_quantity, l_extendedprice FROM lineitem
  WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def q_scatter_points(spark, sf_dir):
    from ..operators.bivariate import scatter_points
    return scatter_points(fx.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


def _corr_wide_sql():
    rows = []
    for a in _LI4:
        cells = ", ".join((f"1.0 AS {b}" if a == b else f"round(corr({a}, {b}), 3) AS {b}") for b in sorted(_LI4))
        rows.append(f"SELECT '{a}' AS variable, {cells} FROM lineitem")
    return "\nUNION ALL ".join(rows)


@register("corr_wide", _corr_wide_sql())
def q_corr_wide(spark, sf_dir):
    from ..operators.bivariate import corr_matrix, corr_wide
    m = corr_matrix(fx.table(spark, sf_dir, "lineitem"), _LI4, "pearson")
    return corr_wide(m, 3, order=sorted(_LI4))


@register("impute_mean", DIRTY + """, m AS (SELECT avg(price) FILTER (WHERE NOT isnan(price)) AS p FROM dirty_orders),
md AS (SELECT v FROM (SELECT status AS v, count(*) AS n FROM dirty_orders WHERE status IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)
SELECT o_orderkey, o_custkey, round(CASE WHEN price IS NULL OR isnan(price) THEN (SELECT p FROM m) ELSE price END, 6) AS price,
  price_txt, coalesce(status, (SELECT v FROM md)) AS status, date_txt, email, ratio, constant_col, priority FROM dirty_orders""")
def q_impute_mean(spark, sf_dir):
    from ..operators.correct import impute
    return _round(impute(fx.dirty_orders(spark, sf_dir), ["price", "status"], "mean")[0], 6, ["price"])


@register("impute_median", DIRTY + """, m AS (SELECT quantile_cont(price, 0.5) FILTER (WHERE NOT isnan(price)) AS p FROM dirty_orders)
SELECT o_orderkey, o_custkey, CASE WHEN price IS NULL OR isnan(price) THEN (SELECT p FROM m) ELSE price END AS price,
  price_txt, status, date_txt, email, ratio, constant_col, priority FROM dirty_orders""")
def q_impute_median(spark, sf_dir):
    from ..operators.correct import impute
    return impute(fx.dirty_orders(spark, sf_dir), ["price"], "median")[0]


@register("impute_mode", DIRTY + """,
md AS (SELECT v FROM (SELECT date_txt AS v, count(*) AS n FROM dirty_orders WHERE date_txt IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)
SELECT o_orderkey, o_custkey, price, price_txt, status, coalesce(date_txt, (SELECT v FROM md)) AS date_txt, email, ratio,
  constant_col, priority FROM dirty_orders""")
def q_impute_mode(spark, sf_dir):
    from ..operators.correct import impute
    return impute(fx.dirty_orders(spark, sf_dir), ["date_txt"], "mode")[0]


# ---------------------------------------------------------------- O3, models
@register("outliers_iforest")
def q_outliers_iforest(spark, sf_dir):
    from ..operators.iforest import outliers_iforest
    return outliers_iforest(fx.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


@register("elastic_net_fit", """WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v,
  avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
w AS (SELECT sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5) AS w, mx, my FROM s)
SELECT round(w, 4) AS slope, round(my - w * mx, 4) AS intercept FROM w""")
def q_elastic_net_fit(spark, sf_dir):
    from ..ml.models import make_estimator
    from .ml_queries import _coef_row, _one_feature
    d = _one_feature(spark, sf_dir)
    m = make_estimator("elastic_net", "regression", d, {"alpha": 1.0, "l1_ratio": 0.5}).fit(d)
    return _round(_coef_row(m), 4)


@register("naive_bayes_means", """SELECT CAST(o_orderstatus = 'F' AS INTEGER) * 1.0 AS label,
  round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1""")
def q_naive_bayes_means(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from ..ml.models import make_estimator
    d = fx.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"), "o_totalprice")
    d = VectorAssembler(inputCols=["o_totalprice"], outputCol="features").transform(d)
    m = make_estimator("naive_bayes", "classification", d).fit(d)
    theta = m.theta.toArray()
    rows = [(float(i), round(float(theta[i][0]), 4)) for i in range(theta.shape[0])]
    return spark.createDataFrame(rows, "label double, mean_price double")


def _prepared(spark, sf_dir):
    from .ml_queries import _prepared as p
    return p(spark, sf_dir)


@register("knn_predict")
def q_knn_predict(spark, sf_dir):
    from ..ml.compare import fit_model
    d, task = _prepared(spark, sf_dir)
    return fit_model(d, "knn", task, {"n_neighbors": 5}, key="o_orderkey")[1]


@register("adaboost_predict")
def q_adaboost_predict(spark, sf_dir):
    from ..ml.compare import fit_model
    d, task = _prepared(spark, sf_dir)
    return fit_model(d, "adaboost", task, key="o_orderkey")[1]


def _price_regression(spark, sf_dir):
    """Line prices from the other numbers of a line, over all of lineitem."""
    from ..ml.features import prepare
    d = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    return prepare(d, "l_extendedprice", key="line", task="regression")


def _register_predictions(name, model, source, key, params=None):
    @register(name)
    def run(spark, sf_dir):
        from ..ml.compare import fit_model
        d, task = source(spark, sf_dir)
        return fit_model(d, model, task, params, key=key)[1]


_register_predictions("gradient_boosting_predict", "gradient_boosting", _prepared, "o_orderkey")
_register_predictions("extra_trees_predict", "extra_trees", _prepared, "o_orderkey", {"n_estimators": 20, "max_depth": 8})
_register_predictions("svm_predict", "svm", _prepared, "o_orderkey")
_register_predictions("svr_predict", "svr", _price_regression, "line")


@register("compare_regression")
def q_compare_regression(spark, sf_dir):
    from ..ml.compare import compare_models
    d, task = _price_regression(spark, sf_dir)
    return compare_models(d, task, key="line").drop("fit_seconds")


@register("best_model")
def q_best_model(spark, sf_dir):
    from ..ml.compare import best_model, compare_models
    d, task = _prepared(spark, sf_dir)
    return best_model(compare_models(d, task, models=["naive_bayes", "decision_tree", "logistic_regression"], key="o_orderkey"), task)


@register("cross_val")
def q_cross_val(spark, sf_dir):
    from ..ml.compare import cross_val, prepare_features
    d, task = _prepared(spark, sf_dir)
    _, data, _ = prepare_features(d)
    score = cross_val(data.where("split = 'train'"), "naive_bayes", task, "o_orderkey", folds=5)
    return spark.createDataFrame([("naive_bayes", 5, score)], "model string, folds int, cv_score double")


@register("learning_curve")
def q_learning_curve(spark, sf_dir):
    from ..ml.compare import prepare_features
    from ..ml.explain import learning_curve
    d, task = _prepared(spark, sf_dir)
    _, data, _ = prepare_features(d)
    return learning_curve(data.where("split = 'train'"), "naive_bayes", task, "o_orderkey")


@register("shapley_linear", """SELECT 'l_quantity' AS feature,
  round(abs(regr_slope(l_extendedprice, l_quantity)) * avg(abs(l_quantity - m)), 4) AS importance
FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem) s""")
def q_shapley_linear(spark, sf_dir):
    from ..ml.explain import shapley_linear
    from ..ml.models import make_estimator
    from .ml_queries import _one_feature
    d = _one_feature(spark, sf_dir)
    m = make_estimator("linear_regression", "regression", d).fit(d)
    return _round(shapley_linear(m.coefficients.toArray().tolist(), ["l_quantity"], d), 4)


@register("shapley")
def q_shapley(spark, sf_dir):
    from ..ml.compare import fit_prepared, prepare_features
    from ..ml.explain import shapley_importance
    from ..ml.features import feature_names
    d, task = _prepared(spark, sf_dir)
    _, data, _ = prepare_features(d)
    model, _ = fit_prepared(data, "decision_tree", task, {"max_depth": 5})
    names = feature_names(data)
    return shapley_importance(model, data.where("split = 'test'"), names, n_perm=10, binary=True)


# rounded: a block's sums are added in any order
@register("shapiro_blocks")
def q_shapiro_blocks(spark, sf_dir):
    from ..operators.normality import shapiro_blocks
    return _round(shapiro_blocks(fx.dirty_orders(spark, sf_dir), ["price", "ratio"]), 6, ["w", "p_value"])


@register("normality_verdict")
def q_normality_verdict(spark, sf_dir):
    from ..operators.normality import normality_verdict
    return _round(normality_verdict(fx.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 6, ["p_value"])
