"""Catalogue part 4: feature preparation and models.

Closed-form models are checked against SQL (one feature: OLS, ridge, lasso); the
randomised or iterative ones (trees, boosting, comparisons) get a row-count check.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from .catalog import _round, register

HC = "WITH " + fx.high_card_sql()


def _high_card(spark, sf_dir):
    return fx.high_card(spark, sf_dir).drop("status")


@register("split")
def q_split(spark, sf_dir):
    from ..ml.features import split
    return split(fx.table(spark, sf_dir, "orders"), "o_orderkey", 0.2)


@register("split_sizes", """SELECT 'test' AS split, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM orders
UNION ALL SELECT 'train', CAST(count(*) - ceil(count(*) * 0.2) AS BIGINT) FROM orders""")
def q_split_sizes(spark, sf_dir):
    from ..ml.features import split
    s = split(fx.table(spark, sf_dir, "orders"), "o_orderkey", 0.2)
    return s.groupBy("split").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("target_encode", HC + """, p AS (SELECT avg(is_f) AS prior FROM high_card),
g AS (SELECT cust AS category, count(*) AS n, avg(is_f) AS m FROM high_card GROUP BY cust)
SELECT 'cust' AS column_name, category,
  round((1.0 / (1.0 + exp(-(n - 20.0) / 10.0))) * m + (1.0 - 1.0 / (1.0 + exp(-(n - 20.0) / 10.0))) * prior, 6) AS enc
FROM g, p""")
def q_target_encode(spark, sf_dir):
    from ..ml.features import TargetEncoderStage
    d = fx.high_card(spark, sf_dir)
    m = TargetEncoderStage(inputCols=["cust"], outputCols=["cust_te"], labelCol="is_f").fit(d)
    return _round(m.table, 6)


@register("numeric_stage", """WITH s AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM orders),
f AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT med FROM s)) AS x FROM orders),
m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM f)
SELECT o_orderkey, round((x - mu) / sd, 6) AS price_scaled FROM f, m""")
def q_numeric_stage(spark, sf_dir):
    from ..ml.features import NumericStage
    d = fx.table(spark, sf_dir, "orders")
    m = NumericStage(inputCols=["o_totalprice"], outputCols=["price_scaled"], scale=True).fit(d)
    return _round(m.transform(d).select("o_orderkey", "price_scaled"), 6)


def _one_feature(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        li.select("l_quantity", F.col("l_extendedprice").alias("label")))


def _coef_row(model):
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


@register("linear_fit", """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def q_linear_fit(spark, sf_dir):
    from ..ml.models import make_estimator
    d = _one_feature(spark, sf_dir)
    m = make_estimator("linear_regression", "regression", d).fit(d)
    return _round(_coef_row(m), 4)


@register("ridge_fit", """WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy,
  var_pop(l_quantity) * count(*) AS sxx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
SELECT round(sxy / (sxx + 1.0), 4) AS slope, round(my - sxy / (sxx + 1.0) * mx, 4) AS intercept FROM s""")
def q_ridge_fit(spark, sf_dir):
    from ..ml.models import make_estimator
    d = _one_feature(spark, sf_dir)
    m = make_estimator("ridge", "regression", d, {"alpha": 1.0}).fit(d)
    return _round(_coef_row(m), 4)


@register("lasso_fit", """WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v,
  avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
w AS (SELECT sign(c) * greatest(abs(c) - 1.0, 0) / v AS w, mx, my FROM s)
SELECT round(w, 4) AS slope, round(my - w * mx, 4) AS intercept FROM w""")
def q_lasso_fit(spark, sf_dir):
    from ..ml.models import make_estimator
    d = _one_feature(spark, sf_dir)
    m = make_estimator("lasso", "regression", d, {"alpha": 1.0}).fit(d)
    return _round(_coef_row(m), 4)


def _prepared(spark, sf_dir):
    from ..ml.features import prepare
    return prepare(_high_card(spark, sf_dir), "is_f", key="o_orderkey", task="classification")


@register("fit_logistic")
def q_fit_logistic(spark, sf_dir):
    from ..ml.compare import fit_model
    d, task = _prepared(spark, sf_dir)
    return fit_model(d, "logistic_regression", task, key="o_orderkey")[1]


@register("compare_models")
def q_compare_models(spark, sf_dir):
    from ..ml.compare import compare_models
    d, task = _prepared(spark, sf_dir)
    return compare_models(d, task, key="o_orderkey", max_workers=3).drop("fit_seconds")


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    from ..ml.compare import feature_importance, fit_model
    from ..ml.features import feature_names
    d, task = _prepared(spark, sf_dir)
    model, _ = fit_model(d, "decision_tree", task, {"max_depth": 5}, key="o_orderkey")
    names = feature_names(_features_frame(model, d))
    return feature_importance(model, names)


def _features_frame(model, d):
    from pyspark.ml import PipelineModel
    return PipelineModel(stages=model.stages[:-1]).transform(d)
