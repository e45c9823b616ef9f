"""Catalogue part 6: a column with infinities and NaN (``dirty_orders.ratio``), scores that are missing, and text whose
quoted fields hold line breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from .catalog import DIRTY, _round, register

_FINITE = DIRTY + """,
x AS (SELECT o_orderkey, ratio AS v FROM dirty_orders WHERE ratio IS NOT NULL AND NOT isnan(ratio) AND NOT isinf(ratio)),
f AS (SELECT avg(v) AS m, stddev_pop(v) AS s, stddev_samp(v) AS sd, count(*) AS n, min(v) AS lo, max(v) AS hi FROM x),
i AS (SELECT quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.75) AS q3, count(*) AS n FROM dirty_orders
      WHERE ratio IS NOT NULL AND NOT isnan(ratio))"""


@register("outliers_zscore_ratio", _FINITE + """
SELECT 'ratio' AS column_name, round(v, 6) AS value, round((v - m) / s, 6) AS z FROM x, f WHERE abs((v - m) / s) > 1.5""")
def q_outliers_zscore_ratio(spark, sf_dir):
    from ..operators.outliers import outliers_zscore
    return _round(outliers_zscore(fx.dirty_orders(spark, sf_dir), ["ratio"], threshold=1.5), 6)


@register("outlier_summary_ratio", _FINITE + """
SELECT 'ratio' AS column_name, 'iqr' AS method, CAST((SELECT count(*) FROM dirty_orders, i WHERE NOT isnan(ratio)
    AND (ratio < q1 - 1.5 * (q3 - q1) OR ratio > q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers,
  round((SELECT count(*) FROM dirty_orders, i WHERE NOT isnan(ratio) AND (ratio < q1 - 1.5 * (q3 - q1) OR ratio > q3 + 1.5 * (q3 - q1)))
        / (SELECT n FROM i) * 100.0, 6) AS pct_outliers
UNION ALL SELECT 'ratio', 'zscore', CAST(count(*) FILTER (WHERE abs((v - m) / s) > 1.5) AS BIGINT),
  round(count(*) FILTER (WHERE abs((v - m) / s) > 1.5) / (SELECT n FROM i) * 100.0, 6) FROM x, f""")
def q_outlier_summary_ratio(spark, sf_dir):
    from ..operators.outliers import outlier_summary
    return _round(outlier_summary(fx.dirty_orders(spark, sf_dir), ["ratio"], threshold=1.5, with_iforest=False), 6)


@register("kde_ratio", _FINITE + """,
p AS (SELECT n, lo, hi, sd * pow(n, -0.2) AS bw, (hi - lo) / 2048 AS w FROM f),
fine AS (SELECT least(CAST(floor((v - lo) / w) AS BIGINT), 2047) AS b, count(*) AS c FROM x, p GROUP BY 1),
cent AS (SELECT lo + (b + 0.5) * w AS centre, c FROM fine, p),
grid AS (SELECT (lo - 3.0 * bw) + i * (((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199) AS g FROM p, range(200) r(i))
SELECT round(g, 4) AS x, round(sum(c * exp(-0.5 * ((g - centre) / bw) * ((g - centre) / bw))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM grid, cent, p GROUP BY g, n, bw""")
def q_kde_ratio(spark, sf_dir):
    from ..operators.profile import kde
    d = kde(fx.dirty_orders(spark, sf_dir), "ratio")
    return d.select(F.round("x", 4).alias("x"), F.round("density", 6).alias("density"))


@register("numeric_stage_ratio", _FINITE + """,
md AS (SELECT quantile_cont(v, 0.5) AS med FROM x),
filled AS (SELECT o_orderkey, CASE WHEN ratio IS NULL OR isnan(ratio) OR isinf(ratio) THEN med ELSE ratio END AS v FROM dirty_orders, md),
m AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM filled)
SELECT o_orderkey, round((v - mu) / sd, 6) AS ratio_scaled FROM filled, m""")
def q_numeric_stage_ratio(spark, sf_dir):
    from ..ml.features import NumericStage
    d = fx.dirty_orders(spark, sf_dir)
    m = NumericStage(inputCols=["ratio"], outputCols=["ratio_scaled"], scale=True).fit(d)
    return _round(m.transform(d).select("o_orderkey", "ratio_scaled"), 6)


# the scored events, with a NaN or missing score or a missing label on some of them
_HOLES = "CASE WHEN key % 19 = 0 THEN CAST('NaN' AS double) WHEN key % 23 = 0 THEN NULL ELSE probability END AS probability"
_UNSURE = "CASE WHEN key % 29 = 0 THEN NULL ELSE label END AS label"
_HOLED = "WITH " + fx.scored_events_sql() + f""",
holed AS (SELECT key, {_UNSURE}, {_HOLES} FROM scored_events),
known AS (SELECT * FROM holed WHERE probability IS NOT NULL AND NOT isnan(probability) AND label IS NOT NULL)"""


def _holed(spark, sf_dir):
    return fx.scored_events(spark, sf_dir).selectExpr("key", _UNSURE, _HOLES)


@register("roc_auc_missing", _HOLED + """,
r AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS rk FROM known)
SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auc FROM r""")
def q_roc_auc_missing(spark, sf_dir):
    from ..operators.evaluate import roc_auc
    return _round(roc_auc(_holed(spark, sf_dir)), 9)


@register("calibration_missing", _HOLED + """
SELECT CAST(least(greatest(ceil(probability * 10.0) - 1, 0), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n,
  round(avg(probability), 6) AS mean_predicted, round(avg(label), 6) AS fraction_positive FROM known GROUP BY 1""")
def q_calibration_missing(spark, sf_dir):
    from ..operators.evaluate import calibration_curve
    return _round(calibration_curve(_holed(spark, sf_dir)), 6)


@register("scan_quoted", "SELECT doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang, nullif(source, '') AS source, n_chars FROM documents")
def q_scan_quoted(spark, sf_dir):
    """Texts with line breaks, written as quoted CSV and read back by as many tasks as the files have blocks."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.files import scan_delimited
    docs = fx.table(spark, sf_dir, "documents")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quoted-{uuid.uuid4().hex}"
    docs.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return scan_delimited(spark, path, schema=docs.schema, multi_line=True)[0]


def _tree_model(spark, sf_dir, name, params):
    """A fitted tree model on the prepared orders, their features, and its feature names."""
    from ..ml.compare import n_classes, prepare_features
    from ..ml.features import feature_names
    from ..ml.models import make_estimator
    from .ml_queries import _prepared
    d, task = _prepared(spark, sf_dir)
    _, data, _ = prepare_features(d)
    train = data.where("split = 'train'")
    return make_estimator(name, task, train, params, n_classes=n_classes(train)).fit(train), data, feature_names(data)


@register("shapley_tree")
def q_shapley_tree(spark, sf_dir):
    from ..ml.tree_shap import shapley_trees
    model, data, names = _tree_model(spark, sf_dir, "random_forest", {"n_estimators": 20, "max_depth": 6})
    return shapley_trees(model, data.where("split = 'test'"), names)


@register("shapley_tree_additive", "SELECT o_orderkey, true AS additive FROM orders")
def q_shapley_tree_additive(spark, sf_dir):
    """Whether the attributions of every order sum to the forest's probability."""
    from pyspark.ml.functions import vector_to_array

    from ..ml.tree_shap import tree_attributions
    model, data, _ = _tree_model(spark, sf_dir, "random_forest", {"n_estimators": 20, "max_depth": 6})
    found = tree_attributions(model, model.transform(data).withColumn("p", vector_to_array("probability")[1]), ["o_orderkey", "p"])
    total = F.aggregate("phi", F.col("base"), lambda a, x: a + x)
    return found.select("o_orderkey", (F.abs(total - F.col("p")) < 1e-9).alias("additive"))
