"""Evaluation tables (E1-E12) over a predictions DataFrame
(key, label, prediction[, probability]).

Classification metrics work from the confusion counts (one ``groupBy`` to a table of
at most #classes^2 rows); curves use the distributed running sums of
``functions.ranking`` over distinct scores, so no global sort lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import is_float_type, q
from ..functions.normal import add_inv_normal
from ..functions.ranking import ranks_from_counts, running_sum


# --------------------------------------------------------------------------- E2
def coerce_predictions(p: DataFrame, label: str = "label", prediction: str = "prediction",
                       binary: bool | None = None) -> DataFrame:
    """Floating predictions -> classes: binary target -> (p >= 0.5), otherwise
    round half to even; an array of class scores -> position of the maximum."""
    dt = p.schema[prediction].dataType
    if isinstance(dt, T.ArrayType):
        arr = q(prediction)
        return p.withColumn(prediction, (F.array_position(arr, F.array_max(arr)) - 1).cast("double"))
    if not isinstance(dt, (T.FloatType, T.DoubleType)):
        return p
    if binary is None:
        binary = p.select(q(label)).distinct().limit(3).count() == 2
    c = q(prediction)
    new = F.when(c >= 0.5, 1.0).otherwise(0.0) if binary else F.bround(c, 0)
    return p.withColumn(prediction, F.when(c.isNull(), None).otherwise(new))


# --------------------------------------------------------------------------- E1 / E4
def confusion_counts(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return p.groupBy(q(label).alias("label"), q(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_metrics(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1, precision, recall (0 where undefined).
    Output: one row."""
    cm = confusion_counts(p, label, prediction)
    tp = cm.where(F.col("label") == F.col("prediction")).groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("tp"))
    sup = cm.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"))
    pc = cm.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("npred"))
    # class tables have one row per class: tiny joins
    per = sup.join(pc, "c", "full").join(tp, "c", "left").fillna(0, ["tp", "support", "npred"])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    per = per.select("support", "tp", prec.alias("p"), rec.alias("r"), f1.alias("f"))
    tot = F.sum("support")
    return per.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("f") * F.col("support")) / tot).alias("f1_weighted"),
        (F.sum(F.col("p") * F.col("support")) / tot).alias("precision_weighted"),
        (F.sum(F.col("r") * F.col("support")) / tot).alias("recall_weighted"))


def confusion_matrix(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts for every (true, predicted) pair over the union of classes, zero
    cells kept. Output (long): label, prediction, n."""
    cm = confusion_counts(p, label, prediction)
    cm = cm.select(F.col("label").cast("string").alias("label"), F.col("prediction").cast("string").alias("prediction"), "n")
    # class list: bounded by the number of classes
    levels = sorted({r[0] for r in cm.select("label").union(cm.select("prediction")).distinct().collect()
                     if r[0] is not None})
    w = cm.groupBy("label").pivot("prediction", levels).agg(F.sum("n"))
    present = {r[0] for r in w.select("label").collect()}
    missing = [lv for lv in levels if lv not in present]
    if missing:
        extra = p.sparkSession.createDataFrame([(lv, *([0] * len(levels))) for lv in missing],
                                               T.StructType([T.StructField("label", T.StringType())] +
                                                            [T.StructField(lv, T.LongType()) for lv in levels]))
        w = w.unionByName(extra)
    items = [F.struct(F.lit(lv).alias("prediction"), F.coalesce(F.col(f"`{lv}`"), F.lit(0)).cast("long").alias("n"))
             for lv in levels]
    return w.where(F.col("label").isNotNull()).select("label", F.inline(F.array(*items)))


# --------------------------------------------------------------------------- E3
def regression_metrics(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mse, rmse, r2 (1 - SS_res / SS_tot) in one aggregate. Output: one row."""
    e = q(label).cast("double") - q(prediction).cast("double")
    a = p.agg(F.avg(e * e).alias("mse"), F.var_pop(q(label).cast("double")).alias("vy"))
    return a.select("mse", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("vy") > 0, F.lit(1.0) - F.col("mse") / F.col("vy")).otherwise(F.lit(float("nan"))).alias("r2"))


# --------------------------------------------------------------------------- E5 / E6
def scored(p: DataFrame, label: str, score: str) -> DataFrame:
    """Rows that have a score and a label: neither NULL nor NaN (Spark ranks NaN above every number, and a missing
    label is no negative)."""
    known = [q(c).isNotNull() & ~F.isnan(q(c)) if is_float_type(p.schema[c].dataType) else q(c).isNotNull() for c in (label, score)]
    return p.where(known[0] & known[1])


def _score_groups(p: DataFrame, label: str, score: str, pos_label) -> DataFrame:
    pos = q(label) == F.lit(pos_label)
    return scored(p, label, score).groupBy(q(score).cast("double").alias("threshold")).agg(
        F.sum(F.when(pos, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(pos, 0).otherwise(1)).cast("long").alias("fp"))


def _cumulated(p: DataFrame, label: str, score: str, pos_label) -> DataFrame:
    g = _score_groups(p, label, score, pos_label)
    # running sums by decreasing score (one row per distinct score)
    return running_sum(g, "threshold", ["tp", "fp"], descending=True)


def roc_curve(p: DataFrame, label: str = "label", score: str = "probability", pos_label=1.0,
              drop_intermediate: bool = True) -> DataFrame:
    """E5: ROC points (threshold, fpr, tpr) by decreasing threshold, starting at
    (0, 0) with an infinite threshold; collinear points dropped like scikit-learn's
    ``drop_intermediate``. Rows without a score or a label (NULL or NaN) are left out. Output also carries ``idx`` (0 = start point)."""
    g = _score_groups(p, label, score, pos_label).withColumn("one", F.lit(1).cast("long"))
    tot = g.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N")).first()
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    # counts, position and the next point's counts in one running sum
    c = running_sum(g, "threshold", ["tp", "fp", "one"], descending=True, lead_cols=["tp", "fp"]).withColumnRenamed("one_cum", "idx")
    if drop_intermediate:
        last = F.col("tp_next").isNull()
        c = c.where((F.col("idx") == 1) | last | (F.col("tp_next") != F.col("tp")) | (F.col("fp_next") != F.col("fp")))
    fpr = F.col("fp_cum") / F.lit(N) if N > 0 else F.lit(float("nan"))
    tpr = F.col("tp_cum") / F.lit(P) if P > 0 else F.lit(float("nan"))
    pts = c.select(F.col("idx").cast("long"), "threshold", fpr.alias("fpr"), tpr.alias("tpr"))
    start = p.sparkSession.createDataFrame([(0, float("inf"), 0.0, 0.0)], "idx long, threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def roc_auc(p: DataFrame, label: str = "label", score: str = "probability", pos_label=1.0) -> DataFrame:
    """E5: area under the ROC curve by the trapezoid rule over all distinct
    thresholds (ties handled exactly). Output: one row (auc), NaN without both classes."""
    c = _cumulated(p, label, score, pos_label)
    # count x count products pass the long range near 3e9 rows: exact decimals
    twice_area = F.col("fp").cast("decimal(38,0)") * (F.col("tp_cum") + F.col("tp_before")).cast("decimal(38,0)")
    a = c.agg(F.sum(twice_area).alias("s"),
              F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    area = F.try_divide(F.col("s").cast("double"), F.lit(2.0) * F.col("P") * F.col("N"))
    return a.select(F.coalesce(area, F.lit(float("nan"))).alias("auc"))


def pr_curve(p: DataFrame, label: str = "label", score: str = "probability", pos_label=1.0) -> DataFrame:
    """precision/recall at every distinct threshold plus the end point
    (precision 1, recall 0, threshold NULL)."""
    c = _cumulated(p, label, score, pos_label)
    P = c.agg(F.sum("tp")).first()[0] or 0
    prec = F.when(F.col("tp_cum") + F.col("fp_cum") > 0, F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum"))).otherwise(0.0)
    rec = F.col("tp_cum") / F.lit(float(P)) if P > 0 else F.lit(1.0)
    pts = c.select("threshold", prec.alias("precision"), rec.alias("recall"))
    end = p.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


# --------------------------------------------------------------------------- E7 / E8
def quantile_edges(p: DataFrame, col: str, n: int = 10) -> list[float]:
    """Linear-interpolated quantile edges at 0, 1/n, ..., 1 with duplicates dropped
    (pandas ``qcut(..., duplicates='drop')``), exact."""
    from ..functions.ranking import exact_quantiles
    probs = [i / n for i in range(n + 1)]
    rows = exact_quantiles(p.select(q(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")), "x", probs).collect()
    return sorted({r["q"] for r in rows})


def _bin_expr(col: str, edges: Sequence[float]):
    interior = list(edges[1:-1])
    x = q(col).cast("double")
    b = F.lit(0)
    for e in interior:
        b = b + F.when(x > F.lit(e), 1).otherwise(0)
    return b


def decile_table(p: DataFrame, task: str = "classification", label: str = "label", prediction: str = "prediction",
                 probability: str = "probability", pos_label=1.0, decimals: int = 4) -> DataFrame:
    """Rows cut into deciles of the score (classification: probability;
    regression: prediction), right-closed bins, duplicate edges dropped.
    Classification: n, n_positive, positive_rate, mean/min/max probability.
    Regression: mean and sample std of truth, prediction and absolute error."""
    score = probability if task == "classification" else prediction
    edges = quantile_edges(p, score)
    x = q(score).cast("double")
    d = p.where(x.isNotNull() & ~F.isnan(x)).withColumn("decile", _bin_expr(score, edges))
    r = lambda e: F.round(e, decimals)
    if task == "classification":
        y = (q(label) == F.lit(pos_label)).cast("int")
        return d.groupBy("decile").agg(
            F.count(F.lit(1)).cast("long").alias("n"), F.sum(y).cast("long").alias("n_positive"),
            r(F.avg(y)).alias("positive_rate"), r(F.avg(q(score))).alias("mean_probability"),
            r(F.min(q(score))).alias("min_probability"), r(F.max(q(score))).alias("max_probability"))
    err = F.abs(q(label).cast("double") - q(prediction).cast("double"))
    return d.groupBy("decile").agg(
        r(F.avg(q(label))).alias("true_mean"), r(F.stddev_samp(q(label))).alias("true_std"),
        r(F.avg(q(prediction))).alias("pred_mean"), r(F.stddev_samp(q(prediction))).alias("pred_std"),
        r(F.avg(err)).alias("error_mean"), r(F.stddev_samp(err)).alias("error_std"))


# --------------------------------------------------------------------------- E9
def calibration_curve(p: DataFrame, label: str = "label", probability: str = "probability", bins: int = 10,
                      pos_label=1.0) -> DataFrame:
    """Uniform bins on [0, 1] (right-closed), empty bins dropped: mean predicted
    probability vs observed positive rate, over the rows with a score and a label."""
    # edges as numpy.linspace(0, 1, bins + 1) computes them (i * step)
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    d = scored(p, label, probability).withColumn("bin", _bin_expr(probability, edges))
    y = (q(label) == F.lit(pos_label)).cast("double")
    return d.groupBy("bin").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                F.avg(q(probability)).alias("mean_predicted"), F.avg(y).alias("fraction_positive"))


# --------------------------------------------------------------------------- E10-E12
def residuals(p: DataFrame, label: str = "label", prediction: str = "prediction", key: str | None = "key") -> DataFrame:
    """residual = truth - prediction per row."""
    cols = ([q(key)] if key and key in p.columns else []) + [q(label), q(prediction)]
    return p.select(*cols, (q(label).cast("double") - q(prediction).cast("double")).alias("residual"))


def residual_histogram(p: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30) -> DataFrame:
    """30-bin histogram of the residuals."""
    from .profile import histogram
    return histogram(residuals(p, label, prediction, None), "residual", bins)


def prediction_range(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """End points of the identity line (min and max of the truth) and of the
    predictions."""
    return p.agg(F.min(q(label).cast("double")).alias("y_min"), F.max(q(label).cast("double")).alias("y_max"),
                 F.min(q(prediction).cast("double")).alias("pred_min"),
                 F.max(q(prediction).cast("double")).alias("pred_max"))


BLOCK = 1 << 16  # positions of one residual that are spread together


def qq_table(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Normal QQ table of the residuals: position i, ordered residual,
    theoretical quantile from Filliben's order-statistic medians."""
    r = residuals(p, label, prediction, None).select("residual").where(F.col("residual").isNotNull())
    # equal residuals are counted and ranked as one row, then spread over their positions in blocks
    counts = r.groupBy("residual").agg(F.count(F.lit(1)).alias("cnt"))
    n = counts.agg(F.sum("cnt")).first()[0] or 0
    if not n:
        return p.sparkSession.createDataFrame([], "i long, theoretical double, ordered double")
    blocks = ranks_from_counts(counts, "residual").select("residual", "rank_lo", "cnt", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("cnt") - 1) / BLOCK))).alias("block")).repartition("residual", "block")
    first = F.col("rank_lo") + F.col("block") * BLOCK
    ranked = blocks.select("residual", F.explode(F.sequence(first, F.least(first + BLOCK - 1, F.col("rank_lo") + F.col("cnt") - 1))).alias("i"))
    i = F.col("i").cast("double")
    med = (F.when(F.col("i") == 1, F.lit(1.0 - 0.5 ** (1.0 / n))).when(F.col("i") == n, F.lit(0.5 ** (1.0 / n)))
           .otherwise((i - 0.3175) / F.lit(n + 0.365)))
    t = add_inv_normal(ranked.withColumn("__m", med), "__m", "theoretical")
    return t.select(F.col("i").cast("long").alias("i"), "theoretical", F.col("residual").alias("ordered"))


def qq_fit(p: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Least-squares line through the QQ points (slope, intercept, r)."""
    t = qq_table(p, label, prediction)
    return t.agg(F.regr_slope("ordered", "theoretical").alias("slope"),
                 F.regr_intercept("ordered", "theoretical").alias("intercept"),
                 F.corr("theoretical", "ordered").alias("r"))
