"""Feature preparation (F1-F6) as Spark ML stages.

Every fitted statistic is an aggregate computed on the executors; the fitted state
of the numeric and mode stages is a handful of numbers per column (kept as Params, so
``DefaultParamsWritable`` persists them). The target encoder's per-category table can
be large; it stays a DataFrame, is joined (broadcast only after a size check), and
is written as Parquet next to the stage metadata.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import is_finite, is_inf, is_numeric_type, nan_to_null, q
from ..functions.ranking import exact_quantiles
from .tables import SideTables

CLASSIFICATION = "classification"
REGRESSION = "regression"


# --------------------------------------------------------------------------- F1
class _NumericParams(HasInputCols, HasOutputCols):
    scale = Param(Params._dummy(), "scale", "standardise with the population std", TypeConverters.toBoolean)


class NumericStage(Estimator, _NumericParams, DefaultParamsReadable, DefaultParamsWritable):
    """exact median imputation, then optional (x - mean) / population std."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, scale=True):
        super().__init__()
        self._setDefault(scale=True)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getInputCols()
        items = [F.struct(F.lit(c).alias("column_name"), nan_to_null(q(c).cast("double"), T.DoubleType()).alias("x"))
                 for c in cols]
        lv = df.select(F.inline(F.array(*items))).where(F.col("x").isNotNull() & ~is_inf(F.col("x")))
        med = {r["column_name"]: r["q"] for r in
               exact_quantiles(lv, "x", [0.5], ["column_name"], split_groups=["column_name"]).collect()}
        medians = [float(med.get(c, 0.0) if med.get(c) is not None else 0.0) for c in cols]
        # mean / std of the imputed column (infinities are imputed as well), one aggregate for all columns
        filled = [F.when(is_finite(q(c).cast("double")), q(c).cast("double")).otherwise(F.lit(m)) for c, m in zip(cols, medians)]
        a = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)],
                   *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]).first()
        means = [float(a[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(a[f"s{i}"] or 0.0) for i in range(len(cols))]
        m = NumericStageModel(inputCols=cols, outputCols=self.getOutputCols(), scale=self.getOrDefault("scale"),
                              medians=medians, means=means, stds=stds)
        return m


class NumericStageModel(Model, _NumericParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "fitted medians", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population std", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, scale=True, medians=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, outs = self.getInputCols(), self.getOutputCols()
        med, mean, std = self.getOrDefault("medians"), self.getOrDefault("means"), self.getOrDefault("stds")
        scale = self.getOrDefault("scale")
        new = {}
        for c, o, m, mu, s in zip(cols, outs, med, mean, std):
            x = nan_to_null(q(c).cast("double"), T.DoubleType())
            x = F.when(is_inf(x), F.lit(None)).otherwise(x)
            x = F.coalesce(x, F.lit(m))
            if scale:
                x = (x - F.lit(mu)) / F.lit(s if s > 0 else 1.0)
            new[o] = x
        return df.withColumns(new)


# --------------------------------------------------------------------------- F2 (mode imputation)
class ModeImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Most frequent value (smallest on ties) per column; values cast to string."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        from ..operators.correct import column_modes
        cols = self.getInputCols()
        modes = column_modes(df.select(*[q(c).cast("string").alias(c) for c in cols]), cols)
        return ModeImputerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                modes=[modes[c] if modes[c] is not None else "" for c in cols])


class ModeImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    modes = Param(Params._dummy(), "modes", "fitted modes", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, modes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({o: F.coalesce(q(c).cast("string"), F.lit(m))
                               for c, o, m in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("modes"))})


# --------------------------------------------------------------------------- F3
class _TEParams(HasInputCols, HasOutputCols, HasLabelCol):
    k = Param(Params._dummy(), "k", "smoothing: count at which the category mean gets weight 1/2", TypeConverters.toFloat)
    f = Param(Params._dummy(), "f", "smoothing: slope of the sigmoid weight", TypeConverters.toFloat)


class TargetEncoderStage(Estimator, _TEParams, DefaultParamsReadable, DefaultParamsWritable):
    """Micci-Barreca (2001) smoothed target mean per category:
    lambda = 1 / (1 + exp(-(n - k) / f)), enc = lambda * mean_cat + (1 - lambda) * mean_all.
    Unknown categories get the overall mean. Numeric label expected (0/1 for binary)."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, labelCol="label", k=20.0, f=10.0):
        super().__init__()
        self._setDefault(k=20.0, f=10.0, labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols, y = self.getInputCols(), self.getLabelCol()
        k, f = self.getOrDefault("k"), self.getOrDefault("f")
        prior = df.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
        items = [F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("category")) for c in cols]
        lv = df.select(F.col(y).cast("double").alias("__y"), F.inline(F.array(*items)))
        g = lv.groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean"))
        lam = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n") - F.lit(k)) / F.lit(f)))
        table = g.select("column_name", "category", (lam * F.col("mean") + (F.lit(1.0) - lam) * F.lit(prior)).alias("enc"))
        model = TargetEncoderStageModel(inputCols=cols, outputCols=self.getOutputCols(), labelCol=y, k=k, f=f)
        model._set(prior=float(prior))
        model.table = table
        return model


class TargetEncoderStageModel(Model, _TEParams, SideTables):
    prior = Param(Params._dummy(), "prior", "overall target mean", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, labelCol="label", k=20.0, f=10.0):
        super().__init__()
        self._set(**self._input_kwargs)
        self.table: DataFrame | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        prior = self.getOrDefault("prior")
        for c, o in zip(self.getInputCols(), self.getOutputCols()):
            t = self.table.where(F.col("column_name") == c).select(F.col("category").alias(f"__cat_{o}"),
                                                                   F.col("enc").alias(f"__enc_{o}"))
            out = out.join(t, q(c).cast("string") == F.col(f"__cat_{o}"), "left")
            out = out.withColumn(o, F.coalesce(F.col(f"__enc_{o}"), F.lit(prior))).drop(f"__cat_{o}", f"__enc_{o}")
        return out

    # ---- persistence: the encodings as a table
    def side_tables(self, spark):
        names = ("k", "f", "prior")
        return {"inputCols": self.getInputCols(), "outputCols": self.getOutputCols(), "labelCol": self.getLabelCol(),
                **{n: self.getOrDefault(n) for n in names}}, {"table": self.table}

    @classmethod
    def from_tables(cls, meta, tables):
        m = cls(inputCols=meta["inputCols"], outputCols=meta["outputCols"], labelCol=meta["labelCol"], k=meta["k"], f=meta["f"])
        m._set(prior=meta["prior"])
        m.table = tables["table"]
        return m


# --------------------------------------------------------------------------- F4
ROLE = "vigil_role"  # column metadata: a row key is no feature


def mark_key(df: DataFrame, key: str) -> DataFrame:
    return df.withMetadata(key, {**(df.schema[key].metadata or {}), ROLE: "key"})


def route_columns(df: DataFrame, target: str, max_onehot: int = 100) -> dict:
    """F4 routing: numeric -> F1; string with <= 100 distinct -> F2; > 100 -> F3;
    everything else (boolean, dates, nested) is dropped and reported; a column marked as
    key is not routed at all."""
    feats = [f for f in df.schema.fields if f.name != target and (f.metadata or {}).get(ROLE) != "key"]
    num = [f.name for f in feats if is_numeric_type(f.dataType)]
    strings = [f.name for f in feats if isinstance(f.dataType, T.StringType)]
    dropped = [f.name for f in feats if f.name not in num and f.name not in strings]
    low, high = [], []
    if strings:
        from ..operators.profile import distinct_at_most
        nd = distinct_at_most(df, max_onehot, strings)
        low = [c for c in strings if nd[c] <= max_onehot]
        high = [c for c in strings if nd[c] > max_onehot]
    return {"numeric": num, "low_card": low, "high_card": high, "dropped": dropped}


def build_preprocessor(df: DataFrame, target: str, scale: bool = True, target_encoding: bool = True,
                       label_col: str = "label", features_col: str = "features") -> tuple[Pipeline, dict]:
    """Pipeline of F1/F2/F3 stages + VectorAssembler; the routing is returned too
    (``dropped`` lists columns left out, including high-cardinality ones when target
    encoding is off). Output feature names keep the input names (unprefixed)."""
    r = route_columns(df, target)
    stages = []
    assemble = []
    if r["numeric"]:
        outs = [f"__num_{c}" for c in r["numeric"]]
        stages.append(NumericStage(inputCols=r["numeric"], outputCols=outs, scale=scale))
        assemble += outs
    if r["low_card"]:
        imp = [f"__mode_{c}" for c in r["low_card"]]
        idx = [f"__idx_{c}" for c in r["low_card"]]
        ohe = [f"__ohe_{c}" for c in r["low_card"]]
        stages.append(ModeImputer(inputCols=r["low_card"], outputCols=imp))
        stages.append(StringIndexer(inputCols=imp, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep"))
        assemble += ohe
    if r["high_card"]:
        if target_encoding:
            imp = [f"__mode_{c}" for c in r["high_card"]]
            te = [f"__te_{c}" for c in r["high_card"]]
            stages.append(ModeImputer(inputCols=r["high_card"], outputCols=imp))
            stages.append(TargetEncoderStage(inputCols=imp, outputCols=te, labelCol=label_col))
            assemble += te
        else:
            r["dropped"] = r["dropped"] + r["high_card"]
    stages.append(VectorAssembler(inputCols=assemble, outputCol=features_col, handleInvalid="keep"))
    return Pipeline(stages=stages), r


def feature_names(model_df: DataFrame, features_col: str = "features") -> list[str]:
    """Names of the assembled vector slots from the ML attribute metadata, without
    the internal prefixes (``__num_x`` -> ``x``, ``__ohe_c_v`` -> ``c_v``)."""
    meta = model_df.schema[features_col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    attrs.sort(key=lambda a: a["idx"])
    out = []
    for a in attrs:
        n = a.get("name", f"f{a['idx']}")
        for pre in ("__num_", "__ohe___idx_", "__ohe_", "__te___mode_", "__te_"):
            if n.startswith(pre):
                n = n[len(pre):]
                break
        n = n.replace("__idx___mode_", "").replace("__mode_", "")
        out.append(n)
    return out


# --------------------------------------------------------------------------- F5 / F6
def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, split_col: str = "split") -> DataFrame:
    """exact-size seeded split: rows ranked by xxhash64(key, seed) (distributed
    row number); the first ceil(n * test_size) are ``test``. Rows that share a key are told
    apart by a hash of the whole row, so the split is stable under any repartitioning,
    unlike ``randomSplit``."""
    if not 0.05 <= test_size <= 0.5:
        raise ValueError("test_size must be within [0.05, 0.5]")
    from ..functions.ranking import row_number
    n = df.count()
    n_test = int(math.ceil(n * test_size))
    # high bits: the key; low bits: the whole row
    row = F.xxhash64(*[q(c) for c in df.columns]).bitwiseAND(F.lit((1 << 24) - 1))
    h = df.withColumn("__h", F.shiftleft(F.shiftright(F.xxhash64(q(key), F.lit(seed)), 24), 24).bitwiseOR(row))
    r = row_number(h, "__h", name="__rn")
    return r.withColumn(split_col, F.when(F.col("__rn") <= n_test, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("__h", "__rn")


def prepare(df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = 42, missing_target: str = "drop",
            task: str | None = None) -> tuple[DataFrame, str]:
    """target cleaning (V6) + task detection (V7) + split (F5). The label column is
    ``label`` (double; string classes indexed alphabetically). Returns (df, task)."""
    from ..operators.validate import clean_target, detect_task
    d = clean_target(df, target, missing_target)
    task = task or detect_task(d, target).first()["task"]
    if task == CLASSIFICATION and not is_numeric_type(d.schema[target].dataType):
        levels = [r[0] for r in d.select(q(target).cast("string")).distinct().orderBy(1).collect()]
        m = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(float(i)))])
        d = d.withColumn("label", m[q(target).cast("string")])
    else:
        d = d.withColumn("label", q(target).cast("double"))
    d = d.drop(target) if target != "label" else d
    return mark_key(split(d, key, test_size, seed), key), task
