"""G2 and friends: normal quantile/CDF as Column expressions, Student-t tail as a
small vectorised helper.

Fixed values: the coefficients below are the published constants of
Wichura (1988), Algorithm AS 241 (PPND16), and of the Chebyshev erfc fit in
Press et al., Numerical Recipes (2nd ed., section 6.2, ``erfcc``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# AS 241 coefficients (fixed values)
_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
      4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
      1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
      2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]

# Numerical Recipes erfcc coefficients (fixed values)
_ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398,
         1.48851587, -0.82215223, 0.17087277]


def _poly(coefs, x: Column) -> Column:
    acc = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def inv_normal(p: Column) -> Column:
    """Standard normal quantile of ``p`` (0 < p < 1), AS 241, ~1e-16 relative error."""
    q = p - F.lit(0.5)
    r1 = F.lit(0.180625) - q * q
    central = q * _poly(_A, r1) / _poly(_B, r1)
    r = F.when(q < 0, p).otherwise(F.lit(1.0) - p)
    r = F.sqrt(-F.log(r))
    near = _poly(_C, r - F.lit(1.6)) / _poly(_D, r - F.lit(1.6))
    far = _poly(_E, r - F.lit(5.0)) / _poly(_F, r - F.lit(5.0))
    tail = F.when(r <= F.lit(5.0), near).otherwise(far)
    tail = F.when(q < 0, -tail).otherwise(tail)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= F.lit(0.425), central)
            .otherwise(tail))


def erfc(x: Column) -> Column:
    """Complementary error function, fractional error < 1.2e-7 everywhere."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    ans = t * F.exp(-z * z + _poly(_ERFC, t))
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def norm_cdf(x: Column) -> Column:
    return F.lit(0.5) * erfc(-x / F.lit(math.sqrt(2.0)))


def norm_sf(x: Column) -> Column:
    return F.lit(0.5) * erfc(x / F.lit(math.sqrt(2.0)))


# ---- Student-t two-sided p-value: regularised incomplete beta by Lentz's continued
# fraction (Numerical Recipes ``betacf``), vectorised with numpy, used on one-row
# aggregate results only.

def _betacf(a, b, x, iters=300, eps=3e-16):
    fpmin = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < fpmin, fpmin, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < fpmin, fpmin, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < fpmin, fpmin, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < fpmin, fpmin, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < fpmin, fpmin, c)
        d = 1.0 / d
        de = d * c
        h = h * de
        if np.all(np.abs(de - 1.0) < eps):
            break
    return h


def betainc_reg(a, b, x):
    """Regularised incomplete beta I_x(a, b), numpy arrays."""
    a = np.asarray(a, dtype=float)
    b = np.asarray(b, dtype=float)
    x = np.clip(np.asarray(x, dtype=float), 0.0, 1.0)
    from math import lgamma
    lg = np.vectorize(lgamma)
    with np.errstate(divide="ignore", invalid="ignore"):
        lbt = lg(a + b) - lg(a) - lg(b) + a * np.log(np.where(x > 0, x, 1)) + b * np.log(np.where(x < 1, 1 - x, 1))
        bt = np.where((x == 0) | (x == 1), 0.0, np.exp(lbt))
        swap = x >= (a + 1.0) / (a + b + 2.0)
        direct = bt * _betacf(a, b, np.where(swap, 0.5, x)) / a
        flipped = 1.0 - bt * _betacf(b, a, np.where(swap, 1 - x, 0.5)) / b
        res = np.where(swap, flipped, direct)
        res = np.where(x == 0, 0.0, np.where(x == 1, 1.0, res))
    return res


def t_two_sided_p_np(t, df):
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = df / (df + t * t)
        p = betainc_reg(df / 2.0, np.full_like(x, 0.5), x)
    return np.where(np.isfinite(t) & (df > 0), p, np.where(np.isinf(t) & (df > 0), 0.0, np.nan))


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student-t p-value, Arrow-batched; applied to aggregate rows."""
    return pd.Series(t_two_sided_p_np(t.to_numpy(dtype=float, na_value=np.nan),
                                      dof.to_numpy(dtype=float, na_value=np.nan)))


# ---- staged forms: intermediate values become columns of their own projection, so
# the optimizer keeps them (it does not inline an expensive expression that is
# referenced several times) and the generated code stays small.

def add_inv_normal(df, p: str, out: str):
    """``df`` plus column ``out`` = standard normal quantile of column ``p``."""
    d = df.withColumn("__in_q", F.col(p) - F.lit(0.5))
    d = d.withColumn("__in_r1", F.lit(0.180625) - F.col("__in_q") * F.col("__in_q"))
    d = d.withColumn("__in_r", F.sqrt(-F.log(F.when(F.col("__in_q") < 0, F.col(p)).otherwise(F.lit(1.0) - F.col(p)))))
    d = d.withColumn("__in_rn", F.col("__in_r") - F.lit(1.6)).withColumn("__in_rf", F.col("__in_r") - F.lit(5.0))
    central = F.col("__in_q") * _poly(_A, F.col("__in_r1")) / _poly(_B, F.col("__in_r1"))
    near = _poly(_C, F.col("__in_rn")) / _poly(_D, F.col("__in_rn"))
    far = _poly(_E, F.col("__in_rf")) / _poly(_F, F.col("__in_rf"))
    tail = F.when(F.col("__in_r") <= F.lit(5.0), near).otherwise(far)
    tail = F.when(F.col("__in_q") < 0, -tail).otherwise(tail)
    res = (F.when((F.col(p) <= 0) | (F.col(p) >= 1), F.lit(None).cast("double"))
           .when(F.abs(F.col("__in_q")) <= F.lit(0.425), central).otherwise(tail))
    return d.withColumn(out, res).drop("__in_q", "__in_r1", "__in_r", "__in_rn", "__in_rf")


def add_norm_sf(df, x: str, out: str):
    """``df`` plus column ``out`` = P(Z > x) for a standard normal Z."""
    d = df.withColumn("__ns_v", F.col(x) / F.lit(math.sqrt(2.0)))
    d = d.withColumn("__ns_z", F.abs(F.col("__ns_v")))
    d = d.withColumn("__ns_t", F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * F.col("__ns_z")))
    d = d.withColumn("__ns_e", F.col("__ns_t") * F.exp(-F.col("__ns_z") * F.col("__ns_z") + _poly(_ERFC, F.col("__ns_t"))))
    erfc_v = F.when(F.col("__ns_v") >= 0, F.col("__ns_e")).otherwise(F.lit(2.0) - F.col("__ns_e"))
    return d.withColumn(out, F.lit(0.5) * erfc_v).drop("__ns_v", "__ns_z", "__ns_t", "__ns_e")
