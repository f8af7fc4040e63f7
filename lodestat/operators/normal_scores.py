"""Normality by order statistics: the W of Shapiro and Wilk with Royston's weights, for tables of any size.

A value's weight depends on its rank alone: its expected normal order score, with corrections for the two values at either end.
So one ranking and one aggregate give W, without bringing the sorted values together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.dist import norm_sf
from lodestat.functions.expr import as_col, local_rows
from lodestat.operators.ordering import with_position

# fixed values: the rational approximation of the normal quantile (algorithm AS 241), numerators and denominators by power
CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
          (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
MIDDLE = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
          (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
TAIL = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))
# fixed values: polynomials in 1 / sqrt(n) of the two outer weights, and in n or log n of the mean and log deviation of the transformed W
LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
BEFORE_LAST = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN, SMALL_LOG_DEVIATION, SMALL_SHIFT = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
LARGE_MEAN, LARGE_LOG_DEVIATION = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def polynomial(c: Sequence[float], x):
    """By Horner's rule, for numbers and columns."""
    out = c[-1]
    for v in c[-2::-1]:
        out = out * x + v
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, to about 16 digits."""
    q = p - 0.5
    r = 0.180625 - q * q
    far = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(far <= 5, polynomial(MIDDLE[0], far - 1.6) / polynomial(MIDDLE[1], far - 1.6)).otherwise(polynomial(TAIL[0], far - 5) / polynomial(TAIL[1], far - 5))
    return F.when(F.abs(q) <= 0.425, q * polynomial(CENTRE[0], r) / polynomial(CENTRE[1], r)).otherwise(F.signum(q) * outer)


def score(i: Column, n: int) -> Column:
    """Expected normal score of the i-th smallest of n values, i from 1."""
    return normal_quantile((i - 0.375) / (n + 0.25))


def w_p(w: float, n: int) -> float:
    """p-value of W; the approximation was made for up to 5,000 values and is carried on beyond."""
    if w >= 1:
        return 1.0
    y = math.log(1 - w)
    if n <= 11:
        y = -math.log(max(polynomial(SMALL_SHIFT, n) - y, 1e-300))
        mean, deviation = polynomial(SMALL_MEAN, n), math.exp(polynomial(SMALL_LOG_DEVIATION, n))
    else:
        mean, deviation = polynomial(LARGE_MEAN, math.log(n)), math.exp(polynomial(LARGE_LOG_DEVIATION, math.log(n)))
    return norm_sf((y - mean) / deviation)


def shapiro_wilk(df: DataFrame, cols: Sequence[str], **kw) -> DataFrame:
    """`column, n, w, p` of each numeric column; null under six values or without variation. Nulls and NaN are left out, ties count by rank."""
    rows = []
    for c in cols:
        v = as_col(c).cast("double")
        data = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
        n, mean = data.agg(F.count("v"), F.avg("v")).first()
        w = p = None
        if n >= 6:
            placed = with_position(data.select((F.col("v") - F.lit(mean)).alias("v")), ["v"], name="i", **kw)
            m = score(F.col("i") + 1, n)
            ends = [F.max(F.when(F.col("i") == i, F.col("v"))) for i in (0, 1, n - 2, n - 1)]
            outer = [F.max(F.when(F.col("i") == i, m)) for i in (n - 2, n - 1)]
            mm, mx, ss, low, low2, high2, high, m2, m1 = placed.agg(F.sum(m * m), F.sum(m * F.col("v")), F.sum(F.col("v") * F.col("v")), *ends, *outer).first()
            if ss > 0 and high > low:
                u = 1 / math.sqrt(n)
                a1, a2 = m1 / math.sqrt(mm) + polynomial(LAST, u), m2 / math.sqrt(mm) + polynomial(BEFORE_LAST, u)
                phi = (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
                inner = (mx - m1 * (high - low) - m2 * (high2 - low2)) / math.sqrt(phi)
                w = min((a1 * (high - low) + a2 * (high2 - low2) + inner) ** 2 / ss, 1.0)
                p = w_p(w, n)
        rows.append((c, n, w, p))
    return local_rows(df.sparkSession, rows, "column string, n long, w double, p double")
