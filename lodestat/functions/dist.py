"""Tail probabilities and quantiles of the usual distributions (scalar, plus Arrow UDFs for result rows)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_pdf(z: float) -> float:
    return math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _bisect(f, target: float, lo: float, hi: float) -> float:
    """x with f(x) = target for an increasing f."""
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if f(mid) < target:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-13 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def norm_ppf(p: float) -> float:
    if p <= 0:
        return -math.inf
    if p >= 1:
        return math.inf
    return _bisect(norm_cdf, p, -40.0, 40.0) if p < 0.5 else -_bisect(norm_cdf, 1 - p, -40.0, 40.0)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        for _ in range(100000):
            k += 1
            term *= x / k
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - lead * total)
    b = x + 1 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    return _bisect(lambda v: 1 - t_sf(v, df), p, 0.0, 1e4)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


_GH = np.polynomial.legendre.leggauss(96)


def _range_cdf_inf(w: float, k: int) -> float:
    """P(range of k standard normals < w)."""
    if w <= 0:
        return 0.0
    nodes, weights = _GH
    z = 8.0 * nodes
    cdf = np.array([norm_cdf(v) for v in z])
    cdf_w = np.array([norm_cdf(v - w) for v in z])
    pdf = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return float(min(1.0, max(0.0, 8.0 * np.sum(weights * k * pdf * (cdf - cdf_w) ** (k - 1)))))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(studentized range of k means > q), by quadrature over the chi scale."""
    if q <= 0:
        return 1.0
    if df > 20000:
        return 1.0 - _range_cdf_inf(q, k)
    spread = 8.0 / math.sqrt(2 * df)
    lo, hi = max(1e-4, 1 - spread), 1 + spread
    nodes, weights = _GH
    s = 0.5 * (hi - lo) * nodes + 0.5 * (hi + lo)
    logpdf = (math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2)
              + (df - 1) * np.log(s) - df * s * s / 2)
    dens = np.exp(logpdf) * weights * 0.5 * (hi - lo)
    dens = dens / dens.sum()
    return float(min(1.0, max(0.0, 1.0 - sum(d * _range_cdf_inf(q * v, k) for d, v in zip(dens, s)))))


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    return _bisect(lambda v: 1 - studentized_range_sf(v, k, df), p, 0.0, 200.0)


def nct_cdf(t: float, df: float, delta: float) -> float:
    """Noncentral t by quadrature over the chi scale."""
    spread = 8.0 / math.sqrt(2 * df)
    lo, hi = max(1e-6, 1 - spread), 1 + spread
    nodes, weights = _GH
    s = 0.5 * (hi - lo) * nodes + 0.5 * (hi + lo)
    logpdf = (math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2)
              + (df - 1) * np.log(s) - df * s * s / 2)
    dens = np.exp(logpdf) * weights
    dens = dens / dens.sum()
    return float(sum(d * norm_cdf(t * v - delta) for d, v in zip(dens, s)))


def fisher_exact_2x2(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p: total probability of tables no likelier than the observed one."""
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    const = (math.lgamma(r1 + 1) + math.lgamma(r2 + 1) + math.lgamma(c1 + 1) + math.lgamma(n - c1 + 1)
             - math.lgamma(n + 1))

    def logp(x: int) -> float:
        return const - (math.lgamma(x + 1) + math.lgamma(r1 - x + 1) + math.lgamma(c1 - x + 1)
                        + math.lgamma(r2 - c1 + x + 1))

    seen = logp(a)
    lo, hi = max(0, c1 - r2), min(r1, c1)
    # tails decay geometrically away from the mode, so stop once terms vanish
    mode = min(hi, max(lo, int((r1 + 1) * (c1 + 1) / (n + 2))))
    total = 0.0
    for start, step in ((mode, 1), (mode - 1, -1)):
        x = start
        while lo <= x <= hi:
            lp = logp(x)
            if lp <= seen + 1e-7:
                total += math.exp(lp)
                if lp < seen - 60 or lp < -700:
                    break
            x += step
    return min(1.0, total)


def _udf(fn):
    def apply(*args: pd.Series) -> pd.Series:
        out = []
        for values in zip(*args):
            if any(v is None or v != v for v in values):
                out.append(None)
            else:
                out.append(float(fn(*[float(v) for v in values])))
        return pd.Series(out, dtype="float64")

    return apply


def _columns(arity: int, fn):
    body = _udf(fn)
    if arity == 1:
        def one(a: pd.Series) -> pd.Series:
            return body(a)
        return F.pandas_udf(one, "double")
    if arity == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return body(a, b)
        return F.pandas_udf(two, "double")

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return body(a, b, c)
    return F.pandas_udf(three, "double")


def p_t(t: Column, df: Column) -> Column:
    """Two-sided Student p-value for result rows."""
    return _columns(2, t_two_sided)(t.cast("double"), df.cast("double"))


def p_t_upper(t: Column, df: Column) -> Column:
    return _columns(2, t_sf)(t.cast("double"), df.cast("double"))


def t_critical(level: float, df: Column) -> Column:
    return _columns(1, lambda d: t_ppf(0.5 + level / 2, d))(df.cast("double"))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _columns(3, f_sf)(f.cast("double"), d1.cast("double"), d2.cast("double"))


def p_chi2(x: Column, df: Column) -> Column:
    return _columns(2, chi2_sf)(x.cast("double"), df.cast("double"))


def p_norm(z: Column) -> Column:
    return _columns(1, lambda v: 2 * norm_sf(abs(v)))(z.cast("double"))


def p_studentized_range(q: Column, k: Column, df: Column) -> Column:
    return _columns(3, lambda a, b, c: studentized_range_sf(a, int(b), c))(
        q.cast("double"), k.cast("double"), df.cast("double"))


def crit_studentized_range(level: float, k: Column, df: Column) -> Column:
    return _columns(2, lambda b, c: studentized_range_ppf(level, int(b), c))(k.cast("double"), df.cast("double"))
