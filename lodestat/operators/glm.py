"""Generalised linear, count and quantile regression."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.functions.expr import local_rows, as_col
from lodestat.operators.gram import complete, dot, gram, ols, standardised, unstandardise, weighted_sums
from lodestat.operators.quantiles import exact_quantiles
from lodestat.session import saved

OVERDISPERSED = 1.5


def _glm(df: DataFrame, y: str, xs: Sequence[str], family: str, link: str, offset: Column | None = None):
    data = complete(df, [*xs, y]).select(*[as_col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs)],
                                         as_col(y).cast("double").alias("label"), (offset if offset is not None else F.lit(0.0)).alias("offset"))
    data = saved(data, "glm")  # every step of the fit and its summary read it again
    wide = VectorAssembler(inputCols=[f"x{i}" for i in range(len(xs))], outputCol="features").transform(data)
    est = GeneralizedLinearRegression(family=family, link=link, maxIter=50, tol=1e-10, **({"offsetCol": "offset"} if offset is not None else {}))
    return est.fit(wide), wide


def _table(spark, names, coef, se, ratio_name: str) -> DataFrame:
    rows = []
    for n, b, s in zip(names, coef, se):
        z = b / s if s > 0 else 0.0
        rows.append((n, float(b), float(s), float(z), 2 * dist.norm_sf(abs(z)), math.exp(min(b, 700)), float(b - 1.959963984540054 * s), float(b + 1.959963984540054 * s)))
    return local_rows(spark, rows, f"variable string, coefficient double, std_error double, z double, p double, {ratio_name} double, ci_low double, ci_high double")


def _ordered(model, xs):
    """Coefficients and errors with the intercept first (Spark lists it last)."""
    se = list(model.summary.coefficientStandardErrors)
    return ["const", *xs], np.array([model.intercept, *model.coefficients]), np.array([se[-1], *se[:-1]])


def logistic_summary(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Coefficients, z and odds ratios of a 0/1 response."""
    model, _ = _glm(df, y, xs, "binomial", "logit")
    return _table(df.sparkSession, *_ordered(model, xs), "odds_ratio")


def logistic_quality(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    model, _ = _glm(df, y, xs, "binomial", "logit")
    s = model.summary
    return local_rows(df.sparkSession, [(s.deviance, s.nullDeviance, 1 - s.deviance / s.nullDeviance if s.nullDeviance else None, s.aic)],
                                           "deviance double, null_deviance double, pseudo_r2 double, aic double")


# ---------------------------------------------------------------- counts

_COUNT_NAME = re.compile(r"(?:^|[_\s])(nb|nombre|count|n|effectif|quantite|qte|freq)(?:$|[_\s])")


def is_count(df: DataFrame, col: str) -> DataFrame:
    """Does a column look like counts: whole, not negative, 3 to max(50, n/5) values, small values or a telling name?"""
    v = as_col(col).cast("double")
    s = df.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.min((v == F.rint(v)).cast("int")).alias("whole"), F.count_distinct(v).alias("d"))
    named = bool(_COUNT_NAME.search(col.lower()))
    return s.select(F.lit(col).alias("column"), "n", ((F.col("n") >= 20) & (F.col("low") >= 0) & (F.col("whole") == 1) & F.col("d").between(
        3, F.greatest(F.lit(50), F.floor(F.col("n") * 0.2))) & (F.lit(named) | (F.col("low") <= 3))).alias("is_count"))


def poisson(df: DataFrame, y: str, xs: Sequence[str], exposure: str | None = None) -> tuple[DataFrame, dict]:
    """Coefficients with incidence-rate ratios, and the fit's dispersion, AIC and pseudo-R2."""
    data = df.where(as_col(exposure) > 0) if exposure else df
    model, wide = _glm(data, y, xs, "poisson", "log", F.log(as_col(exposure)) if exposure else None)
    fitted = model.transform(wide)
    chi2, n, mean = fitted.agg(F.sum((F.col("label") - F.col("prediction")) ** 2 / F.col("prediction")), F.count(F.lit(1)), F.avg("label")).first()
    s = model.summary
    info = {"dispersion": chi2 / max(1, n - len(xs) - 1), "aic": s.aic, "mean": mean, "n": n,
            "pseudo_r2": 1 - s.deviance / s.nullDeviance if s.nullDeviance else None}
    return _table(df.sparkSession, *_ordered(model, xs), "incidence_rate_ratio"), info


def negative_binomial(df: DataFrame, y: str, xs: Sequence[str], alpha: float, exposure: str | None = None, rounds: int = 50) -> DataFrame:
    """Log-link negative binomial with a given dispersion, by reweighted normal equations."""
    data = complete(df, [*xs, y, *([exposure] if exposure else [])])
    data = saved(data.select(*[as_col(c) for c in dict.fromkeys([*xs, y, *([exposure] if exposure else [])])]), "counts")
    g = gram(data, [*xs, y])
    cols, mean, sd = standardised(g, xs)
    offset = F.log(as_col(exposure)) if exposure else F.lit(0.0)
    target = as_col(y).cast("double")
    beta = np.zeros(len(xs) + 1)
    base = data.agg(F.log(F.avg(target)) - F.log(F.avg(F.exp(offset)))).first()[0]
    beta[0] = base
    inv = np.eye(len(beta))
    for _ in range(rounds):
        mu = F.exp(F.least(dot(beta, cols) + offset, F.lit(700.0)))
        a, b, _ = weighted_sums(data, cols, mu / (1 + alpha * mu), (target - mu) / (1 + alpha * mu))
        inv = np.linalg.pinv(a, hermitian=True)
        step = inv @ b
        beta = beta + step
        if np.max(np.abs(step)) < 1e-9:
            break
    coef, cov = unstandardise(beta, inv, mean, sd)
    return _table(df.sparkSession, ["const", *xs], coef, np.sqrt(np.diag(cov)), "incidence_rate_ratio")


def count_model(df: DataFrame, y: str, xs: Sequence[str], exposure: str | None = None) -> DataFrame:
    """Poisson, or negative binomial when the variance clearly exceeds the mean."""
    table, info = poisson(df, y, xs, exposure)
    if info["dispersion"] <= OVERDISPERSED:
        return table.withColumn("model", F.lit("poisson")).withColumn("dispersion", F.lit(info["dispersion"]))
    alpha = max(1e-6, (info["dispersion"] - 1) / max(info["mean"], 1e-9))
    return negative_binomial(df, y, xs, alpha, exposure).withColumn("model", F.lit("negative_binomial")).withColumn("dispersion", F.lit(info["dispersion"]))


# ---------------------------------------------------------------- quantile regression

QUANTILES = (.1, .25, .5, .75, .9)


def quantile_regression(df: DataFrame, y: str, xs: Sequence[str], taus: Sequence[float] = QUANTILES,
                        bandwidths: Sequence[float] = (.5, .1, .02, .005), steps: int = 3) -> DataFrame:
    """Coefficients per quantile with pseudo-R2 and their distance from least squares.

    Newton steps on a check loss smoothed by a logistic kernel, with a shrinking bandwidth
    (in deviations of y); every step updates all quantiles in one aggregate.
    """
    data = complete(df, [*xs, y])
    g = gram(data, [*xs, y])
    cols, mean, sd = standardised(g, xs)
    k = len(cols)
    sy = math.sqrt(g.cross[-1, -1] / g.n) or 1.0
    target = (as_col(y).cast("double") - float(g.mean[-1])) / sy
    start = ols(g, y, xs)
    base = exact_quantiles(data.select((as_col(y).cast("double") - start.predict()).alias("e")), ["e"], list(taus))["e"]
    slope = start.coef[1:] * sd / sy
    betas = {t: np.concatenate([[q / sy], slope]) for t, q in zip(taus, base)}
    work = data.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], target.alias("y"))
    xcol = [F.col(f"x{i}") for i in range(k)]
    for h in bandwidths:
        for _ in range(steps):
            aggs = []
            scored = work.select(*xcol, *[(1 / (1 + F.exp((F.col("y") - dot(betas[t], xcol)) / h))).alias(f"s{m}") for m, t in enumerate(taus)])
            for m, t in enumerate(taus):
                s = F.col(f"s{m}")
                aggs += [F.sum(s * (1 - s) * xcol[i] * xcol[j]).alias(f"{m}|a{i}_{j}") for i in range(k) for j in range(i, k)]
                aggs += [F.sum(xcol[i] * (F.lit(t) - s)).alias(f"{m}|b{i}") for i in range(k)]
            row = scored.agg(*aggs).first()
            moved = 0.0
            for m, t in enumerate(taus):
                a = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        a[i, j] = a[j, i] = row[f"{m}|a{i}_{j}"] / h
                step = np.linalg.pinv(a, hermitian=True) @ np.array([row[f"{m}|b{i}"] for i in range(k)])
                step *= min(1.0, 0.5 / max(float(np.max(np.abs(step))), 1e-12))
                moved = max(moved, float(np.max(np.abs(step))))
                betas[t] = betas[t] + step
            if moved < h / 1000:
                break

    def loss(e: Column, t: float) -> Column:
        return F.sum(e * (F.lit(t) - (e < 0).cast("double")))

    flat = exact_quantiles(work, ["y"], list(taus))["y"]
    sums = work.agg(*[x for t, q in zip(taus, flat) for x in (
        loss(F.col("y") - dot(betas[t], xcol), t).alias(f"{t}|m"), loss(F.col("y") - F.lit(q), t).alias(f"{t}|0"))]).first()
    rows = []
    for t in taus:
        coef, _ = unstandardise(betas[t] * sy, None, mean, sd)
        coef[0] += g.mean[-1]
        fit = 1 - sums[f"{t}|m"] / sums[f"{t}|0"] if sums[f"{t}|0"] else None
        rows += [(float(t), n, float(c), float(c - o), fit) for n, c, o in zip(["const", *xs], coef, start.coef)]
    return local_rows(df.sparkSession, rows, "quantile double, variable string, coefficient double, minus_ols double, pseudo_r2 double")
