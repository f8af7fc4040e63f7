"""Panel regressions from one per-entity aggregate; no entity's rows are ever gathered."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.functions.expr import local_rows, as_col
from lodestat.operators.gram import Gram, complete, gram, ols
from lodestat.operators.linear import COEF_SCHEMA, coefficient_rows, residual


@dataclass
class PanelSums:
    cols: list[str]
    n: float
    entities: int
    within: np.ndarray        # sum over entities of centred cross-products
    means: np.ndarray         # sum of n_i (1, m_i)(1, m_i)'
    between: Gram             # unweighted, over entity means
    balanced: bool


def panel_sums(df: DataFrame, entity: str, cols: Sequence[str]) -> PanelSums:
    cols, k = list(cols), len(cols)
    v = [as_col(c).cast("double") for c in cols]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    per = complete(df, cols).where(as_col(entity).isNotNull()).groupBy(as_col(entity).alias("g")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(v[i]).alias(f"m{i}") for i in range(k)],
        *[F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i, j in pairs])
    m = [F.col(f"m{i}") for i in range(k)]
    row = per.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("entities"), F.min("n").alias("low"), F.max("n").alias("high"),
        *[F.sum(F.col("n") * F.col(f"c{i}_{j}")).alias(f"w{i}_{j}") for i, j in pairs],
        *[F.sum(F.col("n") * m[i]).alias(f"s{i}") for i in range(k)],
        *[F.sum(F.col("n") * m[i] * m[j]).alias(f"q{i}_{j}") for i, j in pairs],
        *[F.avg(m[i]).alias(f"b{i}") for i in range(k)], *[F.covar_pop(m[i], m[j]).alias(f"d{i}_{j}") for i, j in pairs]).first()
    within, means, cross = np.zeros((k, k)), np.zeros((k + 1, k + 1)), np.zeros((k, k))
    means[0, 0] = row["n"]
    for i in range(k):
        means[0, i + 1] = means[i + 1, 0] = row[f"s{i}"]
    for i, j in pairs:
        within[i, j] = within[j, i] = row[f"w{i}_{j}"]
        means[i + 1, j + 1] = means[j + 1, i + 1] = row[f"q{i}_{j}"]
        cross[i, j] = cross[j, i] = row[f"d{i}_{j}"] * row["entities"]
    return PanelSums(cols, row["n"], row["entities"], within, means,
                     Gram(cols, row["entities"], np.array([row[f"b{i}"] for i in range(k)]), cross), row["low"] == row["high"])


def pooled(df: DataFrame, entity: str, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares with errors clustered on the entity."""
    fit = ols(gram(df, [*xs, y]), y, xs)
    e = residual(fit, y)
    k = len(xs) + 1
    design = [F.lit(1.0)] + [as_col(c).cast("double") for c in xs]
    per = complete(df, [*xs, y]).where(as_col(entity).isNotNull()).groupBy(as_col(entity)).agg(*[F.sum(x * e).alias(f"s{i}") for i, x in enumerate(design)])
    row = per.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = row[f"a{i}_{j}"]
    g = row["g"]
    cov = fit.inv @ meat @ fit.inv * g / (g - 1) * (fit.n - 1) / (fit.n - k)
    return local_rows(df.sparkSession, coefficient_rows(fit.names, fit.coef, np.sqrt(np.diag(cov)), g - 1), COEF_SCHEMA)


@dataclass
class PanelFit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    dof: float
    sigma2: float
    r2: float


def _fixed(s: PanelSums, y: str, xs: Sequence[str]) -> PanelFit:
    at = [s.cols.index(c) for c in xs]
    yi = s.cols.index(y)
    keep = [(c, i) for c, i in zip(xs, at) if s.within[i, i] / max(s.n - 1, 1) > 1e-10]
    if not keep:
        raise ValueError("no regressor varies within entities")
    names, idx = [c for c, _ in keep], [i for _, i in keep]
    inv = np.linalg.pinv(s.within[np.ix_(idx, idx)], hermitian=True)
    b = inv @ s.within[idx, yi]
    rss = float(s.within[yi, yi] - b @ s.within[idx, yi])
    dof = max(1.0, s.n - s.entities - len(idx))
    return PanelFit(names, b, inv * rss / dof, dof, rss / dof, 1 - rss / s.within[yi, yi])


def fixed_effects(df: DataFrame, entity: str, y: str, xs: Sequence[str]) -> DataFrame:
    """Within estimator: cross-products around entity means are sums of per-entity covariances."""
    f = _fixed(panel_sums(df, entity, [*xs, y]), y, xs)
    return local_rows(df.sparkSession, coefficient_rows(f.names, f.coef, np.sqrt(np.diag(f.cov)), f.dof), COEF_SCHEMA)


def _random(s: PanelSums, y: str, fe: PanelFit) -> tuple[PanelFit, float, float]:
    xs = fe.names
    b = ols(s.between, y, xs)
    sb = b.rss / max(1.0, s.entities - len(xs) - 1)
    t_bar = s.n / s.entities
    su = max(0.0, sb - fe.sigma2 / t_bar)
    theta = 1 - np.sqrt(fe.sigma2 / max(1e-8, fe.sigma2 + t_bar * su))
    order = [s.cols.index(c) for c in [*xs, y]]
    k = len(xs)
    # quasi-demeaned products split into the within part and (1 - theta)^2 times the part between means
    m = (1 - theta) ** 2 * s.means[np.ix_([0] + [i + 1 for i in order], [0] + [i + 1 for i in order])]
    m[1:, 1:] += s.within[np.ix_(order, order)]
    a, c, yy = m[:k + 1, :k + 1], m[:k + 1, k + 1], m[k + 1, k + 1]
    inv = np.linalg.pinv(a, hermitian=True)
    coef = inv @ c
    rss = float(yy - coef @ c)
    dof = s.n - k - 1
    mean_y = m[0, k + 1] / m[0, 0] if m[0, 0] else 0.0
    tss = yy - m[0, k + 1] * mean_y
    return PanelFit(["const", *xs], coef, inv * rss / dof, dof, rss / dof, 1 - rss / tss if tss > 0 else float("nan")), theta, su


def random_effects(df: DataFrame, entity: str, y: str, xs: Sequence[str]) -> DataFrame:
    """Swamy-Arora generalised least squares."""
    s = panel_sums(df, entity, [*xs, y])
    f, theta, su = _random(s, y, _fixed(s, y, xs))
    out = local_rows(df.sparkSession, coefficient_rows(f.names, f.coef, np.sqrt(np.diag(f.cov)), f.dof), COEF_SCHEMA)
    return out.withColumn("theta", F.lit(float(theta))).withColumn("sigma2_entity", F.lit(float(su)))


def hausman(df: DataFrame, entity: str, y: str, xs: Sequence[str]) -> DataFrame:
    """Do entity effects correlate with the regressors?"""
    s = panel_sums(df, entity, [*xs, y])
    fe = _fixed(s, y, xs)
    re, _, _ = _random(s, y, fe)
    gap = fe.coef - re.coef[1:]
    stat = max(0.0, float(gap @ np.linalg.pinv(fe.cov - re.cov[1:, 1:]) @ gap))
    p = dist.chi2_sf(stat, len(gap))
    return local_rows(df.sparkSession, [(stat, len(gap), p, "fixed" if p < 0.05 else "random")], "statistic double, df int, p double, preferred string")
