"""Least squares: summaries, robust errors, residual diagnostics, breaks and influence."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.functions.expr import local_rows, as_col, ratio
from lodestat.operators.gram import Fit, Gram, complete, gram, ols, weighted_sums
from lodestat.operators.ordering import over_order, running_total

COEF_SCHEMA = "variable string, coefficient double, std_error double, t double, p double, ci_low double, ci_high double"


def coefficient_rows(names: Sequence[str], coef: np.ndarray, se: np.ndarray, dof: float) -> list[tuple]:
    crit = dist.t_ppf(0.975, dof) if dof > 0 else float("nan")
    rows = []
    for n, b, s in zip(names, coef, se):
        t = b / s if s > 0 else None
        rows.append((n, float(b), float(s), None if t is None else float(t), None if t is None else dist.t_two_sided(t, dof),
                     float(b - crit * s), float(b + crit * s)))
    return rows


def fit_ols(df: DataFrame, y: str, xs: Sequence[str]) -> Fit:
    return ols(gram(df, [*xs, y]), y, xs)


def residual(fit: Fit, y: str) -> Column:
    return as_col(y).cast("double") - fit.predict()


def ols_summary(df: DataFrame, y: str, xs: Sequence[str], robust: str | None = None) -> DataFrame:
    """Coefficient table; `robust` of hc1 or hc3 replaces the classical errors."""
    fit = fit_ols(df, y, xs)
    se = fit.se if robust is None else np.sqrt(np.diag(robust_covariance(df, fit, y, robust)))
    return local_rows(df.sparkSession, coefficient_rows(fit.names, fit.coef, se, fit.df_resid), COEF_SCHEMA)


def ols_quality(df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """R2, F, information criteria and, given a row order, Durbin-Watson; one row."""
    fit = fit_ols(df, y, xs)
    n, k = fit.n, len(xs)
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(fit.rss / n) + 1) if fit.rss > 0 else float("inf")
    f = (fit.tss - fit.rss) / k / fit.sigma2 if fit.rss > 0 and k else float("inf")
    dw = durbin_watson(complete(df, [*xs, y]), residual(fit, y), order).first()[0] if order else None
    terms = " ".join(f"{'+' if b >= 0 else '-'} {abs(b):.6g}*{n}" for n, b in zip(fit.names[1:], fit.coef[1:]))
    row = (int(n), fit.r2, 1 - (1 - fit.r2) * (n - 1) / fit.df_resid, f, dist.f_sf(f, k, fit.df_resid), -2 * llf + 2 * (k + 1),
           -2 * llf + math.log(n) * (k + 1), dw, f"{y} = {fit.coef[0]:.6g} {terms}".strip())
    return local_rows(df.sparkSession, [row], "n long, r2 double, r2_adjusted double, f double, f_p double, aic double, bic double, durbin_watson double, equation string")


def _design(fit: Fit) -> list[Column]:
    return [F.lit(1.0)] + [as_col(c).cast("double") for c in fit.names[1:]]


def leverage(fit: Fit) -> Column:
    """x (X'X)^-1 x' as an expression, in coordinates centred by the fit's own block for stability."""
    inv = fit.inv[1:, 1:]
    k = len(inv)
    centre = -np.linalg.pinv(inv) @ fit.inv[1:, 0] if k else np.zeros(0)
    d = [as_col(c).cast("double") - float(m) for c, m in zip(fit.names[1:], centre)]
    out = F.lit(1.0 / fit.n)
    for i in range(k):
        for j in range(k):
            out = out + F.lit(float(inv[i, j])) * d[i] * d[j]
    return out


def robust_covariance(df: DataFrame, fit: Fit, y: str, kind: str = "hc1") -> np.ndarray:
    """White covariance from a second pass; HC3 divides each residual by one minus its leverage."""
    e = residual(fit, y)
    if kind == "hc3":
        e = e / (1 - leverage(fit))
    meat, _, _ = weighted_sums(complete(df, [*fit.names[1:], y]), _design(fit), e * e, F.lit(0.0))
    cov = fit.inv @ meat @ fit.inv
    return cov * fit.n / fit.df_resid if kind == "hc1" else cov


# ---------------------------------------------------------------- residual diagnostics

def breusch_pagan(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """n R2 of squared residuals on the regressors."""
    fit = fit_ols(df, y, xs)
    aux = complete(df, [*xs, y]).select(*[as_col(c) for c in xs], (residual(fit, y) * residual(fit, y)).alias("__e2"))
    g = ols(gram(aux, [*xs, "__e2"]), "__e2", xs)
    lm = g.n * g.r2
    return local_rows(df.sparkSession, [(int(g.n), float(lm), len(xs), dist.chi2_sf(lm, len(xs)))], "n long, lm double, df int, p double")


def jarque_bera(df: DataFrame, e: Column) -> DataFrame:
    s = df.agg(F.count(e).alias("n"), F.skewness(e).alias("g1"), F.kurtosis(e).alias("g2"))
    return s.select("n", (F.col("n") / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)).alias("jarque_bera"))


def durbin_watson(df: DataFrame, e: Column, order: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    work = df.withColumn("__e", e).where("__e IS NOT NULL")
    lagged = over_order(work, order, lambda w: {"__l": F.lag("__e").over(w)}, by, before=1, **kw)
    d = F.col("__e") - F.col("__l")
    return lagged.groupBy(*[as_col(b) for b in by]).agg(ratio(F.sum(d * d), F.sum(F.col("__e") * F.col("__e"))).alias("durbin_watson"))


def ljung_box(df: DataFrame, e: Column, order: Sequence[str], lags: int | None = None, by: Sequence[str] = (), **kw) -> DataFrame:
    """Q over the first lags, from all lag products in one pass."""
    work = df.withColumn("__x", e).where("__x IS NOT NULL")
    if lags is None:
        lags = max(1, min(10, work.count() // 5))
    keys = [as_col(b) for b in by]
    if by:
        from lodestat.functions.expr import join_null_safe
        means = work.groupBy(*keys).agg(F.avg("__x").alias("__m"))
        work = join_null_safe(work, means, list(by)).withColumn("__x", F.col("__x") - F.col("__m")).drop("__m")
    else:
        work = work.withColumn("__x", F.col("__x") - F.lit(work.agg(F.avg("__x")).first()[0]))
    lagged = over_order(work, order, lambda w: {f"__l{k}": F.lag("__x", k).over(w) for k in range(1, lags + 1)}, by, before=lags, **kw)
    s = lagged.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("__x") * F.col("__x")).alias("v"),
                                  *[F.sum(F.col("__x") * F.col(f"__l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    n = F.col("n")
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        rho = ratio(F.col(f"c{k}"), F.col("v"))
        q = q + F.coalesce(rho * rho, F.lit(0.0)) * F.coalesce(F.try_divide(F.lit(1.0), F.greatest(n - k, F.lit(0.0))), F.lit(0.0))
    return s.select(*keys, n.cast("long").alias("n"), F.lit(lags).alias("lags"), (n * (n + 2) * q).alias("q"))


def reset_test(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """F for adding the squared fitted value."""
    fit = fit_ols(df, y, xs)
    data = complete(df, [*xs, y])
    middle = float(data.agg(F.avg(as_col(y).cast("double"))).first()[0])  # fitted values share the response's mean
    square = (fit.predict() - middle) * (fit.predict() - middle)
    wide = data.select(*[as_col(c) for c in [*xs, y]], square.alias("__fit2"))
    big = ols(gram(wide, [*xs, "__fit2", y]), y, [*xs, "__fit2"])
    f = (fit.rss - big.rss) / big.sigma2 if big.sigma2 > 0 else float("inf")
    return local_rows(df.sparkSession, [(int(fit.n), float(f), 1.0, float(big.df_resid), dist.f_sf(f, 1, big.df_resid) if math.isfinite(f) else 0.0)],
                                           "n long, f double, df1 double, df2 double, p double")


def diagnose_regression(df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Assumption checks of one regression: (check, statistic, p, respected, remedy)."""
    data = complete(df, [*xs, y])
    fit = fit_ols(df, y, xs)
    e = residual(fit, y)
    bp = breusch_pagan(df, y, xs).first()
    jb = jarque_bera(data, e).first()["jarque_bera"]
    lb = ljung_box(data, e, order).first()
    rs = reset_test(df, y, xs).first()
    dw = durbin_watson(data, e, order).first()[0]
    checks = [
        ("breusch_pagan", bp["lm"], bp["p"], "robust standard errors or a log target"),
        ("jarque_bera", jb, dist.chi2_sf(jb, 2), "harmless on large samples; else transform the target"),
        ("ljung_box", lb["q"], dist.chi2_sf(lb["q"], lb["lags"]), "a time-series model or autocorrelation-robust errors"),
        ("reset", rs["f"], rs["p"], "add a quadratic or interaction term"),
    ]
    rows = [(c, float(s), float(p), p >= 0.05, None if p >= 0.05 else why) for c, s, p, why in checks]
    rows.append(("durbin_watson", float(dw), None, 1.5 <= dw <= 2.5, None if 1.5 <= dw <= 2.5 else "model the memory between rows"))
    return local_rows(df.sparkSession, rows, "check string, statistic double, p double, respected boolean, remedy string")


# ---------------------------------------------------------------- breaks

def chow_f(pooled: Fit, first: Fit, second: Fit) -> tuple[float, float, float]:
    k = len(pooled.names)
    dof = pooled.n - 2 * k
    rss = first.rss + second.rss
    return max(0.0, (pooled.rss - rss) / k / (rss / dof)), float(k), float(dof)


def chow_test(df: DataFrame, y: str, xs: Sequence[str], before: Column) -> DataFrame:
    """F for different coefficients where `before` holds; both halves come from one grouped aggregate."""
    from lodestat.operators.gram import gram_exprs, gram_of_row
    cols = [*xs, y]
    rows = complete(df, cols).groupBy(before.alias("__before")).agg(*gram_exprs(cols)).collect()
    halves = {bool(r["__before"]): ols(gram_of_row(r, cols), y, xs) for r in rows}
    f, d1, d2 = chow_f(fit_ols(df, y, xs), halves[True], halves[False])
    return local_rows(df.sparkSession, [(float(f), d1, d2, dist.f_sf(f, d1, d2), float(halves[True].rss), float(halves[False].rss))],
        "f double, df1 double, df2 double, p double, rss_before double, rss_after double")


def chow_scan(df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str], trim: float = .15, **kw) -> DataFrame:
    """Chow F at every split of the ordered rows, in parallel.

    Running cross-products (prefix sums over slices) give both halves of every split;
    the small solves run on Arrow batches. (position, …order, f)
    """
    cols = [*xs, y]
    g = gram(df, cols)
    sd = np.sqrt(np.where(np.diag(g.cross) > 0, np.diag(g.cross), 1.0) / g.n)
    z = [(as_col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(cols, g.mean, sd)]
    k, n = len(cols), int(g.n)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    work = complete(df, cols).select(*[as_col(o) for o in order], F.lit(1).cast("double").alias("one"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
    sums = {"s_n": "one", **{f"s{i}": f"z{i}" for i in range(k)}, **{f"s{i}_{j}": F.col(f"z{i}") * F.col(f"z{j}") for i, j in pairs}}
    prefix = running_total(work, sums, order, **kw).drop("one", *[f"z{i}" for i in range(k)])
    unit = Gram(cols, g.n, np.zeros(k), g.cross / np.outer(sd, sd))
    pooled = ols(unit, y, xs).rss
    whole = unit.cross
    p = len(xs) + 1
    lowest = max(p + 1, int(n * trim))

    def rss(m: np.ndarray) -> np.ndarray:
        """Residual sums of a stack of centred blocks (last column is the response)."""
        a, b, c = m[:, :-1, :-1], m[:, :-1, -1], m[:, -1, -1]
        sol = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-10, hermitian=True), b)
        return np.maximum(c - np.einsum("ni,ni->n", sol, b), 0)

    def scan(batches):
        for pdf in batches:
            m = pdf["s_n"].to_numpy(float)
            keep = (m >= lowest) & (m < n - lowest)
            pdf, m = pdf[keep], m[keep]
            if not len(pdf):
                continue
            s = pdf[[f"s{i}" for i in range(k)]].to_numpy(float)
            q = np.zeros((len(pdf), k, k))
            for i, j in pairs:
                q[:, i, j] = q[:, j, i] = pdf[f"s{i}_{j}"]
            outer = np.einsum("ni,nj->nij", s, s)
            first = q - outer / m[:, None, None]
            second = (whole - q) - outer / (n - m)[:, None, None]
            both = rss(first) + rss(second)
            f = np.maximum(0, (pooled - both) / p / (both / (n - 2 * p)))
            yield pd.DataFrame({"split": m.astype("int64"), **{o: pdf[o] for o in order}, "f": f})

    schema = "split long, " + ", ".join(f"`{o}` {work.schema[o].dataType.simpleString()}" for o in order) + ", f double"
    return prefix.mapInPandas(scan, schema)


def strongest_break(df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    scan = chow_scan(df, y, xs, order, **kw)
    best = scan.agg(F.max(F.struct("f", (-F.col("split")).alias("k"), *[as_col(o) for o in order])).alias("b"))
    k = len(xs) + 1
    n = complete(df, [*xs, y]).count()
    return best.select((-F.col("b.k")).alias("split"), *[F.col(f"b.{o}").alias(o) for o in order], F.col("b.f").alias("f"),
                       dist.p_f(F.col("b.f"), F.lit(float(k)), F.lit(float(n - 2 * k))).alias("p"))


# ---------------------------------------------------------------- interaction and influence

def interaction_test(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Gain in R2 from the centred product of two columns."""
    g = gram(df, [a, b, y])
    ma, mb = g.mean[0], g.mean[1]
    wide = complete(df, [a, b, y]).select(as_col(a), as_col(b), as_col(y),
                                          ((as_col(a).cast("double") - float(ma)) * (as_col(b).cast("double") - float(mb))).alias("__ab"))
    full = gram(wide, [a, b, "__ab", y])
    small, big = ols(full, y, [a, b]), ols(full, y, [a, b, "__ab"])
    t = big.coef[3] / big.se[3] if big.se[3] > 0 else 0.0
    return local_rows(df.sparkSession, [(a, b, float(big.coef[3]), float(big.r2 - small.r2), float(t), dist.t_two_sided(t, big.df_resid))],
                                           "a string, b string, coefficient double, r2_gain double, t double, p double")


def cook_distance(df: DataFrame, y: str, xs: Sequence[str], name: str = "cook") -> DataFrame:
    """Influence of every row as an expression of its residual and leverage."""
    fit = fit_ols(df, y, xs)
    h, e = leverage(fit), residual(fit, y)
    return complete(df, [*xs, y]).withColumn("leverage", h).withColumn(
        name, e * e * F.col("leverage") / (F.lit(float(fit.rank * fit.sigma2)) * (1 - F.col("leverage")) * (1 - F.col("leverage"))))


def influence_summary(df: DataFrame, y: str, xs: Sequence[str], key: Sequence[str], top: int = 3, limit: float | None = None) -> DataFrame:
    """The most influential rows with the share of rows above the 4/n threshold."""
    d = cook_distance(df, y, xs)
    n = d.count()
    cut = limit if limit is not None else 4.0 / n
    above = d.agg(F.count_if(F.col("cook") > cut)).first()[0]
    return d.orderBy(F.desc("cook"), *[as_col(k) for k in key]).limit(top).select(*[as_col(k) for k in key], "cook", "leverage").withColumn(
        "share_above", F.lit(above / n)).withColumn("threshold", F.lit(cut))


def linear_warnings(df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Collinearity, residual memory and residual shape of a fitted line."""
    from lodestat.operators.correlate import vif_values
    g = gram(df, [*xs, y])
    fit = ols(g, y, xs)
    data = complete(df, [*xs, y])
    rows = [("vif", c, float(v), v > 10) for c, v in vif_values(g, list(xs)).items()]
    dw = durbin_watson(data, residual(fit, y), order).first()[0]
    rows.append(("durbin_watson", y, float(dw), not 1.5 <= dw <= 2.5))
    jb = jarque_bera(data, residual(fit, y)).first()["jarque_bera"]
    rows.append(("residual_normality", y, float(jb), dist.chi2_sf(jb, 2) < 0.05))
    return local_rows(df.sparkSession, rows, "check string, subject string, statistic double, warning boolean")
