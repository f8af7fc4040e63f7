"""Forecasters for many series: smoothing, autoregression, trend with seasons, conditional volatility.

Recursive filters are linear in their state, so a long series is cut into blocks: each
block's effect on the state is computed independently, the few block effects are chained,
and the blocks are then replayed from their true starting states. No series is processed
whole by one task unless it is short.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, join_null_safe
from lodestat.operators.gram import complete, gram_exprs, gram_of_row, ols
from lodestat.operators.ordering import largest_series, over_order, with_position

BLOCK = 50_000


def _keys(by: Sequence[str]) -> list[Column]:
    return [as_col(b) for b in by]


def _typed(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)


def per_series(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit: Callable, schema: str) -> DataFrame:
    """Cross-products per series in one aggregate, then `fit(gram) -> rows` on Arrow batches of series."""
    cols, by = list(cols), list(by)
    blocks = complete(df, cols).groupBy(*_keys(by)).agg(*gram_exprs(cols))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if r["n"] and r["n"] > 0:
                    r = {k: (0.0 if isinstance(v, float) and v != v else v) for k, v in r.items()}
                    out += [tuple(r[b] for b in by) + row for row in fit(gram_of_row(r, cols))]
            yield pd.DataFrame(out, columns=names)

    names = [*by, *[f.strip().split(" ")[0] for f in schema.split(",")]]
    return blocks.mapInPandas(run, _typed(df, by) + schema)


# ---------------------------------------------------------------- linear state filters

@dataclass
class StateModel:
    """state' = a state + b y + c; the one-step prediction is h . state (before y is seen)."""
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    h: np.ndarray
    tag: tuple


def filter_series(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], models: Sequence[StateModel], start: DataFrame,
                  loss: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int | None = None, **kw) -> DataFrame:
    """(by…, model, loss, state): total loss and final state of every model on every series.

    `start` holds (by…, s0 array<double>), the state before the first value.
    """
    by = list(by)
    # neither a block's rows nor a series' chain of blocks may outgrow a task: both stay near the square root
    block = block or max(BLOCK, math.isqrt(largest_series(df, by)))
    placed = with_position(df.where(as_col(value).isNotNull()), order, by, "__i", **kw).select(
        *_keys(by), "__i", as_col(value).cast("double").alias("y"), F.floor(F.col("__i") / block).alias("blk"))
    m, d = len(models), len(models[0].b)
    A, B, C, H = (np.stack([getattr(x, k) for x in models]) for k in "abch")
    kinds = _typed(df, by)

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros((m, d))
        for y in pdf.sort_values("__i")["y"].to_numpy():
            s = np.einsum("mij,mj->mi", A, s) + B * y + C
        return pd.DataFrame([[*(pdf[b].iloc[0] for b in by), int(pdf["blk"].iloc[0]), len(pdf), s.ravel().tolist()]], columns=[*by, "blk", "size", "effect"])

    effects = placed.groupBy(*_keys(by), "blk").applyInPandas(effect, kinds + "blk long, size long, effect array<double>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Starting state of each block; one row per block comes in."""
        s = np.tile(np.asarray(pdf["s0"].iloc[0], float), (m, 1))
        out = []
        for r in pdf.sort_values("blk").itertuples(index=False):
            out.append([*(getattr(r, b) if hasattr(r, b) else pdf[b].iloc[0] for b in by), r.blk, s.ravel().tolist()])
            power = np.stack([np.linalg.matrix_power(a, int(r.size)) for a in A])
            s = np.einsum("mij,mj->mi", power, s) + np.asarray(r.effect, float).reshape(m, d)
        return pd.DataFrame(out, columns=[*by, "blk", "s"])

    with_start = join_null_safe(effects, start, by) if by else effects.withColumn("s0", F.lit(start.first()["s0"]))
    begins = with_start.groupBy(*(_keys(by) or [F.lit(0).alias("__all")])).applyInPandas(chain, kinds + "blk long, s array<double>")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        s = np.asarray(pdf["s"].iloc[0], float).reshape(m, d)
        total = np.zeros(m)
        for y in pdf["y"].to_numpy():
            total += loss(np.full(m, y), np.einsum("mi,mi->m", H, s))
            s = np.einsum("mij,mj->mi", A, s) + B * y + C
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] * m for b in by}, "blk": int(pdf["blk"].iloc[0]), "model": range(m), "loss": total, "state": [r.tolist() for r in s]})

    whole = join_null_safe(placed, begins, [*by, "blk"])
    parts = whole.groupBy(*_keys(by), "blk").applyInPandas(replay, kinds + "blk long, model long, loss double, state array<double>")
    return parts.groupBy(*_keys(by), "model").agg(F.sum("loss").alias("loss"), F.max_by("state", "blk").alias("state"), F.count(F.lit(1)).alias("blocks"))


def best_models(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    return fits.groupBy(*_keys(by)).agg(F.min(F.struct("loss", "model", "state")).alias("b")).select(*_keys(by), "b.*")


def smoothing_models(period: int, grid: Sequence[float] = (.1, .3, .5, .8), trend: Sequence[float] = (0.0, .1, .3), season: Sequence[float] = (.05, .2, .4)) -> list[StateModel]:
    """Additive Holt-Winters over a parameter grid; state is level, slope, and the seasons with the next one first."""
    p = period if period > 1 else 0
    d = 2 + p
    out = []
    for al, be, ga in itertools.product(grid, trend, season if p else (0.0,)):
        f = np.zeros((d, d))
        f[0, 0] = f[0, 1] = f[1, 1] = 1.0
        for i in range(p):
            f[2 + i, 2 + (i + 1) % p] = 1.0
        h = np.zeros(d)
        h[0] = h[1] = 1.0
        g = np.zeros(d)
        g[0], g[1] = al, al * be
        if p:
            h[2] = 1.0
            g[d - 1] = ga * (1 - al)
        out.append(StateModel(f - np.outer(g, h), g, np.zeros(d), h, (al, be, ga)))
    return out


def holt_winters(df: DataFrame, value: str, order: Sequence[str], horizon: int, period: int = 1, by: Sequence[str] = (), multiplicative: bool = False, **kw) -> DataFrame:
    """Forecasts of each series from its best smoothing parameters; multiplicative seasons are additive in logs."""
    by = list(by)
    v = F.log(as_col(value)) if multiplicative else as_col(value).cast("double")
    work = df.withColumn("__y", v).where("__y IS NOT NULL")
    p = period if period > 1 else 0
    placed = with_position(work, order, by, "__i").where(F.col("__i") < max(2 * period, 2))
    head = placed.groupBy(*_keys(by)).agg(F.avg("__y").alias("m"), F.avg(F.when(F.col("__i") < period, F.col("__y"))).alias("a"),
                                          F.avg(F.when(F.col("__i") >= period, F.col("__y"))).alias("b"),
                                          *[F.avg(F.when(F.col("__i") % period == i, F.col("__y"))).alias(f"s{i}") for i in range(p)])
    slope = F.coalesce((F.col("b") - F.col("a")) / period, F.lit(0.0))
    level = F.col("a") - slope * (period + 1) / 2
    seasons = [F.coalesce(F.col(f"s{i}") - F.col("m") - slope * (i - (p - 1) / 2), F.lit(0.0)) for i in range(p)]
    start = head.select(*_keys(by), F.array(level, slope, *seasons).alias("s0"))
    models = smoothing_models(period)
    best = best_models(filter_series(work, "__y", order, by, models, start, lambda y, f: (y - f) ** 2, **kw), by)
    steps = best.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    season = F.element_at("state", (F.pmod(F.col("step") - 1, F.lit(p)) + 3).cast("int")) if p else F.lit(0.0)
    f = F.element_at("state", 1) + F.col("step") * F.element_at("state", 2) + season
    params = F.array(*[F.array(*[F.lit(float(x)) for x in m.tag]) for m in models])
    return steps.select(*_keys(by), "step", (F.exp(f) if multiplicative else f).alias("forecast"), F.col("loss").alias("sse"),
                        F.element_at(params, (F.col("model") + 1).cast("int")).alias("parameters"))


def garch(df: DataFrame, ret: str, order: Sequence[str], by: Sequence[str] = (), alphas: Sequence[float] = (.03, .05, .1, .15, .2), betas: Sequence[float] = (.6, .7, .8, .85, .9, .94), **kw) -> DataFrame:
    """Conditional variance with variance targeting: best (alpha, beta) by likelihood, last and long-run variance.

    Returns are divided by their own deviation first, so one grid of models fits all series.
    """
    by = list(by)
    r = as_col(ret).cast("double")
    stats = df.groupBy(*_keys(by)).agg(F.avg(r).alias("__m"), F.var_samp(r).alias("__v"))
    if by:
        work = join_null_safe(df, stats, by)
    else:
        s = stats.first()
        work = df.withColumn("__m", F.lit(s["__m"])).withColumn("__v", F.lit(s["__v"]))
    work = work.withColumn("__u", F.try_divide((r - F.col("__m")) * (r - F.col("__m")), F.col("__v")))
    models = [StateModel(np.array([[b]]), np.array([a]), np.array([1 - a - b]), np.array([1.0]), (a, b)) for a in alphas for b in betas if a + b < 0.999]
    start = stats.where("__v > 0").select(*_keys(by), F.array(F.lit(1.0)).alias("s0"))
    fits = filter_series(work, "__u", order, by, models, start, lambda y, f: 0.5 * (np.log(f) + y / f), **kw)
    best = best_models(fits, by)
    scaled = join_null_safe(best, stats, by) if by else best.withColumn("__v", F.lit(stats.first()["__v"]))
    pick = F.array(*[F.array(*[F.lit(float(x)) for x in m.tag]) for m in models])
    tag = F.element_at(pick, (F.col("model") + 1).cast("int"))
    return scaled.select(*_keys(by), F.element_at(tag, 1).alias("alpha"), F.element_at(tag, 2).alias("beta"), F.col("loss").alias("neg_log_likelihood"),
                         F.sqrt(F.element_at("state", 1) * F.col("__v")).alias("next_volatility"), F.sqrt("__v").alias("long_run_volatility"))


# ---------------------------------------------------------------- autoregression

def lag_columns(df: DataFrame, value: str, order: Sequence[str], lags: Sequence[int], d: int = 0, by: Sequence[str] = (), **kw) -> DataFrame:
    """The (differenced) value as `y` with its lags l1, l2, …"""
    work = df.where(as_col(value).isNotNull()).withColumn("y", as_col(value).cast("double"))
    for _ in range(d):
        work = over_order(work, order, lambda w: {"y": F.col("y") - F.lag("y").over(w)}, by, before=1, **kw).where("y IS NOT NULL")
    return over_order(work, order, lambda w: {f"l{k}": F.lag("y", k).over(w) for k in lags}, by, before=max(lags), **kw)


def autoregression(df: DataFrame, value: str, order: Sequence[str], most: int = 5, d: int = 0, seasonal: int = 0, by: Sequence[str] = (), **kw) -> DataFrame:
    """Per series: lag order by AIC, coefficients (constant first) and residual variance; a seasonal lag may be added."""
    lags = [*range(1, most + 1), *([seasonal] if seasonal > most else [])]
    wide = lag_columns(df, value, order, lags, d, by, **kw)

    def fit(g):
        best = None
        for p in range(1, most + 1):
            for extra in ((), (f"l{seasonal}",)) if seasonal > most else ((),):
                xs = [*[f"l{k}" for k in range(1, p + 1)], *extra]
                f = ols(g, "y", xs)
                aic = g.n * math.log(max(f.rss, 1e-300) / g.n) + 2 * (len(xs) + 1)
                if best is None or aic < best[0] - 1e-12:
                    best = (aic, p, bool(extra), f)
        aic, p, extra, f = best
        return [(int(p), extra, int(g.n), float(aic), float(f.rss / max(1.0, f.df_resid)), [float(c) for c in f.coef])]

    return per_series(wide, [*[f"l{k}" for k in lags], "y"], by, fit, "p long, seasonal boolean, n long, aic double, sigma2 double, coef array<double>")


def autoregressive_forecast(df: DataFrame, value: str, order: Sequence[str], horizon: int, most: int = 5, d: int = 0, seasonal: int = 0, by: Sequence[str] = (), **kw) -> DataFrame:
    """Step-ahead forecasts with 95 % limits from the fitted lags and the last few values of each series."""
    by = list(by)
    fits = autoregression(df, value, order, most, d, seasonal, by, **kw)
    depth = max(most, seasonal) + d + 1
    placed = with_position(df.where(as_col(value).isNotNull()), order, by, "__i", **kw).select(*_keys(by), "__i", as_col(value).cast("double").alias("y"))
    size = placed.groupBy(*_keys(by)).agg(F.max("__i").alias("__n"))
    tail = join_null_safe(placed, size, by) if by else placed.withColumn("__n", F.lit(size.first()[0]))
    last = tail.where(F.col("__i") > F.col("__n") - depth).groupBy(*_keys(by)).agg(F.sort_array(F.collect_list(F.struct("__i", "y"))).alias("t")).select(
        *_keys(by), F.transform("t", lambda s: s["y"]).alias("tail"))  # at most `depth` values per series
    both = join_null_safe(fits, last, by) if by else fits.withColumn("tail", F.lit(last.first()["tail"]))
    names = [*by, "step", "forecast", "low", "high"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                hist = np.diff(np.asarray(r["tail"], float), d) if d else np.asarray(r["tail"], float)
                hist, coef, p = list(hist), np.asarray(r["coef"], float), int(r["p"])
                phi = np.zeros(max(p, seasonal if r["seasonal"] else 0) + 1)
                phi[1:p + 1] = coef[1:p + 1]
                if r["seasonal"]:
                    phi[seasonal] += coef[-1]
                path, psi = [], [1.0]
                for h in range(horizon):
                    y = coef[0] + sum(phi[k] * hist[-k] for k in range(1, len(phi)) if k <= len(hist))
                    hist.append(y)
                    path.append(y)
                    psi.append(sum(phi[k] * psi[-k] for k in range(1, min(len(phi), len(psi) + 1))))
                weights, level = np.array(psi[:horizon]), np.asarray(path)
                for j in range(d):
                    weights = np.cumsum(weights)
                    level = np.cumsum(level) + np.diff(np.asarray(r["tail"], float), d - 1 - j)[-1]
                half = 1.959963984540054 * np.sqrt(r["sigma2"] * np.cumsum(weights ** 2))
                out += [tuple(r[b] for b in by) + (i + 1, float(level[i]), float(level[i] - half[i]), float(level[i] + half[i])) for i in range(horizon)]
            yield pd.DataFrame(out, columns=names)

    return both.mapInPandas(run, _typed(df, by) + "step int, forecast double, low double, high double")


# ---------------------------------------------------------------- trend with seasons

def trend_season_fit(df: DataFrame, value: str, order: Sequence[str], period: int, horizon: int, knots: int = 5, waves: int = 3, by: Sequence[str] = (), **kw) -> DataFrame:
    """Piecewise-linear trend plus Fourier terms by least squares per series, with forecasts."""
    by = list(by)
    placed = with_position(df.where(as_col(value).isNotNull()), order, by, "__i", **kw).select(*_keys(by), F.col("__i").cast("double").alias("i"), as_col(value).cast("double").alias("y"))
    size = placed.groupBy(*_keys(by)).agg((F.max("i") + 1).alias("n"))
    work = join_null_safe(placed, size, by) if by else placed.withColumn("n", F.lit(size.first()[0]))
    t = F.col("i") / F.col("n")
    terms = {"t": t, **{f"k{j}": F.greatest(t - j / (knots + 1) * 0.8, F.lit(0.0)) for j in range(1, knots + 1)}}
    waves = min(waves, max(1, period // 2)) if period > 1 else 0
    for j in range(1, waves + 1):
        terms[f"c{j}"] = F.cos(F.col("i") * (2 * math.pi * j / period))
        if 2 * j != period:
            terms[f"s{j}"] = F.sin(F.col("i") * (2 * math.pi * j / period))
    wide = work.select(*_keys(by), "y", "n", *[c.alias(n) for n, c in terms.items()])
    names = list(terms)

    def fit(g):
        n = int(round(g.n))
        f = ols(g, "y", names)
        rows = []
        for s in range(1, horizon + 1):
            i = n - 1 + s
            x = [1.0, i / n, *[max(i / n - j / (knots + 1) * 0.8, 0.0) for j in range(1, knots + 1)]]
            for j in range(1, waves + 1):
                x.append(math.cos(i * 2 * math.pi * j / period))
                if 2 * j != period:
                    x.append(math.sin(i * 2 * math.pi * j / period))
            y = float(np.dot(f.coef, x))
            half = 1.959963984540054 * math.sqrt(max(f.sigma2, 0.0))
            rows.append((s, y, y - half, y + half, float(f.r2)))
        return rows

    return per_series(wide, [*names, "y"], by, fit, "step long, forecast double, low double, high double, r2 double")


# ---------------------------------------------------------------- comparison

def compare_forecasters(df: DataFrame, value: str, order: Sequence[str], horizon: int, period: int = 1, by: Sequence[str] = (), methods: Sequence[str] | None = None, **kw) -> DataFrame:
    """Hold out the last `horizon` values and score each forecaster: MAE, RMSE, MAPE and skill against the last value."""
    from lodestat.operators.arima import arima_forecast
    from lodestat.operators.series import naive_forecasts, score_forecasts
    from lodestat.operators.smoothing import smoothing_forecast
    by = list(by)
    placed = with_position(df.where(as_col(value).isNotNull()), order, by, "__i", **kw)
    size = placed.groupBy(*_keys(by)).agg((F.max("__i") + 1).alias("__n"))
    whole = join_null_safe(placed, size, by) if by else placed.withColumn("__n", F.lit(size.first()[0]))
    past = whole.where(F.col("__i") < F.col("__n") - horizon).drop("__n")
    actual = whole.where(F.col("__i") >= F.col("__n") - horizon).select(*_keys(by), (F.col("__i") - F.col("__n") + horizon + 1).cast("int").alias("step"), as_col(value).cast("double").alias("y"))
    simple = naive_forecasts(past, value, ["__i"], horizon, period, by)
    out = simple.select(*_keys(by), F.col("step").cast("int").alias("step"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(m).alias("forecast")) for m in ("naive", "seasonal_naive", "drift")])).alias("m")).select(*_keys(by), "step", "m.*")
    makers = {
        "holt_winters": lambda: smoothing_forecast(past, value, ["__i"], horizon, period, by),
        "autoregressive": lambda: autoregressive_forecast(past, value, ["__i"], horizon, by=by),
        "arima": lambda: arima_forecast(past, value, ["__i"], horizon, by=by),
        "trend_season": lambda: trend_season_fit(past, value, ["__i"], period, horizon, by=by),
    }
    for m in methods if methods is not None else makers:
        out = out.unionByName(makers[m]().select(*_keys(by), F.col("step").cast("int").alias("step"), F.lit(m).alias("method"), "forecast"))
    return score_forecasts(join_null_safe(out, actual, [*by, "step"]).where("y IS NOT NULL"), by)
