"""Unit-root and stationarity tests from lag cross-products."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.functions.expr import as_col, local_rows
from lodestat.operators.gram import BLOCK, BRANCHES, WIDE, Gram, block_of, complete, gram, merged, ols
from lodestat.operators.ordering import over_order, running_total, with_position
from lodestat.session import cut_lineage

# Response-surface polynomials for the p-value of the unit-root t (MacKinnon 1994), one series.
UNIT_ROOT = {
    "c": {"star": -1.61, "min": -18.83, "max": 2.74, "small": [2.1659, 1.4412, 0.038269], "large": [1.7339, 0.93202, -0.12745, -0.010368]},
    "ct": {"star": -2.89, "min": -16.18, "max": 0.7, "small": [3.2512, 1.6047, 0.049588], "large": [2.5261, 0.61654, -0.37956, -0.060285]},
}
# Critical values at 10, 5, 2.5 and 1 % (Kwiatkowski, Phillips, Schmidt and Shin 1992).
LEVEL_CRITICAL = {"c": [0.347, 0.463, 0.574, 0.739], "ct": [0.119, 0.146, 0.176, 0.216]}
LAG_ROWS = 20_000  # positions whose lags a task holds at once
_LEVELS = [0.10, 0.05, 0.025, 0.01]


def unit_root_p(tau: float, kind: str = "c") -> float:
    t = UNIT_ROOT[kind]
    if tau > t["max"]:
        return 1.0
    if tau < t["min"]:
        return 0.0
    poly = t["small"] if tau <= t["star"] else t["large"]
    return dist.norm_cdf(sum(c * tau ** i for i, c in enumerate(poly)))


def _placed(df: DataFrame, value: str, order: Sequence[str], **kw) -> DataFrame:
    return with_position(df.where(as_col(value).isNotNull()), order, name="i", **kw).select("i", as_col(value).cast("double").alias("y"))


def _lagged(df: DataFrame, value: str, order: Sequence[str], depth: int, **kw) -> DataFrame:
    """Position, level, lagged level, difference and its lags."""
    placed = _placed(df, value, order, **kw)
    return over_order(placed, ["i"], lambda w: {
        "y1": F.lag("y", 1).over(w), "d0": F.col("y") - F.lag("y", 1).over(w),
        **{f"d{k}": F.lag("y", k).over(w) - F.lag("y", k + 1).over(w) for k in range(1, depth + 1)}}, before=depth + 1, **kw)


def _stretches(placed: DataFrame, reach: int) -> tuple[DataFrame, int]:
    """Rows by `stretch` of so many positions `i` (0, 1, …), each with the `reach` rows before it as well."""
    size = max(LAG_ROWS, reach)
    stretch = F.floor(F.col("i") / F.lit(size))
    also = F.floor((F.col("i") + reach) / F.lit(size))
    return placed.withColumn("stretch", F.explode(F.when(stretch == also, F.array(stretch)).otherwise(F.array(stretch, also)))), size


def lag_gram(placed: DataFrame, depth: int, trend: bool) -> Gram:
    """The block of y1, i with a trend, d1 … d<depth> and d0 of a series (i, y) with positions 0, 1, …: the lags are made in the tasks,
    from stretches of LAG_ROWS positions and those before that the lags reach."""
    names = ["y1", *(["i"] if trend else []), *[f"d{k}" for k in range(1, depth + 1)], "d0"]
    reach = depth + 1
    stretched, size = _stretches(placed.select("i", "y"), reach)

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        rows, stretch = rows.sort_values("i"), int(rows["stretch"].iloc[0])
        at, y = rows["i"].to_numpy(), rows["y"].to_numpy()
        d = np.diff(y)
        now = np.arange(max(reach, int(np.searchsorted(at, stretch * size))), len(y))  # rows of this stretch with all their lags
        lagged = [y[now - 1], *([at[now].astype(float)] if trend else []), *[d[now - 1 - k] for k in range(1, depth + 1)], d[now - 1]]
        n, mean, cross = block_of(np.column_stack(lagged))
        return pd.DataFrame({"branch": [stretch % BRANCHES], "n": [n], "mean": [mean.tobytes()], "block": [cross.tobytes()]})

    return merged(stretched.groupBy("stretch").applyInPandas(multiply, BLOCK), names)


def adf(df: DataFrame, value: str, order: Sequence[str], kind: str = "c", max_lag: int | None = None, **kw) -> tuple[float, float, int, int]:
    """(tau, p, lags, rows): lag length by AIC from one block of cross-products, then refitted on all usable rows."""
    n = df.where(as_col(value).isNotNull()).count()
    if n < 8:
        raise ValueError("a unit-root test needs at least 8 values")
    deepest = max_lag if max_lag is not None else int(math.ceil(12 * (n / 100) ** 0.25))
    deepest = max(0, min(deepest, n // 2 - (3 if kind == "ct" else 2)))
    lead = ["y1", *(["i"] if kind == "ct" else [])]
    many = len(lead) + deepest + 1 > WIDE
    if many:
        placed = cut_lineage(_placed(df, value, order, **kw))
    else:
        wide = _lagged(df, value, order, deepest, **kw)

    def block(lags: int) -> Gram:
        return lag_gram(placed, lags, kind == "ct") if many else gram(wide, [*lead, *[f"d{k}" for k in range(1, lags + 1)], "d0"])

    g = block(deepest)
    best = None
    for p in range(deepest + 1):
        fit = ols(g, "d0", [*lead, *[f"d{k}" for k in range(1, p + 1)]])
        aic = g.n * (math.log(max(fit.rss, 1e-300) / g.n) + math.log(2 * math.pi) + 1) + 2 * len(fit.names)
        if best is None or aic < best[0] - 1e-12:
            best = (aic, p)
    p = best[1]
    cols = [*lead, *[f"d{k}" for k in range(1, p + 1)], "d0"]
    fit = ols(block(p), "d0", cols[:-1])
    tau = float(fit.coef[1] / fit.se[1]) if fit.se[1] > 0 else float("-inf")
    return tau, unit_root_p(tau, kind), p, int(fit.n)


def autocovariances(df: DataFrame, e: str, lags: int, at_once: int = 100, **kw) -> list[float]:
    """Sums of lag products 1…lags of a centred column with positions `i`; many lags are multiplied in the tasks."""
    if lags > WIDE:
        stretched, size = _stretches(df.select("i", as_col(e).alias("e")), lags)

        def multiply(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("i")
            v = rows["e"].to_numpy()
            first = int(np.searchsorted(rows["i"].to_numpy(), int(rows["stretch"].iloc[0]) * size))
            sums = [float(v[max(first, k) :] @ v[max(first, k) - k : len(v) - k]) if len(v) > k else 0.0 for k in range(1, lags + 1)]
            return pd.DataFrame({"lag": range(1, lags + 1), "s": sums})

        found = stretched.groupBy("stretch").applyInPandas(multiply, "lag int, s double").groupBy("lag").agg(F.sum("s").alias("s")).collect()  # a row a lag
        return [s for _, s in sorted((r["lag"], r["s"]) for r in found)]
    out: list[float] = []
    for start in range(1, lags + 1, at_once):
        ks = range(start, min(lags, start + at_once - 1) + 1)
        wide = over_order(df, ["i"], lambda w: {f"l{k}": F.lag(e, k).over(w) for k in ks}, before=max(ks), **kw)
        row = wide.agg(*[F.sum(F.col(e) * F.col(f"l{k}")).alias(f"s{k}") for k in ks]).first()
        out += [row[f"s{k}"] or 0.0 for k in ks]
    return out


def kpss(df: DataFrame, value: str, order: Sequence[str], kind: str = "c", **kw) -> tuple[float, float, int]:
    """(statistic, p held between 0.01 and 0.10, lags) with the data-driven bandwidth."""
    placed = with_position(df.where(as_col(value).isNotNull()), order, name="i", **kw).select("i", as_col(value).cast("double").alias("y"))
    n, mean, slope, cut = placed.agg(F.count("y"), F.avg("y"), F.regr_slope(F.col("y"), F.col("i")), F.regr_intercept(F.col("y"), F.col("i"))).first()
    fitted = F.lit(mean) if kind == "c" else F.lit(cut) + F.lit(slope) * F.col("i")
    resid = placed.select("i", (F.col("y") - fitted).alias("e"))
    square = resid.agg(F.sum(F.col("e") * F.col("e"))).first()[0]
    if not square:
        raise ValueError("a constant series has no stationarity test")
    few = int(n ** (2 / 9))
    g = autocovariances(resid, "e", few, **kw) if few else []
    s0 = square / n + sum(c / (n / 2) for c in g)
    s1 = sum((k + 1) * c / (n / 2) for k, c in enumerate(g))
    gamma = 1.1447 * ((s1 / s0) ** 2) ** (1 / 3) if s0 else 0.0
    lags = min(int(gamma * n ** (1 / 3)), n - 1)
    more = autocovariances(resid, "e", lags, **kw) if lags > few else g[:lags]
    long_run = (square + 2 * sum(c * (1 - (k + 1) / (lags + 1)) for k, c in enumerate(more))) / n
    prefix = running_total(resid, {"s": "e"}, ["i"], **kw)
    eta = prefix.agg(F.sum(F.col("s") * F.col("s"))).first()[0] / (n * n)
    stat = eta / long_run if long_run > 0 else float("inf")
    return stat, float(np.interp(stat, LEVEL_CRITICAL[kind], _LEVELS)), lags


def verdict(adf_p: float, kpss_p: float, alpha: float = 0.05) -> str:
    root, level = adf_p >= alpha, kpss_p >= alpha
    if not root and level:
        return "stationary"
    if root and not level:
        return "non_stationary"
    return "difference_stationary" if not root else "inconclusive"


_SCHEMA = "column string, adf double, adf_p double, adf_lags long, kpss double, kpss_p double, kpss_lags long, verdict string"


def stationarity(df: DataFrame, values: Sequence[str], order: Sequence[str], kind: str = "c", **kw) -> DataFrame:
    rows = []
    df = _held(df, values, order)
    for c in values:
        tau, p, lags, _ = adf(df, c, order, kind, **kw)
        k, kp, kl = kpss(df, c, order, kind, **kw)
        rows.append((c, tau, p, lags, k, kp, kl, verdict(p, kp)))
    return local_rows(df.sparkSession, rows, _SCHEMA)


def _held(df: DataFrame, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Only the columns tested, written once: the tests read them many times."""
    return cut_lineage(df.select(*[as_col(c) for c in dict.fromkeys([*order, *values])]))


def differenced(df: DataFrame, value: str, order: Sequence[str], times: int, **kw) -> DataFrame:
    """The column differenced in place `times` times."""
    for _ in range(times):
        df = over_order(df.where(as_col(value).isNotNull()), order, lambda w: {value: as_col(value) - F.lag(as_col(value)).over(w)}, before=1, **kw)
    return df.where(as_col(value).isNotNull())


def integration_order(df: DataFrame, value: str, order: Sequence[str], most: int = 2, **kw) -> tuple[int, float, float]:
    """(order, first ADF p, first KPSS p): differences needed until both tests agree on stationarity."""
    first = None
    df = _held(df, [value], order)
    for d in range(most + 1):
        work = differenced(df, value, order, d, **kw)
        p = adf(work, value, order, **kw)[1]
        kp = kpss(work, value, order, **kw)[1]
        first = first or (p, kp)
        if p < 0.05 and kp > 0.05:
            return d, *first
    return most, *first


def integration_summary(df: DataFrame, values: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    rows = [(c, *integration_order(df, c, order, **kw)) for c in values]
    orders = {r[1] for r in rows}
    word = "all_stationary" if orders == {0} else "all_i1" if orders == {1} else "mixed" if 0 in orders else "all_nonstationary"
    return local_rows(df.sparkSession, [(*r, word) for r in rows], "column string, integration_order long, adf_p double, kpss_p double, summary string")
