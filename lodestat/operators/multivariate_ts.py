"""Several series together: causality, cointegration, vector models and their workflow.

All models here are read off one block of cross-products of the variables' lags.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.functions.expr import as_col, local_rows
from lodestat.operators.gram import Gram, complete, gram, ols
from lodestat.operators.ordering import over_order
from lodestat.operators.stationarity import differenced, integration_order

# 90, 95 and 99 % points of the rank tests with a constant (MacKinnon, Haug and Michelis 1999), by number of common trends.
TRACE_CRITICAL = [[2.7055, 3.8415, 6.6349], [13.4294, 15.4943, 19.9349], [27.0669, 29.7961, 35.4628], [44.4929, 47.8545, 54.6815],
                  [65.8202, 69.8189, 77.8202], [91.1090, 95.7542, 104.9637], [120.3673, 125.6185, 135.9825], [153.6341, 159.5290, 171.0905]]
MAX_EIGEN_CRITICAL = [[2.7055, 3.8415, 6.6349], [12.2971, 14.2639, 18.5200], [18.8928, 21.1314, 25.8650], [25.1236, 27.5858, 32.7172],
                      [31.2379, 33.8777, 39.3693], [37.2786, 40.0763, 45.8662], [43.2947, 46.2299, 52.3069], [49.2855, 52.3622, 58.6634]]
# 5 % lower and upper bounds, constant without trend, by number of regressors (Pesaran, Shin and Smith 2001).
BOUNDS_5 = {1: (4.94, 5.73), 2: (3.79, 4.85), 3: (3.23, 4.35), 4: (2.86, 4.01), 5: (2.62, 3.79)}


def lag_frame(df: DataFrame, cols: Sequence[str], order: Sequence[str], lags: int, **kw) -> DataFrame:
    """Columns v0, v1, … of each variable v (lag 0 to `lags`), named index_lag."""
    base = complete(df, cols).select(*[as_col(o) for o in order], *[as_col(c).cast("double").alias(f"y{i}_0") for i, c in enumerate(cols)])
    return over_order(base, order, lambda w: {f"y{i}_{k}": F.lag(f"y{i}_0", k).over(w) for i in range(len(cols)) for k in range(1, lags + 1)}, before=lags, **kw)


def lag_block(df: DataFrame, cols: Sequence[str], order: Sequence[str], lags: int, **kw) -> Gram:
    return gram(lag_frame(df, cols, order, lags, **kw), [f"y{i}_{k}" for i in range(len(cols)) for k in range(lags + 1)])


# ---------------------------------------------------------------- causality

def _granger_f(g: Gram, effect: int, cause: int, p: int) -> tuple[float, float, float, float]:
    own = [f"y{effect}_{k}" for k in range(1, p + 1)]
    small = ols(g, f"y{effect}_0", own)
    big = ols(g, f"y{effect}_0", [*own, *[f"y{cause}_{k}" for k in range(1, p + 1)]])
    dof = g.n - 2 * p - 1
    f = max(0.0, (small.rss - big.rss) / p / (big.rss / dof)) if big.rss > 0 else float("inf")
    bic = g.n * math.log(max(big.rss, 1e-300) / g.n) + math.log(g.n) * (2 * p + 1)
    return f, float(p), dof, bic


def granger(df: DataFrame, cols: Sequence[str], order: Sequence[str], lags: int = 4, **kw) -> DataFrame:
    """Every ordered pair: lag by BIC on residual sums, its F and p, and the smallest p corrected for the lags tried."""
    g = lag_block(df, cols, order, lags, **kw)
    rows = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            if i == j:
                continue
            tests = [_granger_f(g, j, i, p) for p in range(1, lags + 1)]
            ps = [dist.f_sf(f, d1, d2) for f, d1, d2, _ in tests]
            at = int(np.argmin([t[3] for t in tests]))
            rows.append((cols[i], cols[j], at + 1, float(tests[at][0]), float(ps[at]), min(1.0, min(ps) * lags), min(1.0, min(ps) * lags) < 0.05))
    return local_rows(df.sparkSession, rows, "cause string, effect string, lag int, f double, p double, p_corrected double, significant boolean")


def granger_stationary(df: DataFrame, cols: Sequence[str], order: Sequence[str], lags: int = 4, **kw) -> DataFrame:
    """The same after differencing every series as often as the most integrated one needs."""
    d = max(integration_order(df, c, order, **kw)[0] for c in cols)
    work = complete(df, cols)
    for _ in range(d):
        work = over_order(work, order, lambda w: {c: as_col(c) - F.lag(as_col(c)).over(w) for c in cols}, before=1, **kw)
        work = complete(work, cols)
    return granger(work, cols, order, lags, **kw).withColumn("differences", F.lit(d))


# ---------------------------------------------------------------- cointegration

def _johansen(df: DataFrame, cols: Sequence[str], order: Sequence[str], lags: int, **kw):
    k = len(cols)
    wide = lag_frame(df, cols, order, lags + 1, **kw)
    names = {}
    for i in range(k):
        for l in range(lags + 1):
            names[f"d{i}_{l}"] = F.col(f"y{i}_{l}") - F.col(f"y{i}_{l + 1}")
        names[f"x{i}"] = F.col(f"y{i}_1")
    g = gram(wide.select(*[c.alias(n) for n, c in names.items()]), list(names))
    d0, z, x = [f"d{i}_0" for i in range(k)], [f"d{i}_{l}" for l in range(1, lags + 1) for i in range(k)], [f"x{i}" for i in range(k)]
    m = g.sub([*d0, *x, *z]).cross
    if z:
        zz = np.linalg.pinv(m[2 * k:, 2 * k:], hermitian=True)
        m = m[:2 * k, :2 * k] - m[:2 * k, 2 * k:] @ zz @ m[2 * k:, :2 * k]
    s = m / g.n
    s00, s01, s11 = s[:k, :k], s[:k, k:], s[k:, k:]
    chol = np.linalg.cholesky(s11)
    ci = np.linalg.inv(chol)
    vals, vecs = np.linalg.eigh(ci @ s01.T @ np.linalg.pinv(s00, hermitian=True) @ s01 @ ci.T)
    at = np.argsort(vals)[::-1]
    vals, beta = np.clip(vals[at], 0, 1 - 1e-15), ci.T @ vecs[:, at]
    return g, vals, beta, s00, s01, s11, (d0, x, z)


def johansen(df: DataFrame, cols: Sequence[str], order: Sequence[str], lags: int = 1, check: bool = True, **kw) -> DataFrame:
    """Trace and largest-eigenvalue statistics per rank, and the rank found step by step at 5 %."""
    if check:
        odd = [c for c in cols if integration_order(df, c, order, **kw)[0] != 1]
    else:
        odd = []
    g, vals, *_ = _johansen(df, cols, order, lags, **kw)
    k = len(cols)
    rows, rank, open_ = [], 0, True
    for r in range(k):
        trace = -g.n * np.log(1 - vals[r:]).sum()
        big = -g.n * math.log(1 - vals[r])
        ct, ce = TRACE_CRITICAL[k - r - 1][1], MAX_EIGEN_CRITICAL[k - r - 1][1]
        open_ = open_ and trace > ct
        rank += int(open_)
        rows.append((r, float(vals[r]), float(trace), ct, float(big), ce, bool(open_)))
    return local_rows(df.sparkSession, [(*x, rank, odd) for x in rows],
                      "null_rank int, eigenvalue double, trace double, trace_critical double, max_eigen double, max_eigen_critical double, rejected boolean, rank int, not_i1 array<string>")


# ---------------------------------------------------------------- vector autoregression

class VectorModel:
    """y_t = c + sum A_l y_{t-l} + e, with residual covariance and the last observed rows."""

    def __init__(self, cols: Sequence[str], const: np.ndarray, mats: list[np.ndarray], sigma: np.ndarray, n: float, last: np.ndarray):
        self.cols, self.const, self.mats, self.sigma, self.n, self.last = list(cols), const, mats, sigma, n, last

    def forecast(self, steps: int) -> np.ndarray:
        hist = [r for r in self.last]
        for _ in range(steps):
            hist.append(self.const + sum(a @ hist[-l] for l, a in enumerate(self.mats, 1)))
        return np.array(hist[-steps:])

    def impulse(self, steps: int, orthogonal: bool = True) -> np.ndarray:
        k = len(self.cols)
        psi = [np.eye(k)]
        for h in range(1, steps + 1):
            psi.append(sum((self.mats[l - 1] @ psi[h - l] for l in range(1, min(h, len(self.mats)) + 1)), np.zeros((k, k))))
        root = np.linalg.cholesky(self.sigma + 1e-12 * np.trace(self.sigma) / k * np.eye(k)) if orthogonal else np.eye(k)
        return np.array([p @ root for p in psi])


def last_rows(df: DataFrame, cols: Sequence[str], order: Sequence[str], n: int) -> np.ndarray:
    rows = complete(df, cols).orderBy(*[as_col(o).desc() for o in order]).limit(n).select(*[as_col(c).cast("double") for c in cols]).collect()
    return np.array([list(r) for r in rows][::-1])


def _fit_vector(g: Gram, k: int, p: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    xs = [f"y{i}_{l}" for l in range(1, p + 1) for i in range(k)]
    ys = [f"y{i}_0" for i in range(k)]
    block = g.sub([*xs, *ys])
    m = len(xs)
    sxx, sxy, syy = block.cross[:m, :m], block.cross[:m, m:], block.cross[m:, m:]
    sd = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
    b = (np.linalg.pinv(sxx / np.outer(sd, sd), hermitian=True) @ (sxy / sd[:, None])) / sd[:, None]
    resid = syy - sxy.T @ b
    const = block.mean[m:] - b.T @ block.mean[:m]
    return const, [b[(l - 1) * k:l * k].T for l in range(1, p + 1)], (resid + resid.T) / 2


def var_fit(df: DataFrame, cols: Sequence[str], order: Sequence[str], most: int = 4, lag: int | None = None, **kw) -> tuple[VectorModel, int]:
    """Lag order by AIC over one common block."""
    k = len(cols)
    g = lag_block(df, cols, order, most, **kw)
    best = None
    for p in [lag] if lag else range(1, most + 1):
        const, mats, resid = _fit_vector(g, k, p)
        aic = np.linalg.slogdet(resid / g.n)[1] + 2 * k * (k * p + 1) / g.n
        if best is None or aic < best[0]:
            best = (aic, p, const, mats, resid / max(1.0, g.n - k * p - 1))
    _, p, const, mats, sigma = best
    return VectorModel(cols, const, mats, sigma, g.n, last_rows(df, cols, order, p)), p


def _path_rows(spark, cols, path: np.ndarray) -> DataFrame:
    return local_rows(spark, [(s + 1, c, float(path[s, i])) for s in range(len(path)) for i, c in enumerate(cols)], "step int, column string, forecast double")


def var_forecast(df: DataFrame, cols: Sequence[str], order: Sequence[str], steps: int, most: int = 4, **kw) -> DataFrame:
    model, p = var_fit(df, cols, order, most, **kw)
    return _path_rows(df.sparkSession, cols, model.forecast(steps)).withColumn("lag", F.lit(p))


def impulse_rows(spark, model: VectorModel, steps: int) -> DataFrame:
    r = model.impulse(steps)
    share = np.cumsum(r ** 2, axis=0)
    share = share / share.sum(axis=2, keepdims=True)
    rows = [(h, b, a, float(r[h, i, j]), float(share[h, i, j])) for h in range(steps + 1) for i, a in enumerate(model.cols) for j, b in enumerate(model.cols)]
    return local_rows(spark, rows, "step int, impulse string, response string, value double, variance_share double")


def impulse_responses(df: DataFrame, cols: Sequence[str], order: Sequence[str], steps: int = 10, most: int = 4, **kw) -> DataFrame:
    """Orthogonalised responses and forecast-error variance shares."""
    return impulse_rows(df.sparkSession, var_fit(df, cols, order, most, **kw)[0], steps)


def pairwise_var(df: DataFrame, cols: Sequence[str], order: Sequence[str], steps: int, lag: int = 2, **kw) -> DataFrame:
    """Two-variable models of every pair, averaged per variable; all pairs come from one block."""
    g = lag_block(df, cols, order, lag, **kw)
    last = last_rows(df, cols, order, lag)
    total, used = np.zeros((steps, len(cols))), np.zeros(len(cols))
    for i, j in combinations(range(len(cols)), 2):
        names = {f"y{a}_{l}": f"y{b}_{l}" for b, a in enumerate((i, j)) for l in range(lag + 1)}
        sub = g.sub(list(names))
        sub.names = list(names.values())
        const, mats, resid = _fit_vector(sub, 2, lag)
        path = VectorModel([cols[i], cols[j]], const, mats, resid / g.n, g.n, last[:, [i, j]]).forecast(steps)
        total[:, i] += path[:, 0]
        total[:, j] += path[:, 1]
        used[[i, j]] += 1
    return _path_rows(df.sparkSession, cols, total / np.maximum(used, 1))


def vecm_forecast(df: DataFrame, cols: Sequence[str], order: Sequence[str], steps: int, lags: int = 1, rank: int | None = None, **kw) -> DataFrame:
    """Error-correction model by reduced-rank regression, rewritten in levels to forecast."""
    if rank is None:
        rank = johansen(df, cols, order, lags, check=False, **kw).first()["rank"]
    k = len(cols)
    rank = max(1, min(rank, k - 1))
    g, _, beta, s00, s01, s11, (d0, x, z) = _johansen(df, cols, order, lags, **kw)
    b = beta[:, :rank]
    alpha = s01 @ b @ np.linalg.pinv(b.T @ s11 @ b)
    block = g.sub([*d0, *x, *z])
    rest = block.cross[:k, 2 * k:] - alpha @ b.T @ block.cross[k:2 * k, 2 * k:]
    gamma = rest @ np.linalg.pinv(block.cross[2 * k:, 2 * k:], hermitian=True) if z else np.zeros((k, 0))
    const = block.mean[:k] - alpha @ b.T @ block.mean[k:2 * k] - gamma @ block.mean[2 * k:]
    hist = list(last_rows(df, cols, order, lags + 1))
    for _ in range(steps):
        d = const + alpha @ b.T @ hist[-1] + sum((gamma[:, (l - 1) * k:l * k] @ (hist[-l] - hist[-l - 1]) for l in range(1, lags + 1)), np.zeros(k))
        hist.append(hist[-1] + d)
    return _path_rows(df.sparkSession, cols, np.array(hist[-steps:])).withColumn("rank", F.lit(rank))


def ardl_bounds(df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str], lags: int = 2, **kw) -> DataFrame:
    """Bounds test for a level relation, with long-run coefficients."""
    cols = [y, *xs]
    wide = lag_frame(df, cols, order, lags + 1, **kw)
    k = len(cols)
    names = {}
    for i in range(k):
        names[f"x{i}"] = F.col(f"y{i}_1")
        for l in range(lags + 1):
            names[f"d{i}_{l}"] = F.col(f"y{i}_{l}") - F.col(f"y{i}_{l + 1}")
    g = gram(wide.select(*[c.alias(n) for n, c in names.items()]), list(names))
    short = [*[f"d0_{l}" for l in range(1, lags + 1)], *[f"d{i}_{l}" for i in range(1, k) for l in range(lags + 1)]]
    level = [f"x{i}" for i in range(k)]
    small, big = ols(g, "d0_0", short), ols(g, "d0_0", [*level, *short])
    f = (small.rss - big.rss) / k / big.sigma2
    lo, hi = BOUNDS_5.get(len(xs), BOUNDS_5[5])
    word = "level_relation" if f > hi else "none" if f < lo else "inconclusive"
    speed = float(big.coef[1])
    rows = [(x, float(-big.coef[2 + i] / speed) if speed else None, float(f), lo, hi, word, speed) for i, x in enumerate(xs)]
    return local_rows(df.sparkSession, rows, "regressor string, long_run double, f double, lower double, upper double, verdict string, adjustment double")


def bvar_fit(df: DataFrame, cols: Sequence[str], order: Sequence[str], lags: int = 2, tightness: float = 0.2, decay: float = 1.0, cross: float = 0.5, **kw) -> VectorModel:
    """Posterior mean under the Minnesota prior (own first lag near one, others near zero), equation by equation."""
    k = len(cols)
    g = lag_block(df, cols, order, lags, **kw)
    xs = [f"y{i}_{l}" for l in range(1, lags + 1) for i in range(k)]
    block = g.sub([*xs, *[f"y{i}_0" for i in range(k)]])
    m = len(xs)
    sxx, sxy, syy = block.cross[:m, :m], block.cross[:m, m:], block.cross[m:, m:]
    scale = np.array([math.sqrt(max(ols(g, f"y{i}_0", [f"y{i}_{l}" for l in range(1, lags + 1)]).sigma2, 1e-12)) for i in range(k)])
    b = np.zeros((m, k))
    for e in range(k):
        prior_mean = np.array([1.0 if (i == e and l == 1) else 0.0 for l in range(1, lags + 1) for i in range(k)])
        sd = np.array([tightness / l ** decay * (1.0 if i == e else cross * scale[e] / scale[i]) for l in range(1, lags + 1) for i in range(k)])
        w = scale[e] ** 2 / sd ** 2
        b[:, e] = np.linalg.solve(sxx + np.diag(w), sxy[:, e] + w * prior_mean)
    const = block.mean[m:] - b.T @ block.mean[:m]
    resid = syy - b.T @ sxy - sxy.T @ b + b.T @ sxx @ b
    return VectorModel(cols, const, [b[(l - 1) * k:l * k].T for l in range(1, lags + 1)], (resid + resid.T) / 2 / g.n, g.n, last_rows(df, cols, order, lags))


def bvar_forecast(df: DataFrame, cols: Sequence[str], order: Sequence[str], steps: int, lags: int = 2, **kw) -> DataFrame:
    return _path_rows(df.sparkSession, cols, bvar_fit(df, cols, order, lags, **kw).forecast(steps))


# ---------------------------------------------------------------- workflow

def workflow(df: DataFrame, cols: Sequence[str], order: Sequence[str], lags: int = 2, **kw) -> DataFrame:
    """Integration, cointegration, regime, causality and the models they call for: (stage, item, value, note)."""
    orders = {c: integration_order(df, c, order, **kw)[0] for c in cols}
    rows: list[tuple] = [("integration", c, float(d), None) for c, d in orders.items()]
    rank = 0
    ones = [c for c, d in orders.items() if d == 1]
    if len(ones) >= 2:
        rank = johansen(df, ones, order, 1, check=False, **kw).first()["rank"]
        rows.append(("cointegration", ",".join(ones), float(rank), None))
    regime = "levels" if set(orders.values()) == {0} else "error_correction" if 0 < rank < len(ones) and len(ones) == len(cols) else "differences"
    rows.append(("regime", regime, None, None))
    d = 0 if regime != "differences" else max(orders.values())
    for r in (granger(df, cols, order, lags, **kw) if d == 0 else granger_stationary(df, cols, order, lags, **kw)).collect():  # one row per ordered pair
        rows.append(("causality", f"{r['cause']}->{r['effect']}", r["p_corrected"], "significant" if r["significant"] else None))
    models = {"levels": ["var", "bvar"], "error_correction": ["vecm", "ardl"], "differences": ["var_differences", "bvar", "ardl"]}[regime]
    n = complete(df, cols).count()
    per = n / max(1, len(cols) * lags + 1)
    for i, m in enumerate(models):
        note = "few rows per coefficient: prefer the shrunken model" if per < 10 and m == "bvar" else None
        rows.append(("recommendation", m, float(i + 1), note))
    return local_rows(df.sparkSession, rows, "stage string, item string, value double, note string")
