"""Seasonal ARIMA with moving-average terms by exact Gaussian likelihood, for many series at once.

The one-step errors come from the state-space form. What its covariance does is known without data: it is carried as a
rank-one change per step until it stands still, and from there on the errors follow the ARMA recursion, which is linear in
the errors before. So a series longer than `block` is cut: each block gives its errors for empty history, the response to
each unit of history, and the cross-products of all of them, in one pass; a series' blocks are then chained through these
small matrices. Shorter series are fitted whole in their task.

Parameters descend by damped Gauss-Newton. One evaluation filters the point and its neighbours on both sides of every
parameter together; the cross-products of their errors hold the loss, its slope and its curvature.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, join_null_safe
from lodestat.operators.forecast import BLOCK, _keys, _typed
from lodestat.operators.ordering import largest_series, over_order, with_position
from lodestat.session import saved

LIMIT = 0.9995  # of partial autocorrelations, so that errors forget their start within a block
STILL = 1e-13  # change of the covariance per step that counts as none
STEP = 1e-4  # between a point and its neighbours
NO_GAIN = 1e-13  # of the sum of squares, where descents end
LITTLE_GAIN = 1e-7  # the same while starts and orders are compared
ROUNDS = 60
Order = tuple[int, int, int, int, int, int, int]  # p, d, q, P, D, Q, s


def candidate_orders(most: int = 2, d: int = 0) -> list[Order]:
    """All (p, d, q) with p and q up to `most`, not both 0."""
    return [(p, d, q, 0, 0, 0, 0) for p in range(most + 1) for q in range(most + 1) if p or q]


def seasonal_orders(s: int) -> list[Order]:
    """Twelve usual seasonal orders of period s."""
    fixed = [(1, 1, 0, 1, 0, 0), (0, 1, 1, 0, 1, 1), (1, 1, 1, 1, 0, 1), (1, 1, 1, 1, 1, 1), (2, 1, 0, 1, 0, 0), (0, 1, 2, 0, 1, 1),
             (1, 0, 1, 1, 0, 1), (2, 1, 1, 1, 0, 0), (1, 1, 0, 0, 1, 1), (0, 1, 1, 1, 0, 0), (1, 0, 0, 1, 1, 0), (2, 1, 1, 0, 1, 1)]
    return [(*o, s) for o in fixed]


# ---------------------------------------------------------------- polynomials

def differencing(d: int, D: int, s: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^s)^D, that of B^0 first."""
    out = np.ones(1)
    for lag, times in ((1, d), (s, D)):
        for _ in range(times):
            out = np.convolve(out, np.concatenate([[1.0], np.zeros(lag - 1), [-1.0]]))
    return out


def stable(x: np.ndarray) -> np.ndarray:
    """(m, p) numbers without bound to coefficients of a stationary recursion, through partial autocorrelations."""
    r = LIMIT * x / np.sqrt(1 + x * x)
    a = np.zeros((len(x), 0))
    for j in range(x.shape[1]):
        last = r[:, j : j + 1]
        a = np.concatenate([a - last * a[:, ::-1], last], axis=1)
    return a


def product(short: np.ndarray, seasonal: np.ndarray, s: int, sign: float) -> np.ndarray:
    """Coefficients behind B^0 of (1 + sign a(B)) (1 + sign b(B^s)), times sign."""
    p, q = short.shape[1], seasonal.shape[1]
    out = np.zeros((len(short), p + s * q + 1))
    for i in range(p + 1):
        for j in range(q + 1):
            a = 1.0 if i == 0 else sign * short[:, i - 1]
            b = 1.0 if j == 0 else sign * seasonal[:, j - 1]
            out[:, i + s * j] += a * b
    return sign * out[:, 1:]


@dataclass
class Model:
    order: Order
    constant: bool = True

    @property
    def mean(self) -> bool:
        return self.constant and self.order[1] == self.order[4] == 0

    @property
    def k(self) -> int:
        p, _, q, P, _, Q, _ = self.order
        return p + q + P + Q + self.mean

    @property
    def depth(self) -> int:
        """Values that differencing takes."""
        return self.order[1] + self.order[6] * self.order[4]

    @property
    def reach(self) -> tuple[int, int]:
        """Lags of the full recursion in values and in errors."""
        p, _, q, P, _, Q, s = self.order
        return p + s * P, q + s * Q

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """ar, seasonal ar, ma, seasonal ma and mean of (m, k) parameters."""
        p, _, q, P, _, Q, _ = self.order
        at = np.cumsum([0, p, P, q, Q])
        ar, sar, ma, sma = (stable(x[:, a:b]) for a, b in zip(at, at[1:]))
        return [ar, sar, -ma, -sma, x[:, -1] if self.mean else np.zeros(len(x))]

    def full(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ar, sar, ma, sma, mean = self.parts(x)
        s = self.order[6]
        return product(ar, sar, s, -1.0), product(ma, sma, s, 1.0), mean

    def starts(self) -> list[np.ndarray]:
        p, _, q, P, _, Q, _ = self.order
        out = []
        for ar, ma in ((0.4, 0.2), (-0.3, -0.4), (0.9, 0.9)) if p + P and q + Q else ((0.3, 0.3), (-0.5, -0.5)):
            out.append(np.concatenate([np.full(p, ar) / np.arange(1, p + 1), np.full(P, 0.3), np.full(q, ma) / np.arange(1, q + 1), np.full(Q, 0.3), np.zeros(int(self.mean))]))
        return out


# ---------------------------------------------------------------- errors

def run_errors(x: np.ndarray, theta: np.ndarray, history: np.ndarray) -> np.ndarray:
    """e_t = x_t - sum theta_j e_(t-j) for (m, n) inputs; history (m, q) holds the errors before, the newest first.

    Pieces of about sqrt(n) run side by side from empty history, and are chained by their responses to history."""
    m, n = x.shape
    q = theta.shape[1]
    if q == 0 or n == 0:
        return x.copy()
    lags = [j for j in range(1, q + 1) if theta[:, j - 1].any()]
    size = max(q, math.isqrt(n) + 1)
    pieces = -(-n // size)
    padded = np.zeros((m, pieces * size))
    padded[:, :n] = x
    e = np.ascontiguousarray(padded.reshape(m, pieces, size).transpose(2, 0, 1))
    response = np.zeros((q + size, m, q))
    response[np.arange(q), :, np.arange(q)[::-1]] = 1.0  # row q - 1 - j is the error j + 1 steps before
    for i in range(size):
        for j in lags:
            if j <= i:
                e[i] -= theta[:, j - 1, None] * e[i - j]
            response[q + i] -= theta[:, j - 1, None] * response[q + i - j]
    response = response[q:]
    for c in range(pieces):
        e[:, :, c] += np.einsum("imq,mq->im", response, history)
        history = e[size - 1 : size - q - 1 if size > q else None : -1, :, c].T
    return e.transpose(1, 2, 0).reshape(m, -1)[:, :n]


def filtered(w: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """w_t - sum phi_i w_(t-i) behind the first phi.shape[1] values."""
    p = phi.shape[1]
    out = w[:, p:].copy()
    for i in range(1, p + 1):
        if phi[:, i - 1].any():
            out -= phi[:, i - 1, None] * w[:, p - i : w.shape[1] - i]
    return out


def first_errors(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact one-step errors of (m, n) values from the start of the series, divided by their deviations, and the log of the product of variances."""
    m, n = w.shape
    p, q = phi.shape[1], theta.shape[1]
    r = max(p, q + 1)
    ar, load = np.zeros((m, r)), np.zeros((m, r))
    ar[:, :p], load[:, 0], load[:, 1 : q + 1] = phi, 1.0, theta

    def ahead(v: np.ndarray) -> np.ndarray:
        out = ar * v[:, :1]
        out[:, :-1] += v[:, 1:]
        return out

    step = np.zeros((m, r, r))
    step[:, :, 0] = ar
    step[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    spread, power = load[:, :, None] * load[:, None, :], step
    for _ in range(60):
        more = power @ spread @ power.transpose(0, 2, 1)
        spread, power = spread + more, power @ power
        if np.abs(more).max() <= 1e-15 * np.abs(spread).max():
            break
    variance, gain = spread[:, 0, 0], (step @ spread[:, :, :1])[:, :, 0]
    change, scale = gain.copy(), -1.0 / variance
    state = np.zeros((m, r))
    errors, logs = np.empty((m, n)), np.zeros(m)
    raw = np.empty((m, n))
    t = 0
    while t < n:
        e = w[:, t] - state[:, 0]
        raw[:, t], errors[:, t] = e, e / np.sqrt(variance)
        logs += np.log(variance)
        state = ahead(state) + gain * (e / variance)[:, None]
        head = change[:, 0]
        after = variance + head * head * scale
        gain = gain + ahead(change) * (scale * head)[:, None]
        scale = scale + (scale * head) ** 2 / variance
        change = ahead(change) - gain * (head / after)[:, None]
        variance = after
        t += 1
        if t % 16 == 0 and t >= max(p, q) and (np.abs(scale) * np.square(change).max(axis=1)).max() < STILL:
            break
    if t < n:
        history = raw[:, t - q : t][:, ::-1] if q else np.zeros((m, 0))
        errors[:, t:] = run_errors(filtered(w[:, t - p :], phi), theta, history)
    return errors, logs


# ---------------------------------------------------------------- descent

def around(x: np.ndarray) -> np.ndarray:
    """The point and its neighbours on both sides of each parameter."""
    k = len(x)
    out = np.tile(x, (2 * k + 1, 1))
    for i in range(k):
        out[1 + 2 * i, i] += STEP
        out[2 + 2 * i, i] -= STEP
    return out


@dataclass
class Descent:
    """Damped Gauss-Newton from loss, slope and curvature at trial points."""
    trial: np.ndarray
    x: np.ndarray | None = None
    loss: float = math.inf
    curvature: np.ndarray | None = None
    slope: np.ndarray | None = None
    damping: float = 1e-3
    done: bool = False
    rounds: int = 0
    tolerance: float = NO_GAIN
    kept: dict = field(default_factory=dict)

    def take(self, loss: float, slope: np.ndarray, curvature: np.ndarray, **kept) -> None:
        """What was found at `self.trial`; `kept` is stored if the trial becomes the point."""
        self.rounds += 1
        if math.isfinite(loss) and loss < self.loss:
            self.x, self.loss, self.slope, self.curvature, self.kept = self.trial, loss, slope, curvature, kept
            self.damping = max(self.damping / 5, 1e-9)
            self.done = len(self.trial) == 0
        else:
            self.damping = max(self.damping, 1e-6) * 6
            if self.x is None or self.damping > 1e9:
                self.done = True
        if self.rounds >= ROUNDS:
            self.done = True
        if not self.done:
            self.propose()

    def propose(self) -> None:
        """The next trial; the quadratic model's gain decides whether to go on, so a flat ridge of needless parameters ends a descent too."""
        weight = np.maximum(np.diag(self.curvature), 1e-12 * max(abs(self.loss), 1e-300))
        move = -np.linalg.lstsq(self.curvature + np.diag(self.damping * weight), self.slope, rcond=None)[0]
        move *= min(1.0, 1.0 / max(float(np.abs(move).max(initial=0.0)), 1e-300))
        self.done = -float(self.slope @ move) <= self.tolerance * abs(self.loss)
        self.trial = self.x + move

    def refine(self) -> None:
        """Go on from the point found, to the finest tolerance."""
        if self.x is not None and len(self.x):
            self.tolerance, self.rounds, self.damping, self.done = NO_GAIN, 0, min(self.damping, 1e-3), False
            self.propose()

    @property
    def flatness(self) -> float:
        """Slope in units of loss and curvature; near zero at a minimum."""
        if self.x is None or not len(self.x) or self.loss == 0:
            return 0.0
        weight = np.sqrt(np.maximum(np.diag(self.curvature), 1e-300) * max(abs(self.loss), 1e-300))
        return float(np.abs(self.slope / weight).max())


def of_squares(products: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of squares, its half slope and curvature from the cross-products of the errors of `around(x)`."""
    plus, minus = products[1::2], products[2::2]
    curvature = (plus[:, 1::2] - plus[:, 2::2] - minus[:, 1::2] + minus[:, 2::2]) / (4 * STEP * STEP)
    return float(products[0, 0]), (plus[:, 0] - minus[:, 0]) / (2 * STEP), curvature


def scaled(products: np.ndarray, logs: np.ndarray, n: int) -> np.ndarray:
    """Cross-products whose diagonal is minimal where the likelihood is largest."""
    g = np.exp(logs / (2 * n))
    return products * np.outer(g, g)


def likelihood(loss: float, log0: float, n: int, k: int, unit: float) -> tuple[float, float, float, float]:
    """sigma^2, log-likelihood, AIC and BIC; `loss` is a scaled sum of squares of values in units of `unit`."""
    variance = max(loss * math.exp(-log0 / n) / n, 1e-300)
    log = -0.5 * (n * (math.log(2 * math.pi * variance) + 1) + log0) - n * math.log(unit)
    return variance * unit * unit, log, -2 * log + 2 * (k + 1), -2 * log + math.log(n) * (k + 1)


def better(a: tuple | None, b: tuple | None) -> bool:
    """Whether fit a = (aic, ...) beats b."""
    return a is not None and (b is None or a[0] < b[0] - 1e-9)


FIT = ("p int, d int, q int, sp int, sd int, sq int, period int, n long, mean double, ar array<double>, ma array<double>, seasonal_ar array<double>, seasonal_ma array<double>, "
       "sigma2 double, log_likelihood double, aic double, bic double, flatness double, tail array<double>, shocks array<double>")


def fit_row(model: Model, at: Descent, n: int, center: float, unit: float, tail: np.ndarray, shocks: np.ndarray) -> tuple:
    sigma2, log, aic, bic = likelihood(at.loss, at.kept["log0"], n, model.k, unit)
    ar, sar, ma, sma, mean = (v[0] for v in model.parts(at.x[None, :]))
    mean = float(center + unit * mean) if model.mean else 0.0
    return (aic, *model.order, n, mean, ar.tolist(), ma.tolist(), sar.tolist(), sma.tolist(), sigma2, log, aic, bic, at.flatness, [float(v) for v in tail], [float(v) for v in shocks])


def fit_series(y: np.ndarray, models: Sequence[Model]) -> tuple | None:
    """The best model of one series that fits in memory, as a FIT row with its AIC in front."""
    burn = max(m.depth for m in models)  # all orders explain the same values
    best = None
    for model in models:
        w = np.convolve(y, differencing(*(model.order[i] for i in (1, 4, 6))))[model.depth : len(y)][burn - model.depth :]
        n = len(w)
        if n < model.k + 2 or n <= max(model.reach):
            continue
        center = float(w.mean()) if model.mean else 0.0
        unit = float(np.sqrt(np.mean((w - center) ** 2))) or 1.0
        z = (w - center) / unit

        def descend(at: Descent, model: Model = model, z: np.ndarray = z, n: int = n, unit: float = unit) -> None:
            while not at.done:
                phi, theta, mean = model.full(around(at.trial))
                errors, logs = first_errors(z[None, :] - mean[:, None], phi, theta)
                at.take(*of_squares(scaled(errors @ errors.T, logs, n)), log0=float(logs[0]), shocks=unit * errors[0, ::-1][: model.reach[1]])

        descents = [Descent(start, tolerance=LITTLE_GAIN) for start in model.starts()]
        for at in descents:
            descend(at)
        at = min(descents, key=lambda d: d.loss)
        if at.x is None:
            continue
        found = (likelihood(at.loss, at.kept["log0"], n, model.k, unit)[2], model, at, n, center, unit, descend)
        best = found if better(found, best) else best
    if best is None:
        return None
    _, model, at, n, center, unit, descend = best
    at.refine()
    descend(at)
    return fit_row(model, at, n, center, unit, y[::-1][: model.reach[0] + model.depth], at.kept["shocks"])


# ---------------------------------------------------------------- series in blocks

def _block_products(z: np.ndarray, model: Model, trial: np.ndarray, first: bool, lead: int) -> dict:
    """What a block tells of the errors around a trial: `z` has `lead` values of the block before in front.

    Columns are, for each point, its errors from empty history and, behind the first block, its responses to history; `gram` holds
    their cross-products, `ends` their last errors, the newest first."""
    phi, theta, mean = model.full(around(trial))
    p, q = model.reach
    m = len(phi)
    w = z[None, :] - mean[:, None]
    if first:
        errors, logs = first_errors(w, phi, theta)
        columns = errors[:, None, :]
    else:
        logs = np.zeros(m)
        own = run_errors(filtered(w[:, lead - p :], phi), theta, np.zeros((m, q)))
        units = np.repeat(theta, q, axis=0)
        size = own.shape[1]
        back = run_errors(np.zeros((m * q, size)), units, np.tile(np.eye(q), (m, 1))).reshape(m, q, size)
        columns = np.concatenate([own[:, None, :], back], axis=1)
    flat = columns.reshape(-1, columns.shape[2])
    return {"gram": (flat @ flat.T).ravel().tolist(), "ends": columns[:, :, ::-1][:, :, :q].ravel().tolist(), "logs": logs.tolist()}


def _chained(blocks: pd.DataFrame, m: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-products of the errors over all blocks of a series, log variances, and the last errors, from the blocks' summaries in order."""
    products, logs, history = np.zeros((m, m)), np.zeros(m), np.zeros((m, q))
    for b in blocks.sort_values("blk").itertuples(index=False):
        columns = 1 if b.blk == 0 else 1 + q
        weight = np.ones((m, columns))
        if columns > 1:
            weight[:, 1:] = history
        gram = np.asarray(b.gram, float).reshape(m, columns, m, columns)
        products += np.einsum("ia,iajb,jb->ij", weight, gram, weight)
        logs += np.asarray(b.logs, float)
        history = np.einsum("ia,iaq->iq", weight, np.asarray(b.ends, float).reshape(m, columns, q))
    return products, logs, history


def _fit_in_blocks(df: DataFrame, value: str, order: Sequence[str], by: list[str], models: list[Model], block: int, kinds: str, **kw) -> DataFrame:
    """FIT rows of series that are longer than a block: a pass over the data for each round of the descents of all orders and starts."""
    burn = max(m.depth for m in models)
    lead = max(m.reach[0] for m in models)
    if block <= max(lead, max(m.reach[1] for m in models)) + 16:
        raise ValueError("a block must be longer than the orders reach")
    forms = sorted({(m.order[1], m.order[4], m.order[6] if m.order[4] else 0) for m in models})
    work = df.where(as_col(value).isNotNull()).withColumn("__y", as_col(value).cast("double"))

    def differences(w) -> dict:
        out = {}
        for j, (d, D, s) in enumerate(forms):
            out[f"__w{j}"] = sum((F.lit(float(c)) * (F.lag("__y", i).over(w) if i else F.col("__y")) for i, c in enumerate(differencing(d, D, s)) if c), F.lit(0.0))
        return out

    placed = with_position(over_order(work, order, differences, by, before=burn, **kw) if burn else work.withColumn("__w0", F.col("__y")), order, by, "__i", **kw)
    keys = [f"`{b}`" for b in by]
    names = [f"__w{j}" for j in range(len(forms))]
    rows = placed.where(F.col("__i") >= burn).select(*keys, (F.col("__i") - burn).alias("i"), F.col("__y").alias("y"), *names)
    stats = saved(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"a{c}") for c in names], *[F.avg(F.col(c) * F.col(c)).alias(f"s{c}") for c in names]), "series_scale")
    # a block also has the last values of the one before; the last block takes a short rest
    last = F.greatest(F.floor(F.col("n") / block) - 1, F.lit(0))
    wide = (join_null_safe(rows, stats.select(*keys, "n"), by) if by else rows.crossJoin(F.broadcast(stats.select("n"))))
    home = F.least(F.floor(F.col("i") / block), last)
    ahead = F.least(F.floor((F.col("i") + lead) / block), last)
    spread = saved(wide.select(*keys, "i", "y", *names, F.explode(F.sequence(home.cast("long"), ahead.cast("long"))).alias("blk"), home.cast("long").alias("home")), "series_blocks")

    problems = [(j, start) for j, m in enumerate(models) for start in m.starts()]
    form_of = [forms.index((m.order[1], m.order[4], m.order[6] if m.order[4] else 0)) for m in models]

    def scale(model: Model, r) -> tuple[float, float]:
        j = form_of[models.index(model)]
        center = float(r[f"a__w{j}"]) if model.mean else 0.0
        return center, math.sqrt(max(float(r[f"s__w{j}"]) - center * center, 0.0)) or 1.0

    state_kind = kinds + "n long, center array<double>, unit array<double>, state binary, open boolean, result binary"
    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                sizes = [scale(models[j], r) for j, _ in problems]
                states = [Descent(start, tolerance=1e-10, done=r["n"] < models[j].k + 2 or r["n"] <= max(models[j].reach)) for j, start in problems]
                out.append((*(r[b] for b in by), r["n"], [c for c, _ in sizes], [u for _, u in sizes], pickle.dumps(states), True, None))
            yield pd.DataFrame(out, columns=[*by, "n", "center", "unit", "state", "open", "result"])

    states = saved(stats.mapInPandas(opened, state_kind), "descents")

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        held = pickle.loads(pdf["state"].iloc[0])
        front = int((pdf["home"] < pdf["blk"]).sum())
        blk, out = int(pdf["blk"].iloc[0]), []
        for k, ((j, _), at) in enumerate(zip(problems, held)):
            if not at.done:
                z = (pdf[f"__w{form_of[j]}"].to_numpy(float) - pdf["center"].iloc[0][k]) / pdf["unit"].iloc[0][k]
                out.append((*(pdf[b].iloc[0] for b in by), blk, k, _block_products(z, models[j], at.trial, blk == 0, front)))
        return pd.DataFrame([(*r[:-1], r[-1]["gram"], r[-1]["ends"], r[-1]["logs"]) for r in out], columns=[*by, "blk", "problem", "gram", "ends", "logs"])

    def advance(key, told: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        row = held.iloc[0]
        descents = pickle.loads(row["state"])
        for k, blocks in told.groupby("problem"):
            model = models[problems[int(k)][0]]
            products, logs, history = _chained(blocks, 2 * model.k + 1, model.reach[1])
            descents[int(k)].take(*of_squares(scaled(products, logs, int(row["n"]))), log0=float(logs[0]), shocks=row["unit"][int(k)] * history[0])
        out = held.iloc[:1].copy()
        out["state"], out["open"] = [pickle.dumps(descents)], any(not d.done for d in descents)
        return out

    told_kind = kinds + "blk long, problem int, gram array<double>, ends array<double>, logs array<double>"
    while True:
        live = states.where("open")
        if live.isEmpty():
            break
        both = join_null_safe(spread, live.drop("open", "result", "n"), by, "inner") if by else spread.crossJoin(F.broadcast(live.drop("open", "result", "n")))
        told = both.groupBy(*keys, "blk").applyInPandas(evaluate, told_kind)
        group = keys or [F.lit("")]
        moved = told.groupBy(*group).cogroup(live.groupBy(*group)).applyInPandas(advance, state_kind)
        states = saved(moved.unionByName(states.where("NOT open")), "descents")

    depth = max(m.reach[0] + m.depth for m in models)
    numbered = placed.select(*keys, "__i", "__y")
    sizes = stats.select(*keys, (F.col("n") + burn).alias("__n"))
    late = join_null_safe(numbered, sizes, by) if by else numbered.crossJoin(F.broadcast(sizes))
    tails = late.where(F.col("__i") >= F.col("__n") - depth).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(-F.col("__i"), "__y"))).alias("tail"))  # `depth` values a series
    ends = join_null_safe(states, tails, by) if by else states.crossJoin(F.broadcast(tails))

    def closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                best, tail = None, np.array([t["__y"] for t in r["tail"]], float)
                for k, ((j, _), at) in enumerate(zip(problems, pickle.loads(r["state"]))):
                    if at.x is not None:
                        m = models[j]
                        found = fit_row(m, at, int(r["n"]), r["center"][k], r["unit"][k], tail[: m.reach[0] + m.depth], at.kept["shocks"])
                        best = found if better(found, best) else best
                if best:
                    out.append((*(r[b] for b in by), *best[1:]))
            yield pd.DataFrame(out, columns=_names(by))

    return ends.select(*keys, "n", "center", "unit", "state", F.transform("tail", lambda t: F.struct(t["__y"].alias("__y"))).alias("tail")).mapInPandas(closed, kinds + FIT)


def _names(by: Sequence[str]) -> list[str]:
    return [*by, *[c.strip().split(" ")[0] for c in FIT.split(", ")]]


def arima_fit(df: DataFrame, value: str, order: Sequence[str], orders: Sequence[Order] | None = None, by: Sequence[str] = (), mean: bool = True, block: int = BLOCK, **kw) -> DataFrame:
    """The model of least AIC for each series: orders, coefficients, error variance, likelihood, and what forecasts start from.

    `orders` are (p, d, q, P, D, Q, s); all are compared on the values that the deepest differencing leaves. A mean is fitted
    where nothing is differenced, unless `mean` is false. Stationary and invertible by construction. `flatness` is the scaled slope at the
    result. Null values are left out; series too short for every order have no row. Coefficients follow y_t = ar y_(t-1) + e_t + ma e_(t-1).

    Series of more than `block` values are cut; behind the first block error variances count as settled, which holds to about 1e-11
    for 50,000 values at any parameters allowed here, and for much smaller blocks where no root is near the unit circle.
    """
    by = list(by)
    models = [Model(tuple(o), mean) for o in (orders if orders is not None else candidate_orders())]
    kinds = _typed(df, by)
    if largest_series(df, by) > block:
        return _fit_in_blocks(df, value, order, by, models, block, kinds, **kw)
    rows = df.where(as_col(value).isNotNull()).select(*_keys(by), F.struct(*[as_col(o) for o in order]).alias("__at"), as_col(value).cast("double").alias("__y"))
    # at most `block` values a series
    whole = rows.groupBy(*_keys(by)).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__y"))), lambda r: r["__y"]).alias("__ys"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                best = fit_series(np.asarray(r["__ys"], float), models)
                if best:
                    out.append((*(r[b] for b in by), *best[1:]))
            yield pd.DataFrame(out, columns=_names(by))

    return (whole.repartition(*_keys(by)) if by else whole).mapInPandas(run, kinds + FIT)


def arima_forecast(df: DataFrame, value: str, order: Sequence[str], horizon: int, orders: Sequence[Order] | None = None, by: Sequence[str] = (), **kw) -> DataFrame:
    """`step, forecast, low, high` with 95 % limits from the model of least AIC of each series, beside its `aic`."""
    by = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                s = int(r["period"])
                ar, ma = (product(np.array([r[a]], float).reshape(1, -1), np.array([r[b]], float).reshape(1, -1), s, sign)[0]
                          for a, b, sign in (("ar", "seasonal_ar", -1.0), ("ma", "seasonal_ma", 1.0)))
                whole = -np.convolve(np.concatenate([[1.0], -ar]), differencing(int(r["d"]), int(r["sd"]), s))[1:]
                values = [v - r["mean"] for v in r["tail"]][::-1]
                shocks = r["shocks"]  # the newest first
                psi = np.zeros(horizon)
                for h in range(horizon):
                    # errors after the end are zero
                    y = sum(c * values[-1 - i] for i, c in enumerate(whole)) + sum(c * shocks[j - h] for j, c in enumerate(ma) if j >= h)
                    values.append(y)
                    psi[h] = 1.0 if h == 0 else (ma[h - 1] if h <= len(ma) else 0.0) + sum(c * psi[h - 1 - i] for i, c in enumerate(whole) if i < h)
                half = 1.959963984540054 * np.sqrt(r["sigma2"] * np.cumsum(psi * psi))
                for h, y in enumerate(values[-horizon:] if horizon else []):
                    out.append((*(r[b] for b in by), h + 1, y + r["mean"], y + r["mean"] - half[h], y + r["mean"] + half[h], r["aic"]))
            yield pd.DataFrame(out, columns=[*by, "step", "forecast", "low", "high", "aic"])

    return arima_fit(df, value, order, orders, by, **kw).mapInPandas(run, _typed(df, by) + "step int, forecast double, low double, high double, aic double")
