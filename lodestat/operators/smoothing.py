"""Exponential smoothing and conditional volatility with parameters by descent, each series its own.

A recursion is run for a point of the parameters and its neighbours on both sides together, for all series of one length in a batch side by
side; differences give slope and curvature, and `Descent` moves the point. Series of more than `block` values are cut: every
block is run from a guess of its starting state, its end is the next block's next guess, and a trial counts once no guess moves any
more. The recursions forget their start, so that takes a pass or two, and never more than there are blocks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, join_null_safe
from lodestat.operators.arima import STEP, Descent, around, of_squares, run_errors
from lodestat.operators.forecast import BLOCK, _keys, _typed
from lodestat.operators.ordering import largest_series, with_position
from lodestat.session import saved

SETTLED = 1e-9  # relative change of a block's start that counts as none
BATCH = 4_000_000  # values run side by side
PASS_GAIN = 1e-9  # of the loss, below which a further pass over a series in blocks is not made


def unit(x: np.ndarray) -> np.ndarray:
    """Any number to one between 0 and 1."""
    return 0.5 * (1 + x / np.sqrt(1 + x * x))


def from_unit(u: float) -> float:
    v = 2 * u - 1
    return v / math.sqrt(1 - v * v)


class Smoothing:
    """Level, with a trend and seasons if wanted; seasons are added or multiply. The loss is the sum of squared one-step errors.

    In a state the seasons stand by phase. Their start comes from the first two periods, as means and a slope between them."""

    def __init__(self, period: int = 1, trend: bool = True, multiplicative: bool = False):
        self.p, self.trend, self.multiplicative = (period if period > 1 else 0), trend, multiplicative and period > 1
        self.d, self.k = 2 + self.p, 1 + trend + (self.p > 0)
        self.head = max(2 * self.p, 2)
        grids = [(0.1, 0.3, 0.5, 0.8), *([(0.01, 0.1, 0.3)] if trend else []), *([(0.05, 0.2, 0.4)] if self.p else [])]
        self.grid = np.array(np.meshgrid(*[[from_unit(u) for u in g] for g in grids], indexing="ij")).reshape(self.k, -1).T

    def enough(self, n: int) -> bool:
        return n >= self.head

    def weights(self, x: np.ndarray) -> list[np.ndarray]:
        u = unit(x)
        return [u[..., 0], u[..., 1] if self.trend else np.zeros(u.shape[:-1]), u[..., -1] if self.p else np.zeros(u.shape[:-1])]

    def start(self, head: np.ndarray, scale: np.ndarray) -> np.ndarray:
        p, y = max(self.p, 1), head
        if not self.trend and not self.p:
            return np.array([y[0], 0.0])
        a, b = y[:p].mean(), y[p : 2 * p].mean()
        slope = (b - a) / p if self.trend else 0.0
        if not self.p:
            return np.array([a - slope, slope])
        t = np.arange(2 * p)
        line = a - slope * (p - 1) / 2 + slope * t if self.trend else np.full(2 * p, (a + b) / 2)
        seasons = (y / line if self.multiplicative else y - line).reshape(2, p).mean(axis=0)
        seasons = seasons / seasons.mean() if self.multiplicative else seasons - seasons.mean()
        return np.concatenate([[line[0] - slope, slope], seasons])

    def run(self, y: np.ndarray, x: np.ndarray, state: np.ndarray, scale: np.ndarray, phase: int) -> tuple[np.ndarray, np.ndarray]:
        """Errors (b, m, n) and end states (b, m, d) of series y (b, n) at parameters x (b, m, k) from `state`."""
        alpha, beta, gamma = self.weights(x)
        pull, turn = alpha * beta, gamma * (1 - alpha)
        level, slope = state[..., 0].copy(), state[..., 1].copy()
        seasons = [state[..., 2 + i].copy() for i in range(self.p)]
        errors = np.empty((y.shape[1], *level.shape))
        for t in range(y.shape[1]):
            base = level + slope
            if not self.p:
                e = y[:, t, None] - base
                level, slope = base + alpha * e, slope + pull * e
            else:
                at = (phase + t) % self.p
                s = seasons[at]
                if self.multiplicative:
                    e = y[:, t, None] - base * s
                    level, slope, seasons[at] = base + alpha * e / s, slope + pull * e / s, s + turn * e / base
                else:
                    e = y[:, t, None] - base - s
                    level, slope, seasons[at] = base + alpha * e, slope + pull * e, s + turn * e
            errors[t] = e
        return errors.transpose(1, 2, 0), np.stack([level, slope, *seasons], axis=-1)

    def told(self, errors: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return of_squares(errors @ errors.T)

    def losses(self, errors: np.ndarray) -> np.ndarray:
        return np.einsum("mn,mn->m", errors, errors)


class Volatility:
    """Variance h' = omega + alpha e^2 + beta h of errors e around a constant mean; the loss is minus the Gaussian log-likelihood.

    Values count in units of their deviation; parameters are the mean, log omega, alpha + beta and alpha's share of it."""

    d, k, head = 1, 4, 2

    def __init__(self):
        self.grid = np.array([[0.0, math.log(1 - s), from_unit(s / LARGEST_SUM), from_unit(a)] for s in (0.5, 0.9, 0.97) for a in (0.05, 0.15, 0.4)])

    def enough(self, n: int) -> bool:
        return n >= 8

    def start(self, head: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return np.ones(1)

    def natural(self, x: np.ndarray) -> list[np.ndarray]:
        total = LARGEST_SUM * unit(x[..., 2])
        alpha = total * unit(x[..., 3])
        return [x[..., 0], np.exp(np.clip(x[..., 1], -60, 60)), alpha, total - alpha]

    def run(self, y: np.ndarray, x: np.ndarray, state: np.ndarray, scale: np.ndarray, phase: int) -> tuple[np.ndarray, np.ndarray]:
        mean, omega, alpha, beta = self.natural(x)
        b, m = mean.shape
        z = (y - scale[:, :1]) / scale[:, 1:2]
        e = (z[:, None, :] - mean[..., None]).reshape(b * m, -1)
        push = omega.reshape(-1, 1) + alpha.reshape(-1, 1) * e * e
        h = run_errors(push, -beta.reshape(-1, 1), state.reshape(-1, 1))  # the variance behind each value
        before = np.concatenate([state.reshape(-1, 1), h[:, :-1]], axis=1)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            loss = 0.5 * (math.log(2 * math.pi) + np.log(before) + e * e / before)
        return loss.reshape(b, m, -1), h[:, -1].reshape(b, m, 1)

    def told(self, losses: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Scores by differences, their sum, and their cross-products as curvature."""
        scores = (losses[1::2] - losses[2::2]) / (2 * STEP)
        return float(losses[0].sum()), scores.sum(axis=1), scores @ scores.T

    def losses(self, losses: np.ndarray) -> np.ndarray:
        return losses.sum(axis=1)


LARGEST_SUM = 0.9999
FOUND = "n long, parameters array<double>, loss double, state array<double>, flatness double, center double, unit double"
FOUND_NAMES = [c.split(" ")[0] for c in FOUND.split(", ")]


def _scales(y: np.ndarray) -> np.ndarray:
    """Mean and deviation of each row."""
    return np.stack([y.mean(axis=1), np.sqrt(y.var(axis=1))], axis=1)


def fit_batch(kernel, y: np.ndarray) -> list[Descent]:
    """The descents of series of one length, side by side, each from the best point of a grid."""
    scale = _scales(y)
    scale[scale[:, 1] == 0, 1] = 1.0
    starts = np.stack([kernel.start(row[: kernel.head], s) for row, s in zip(y, scale)])

    def filtered(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = np.repeat(starts[rows][:, None, :], x.shape[1], axis=1)
        return kernel.run(y[rows], x, state, scale[rows], 0)

    points = np.tile(kernel.grid, (len(y), 1, 1))
    first, _ = filtered(np.arange(len(y)), points)
    descents = []
    for values in first:
        losses = kernel.losses(values)
        descents.append(Descent(kernel.grid[int(np.where(np.isfinite(losses), losses, np.inf).argmin())]))
    while True:
        live = np.array([i for i, d in enumerate(descents) if not d.done], np.int64)
        if not len(live):
            return descents
        values, ends = filtered(live, np.stack([around(descents[i].trial) for i in live]))
        for i, v, e in zip(live, values, ends):
            descents[i].take(*kernel.told(v), state=e[0].tolist())


def _found(kernel, d: Descent, n: int, scale: Sequence[float]) -> tuple:
    return (n, d.x.tolist(), d.loss, d.kept["state"], d.flatness, float(scale[0]), float(scale[1]))


def fit_recursion(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], kernel, block: int = BLOCK, **kw) -> DataFrame:
    """by…, n, parameters (as the kernel takes them), loss, state behind the last value, flatness of the loss, mean and deviation."""
    by = list(by)
    kinds = _typed(df, by)
    rows = df.where(as_col(value).isNotNull() & ~F.isnan(as_col(value).cast("double")))
    if largest_series(rows, by) > block:
        return _fit_in_blocks(rows, value, order, by, kernel, block, kinds, **kw)
    at = F.struct(F.struct(*[as_col(o) for o in order]).alias("__at"), as_col(value).cast("double").alias("__y"))
    whole = rows.groupBy(*_keys(by)).agg(F.transform(F.sort_array(F.collect_list(at)), lambda r: r["__y"]).alias("__ys"))  # at most `block` values a series

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, some in batch.groupby(batch["__ys"].map(len), sort=True):
                size = max(1, BATCH // (max(len(kernel.grid), 2 * kernel.k + 1) * max(n, 1)))
                for k in range(0, len(some) if kernel.enough(n) else 0, size):
                    part = some.iloc[k : k + size]
                    y = np.stack([np.asarray(v, float) for v in part["__ys"]])
                    found = zip(part.to_dict("records"), fit_batch(kernel, y), _scales(y))
                    out = [(*(r[b] for b in by), *_found(kernel, d, n, s)) for r, d, s in found if d.x is not None]
                    yield pd.DataFrame(out, columns=[*by, *FOUND_NAMES])

    return (whole.repartition(*_keys(by)) if by else whole).mapInPandas(run, kinds + FOUND)


def _fit_in_blocks(rows: DataFrame, value: str, order: Sequence[str], by: list[str], kernel, block: int, kinds: str, **kw) -> DataFrame:
    """The same for series in blocks: a pass over the data for each trial and each time the starts have moved."""
    if block < kernel.head:
        raise ValueError("a block must hold what the starting state is taken from")
    keys = _keys(by)
    placed = with_position(rows, order, by, "__i", **kw).select(*keys, "__i", as_col(value).cast("double").alias("__y"))
    packed = placed.groupBy(*keys, F.floor(F.col("__i") / block).alias("blk")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__i", "__y"))), lambda r: r["__y"]).alias("__ys"))  # at most `block` values
    data = saved(packed, "series_blocks")
    stats = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("center"), F.stddev_pop("__y").alias("unit"),
                                      F.transform(F.sort_array(F.collect_list(F.when(F.col("__i") < kernel.head, F.struct("__i", "__y")))), lambda r: r["__y"]).alias("head"))
    series_kind = kinds + "n long, center double, unit double, head array<double>, state binary, open boolean, again boolean"

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["state"] = [pickle.dumps(Descent(np.zeros(0), done=not kernel.enough(int(n)))) for n in batch["n"]]
            batch["open"], batch["again"] = [kernel.enough(int(n)) for n in batch["n"]], False
            yield batch

    states = saved(stats.mapInPandas(opened, series_kind), "descents")
    told_kind = kinds + "blk long, losses array<double>, slope array<double>, curvature array<double>, ends array<double>, begin array<double>"
    guesses, grid = None, True  # the first passes look at the grid
    while True:
        live = states.where("open")
        if live.isEmpty():
            break
        both = join_null_safe(data, live.select(*keys, "center", "unit", "head", "state"), by, "inner") if by else data.crossJoin(F.broadcast(live.select("center", "unit", "head", "state")))
        both = join_null_safe(both, guesses, [*by, "blk"]) if guesses is not None else both.withColumn("guess", F.lit(None).cast("array<double>"))

        def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.to_dict("records"):
                    d = pickle.loads(r["state"])
                    x = kernel.grid if grid else around(d.trial)
                    scale = np.array([[r["center"], r["unit"] or 1.0]])
                    first = kernel.start(np.asarray(r["head"], float), scale[0])
                    known = r["guess"] is not None and r["blk"] > 0
                    begin = np.asarray(r["guess"], float).reshape(-1, kernel.d) if known else np.tile(first, (len(x), 1))
                    if len(begin) != len(x):  # from the grid's pass to a descent's
                        begin = np.tile(begin[:1], (len(x), 1))
                    values, ends = kernel.run(np.asarray(r["__ys"], float)[None], x[None], begin[None], scale, int(r["blk"]) * block)
                    loss, slope, curvature = (0.0, np.zeros(0), np.zeros((0, 0))) if grid else kernel.told(values[0])
                    losses = kernel.losses(values[0]) if grid else np.array([loss])
                    out.append((*(r[b] for b in by), r["blk"], losses.tolist(), slope.tolist(), curvature.ravel().tolist(), ends[0].ravel().tolist(), begin.ravel().tolist()))
                yield pd.DataFrame(out, columns=[*by, "blk", "losses", "slope", "curvature", "ends", "begin"])

        told = saved(both.mapInPandas(evaluate, told_kind), "block_results")
        after = told.select(*keys, (F.col("blk") + 1).alias("blk"), F.col("ends").alias("guess"))
        change = F.array_max(F.zip_with("guess", "begin", lambda a, b: F.abs(a - b) / (F.abs(a) + F.abs(b) + 1e-300)))
        met = join_null_safe(told, after, [*by, "blk"])
        sums = met.select(*keys, "blk", "losses", "slope", "curvature", "ends", F.coalesce(F.when(F.col("blk") > 0, change), F.lit(0.0)).alias("moved"))
        group = keys or [F.lit("")]

        def advance(key, parts: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = held.iloc[:1].copy()
            if parts["moved"].max() > SETTLED:
                out["again"] = True
                return out
            d = pickle.loads(out["state"].iloc[0])
            losses = np.sum([np.asarray(v, float) for v in parts["losses"]], axis=0)
            if grid:
                d = Descent(kernel.grid[int(np.where(np.isfinite(losses), losses, np.inf).argmin())], tolerance=PASS_GAIN)
            else:
                slope = np.sum([np.asarray(v, float) for v in parts["slope"]], axis=0)
                curvature = np.sum([np.asarray(v, float) for v in parts["curvature"]], axis=0).reshape(kernel.k, kernel.k)
                end = np.asarray(parts.loc[parts["blk"].idxmax(), "ends"], float).reshape(-1, kernel.d)[0]
                d.take(float(losses[0]), slope, curvature, state=end.tolist())
            out["state"], out["open"], out["again"] = [pickle.dumps(d)], not d.done, False
            return out

        moved = sums.groupBy(*group).cogroup(live.groupBy(*group)).applyInPandas(advance, series_kind)
        states = saved(moved.unionByName(states.where("NOT open")), "descents")
        guesses = after
        grid = grid and not states.where("again").isEmpty()

    def closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                d = pickle.loads(r["state"])
                if d.x is not None:
                    out.append((*(r[b] for b in by), *_found(kernel, d, int(r["n"]), (r["center"], r["unit"]))))
            yield pd.DataFrame(out, columns=[*by, *FOUND_NAMES])

    return states.mapInPandas(closed, kinds + FOUND)


# ---------------------------------------------------------------- forecasts

def smoothing_fit(df: DataFrame, value: str, order: Sequence[str], period: int = 1, by: Sequence[str] = (), trend: bool = True, multiplicative: bool = False, **kw) -> DataFrame:
    """by…, n, alpha, beta, gamma, sse, flatness, and the state (level, slope, seasons by phase) behind the last value.

    Weights that the model lacks are null. Null values are left out; a series needs two values, and two periods with seasons.
    Multiplying seasons want positive values."""
    kernel = Smoothing(period, trend, multiplicative)
    u = F.transform("parameters", lambda x: (1 + x / F.sqrt(1 + x * x)) / 2)
    found = fit_recursion(df, value, order, by, kernel, **kw)
    none = F.lit(None).cast("double")
    return found.select(*_keys(by), "n", u[0].alias("alpha"), (u[1] if trend else none).alias("beta"), (u[kernel.k - 1] if kernel.p else none).alias("gamma"),
                        F.col("loss").alias("sse"), "flatness", "state")


def smoothing_forecast(df: DataFrame, value: str, order: Sequence[str], horizon: int, period: int = 1, by: Sequence[str] = (), trend: bool = True, multiplicative: bool = False, **kw) -> DataFrame:
    """`step, forecast` from the fitted smoothing of each series, beside its `sse` and `parameters` (alpha, beta, gamma)."""
    fits = smoothing_fit(df, value, order, period, by, trend, multiplicative, **kw)
    steps = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    line = F.element_at("state", 1) + F.col("step") * F.element_at("state", 2)
    if period > 1:
        season = F.element_at("state", (F.pmod(F.col("n") + F.col("step") - 1, F.lit(period)) + 3).cast("int"))
        line = line * season if multiplicative else line + season
    return steps.select(*_keys(by), F.col("step").cast("int").alias("step"), line.alias("forecast"), "sse", F.array("alpha", "beta", "gamma").alias("parameters"))


def garch_fit(df: DataFrame, ret: str, order: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """GARCH(1, 1) with a constant mean by maximum likelihood: mean, omega, alpha, beta, neg_log_likelihood, next and long-run volatility, flatness.

    The first variance is that of the series. Series without variation or with fewer than eight values have no row."""
    found = fit_recursion(df, ret, order, by, Volatility(), **kw).where("unit > 0")
    p, s = "parameters", F.col("unit")
    total = F.lit(LARGEST_SUM) * (1 + F.get(p, 2) / F.sqrt(1 + F.get(p, 2) * F.get(p, 2))) / 2
    share = (1 + F.get(p, 3) / F.sqrt(1 + F.get(p, 3) * F.get(p, 3))) / 2
    omega = F.exp(F.get(p, 1)) * s * s
    return found.select(*_keys(by), "n", (F.col("center") + s * F.get(p, 0)).alias("mean"), omega.alias("omega"), (total * share).alias("alpha"), (total * (1 - share)).alias("beta"),
                        (F.col("loss") + F.col("n") * F.log(s)).alias("neg_log_likelihood"), (F.sqrt(F.element_at("state", 1)) * s).alias("next_volatility"),
                        F.sqrt(omega / (1 - total)).alias("long_run_volatility"), "flatness")
