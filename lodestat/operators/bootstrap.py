"""Percentile bootstrap intervals over all rows.

Each row gets, for each replicate, a Poisson(1) count drawn from a hash of its key
and the replicate number, so answers do not depend on partitioning. Weighted sums
are formed inside each partition (rows x replicates never leave the task); what is
shuffled is one row of sums per partition and replicate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.dist import norm_ppf
from lodestat.functions.expr import local_rows, as_col
from lodestat.operators.gram import Gram, complete, gram, ols
from lodestat.operators.quantiles import exact_quantiles

_CUTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson_weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """rows x replicates counts from a 64-bit mix of (key, replicate, seed)."""
    with np.errstate(over="ignore"):
        salt = (np.arange(replicates, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = keys.astype(np.uint64)[:, None] ^ (salt + np.uint64(seed))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    u = (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_CUTS, u).astype(np.float64)


def replicate_sums(df: DataFrame, key: Sequence[str], terms: Sequence[Column], replicates: int, seed: int) -> np.ndarray:
    """Weighted sums per replicate: array (replicates, 1 + terms), first the sum of weights."""
    k = len(terms)
    work = df.select(F.xxhash64(*[as_col(c) for c in key]).alias("h"), *[t.cast("double").alias(f"t{i}") for i, t in enumerate(terms)])

    def partial(batches):
        total = np.zeros((replicates, k + 1))
        for pdf in batches:
            values = np.column_stack([np.ones(len(pdf)), *[pdf[f"t{i}"].to_numpy(float) for i in range(k)]])
            hashes = pdf["h"].to_numpy(np.int64)
            for at in range(0, len(pdf), 2048):
                total += poisson_weights(hashes[at:at + 2048], replicates, seed).T @ values[at:at + 2048]
        yield pd.DataFrame({"b": np.arange(replicates), **{f"s{i}": total[:, i] for i in range(k + 1)}})

    schema = "b long, " + ", ".join(f"s{i} double" for i in range(k + 1))
    rows = work.mapInPandas(partial, schema).groupBy("b").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k + 1)])
    table = rows.orderBy("b").toPandas()  # one row per replicate
    return table[[f"s{i}" for i in range(k + 1)]].to_numpy(float)


def _interval(values: np.ndarray, level: float) -> tuple[float, float, float]:
    good = values[np.isfinite(values)]
    a = (1 - level) / 2
    return float(np.quantile(good, a)), float(np.quantile(good, 1 - a)), float(np.std(good, ddof=1))


_SCHEMA = "statistic string, estimate double, ci_low double, ci_high double, std_error double"


def bootstrap_ci(df: DataFrame, col: str, key: Sequence[str], statistics: Sequence[str] = ("mean", "std"),
                 replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Intervals for mean, std and median.

    For the median the resampling distribution is known: the resampled median lies at
    or below the k-th smallest value with a binomial probability, so its interval is a
    pair of order statistics and no resampling is run.
    """
    v = as_col(col).cast("double")
    data = df.where(v.isNotNull())
    n, mean, sd = data.agg(F.count(v), F.avg(v), F.stddev_samp(v)).first()
    rows = []
    moments = [s for s in statistics if s != "median"]
    if moments:
        centred = v - F.lit(float(mean))
        sums = replicate_sums(data, key, [centred, centred * centred], replicates, seed)
        w, s1, s2 = sums.T
        means = s1 / w
        stds = np.sqrt(np.maximum(s2 / w - means ** 2, 0) * w / np.maximum(w - 1, 1))
        for s in moments:
            reps, est = (means + mean, mean) if s == "mean" else (stds, sd)
            rows.append((s, float(est), *_interval(reps, level)))
    if "median" in statistics:
        z = norm_ppf(0.5 + level / 2) * 0.5 / math.sqrt(n)
        med, lo, hi = exact_quantiles(data, [col], [0.5, max(0.0, 0.5 - z), min(1.0, 0.5 + z)])[col]
        rows.append(("median", med, lo, hi, (hi - lo) / (2 * norm_ppf(0.5 + level / 2))))
    return local_rows(df.sparkSession, rows, _SCHEMA)


def _replicate_grams(df: DataFrame, cols: Sequence[str], key: Sequence[str], replicates: int, seed: int) -> tuple[Gram, list[Gram]]:
    base = gram(df, cols)
    sd = np.sqrt(np.where(np.diag(base.cross) > 0, np.diag(base.cross), 1.0) / max(base.n, 1))
    z = [(as_col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(cols, base.mean, sd)]
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = replicate_sums(complete(df, cols), key, [*z, *[z[i] * z[j] for i, j in pairs]], replicates, seed)
    out = []
    for row in sums:
        w, m = row[0], row[1:k + 1] / row[0]
        cross = np.zeros((k, k))
        for (i, j), s in zip(pairs, row[k + 1:]):
            cross[i, j] = cross[j, i] = (s - w * m[i] * m[j]) * sd[i] * sd[j]
        out.append(Gram(list(cols), w, m * sd + base.mean, cross))
    return base, out


def bootstrap_correlations(df: DataFrame, cols: Sequence[str], key: Sequence[str], replicates: int = 500,
                           level: float = 0.95, seed: int = 42) -> DataFrame:
    base, reps = _replicate_grams(df, cols, key, replicates, seed)
    stack = np.array([g.corr for g in reps])
    rows = [(f"{a}~{b}", float(base.corr[i, j]), *_interval(stack[:, i, j], level))
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return local_rows(df.sparkSession, rows, _SCHEMA)


def bootstrap_regression(df: DataFrame, y: str, xs: Sequence[str], key: Sequence[str], replicates: int = 500,
                         level: float = 0.95, seed: int = 42) -> DataFrame:
    base, reps = _replicate_grams(df, [*xs, y], key, replicates, seed)
    fit = ols(base, y, xs)
    stack = np.array([ols(g, y, xs).coef for g in reps])
    rows = [(name, float(fit.coef[i]), *_interval(stack[:, i], level)) for i, name in enumerate(fit.names)]
    return local_rows(df.sparkSession, rows, _SCHEMA)


METRIC_TERMS: dict[str, Callable[[Column, Column], list[Column]]] = {
    "mae": lambda y, p: [F.abs(y - p)],
    "rmse": lambda y, p: [(y - p) * (y - p)],
    "r2": lambda y, p: [(y - p) * (y - p), y, y * y],
    "accuracy": lambda y, p: [(y == p).cast("double")],
}


def bootstrap_metric(df: DataFrame, y: str, predicted: str, metric: str, key: Sequence[str], replicates: int = 500,
                     level: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval for a metric of (actual, predicted)."""
    shift = df.agg(F.avg(as_col(y).cast("double"))).first()[0] if metric == "r2" else 0.0
    a, b = as_col(y).cast("double") - shift, as_col(predicted).cast("double") - shift
    terms = METRIC_TERMS[metric](a, b)
    data = df.where(a.isNotNull() & b.isNotNull())

    def value(s: np.ndarray) -> np.ndarray:
        w = s[:, 0]
        if metric in ("mae", "accuracy"):
            return s[:, 1] / w
        if metric == "rmse":
            return np.sqrt(s[:, 1] / w)
        return 1 - s[:, 1] / (s[:, 3] - s[:, 2] ** 2 / w)

    whole = data.agg(F.count(F.lit(1)), *[F.sum(t) for t in terms]).first()
    est = float(value(np.array([[float(v) for v in whole]]))[0])
    return local_rows(df.sparkSession, [(metric, est, *_interval(value(replicate_sums(data, key, terms, replicates, seed)), level))], _SCHEMA)


def bootstrap_pca(df: DataFrame, cols: Sequence[str], key: Sequence[str], axes: int = 2, replicates: int = 300,
                  level: float = 0.95, seed: int = 42) -> DataFrame:
    """Intervals of loadings, each replicate's axes sign-aligned with the full-data axes."""
    base, reps = _replicate_grams(df, cols, key, replicates, seed)

    def loadings(g: Gram) -> np.ndarray:
        vals, vecs = np.linalg.eigh(g.corr)
        at = np.argsort(vals)[::-1][:axes]
        return vecs[:, at] * np.sqrt(np.maximum(vals[at], 0))

    ref = loadings(base)
    stack = []
    for g in reps:
        load = loadings(g)
        stack.append(load * np.where((load * ref).sum(axis=0) < 0, -1.0, 1.0))
    stack = np.array(stack)
    rows = [(f"{c}@axis{a + 1}", float(ref[i, a]), *_interval(stack[:, i, a], level))
            for i, c in enumerate(cols) for a in range(axes)]
    return local_rows(df.sparkSession, rows, _SCHEMA)
