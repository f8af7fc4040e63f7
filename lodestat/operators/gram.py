"""Cross-product aggregates and the least-squares algebra built on them.

One map-side-combined aggregate yields n, means and centred cross-products; only
that k x k block reaches the driver. Sums use the merge-stable covariance
aggregates, so no second pass is needed for centring.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col

WIDE = 32  # more columns than this are multiplied as matrices in the tasks, as an aggregate a pair would be thousands of them
BRANCHES = 16  # partial blocks of a wide one that reach the driver


@dataclass
class Gram:
    names: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray  # centred sums of products

    def sub(self, names: Sequence[str]) -> "Gram":
        at = [self.names.index(v) for v in names]
        return Gram(list(names), self.n, self.mean[at], self.cross[np.ix_(at, at)])

    @property
    def cov(self) -> np.ndarray:
        return self.cross / max(self.n - 1, 1)

    @property
    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.cross))
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.cross / np.outer(sd, sd)

    def raw(self) -> np.ndarray:
        """Uncentred cross-products with a leading constant."""
        m = np.concatenate([[1.0], self.mean])
        out = self.n * np.outer(m, m)
        out[1:, 1:] += self.cross
        return out


def gram_exprs(names: Sequence[str]) -> list[Column]:
    """Aggregates over complete rows of `names`, named by index."""
    k = len(names)
    v = [as_col(c).cast("double") for c in names]
    out = [F.count(F.lit(1)).alias("n")] + [F.avg(v[i]).alias(f"m{i}") for i in range(k)]
    return out + [F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]


def gram_of_row(row, names: Sequence[str]) -> Gram:
    k, n = len(names), float(row["n"] or 0)
    cross = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cross[i, j] = cross[j, i] = (row[f"c{i}_{j}"] or 0.0) * n
    return Gram(list(names), n, np.array([row[f"m{i}"] or 0.0 for i in range(k)]), cross)


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        v = as_col(c).cast("double")
        cond = cond & v.isNotNull() & ~F.isnan(v)
    return df.where(cond)


def gram(df: DataFrame, cols: Sequence[str]) -> Gram:
    cols = list(dict.fromkeys(cols))
    if len(cols) > WIDE:
        return wide_gram(df, cols)
    return gram_of_row(complete(df, cols).agg(*gram_exprs(cols)).first(), cols)


def merge_blocks(blocks: Iterable[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred cross-products) of the rows of several such blocks."""
    def merge(a, b):
        n = a[0] + b[0]
        if not b[0] or not a[0]:
            return a if a[0] else b
        d = b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    return reduce(merge, blocks, (0, np.zeros(k), np.zeros((k, k))))


def wide_gram(df: DataFrame, cols: Sequence[str]) -> Gram:
    """The block of many columns: a matrix product for each Arrow batch, merged in the task and then in BRANCHES branches."""
    k = len(cols)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, cross = merge_blocks((block_of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])) for b in batches), k)
        branch = TaskContext.get().partitionId() % BRANCHES
        yield pa.RecordBatch.from_pydict({"branch": pa.array([branch], pa.int32()), "n": [n], "mean": [mean.tobytes()], "block": [cross.tobytes()]})

    parts = df.select(*[as_col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).mapInArrow(multiply, BLOCK)
    return merged(parts, cols)


BLOCK = "branch int, n long, mean binary, block binary"


def block_of(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred cross-products) of the complete rows of x."""
    x = x[~np.isnan(x).any(axis=1)]
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    return len(x), mean, (x - mean).T @ (x - mean)


def merged(parts: DataFrame, cols: Sequence[str]) -> Gram:
    """One block from those of tasks (BLOCK), which are put together in branches first."""
    k = len(cols)

    def unpack(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return ((n, np.frombuffer(m), np.frombuffer(c).reshape(k, k)) for n, m, c in zip(rows["n"], rows["mean"], rows["block"]))

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        n, mean, cross = merge_blocks(unpack(rows), k)
        return pd.DataFrame({"branch": rows["branch"][:1], "n": [n], "mean": [mean.tobytes()], "block": [cross.tobytes()]})

    got = parts.groupBy("branch").applyInPandas(together, BLOCK).orderBy("branch").toPandas()
    n, mean, cross = merge_blocks(unpack(got), k)
    return Gram(list(cols), float(n), mean, cross)


def gram_by(df: DataFrame, cols: Sequence[str], by: str) -> list[tuple[object, Gram]]:
    """Per-level blocks for a factor whose levels the caller knows to be few."""
    cols = list(dict.fromkeys(cols))
    rows = complete(df, cols).groupBy(as_col(by).alias("__g")).agg(*gram_exprs(cols)).collect()
    return sorted(((r["__g"], gram_of_row(r, cols)) for r in rows), key=lambda t: str(t[0]))


@dataclass
class Fit:
    names: list[str]      # intercept first
    coef: np.ndarray
    inv: np.ndarray       # (X'X)^-1 with intercept
    rss: float
    tss: float
    n: float
    rank: int

    @property
    def df_resid(self) -> float:
        return self.n - self.rank

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_resid if self.df_resid > 0 else float("nan")

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.inv) * self.sigma2, 0))

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else float("nan")

    def predict(self) -> Column:
        """Fitted value as a Column expression."""
        out = F.lit(float(self.coef[0]))
        for name, b in zip(self.names[1:], self.coef[1:]):
            out = out + F.lit(float(b)) * as_col(name).cast("double")
        return out


def ols(g: Gram, y: str, xs: Sequence[str]) -> Fit:
    """Least squares with intercept from the centred block; pseudo-inverse on rank loss."""
    xs = list(xs)
    block = g.sub([*xs, y])
    k = len(xs)
    sxx, sxy, syy = block.cross[:k, :k], block.cross[:k, k], block.cross[k, k]
    scale = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
    if k:
        unit = sxx / np.outer(scale, scale)
        rank = int(np.linalg.matrix_rank(unit, tol=1e-10))
        inv = np.linalg.pinv(unit, rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    else:
        rank, inv = 0, np.zeros((0, 0))
    slope = inv @ sxy
    xbar, ybar = block.mean[:k], block.mean[k]
    full = np.zeros((k + 1, k + 1))
    full[1:, 1:] = inv
    full[0, 1:] = full[1:, 0] = -inv @ xbar
    full[0, 0] = 1.0 / block.n + xbar @ inv @ xbar if block.n else float("nan")
    rss = float(max(syy - slope @ sxy, 0.0))
    return Fit(["const", *xs], np.concatenate([[ybar - slope @ xbar], slope]), full, rss, float(syy), block.n, rank + 1)


def weighted_sums(df: DataFrame, design: Sequence[Column], weight: Column, score: Column,
                  extra: Sequence[Column] = ()) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(sum w x x', sum score x, extra sums) in one aggregate; the step of every iterative fit."""
    k = len(design)
    named = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(design)],
                      weight.cast("double").alias("w"), score.cast("double").alias("z"),
                      *[c.cast("double").alias(f"e{i}") for i, c in enumerate(extra)])
    aggs = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}")
            for i in range(k) for j in range(i, k)]
    aggs += [F.sum(F.col(f"x{i}") * F.col("z")).alias(f"b{i}") for i in range(k)]
    aggs += [F.sum(f"e{i}").alias(f"s{i}") for i in range(len(extra))]
    row = named.agg(*aggs).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(k)]), [row[f"s{i}"] or 0.0 for i in range(len(extra))]


def dot(coef: Sequence[float], cols: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for b, c in zip(coef, cols):
        out = out + F.lit(float(b)) * c
    return out


def standardised(g: Gram, xs: Sequence[str]) -> tuple[list[Column], np.ndarray, np.ndarray]:
    """Constant plus centred, unit-variance columns, with the means and scales used."""
    block = g.sub(list(xs))
    sd = np.sqrt(np.diag(block.cross) / max(block.n, 1))
    sd = np.where(sd > 0, sd, 1.0)
    cols = [F.lit(1.0)] + [(as_col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(xs, block.mean, sd)]
    return cols, block.mean, sd


def unstandardise(beta: np.ndarray, cov: np.ndarray | None, mean: np.ndarray, sd: np.ndarray):
    """Coefficients (and covariance) back on the original scale."""
    k = len(mean)
    back = np.zeros((k + 1, k + 1))
    back[0, 0] = 1.0
    back[0, 1:] = -mean / sd
    back[1:, 1:] = np.diag(1.0 / sd)
    return back @ beta, None if cov is None else back @ cov @ back.T
