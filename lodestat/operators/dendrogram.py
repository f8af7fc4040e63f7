"""Agglomerative trees over mergeable summaries of rows: Ward, complete, average and single linkage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, local_rows
from lodestat.operators.gram import complete
from lodestat.session import cut_lineage

LINKAGES = ("ward", "complete", "average", "single")
BITS = 16  # halvings of each column's range in the finest grid
MOST_LEVELS = 48


def join_order(points: np.ndarray, weights: np.ndarray, linkage: str) -> np.ndarray:
    """All merges of weighted points as rows (left, right, height, weight), lowest first, by chains of nearest neighbours.

    Points are numbered 0, 1, ..., the cluster of merge i gets the number points + i. Ward's height is the square root of
    twice the growth of the sum of squares, so two single points merge at their distance.
    """
    m = len(points)
    gap = np.square(points[:, None, :] - points[None, :, :]).sum(axis=2)
    size = weights.astype(float).copy()
    if linkage == "ward":
        gap *= 2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :])
    else:
        gap = np.sqrt(gap)
    np.fill_diagonal(gap, np.inf)
    live, chain, merges = np.full(m, True), [], []
    while len(merges) < m - 1:
        if not chain:
            chain.append(int(np.argmax(live)))
        while True:
            a = chain[-1]
            b = int(np.argmin(gap[a]))
            if len(chain) > 1 and gap[a, chain[-2]] <= gap[a, b]:  # the one before, also in a tie, ends the chain
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        na, nb, old = size[a], size[b], gap[a, b]
        if linkage == "ward":
            new = ((na + size) * gap[a] + (nb + size) * gap[b] - size * old) / (na + nb + size)
        elif linkage == "average":
            new = (na * gap[a] + nb * gap[b]) / (na + nb)
        else:
            new = (np.minimum if linkage == "single" else np.maximum)(gap[a], gap[b])
        merges.append((a, b, old))
        live[b] = False
        new[~live] = np.inf
        new[a] = np.inf
        gap[a], gap[:, a] = new, new
        gap[b], gap[:, b] = np.inf, np.inf
        size[a] = na + nb
    out, name = [], {i: i for i in range(m)}
    top, total = list(range(m)), dict(enumerate(weights.astype(float)))
    for a, b, height in sorted(merges, key=lambda t: t[2]):
        x, y = sorted((name[_root(top, a)], name[_root(top, b)]))
        total[m + len(out)] = total[x] + total[y]
        top[_root(top, b)] = _root(top, a)
        name[_root(top, a)] = m + len(out)
        out.append((x, y, float(np.sqrt(max(height, 0.0))) if linkage == "ward" else float(height), total[x] + total[y]))
    return np.array(out, float).reshape(-1, 4)


def _root(top: list[int], i: int) -> int:
    while top[i] != i:
        top[i] = top[top[i]]
        i = top[i]
    return i


@dataclass
class Tree:
    """A merge table over summaries; `within` is the share of the sum of squares that lies inside the summaries."""

    cols: list[str]
    cells: DataFrame  # one row a summary: its key columns and `summary`
    keys: list[tuple[str, Column]]
    merges: np.ndarray
    sizes: np.ndarray
    within: float
    scale: np.ndarray
    mean: np.ndarray

    def table(self) -> DataFrame:
        """(step, lower, upper, height, rows): summaries have the numbers from 0, later clusters those after them."""
        return local_rows(self.cells.sparkSession, [(i, int(a), int(b), float(h), int(n)) for i, (a, b, h, n) in enumerate(self.merges)],
                          "step long, lower long, upper long, height double, rows long")

    def labels(self, k: int) -> np.ndarray:
        """The cluster of each summary with k clusters left; larger clusters have smaller numbers."""
        m = len(self.sizes)
        top = list(range(m + len(self.merges)))
        for i, (a, b, _, _) in enumerate(self.merges[: max(m - k, 0)]):
            top[int(a)] = top[int(b)] = m + i
        root = np.array([_root(top, i) for i in range(m)], int)
        rows = {r: (-self.sizes[root == r].sum(), int(np.argmax(root == r))) for r in set(root.tolist())}
        number = {r: i for i, r in enumerate(sorted(rows, key=rows.get))}
        return np.array([number[r] for r in root.tolist()], int)

    def cut(self, df: DataFrame, k: int) -> DataFrame:
        """The complete rows of `df` with `cluster`. The joined table has at most as many rows as there are summaries."""
        named = local_rows(df.sparkSession, list(enumerate(self.labels(k).tolist())), "summary int, cluster int")
        small = self.cells.join(F.broadcast(named), "summary").drop("summary")
        rows = complete(df, self.cols).withColumns(dict(self.keys))
        return rows.join(F.broadcast(small), [n for n, _ in self.keys]).drop(*[n for n, _ in self.keys])

    def cut_by_silhouette(self, df: DataFrame, ks: Sequence[int] = (2, 3, 4, 5, 6)) -> tuple[DataFrame, list[tuple[int, float]]]:
        """The cut of the largest silhouette over all rows, and the silhouette of each k."""
        scaled = F.array(*[(as_col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.cols, self.mean, self.scale)])
        tried = []
        for k in ks:
            if 2 <= k <= len(self.sizes):
                scored = self.cut(df, k).withColumn("__v", array_to_vector(scaled))
                tried.append((k, float(ClusteringEvaluator(featuresCol="__v", predictionCol="cluster").evaluate(scored))))
        if not tried:
            raise ValueError("no number of clusters gave two groups")
        return self.cut(df, max(tried, key=lambda t: (t[1], -t[0]))[0]), tried


def agglomerative(df: DataFrame, cols: Sequence[str], linkage: str = "ward", summaries: int = 1000, standardise: bool = True) -> Tree:
    """The tree of the complete rows of `df`, from the bottom up.

    With at most `summaries` different rows the tree is that of all rows, exactly, however often each is repeated. With more, rows are first
    folded into cells of the finest grid with at most so many filled cells; a cell keeps its count, means and inner sum of squares,
    which Spark adds up before any shuffle. Every row counts, and for Ward the heights of the tree and what lies inside the cells add up
    to the whole sum of squares. The grid halves the columns' ranges in turn, so that it also works in many columns. Only the
    summaries (at most `summaries` rows) reach the driver.

    Rows with a null, NaN or infinite value in `cols` are left out. An empty table has a tree without merges.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage is one of {', '.join(LINKAGES)}")
    if summaries < 2:
        raise ValueError("at least two summaries are needed")
    cols = list(cols)
    d = len(cols)
    v = [as_col(c).cast("double") for c in cols]
    finite = F.lit(True)
    for x in v:
        finite = finite & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = complete(df, cols).where(finite)
    ends = rows.agg(*[F.min(x).alias(f"lo{i}") for i, x in enumerate(v)], *[F.max(x).alias(f"hi{i}") for i, x in enumerate(v)]).first()
    exact = rows.select(*[x.alias(f"v{i}") for i, x in enumerate(v)]).distinct().limit(summaries + 1).count() <= summaries
    if exact:
        keys = [(f"__k{i}", x + F.lit(0.0)) for i, x in enumerate(v)]
    else:
        # minima and maxima do not depend on the order of rows, so a lost task finds the same cells again
        unit = [(x - F.lit(ends[f"lo{i}"])) / F.lit(max(ends[f"hi{i}"] - ends[f"lo{i}"], 5e-324)) for i, x in enumerate(v)]

        def grid(level: int) -> list[tuple[str, Column]]:
            return [(f"__k{i}", F.least(F.floor(u * float(2 ** ((level + d - 1 - i) // d))), F.lit(2 ** ((level + d - 1 - i) // d) - 1))) for i, u in enumerate(unit)]

        levels = range(1, min(BITS * d, MOST_LEVELS) + 1)
        about = rows.agg(*[F.approx_count_distinct(F.xxhash64(*[c for _, c in grid(n)]), 0.02).alias(f"n{n}") for n in levels]).first()
        level = max((n for n in levels if about[f"n{n}"] <= summaries), default=1)
        while rows.select(*[c.alias(n) for n, c in grid(level)]).distinct().limit(summaries + 1).count() > summaries:
            level -= 1  # the counts are estimates; level 1 has two cells at most
        keys = grid(level)
    names = [n for n, _ in keys]
    folded = cut_lineage(rows.withColumns(dict(keys)).groupBy(*names).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(x).alias(f"__m{i}") for i, x in enumerate(v)], *[F.var_pop(x).alias(f"__s{i}") for i, x in enumerate(v)]))
    found = sorted(folded.collect(), key=lambda r: tuple(r[n] for n in names))
    size = np.array([r["__n"] for r in found], float)
    centre = np.array([[r[f"__m{i}"] for i in range(d)] for r in found], float).reshape(-1, d)
    inner = np.array([[r[f"__s{i}"] * r["__n"] for i in range(d)] for r in found], float).reshape(-1, d)
    if not found:
        mean, scale = np.zeros(d), np.ones(d)
    else:
        mean = (size[:, None] * centre).sum(axis=0) / size.sum()
        spread = np.sqrt((inner + size[:, None] * (centre - mean) ** 2).sum(axis=0) / size.sum())
        scale = np.where(spread > 0, spread, 1.0) if standardise else np.ones(d)
    z = (centre - mean) / scale
    total = float(((inner / scale**2) + size[:, None] * z**2).sum())
    within = float((inner / scale**2).sum())
    kinds = dict(folded.dtypes)
    cells = local_rows(df.sparkSession, [(*[r[n] for n in names], i) for i, r in enumerate(found)], ", ".join(f"{n} {kinds[n]}" for n in names) + ", summary int")
    return Tree(cols, cells, keys, join_order(z, size, linkage), size, within / total if total else 0.0, scale, mean)
