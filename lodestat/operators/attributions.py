"""Exact Shapley attributions of fitted trees and forests, for every row.

A tree's prediction, when only some features are known, follows the split where the feature is known and otherwise both branches
in proportion to the training rows that went there. For one leaf the Shapley value of a feature on its path is an integral over
[0, 1] of a product with one factor a feature, o s + z (1 - s), where o says whether the row meets the feature's splits on the path and z is
the share of rows that do. A product of m factors is a polynomial of degree m - 1 without the feature itself, so a few
quadrature points give it exactly. Leaves of equally many features are handled together for a whole Arrow batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col
from lodestat.operators.cell_trees import grid_values, with_cell
from lodestat.session import saved, scratch_path

CELLS = 2_000_000  # rows x leaves x features worked on together
GRID_CELLS = 1 << 16  # with so few cells between all split points, rows look up their cell's attributions
KNOWN_CELLS = 200_000  # cells whose attributions a task keeps
PATTERN_FEATURES = 6  # up to so many features on a path the 2^m patterns of a leaf are worked out beforehand


@dataclass
class Leaf:
    """A leaf's value and, for each feature on its path, the bounds or categories a value must meet and the share of rows that do."""
    value: float
    cover: float  # share of the tree's rows
    features: list[int]
    low: list[float]  # value must be above
    high: list[float]  # and at most
    sets: list[frozenset | None]
    share: list[float]


def tree_tables(model) -> list[tuple[float, list[dict]]]:
    """(weight, nodes) of each tree of a fitted tree, forest or boosted model, from its saved form."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "model")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        nodes = rows.select("treeID", "nodeData.*")
        weights = dict(enumerate(model.treeWeights))
    else:
        nodes, weights = rows.withColumn("treeID", F.lit(0)), {0: 1.0}
    if model.__class__.__name__.startswith("RandomForest"):
        weights = {k: 1.0 / len(weights) for k in weights}
    trees: dict[int, list[dict]] = {k: [] for k in weights}
    for r in nodes.select("treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild", "split.*").collect():  # nodes of the model, no data
        trees[r["treeID"]].append(r.asDict())
    return [(weights[k], sorted(v, key=lambda n: n["id"])) for k, v in trees.items()]


def leaves_of(nodes: Sequence[dict], label: int | None = None) -> list[Leaf]:
    """The leaves of one tree; `label` asks for the probability of that class in place of the predicted value."""
    by_id = {n["id"]: n for n in nodes}
    out: list[Leaf] = []

    def weight(n: dict) -> float:
        return float(sum(n["impurityStats"])) if label is not None else float(n["rawCount"])

    def walk(at: int, met: dict, cover: float) -> None:
        n = by_id[at]
        if n["leftChild"] < 0:
            total = sum(n["impurityStats"]) if label is not None else 1.0
            value = n["impurityStats"][label] / total if label is not None and total else n["prediction"]
            features = list(met)
            out.append(Leaf(float(value), cover, features, *(list(v) for v in zip(*met.values()))) if features else Leaf(float(value), cover, [], [], [], [], []))
            return
        f, bounds = n["featureIndex"], n["leftCategoriesOrThreshold"]
        here = weight(n)
        for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
            share = weight(by_id[child]) / here if here else 0.5
            low, high, allowed, z = met.get(f, (-np.inf, np.inf, None, 1.0))
            if n["numCategories"] == -1:
                low, high = (low, min(high, bounds[0])) if left else (max(low, bounds[0]), high)
            else:
                chosen = frozenset(bounds) if left else frozenset(range(n["numCategories"])) - frozenset(bounds)
                allowed = chosen if allowed is None else allowed & chosen
            walk(child, {**met, f: (low, high, allowed, z * share)}, cover * share)

    walk(0, {}, 1.0)
    return out


def leaf_values(o: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(rows, leaves, m) Shapley values of leaves of value 1, where o (rows, leaves, m) says which features meet their splits."""
    m = o.shape[2]
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    inner = np.zeros_like(o)
    for at, weight in zip((points + 1) / 2, weights / 2):
        factor = o * at + z * (1 - at)
        before, after = np.ones_like(o), np.ones_like(o)
        for j in range(1, m):
            before[:, :, j] = before[:, :, j - 1] * factor[:, :, j - 1]
            after[:, :, m - 1 - j] = after[:, :, m - j] * factor[:, :, m - j]
        inner += weight * before * after
    return (o - z) * inner


class Attributor:
    """Weighted leaves laid out by the number of their features; with few features the values of all patterns are worked out once."""

    def __init__(self, leaves: Sequence[tuple[float, Leaf]]):
        self.parts = []
        for m in sorted({len(leaf.features) for _, leaf in leaves} - {0}):
            some = [(w, leaf) for w, leaf in leaves if len(leaf.features) == m]
            features = np.array([leaf.features for _, leaf in some])
            low, high, z = (np.array([getattr(leaf, c) for _, leaf in some]) for c in ("low", "high", "share"))
            sets = [(i, j, np.array(sorted(v), float)) for i, (_, leaf) in enumerate(some) for j, v in enumerate(leaf.sets) if v is not None]
            scale = np.array([w * leaf.value for w, leaf in some])
            table = None
            if m <= PATTERN_FEATURES:
                patterns = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
                table = leaf_values(np.repeat(patterns[:, None, :], len(some), axis=1), z) * scale[None, :, None]
            self.parts.append((m, features, low, high, z, sets, scale, table))

    def __call__(self, x: np.ndarray, width: int) -> np.ndarray:
        """(rows, width) Shapley values of rows x."""
        out = np.zeros((len(x), width))
        for m, features, low, high, z, sets, scale, table in self.parts:
            step = max(1, CELLS // (len(features) * m))
            for k in range(0, len(x), step):
                values = x[k : k + step][:, features]
                met = (values > low) & (values <= high)
                for i, j, allowed in sets:
                    met[:, i, j] &= np.isin(values[:, i, j], allowed)
                if table is None:
                    gained = leaf_values(met.astype(float), z) * scale[None, :, None]
                else:
                    gained = table[met @ (1 << np.arange(m)), np.arange(len(features))[None, :]]
                for f in np.unique(features):
                    out[k : k + step, f] += gained[:, features == f].sum(axis=1)
        return out


class CellValues:
    """Attributions by cell: a row's depend only on the interval between split points in which each of its values lies.

    The cells met so far are kept in the task, KNOWN_CELLS at most, so that a batch works out only those that are new. With
    categorical splits, or more cells than numbers for them, equal rows of a batch are worked out once.
    """

    def __init__(self, attribute: Attributor, leaves: Sequence[tuple[float, Leaf]], width: int):
        self.attribute, self.width = attribute, width
        points: list[set] = [set() for _ in range(width)]
        for _, leaf in leaves:
            for f, low, high in zip(leaf.features, leaf.low, leaf.high):
                points[f] |= {v for v in (low, high) if np.isfinite(v)}
        self.cuts = [np.array(sorted(v)) for v in points]
        sizes = [len(c) + 2 for c in self.cuts]  # intervals, and one for NaN and -inf, which meet no split
        self.steps = [int(np.prod([1, *sizes[:i]], dtype=object)) for i in range(width)]
        self.sizes, self.cells = sizes, int(np.prod([1, *sizes], dtype=object))
        self.usable = self.cells < 2**62 and not any(s is not None for _, leaf in leaves for s in leaf.sets)
        self.keys, self.values = np.zeros(0, np.int64), np.zeros((0, width))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            some, at = np.unique(x, axis=0, return_inverse=True)  # equal rows have equal attributions
            return self.attribute(some, self.width)[at.ravel()]
        cell = np.zeros(len(x), np.int64)
        for values, cuts, step in zip(x.T, self.cuts, self.steps):
            cell += step * np.where(values > -np.inf, np.searchsorted(cuts, values), len(cuts) + 1)
        some, first, at = np.unique(cell, return_index=True, return_inverse=True)
        new = ~np.isin(some, self.keys, assume_unique=True)
        if new.any():
            if len(self.keys) + new.sum() > KNOWN_CELLS:
                self.keys, self.values, new = self.keys[:0], self.values[:0], np.ones(len(some), bool)
            keys = np.concatenate([self.keys, some[new]])
            values = np.concatenate([self.values, self.attribute(x[first[new]], self.width)])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]
        return self.values[np.searchsorted(self.keys, some)][at.ravel()]


def grid_contributions(cells: CellValues, base: float, df: DataFrame, key: Sequence[str], names: Sequence[str], features: str) -> DataFrame:
    """As `tree_contributions`, where all cells are few: each is worked out once, in tasks, and rows look theirs up."""
    attribute, width = cells.attribute, len(names)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(len(batch), width)
            values = attribute(x, width)
            yield pd.DataFrame({"cell": batch["cell"], **{f"s{i}": values[:, i] for i in range(width)}, "total": base + values.sum(axis=1)})

    ends = [[*c, np.nextafter(c[-1], np.inf) if len(c) else 0.0, np.nan] for c in cells.cuts]  # the last one is for values that meet no split
    grid = grid_values(df.sparkSession, ends).select("cell", vector_to_array("features").alias("x"))
    known = saved(grid.mapInPandas(work, "cell int, " + "".join(f"s{i} double, " for i in range(width)) + "total double"), "attributions")
    rows = with_cell(df.select(*[as_col(k) for k in key], as_col(features).alias("__features")), "__features", cells.cuts, "__cell", apart=True)
    found = rows.join(F.broadcast(known.withColumnsRenamed({c: f"__{c}" for c in known.columns})), "__cell", "left")  # GRID_CELLS rows at most
    return found.select(*[as_col(k) for k in key], F.lit(base).alias("base"), *[F.col(f"__s{i}").alias(f"shap_{n}") for i, n in enumerate(names)], F.col("__total").alias("total"))


def tree_contributions(model, df: DataFrame, key: Sequence[str], names: Sequence[str], features: str = "features", label: int | None = None) -> DataFrame:
    """Per row: key…, `base`, `shap_<name>` for each feature and `total`, their sum with the base.

    `model` is a fitted decision tree, random forest or gradient-boosted model, `df` has its vector column. Regression models and
    boosted margins explain the prediction; with `label`, trees and forests of a classification explain that class's probability.
    `base` is the prediction with no feature known. Attributions are exact, whatever the depth.
    """
    trees = tree_tables(model)
    leaves = [(w, leaf) for w, nodes in trees for leaf in leaves_of(nodes, label)]
    base = sum(w * leaf.value * leaf.cover for w, leaf in leaves)
    attribute = Attributor(leaves)
    names = list(names)
    cells = CellValues(attribute, leaves, len(names))
    if cells.usable and cells.cells <= GRID_CELLS:
        return grid_contributions(cells, base, df, key, names, features)
    rows = df.select(*[as_col(k) for k in key], vector_to_array(as_col(features)).alias("__x"))
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        contributions = CellValues(attribute, leaves, len(names))
        for batch in batches:
            x = np.stack([np.asarray(v, float) for v in batch["__x"]]) if len(batch) else np.zeros((0, len(names)))
            values = contributions(x)
            out = batch.drop(columns="__x").assign(base=base, **{f"shap_{n}": values[:, i] for i, n in enumerate(names)})
            yield out.assign(total=base + values.sum(axis=1))

    return rows.mapInPandas(run, kinds + "base double, " + "".join(f"`shap_{n}` double, " for n in names) + "total double")
