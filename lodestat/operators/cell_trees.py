"""Regression trees on all rows of a large table, grown from sums by cell.

A tree of Spark's kind looks at a feature only through its candidate thresholds, `maxBins` - 1 at most. Rows between the same thresholds
in all features are one cell: they go the same way in every tree, so counts, sums and sums of squares by cell hold all that the
variance of any split needs, and the rows are read once instead of once a level. A forest draws how often each row is in
each tree's sample, row by row as Spark does, and adds up a cell's sums for each tree; boosting needs only the sums, as all rows of a cell
have the same prediction so far. The trees are written in the saved form of Spark's models and loaded as such.

Small tables, and those whose rows lie in too many cells, go to Spark's own trees.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.session import scratch_path

PLAIN_ROWS = 200_000  # up to so many rows Spark's own trees are fitted
MOST_CELLS = 1 << 15  # a task holds the sums of so many cells for each tree
MOST_VALUES = 2_000  # a feature of more different values takes its thresholds from a sketch of all rows
AT_ONCE = 200_000  # rows drawn for at once


@dataclass
class Cells:
    """The cells that hold rows: their numbers, bins (cells, features), counts, and sums and sums of squares of label - shift."""
    cuts: list[np.ndarray]
    shift: float
    codes: np.ndarray
    bins: np.ndarray
    sums: np.ndarray  # (3, cells)


# ---------------------------------------------------------------- rows of a task

def _plain(dataset: DataFrame, features: str, label: str) -> DataFrame:
    return dataset.select(vector_to_array(features).alias("x"), F.col(f"`{label}`").cast("double").alias("y"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, features) and labels, about AT_ONCE rows at a time."""
    held, rows = [], 0

    def block():
        x, y = (np.concatenate(v) for v in zip(*held))
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            raise ValueError("features and labels of a tree must not be null, NaN or infinite")
        return x, y

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width) + 0.0, b.column(1).to_numpy(zero_copy_only=False)))  # -0.0 becomes 0.0
            rows += b.num_rows
        if rows >= AT_ONCE:
            yield block()
            held, rows = [], 0
    if held:
        yield block()


def _codes(x: np.ndarray, cuts: list[np.ndarray], steps: list[int]) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for values, c, step in zip(x.T, cuts, steps):
        code += step * np.searchsorted(c, values)
    return code


def _steps(cuts: list[np.ndarray]) -> list[int]:
    sizes = [len(c) + 1 for c in cuts]
    return [int(np.prod([1, *sizes[:i]], dtype=object)) for i in range(len(sizes))]


def thresholds_of(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Spark's candidate thresholds of a feature from its sorted values and how often each is found: midway between neighbours, at even shares."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) <= most:
        return middles
    stride = counts.sum() / (most + 1)
    out, target, upto = [], stride, np.cumsum(counts)
    for i, middle in enumerate(middles):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(middle)
            target += stride
    return np.array(out)


def candidate_thresholds(rows: DataFrame, width: int, most: int) -> tuple[list[np.ndarray], float]:
    """Thresholds of each feature from all rows, and the mean label."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list = [pd.Series(dtype=float)] * width
        n, total = 0, 0.0
        for x, y in _blocks(batches, width):
            n, total = n + len(y), total + y.sum()
            for f in range(width):
                if known[f] is not None:
                    known[f] = known[f].add(pd.Series(x[:, f]).value_counts(sort=False), fill_value=0)
                    if len(known[f]) > MOST_VALUES:
                        known[f] = None
        found = [(-1, 0.0, float(n), total)] + [(f, np.nan, 0.0, 0.0) for f in range(width) if known[f] is None]
        found += [(f, v, c, 0.0) for f in range(width) if known[f] is not None for v, c in known[f].items()]
        columns = {"feature": "int32", "value": float, "n": float, "label": float}
        yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=list(columns)).astype(columns), preserve_index=False)

    def choose(found: pd.DataFrame) -> pd.DataFrame:
        f = int(found["feature"].iloc[0])
        if f < 0:
            out: list | None = [float(found["label"].sum()), float(found["n"].sum())]
        elif found["value"].isna().any() or len(found) > MOST_VALUES:
            out = None
        else:
            found = found.sort_values("value")
            out = thresholds_of(found["value"].to_numpy(), found["n"].to_numpy(), most).tolist()
        return pd.DataFrame({"feature": [f], "cuts": [out]}).astype({"feature": "int32"})

    counted = rows.mapInArrow(count, "feature int, value double, n double, label double").groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("label").alias("label"))
    got = {r["feature"]: r["cuts"] for r in counted.groupBy("feature").applyInPandas(choose, "feature int, cuts array<double>").collect()}  # a row a feature
    total, n = got.pop(-1)
    many = [f for f in range(width) if got[f] is None]
    if many:
        shares = [i / (most + 1) for i in range(1, most + 1)]
        row = rows.agg(*[F.percentile_approx(F.get("x", f), shares, 10_000).alias(f"q{f}") for f in many], *[F.max(F.get("x", f)).alias(f"m{f}") for f in many]).first()
        got |= {f: sorted({v for v in row[f"q{f}"] if v < row[f"m{f}"]}) for f in many}
    return [np.array(got[f], float) for f in range(width)], total / n


def cells_of(rows: DataFrame, width: int, most: int) -> Cells | None:
    """Sums by cell, or None where rows lie in more than MOST_CELLS of them."""
    cuts, shift = candidate_thresholds(rows, width, most)
    steps = _steps(cuts)
    if steps[-1] * (len(cuts[-1]) + 1) >= 2**62:
        return None

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = pd.Index([], dtype="int64"), np.zeros((3, 0))
        for x, y in _blocks(batches, width):
            at, here = pd.factorize(_codes(x, cuts, steps))
            known = known.append(pd.Index(here[~np.isin(here, known)]))
            if len(known) > MOST_CELLS:
                break
            sums = np.pad(sums, ((0, 0), (0, len(known) - sums.shape[1])))
            y = y - shift
            sums[:, known.get_indexer(here)] += np.array([np.bincount(at, w, len(here)) for w in (None, y, y * y)])
        over = len(known) > MOST_CELLS
        at = known.to_numpy()[: 0 if over else None]
        yield pa.RecordBatch.from_pydict({"code": pa.array([-1] if over else at, pa.int64()), **{f"s{i}": pa.array(np.zeros(1) if over else sums[i], pa.float64()) for i in range(3)}})

    parts = rows.mapInArrow(add_up, "code long, s0 double, s1 double, s2 double").groupBy("code").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(3)])
    got = parts.orderBy("code").limit(MOST_CELLS + 1).toPandas()  # cells, no rows
    codes = got["code"].to_numpy()
    if len(codes) > MOST_CELLS or codes[0] < 0:
        return None
    bins = np.column_stack([codes // step % (len(c) + 1) for c, step in zip(cuts, steps)])
    return Cells(cuts, shift, codes, bins, got[["s0", "s1", "s2"]].to_numpy().T.copy())


class Draws:
    """Poisson numbers, by a table over 16 random bits and, where these do not decide, 48 more."""

    def __init__(self, rate: float, seed: list[int]):
        self.rng = np.random.default_rng(seed)
        self.upto = np.cumsum([math.exp(-rate) * rate**i / math.factorial(i) for i in range(60)])
        low, high = np.arange(1 << 16) / 65536, np.arange(1, (1 << 16) + 1) / 65536
        first = np.searchsorted(self.upto, low, side="right")
        self.table = np.where(first == np.searchsorted(self.upto, high), first, 255).astype(np.uint8)

    def __call__(self, n: int) -> np.ndarray:
        bits = np.frombuffer(self.rng.bytes(2 * n), np.uint16)
        out = self.table[bits]
        open_ = np.flatnonzero(out == 255)
        out[open_] = np.searchsorted(self.upto, (bits[open_] + self.rng.random(len(open_))) / 65536, side="right")
        return out


# ---------------------------------------------------------------- one tree

NODE = "id int, prediction double, impurity double, stats array<double>, n long, gain double, left int, right int, feature int, threshold double"


def _variance(w: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w > 0, (q - s * s / w) / w, 0.0)


def grow(bins: np.ndarray, sums: np.ndarray, cuts: list[np.ndarray], shift: float, depth: int, tried: int, rng: np.random.Generator,
         fewest: float = 1.0, least_gain: float = 0.0) -> tuple[list[tuple], np.ndarray]:
    """Nodes of a tree in Spark's order (NODE), and its prediction for each cell. `tried` features are looked at in a node."""
    width, size = len(cuts), max(len(c) for c in cuts) + 1
    nodes: list[dict] = []
    at = np.zeros(len(bins), np.int64)  # the cell's node
    level = [0]
    nodes.append({"sums": sums.sum(axis=1)})
    for d in range(depth):
        place = np.full(len(nodes), -1)
        place[level] = np.arange(len(level))
        mine = place[at]
        some = mine >= 0
        whole = np.array([nodes[i]["sums"] for i in level]).T
        impurity = _variance(*whole)
        best = np.full(len(level), -np.inf)
        pick = np.zeros((2, len(level)), np.int64)
        looked = rng.random((len(level), width)).argsort(axis=1).argsort(axis=1) < tried
        for f in range(width):
            if not len(cuts[f]):
                continue
            slot = mine[some] * size + bins[some, f]
            left = np.array([np.bincount(slot, v[some], len(level) * size).reshape(-1, size) for v in sums]).cumsum(axis=2)[:, :, : len(cuts[f])]
            right = whole[:, :, None] - left
            share = left[0] / whole[0][:, None]
            gain = impurity[:, None] - share * _variance(*left) - (1 - share) * _variance(*right)
            gain[(left[0] < fewest) | (right[0] < fewest) | ~looked[:, f, None] | ~(gain >= least_gain)] = -np.inf
            first = gain.argmax(axis=1)
            top = gain[np.arange(len(level)), first]
            better = top > best
            best[better], pick[0, better], pick[1, better] = top[better], f, first[better]
        following = []
        target = np.full((2, len(nodes)), -1)
        for i, node in enumerate(level):
            if not best[i] > 0 or impurity[i] < np.finfo(float).eps:
                continue
            f, s = int(pick[0, i]), int(pick[1, i])
            nodes[node] |= {"feature": f, "cut": s, "gain": float(best[i]), "left": len(nodes), "right": len(nodes) + 1}
            target[:, node] = len(nodes), len(nodes) + 1
            following += [len(nodes), len(nodes) + 1]
            nodes += [{}, {}]
        split = target[0, at] >= 0
        if not split.any():
            break
        feature = np.array([n.get("feature", 0) for n in nodes])[at]
        cut = np.array([n.get("cut", 0) for n in nodes])[at]
        goes = bins[np.arange(len(bins)), feature] > cut
        at = np.where(split, target[goes.astype(int), at], at)
        for j in range(3):
            for node, v in zip(following, np.bincount(at, sums[j], len(nodes))[following]):
                nodes[node].setdefault("sums", np.zeros(3))[j] = v
        level = following
    value = np.array([shift + n["sums"][1] / n["sums"][0] for n in nodes])
    out: list[tuple] = []

    def one(i: int) -> bool:
        """Lay out node i and what is below it; whether it is a leaf. Two leaves of one value become a leaf, as in Spark."""
        n, here = nodes[i], len(out)
        w, s, q = n["sums"]
        said = (float(value[i]), float(_variance(w, s, q)), [float(w), float(s + w * shift), float(q + 2 * shift * s + w * shift * shift)], int(round(w)))
        out.append((here, *said, -1.0, -1, -1, -1, None))
        if "feature" not in n:
            return True
        ends, right = one(n["left"]), len(out)
        ends = one(n["right"]) and ends
        if ends and out[here + 1][1] == out[right][1]:
            del out[here + 1 :]
            out[here] = (here, float(value[n["left"]]), *said[1:], -1.0, -1, -1, -1, None)
            return True
        out[here] = (here, *said, n["gain"], here + 1, right, n["feature"], float(cuts[n["feature"]][n["cut"]]))
        return False

    one(0)
    return out, value[at]


# ---------------------------------------------------------------- models

def with_cell(df: DataFrame, features: str, cuts: Sequence[Sequence[float]], name: str, apart: bool = False) -> DataFrame:
    """Add the number of the row's cell: a value's bin is how many cuts lie below it. `apart` gives NaN and -inf a bin of their own, else
    they lie above all cuts and below. `features` is a vector column."""
    at = [f"{name}{f}" for f in range(len(cuts))]
    df = df.withColumn(name, vector_to_array(F.col(f"`{features}`"))).withColumns({c: F.get(name, F.lit(f)) for f, c in enumerate(at)})
    some = [f for f, c in enumerate(cuts) if len(c)]
    if some:  # Bucketizer's bins hold their lower end, ours the upper one
        ends = [[-np.inf, *(float(v) for v in np.nextafter(cuts[f], np.inf)), np.inf] for f in some]
        df = Bucketizer(splitsArray=ends, inputCols=[at[f] for f in some], outputCols=[f"{at[f]}_bin" for f in some], handleInvalid="keep").transform(df)
    code, step = F.lit(0), 1
    for f, c in enumerate(cuts):
        here = F.col(f"{at[f]}_bin").cast("int") if len(c) else F.when(F.isnan(at[f]), 1).otherwise(0)
        here = F.when(F.col(at[f]) == float("-inf"), len(c) + 1).otherwise(here) if apart else F.least(here, F.lit(len(c)))
        code, step = code + here * step, step * (len(c) + 1 + apart)
    return df.withColumn(name, code).drop(*at, *[f"{at[f]}_bin" for f in some])


def grid_values(spark: SparkSession, values: Sequence[Sequence[float]], parts: int | None = None) -> DataFrame:
    """A row a cell of a grid: `cell` and the vector of the values that stand for its bins."""
    size = math.prod(len(v) for v in values)
    picks, step = [], 1
    for v in values:
        picks.append(F.get(F.array(*[F.lit(float(e)) for e in v]), (F.floor(F.col("id") / F.lit(step)) % len(v)).cast("int")))
        step *= len(v)
    return spark.range(0, size, 1, parts or spark.sparkContext.defaultParallelism).select(F.col("id").cast("int").alias("cell"), array_to_vector(F.array(*picks)).alias("features"))


class ByCell:
    """A model of trees whose rows look up their cell's prediction instead of walking through every tree."""

    cuts: list[np.ndarray] | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes = [len(c) + 1 for c in self.cuts or []]
        if self.cuts is None or math.prod(sizes) > MOST_CELLS or "__cell" in dataset.columns:
            return super()._transform(dataset)
        grid = grid_values(dataset.sparkSession, [[*c, np.nextafter(c[-1], np.inf) if len(c) else 0.0] for c in self.cuts])
        known = super()._transform(grid.withColumnRenamed("features", self.getFeaturesCol())).select(F.col("cell").alias("__cell"), F.col(f"`{self.getPredictionCol()}`"))
        rows = with_cell(dataset, self.getFeaturesCol(), self.cuts, "__cell")
        return rows.join(F.broadcast(known), "__cell", "left").drop("__cell")  # MOST_CELLS rows at most; an inner join would test the cell for null before, and work it out twice


class DecisionTreeByCell(ByCell, DecisionTreeRegressionModel):
    pass


class RandomForestByCell(ByCell, RandomForestRegressionModel):
    pass


class GBTByCell(ByCell, GBTRegressionModel):
    pass


def model_of(spark: SparkSession, estimator, nodes: DataFrame, weights: list[float] | None, cuts: list[np.ndarray]) -> Model:
    """Spark's model of these trees (`tree` and NODE), by way of its saved form."""
    path, width = scratch_path(spark, "trees"), len(cuts)
    kind, here = {DecisionTreeRegressor: (DecisionTreeRegressionModel, DecisionTreeByCell), RandomForestRegressor: (RandomForestRegressionModel, RandomForestByCell),
                  GBTRegressor: (GBTRegressionModel, GBTByCell)}[type(estimator)]
    node = [F.col("id"), F.col("prediction"), F.col("impurity"), F.col("stats").alias("impurityStats"), F.col("n").alias("rawCount"), F.col("gain"),
            F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
            F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("threshold").isNull(), F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories")).alias("split")]
    given, usual = ({p.name: v for p, v in m.items()} for m in (estimator._paramMap, estimator._defaultParamMap))

    def about(kind: type, uid: str, given: dict, usual: dict) -> dict:
        return {"class": f"org.apache.spark.ml.regression.{kind.__name__}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                "paramMap": given, "defaultParamMap": usual}

    described = about(kind, estimator.uid, given, usual) | {"numFeatures": width}
    if weights is None:
        nodes.select(*node).write.parquet(f"{path}/data")
    else:
        nodes.select(F.col("tree").alias("treeID"), F.struct(*node).alias("nodeData")).write.parquet(f"{path}/data")
        plain = DecisionTreeRegressor()
        small = {p.name: v for p, v in plain._defaultParamMap.items()}
        trees = [(i, json.dumps(about(DecisionTreeRegressionModel, f"{plain.uid}_{i}", {k: v for k, v in given.items() if k in small}, small)), float(w)) for i, w in enumerate(weights)]
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        described |= {"numTrees": len(weights)}
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    model = kind.load(path)
    model.__class__, model.cuts = here, cuts
    return model


def _forest(rows: DataFrame, cells: Cells, estimator) -> DataFrame:
    """Nodes of all trees: each row's number of times in each tree's sample is drawn once, a tree is grown in one task."""
    width, trees, seed, depth = len(cells.cuts), estimator.getNumTrees(), estimator.getSeed(), estimator.getMaxDepth()
    rate, fewest, least_gain = estimator.getSubsamplingRate(), float(estimator.getMinInstancesPerNode()), estimator.getMinInfoGain()
    cuts, shift, codes, bins, size = cells.cuts, cells.shift, cells.codes, cells.bins, len(cells.codes)
    tried = width if trees == 1 else -(-width // 3)
    steps = _steps(cuts)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        often = Draws(rate, [seed % 2**32, part])
        sums = np.zeros((trees, 3, size))
        for x, y in _blocks(batches, width):
            at, y = np.searchsorted(codes, _codes(x, cuts, steps)), y - shift
            for t in range(trees):
                w = often(len(y)).astype(float)
                wy = w * y
                for j, v in enumerate((w, wy, wy * y)):
                    sums[t, j] += np.bincount(at, v, size)
        if sums.any():
            yield pa.RecordBatch.from_pydict({"tree": pa.array(range(trees), pa.int32()), "part": pa.array([part] * trees, pa.int32()), "sums": [s.tobytes() for s in sums]})

    def tree(found: pd.DataFrame) -> pd.DataFrame:
        t = int(found["tree"].iloc[0])
        sums = sum(np.frombuffer(b).reshape(3, size) for b in found.sort_values("part")["sums"])
        some = sums[0] > 0
        nodes, _ = grow(bins[some], sums[:, some], cuts, shift, depth, tried, np.random.default_rng([seed % 2**32, t, 1]), fewest, least_gain)
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE.split(", ")]).assign(tree=t)

    drawn = rows.mapInArrow(draw, "tree int, part int, sums binary")
    return drawn.groupBy("tree").applyInPandas(tree, NODE + ", tree int")


def _boosted(cells: Cells, estimator) -> tuple[list[tuple], list[float]]:
    """Trees on what the ones before leave over, for squared loss: the first counts in full, the others by the step size."""
    w, s, q = cells.sums
    mean = s / w
    within = np.maximum(q - s * mean, 0.0)
    so_far, nodes, weights = np.zeros(len(w)), [], []
    rng = np.random.default_rng(estimator.getSeed() % 2**32)
    for m in range(estimator.getMaxIter()):
        if m == 0:
            left, spread, base = mean, within, cells.shift
        else:
            left, spread, base = 2 * (mean + cells.shift - so_far), 4 * within, 0.0
        found, values = grow(cells.bins, np.array([w, w * left, spread + w * left * left]), cells.cuts, base, estimator.getMaxDepth(), len(cells.cuts), rng,
                             float(estimator.getMinInstancesPerNode()), estimator.getMinInfoGain())
        weights.append(1.0 if m == 0 else estimator.getStepSize())
        so_far = so_far + weights[-1] * values
        nodes += [(*n, m) for n in found]
    return nodes, weights


class CellTrees(Estimator):
    """Spark's regression tree, forest or boosted trees (`make()` gives the estimator), grown from cells where the table is large.

    Forests are those that sample with replacement and try a third of the features, boosting is for squared loss on all rows. `shared` keeps the cells of the last table, so that estimators made together read them once.
    """

    def __init__(self, make: Callable[[], Estimator], shared: dict | None = None, plain_rows: int | None = None):
        super().__init__()
        self.make, self.shared, self.plain_rows = make, {} if shared is None else shared, PLAIN_ROWS if plain_rows is None else plain_rows

    def _fit(self, dataset: DataFrame) -> Model:
        estimator, spark = self.make(), dataset.sparkSession
        if dataset.count() <= self.plain_rows:
            return estimator.fit(dataset)
        rows = _plain(dataset, estimator.getFeaturesCol(), estimator.getLabelCol())
        width = len(rows.first()["x"])
        if self.shared.get("of") is not dataset:
            self.shared.update(of=dataset, cells=cells_of(rows, width, estimator.getMaxBins() - 1))
        cells = self.shared["cells"]
        if cells is None:
            return estimator.fit(dataset)
        if isinstance(estimator, RandomForestRegressor):
            return model_of(spark, estimator, _forest(rows, cells, estimator), [1.0] * estimator.getNumTrees(), cells.cuts)
        if isinstance(estimator, GBTRegressor):
            nodes, weights = _boosted(cells, estimator)
            return model_of(spark, estimator, spark.createDataFrame(nodes, NODE + ", tree int"), weights, cells.cuts)
        nodes, _ = grow(cells.bins, cells.sums, cells.cuts, cells.shift, estimator.getMaxDepth(), width, np.random.default_rng(0),
                        float(estimator.getMinInstancesPerNode()), estimator.getMinInfoGain())
        return model_of(spark, estimator, spark.createDataFrame(nodes, NODE), None, cells.cuts)
