"""Kernel machines on all rows: radial-basis features drawn once, and Newton steps whose sums are taken map-side.

cos(w x + b) with normal w and uniform b has the radial kernel as its expected product, so a linear machine on a few hundred such
features stands for the kernel machine. Losses are squared (hinge, or beyond epsilon), which makes each Newton step a ridge fit over the
rows that lie on the wrong side; it needs one matrix of the features' cross-products, added up in each task and then in a tree.
The stages before are run once: the rows are written as plain numbers in even shares, and each step reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.session import saved

ROUNDS = 40
BRANCHES = 64  # partial sums that reach the driver


class RandomFeatures:
    """The map of rows (n, k) to (n, size + 1) features, the last one constant; the same for the same seed."""

    def __init__(self, k: int, size: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.w, self.b = rng.normal(scale=np.sqrt(2 * gamma), size=(k, size)), rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


class KernelMachine(Estimator):
    """Support-vector regression (`classes` 0) or classification, one machine for each class against the rest, over vector column
    `features` and number column `label` (classes 0, 1, …). `cost` weighs the loss against half the squared length of the coefficients.
    Scale features first; `gamma` is 1 / their number unless given. Rows without a label are left out."""

    def __init__(self, classes: int = 0, size: int = 200, gamma: float | None = None, cost: float = 1.0, epsilon: float = 0.1, seed: int = 42, features: str = "features", label: str = "label"):
        super().__init__()
        self.classes, self.size, self.gamma, self.cost, self.epsilon, self.seed, self.features, self.label = classes, size, gamma, cost, epsilon, seed, features, label

    def _fit(self, dataset: DataFrame) -> "KernelMachineModel":
        rows = dataset.where(F.col(self.label).isNotNull()).select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"))
        first = rows.first()
        if first is None:
            raise ValueError("no rows with a label")
        xs = [f"x{i}" for i in range(len(first["x"]))]
        plain = rows.select("y", *[F.get("x", i).alias(c) for i, c in enumerate(xs)])
        rows = saved(plain.repartition(dataset.sparkSession.sparkContext.defaultParallelism), "kernel_rows")  # even shares, as every step waits for the largest
        spread = RandomFeatures(len(first["x"]), self.size, self.gamma or 1.0 / max(len(first["x"]), 1), self.seed)
        machines = max(1, self.classes if self.classes > 2 else 1)
        width, epsilon, classes = self.size + 1, self.epsilon, self.classes
        beta = np.zeros((machines, width))

        def targets(y: np.ndarray, m: int) -> np.ndarray:
            if classes == 0:
                return y
            return np.where(y == (m if classes > 2 else 1), 1.0, -1.0)

        def sums(batches: Iterator[pd.DataFrame], at: np.ndarray) -> Iterator[pd.DataFrame]:
            total = np.zeros((machines, width + 1, width + 1))  # cross-products of active features and target, and the loss in the corner
            for batch in batches:
                if not len(batch):
                    continue
                z, y = spread(batch[xs].to_numpy(float)), batch["y"].to_numpy(float)
                for m in range(machines):
                    t, f = targets(y, m), z @ at[m]
                    if classes == 0:
                        over = np.abs(f - t) - epsilon
                        t = t + np.where(f > t, epsilon, -epsilon)
                    else:
                        over = 1 - t * f
                    on = over > 0
                    zt = np.concatenate([z[on], t[on, None]], axis=1)
                    total[m] += zt.T @ zt
                    total[m, -1, -1] += float(np.square(over[on]).sum()) - float(t[on] @ t[on])
            yield pd.DataFrame({"branch": [TaskContext.get().partitionId() % BRANCHES], "total": [total.tobytes()]})

        def added(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(v) for v in group["total"])
            return pd.DataFrame({"branch": group["branch"].iloc[:1], "total": [total.tobytes()]})

        def evaluate(at: np.ndarray) -> np.ndarray:
            parts = rows.mapInPandas(lambda batches: sums(batches, at), "branch int, total binary").groupBy("branch").applyInPandas(added, "branch int, total binary")
            return sum(np.frombuffer(r["total"]) for r in parts.collect()).reshape(machines, width + 1, width + 1)

        ridge = np.diag([*np.ones(self.size), 0.0])
        loss, old, pace = np.full(machines, np.inf), beta.copy(), np.ones(machines)
        step = np.zeros_like(beta)
        rounds = 0
        for rounds in range(1, ROUNDS + 1):
            total = evaluate(beta)
            value = np.array([0.5 * beta[m] @ ridge @ beta[m] + self.cost * total[m, -1, -1] for m in range(machines)])
            moving = False
            for m in range(machines):
                if value[m] <= loss[m]:
                    gain = loss[m] - value[m]
                    old[m], loss[m], pace[m] = beta[m], value[m], 1.0
                    a = ridge + 2 * self.cost * total[m, :width, :width]
                    step[m] = np.linalg.lstsq(a, 2 * self.cost * total[m, :width, width], rcond=None)[0] - beta[m]
                    moving |= bool(gain > 1e-10 * max(abs(value[m]), 1e-300) and np.abs(step[m]).max() > 1e-10)
                else:
                    pace[m] /= 2  # too far: back towards the last point
                    moving |= bool(pace[m] > 1e-6)
            if not moving:
                break
            beta = old + pace[:, None] * step
        return KernelMachineModel(spread, old, classes, self.features, loss, rounds)


class KernelMachineModel(Model):
    def __init__(self, spread: RandomFeatures, beta: np.ndarray, classes: int, features: str, loss: np.ndarray, rounds: int):
        super().__init__()
        self.spread, self.beta, self.classes, self.features, self.loss, self.rounds = spread, beta, classes, features, loss, rounds

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spread, beta, classes = self.spread, self.beta, self.classes

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            f = spread(np.stack([np.asarray(v, float) for v in x])) @ beta.T
            if classes == 0:
                return pd.Series(f[:, 0])
            return pd.Series((f[:, 0] > 0).astype(float) if classes <= 2 else f.argmax(axis=1).astype(float))

        return dataset.withColumn("prediction", predicted(vector_to_array(self.features)))


class StumpEnsemble(Estimator):
    """`BoostedStumps` over a vector column, as a stage of a pipeline."""

    def __init__(self, rounds: int = 30, features: str = "features", label: str = "label"):
        super().__init__()
        self.rounds, self.features, self.label = rounds, features, label

    def _fit(self, dataset: DataFrame) -> "StumpEnsembleModel":
        from lodestat.operators.boosting import BoostedStumps

        first = dataset.select(vector_to_array(self.features).alias("x")).first()
        names = [f"__f{i}" for i in range(len(first["x"]) if first else 0)]
        wide = dataset.withColumn("__x", vector_to_array(self.features)).select(F.col(self.label), *[F.get("__x", i).alias(n) for i, n in enumerate(names)])
        return StumpEnsembleModel(BoostedStumps(rounds=self.rounds).fit(wide, names, self.label), names, self.features)


class StumpEnsembleModel(Model):
    def __init__(self, model, names: list[str], features: str):
        super().__init__()
        self.model, self.names, self.features = model, names, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        wide = dataset.withColumn("__x", vector_to_array(self.features)).withColumns({n: F.get("__x", i) for i, n in enumerate(self.names)})
        return self.model.transform(wide).drop("__x", *self.names)
