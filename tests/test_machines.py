import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler

from lodestat.operators import boosting as B
from lodestat.operators import kernel as K


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(2)
    angle, radius = rng.uniform(0, 2 * np.pi, 900), np.repeat([0.4, 1.2, 2.2], 300)
    d = pd.DataFrame({"a": radius * np.cos(angle) + rng.normal(scale=0.12, size=900), "b": radius * np.sin(angle) + rng.normal(scale=0.12, size=900), "ring": np.repeat([0.0, 1.0, 2.0], 300)})
    d["y"] = np.sin(2 * d["a"]) + d["b"] ** 2
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(d).repartition(3)).cache()


def share(df, label):
    return df.where(f"prediction = {label}").count() / df.count()


def test_kernel_classes_beat_a_line(rings):
    two = rings.where("ring < 2")
    line = LinearSVC(labelCol="ring", maxIter=50).fit(two).transform(two)
    assert share(K.KernelMachine(classes=2, label="ring", gamma=1.0).fit(two).transform(two), "ring") > 0.97 > 0.8 > share(line, "ring")
    assert share(K.KernelMachine(classes=3, label="ring", gamma=1.0).fit(rings).transform(rings), "ring") > 0.95


def test_regression_is_the_minimum_of_its_loss(rings):
    model = K.KernelMachine(label="y", gamma=1.0, cost=2.0, epsilon=0.05, size=80).fit(rings)
    d = rings.toPandas()
    z, y = model.spread(d[["a", "b"]].to_numpy()), d["y"].to_numpy()

    def loss(beta):
        return 0.5 * beta[:-1] @ beta[:-1] + 2.0 * np.square(np.maximum(np.abs(z @ beta - y) - 0.05, 0)).sum()

    best = loss(model.beta[0])
    assert model.loss[0] == pytest.approx(best, rel=1e-9)
    rng = np.random.default_rng(3)
    assert all(loss(model.beta[0] + 1e-3 * rng.normal(size=81)) >= best * (1 - 1e-12) for _ in range(200))
    out = model.transform(rings).toPandas()
    line = np.column_stack([d["a"], d["b"], np.ones(len(d))])
    rest = d["y"] - line @ np.linalg.lstsq(line, d["y"], rcond=None)[0]
    assert np.mean((out["prediction"] - out["y"]) ** 2) < 0.1 * np.mean(rest**2)  # a line leaves ten times as much


def test_stages_before_the_machine_run_once_and_not_at_each_step(rings):
    from pyspark.sql import functions as F

    runs = rings.sparkSession.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(y):
        runs.add(1)
        return y

    K.KernelMachine(label="z", gamma=1.0).fit(rings.withColumn("z", counted("y")).where("z is not null"))
    assert runs.value <= 4 * rings.count()


def plain_samme(x, y, k, rounds):
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            for cut in range(int(x[:, f].max()) + 1):
                left = x[:, f] <= cut
                a, b = (np.bincount(y[s], w[s], k) for s in (left, ~left))
                e = 1 - (a.max() + b.max()) / w.sum()
                if best is None or e < best[0] - 1e-12:
                    best = (e, f, cut, int(a.argmax()), int(b.argmax()))
        e, f, cut, lo, hi = best
        alpha = math.log((1 - e) / e) + math.log(k - 1)
        out.append((f, cut, lo, hi, e, alpha))
        w = w * np.exp(alpha * (np.where(x[:, f] <= cut, lo, hi) != y))
    return out


def test_stumps_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 7, (600, 3))
    y = (x[:, 0] > 3).astype(int) + ((x[:, 1] > 2) & (x[:, 2] < 5)).astype(int)
    y = np.where(rng.random(600) < 0.1, rng.integers(0, 3, 600), y)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=[f"k{v}" for v in y]))
    cuts = {c: [i + 0.5 for i in range(6)] for c in "abc"}
    model = B.BoostedStumps(rounds=8).fit(df, list("abc"), "y", cuts)
    want = plain_samme(x + 1, y, 3, 8)
    assert [(s.feature, s.bin, s.left, s.right) for s in model.stumps] == [w[:4] for w in want]
    assert np.allclose([(s.error, s.weight) for s in model.stumps], [w[4:] for w in want])
    votes = np.zeros((600, 3))
    for f, cut, lo, hi, _, a in want:
        votes[np.arange(600), np.where(x[:, f] + 1 <= cut, lo, hi)] += a
    got = model.transform(df).toPandas()
    assert (got["prediction"] == [f"k{v}" for v in votes.argmax(axis=1)]).mean() == 1.0


def test_stumps_with_nulls_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1.0, "a"), (5.0, "b"), (float("nan"), "a"), (6.0, "b"), (2.0, None)], "x double, y string")
    out = {r["x"]: r["prediction"] for r in B.BoostedStumps(rounds=3).fit(df, ["x"], "y").transform(df).collect()}
    assert out[None] == "a" and out[6.0] == "b"
    assert {r[0] for r in B.BoostedStumps().fit(df.where("y = 'a'"), ["x"], "y").transform(df).select("prediction").collect()} == {"a"}
