"""Trees grown from sums by cell against Spark's own on the same rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from lodestat.operators import attributions as AT
from lodestat.operators import cell_trees as C
from lodestat.operators import supervised as M


def _table(frame, n=3000, seed=0, parts=5):
    """Two features of few values, one of 60 unevenly found, and a label of another size than its spread."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 5, n) - 2.0, rng.integers(0, 3, n) / 7, np.floor(60 * rng.random(n) ** 2)
    y = 1000 + 3 * a * (b > .2) + np.sin(c / 5) * 2 + rng.normal(size=n)
    df = frame({"a": a, "b": b, "c": c, "label": y}, parts)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def _nodes(model):
    return [(n["id"], n["leftChild"], n["rightChild"], n["featureIndex"], tuple(np.round(n["leftCategoriesOrThreshold"], 9)), n["rawCount"], round(n["prediction"], 6),
             *np.round(n["impurityStats"], 3)) for _, tree in AT.tree_tables(model) for n in tree]


@pytest.mark.parametrize("make", [lambda: DecisionTreeRegressor(maxDepth=6, seed=1), lambda: GBTRegressor(maxIter=6, maxDepth=3, seed=1)])
def test_trees_are_those_of_spark(frame, make):
    df = _table(frame)
    own, cells = make().fit(df), C.CellTrees(make, plain_rows=0).fit(df)
    assert _nodes(cells) == _nodes(own)
    assert np.allclose(cells.featureImportances.toArray(), own.featureImportances.toArray(), atol=1e-9)
    gap = own.transform(df).withColumnRenamed("prediction", "p").drop("c")
    assert cells.transform(gap).agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-9


def test_small_tables_go_to_spark(frame):
    model = C.CellTrees(lambda: DecisionTreeRegressor(seed=1)).fit(_table(frame, 50))
    assert type(model) is DecisionTreeRegressionModel


def test_boosting_does_not_read_the_rows_at_every_level(frame, spark, monkeypatch):
    """30 rounds of 4 levels were over 150 jobs on the rows."""
    monkeypatch.setattr(C, "PLAIN_ROWS", 0)
    df = _table(frame)
    spark.sparkContext.setJobGroup("boosting", "boosting")
    try:
        model = M.regressors()["gradient_boosting"]()[0].fit(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.getNumTrees == 30 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) < 40


def test_estimators_made_together_read_the_cells_once(frame, monkeypatch):
    monkeypatch.setattr(C, "PLAIN_ROWS", 0)
    whole, read = C.cells_of, []
    monkeypatch.setattr(C, "cells_of", lambda *a: read.append(1) or whole(*a))
    df, models = _table(frame, 400), M.regressors()
    for name in ("decision_tree", "gradient_boosting"):
        models[name]()[0].fit(df)
    assert len(read) == 1
    models["decision_tree"]()[0].fit(_table(frame, 300, 1))
    assert len(read) == 2


def test_forest_draws_every_row_for_every_tree(frame):
    """The rows in a tree's sample are Poisson in number; drawn by cell, their number would spread far more."""
    n = 3000
    df = _table(frame, n)
    model = C.CellTrees(lambda: RandomForestRegressor(numTrees=50, maxDepth=5, seed=3), plain_rows=0).fit(df)
    roots = np.array([tree[0]["rawCount"] for _, tree in AT.tree_tables(model)])
    assert len(set(roots)) > 30 and abs(roots.mean() - n) < 5 * np.sqrt(n / 50) and .5 < roots.var() / n < 1.8
    r2 = M.regression_metrics(model.transform(df), "label", "prediction").first()["r2"]
    own = RandomForestRegressor(numTrees=50, maxDepth=5, seed=3).fit(df)
    assert abs(r2 - M.regression_metrics(own.transform(df), "label", "prediction").first()["r2"]) < .05


def test_draws_are_poisson():
    got = np.bincount(C.Draws(1.0, [1])(400_000), minlength=6) / 400_000
    want = np.exp(-1) / np.array([1, 1, 2, 6, 24, 120])
    assert np.abs(got[:6] - want).max() < 4e-3 and abs((got * np.arange(len(got))).sum() - 1) < .01


def test_features_of_many_values(frame, monkeypatch):
    """Thresholds come from all rows; looked-up predictions are those of the trees, for values outside of the table too."""
    rng = np.random.default_rng(4)
    n = 6000
    x, z = rng.normal(size=n), rng.exponential(size=n)
    df = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(frame({"x": x, "z": z, "label": np.where(x > .5, 4.0, 0) + z}, 4))
    cells = C.CellTrees(lambda: DecisionTreeRegressor(maxDepth=6, seed=1), plain_rows=0).fit(df)
    own = DecisionTreeRegressor(maxDepth=6, seed=1).fit(df)
    r2 = [M.regression_metrics(m.transform(df), "label", "prediction").first()["r2"] for m in (cells, own)]
    assert len(cells.cuts[0]) == 31 and r2[0] > r2[1] - .02
    odd = VectorAssembler(inputCols=["x", "z"], outputCol="features", handleInvalid="keep").transform(
        frame({"x": [*cells.cuts[0], -50.0, np.nan, np.inf, -np.inf, 9.0], "z": [float(v) for v in cells.cuts[1]] + [1e9, -1.0, np.nan, 0.5, -np.inf]}))
    looked = [r[0] for r in cells.transform(odd).select("prediction").collect()]
    cells.cuts = None
    assert looked == [r[0] for r in cells.transform(odd).select("prediction").collect()]


def test_too_many_cells_go_to_spark(frame, monkeypatch):
    monkeypatch.setattr(C, "MOST_CELLS", 20)
    model = C.CellTrees(lambda: DecisionTreeRegressor(maxDepth=2, seed=1), plain_rows=0).fit(_table(frame))
    assert type(model) is DecisionTreeRegressionModel


def test_labels_without_a_number_are_refused(frame):
    df = _table(frame, 200).withColumn("label", F.when(F.col("a") < 2, F.col("label")))
    with pytest.raises(Exception, match="must not be null"):
        C.CellTrees(lambda: DecisionTreeRegressor(seed=1), plain_rows=0).fit(df)


def test_constant_features_and_labels(frame):
    df = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(frame({"x": [1.0] * 40, "z": [float(i % 2) for i in range(40)], "label": [5.0] * 40}))
    for make in (lambda: DecisionTreeRegressor(seed=1), lambda: RandomForestRegressor(numTrees=3, seed=1), lambda: GBTRegressor(maxIter=2, seed=1)):
        model = C.CellTrees(make, plain_rows=0).fit(df)
        assert {r[0] for r in model.transform(df).select("prediction").collect()} == {5.0}


def test_attributions_looked_up_are_those_worked_out(frame, monkeypatch):
    """All cells worked out beforehand give what the rows' own attributions are; odd values meet no split or the last."""
    df = _table(frame, 800)
    model = C.CellTrees(lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=1), plain_rows=0).fit(df)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(
        df.select("a", "b", "c").unionByName(frame({"a": [np.nan, -np.inf, np.inf, 0.0], "b": [0.0, np.nan, -9.0, np.inf], "c": [3.0, 900.0, np.nan, -np.inf]})))

    def values():
        found = AT.tree_contributions(model, rows, ["a", "b", "c"], ["a", "b", "c"])
        return found.columns, sorted(tuple(None if v is None else f"{round(v, 9) + 0.0:.9g}" for v in r)[3:] for r in found.collect())

    looked = values()
    monkeypatch.setattr(AT, "GRID_CELLS", 0)
    assert looked == values() and len(looked[1]) == 804
