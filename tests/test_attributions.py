import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor

from lodestat.operators import attributions as A


def expectation(nodes, row, known, label):
    by_id = {n["id"]: n for n in nodes}

    def value(at):
        n = by_id[at]
        if n["leftChild"] < 0:
            return n["impurityStats"][label] / sum(n["impurityStats"]) if label is not None else n["prediction"]
        f, bounds = n["featureIndex"], n["leftCategoriesOrThreshold"]
        if f in known:
            left = row[f] <= bounds[0] if n["numCategories"] == -1 else row[f] in bounds
            return value(n["leftChild"] if left else n["rightChild"])
        size = (lambda c: sum(c["impurityStats"])) if label is not None else (lambda c: c["rawCount"])
        a, b = by_id[n["leftChild"]], by_id[n["rightChild"]]
        return (size(a) * value(n["leftChild"]) + size(b) * value(n["rightChild"])) / (size(a) + size(b))

    return value(0)


def by_subsets(trees, row, width, label):
    out = np.zeros(width)
    for i in range(width):
        rest = [j for j in range(width) if j != i]
        for size in range(width):
            for some in itertools.combinations(rest, size):
                weight = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
                out[i] += weight * sum(w * (expectation(n, row, {*some, i}, label) - expectation(n, row, {*some}, label)) for w, n in trees)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    d = pd.DataFrame({"i": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400), "c": rng.integers(0, 5, 400).astype(float), "d": rng.normal(size=400)})
    d["label"] = d["a"] * (d["c"] == 2) + np.sign(d["b"]) * d["d"] + 0.3 * d["c"] % 2
    d["k"] = (d["label"] > 0.3).astype(float) + (d["a"] > 1)
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="raw").transform(spark.createDataFrame(d))
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=6).fit(df).transform(df).cache()


@pytest.mark.parametrize("maker, label", [(lambda: DecisionTreeRegressor(maxDepth=5), None), (lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=1), None),
                                          (lambda: RandomForestClassifier(labelCol="k", numTrees=5, maxDepth=4, seed=1), 1)])
def test_equal_to_all_subsets_and_additive(table, maker, label):
    model = maker().fit(table)
    names = ["a", "b", "c", "d"]
    out = A.tree_contributions(model, table, ["i"], names, label=label).toPandas().set_index("i").sort_index()
    scored = {r["i"]: r for r in model.transform(table).select("i", "features", "prediction", *(["probability"] if label is not None else [])).collect()}
    want = np.array([scored[i]["probability"][label] if label is not None else scored[i]["prediction"] for i in out.index])
    assert np.allclose(out["total"], want, atol=1e-9)
    trees = A.tree_tables(model)
    for i in range(0, 400, 57):
        row = scored[i]["features"].toArray()
        assert np.allclose(out.loc[i, [f"shap_{n}" for n in names]].to_numpy(float), by_subsets(trees, row, 4, label), atol=1e-10)
    if label is None:
        assert out["base"].iloc[0] == pytest.approx(want.mean(), abs=1e-9)


def test_pattern_tables_change_nothing(table, monkeypatch):
    leaves = [(1.0, leaf) for _, nodes in A.tree_tables(DecisionTreeRegressor(maxDepth=6).fit(table)) for leaf in A.leaves_of(nodes)]
    x = np.array([r[0].toArray() for r in table.select("features").limit(60).collect()])
    with_tables = A.Attributor(leaves)(x, 4)
    monkeypatch.setattr(A, "PATTERN_FEATURES", 0)
    assert np.allclose(A.Attributor(leaves)(x, 4), with_tables, atol=1e-12)


def test_stump_free_tree_and_no_rows(table):
    flat = DecisionTreeRegressor(maxDepth=0).fit(table)
    out = A.tree_contributions(flat, table, ["i"], ["a", "b", "c", "d"])
    assert out.where("abs(shap_a) + abs(shap_d) > 0").count() == 0
    assert A.tree_contributions(flat, table.limit(0), ["i"], ["a", "b", "c", "d"]).collect() == []


def test_cells_are_worked_out_once():
    """Rows between the same split points share attributions across batches; NaN, split points and a full store included."""
    inf = np.inf
    leaves = [(1.0, A.Leaf(2.0, .3, [0], [-inf], [1.0], [None], [.3])), (1.0, A.Leaf(-1.0, .4, [0, 1], [1.0, -inf], [inf, 0.5], [None, None], [.7, .6])),
              (1.0, A.Leaf(5.0, .3, [0, 1], [1.0, 0.5], [inf, inf], [None, None], [.7, .4]))]
    whole, asked = A.Attributor(leaves), []

    def counted(x, width):
        asked.append(len(x))
        return whole(x, width)

    cells = A.CellValues(counted, leaves, 2)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(1, 1, (500, 2)), [[1.0, 0.5], [np.nan, 0.5], [1.0, np.nan], [inf, -inf]]])
    for _ in range(3):
        assert np.allclose(cells(x), whole(x, 2)) and cells(x[:0]).shape == (0, 2)
    assert sum(asked) <= 9
    kept, A.KNOWN_CELLS = A.KNOWN_CELLS, 2
    try:
        small = A.CellValues(whole, leaves, 2)
        assert all(np.allclose(small(part), whole(part, 2)) for part in (x[:3], x[3:6], x))
    finally:
        A.KNOWN_CELLS = kept
