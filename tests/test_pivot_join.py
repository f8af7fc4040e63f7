import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from lodestat.operators import correlate, neighbours, pivot_join as P


def brute(q, d, sd, metric, k):
    gaps = np.abs(q[:, None] / sd - d[None] / sd)
    dist = gaps.max(-1) if metric == "maximum" else np.sqrt((gaps**2).sum(-1))
    order = np.lexsort((np.broadcast_to(np.arange(len(d)), dist.shape), dist), axis=1)[:, :k]
    return order, np.take_along_axis(dist, order, axis=1)


def table(name, values):
    return pd.DataFrame({name: np.arange(len(values)), **{f"x{i}": c for i, c in enumerate(values.T)}})


@pytest.mark.parametrize("metric", ["euclidean", "maximum"])
def test_equals_brute_force_and_compares_few(spark, frame, metric):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 10)) * 4
    d = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 10)) * 0.6
    q = centres[rng.integers(0, 60, 150)] + rng.normal(size=(150, 10)) * 0.6
    cols = [f"x{i}" for i in range(10)]
    got = P.pivot_join(frame(table("q", q)), frame(table("d", d), 7), cols, "q", "d", 5, metric=metric, report=True).toPandas().sort_values(["q", "rank"])
    ids, dist = brute(q, d, d.std(axis=0, ddof=1), metric, 5)
    assert (got["d"].to_numpy().reshape(150, 5) == ids).all() and np.allclose(got["distance"].to_numpy().reshape(150, 5), dist, rtol=1e-12)
    met = got.drop_duplicates("q")["candidates"].mean() / 6000
    assert met < 0.05, met


def test_ties_repeats_and_hot_cells(spark, frame, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 50)
    d = np.array([[0.0, 0.0, 0.0, 0.0]] * 400 + [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [5.0, 5.0, 5.0, 5.0]])
    q = np.array([[0.5, 0.5, 0.0, 0.0], [5.0, 5.0, 5.0, 4.0]])
    got = P.pivot_join(frame(table("q", q)), frame(table("d", d)), ["x0", "x1", "x2", "x3"], "q", "d", 402, standardise=False).toPandas().sort_values(["q", "rank"])
    ids, dist = brute(q, d, np.ones(4), "euclidean", 402)
    assert (got["d"].to_numpy().reshape(2, 402) == ids).all() and np.allclose(got["distance"].to_numpy().reshape(2, 402), dist)


def test_a_visit_gives_its_nearest_and_not_a_row_a_pair(spark, frame, monkeypatch):
    monkeypatch.setattr(P, "CELLS_AT_ONCE", 700)
    rng = np.random.default_rng(4)
    d, q = rng.integers(0, 9, (300, 2)).astype(float), rng.integers(0, 9, (40, 2)).astype(float)
    donors = frame({"__at": np.arange(300) % 2, "__d": [f"d{i:03d}" for i in range(300)], "__x0": d[:, 0], "__x1": d[:, 1], "__pay_v": np.arange(300), "__n": np.arange(300)}, 5)
    visits = frame({"__at": np.repeat([0, 1, 2], 40), "__q": np.tile(np.arange(40), 3), "__x0": np.tile(q[:, 0], 3), "__x1": np.tile(q[:, 1], 3), "__low": 20, "__high": 249, "__reach": 3.0})
    got = P.nearest_in_blocks(visits, donors, 2, 4).toPandas()
    assert (got["__pay_v"] == got["__d"].str[1:].astype(int)).all() and len(got) <= 2 * 40 * 4
    far = np.sqrt(((q[:, None] - d[None]) ** 2).sum(-1))
    for i in range(40):
        for block in (0, 1):
            want = sorted((far[i, j], j) for j in range(20 + block, 250, 2) if far[i, j] <= 3)[:4]
            part = got[(got["__q"] == i) & (got["__pay_v"] % 2 == block)]
            assert sorted(zip(part["distance"], part["__pay_v"])) == want


def test_one_axis_search_compares_inside_tasks(spark, frame, monkeypatch):
    rng = np.random.default_rng(5)
    d, q = rng.integers(0, 30, (2500, 2)).astype(float), rng.integers(0, 30, (60, 2)).astype(float)
    rows, kept = [], neighbours.nearest_in_blocks

    def counted(*args):
        out = kept(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "nearest_in_blocks", counted)
    got = neighbours.nearest(frame(table("q", q)), frame(table("d", d), 3), ["x0", "x1"], "q", "d", 5).toPandas().sort_values(["q", "rank"])
    _, dist = brute(q, d, d.std(axis=0, ddof=1), "euclidean", 5)
    assert np.allclose(got["distance"].to_numpy().reshape(60, 5), dist, rtol=1e-9, atol=1e-12)
    assert max(rows) <= 60 * 5 * 4, rows  # not the 128 rows of a query and more of each span


def test_incomplete_rows_and_empty_tables(spark):
    cols, schema = ["a", "b", "c", "e"], "i long, a double, b double, c double, e double, v string"
    d = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, "x"), (2, None, 0.0, 0.0, 0.0, "y"), (3, float("nan"), 0.0, 0.0, 0.0, "z"), (4, 1.0, 0.0, 0.0, 0.0, None)], schema)
    q = d.withColumnRenamed("i", "q")
    got = neighbours.nearest(q, d, cols, "q", "i", 3, ["v"]).orderBy("q", "rank").collect()
    assert [(r["q"], r["i"], r["v"]) for r in got] == [(1, 1, "x"), (1, 4, None), (4, 4, None), (4, 1, "x")]
    assert neighbours.nearest(q, d.limit(0), cols, "q", "i", 3, ["v"]).columns == ["q", "i", "distance", "v", "rank"]
    assert neighbours.nearest(q, d.limit(0), cols, "q", "i", 3).count() == neighbours.nearest(q.limit(0), d, cols, "q", "i", 3).count() == 0
    assert "neighbour" in neighbours.nearest(d, d, cols, "i", "i", 1).columns


def test_mutual_information_by_neighbours_equals_brute_force(spark, frame):
    rng = np.random.default_rng(5)
    n, k = 2000, 3
    x, steps = rng.normal(size=n), rng.integers(0, 12, n).astype(float)
    y = np.sin(2 * x) + 0.1 * rng.normal(size=n) + 0.3 * steps
    df = frame({"key": range(n), "x": x, "steps": steps, "y": y, "none": [None] * n}).withColumn("none", F.col("none").cast("double"))
    got = {r["column"]: r for r in correlate.mutual_information_neighbours(df, "y", ["x", "steps", "none"], "key", k).collect()}

    def psi(m):
        harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, n + 1))])
        return harmonic[m - 1] - 0.5772156649015329

    for name, v in {"x": x, "steps": steps}.items():
        a, b = np.abs(np.subtract.outer(v, v)) / v.std(ddof=1), np.abs(np.subtract.outer(y, y)) / y.std(ddof=1)
        reach = np.partition(np.maximum(a, b), k, axis=1)[:, [k]]
        counts = [(g < np.maximum(reach * (1 - 1e-11), 1e-11)).sum(axis=1) for g in (a, b)]
        want = psi(n) + psi(k) - np.mean(psi(counts[0])) - np.mean(psi(counts[1]))
        assert abs(got[name]["mi"] - max(want, 0)) < 1e-9 and got[name]["n"] == n
    assert got["none"]["mi"] is None and got["none"]["n"] == 0 and got["x"]["mi"] > 0.2
