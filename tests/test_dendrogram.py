"""Agglomerative trees against the definition of each linkage."""

import itertools

import numpy as np
import pytest

from lodestat.operators.dendrogram import LINKAGES, agglomerative, join_order


def heights_by_definition(x, linkage):
    groups = [[i] for i in range(len(x))]
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))

    def gap(a, b):
        if linkage == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * np.square(x[a].mean(axis=0) - x[b].mean(axis=0)).sum())
        return {"single": np.min, "complete": np.max, "average": np.mean}[linkage](d[np.ix_(a, b)])

    out = []
    while len(groups) > 1:
        h, i, j = min((gap(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        out.append(h)
        groups[i] += groups.pop(j)
    return np.array(out)


@pytest.mark.parametrize("linkage", LINKAGES)
def test_heights_and_cut_equal_the_definition(frame, linkage):
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(c, 0.6, (14, 3)) for c in ((0, 0, 0), (6, 0, 1), (0, 7, 2))]).round(3)
    df = frame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}, parts=3)
    tree = agglomerative(df, ["a", "b", "c"], linkage, standardise=False)
    assert np.allclose(tree.merges[:, 2], heights_by_definition(x, linkage)) and tree.within < 1e-9
    assert tree.merges[-1, 3] == len(x) and tree.table().count() == len(x) - 1
    got = {row["id"]: row["cluster"] for row in tree.cut(df, 3).collect()}
    assert len(got) == len(x) and [len({got[i] for i in range(s, s + 14)}) for s in (0, 14, 28)] == [1, 1, 1] and len(set(got.values())) == 3


def test_repeated_rows_count_as_often_as_they_stand(frame):
    r = np.random.default_rng(5)
    x = r.integers(0, 5, (60, 2)).astype(float)
    df = frame({"a": x[:, 0], "b": x[:, 1]})
    for linkage in LINKAGES:
        want = heights_by_definition(x, linkage)
        got = agglomerative(df, ["a", "b"], linkage, standardise=False).merges[:, 2]
        # ties may be broken either way, which changes later average, complete and Ward heights; single linkage has one set of heights
        if linkage == "single":
            assert np.allclose(got, want[want > 0])
        assert len(got) == len(np.unique(x, axis=0)) - 1


def test_dense_size(spark, frame):
    x = np.random.default_rng(8).normal(size=(500, 4))
    merges = join_order(x, np.ones(500), "single")
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    inside, best, want = np.zeros(500, bool), d[0].copy(), []
    inside[0] = True
    for _ in range(499):  # the edges of the smallest spanning tree
        j = int(np.argmin(np.where(inside, np.inf, best)))
        want.append(best[j])
        inside[j] = True
        best = np.minimum(best, d[j])
    assert np.allclose(merges[:, 2], sorted(want))


def test_folded_rows_keep_the_whole_sum_of_squares(frame):
    r = np.random.default_rng(9)
    x = np.vstack([r.normal(c, 0.3, (700, 2)) for c in ((0, 0), (5, 1), (2, 6))])
    df = frame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]}, parts=4)
    tree = agglomerative(df, ["a", "b"], summaries=120)
    assert 20 < len(tree.sizes) <= 120 and tree.sizes.sum() == len(x)
    assert np.isclose((tree.merges[:, 2] ** 2).sum() / 2 + tree.within * 2 * len(x), 2 * len(x))
    rows, tried = tree.cut_by_silhouette(df, (2, 3, 4))
    assert max(tried, key=lambda t: t[1])[0] == 3
    got = {row["id"]: row["cluster"] for row in rows.collect()}
    assert len(got) == len(x) and all(len({got[i] for i in range(s, s + 700)}) == 1 for s in (0, 700, 1400))


def test_nulls_constants_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 5.0, 1.0), (5, float("inf"), 1.0)], "id int, a double, b double")
    tree = agglomerative(df, ["a", "b"])
    assert len(tree.merges) == 1 and {r["id"] for r in tree.cut(df, 2).collect()} == {1, 4}
    none = agglomerative(df.limit(0), ["a", "b"])
    assert len(none.merges) == 0 and none.table().count() == 0 and none.cut(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        agglomerative(df, ["a"], "median")
