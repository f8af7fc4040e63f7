import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import normal_scores as N


def test_quantile_column(spark):
    ps = [1e-300, 1e-20, 1e-6, 0.02, 0.0749, 0.076, 0.3, 0.5, 0.7, 0.93, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").coalesce(1).select(N.normal_quantile(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-13, atol=1e-15)


def dense_w(x):
    x, n = np.sort(x), len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, c = 1 / math.sqrt(n), m / math.sqrt(m @ m)
    a = m.copy()
    an, am = c[-1] + N.polynomial(N.LAST, u), c[-2] + N.polynomial(N.BEFORE_LAST, u)
    a /= math.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * am**2))
    a[[0, 1, -2, -1]] = -an, -am, am, an
    return (a @ x) ** 2 / np.square(x - x.mean()).sum()


@pytest.mark.parametrize("n", [6, 11, 12, 50, 500])
def test_w_equals_the_dense_formula_for_any_slices(frame, n):
    rng = np.random.default_rng(n)
    x = {"normal": 1000 + rng.normal(size=n), "skewed": rng.exponential(size=n), "ties": rng.integers(0, 4, n).astype(float)}
    for kw in ({}, {"rows_per_slice": 7}):
        for r in N.shapiro_wilk(frame(x, 3), list(x), **kw).collect():
            assert r["w"] == pytest.approx(dense_w(x[r["column"]]), rel=1e-10)


def test_levels_and_odd_columns(frame):
    rng = np.random.default_rng(1)
    df = frame({"normal": rng.normal(size=3000), "uniform": rng.random(3000), "flat": [2.0] * 3000, "few": [1.0, 2.0, 3.0] + [None] * 2997})
    p = {r["column"]: r["p"] for r in N.shapiro_wilk(df, df.columns).collect()}
    assert p["normal"] > 0.01 > 1e-6 > p["uniform"] and p["flat"] is None and p["few"] is None
    hits = [N.w_p(dense_w(rng.normal(size=20)), 20) < 0.05 for _ in range(2000)]
    assert 0.03 < np.mean(hits) < 0.075
