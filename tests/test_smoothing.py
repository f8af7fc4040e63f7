import math

import numpy as np
import pandas as pd
import pytest

from lodestat.operators import forecast as FC
from lodestat.operators import smoothing as SM


def seasonal(n=140, multiplicative=False, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    wave = np.sin(2 * np.pi * t / 7)
    line = 50 + 0.4 * t + np.cumsum(rng.normal(scale=0.5, size=n))
    return line * (1 + 0.2 * wave) + rng.normal(scale=0.3, size=n) if multiplicative else line + 5 * wave + rng.normal(scale=0.3, size=n)


def plain_sse(y, alpha, beta, gamma, kernel):
    state = kernel.start(y[: kernel.head], None)
    level, slope, s, total = state[0], state[1], list(state[2:]), 0.0
    for t, v in enumerate(y):
        at = t % 7
        base = level + slope
        e = v - (base * s[at] if kernel.multiplicative else base + s[at])
        by = s[at] if kernel.multiplicative else 1.0
        level, slope = base + alpha * e / by, slope + alpha * beta * e / by
        s[at] += gamma * (1 - alpha) * e / (base if kernel.multiplicative else 1.0)
        total += e * e
    return total


@pytest.mark.parametrize("multiplicative", [False, True])
def test_smoothing_is_a_minimum_of_the_plain_recursion(frame, multiplicative):
    ys = {g: seasonal(n, multiplicative, s) for g, n, s in (("a", 140, 1), ("b", 140, 2), ("c", 77, 3), ("short", 13, 4))}
    df = frame(pd.concat([pd.DataFrame({"g": g, "i": range(len(y)), "y": y}) for g, y in ys.items()]))
    kernel = SM.Smoothing(7, True, multiplicative)
    rows = {r["g"]: r for r in SM.smoothing_fit(df, "y", ["i"], 7, ["g"], multiplicative=multiplicative).collect()}
    assert set(rows) == {"a", "b", "c"}
    for g, r in rows.items():
        at = [r["alpha"], r["beta"], r["gamma"]]
        best = plain_sse(ys[g], *at, kernel)
        assert r["sse"] == pytest.approx(best, rel=1e-9)
        assert r["flatness"] < 1e-4 or min(*at, *(1 - v for v in at)) < 1e-3
        for i in range(3):
            for step in (-0.02, 0.02):
                moved = list(at)
                moved[i] = min(max(moved[i] + step, 0.0), 1.0)
                assert plain_sse(ys[g], *moved, kernel) >= best * (1 - 1e-9)


def test_never_worse_than_the_grid(frame):
    df = frame(pd.DataFrame({"i": range(140), "y": seasonal()}))
    grid = FC.holt_winters(df, "y", ["i"], 1, 7).first()["sse"]
    assert SM.smoothing_fit(df, "y", ["i"], 7).first()["sse"] <= grid * 1.02  # starts differ a little
    kernel = SM.Smoothing(7)
    assert SM.smoothing_fit(df, "y", ["i"], 7).first()["sse"] <= min(plain_sse(seasonal(), a, b, c, kernel) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.01, 0.1, 0.3) for c in (0.05, 0.2, 0.4))


def test_blocks_and_slices_do_not_matter(frame):
    noise = {g: np.random.default_rng(s).normal(size=140) for g, s in (("a", 1), ("b", 2))}
    both = pd.concat([pd.DataFrame({"g": g, "i": range(140), "y": 50 + np.cumsum(e) + 2 * e}) for g, e in noise.items()])
    a, b = (SM.smoothing_forecast(frame(both, 4), "y", ["i"], 2, 1, ["g"], trend=False, block=n).orderBy("g", "step").toPandas() for n in (1000, 70))
    assert np.allclose(a["forecast"], b["forecast"], rtol=1e-3) and np.allclose(a["sse"], b["sse"], rtol=1e-6)


@pytest.mark.parametrize("multiplicative", [False, True])
def test_starts_of_blocks_settle_at_the_whole_recursion(multiplicative):
    kernel, y, x = SM.Smoothing(7, True, multiplicative), seasonal(140, multiplicative)[None], np.array([[[0.3, -0.8, 0.2]]])
    scale, begin = np.array([[0.0, 1.0]]), kernel.start(y[0, :14], None)[None, None]
    errors, end = kernel.run(y, x, begin, scale, 0)
    starts = [begin] * 4
    for _ in range(4):
        parts = [kernel.run(y[:, 35 * k : 35 * k + 35], x, s, scale, 35 * k) for k, s in enumerate(starts)]
        starts = [begin, *[p[1] for p in parts[:-1]]]
    assert np.allclose(np.concatenate([p[0] for p in parts], axis=2), errors) and np.allclose(parts[-1][1], end)


def test_forecast_of_a_clean_season(frame):
    t = np.arange(70)
    y = (10 + 2.0 * t) * (1 + 0.3 * np.sin(2 * np.pi * t / 7))
    out = SM.smoothing_forecast(frame({"i": t, "y": y}), "y", ["i"], 7, 7, multiplicative=True).orderBy("step").toPandas()
    later = np.arange(70, 77)
    assert np.allclose(out["forecast"], (10 + 2.0 * later) * (1 + 0.3 * np.sin(2 * np.pi * later / 7)), rtol=0.03)


def volatile(n, seed=3):
    rng = np.random.default_rng(seed)
    h, r = 1.0, []
    for _ in range(n):
        e = math.sqrt(h) * rng.normal()
        r.append(0.1 + e)
        h = 0.05 + 0.15 * e * e + 0.8 * h
    return np.array(r)


def plain_nll(r, mean, omega, alpha, beta):
    h, total = r.var(), 0.0
    for v in r:
        e = v - mean
        total += 0.5 * (math.log(2 * math.pi * h) + e * e / h)
        h = omega + alpha * e * e + beta * h
    return total


def test_volatility_is_a_maximum_of_the_likelihood(frame):
    r = volatile(3000)
    df = frame({"i": range(3000), "r": r}, 3)
    out = SM.garch_fit(df, "r", ["i"]).first()
    at = [out[c] for c in ("mean", "omega", "alpha", "beta")]
    best = plain_nll(r, *at)
    assert out["neg_log_likelihood"] == pytest.approx(best, rel=1e-9) and out["flatness"] < 1e-3
    for i, step in enumerate((0.01, 0.003, 0.01, 0.01)):
        for sign in (-1, 1):
            moved = list(at)
            moved[i] += sign * step
            assert plain_nll(r, *moved) > best
    assert abs(at[2] - 0.15) < 0.05 and abs(at[3] - 0.8) < 0.08
    assert best <= FC.garch(df, "r", ["i"]).first()["neg_log_likelihood"] + 0.5 * 3000 * math.log(2 * math.pi) + 3000 * math.log(r.std()) + 1e-6
    cut = SM.garch_fit(df, "r", ["i"], block=1500).first()
    assert cut["neg_log_likelihood"] == pytest.approx(out["neg_log_likelihood"], rel=1e-7) and cut["next_volatility"] == pytest.approx(out["next_volatility"], rel=1e-2)


def test_constant_null_and_empty_series(frame):
    df = frame(pd.DataFrame({"g": ["a"] * 20 + ["b"] * 20, "i": [*range(20)] * 2, "y": [3.0] * 20 + [None if k % 4 == 0 else float(k) for k in range(20)]}))
    rows = {r["g"]: r for r in SM.smoothing_fit(df, "y", ["i"], 1, ["g"]).collect()}
    assert rows["a"]["sse"] == pytest.approx(0, abs=1e-12) and rows["b"]["n"] == 15
    assert [r["g"] for r in SM.garch_fit(df, "y", ["i"], ["g"]).collect()] == ["b"]
    assert SM.smoothing_fit(df.limit(0), "y", ["i"], 1, ["g"]).collect() == []
