import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.operators import forecast as FC
from lodestat.operators import multivariate_ts as MV
from lodestat.operators import series as S
from lodestat.operators import stationarity as ST


@pytest.fixture(scope="module")
def noise_and_walk():
    rng = np.random.default_rng(42)
    e = rng.normal(size=300)
    return pd.DataFrame({"i": range(300), "noise": e, "walk": np.cumsum(rng.normal(size=300))})


def test_unit_root_tests_tell_noise_from_walk(frame, noise_and_walk):
    df = frame(noise_and_walk)
    out = {r["column"]: r for r in ST.stationarity(df, ["noise", "walk"], ["i"]).collect()}
    assert out["noise"]["verdict"] == "stationary" and out["walk"]["adf_p"] > .05 and out["walk"]["kpss_p"] < .05
    assert ST.integration_order(df, "walk", ["i"])[0] == 1


def test_unit_root_p_at_critical_values():
    assert ST.unit_root_p(-2.8615, "c") == pytest.approx(.05, abs=.002) and ST.unit_root_p(-3.4108, "ct") == pytest.approx(.05, abs=.002)


def test_sliced_tests_agree(frame, noise_and_walk):
    df = frame(noise_and_walk, 5)
    assert ST.kpss(df, "walk", ["i"])[0] == pytest.approx(ST.kpss(df, "walk", ["i"], rows_per_slice=40)[0])
    assert ST.adf(df, "walk", ["i"])[0] == pytest.approx(ST.adf(df, "walk", ["i"], rows_per_slice=40)[0])


def weekly(n=140):
    rng = np.random.default_rng(1)
    t = np.arange(n)
    return pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n), "i": t, "y": 50 + .4 * t + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(scale=.3, size=n), "g": "a"})


def test_smoothing_equals_a_plain_loop_and_ignores_blocks(frame):
    d = weekly()
    both = frame(pd.concat([d, d.assign(g="b", y=d["y"] * 2)]))
    a = FC.holt_winters(both, "y", ["i"], 7, 7, ["g"]).orderBy("g", "step").toPandas()
    b = FC.holt_winters(both, "y", ["i"], 7, 7, ["g"], block=20).orderBy("g", "step").toPandas()
    assert np.allclose(a["forecast"], b["forecast"]) and np.allclose(a["sse"], b["sse"])
    al, be, ga = a["parameters"].iloc[0]
    y = d["y"].to_numpy()
    m, slope = y[:14].mean(), (y[7:14].mean() - y[:7].mean()) / 7
    level = y[:7].mean() - slope * 4
    season = [np.mean(y[i:14:7]) - m - slope * (i - 3) for i in range(7)]
    sse = 0.0
    for v in y:
        e = v - (level + slope + season[0])
        sse += e * e
        level, slope = level + slope + al * e, slope + al * be * e
        season = season[1:] + [season[0] + ga * (1 - al) * e]
    assert a["sse"].iloc[0] == pytest.approx(sse)
    want = 50 + .4 * (139 + np.arange(1, 8)) + 5 * np.sin(2 * np.pi * (139 + np.arange(1, 8)) / 7)
    assert np.abs(a["forecast"].to_numpy()[:7] - want).max() < 2.0


def test_volatility_grid_prefers_the_planted_pair(frame):
    rng = np.random.default_rng(3)
    s, r = 1.0, []
    for _ in range(4000):
        e = math.sqrt(s) * rng.normal()
        r.append(e)
        s = .05 + .15 * e * e + .8 * s
    df = frame({"i": range(4000), "r": r})
    out = FC.garch(df, "r", ["i"]).first()
    assert out["alpha"] in (.1, .15, .2) and out["beta"] in (.7, .8, .85)
    assert FC.garch(df, "r", ["i"], block=500).first()["neg_log_likelihood"] == pytest.approx(out["neg_log_likelihood"])


def test_autoregression_recovers_coefficients(frame):
    rng = np.random.default_rng(4)
    y = [0.0, 0.0]
    for _ in range(1500):
        y.append(1 + .6 * y[-1] - .3 * y[-2] + rng.normal())
    df = frame({"i": range(len(y)), "y": y})
    r = FC.autoregression(df, "y", ["i"], 4).first()
    assert r["p"] >= 2 and r["coef"][1] == pytest.approx(.6, abs=.08) and r["coef"][2] == pytest.approx(-.3, abs=.08)
    f = FC.autoregressive_forecast(df, "y", ["i"], 40, 2).orderBy("step").toPandas()
    assert f["forecast"].iloc[-1] == pytest.approx(1 / .7, abs=.3) and (f["high"] - f["low"]).is_monotonic_increasing


def test_differenced_forecast_keeps_the_slope(frame):
    t = np.arange(60)
    rng = np.random.default_rng(5)
    df = frame({"i": t, "y": 3.0 * t + rng.normal(scale=.01, size=60)})
    f = FC.autoregressive_forecast(df, "y", ["i"], 5, 1, d=1).orderBy("step").toPandas()
    assert np.allclose(f["forecast"], 3.0 * (59 + np.arange(1, 6)), atol=.3)


def test_trend_season_fit(frame):
    d = weekly()
    f = FC.trend_season_fit(frame(d), "y", ["i"], 7, 7, knots=2).orderBy("step").toPandas()
    want = 50 + .4 * (139 + np.arange(1, 8)) + 5 * np.sin(2 * np.pi * (139 + np.arange(1, 8)) / 7)
    assert np.abs(f["forecast"] - want).max() < 1.5 and f["r2"].iloc[0] > .99


def test_comparison_prefers_season_aware_models(frame):
    out = FC.compare_forecasters(frame(weekly()), "y", ["i"], 7, 7).toPandas().set_index("method")
    assert out.loc["holt_winters", "mae"] < out.loc["naive", "mae"] and out.loc["naive", "skill"] == 0


def test_grid_chunks_and_gaps(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-04", 4.0), ("b", "2024-01-02", 2.0)], "g string, d string, v double").withColumn("d", F.to_timestamp("d"))
    a = S.regular_grid(df, "d", ["v"], "D", ["g"]).orderBy("g", "ts").toPandas()
    b = S.regular_grid(df, "d", ["v"], "D", ["g"], chunk=2, rows_per_slice=2).orderBy("g", "ts").toPandas()
    assert a.equals(b) and a["v"].tolist() == [1, 1, 1, 4, 2]
    assert S.seasonal_period("MS") == 12 and S.seasonal_period("h") == 24 and S.seasonal_period("min") == 60
    with pytest.raises(ValueError):
        S.future_dates(df, "d", "D", 3, dates=[])


def lagged(n=300):
    rng = np.random.default_rng(6)
    x = rng.normal(size=n)
    y = np.concatenate([[0, 0], .9 * x[:-2]]) + rng.normal(scale=.3, size=n)
    return pd.DataFrame({"i": range(n), "x": x, "y": y})


def test_granger_direction_and_lag(frame):
    out = {(r["cause"], r["effect"]): r for r in MV.granger(frame(lagged()), ["x", "y"], ["i"], 4).collect()}
    assert out[("x", "y")]["significant"] and out[("x", "y")]["lag"] == 2 and not out[("y", "x")]["significant"]


def test_cointegration_rank(frame):
    rng = np.random.default_rng(7)
    w = np.cumsum(rng.normal(size=400))
    df = frame({"i": range(400), "a": w + rng.normal(scale=.5, size=400), "b": 2 * w + rng.normal(scale=.5, size=400), "c": np.cumsum(rng.normal(size=400))})
    got = MV.johansen(df, ["a", "b"], ["i"], 1, check=False).toPandas()
    level = np.column_stack(list(df.orderBy("i").toPandas()[["a", "b"]].to_numpy().T))
    d = np.diff(level, axis=0)
    z = np.column_stack([np.ones(len(d) - 1), d[:-1]])
    r0, r1 = (m - z @ np.linalg.lstsq(z, m, rcond=None)[0] for m in (d[1:], level[1:-1]))
    t = len(r0)
    ev = np.sort(np.linalg.eigvals(np.linalg.inv(r1.T @ r1) @ (r1.T @ r0) @ np.linalg.inv(r0.T @ r0) @ (r0.T @ r1)).real)[::-1]
    assert np.allclose(got["eigenvalue"], ev) and np.allclose(got["trace"], [-t * np.log(1 - ev[k:]).sum() for k in range(2)])
    assert got["rank"].iloc[0] >= 1
    assert MV.johansen(df, ["a", "c"], ["i"], 1, check=False).first()["rank"] == 0
    r = MV.ardl_bounds(df, "b", ["a"], ["i"], 1).first()
    assert r["verdict"] == "level_relation" and r["long_run"] == pytest.approx(2, abs=.1)
    f = MV.vecm_forecast(df, ["a", "b"], ["i"], 5).toPandas().pivot(index="step", columns="column", values="forecast")
    assert abs(f["b"].iloc[-1] - 2 * f["a"].iloc[-1]) < 4


def test_vector_models(frame):
    rng = np.random.default_rng(8)
    a = np.array([[.5, .2], [0, .6]])
    y = [np.zeros(2)]
    for _ in range(1500):
        y.append(a @ y[-1] + rng.normal(size=2))
    y = np.array(y)
    df = frame({"i": range(len(y)), "u": y[:, 0], "v": y[:, 1]})
    m, p = MV.var_fit(df, ["u", "v"], ["i"], 3)
    assert np.allclose(MV.var_fit(df, ["u", "v"], ["i"], 3, lag=1)[0].mats[0], a, atol=.08)
    share = MV.impulse_responses(df, ["u", "v"], ["i"], 5, 1).groupBy("step", "response").agg(F.sum("variance_share").alias("s")).toPandas()["s"]
    assert np.allclose(share, 1)
    assert MV.bvar_fit(df, ["u", "v"], ["i"], 1).mats[0][0, 0] == pytest.approx(.5, abs=.15)
    assert MV.pairwise_var(df, ["u", "v"], ["i"], 3, 1).count() == 6
