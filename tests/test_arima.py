import numpy as np
import pandas as pd
import pytest

from lodestat.operators import arima as A


def dense_likelihood(w, phi, theta):
    """Quadratic form and log-determinant of the covariance of an ARMA process with unit error variance."""
    n, psi = len(w), np.zeros(6000)
    psi[0] = 1.0
    for i in range(1, len(psi)):
        psi[i] = (theta[i - 1] if i <= len(theta) else 0.0) + sum(phi[j] * psi[i - 1 - j] for j in range(min(i, len(phi))))
    auto = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)])
    cov = auto[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    return w @ np.linalg.solve(cov, w), np.linalg.slogdet(cov)[1]


def simulated(n, phi=(), theta=(), seed=0, burn=400):
    e = np.random.default_rng(seed).normal(size=n + burn)
    y = np.zeros(n + burn)
    for t in range(n + burn):
        y[t] = e[t] + sum(c * y[t - 1 - i] for i, c in enumerate(phi) if t > i) + sum(c * e[t - 1 - j] for j, c in enumerate(theta) if t > j)
    return y[burn:]


@pytest.mark.parametrize("order", [(1, 0, 0, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0, 0), (2, 0, 2, 0, 0, 0, 0), (1, 0, 1, 1, 0, 1, 4), (0, 0, 2, 0, 0, 1, 7)])
def test_errors_have_the_dense_likelihood(order):
    rng = np.random.default_rng(sum(order))
    model = A.Model(order)
    phi, theta, mean = model.full(rng.normal(size=(2, model.k)))
    w = rng.normal(size=160)
    errors, logs = A.first_errors(w[None, :] - mean[:, None], phi, theta)
    for i in range(2):
        quad, log = dense_likelihood(w - mean[i], phi[i], theta[i])
        assert errors[i] @ errors[i] == pytest.approx(quad, rel=1e-9) and logs[i] == pytest.approx(log, abs=1e-9)


def test_pieces_equal_the_plain_recursion():
    rng = np.random.default_rng(1)
    for n, q in ((1, 3), (5, 5), (700, 4), (3, 0)):
        x, theta, history = rng.normal(size=(2, n)), rng.normal(size=(2, q)) * 0.2, rng.normal(size=(2, q))
        e = np.zeros((2, n))
        for t in range(n):
            e[:, t] = x[:, t] - sum(theta[:, j] * (e[:, t - 1 - j] if t > j else history[:, j - t]) for j in range(q))
        assert np.allclose(A.run_errors(x, theta, history), e)


@pytest.fixture(scope="module")
def series():
    walk = np.cumsum(simulated(260, theta=[-0.5], seed=3))
    season = np.cumsum(simulated(260, theta=[-0.4, 0, 0, -0.5, 0.2], seed=5))
    for i in range(4, len(season)):
        season[i] += season[i - 4]
    return pd.concat([pd.DataFrame({"g": g, "i": range(len(y)), "y": y}) for g, y in (("season", season), ("arma", 20 + simulated(300, [0.7], [0.4], 2)), ("walk", walk), ("const", np.full(40, 3.0)), ("short", np.arange(2.0)))])


def test_fits_are_stationary_points_of_the_dense_likelihood(frame, series):
    rows = {r["g"]: r for r in A.arima_fit(frame(series), "y", ["i"], [(1, 0, 1, 0, 0, 0, 0)], ["g"]).collect()}
    r = rows["arma"]
    y = series[series["g"] == "arma"]["y"].to_numpy()

    def loss(ar, ma, mean):
        quad, log = dense_likelihood(y - mean, [ar], [ma])
        n = len(y)
        return 0.5 * (n * (np.log(2 * np.pi * quad / n) + 1) + log)

    at = (r["ar"][0], r["ma"][0], r["mean"])
    best = loss(*at)
    assert -r["log_likelihood"] == pytest.approx(best, rel=1e-9) and r["flatness"] < 1e-5
    for i in range(3):
        for step in (-0.01, 0.01):
            moved = list(at)
            moved[i] += step
            assert loss(*moved) > best
    assert abs(at[0] - 0.7) < 0.12 and abs(at[1] - 0.4) < 0.15 and "short" not in rows


def test_order_by_aic_and_no_more_than_others_explain(frame, series):
    df = frame(series)
    orders = [(0, 1, 1, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (2, 1, 2, 0, 0, 0, 0)]
    best = {r["g"]: r for r in A.arima_fit(df, "y", ["i"], orders, ["g"]).collect()}
    each = [{r["g"]: r["aic"] for r in A.arima_fit(df, "y", ["i"], [o], ["g"]).collect()} for o in orders]
    assert best["walk"]["aic"] == pytest.approx(min(e["walk"] for e in each)) and best["walk"]["q"] == 1
    assert best["walk"]["ma"][0] == pytest.approx(-0.5, abs=0.15)


@pytest.mark.parametrize("orders, keys", [([(1, 0, 1, 0, 0, 0, 0)], ["arma"]), ([(0, 1, 1, 0, 1, 1, 4), (1, 1, 0, 1, 0, 0, 4)], ["season"])])
def test_blocks_give_the_same_fit(frame, series, orders, keys):
    df = frame(series[series["g"].isin(keys)], 4)
    a = {r["g"]: r for r in A.arima_fit(df, "y", ["i"], orders, ["g"]).collect()}
    b = {r["g"]: r for r in A.arima_fit(df, "y", ["i"], orders, ["g"], block=90).collect()}
    assert set(a) == set(b) == set(keys)
    for g in a:
        assert [a[g][c] for c in ("p", "d", "q", "sp", "sd", "sq", "n")] == [b[g][c] for c in ("p", "d", "q", "sp", "sd", "sq", "n")]
        for c in ("ar", "ma", "seasonal_ar", "seasonal_ma"):
            assert np.allclose(a[g][c], b[g][c], atol=1e-5)
        assert a[g]["log_likelihood"] == pytest.approx(b[g]["log_likelihood"], rel=1e-8)
        assert np.allclose(a[g]["tail"], b[g]["tail"]) and np.allclose(a[g]["shocks"], b[g]["shocks"], atol=1e-4)


def test_one_series_without_groups_in_blocks(frame, series):
    df = frame(series[series["g"] == "arma"], 3)
    a, b = (A.arima_forecast(df, "y", ["i"], 4, [(1, 0, 1, 0, 0, 0, 0)], block=n).orderBy("step").toPandas() for n in (1000, 80))
    assert np.allclose(a["forecast"], b["forecast"], atol=1e-4) and np.allclose(a["high"], b["high"], atol=1e-4)


def test_forecasts_follow_the_recursion(frame):
    y = np.cumsum(simulated(200, [0.5], [0.3], 8))
    df = frame(pd.DataFrame({"i": range(200), "y": y}))
    fit = A.arima_fit(df, "y", ["i"], [(1, 1, 1, 0, 0, 0, 0)]).first()
    out = A.arima_forecast(df, "y", ["i"], 3, [(1, 1, 1, 0, 0, 0, 0)]).orderBy("step").collect()
    a, m, s = fit["ar"][0], fit["ma"][0], fit["sigma2"] ** 0.5
    change = a * (y[-1] - y[-2]) + m * fit["shocks"][0]
    want = [y[-1] + change, y[-1] + change + a * change, y[-1] + change + a * change + a * a * change]
    assert np.allclose([r["forecast"] for r in out], want)
    psi = np.cumsum([1.0, a + m, a * (a + m)])
    assert np.allclose([r["high"] - r["forecast"] for r in out], 1.959963984540054 * s * np.sqrt(np.cumsum(psi**2)))


def test_null_values_and_empty_tables(frame, series):
    some = series[series["g"] == "arma"].assign(y=lambda d: d["y"].where(d["i"] % 10 > 0))
    assert A.arima_fit(frame(some), "y", ["i"], [(1, 0, 0, 0, 0, 0, 0)], ["g"]).first()["n"] == 270
    assert A.arima_fit(frame(series).limit(0), "y", ["i"], by=["g"]).collect() == []
