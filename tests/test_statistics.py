"""Planted effects and closed-form answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.operators import bootstrap as B
from lodestat.operators import causal as CA
from lodestat.operators import clustering as K
from lodestat.operators import correlate as CO
from lodestat.operators import factor as FA
from lodestat.operators import glm as G
from lodestat.operators import hypothesis as H
from lodestat.operators import linear as L
from lodestat.operators import panel as P
from lodestat.operators import supervised as M
from lodestat.operators import survival as S
from lodestat.operators import whatif as W


@pytest.fixture(scope="module")
def lines():
    rng = np.random.default_rng(5)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    return pd.DataFrame({"k": range(n), "x1": x1, "x2": x2, "twin": 2.2 * x1 + .05 * rng.normal(size=n), "y": 3.5 * x1 - 2 * x2 + 1 + rng.normal(scale=.5, size=n)})


def coef(df, name="coefficient"):
    return {r["variable"]: r[name] for r in df.collect()}


def test_least_squares_and_robust_errors(frame, lines):
    df = frame(lines)
    x = np.column_stack([np.ones(len(lines)), lines["x1"], lines["x2"]])
    b = np.linalg.lstsq(x, lines["y"], rcond=None)[0]
    assert np.allclose(list(coef(L.ols_summary(df, "y", ["x1", "x2"])).values()), b)
    e, inv = lines["y"] - x @ b, np.linalg.inv(x.T @ x)
    hc1 = np.sqrt(np.diag(inv @ (x.T * (e ** 2).to_numpy()) @ x @ inv * len(lines) / (len(lines) - 3)))
    assert np.allclose(list(coef(L.ols_summary(df, "y", ["x1", "x2"], "hc1"), "std_error").values()), hc1)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    hc3 = np.sqrt(np.diag(inv @ (x.T * ((e / (1 - h)) ** 2).to_numpy()) @ x @ inv))
    assert np.allclose(list(coef(L.ols_summary(df, "y", ["x1", "x2"], "hc3"), "std_error").values()), hc3)


def test_collinearity_and_rank_loss(frame, lines):
    df = frame(lines).withColumn("copy", F.col("x1") * 2)
    v = {r["column"]: r["vif"] for r in CO.vif(df, ["x1", "x2", "twin"]).collect()}
    assert v["x1"] > 100 and v["x2"] < 1.2
    assert L.fit_ols(df, "y", ["x1", "copy", "x2"]).rank == 3
    assert math.isinf({r["column"]: r["vif"] for r in CO.vif(df, ["x1", "copy", "x2"]).collect()}["copy"])


def test_reset_sees_a_curve(frame, lines):
    df = frame(lines.assign(z=lines["x1"] + lines["x1"] ** 2))
    assert L.reset_test(df, "z", ["x1"]).first()["p"] < 1e-6 and L.reset_test(df, "y", ["x1", "x2"]).first()["p"] > 0.001


def test_logistic_and_counts(frame):
    rng = np.random.default_rng(6)
    n = 4000
    x = rng.normal(size=n)
    df = frame({"x": x, "b": (rng.random(n) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(int), "p": rng.poisson(np.exp(1 + .4 * x)),
                "nb": rng.negative_binomial(2, 2 / (2 + np.exp(1 + .4 * x))), "e": np.ones(n) * 2})
    assert coef(G.logistic_summary(df, "b", ["x"]))["x"] == pytest.approx(1.2, abs=.15)
    t, info = G.poisson(df, "p", ["x"])
    assert coef(t)["x"] == pytest.approx(.4, abs=.05) and info["dispersion"] < 1.2
    nb = G.count_model(df, "nb", ["x"])
    assert nb.first()["model"] == "negative_binomial" and coef(nb)["x"] == pytest.approx(.4, abs=.08)
    assert coef(G.poisson(df, "p", ["x"], "e")[0])["const"] == pytest.approx(1 - math.log(2), abs=.06)


def test_quantile_regression_matches_linear_programme_optimum(frame):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 4, 1500)
    y = 1 + 2 * x + (0.5 + x) * rng.normal(size=1500)
    out = G.quantile_regression(frame({"x": x, "y": y}), "y", ["x"], (.1, .5, .9)).toPandas()

    def loss(a, b, t):
        e = y - a - b * x
        return np.sum(e * (t - (e < 0)))

    for t, g in out.groupby("quantile"):
        a, b = g.set_index("variable")["coefficient"][["const", "x"]]
        best = min(loss(a + da, b + db, t) for da in np.linspace(-.2, .2, 21) for db in np.linspace(-.2, .2, 21))
        assert loss(a, b, t) <= best * 1.001
    s = out[out["variable"] == "x"].set_index("quantile")["coefficient"]
    assert s[.1] < s[.5] < s[.9]


def test_panel_estimators_recover_effects(frame):
    rng = np.random.default_rng(8)
    e = np.repeat(np.arange(40), 8)
    alpha = rng.normal(scale=3, size=40)[e]
    x1, x2 = rng.normal(size=320) + .5 * alpha, rng.normal(size=320)
    df = frame({"e": e, "x1": x1, "x2": x2, "y": alpha + 1.5 * x1 - .8 * x2 + rng.normal(scale=.5, size=320)})
    fe = coef(P.fixed_effects(df, "e", "y", ["x1", "x2"]))
    assert fe["x1"] == pytest.approx(1.5, abs=.1) and fe["x2"] == pytest.approx(-.8, abs=.1)
    # random effects against dense quasi-demeaned least squares
    g = pd.DataFrame({"e": e, "x1": x1, "x2": x2, "y": df.toPandas().sort_index()["y"]})
    m = g.groupby("e").transform("mean")
    within, means = g[["x1", "x2", "y"]] - m, g.groupby("e").mean()
    b = np.linalg.lstsq(within[["x1", "x2"]], within["y"], rcond=None)[0]
    s2 = ((within["y"] - within[["x1", "x2"]] @ b) ** 2).sum() / (320 - 40 - 2)
    xb = np.column_stack([np.ones(40), means[["x1", "x2"]]])
    sb = ((means["y"] - xb @ np.linalg.lstsq(xb, means["y"], rcond=None)[0]) ** 2).sum() / 37
    theta = 1 - np.sqrt(s2 / (s2 + 8 * max(0, sb - s2 / 8)))
    xr = np.column_stack([np.full(320, 1 - theta), g[["x1", "x2"]] - theta * m[["x1", "x2"]]])
    yr = g["y"] - theta * m["y"]
    br = np.linalg.lstsq(xr, yr, rcond=None)[0]
    re = coef(P.random_effects(df, "e", "y", ["x1", "x2"]))
    assert np.allclose([re["const"], re["x1"], re["x2"]], br)
    vr = np.linalg.inv(xr.T @ xr) * ((yr - xr @ br) ** 2).sum() / 317
    vf = np.linalg.inv(within[["x1", "x2"]].T.to_numpy() @ within[["x1", "x2"]].to_numpy()) * s2
    gap = b - br[1:]
    assert P.hausman(df, "e", "y", ["x1", "x2"]).first()["statistic"] == pytest.approx(max(0.0, gap @ np.linalg.pinv(vf - vr[1:, 1:]) @ gap))
    assert coef(P.pooled(df, "e", "y", ["x1", "x2"]))["x1"] > 1.7


def test_matching_recovers_effect(frame):
    rng = np.random.default_rng(9)
    n = 1500
    age = rng.normal(40, 10, n)
    tr = (rng.random(n) < 1 / (1 + np.exp(-(age - 40) / 8))).astype(int)
    df = frame({"id": range(n), "age": age, "treated": tr, "outcome": 2 * age + 20 * tr + rng.normal(size=n)})
    pairs = CA.propensity_matching(df, "treated", "outcome", ["age"], "id")
    assert CA.matching_effect(pairs).first()["att"] == pytest.approx(20, abs=1.0)
    b = CA.balance_table(df, pairs, "treated", ["age"]).first()
    assert abs(b["smd_after"]) < 0.1 < abs(b["smd_before"])


def test_instrument_and_did(frame):
    rng = np.random.default_rng(10)
    n = 3000
    z, u = rng.normal(size=n), rng.normal(size=n)
    x = z + u
    df = frame({"z": z, "x": x, "y": 2 * x + 3 * u + rng.normal(size=n), "t": rng.integers(0, 2, n), "p": rng.integers(0, 2, n)})
    r = CA.two_stage(df, "y", "x", "z").first()
    assert r["coefficient"] == pytest.approx(2, abs=.2) and r["ols"] > 3 and not r["weak"]
    d = df.withColumn("v", F.col("t") * 3 + F.col("p") * 2 + 45 * F.col("t") * F.col("p"))
    assert CA.did_cells(d, "v", F.col("t"), F.col("p")).first()["effect"] == pytest.approx(45)


def test_survival(frame):
    rng = np.random.default_rng(11)
    n = 1200
    x = rng.integers(0, 2, n)
    t = rng.exponential(1 / np.exp(.7 * x))
    c = rng.exponential(3, n)
    df = frame({"t": np.minimum(t, c), "d": (t <= c).astype(int), "x": x})
    hr = {r["variable"]: r["hazard_ratio"] for r in S.cox(df, "t", "d", ["x"]).collect()}["x"]
    assert math.log(hr) == pytest.approx(.7, abs=.15)
    assert S.log_rank_p(df, "t", "d", "x").first()["p"] < 1e-6
    a = S.kaplan_meier(df, "t", "d").orderBy("time").toPandas()
    b = S.kaplan_meier(df, "t", "d", rows_per_slice=60).orderBy("time").toPandas()
    assert np.allclose(a["survival"], b["survival"]) and a["at_risk"].tolist() == b["at_risk"].tolist()
    last = S.kaplan_meier(frame({"t": [1.0, 2.0], "d": [1, 1]}), "t", "d").orderBy("time").toPandas()
    assert last["survival"].tolist() == [.5, 0.0]


def test_breaks(frame):
    rng = np.random.default_rng(12)
    x = rng.normal(size=200)
    y = np.where(np.arange(200) < 90, 2 * x, -4 * x) + rng.normal(scale=.3, size=200)
    df = frame({"i": range(200), "x": x, "y": y})
    r = L.strongest_break(df, "y", ["x"], ["i"], rows_per_slice=30).first()
    assert abs(r["split"] - 90) <= 2 and r["p"] < 1e-6
    assert L.chow_test(df, "y", ["x"], F.col("i") < 90).first()["f"] == pytest.approx(
        L.chow_scan(df, "y", ["x"], ["i"]).where("split = 90").first()["f"], rel=1e-6)


def test_group_tests(frame):
    rng = np.random.default_rng(13)
    df = frame({"g": np.repeat(["a", "b"], 60), "v": np.concatenate([rng.normal(55, 5, 60), rng.normal(45, 5, 60)]), "e": rng.normal(size=120)})
    r = H.compare_means(df, "g", "v").first()
    assert r["test"] in ("student", "welch") and r["significant"] and r["effect"] > 1.2
    assert H.equivalence_p(df, "g", "e", 1.5).first()["equivalent"]
    p = H.power_two_groups(df, "g", "v").first()
    assert p["power"] > .99 and p["detectable_d"] == pytest.approx(.516, abs=.02)
    with pytest.raises(ValueError):
        H.compare_means(df.where("g = 'a'"), "g", "v")


def test_post_hoc_pairs(frame):
    rng = np.random.default_rng(14)
    df = frame({"g": np.repeat(list("abcd"), 50), "v": np.concatenate([rng.normal(m, 1, 50) for m in (0, 0, 0, 3)])})
    out = H.post_hoc(df, "g", "v").toPandas()
    assert len(out) == 6 and (out["p"] < .05).sum() == 3


def test_false_discovery_slices_agree(frame):
    rng = np.random.default_rng(15)
    t = frame({"test": range(300), "p": rng.random(300) ** 3})
    a = H.benjamini_hochberg(t).orderBy("test").toPandas()["q"]
    b = H.benjamini_hochberg(t, rows_per_slice=20).orderBy("test").toPandas()["q"]
    assert np.allclose(a, b)


def test_bootstrap_is_partition_free_and_sane(frame):
    rng = np.random.default_rng(16)
    data = {"k": range(800), "v": rng.normal(10, 2, 800), "w": rng.normal(size=800)}
    a = B.bootstrap_ci(frame(data, 1), "v", ["k"], ["mean", "std", "median"], 400).toPandas()
    b = B.bootstrap_ci(frame(data, 13), "v", ["k"], ["mean", "std", "median"], 400).toPandas()
    assert np.allclose(a.iloc[:, 1:], b.iloc[:, 1:])
    half = a.set_index("statistic").loc["mean"]
    assert half["ci_high"] - half["ci_low"] == pytest.approx(2 * 1.96 * 2 / math.sqrt(800), rel=.2)
    assert (a["ci_low"] < a["estimate"]).all() and (a["estimate"] < a["ci_high"]).all()


def test_components(frame, lines):
    x = lines[["x1", "x2", "twin"]]
    vals = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    df = frame(lines)
    assert np.allclose([r["eigenvalue"] for r in FA.pca_variance(df, list(x.columns)).collect()], vals)
    s = FA.pca_scores(df, list(x.columns), 2).toPandas()
    assert s["axis1"].var(ddof=0) == pytest.approx(vals[0], rel=1e-6) and abs(np.corrcoef(s["axis1"], s["axis2"])[0, 1]) < 1e-6


def test_correspondence_matches_dense_svd(frame):
    rng = np.random.default_rng(17)
    a, b = rng.integers(0, 4, 600), rng.integers(0, 3, 600)
    b = np.where(rng.random(600) < .4, a % 3, b)
    df = frame({"a": a.astype(str), "b": b.astype(str)})
    n = pd.crosstab(a, b).to_numpy()
    p = n / n.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, v = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)))
    out = FA.correspondence(df, "a", "b", 2).toPandas()
    assert np.allclose(sorted(out["inertia"].unique())[::-1], s[:2] ** 2)
    got = out[(out["variable"] == "a") & (out["axis"] == 1)].sort_values("level")["coordinate"].to_numpy()
    assert np.allclose(np.abs(got), np.abs(u[:, 0] * s[0] / np.sqrt(r)))


def test_density_clusters_equal_brute_force(frame):
    rng = np.random.default_rng(18)
    pts = np.concatenate([rng.normal([0, 0], .15, (120, 2)), rng.normal([3, 3], .2, (80, 2)), rng.uniform(-3, 6, (40, 2)), np.tile([[1.5, -2.0]], (30, 1))])
    eps, mp = .35, 6
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= mp
    label = -np.ones(len(pts), int)
    k = 0
    for i in range(len(pts)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = k
            while stack:
                j = stack.pop()
                for m in np.flatnonzero(d[j]):
                    if label[m] < 0:
                        label[m] = k
                        if core[m]:
                            stack.append(m)
            k += 1
    df = frame({"id": range(len(pts)), "x": pts[:, 0], "y": pts[:, 1]})
    got = K.density_clusters(df, ["x", "y"], "id", eps, mp, standardise=False, rows_per_task=10).toPandas()
    got = got.assign(id=got["id"].astype(int)).sort_values("id")["cluster"].to_numpy()
    assert ((got < 0) == (label < 0)).all()
    same = got[core][:, None] == got[core][None]
    assert (same == (label[core][:, None] == label[core][None])).all()


def test_components_of_a_long_chain(spark):
    n = 300
    e = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b").where("a <> 99")
    out = K.connected_components(e, spark.range(n).selectExpr("id AS node")).toPandas().set_index("node")["label"].sort_index()
    assert (out[:100] == 0).all() and (out[100:] == 100).all()


def test_k_means_and_discriminant(frame):
    rng = np.random.default_rng(19)
    y = np.repeat([0, 1], 60)
    df = frame({"k": range(120), "x": rng.normal(5 * y, 1), "z": rng.normal(5 * y, 1), "y": y})
    rows, tried = K.k_means(df, ["x", "z"], (2, 3, 4))
    assert max(tried, key=lambda t: t[1])[0] == 2 and rows.select("cluster").distinct().count() == 2
    for q in (False, True):
        assert M.classification_metrics(M.GaussianClassifier(q).fit(df, ["x", "z"], "y").transform(df), "y", "prediction").first()["accuracy"] > .97


def test_model_comparison_ranks_and_reports(frame):
    rng = np.random.default_rng(20)
    x = rng.normal(size=300)
    df = frame({"k": range(300), "x": x, "noise": rng.normal(size=300), "y": 3 * x + rng.normal(scale=.3, size=300)})
    out = M.compare_models(df, "y", "k", False, names=["linear", "decision_tree"], k=2).toPandas()
    assert out["model"].tolist()[0] == "linear" and out["model"].tolist()[-1] == "naive" and out["r2"].iloc[0] > .95


def test_permutation_finds_the_driver(frame):
    rng = np.random.default_rng(21)
    df = frame({"k": range(300), "a": rng.normal(size=300), "b": rng.normal(size=300)}).withColumn("y", F.col("a") * 4)
    t = M.permutation_importance(df, lambda d: d.withColumn("prediction", F.col("a") * 4), ["a", "b"], "y", "k", repeats=2).toPandas().set_index("feature")["importance"]
    assert t["a"] > 1 and abs(t["b"]) < 1e-9


def test_noise_scoring_centres_on_the_mean(frame):
    df = frame({"k": range(500), "a": np.linspace(0, 1, 500)})
    r = W.noise_scoring(df, lambda x: 2 * x[:, 0], ["a"], ["k"], noise=.1, copies=60).first()
    assert r["mean"] == pytest.approx(1.0, abs=.005) and 0 < r["std"] < .01


def test_fits_read_their_rows_once(frame):
    """A fit's steps read written rows, not the join behind them."""
    from pyspark.sql import functions as F
    from lodestat.operators import glm

    left = frame({"k": list(range(60)), "x": [float(i % 5) for i in range(60)]})
    right = frame({"k2": list(range(60)), "y": [float((i * 7) % 4 + i % 5) for i in range(60)], "e": [1.0 + i % 3 for i in range(60)]})
    df = left.join(right, F.col("k") == F.col("k2"))
    _, wide = glm._glm(df, "y", ["x"], "poisson", "log", F.log("e"))
    assert "Join" not in wide._jdf.queryExecution().optimizedPlan().toString() and wide.count() == 60
    assert glm.negative_binomial(df, "y", ["x"], 0.2, "e").count() == 2


def test_wide_cross_products_equal_the_aggregates(frame):
    """Many columns are multiplied as matrices; the block is that of the aggregates, rows with a missing value left out."""
    from lodestat.operators import gram as G
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, G.WIDE + 2)) + 1000
    x[3, 1], x[7, 4] = np.nan, np.nan
    df = frame({f"c{i}": x[:, i] for i in range(x.shape[1])}, 7)
    df = df.withColumn("c2", F.when(F.col("c0") < 1001.5, F.col("c2")))
    a, few = G.gram(df, df.columns), G.complete(df, df.columns)
    plain = G.gram(few, df.columns[:8])
    assert a.n == plain.n == few.count() < 298
    assert np.allclose(a.mean[:8], plain.mean, rtol=1e-12) and np.allclose(a.cross[:8, :8], plain.cross, rtol=1e-9, atol=1e-9)
    assert G.gram(df.limit(0), df.columns).n == 0


def test_unit_root_test_with_many_lags_ends_soon(frame):
    """75 lags are one matrix product a batch, not 3003 aggregates."""
    import time
    from lodestat.operators import stationarity as S
    y = np.random.default_rng(6).normal(size=3000)
    start = time.monotonic()
    tau, p, _, n = S.adf(frame({"t": range(3000), "y": y}), "y", ["t"], max_lag=75)
    assert tau < -20 and p < 0.01 and n > 2900 and time.monotonic() - start < 40


@pytest.mark.parametrize("trend", [False, True])
def test_lags_made_in_tasks_are_those_of_the_windows(frame, monkeypatch, trend):
    from lodestat.operators import gram as G
    from lodestat.operators import stationarity as S
    monkeypatch.setattr(S, "LAG_ROWS", 40)
    y = np.random.default_rng(8).normal(size=300).cumsum()
    df = frame({"t": range(300), "y": y}, 4)
    a = S.lag_gram(S._placed(df, "y", ["t"]), 6, trend)
    b = G.gram(S._lagged(df, "y", ["t"], 6), a.names)
    assert a.n == b.n == 293 and np.allclose(a.mean, b.mean) and np.allclose(a.cross, b.cross)


def test_many_lag_products_are_made_in_tasks(frame, monkeypatch):
    from lodestat.operators import stationarity as S
    monkeypatch.setattr(S, "LAG_ROWS", 50)
    v = np.random.default_rng(9).normal(size=260)
    df = frame({"i": range(260), "e": v}, 4)
    for lags in (60, 259):
        assert np.allclose(S.autocovariances(df, "e", lags), [v[k:] @ v[:-k] for k in range(1, lags + 1)])
    assert np.allclose(S.autocovariances(df, "e", 5), [v[k:] @ v[:-k] for k in range(1, 6)])
