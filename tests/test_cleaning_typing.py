import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.functions import casts
from lodestat.operators import cleaning as C
from lodestat.operators import transforms as X
from lodestat.operators import typing as T
from lodestat.operators.neighbours import nearest
from lodestat.sources import readers as R


def test_dirty_numbers(spark):
    df = spark.createDataFrame([("1 250,50",), ("75%",), (" 42 ",), ("N/A",), ("erreur_saisie",), ("1 000",), ("2d",)], "x string")
    assert [r[0] for r in df.select(casts.to_number(F.col("x"))).collect()] == [1250.5, 75.0, 42.0, None, None, 1000.0, None]


def test_dirty_booleans_and_report(spark):
    df = spark.createDataFrame([("oui",), ("non",), ("peut-être",), ("inconnu",), (None,)], "x string")
    assert [r[0] for r in df.select(casts.to_boolean(F.col("x"))).collect()] == [True, False, None, None, None]
    r = T.conversion_report(df, {"x": "bool"}).first()
    assert (r["total"], r["valid"], r["lost"], r["original_null"], r["lossless"]) == (5, 2, 2, 1, False)
    assert r["samples"] == ["inconnu", "peut-être"] and r["loss_rate"] == 0.5


def test_type_aliases_and_names():
    assert T.canonical_type("Booléen".lower().replace("é", "e")) == "binary" and T.canonical_type("numerique") == "continuous"
    assert T.unit_of_name("temp_°C") == ("°C", "temperature") and T.unit_of_name("poids_kg") == ("kg", "mass") and T.unit_of_name("plain") is None
    assert T.humanise("chiffreAffaires_total") == "Chiffre Affaires Total"


def test_years_and_identifiers_are_not_measures(frame):
    rng = np.random.default_rng(0)
    df = frame({"id_observation": range(60), "annee": [1960 + i for i in range(60)], "precip": rng.normal(size=60), "temp": rng.normal(size=60)})
    kinds = T.column_types(df)
    assert kinds["annee"] == "temporal" and kinds["id_observation"] == "identifier" and kinds["precip"] == "continuous"
    assert T.analysable_columns(df) == ["precip", "temp"]


@pytest.mark.parametrize("texts", [["15 janvier 2024", "3 août 2023", "lundi 5 février 2024"], ["2021-W01", "2021-W17", "2022-S40"], ["31/12/2023", "01/02/2024", "15/03/2024"],
                                   ["Jan 15, 2024", "Mar 3, 2024", "Dec 25, 2023"], ["202101", "202102", "202112"]])
def test_date_layouts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    out = T.parse_dates(df, "d", "p").collect()
    assert all(r["p"] is not None for r in out)


def test_month_first_vote(spark):
    df = spark.createDataFrame([("01/31/2024",), ("02/20/2024",), ("03/04/2024",)], "d string")
    assert not T.day_first_vote(df, "d")
    assert [str(r["p"].date()) for r in T.parse_dates(df, "d", "p").collect()] == ["2024-01-31", "2024-02-20", "2024-03-04"]


def test_imputation_and_encoding_edges(frame):
    df = frame({"a": [1.0, None, 3.0], "b": ["x", None, "x"], "e": [None, None, None]}).withColumn("e", F.col("e").cast("string"))
    df = df.withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    out = C.impute(df, {"a": "mean", "b": "mode", "e": "mode"}).toPandas()
    assert out["a"].tolist() == [1.0, 2.0, 3.0] and out["b"].tolist() == ["x"] * 3 and out["e"].tolist() == ["Inconnu"] * 3


def test_formula_rejects_anything_but_arithmetic(frame):
    df = frame({"a": [1.0, 2.0], "b": [3.0, 0.0]})
    assert [r["c"] for r in X.compute_column(df, "c", "a / b + abs(-a) ** 2").collect()] == [1 / 3 + 1, None]
    for bad in ("__import__('os')", "a.b", "open(a)", "a if b else a", "missing + 1", ""):
        with pytest.raises(ValueError):
            X.formula(bad, df.columns)


def test_power_transforms_recover_lambda(frame):
    rng = np.random.default_rng(1)
    df = frame({"x": np.exp(rng.normal(size=3000)), "y": rng.normal(size=3000)})
    assert abs(X.boxcox_lambda(df, F.col("x"))) < 0.08
    assert abs(X.boxcox_lambda(df, F.col("y"), yeo_johnson=True) - 1) < 0.08


def test_nearest_equals_brute_force(frame):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"did": range(400), "a": np.where(rng.random(400) < .3, 0.0, rng.normal(size=400)), "b": rng.normal(size=400), "c": rng.normal(size=400)})
    q = pd.DataFrame({"qid": range(40), "a": rng.normal(size=40), "b": rng.normal(size=40), "c": rng.normal(size=40)})
    got = nearest(frame(q), frame(d), ["a", "b", "c"], "qid", "did", 5, window=4).toPandas().sort_values(["qid", "rank"])
    sd = d[["a", "b", "c"]].std(ddof=1).to_numpy()
    dist = np.sqrt((((q[["a", "b", "c"]].to_numpy()[:, None] - d[["a", "b", "c"]].to_numpy()[None]) / sd) ** 2).sum(-1))
    assert np.allclose(got["distance"].to_numpy().reshape(40, 5), np.sort(dist, axis=1)[:, :5])


def test_isolation_scores_find_the_far_rows(frame):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500), [25.0, -30.0]])
    top = C.isolation_scores(frame({"k": range(502), "x": x}), ["x"], "k", trees=40).orderBy(F.desc("anomaly_score")).limit(2).toPandas()
    assert set(top["k"]) == {500, 501}


def test_csv_sniffing_headers_and_bad_lines(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_bytes("nom;ville;;nom\nAndré;Orléans;1;x\nZoé;Nîmes;2;y\ncassé;1;2;3;4;5\n".encode("cp1252"))
    df = R.read_csv(spark, str(p))
    assert df.columns == ["nom", "ville", "Colonne_3", "nom_1"]
    assert sorted(r["nom"] for r in df.collect()) == ["André", "Zoé"]
    assert R.read_csv(spark, str(p), keep_bad_lines=True).count() == 1


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": {"c": {"d": {"e": {"f": 1}}}}}]')
    df = R.read_json(spark, str(tmp_path / "a.json"))
    assert df.columns == ["a", "b.c.d.e"] and df.first()[1] == '{"f":1}'
    (tmp_path / "o.json").write_text('{"meta": "x", "rows": [{"a": 1}, {"a": 2}], "other": [{"z": 1}]}')
    assert [r["a"] for r in R.read_json(spark, str(tmp_path / "o.json")).collect()] == [1, 2]
    with pytest.raises(ValueError):
        R.read_table(spark, "x.parquetx")
