import math

from lodestat.operators.neighbours import nearest
from lodestat.operators.transforms import transform
from lodestat.plans.sqlview import run_sql
from lodestat.sources.readers import read_csv


def test_csv_fields_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"one\nline"\n2,plain\n3,"with ""quotes"" and, comma"\n')
    got = {r["id"]: r["note"] for r in read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {1: "one\nline", 2: "plain", 3: 'with "quotes" and, comma'}


def test_power_zero_is_the_logarithm(frame):
    df = frame({"v": [100.0, 10.0, 1.0]})
    got = transform(df, "v", "boxcox", lam=0.0)
    new = [c for c in got.columns if c != "v"][0]
    assert sorted(round(r[new], 6) for r in got.collect()) == [round(math.log(v), 6) for v in (1.0, 10.0, 100.0)]


def test_user_sql_leaves_the_callers_views(spark, frame):
    frame({"x": [1]}).createOrReplaceTempView("df")
    assert run_sql("SELECT sum(x) AS s FROM df", df=frame({"x": [5, 6]})).first()["s"] == 11
    assert spark.table("df").first()["x"] == 1
    spark.catalog.dropTempView("df")


def test_many_neighbours_and_incomplete_rows(spark, frame):
    donors = frame({"d": list(range(300)), "a": [float(k) for k in range(300)], "b": [0.5 * k for k in range(300)]})
    queries = spark.createDataFrame([(1, 0.0, 0.0), (2, 299.0, 149.5), (3, None, 1.0)], "q long, a double, b double")
    got = nearest(queries, donors, ["a", "b"], k=100, query_id="q", donor_id="d").toPandas()
    assert got.groupby("q").size().to_dict() == {1: 100, 2: 100}
    assert set(got[got.q == 1].d) == set(range(100)) and set(got[got.q == 2].d) == set(range(200, 300))
