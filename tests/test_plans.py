import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.plans import diagnose as D
from lodestat.plans import explore as E
from lodestat.plans import recipe as R
from lodestat.plans import sqlview as V
from lodestat.sources.versions import Dataset


def test_exploration_follows_facts(frame):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=n)
    g = rng.choice(["p", "q"], n)
    df = frame({"x": x, "noise": rng.normal(size=n), "g": g, "y": np.where(g == "p", 2.0, -2.0) * x + 3 * (g == "p") + rng.normal(scale=.3, size=n)})
    ctx = E.build_context(df, "y", kinds={"x": "continuous", "noise": "continuous", "g": "binary", "y": "continuous"})
    events = []
    s = E.explore(ctx, 60, [p for p in E.PROBES if p.key != "predictive_power"], lambda k, v: events.append(k))
    kinds = {f.kind for f in s.findings}
    assert "sign_reversal" in kinds and "group_difference" in kinds and "simpson" in ctx.facts
    assert "probe" in events and all(f.q is None or f.q >= f.p - 1e-12 for f in s.findings)
    assert E.findings_table(df.sparkSession, s.findings).count() == len(s.findings)


def test_quadratic_link_is_seen_without_correlation(frame):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, 2000)
    ctx = E.build_context(frame({"x": x, "noise": rng.normal(size=2000), "y": x ** 2}), "y", kinds={"x": "continuous", "noise": "continuous", "y": "continuous"})
    assert ctx.ranking[0][0] == "x"
    assert [f.kind for f in E.probe_association(ctx)] == ["nonlinear_association"]


def test_ranking_spreads_over_variables():
    f = [E.Finding("p", str(i), v, e, "m", 500, 1e-9) for i, (v, e) in enumerate([(("a", "b"), .9), (("a", "c"), .85), (("d", "e"), .6)])]
    assert [x.variables[0] for x in E.rank(f)] == ["a", "d", "a"]


def test_correction_helps_and_protects_the_target(frame):
    rng = np.random.default_rng(2)
    n = 300
    x = np.exp(rng.normal(size=n) * 1.2)
    df = frame({"k": range(n), "x": x, "copy": x * 2 + rng.normal(scale=.01, size=n), "one": np.ones(n), "y": x + rng.normal(size=n)})
    c = D.correct(df, "y", skip=["k"], rounds=4)
    assert "y" in c.frame.columns and "one" not in c.frame.columns and len({"x", "copy"} & set(c.frame.columns)) == 1
    assert c.rounds[0].kept and c.rounds[0].after < c.rounds[0].before


def test_remedies_are_not_repeated_or_stacked():
    issues = [D.Issue("skewed", ("x",), .9, 2, [D.Remedy("log", ("x",), True), D.Remedy("boxcox", ("x",), True)]), D.Issue("outliers", ("x",), .5, .1, [D.Remedy("winsorize", ("x",))])]
    tried = set()
    assert [r.action for r in D.choose_remedies(issues, tried, set())] == ["log"]
    assert [r.action for r in D.choose_remedies(issues, tried, {"x"})] == []


def test_recipe_conditions(frame):
    df = frame({"k": range(120), "a": np.arange(120) * 1.5, "b": np.arange(120) % 7 * 1.1, "g": ["u", "v"] * 60})
    f = R.TableFacts(120, {"k": "identifier", "a": "continuous", "b": "continuous", "g": "nominal"}, .2, .0, [], None, "a", "regression")
    names = [s.name for s in R.build_recipe(f)]
    assert names[0] == "clean" and "correlate" not in names and "compare_groups" in names and "forecast" not in names
    assert R.build_recipe(f)[0].options["actions"] == ["duplicates"]


def test_versions(spark, frame, tmp_path):
    ds = Dataset(spark, str(tmp_path / "d"))
    assert ds.latest() == 0
    ds.write(frame({"a": [1, 2, 3]}), "raw")
    assert V.sql_to_version(ds, "SELECT a FROM df WHERE a > 1") == 2
    assert ds.restore(1) == 3 and ds.read().count() == 3 and ds.read(2).count() == 2
    assert [r["parent"] for r in ds.history().collect()] == [None, 1, 1]


def test_sql_accepts_only_selects(frame):
    df = frame({"a": [1]})
    with pytest.raises(ValueError):
        V.run_sql("DROP TABLE x", df=df)
    assert V.run_sql("WITH t AS (SELECT a + 1 AS b FROM df) SELECT b FROM t;", df=df).first()[0] == 2


def test_boundaries(frame, spark):
    from lodestat.operators import describe
    empty = spark.createDataFrame([], "a double, b string")
    assert describe.duplicate_summary(empty).first()["duplicates"] == 0
    assert describe.numeric_descriptive(empty, ["a"]).first()["count"] == 0
    one = describe.numeric_descriptive(frame({"a": [42.0]}), extended=True).first()
    assert one["std"] is None and one["skewness"] is None and one["median"] == 42.0
    flat = describe.shape_moments(frame({"a": [42.0] * 5}), ["a"]).first()
    assert flat["skewness"] is None
    assert describe.tukey_bounds(frame({"a": [1.0] * 20}), ["a"]).first()["lower"] is None


@pytest.fixture()
def folder(spark, frame, tmp_path):
    """A table folder with a few events, customers and orders."""
    n = 60
    rng = np.random.default_rng(3)
    frame({"event_id": range(n), "value": rng.integers(0, 9, n) + 0.5}).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_catalogue_transforms_do_not_stack(spark, folder, monkeypatch):
    """Each transform starts from the table, so that none runs the ones before it again."""
    from lodestat.operators import transforms as X
    from lodestat.queries import load_all
    from lodestat.queries.registry import QUERIES

    load_all()
    whole, seen = X.transform, []
    monkeypatch.setattr(X, "transform", lambda df, col, key, *a, **kw: seen.append((key, sorted(df.columns))) or whole(df, col, key, *a, **kw))
    rows = QUERIES["b30_transform_catalogue"](spark, folder).collect()
    assert [k for k, _ in seen] == list(X.CATALOGUE) and {tuple(c) for _, c in seen} == {("event_id", "value")}
    assert [r["column"] for r in rows] == [f"value_{k}" for k in X.CATALOGUE]


def _file_names(df):
    return {str(f).rsplit("/", 1)[0] for f in df.inputFiles()}


def test_context_table_is_written_once(frame):
    """Probes read one written table instead of the joins behind it."""
    left = frame({"k": list(range(40)), "x": [float(i % 7) for i in range(40)]})
    right = frame({"k2": list(range(40)), "y": [float(i % 7) * 2 + i % 2 for i in range(40)]})
    ctx = E.build_context(left.join(right, F.col("k") == F.col("k2")).drop("k2"), "y", kinds={"x": "continuous", "y": "continuous"})
    plan = ctx.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(_file_names(ctx.frame)) == 1
    assert ctx.rows == ctx.frame.count() == 40
    bare = E.build_context(left.withColumn("nothing", F.lit(None)), None, kinds={"x": "continuous"})
    assert bare.frame.count() == 40 and "nothing" in bare.frame.columns


def test_exploration_keeps_its_time_axis(spark, tmp_path, monkeypatch):
    """The query hands over the order date, so that stationarity, trend, granger and break are among its probes."""
    from lodestat.queries import load_all
    from lodestat.queries.registry import QUERIES
    load_all()
    folder = str(tmp_path)
    spark.range(60).selectExpr("id AS o_orderkey", "id % 5 AS o_custkey", "CAST(1000 + id * 37 % 91 AS DOUBLE) AS o_totalprice", "date_add(DATE'1995-01-01', CAST(id AS INT)) AS o_orderdate",
                               "concat('p', id % 2) AS o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    spark.range(5).selectExpr("id AS c_custkey", "CAST(id * 7 % 3 AS DOUBLE) AS c_acctbal", "concat('s', id % 3) AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    seen = []
    monkeypatch.setattr(E, "explore", lambda ctx, *a, **kw: seen.append(ctx) or E.Session(ctx, [], []))
    QUERIES["h02_exploration"](spark, folder)
    fitting = {p.key for p in E.PROBES if p.fits(seen[0])}
    assert seen[0].time == "o_orderdate" and {"stationarity", "trend", "granger", "structural_break"} <= fitting


def test_dates_without_a_declared_kind_are_the_time_axis(spark):
    df = spark.range(30).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS y", "date_add(DATE'2000-01-01', CAST(id AS INT)) AS day")
    assert E.build_context(df, "y", kinds={"y": "continuous"}).time == "day"
