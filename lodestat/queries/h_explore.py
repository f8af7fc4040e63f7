"""Exploration probes and the diagnose-correct loop."""

from pyspark.sql import functions as F

from lodestat.functions.expr import local_rows, rnd
from lodestat.plans import diagnose as D
from lodestat.plans import explore as E
from lodestat.plans import recipe as R
from lodestat.queries.b_transforms import HOLES_SQL, holes
from lodestat.queries.c_describe import rounded
from lodestat.queries.registry import query
from lodestat.session import cut_lineage


def flat(t):
    """Orders with customer facts and planted effects: price depends on balance, and on segment."""
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    lift = F.expr("CASE c_mktsegment WHEN 'MACHINERY' THEN 4000 WHEN 'BUILDING' THEN -4000 ELSE 0 END")
    return df.select("o_orderkey", "o_orderdate", "c_mktsegment", "o_orderpriority", "c_acctbal", (F.col("o_totalprice") / 100).alias("noise"),
                     (F.col("c_acctbal") * 2 + F.col("o_totalprice") / 100 + lift).alias("spend"))


FLAT_SQL = """flat AS (SELECT o_orderkey, o_orderdate, c_mktsegment, o_orderpriority, c_acctbal, o_totalprice/100 AS noise,
 c_acctbal*2 + o_totalprice/100 + CASE c_mktsegment WHEN 'MACHINERY' THEN 4000 WHEN 'BUILDING' THEN -4000 ELSE 0 END AS spend FROM orders JOIN customer ON o_custkey=c_custkey)"""
KINDS = {"o_orderkey": "identifier", "o_orderdate": "temporal", "c_mktsegment": "nominal", "o_orderpriority": "nominal", "c_acctbal": "continuous", "noise": "continuous", "spend": "continuous"}


def context(t, target="spend", kinds=KINDS):
    return E.build_context(flat(t), target, None, "o_orderkey", kinds)


def found(ctx, probe):
    return local_rows(ctx.frame.sparkSession, [(f.kind, ",".join(f.variables), float(f.effect)) for f in probe(ctx)], "kind string, variables string, effect double")


@query("h01_context")
def _(t):
    return E.context_table(context(t))


@query("h02_exploration")
def _(t):
    return E.findings_table(t.spark, E.explore(context(t)).findings)


@query("h03_ranked_findings")
def _(t):
    ctx = E.build_context(t.lineitem.select("l_quantity", "l_extendedprice", (F.col("l_quantity") * 2 + F.col("l_tax") * 100).alias("twin"), "l_tax"), None, kinds={
        "l_quantity": "continuous", "l_extendedprice": "continuous", "twin": "continuous", "l_tax": "continuous"})
    return E.findings_table(t.spark, E.rank(E.control_false_discovery(E.probe_pairs(ctx) + E.probe_axes(ctx))))


@query("h04_probe_association", f"""
WITH {FLAT_SQL}, r AS (SELECT unnest(['c_acctbal','noise']) c, unnest([corr(c_acctbal,spend), corr(noise,spend)]) r FROM flat)
SELECT 'linear_association' AS kind, c || ',spend' AS variables, round(r,6) AS effect FROM r WHERE abs(r) >= .2""")
def _(t):
    return rounded(found(context(t), E.probe_association), 6)


@query("h05_probe_redundancy", f"""
WITH {FLAT_SQL} SELECT 'redundant_pair' AS kind, 'c_acctbal,twin' AS variables, round(corr(c_acctbal, c_acctbal*3 + o_orderkey % 100),6) AS effect FROM flat""")
def _(t):
    ctx = context(t)
    ctx.frame = ctx.frame.withColumn("twin", F.col("c_acctbal") * 3 + F.col("o_orderkey") % 100)
    ctx.ranking, ctx.numeric = [("c_acctbal", 1.0), ("twin", .9), ("noise", .5)], ["c_acctbal", "twin", "noise"]
    return rounded(found(ctx, E.probe_redundancy), 6)


@query("h06_probe_group_difference", f"""
WITH {FLAT_SQL}, g AS (SELECT 'c_mktsegment' AS c, c_mktsegment AS k, spend FROM flat UNION ALL SELECT 'o_orderpriority', o_orderpriority, spend FROM flat), m AS (SELECT c, k, count(*) n, avg(spend) m, var_samp(spend) v FROM g GROUP BY 1,2),
w AS (SELECT c, sum(n*m)/sum(n) gm FROM m GROUP BY 1), e AS (SELECT m.c, sum(n*pow(m-gm,2))/(sum(n*pow(m-gm,2))+sum((n-1)*v)) e FROM m JOIN w USING (c) GROUP BY 1)
SELECT 'group_difference' AS kind, c || ',spend' AS variables, round(sqrt(e),6) AS effect FROM e WHERE e >= .02""")
def _(t):
    return rounded(found(context(t), E.probe_group_difference), 6)


@query("h07_probe_categorical_link", """
WITH b AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' AND l_orderkey % 3 > 0 THEN 'yes' WHEN l_orderkey % 4 = 0 THEN 'yes' ELSE 'no' END AS link FROM lineitem),
c AS (SELECT l_returnflag a, link b, count(*)::DOUBLE o FROM b GROUP BY 1,2), m AS (SELECT o, sum(o) OVER (PARTITION BY a)*sum(o) OVER (PARTITION BY b)/sum(o) OVER () e, sum(o) OVER () n FROM c)
SELECT 'categorical_link' AS kind, 'l_returnflag,link' AS variables, round(sqrt(sum(pow(o-e,2)/e)/any_value(n)),6) AS effect FROM m""")
def _(t):
    df = t.lineitem.select("l_returnflag", "l_linestatus", F.expr("CASE WHEN l_returnflag = 'R' AND l_orderkey % 3 > 0 THEN 'yes' WHEN l_orderkey % 4 = 0 THEN 'yes' ELSE 'no' END").alias("link"))
    ctx = E.build_context(df, "link", kinds={"l_returnflag": "nominal", "l_linestatus": "binary", "link": "binary"})
    return rounded(found(ctx, E.probe_categorical_link), 6)


@query("h08_probe_target_shape", """
WITH s AS (SELECT count(value)::DOUBLE n, skewness(value)*(count(value)-2)/sqrt(count(value)::DOUBLE*(count(value)-1)) g1, quantile_cont(value,.25) a, quantile_cont(value,.75) b FROM events),
o AS (SELECT avg((value < a-1.5*(b-a) OR value > b+1.5*(b-a))::INT) r FROM events, s)
SELECT 'skewed_target' AS kind, 'value' AS variables, round(least(1,abs(g1)/3),6) AS effect FROM s WHERE abs(g1) >= .8 UNION ALL SELECT 'extreme_values', 'value', round(least(1,r*5),6) FROM o WHERE r >= .01""")
def _(t):
    ctx = E.build_context(t.events.select("value", "event_type"), "value", kinds={"value": "continuous", "event_type": "nominal"})
    return rounded(found(ctx, E.probe_target_shape).where("kind <> 'not_normal'"), 6)


@query("h09_probe_class_balance", """
SELECT 'class_imbalance' AS kind, 'rare' AS variables, round(1-min(n)/max(n)::DOUBLE,6) AS effect FROM (SELECT count(*) n FROM part GROUP BY p_size > 40)""")
def _(t):
    df = t.part.select(F.when(F.col("p_size") > 40, "big").otherwise("small").alias("rare"), "p_retailprice")
    return rounded(found(E.build_context(df, "rare", kinds={"rare": "binary", "p_retailprice": "continuous"}), E.probe_class_balance), 6)


@query("h10_probe_interaction")
def _(t):
    df = t.lineitem.select("l_quantity", "l_discount", (F.col("l_quantity") * F.col("l_discount") * 10 + F.col("l_tax")).alias("gain"))
    return found(E.build_context(df, "gain", kinds={"l_quantity": "continuous", "l_discount": "continuous", "gain": "continuous"}), E.probe_interaction)


def _simpson(t):
    sign = F.when(F.col("l_returnflag") == "A", -1.0).otherwise(1.0)
    df = t.lineitem.select("l_returnflag", "l_quantity", (sign * F.col("l_quantity") + F.col("l_extendedprice") / 5000).alias("score"))
    return E.build_context(df, "score", kinds={"l_returnflag": "nominal", "l_quantity": "continuous", "score": "continuous"})


_SIMPSON = """WITH d AS (SELECT l_returnflag g, l_quantity x, CASE WHEN l_returnflag='A' THEN -1.0 ELSE 1.0 END::DOUBLE*l_quantity + l_extendedprice/5000 y FROM lineitem), r AS (SELECT corr(x,y) r FROM d GROUP BY g)
SELECT 'sign_reversal' AS kind, 'l_quantity,score,l_returnflag' AS variables, round(least(1,max(r)-min(r)),6) AS effect FROM r"""


@query("h11_probe_segmentation", _SIMPSON)
def _(t):
    return rounded(found(_simpson(t), E.probe_segmentation), 6)


@query("h12_probe_heterogeneity", _SIMPSON)
def _(t):
    return rounded(found(_simpson(t), E.probe_heterogeneity), 6)


@query("h13_probe_predictive_power")
def _(t):
    df = t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") * 3 + F.col("p_partkey") % 5).alias("worth"))
    ctx = E.build_context(df, "worth", key="p_partkey", kinds={"p_size": "continuous", "p_retailprice": "continuous", "worth": "continuous"})
    return found(ctx, E.probe_predictive_power)


@query("h14_probe_multicollinearity")
def _(t):
    ctx = context(t)
    ctx.frame = ctx.frame.withColumn("twin", F.col("c_acctbal") * 3 + F.col("o_orderkey") % 100)
    ctx.ranking, ctx.numeric = [("c_acctbal", 1.0), ("twin", .9), ("noise", .5)], ["c_acctbal", "twin", "noise"]
    return found(ctx, E.probe_multicollinearity)


@query("h15_probe_influence")
def _(t):
    return found(context(t), E.probe_influence)


@query("h16_probe_break")
def _(t):
    df = flat(t).withColumn("spend", F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("date"), F.col("spend")).otherwise(-F.col("spend")))
    ctx = E.build_context(df, "spend", None, "o_orderkey", KINDS)
    return found(ctx, E.probe_break)


def _monthly(t):
    from lodestat.queries.g_series import monthly_orders
    df = cut_lineage(monthly_orders(t)).withColumn("climb", F.col("n") / 10 + F.months_between("month", F.lit("1995-01-01").cast("timestamp")))
    return E.build_context(df, "climb", "month", None, {"month": "temporal", "total": "continuous", "mean": "continuous", "climb": "continuous"})


@query("h17_probe_trend", """
WITH m AS (SELECT date_trunc('month', o_orderdate) d, count(*)/10.0::DOUBLE + (year(any_value(o_orderdate))-1995)*12 + month(any_value(o_orderdate)) - 1 c FROM orders GROUP BY 1), k AS (SELECT rank() OVER (ORDER BY d)::DOUBLE a, (rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c)-1)/2.0)::DOUBLE b FROM m)
SELECT 'trend' AS kind, 'climb,month' AS variables, round(corr(a,b),4) AS effect FROM k""")
def _(t):
    return rounded(found(_monthly(t), E.probe_trend), 4)


@query("h17_probe_stationarity_granger")
def _(t):
    ctx = _monthly(t)
    return found(ctx, lambda c: E.probe_stationarity(c) + E.probe_granger(c) + [E.Finding("granger", "ran", ("climb",), 0.0, "fixed", c.rows)])


@query("h18_probe_pairs", f"""
WITH {FLAT_SQL} SELECT 'linear_association' AS kind, p AS variables, round(r,6) AS effect FROM (SELECT unnest(['c_acctbal,noise','c_acctbal,spend','noise,spend']) p, unnest([corr(c_acctbal,noise), corr(c_acctbal,spend), corr(noise,spend)]) r FROM flat) WHERE abs(r) >= .35""")
def _(t):
    return rounded(found(context(t, None), E.probe_pairs), 6)


@query("h19_probe_axes")
def _(t):
    return found(context(t, None), E.probe_axes)


@query("h20_probe_quality", f"""
WITH h AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE 1.0 END AS gap FROM orders)
SELECT 'duplicates' AS kind, 'rows' AS variables, round(least(1,5*(count(*)-(SELECT count(*) FROM (SELECT DISTINCT * FROM h)))/count(*)::DOUBLE),6) AS effect FROM h
UNION ALL SELECT 'missing', 'gap', round(avg((gap IS NULL)::INT),6) FROM h UNION ALL SELECT 'constant', 'gap', .5""")
def _(t):
    df = t.orders.select("o_orderpriority", F.expr("CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE 1.0D END").alias("gap"))
    return rounded(found(E.build_context(df, kinds={"o_orderpriority": "nominal", "gap": "continuous"}), E.probe_quality), 6)


# ---------------------------------------------------------------- diagnose and correct

def issues(t, made):
    return local_rows(t.spark, [(i.code, ",".join(i.columns), float(i.severity)) for i in made], "code string, columns string, severity double")


@query("i01_duplicates", """
WITH d AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem) SELECT 'duplicates' AS code, 'rows' AS columns, round(least(1,6*(count(*)-(SELECT count(*) FROM (SELECT DISTINCT * FROM d)))/count(*)::DOUBLE),6) AS severity FROM d""")
def _(t):
    return rounded(issues(t, D.duplicate_issues(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))), 6)


def tagged(t):
    return holes(t).select("price", "o_orderpriority", F.lit(1).alias("one"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("tag"))


@query("i02_constants", "SELECT 'constant' AS code, 'one' AS columns, .35::DOUBLE AS severity FROM (SELECT count(*) FROM orders)")
def _(t):
    return issues(t, D.column_issues(tagged(t), codes=["constant"]))


@query("i03_identifiers", "SELECT 'identifier_like' AS code, 'tag' AS columns, .4::DOUBLE AS severity FROM (SELECT count(DISTINCT o_orderkey) d, count(*) n FROM orders) WHERE d >= .95*n")
def _(t):
    return issues(t, D.column_issues(tagged(t), codes=["identifier_like"]))


@query("i04_missing", f"SELECT 'missing' AS code, 'price' AS columns, round(least(1,2*avg((price IS NULL)::INT)),6) AS severity FROM {HOLES_SQL}")
def _(t):
    return rounded(issues(t, D.column_issues(tagged(t), codes=["missing"])), 6)


@query("i05_outliers", """
WITH s AS (SELECT quantile_cont(value,.25) a, quantile_cont(value,.75) b FROM events), o AS (SELECT avg((value < a-1.5*(b-a) OR value > b+1.5*(b-a))::INT) r FROM events, s)
SELECT 'outliers' AS code, 'value' AS columns, round(least(1,5*r),6) AS severity FROM o WHERE r >= .02""")
def _(t):
    return rounded(issues(t, D.outlier_issues(t.events, ["value"])), 6)


@query("i06_skew", """
SELECT 'skewed' AS code, 'value' AS columns, round(least(1,abs(g)/4),6) AS severity FROM (SELECT skewness(value)*(count(value)-2)/sqrt(count(value)::DOUBLE*(count(value)-1)) g FROM events) WHERE abs(g) >= 1""")
def _(t):
    return rounded(issues(t, D.skew_issues(t.events, ["value"])), 6)


@query("i07_collinear", """
SELECT 'collinear' AS code, 'p_retailprice,twice' AS columns, round(least(1,(abs(corr(p_retailprice,2*p_retailprice+p_size))-.85)*5),6) AS severity FROM part""")
def _(t):
    df = t.part.select("p_retailprice", (F.col("p_retailprice") * 2 + F.col("p_size")).alias("twice"), "p_size")
    return rounded(issues(t, D.collinear_issues(df, ["p_retailprice", "twice", "p_size"])), 6)


@query("i08_non_stationary")
def _(t):
    from lodestat.operators.ordering import running_total
    from lodestat.queries.g_series import monthly_orders
    m = monthly_orders(t)
    mean = m.agg(F.avg("total")).first()[0]
    walk = running_total(m.select("month", (F.col("total") - F.lit(mean)).alias("step")), {"walk": "step"}, ["month"])
    return issues(t, D.stationarity_issues(walk.select("month", "walk"), ["walk"], ["month"]))


@query("i09_heteroskedastic", """
WITH d AS (SELECT p_size::DOUBLE x, p_size*(1+((p_partkey*7919) % 101)/50.0::DOUBLE) y FROM part), c AS (SELECT regr_slope(y,x) b, regr_intercept(y,x) a FROM d), e AS (SELECT x, pow(y-a-b*x,2) e2 FROM d, c)
SELECT 'heteroskedastic' AS code, 'y' AS columns, .5::DOUBLE AS severity FROM (SELECT count(*)*regr_r2(e2,x) lm FROM e) WHERE lm > 3.8414588""")
def _(t):
    df = t.part.select(F.col("p_size").cast("double").alias("x"), (F.col("p_size") * (1 + (F.col("p_partkey") * 7919 % 101) / 50.0)).alias("y"))
    return issues(t, D.heteroskedastic_issues(df, ["x"], "y"))


def defective(t):
    df = t.events.select("event_id", "value", (F.col("value") * 2 + F.col("event_id") % 2).alias("twin"), F.expr("CASE WHEN event_id % 8 = 0 THEN NULL ELSE value / 3 + event_id % 97 END").alias("gappy"), F.lit(7).alias("one"))
    return df


@query("i10_diagnose", """
WITH d AS (SELECT value, value*2 + event_id % 2 AS twin, CASE WHEN event_id % 8 = 0 THEN NULL ELSE value/3 + event_id % 97 END AS gappy FROM events)
SELECT 'constant' AS code, 'one' AS columns UNION ALL SELECT 'missing', 'gappy' UNION ALL SELECT 'collinear', 'value,twin' UNION ALL SELECT unnest(['outliers','outliers']), unnest(['value','twin'])
UNION ALL SELECT unnest(['skewed','skewed']), unnest(['value','twin']) UNION ALL SELECT 'skewed', 'gappy' FROM (SELECT skewness(gappy) g FROM d) WHERE g >= 1""")
def _(t):
    return issues(t, D.diagnose(defective(t), skip=["event_id"])).where("NOT (code = 'outliers' AND columns = 'gappy')").select("code", "columns")


@query("i11_remedy")
def _(t):
    df = defective(t)
    return D.remedy_effect(df, D.apply_remedy(D.apply_remedy(df, D.Remedy("winsorize", ("value",))), D.Remedy("impute_median", ("gappy",))), ["value", "gappy"])


@query("i12_remedy_choice")
def _(t):
    made = D.diagnose(defective(t), skip=["event_id"])
    return local_rows(t.spark, [(i + 1, r.name) for i, r in enumerate(D.choose_remedies(made, set(), set(), "value"))], "position int, remedy string")


@query("i13_correction_loop")
def _(t):
    return D.rounds_table(t.spark, D.correct(defective(t), skip=["event_id"], rounds=3))


@query("i14_staged_run")
def _(t):
    df = t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") * 2 + F.col("c_nationkey") * 50 + F.col("c_custkey") % 13).alias("worth"))
    out, _table = R.staged_run(df, "worth", "c_custkey", {"c_custkey": "identifier"})
    rows = None
    for i, stage in enumerate(R.STAGES):
        one = out[stage].agg(F.lit(i + 1).alias("position"), F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("result_rows"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def recipe_input(t):
    return t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") * 2 + F.col("c_nationkey") * 50 + F.col("c_custkey") % 13).alias("worth"))


@query("i15_recipe")
def _(t):
    return R.recipe_table(t.spark, R.build_recipe(R.table_facts(recipe_input(t), "worth")))


@query("i16_recipe_run")
def _(t):
    df = recipe_input(t)
    f = R.table_facts(df, "worth")
    _frame, results, failed = R.run_recipe(df, f, R.build_recipe(f, wanted=["clean", "describe", "correlate", "vif", "regression"]), "c_custkey")
    rows = None
    for name, r in results.items():
        one = r.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("result_rows"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.unionByName(local_rows(t.spark, [(k, -1) for k in failed], "step string, result_rows long"))


@query("i17_insights")
def _(t):
    from lodestat.operators import correlate, describe
    d = describe.numeric_descriptive(t.events.select("value", (F.col("value") * 2 + F.col("event_id") % 2).alias("twin")))
    c = correlate.with_p(correlate.pearson_pairs(t.events.select("value", (F.col("value") * 2 + F.col("event_id") % 2).alias("twin"))))
    return R.insights({"describe": d, "correlate": c})
