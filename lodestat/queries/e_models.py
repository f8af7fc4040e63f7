"""Regression, econometrics, causality, survival."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestat.operators import causal as CA
from lodestat.operators import glm as G
from lodestat.operators import linear as L
from lodestat.operators import panel as P
from lodestat.operators import survival as S
from lodestat.operators.gram import complete
from lodestat.queries.c_describe import rounded
from lodestat.queries.registry import query

XS = ["l_quantity", "l_discount"]
Y = "l_extendedprice"

# two-regressor least squares from covariances
_OLS2 = """c AS (SELECT count(*)::DOUBLE n, avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my, covar_pop(l_quantity,l_quantity)*count(*) s11, covar_pop(l_discount,l_discount)*count(*) s22,
 covar_pop(l_quantity,l_discount)*count(*) s12, covar_pop(l_quantity,l_extendedprice)*count(*) s1y, covar_pop(l_discount,l_extendedprice)*count(*) s2y, var_pop(l_extendedprice)*count(*) syy FROM lineitem),
b AS (SELECT *, s11*s22-s12*s12 det, (s22*s1y-s12*s2y)/(s11*s22-s12*s12) b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) b2 FROM c),
f AS (SELECT *, my-b1*m1-b2*m2 b0, syy-b1*s1y-b2*s2y rss FROM b)"""


@query("e01_ols_summary", f"""
WITH {_OLS2}, v AS (SELECT *, rss/(n-3) s2 FROM f)
SELECT 'const' AS variable, round(b0,4) AS coefficient, round(sqrt(s2*(1/n + (m1*m1*s22-2*m1*m2*s12+m2*m2*s11)/det)),4) AS std_error, round(b0/sqrt(s2*(1/n + (m1*m1*s22-2*m1*m2*s12+m2*m2*s11)/det)),5) AS t FROM v
UNION ALL SELECT 'l_quantity', round(b1,4)+0.0, round(sqrt(s2*s22/det),4), round(b1/sqrt(s2*s22/det),5)+0.0 FROM v UNION ALL SELECT 'l_discount', round(b2,4)+0.0, round(sqrt(s2*s11/det),4), round(b2/sqrt(s2*s11/det),5)+0.0 FROM v""")
def _(t):
    return rounded(L.ols_summary(t.lineitem, Y, XS).select("variable", "coefficient", "std_error", "t"), 4, t=5)


@query("e01_ols_quality", f"""
WITH {_OLS2} SELECT n::BIGINT AS n, round(1-rss/syy,8)+0.0 AS r2, round(1-(rss/syy)*(n-1)/(n-3),8)+0.0 AS r2_adjusted, round(((syy-rss)/2)/(rss/(n-3)),5) AS f,
 round(n*(ln(2*pi())+ln(rss/n)+1)+6,2) AS aic, round(n*(ln(2*pi())+ln(rss/n)+1)+3*ln(n),2) AS bic FROM f""")
def _(t):
    return rounded(L.ols_quality(t.lineitem, Y, XS).select("n", "r2", "r2_adjusted", "f", "aic", "bic"), 8, f=5, aic=2, bic=2)


@query("e02_robust_errors")
def _(t):
    hc1 = L.ols_summary(t.lineitem, Y, XS, "hc1").withColumn("kind", F.lit("hc1"))
    return hc1.unionByName(L.ols_summary(t.lineitem, Y, XS, "hc3").withColumn("kind", F.lit("hc3")))


def doc_labels(t):
    return t.labels.join(t.documents, "doc_id").select("doc_id", "quality", "toxic", (F.col("n_chars") / 1000.0).alias("kchars"), (F.col("doc_id") % 7).alias("week"))


@query("e03_logistic_summary")
def _(t):
    return G.logistic_summary(doc_labels(t), "quality", ["kchars", "week"])


@query("e04_breusch_pagan", """
WITH c AS (SELECT regr_slope(l_extendedprice,l_quantity) b, regr_intercept(l_extendedprice,l_quantity) a FROM lineitem),
e AS (SELECT l_quantity q, pow(l_extendedprice-a-b*l_quantity,2) e2 FROM lineitem, c)
SELECT count(*) AS n, round(count(*)*regr_r2(e2,q),5) AS lm, 1 AS df FROM e""")
def _(t):
    return rounded(L.breusch_pagan(t.lineitem, Y, ["l_quantity"]).select("n", "lm", "df"), 5)


_RES = """r AS (SELECT o_orderkey, o_totalprice - regr_intercept(o_totalprice,o_custkey) OVER () - regr_slope(o_totalprice,o_custkey) OVER () * o_custkey AS e FROM orders)"""


def order_residual(t):
    fit = L.fit_ols(t.orders, "o_totalprice", ["o_custkey"])
    return complete(t.orders, ["o_custkey", "o_totalprice"]), L.residual(fit, "o_totalprice")


@query("e05_jarque_bera", f"""
WITH {_RES}, m AS (SELECT count(e)::DOUBLE n, skewness(e)*(count(e)-2)/sqrt(count(e)::DOUBLE*(count(e)-1)) g1, kurtosis_pop(e) g2 FROM r) SELECT n::BIGINT AS n, round(n/6*(g1*g1+g2*g2/4),4) AS jarque_bera FROM m""")
def _(t):
    return rounded(L.jarque_bera(*order_residual(t)))


@query("e06_durbin_watson", f"WITH {_RES} SELECT round(sum(pow(e-l,2))/sum(e*e),6) AS durbin_watson FROM (SELECT e, lag(e) OVER (ORDER BY o_orderkey) l FROM r)")
def _(t):
    return rounded(L.durbin_watson(*order_residual(t), ["o_orderkey"]), 6)


@query("e07_ljung_box", f"""
WITH {_RES}, d AS (SELECT e-avg(e) OVER () x, o_orderkey FROM r), g AS (SELECT x, {", ".join(f"lag(x,{k}) OVER w l{k}" for k in range(1, 11))} FROM d WINDOW w AS (ORDER BY o_orderkey))
SELECT count(*) AS n, 10 AS lags, round(count(*)::DOUBLE*(count(*)+2)*({"+".join(f"pow(sum(x*l{k})/sum(x*x),2)/(count(*)-{k})" for k in range(1, 11))}),5) AS q FROM g""")
def _(t):
    return rounded(L.ljung_box(*order_residual(t), ["o_orderkey"]), 5)


@query("e08_reset")
def _(t):
    return L.reset_test(t.lineitem, Y, XS)


@query("e09_regression_diagnosis")
def _(t):
    return L.diagnose_regression(t.orders, "o_totalprice", ["o_custkey"], ["o_orderkey"])


@query("e10_quantile_regression")
def _(t):
    return G.quantile_regression(t.lineitem, Y, XS, taus=(.25, .5, .75))


def customer_counts(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.avg("o_totalprice").alias("mean_price"))
    return per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "orders", "c_acctbal", (F.col("mean_price") / 1000).alias("mean_price"), (F.col("c_nationkey") + 1).alias("exposure"))


@query("e11_poisson")
def _(t):
    return G.poisson(customer_counts(t), "orders", ["c_acctbal", "mean_price"])[0]


@query("e11_poisson_with_exposure")
def _(t):
    return G.count_model(customer_counts(t), "orders", ["c_acctbal", "mean_price"], "exposure")


@query("e12_negative_binomial")
def _(t):
    return G.negative_binomial(customer_counts(t), "orders", ["c_acctbal", "mean_price"], alpha=0.2)


@query("e13_count_detection", """
SELECT 'orders' AS "column", count(*) AS n, count(*) >= 20 AND min(k) >= 0 AND count(DISTINCT k) BETWEEN 3 AND greatest(50, floor(count(*)*.2)) AND min(k) <= 3 AS is_count FROM (SELECT count(*) k FROM orders GROUP BY o_custkey)
UNION ALL SELECT 'p_retailprice', count(*), false FROM part""")
def _(t):
    return G.is_count(customer_counts(t), "orders").unionByName(G.is_count(t.part, "p_retailprice"))


def nation_months(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        (F.avg("o_totalprice") / 1000).alias("price"), F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("c_acctbal").alias("balance"))


_PANEL = """p AS (SELECT c_nationkey, strftime(o_orderdate,'%Y-%m') mth, avg(o_totalprice)/1000 price, count(*)::DOUBLE n_orders, avg(c_acctbal) balance FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2)"""


@query("e14_panel_pooled")
def _(t):
    return P.pooled(nation_months(t), "c_nationkey", "price", ["n_orders", "balance"])


@query("e15_panel_fixed_effects", f"""
WITH {_PANEL}, d AS (SELECT price-avg(price) OVER w y, n_orders-avg(n_orders) OVER w a, balance-avg(balance) OVER w b, c_nationkey g FROM p WINDOW w AS (PARTITION BY c_nationkey)),
s AS (SELECT count(*) n, count(DISTINCT g) e, sum(a*a) saa, sum(b*b) sbb, sum(a*b) sab, sum(a*y) say, sum(b*y) sby, sum(y*y) syy FROM d),
f AS (SELECT *, saa*sbb-sab*sab det, (sbb*say-sab*sby)/(saa*sbb-sab*sab) b1, (saa*sby-sab*say)/(saa*sbb-sab*sab) b2 FROM s),
v AS (SELECT *, (syy-b1*say-b2*sby)/(n-e-2) s2 FROM f)
SELECT 'n_orders' AS variable, round(b1,6)+0.0 AS coefficient, round(sqrt(s2*sbb/det),6) AS std_error FROM v UNION ALL SELECT 'balance', round(b2,6)+0.0, round(sqrt(s2*saa/det),6) FROM v""")
def _(t):
    return rounded(P.fixed_effects(nation_months(t), "c_nationkey", "price", ["n_orders", "balance"]).select("variable", "coefficient", "std_error"), 6)


@query("e16_panel_random_effects")
def _(t):
    return P.random_effects(nation_months(t), "c_nationkey", "price", ["n_orders", "balance"])


@query("e17_hausman")
def _(t):
    return P.hausman(nation_months(t), "c_nationkey", "price", ["n_orders", "balance"])


@query("e18_difference_in_differences", """
WITH c AS (SELECT avg(o_totalprice) FILTER (o_custkey % 2 = 1 AND o_orderdate >= DATE '1998-01-01') a, avg(o_totalprice) FILTER (o_custkey % 2 = 1 AND o_orderdate < DATE '1998-01-01') b,
 avg(o_totalprice) FILTER (o_custkey % 2 = 0 AND o_orderdate >= DATE '1998-01-01') c, avg(o_totalprice) FILTER (o_custkey % 2 = 0 AND o_orderdate < DATE '1998-01-01') d FROM orders)
SELECT round(a,3) AS treated_post, round(b,3) AS treated_pre, round(c,3) AS control_post, round(d,3) AS control_pre, round(a-b-c+d,3)+0.0 AS effect FROM c""")
def _(t):
    return rounded(CA.did_cells(t.orders, "o_totalprice", F.col("o_custkey") % 2 == 1, F.col("o_orderdate") >= F.lit("1998-01-01").cast("date")), 3)


@query("e18_did_regression", """
WITH c AS (SELECT avg(o_totalprice) FILTER (o_custkey % 2 = 1 AND o_orderdate >= DATE '1998-01-01') a, avg(o_totalprice) FILTER (o_custkey % 2 = 1 AND o_orderdate < DATE '1998-01-01') b,
 avg(o_totalprice) FILTER (o_custkey % 2 = 0 AND o_orderdate >= DATE '1998-01-01') c, avg(o_totalprice) FILTER (o_custkey % 2 = 0 AND o_orderdate < DATE '1998-01-01') d FROM orders)
SELECT 'const' AS variable, round(d,3) AS coefficient FROM c UNION ALL SELECT 'treated', round(b-d,3)+0.0 FROM c UNION ALL SELECT 'post', round(c-d,3)+0.0 FROM c UNION ALL SELECT 'treated_x_post', round(a-b-c+d,3)+0.0 FROM c""")
def _(t):
    return rounded(CA.did_regression(t.orders, "o_totalprice", F.col("o_custkey") % 2 == 1, F.col("o_orderdate") >= F.lit("1998-01-01").cast("date")).select("variable", "coefficient"), 3)


@query("e19_two_stage", """
WITH d AS (SELECT p_retailprice y, p_size + p_partkey/100.0::DOUBLE x, p_partkey::DOUBLE z FROM part),
s AS (SELECT count(*)::DOUBLE n, covar_samp(z,y)/covar_samp(z,x) b, covar_samp(x,y)/var_samp(x) o, avg(y) my, avg(x) mx, pow(corr(x,z),2) r2 FROM d)
SELECT n::BIGINT AS n, round(my-b*mx,5) AS intercept, round(b,6) AS coefficient, round(r2/(1-r2)*(n-2),3) AS first_stage_f, round(o,6) AS ols, round(b-o,6)+0.0 AS gap FROM s""")
def _(t):
    df = t.part.select(F.col("p_retailprice").alias("y"), (F.col("p_size") + F.col("p_partkey") / 100.0).alias("x"), F.col("p_partkey").cast("double").alias("z"))
    return rounded(CA.two_stage(df, "y", "x", "z").select("n", "intercept", "coefficient", "first_stage_f", "ols", "gap"), 6, intercept=5, first_stage_f=3)


def treated_parts(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
                         F.when((F.col("p_partkey") * 7919 % 100) < F.col("p_size"), 1).otherwise(0).alias("treated"))


@query("e20_propensity_matching")
def _(t):
    return CA.matching_effect(CA.propensity_matching(treated_parts(t), "treated", "price", ["size"], "p_partkey"))


@query("e20_nearest_control", """
WITH d AS (SELECT p_partkey, p_size::DOUBLE/50 + (p_partkey % 1000)/100000.0::DOUBLE score, CASE WHEN (p_partkey*7919 % 100) < p_size THEN 1 ELSE 0 END treated FROM part)
SELECT p_partkey, round((SELECT min(abs(c.score-d.score)) FROM d c WHERE c.treated = 0),9) AS distance FROM d WHERE treated = 1""")
def _(t):
    df = treated_parts(t).withColumn("score", F.col("size") / 50 + (F.col("p_partkey") % 1000) / F.lit(100000.0))
    return rounded(CA.match_nearest(df, "treated", "score", "p_partkey", [], None).select("p_partkey", "distance"), 9)


@query("e21_standardised_difference", """
WITH d AS (SELECT p_size::DOUBLE size, p_retailprice price, (p_partkey*7919 % 100) < p_size tr FROM part)
SELECT 'size' AS covariate, round((avg(size) FILTER (tr)-avg(size) FILTER (NOT tr))/sqrt((var_samp(size) FILTER (tr)+var_samp(size) FILTER (NOT tr))/2),6)+0.0 AS smd FROM d
UNION ALL SELECT 'price', round((avg(price) FILTER (tr)-avg(price) FILTER (NOT tr))/sqrt((var_samp(price) FILTER (tr)+var_samp(price) FILTER (NOT tr))/2),6)+0.0 FROM d""")
def _(t):
    return rounded(CA.standardised_difference(treated_parts(t), F.col("treated"), ["size", "price"]).select("covariate", "smd"), 6)


@query("e21_love_plot")
def _(t):
    df = treated_parts(t)
    return CA.balance_table(df, CA.propensity_matching(df, "treated", "price", ["size"], "p_partkey"), "treated", ["size"])


@query("e22_common_support", """
SELECT least(floor((1/(1+exp(-(p_size-25)/10.0)))/(1.0::DOUBLE/15)),14)::BIGINT AS bin, count(*) FILTER ((p_partkey*7919 % 100) < p_size) AS treated, count(*) FILTER (NOT (p_partkey*7919 % 100) < p_size) AS control FROM part GROUP BY 1""")
def _(t):
    return CA.common_support(treated_parts(t), "treated", 1 / (1 + F.exp(-(F.col("size") - 25) / 10.0)))


def second_orders(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ranked = t.orders.select("o_custkey", "o_orderdate", F.row_number().over(w).alias("k")).where("k <= 2")
    last = t.orders.agg(F.max("o_orderdate").alias("m")).first()["m"]
    per = ranked.groupBy("o_custkey").agg(F.min(F.when(F.col("k") == 1, F.col("o_orderdate"))).alias("a"), F.min(F.when(F.col("k") == 2, F.col("o_orderdate"))).alias("b"))
    gap = F.datediff(F.coalesce("b", F.lit(last)), "a")
    return per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        gap.alias("days"), (F.col("b").isNotNull() & (gap <= 365)).cast("int").alias("again"), (F.col("c_nationkey") % 2).alias("arm"), F.col("c_acctbal"), "c_nationkey")


_SURV = """k AS (SELECT o_custkey, o_orderdate d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) k FROM orders),
p AS (SELECT o_custkey, min(d) FILTER (k=1) a, min(d) FILTER (k=2) b FROM k WHERE k <= 2 GROUP BY 1),
s AS (SELECT date_diff('day', a, coalesce(b, (SELECT max(o_orderdate) FROM orders)))::DOUBLE dd, (b IS NOT NULL AND date_diff('day', a, b) <= 365)::INT again, c_nationkey % 2 arm FROM p JOIN customer ON o_custkey=c_custkey)"""


@query("e23_kaplan_meier", f"""
WITH {_SURV}, c AS (SELECT dd AS time, count(*) FILTER (again=1) e, count(*) FILTER (again=0) c FROM s GROUP BY 1), r AS (SELECT *, sum(e+c) OVER (ORDER BY time DESC)::BIGINT n FROM c),
q AS (SELECT *, sum(CASE WHEN n > e THEN ln(1-e/n::DOUBLE) ELSE 0 END) OVER w l, max((n <= e)::INT) OVER w z, sum(CASE WHEN n > e THEN e/(n::DOUBLE*(n-e)) ELSE 0 END) OVER w g FROM r WINDOW w AS (ORDER BY time)),
kk AS (SELECT *, CASE WHEN z > 0 THEN 0 ELSE exp(l) END sv FROM q)
SELECT time, e AS events, c AS censored, n AS at_risk, round(sv,6) AS survival, round(greatest(0,sv-1.96*sv*sqrt(g)),6)+0.0 AS ci_low, round(least(1,sv+1.96*sv*sqrt(g)),6) AS ci_high FROM kk""")
def _(t):
    return rounded(S.kaplan_meier(second_orders(t), "days", "again"), 6)


@query("e24_kaplan_meier_by_group", f"""
WITH {_SURV}, c AS (SELECT arm, dd AS time, count(*) FILTER (again=1) e, count(*) FILTER (again=0) c FROM s GROUP BY 1,2), r AS (SELECT *, sum(e+c) OVER (PARTITION BY arm ORDER BY time DESC)::BIGINT n FROM c),
q AS (SELECT *, sum(CASE WHEN n > e THEN ln(1-e/n::DOUBLE) ELSE 0 END) OVER w l, max((n <= e)::INT) OVER w z FROM r WINDOW w AS (PARTITION BY arm ORDER BY time))
SELECT arm, time, n AS at_risk, round(CASE WHEN z > 0 THEN 0 ELSE exp(l) END,6) AS survival FROM q""")
def _(t):
    return rounded(S.kaplan_meier(second_orders(t), "days", "again", ["arm"]).select("arm", "time", "at_risk", "survival"), 6)


@query("e25_log_rank", f"""
WITH {_SURV}, c AS (SELECT dd, count(*) FILTER (arm=0) r1, count(*) FILTER (arm=1) r2, count(*) FILTER (arm=0 AND again=1) d1, count(*) FILTER (again=1)::DOUBLE d FROM s GROUP BY 1),
r AS (SELECT *, sum(r1) OVER w::DOUBLE n1, sum(r2) OVER w::DOUBLE n2 FROM c WINDOW w AS (ORDER BY dd DESC)),
q AS (SELECT sum(d1)::DOUBLE o, sum(n1*d/(n1+n2)) e, sum(n1*n2*d*(n1+n2-d)/(pow(n1+n2,2)*(n1+n2-1))) v FROM r WHERE n1+n2 > 1 AND d > 0)
SELECT '0' AS group1, '1' AS group2, o AS observed, round(e,6) AS expected, round(pow(o-e,2)/v,6) AS chi2 FROM q""")
def _(t):
    return rounded(S.log_rank(second_orders(t), "days", "again", "arm").drop("variance"), 6)


@query("e26_cox")
def _(t):
    return S.cox(second_orders(t), "days", "again", ["arm", "c_acctbal"])


@query("e27_chow", """
WITH g AS (SELECT o_orderdate < DATE '1998-04-01' AS bf, o_custkey x, o_totalprice y FROM orders),
r AS (SELECT regr_syy(y,x)-pow(regr_sxy(y,x),2)/regr_sxx(y,x) rss FROM g GROUP BY bf), p AS (SELECT count(*)::DOUBLE n, regr_syy(y,x)-pow(regr_sxy(y,x),2)/regr_sxx(y,x) rss FROM g)
SELECT round(((p.rss-u.rss)/2)/(u.rss/(n-4)),6) AS f, 2::DOUBLE AS df1, n-4 AS df2 FROM p, (SELECT sum(rss) rss FROM r) u""")
def _(t):
    return rounded(L.chow_test(t.orders, "o_totalprice", ["o_custkey"], F.col("o_orderdate") < F.lit("1998-04-01").cast("date")).select("f", "df1", "df2"), 6)


@query("e28_supremum_chow", """
WITH m AS (SELECT avg(o_custkey) mx, avg(o_totalprice) my FROM orders), g AS (SELECT o_orderkey, o_custkey-mx x, (o_totalprice-my)/1000 y FROM orders, m),
p AS (SELECT count(*) OVER w::DOUBLE n, sum(x) OVER w sx, sum(y) OVER w sy, sum(x*x) OVER w sxx, sum(x*y) OVER w sxy, sum(y*y) OVER w syy FROM g WINDOW w AS (ORDER BY o_orderkey)),
t AS (SELECT count(*)::DOUBLE nt, sum(x) tx, sum(y) ty, sum(x*x) txx, sum(x*y) txy, sum(y*y) tyy FROM g),
r AS (SELECT n, nt, (syy-sy*sy/n) - pow(sxy-sx*sy/n,2)/(sxx-sx*sx/n) + ((tyy-syy)-pow(ty-sy,2)/(nt-n)) - pow((txy-sxy)-(tx-sx)*(ty-sy)/(nt-n),2)/((txx-sxx)-pow(tx-sx,2)/(nt-n)) u,
 (tyy-ty*ty/nt)-pow(txy-tx*ty/nt,2)/(txx-tx*tx/nt) p0 FROM p, t WHERE n >= floor(nt*.15) AND n < nt-floor(nt*.15))
SELECT max_by(n, ((p0-u)/2)/(u/(nt-4)))::BIGINT AS split, round(max(((p0-u)/2)/(u/(nt-4))),5) AS f FROM r""")
def _(t):
    return rounded(L.strongest_break(t.orders, "o_totalprice", ["o_custkey"], ["o_orderkey"], rows_per_slice=5000).select("split", "f"), 5)


@query("e29_interaction")
def _(t):
    return L.interaction_test(t.lineitem, Y, "l_quantity", "l_discount")


@query("e30_influence", """
WITH c AS (SELECT count(*)::DOUBLE n, regr_slope(o_totalprice,o_custkey) b, regr_intercept(o_totalprice,o_custkey) a, regr_avgx(o_totalprice,o_custkey) mx, regr_sxx(o_totalprice,o_custkey) sxx,
 regr_syy(o_totalprice,o_custkey)-pow(regr_sxy(o_totalprice,o_custkey),2)/regr_sxx(o_totalprice,o_custkey) rss FROM orders),
d AS (SELECT o_orderkey, pow(o_totalprice-a-b*o_custkey,2) e2, 1/n+pow(o_custkey-mx,2)/sxx h, rss/(n-2) s2 FROM orders, c)
SELECT o_orderkey, round(e2*h/(2*s2*pow(1-h,2)),9) AS cook, round(h,9) AS leverage FROM d""")
def _(t):
    return rounded(L.cook_distance(t.orders, "o_totalprice", ["o_custkey"]).select("o_orderkey", "cook", "leverage"), 9)


@query("e30_most_influential")
def _(t):
    return L.influence_summary(t.orders, "o_totalprice", ["o_custkey"], ["o_orderkey"])
