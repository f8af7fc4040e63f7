"""Hypothesis tests and their corrections."""

from pyspark.sql import functions as F

from lodestat.functions.dist import p_t
from lodestat.functions.expr import rnd
from lodestat.operators import describe as D
from lodestat.operators import hypothesis as H
from lodestat.operators import normal_scores as NS
from lodestat.operators.correlate import pearson_pairs
from lodestat.queries.b_transforms import HOLES_SQL, holes
from lodestat.queries.c_describe import LINE_NUM, _pairs_sql, rounded
from lodestat.queries.registry import query

_TWO = """m AS (SELECT l_linestatus g, count(*) n, avg(l_extendedprice) m, var_samp(l_extendedprice) v FROM lineitem GROUP BY 1),
w AS (SELECT min(g) g1, max(g) g2, min_by(n,g) n1, max_by(n,g) n2, min_by(m,g) m1, max_by(m,g) m2, min_by(v,g) v1, max_by(v,g) v2 FROM m),
p AS (SELECT *, ((n1-1)*v1+(n2-1)*v2)/(n1+n2-2) AS sp FROM w)"""


@query("d01_t_test", f"""
WITH {_TWO}
SELECT g1 AS group1, g2 AS group2, n1, n2, round(m1-m2,4) AS difference, round((m1-m2)/sqrt(sp*(1.0::DOUBLE/n1+1.0::DOUBLE/n2)),6)+0.0 AS t_student, (n1+n2-2)::DOUBLE AS df_student,
 round((m1-m2)/sqrt(v1/n1+v2/n2),6)+0.0 AS t_welch, round(pow(v1/n1+v2/n2,2)/(pow(v1/n1,2)/(n1-1)+pow(v2/n2,2)/(n2-1)),3) AS df_welch FROM p""")
def _(t):
    return rounded(H.t_test(t.lineitem, "l_linestatus", "l_extendedprice").drop("cohen_d", "magnitude"), 6, difference=4, df_welch=3)


@query("d02_cohen_d", f"""
WITH {_TWO} SELECT round((m1-m2)/sqrt(sp),6)+0.0 AS cohen_d, CASE WHEN abs((m1-m2)/sqrt(sp)) < .2 THEN 'negligible' ELSE 'small' END AS magnitude FROM p""")
def _(t):
    return rounded(H.t_test(t.lineitem, "l_linestatus", "l_extendedprice").select("cohen_d", "magnitude"), 6)


def _anova_sql(table, g, v):
    return f"""m AS (SELECT {g} g, count(*) n, avg({v}) m, var_samp({v}) s FROM {table} GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT sum(n*m)/sum(n) gm FROM m),
a AS (SELECT count(*) k, sum(n)::BIGINT n, sum(n*pow(m-gm,2)) ssb, sum((n-1)*s) ssw FROM m, c)"""


@query("d03_levene", f"""
WITH q AS (SELECT o_orderpriority p, median(o_totalprice) md FROM orders GROUP BY 1), z AS (SELECT p, abs(o_totalprice-md) d FROM orders JOIN q ON p=o_orderpriority),
{_anova_sql("z", "p", "d")} SELECT k AS groups, n, round((ssb/(k-1))/(ssw/(n-k)),6) AS w, (k-1)::DOUBLE AS df_between, (n-k)::DOUBLE AS df_within FROM a""")
def _(t):
    return rounded(H.levene(t.orders, "o_orderpriority", "o_totalprice"), 6)


@query("d04_mann_whitney", """
WITH k AS (SELECT l_linestatus g, (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice)-1)/2.0)::DOUBLE r FROM lineitem),
s AS (SELECT count(*) FILTER (g='F')::DOUBLE n1, count(*) FILTER (g='O')::DOUBLE n2, sum(r) FILTER (g='F') r1 FROM k),
x AS (SELECT sum(pow(c,3)-c) ties FROM (SELECT count(*)::DOUBLE c FROM lineitem GROUP BY l_extendedprice)),
u AS (SELECT *, r1-n1*(n1+1)/2 u FROM s, x)
SELECT 'F' AS group1, 'O' AS group2, n1::BIGINT AS n1, n2::BIGINT AS n2, u, round((greatest(u,n1*n2-u)-n1*n2/2-.5)/sqrt(n1*n2/12*(n1+n2+1-ties/((n1+n2)*(n1+n2-1)))),6) AS z,
 round(1-2*u/(n1*n2),6)+0.0 AS r FROM u""")
def _(t):
    return rounded(H.mann_whitney(t.lineitem, "l_linestatus", "l_extendedprice"), 6)


@query("d05_anova", f"""
WITH {_anova_sql("orders", "o_orderpriority", "o_totalprice")}
SELECT k AS groups, n, round((ssb/(k-1))/(ssw/(n-k)),6) AS f, round(ssb/(ssb+ssw),8) AS eta_squared,
 CASE WHEN ssb/(ssb+ssw) < .01 THEN 'negligible' WHEN ssb/(ssb+ssw) < .06 THEN 'small' ELSE 'medium' END AS magnitude FROM a""")
def _(t):
    return rounded(H.one_way(t.orders, "o_orderpriority", "o_totalprice").select("groups", "n", "f", "eta_squared", "magnitude"), 6, eta_squared=8)


@query("d06_kruskal_wallis", """
WITH k AS (SELECT l_returnflag g, (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity)-1)/2.0)::DOUBLE r FROM lineitem),
s AS (SELECT g, count(*)::DOUBLE n, sum(r) r FROM k GROUP BY 1), q AS (SELECT count(*) k, sum(n) n, sum(r*r/n) q FROM s),
x AS (SELECT sum(pow(c,3)-c) ties FROM (SELECT count(*)::DOUBLE c FROM lineitem GROUP BY l_quantity)),
h AS (SELECT k, n, (12/(n*(n+1))*q-3*(n+1))/(1-ties/(pow(n,3)-n)) h FROM q, x)
SELECT k AS groups, n::BIGINT AS n, round(h,5) AS h, (k-1)::DOUBLE AS df, round((h-k+1)/(n-k),8)+0.0 AS eta_squared_h FROM h""")
def _(t):
    return rounded(H.kruskal_wallis(t.lineitem, "l_returnflag", "l_quantity"), 5, eta_squared_h=8)


@query("d07_test_selection", f"""
WITH {_anova_sql("orders", "o_orderpriority", "o_totalprice")} SELECT 'anova' AS test, round((ssb/(k-1))/(ssw/(n-k)),6) AS statistic, true AS normality_assumed FROM a""")
def _(t):
    return rounded(H.compare_means(t.orders, "o_orderpriority", "o_totalprice").select("test", "statistic", "normality_assumed"), 6)


@query("d08_correlation_test", """
WITH k AS (SELECT (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity)-1)/2.0)::DOUBLE a,
 (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice)-1)/2.0)::DOUBLE b FROM lineitem)
SELECT 'spearman' AS test, count(*) AS n, round(corr(a,b),6)+0.0 AS r FROM k""")
def _(t):
    return rounded(H.correlation_test(t.lineitem, "l_quantity", "l_extendedprice").select("test", "n", "r"), 6)


@query("d09_chi_square", """
WITH c AS (SELECT o_orderpriority a, c_mktsegment b, count(*)::DOUBLE o FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2),
m AS (SELECT o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () e, sum(o) OVER () n FROM c),
k AS (SELECT count(DISTINCT a) r, count(DISTINCT b) s FROM c)
SELECT 'chi_square' AS test, round(sum(pow(o-e,2)/e),6) AS statistic, any_value((r-1)*(s-1)) AS df, round(min(e),4) AS min_expected,
 round(sqrt(sum(pow(o-e,2)/e)/(any_value(n)*any_value(least(r-1,s-1)))),6) AS cramers_v FROM m, k""")
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(H.independence(df, "o_orderpriority", "c_mktsegment").select("test", "statistic", "df", "min_expected", "cramers_v"), 6, min_expected=4)


@query("d09_chi_square_corrected", """
WITH c AS (SELECT quality a, toxic b, count(*)::DOUBLE o FROM labels GROUP BY 1,2),
m AS (SELECT o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () e FROM c)
SELECT round(sum(pow(abs(o-e)-least(.5,abs(o-e)),2)/e),6) AS statistic, 1::BIGINT AS df, round(min(e),4) AS min_expected FROM m""")
def _(t):
    return rounded(H.independence(t.labels, "quality", "toxic").select("statistic", "df", "min_expected"), 6, min_expected=4)


@query("d10_fisher_exact")
def _(t):
    df = t.nation.select((F.col("n_regionkey") > 3).alias("last"), (F.col("n_nationkey") % 6 == 0).alias("sixth"))
    return H.independence(df, "last", "sixth")


def _normal_sql(c, table):
    return f"""SELECT '{c}' AS "column", count({c})::DOUBLE n, skewness({c})*(count({c})-2)/sqrt(count({c})::DOUBLE*(count({c})-1)) g1, kurtosis_pop({c}) g2 FROM {table}"""


_K2 = """a AS (SELECT *, g1*sqrt((n+1)*(n+3)/(6*(n-2))) y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) b2, 24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5)) vb,
 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) rb FROM s),
b AS (SELECT *, sqrt(2*(b2-1))-1 w2, (g2+3-3*(n-1)/(n+1))/sqrt(vb) x, 6+8/rb*(2/rb+sqrt(1+4/(rb*rb))) aa FROM a),
z AS (SELECT *, asinh(y/sqrt(2/(w2-1)))/sqrt(.5*ln(w2)) zs, 1+x*sqrt(2/(aa-4)) dn FROM b),
k AS (SELECT *, (1-2/(9*aa)-sign(dn)*cbrt((1-2/aa)/abs(dn)))/sqrt(2/(9*aa)) zk FROM z)"""


@query("d11_normality", f"""WITH s AS ({_normal_sql("o_totalprice", "orders")}), {_K2}
SELECT "column", n::BIGINT AS n, round(zs*zs+zk*zk,3) AS k2, round(n/6*(g1*g1+g2*g2/4),4) AS jarque_bera FROM k""")
def _(t):
    return rounded(H.normality(t.orders, ["o_totalprice"]), 4, k2=3)


def _ratio(parts, x):
    top, bottom = ("+".join(f"({c!r}::DOUBLE)*pow({x},{i})" for i, c in enumerate(p)) for p in parts)
    return f"(({top})/({bottom}))"


def _poly(c, x):
    return "(" + "+".join(f"({v!r}::DOUBLE)*pow({x},{i})" for i, v in enumerate(c)) + ")"


@query("d11_shapiro_wilk", f"""
WITH v AS (SELECT o_totalprice::DOUBLE - (SELECT avg(o_totalprice) FROM orders) x, row_number() OVER (ORDER BY o_totalprice) i, (count(*) OVER ())::DOUBLE n FROM orders WHERE o_totalprice IS NOT NULL),
p AS (SELECT *, (i - 0.375::DOUBLE)/(n + 0.25::DOUBLE) - 0.5::DOUBLE q FROM v), f AS (SELECT *, sqrt(-ln(0.5::DOUBLE - abs(q))) r FROM p),
m AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q*{_ratio(NS.CENTRE, "(0.180625::DOUBLE-q*q)")} WHEN r <= 5 THEN sign(q)*{_ratio(NS.MIDDLE, "(r-1.6::DOUBLE)")} ELSE sign(q)*{_ratio(NS.TAIL, "(r-5)")} END m FROM f),
s AS (SELECT any_value(n) n, 1/sqrt(any_value(n)) u, sum(m*m) mm, sum(m*x) mx, sum(x*x) ss, max(x) - min(x) d1, max(x) FILTER (i = n-1) - max(x) FILTER (i = 2) d2, max(m) m1, max(m) FILTER (i = n-1) m2 FROM m),
a AS (SELECT *, m1/sqrt(mm) + {_poly(NS.LAST, "u")} a1, m2/sqrt(mm) + {_poly(NS.BEFORE_LAST, "u")} a2 FROM s)
SELECT 'o_totalprice' AS "column", n::BIGINT AS n, round(pow(a1*d1 + a2*d2 + (mx - m1*d1 - m2*d2)/sqrt((mm - 2*m1*m1 - 2*m2*m2)/(1 - 2*a1*a1 - 2*a2*a2)), 2)/ss, 8) AS w FROM a""")
def _(t):
    return rounded(NS.shapiro_wilk(t.orders, ["o_totalprice"]).drop("p"), 8)


@query("d11_kolmogorov_smirnov")
def _(t):
    return H.kolmogorov_smirnov(t.events, "value")


_PAIRS = """WITH m AS (SELECT o_orderpriority g, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v FROM orders GROUP BY 1),
w AS (SELECT sum((n-1)*v)/(sum(n)-count(*)) mse, (sum(n)-count(*))::DOUBLE df, count(*) k FROM m)"""


@query("d12_tukey_hsd", _PAIRS + """
SELECT a.g AS group1, b.g AS group2, round(b.m-a.m,4)+0.0 AS difference, round(abs(b.m-a.m)/sqrt(mse/2*(1.0::DOUBLE/a.n+1.0::DOUBLE/b.n)),6) AS q, df FROM m a JOIN m b ON a.g < b.g, w""")
def _(t):
    return rounded(H.tukey_hsd(t.orders, "o_orderpriority", "o_totalprice").select("group1", "group2", "difference", "q", "df"), 6, difference=4)


@query("d13_games_howell", _PAIRS + """
SELECT a.g AS group1, b.g AS group2, round(a.m-b.m,4)+0.0 AS difference, round(abs(a.m-b.m)/sqrt(a.v/a.n+b.v/b.n)*sqrt(2),6) AS q,
 round(pow(a.v/a.n+b.v/b.n,2)/(pow(a.v/a.n,2)/(a.n-1)+pow(b.v/b.n,2)/(b.n-1)),4) AS df FROM m a JOIN m b ON a.g < b.g""")
def _(t):
    return rounded(H.games_howell(t.orders, "o_orderpriority", "o_totalprice").select("group1", "group2", "difference", "q", "df"), 6, difference=4, df=4)


@query("d14_post_hoc")
def _(t):
    return H.post_hoc(t.orders, "o_orderpriority", "o_totalprice")


@query("d15_equivalence", f"""
WITH {_TWO}, e AS (SELECT *, sqrt(sp*(1.0::DOUBLE/n1+1.0::DOUBLE/n2)) se, .2*sqrt(sp) mg FROM p)
SELECT g1 AS group1, g2 AS group2, round(m1-m2,4)+0.0 AS difference, round(mg,4) AS margin, (n1+n2-2)::DOUBLE AS df, round((m1-m2+mg)/se,5) AS t_low, round((m1-m2-mg)/se,5) AS t_high FROM e""")
def _(t):
    return rounded(H.equivalence(t.lineitem, "l_linestatus", "l_extendedprice").drop("se"), 5, difference=4, margin=4)


@query("d15_equivalence_p")
def _(t):
    return H.equivalence_p(t.lineitem, "l_linestatus", "l_extendedprice")


@query("d16_power")
def _(t):
    return H.power_two_groups(t.lineitem, "l_linestatus", "l_extendedprice")


@query("d17_benjamini_hochberg", """
WITH p AS (SELECT p_partkey AS test, round(('0x' || substr(md5(p_partkey::VARCHAR),1,8))::BIGINT/4294967296.0::DOUBLE,9) AS p FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY p, test) i, count(*) OVER () m FROM p)
SELECT test, round(least(1, min(p*m/i) OVER (ORDER BY i DESC)),7) AS q FROM r""")
def _(t):
    from lodestat.functions.expr import unit_hash
    tests = t.part.select(F.col("p_partkey").alias("test"), F.round(unit_hash("p_partkey"), 9).alias("p"))
    return rounded(H.benjamini_hochberg(tests).select("test", "q"), 7)


@query("d18_bonferroni", """
WITH p AS (SELECT p_brand, round(('0x' || substr(md5(p_partkey::VARCHAR),1,8))::BIGINT/4294967296.0::DOUBLE,9) AS p FROM part)
SELECT p_brand, count(p) AS tests, min(p) AS p_min, round(least(1, min(p)*count(p)),8) AS p_corrected FROM p GROUP BY 1""")
def _(t):
    from lodestat.functions.expr import unit_hash
    return rounded(H.bonferroni(t.part.select("p_brand", F.round(unit_hash("p_partkey"), 9).alias("p")), ["p_brand"]), 8, p_min=9)


@query("d19_assumption_checks", f"""
WITH s AS ({_normal_sql("o_totalprice", "orders")}), {_K2},
q AS (SELECT o_orderpriority p, median(o_totalprice) md FROM orders GROUP BY 1), zz AS (SELECT p, abs(o_totalprice-md) d FROM orders JOIN q ON p=o_orderpriority),
{_anova_sql("zz", "p", "d").replace("a AS (", "an AS (")}
SELECT 'normality' AS assumption, 'o_totalprice' AS subject, round(zs*zs+zk*zk,3) AS statistic FROM k
UNION ALL SELECT 'equal_variances', 'o_totalprice', round((ssb/(k-1))/(ssw/(n-k)),3) FROM an""")
def _(t):
    return rounded(H.assumption_checks(t.orders, "means_comparison", "o_orderpriority", "o_totalprice"), 3)


@query("d20_test_recommendation")
def _(t):
    return H.recommend_tests(t.orders, "o_orderpriority", "o_totalprice").unionByName(H.recommend_tests(t.lineitem, "l_quantity", "l_extendedprice"))


@query("d21_advisories", f"""
WITH h AS (SELECT price, o_custkey % 3 AS k, CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE 1.0 END AS gap, price*2 AS twice FROM {HOLES_SQL}),
n AS (SELECT count(*)::DOUBLE n, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM h)))::DOUBLE d FROM h)
SELECT 'warning' AS severity, 'missing_data' AS topic, 'gap' AS "column", round((SELECT avg((gap IS NULL)::INT) FROM h),6) AS metric
UNION ALL SELECT 'info', 'constant', 'gap', 1.0 UNION ALL SELECT 'warning', 'collinear', 'price~twice', 1.0
UNION ALL SELECT CASE WHEN d/n > .2 THEN 'critical' ELSE 'warning' END, 'duplicates', NULL, round(d/n,6) FROM n WHERE d > 0""")
def _(t):
    df = holes(t).select("price", (F.col("o_custkey") % 3).alias("k"), F.expr("CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE 1.0D END").alias("gap"), (F.col("price") * 2).alias("twice"))
    return rounded(H.advisories(df), 6)


@query("d22_model_recommendation")
def _(t):
    return H.recommend_models(t.orders, "o_totalprice").unionByName(H.recommend_models(t.labels, "quality"))


@query("d23_methodology_warnings")
def _(t):
    pairs = pearson_pairs(t.lineitem, LINE_NUM).withColumn("p", p_t(F.col("t"), F.col("n") - 2))
    tests, hits = pairs.agg(F.count("p"), F.count_if(F.col("p") < 0.05)).first()
    return H.methodology_warnings(t.spark, tests, t.labels.count(), True, None, hits)
