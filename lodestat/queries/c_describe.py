"""Aggregation, description, correlation, bootstrap."""

from pyspark.sql import functions as F

from lodestat.functions.expr import rnd
from lodestat.operators import bootstrap as B
from lodestat.operators import charts as CH
from lodestat.operators import correlate as CO
from lodestat.operators import describe as D
from lodestat.queries.registry import query

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_KEY = ["o_orderkey"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def rounded(df, digits=4, /, **special):
    """Round every double column, columns named in `special` to their own digits."""
    return df.select(*[rnd(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _numeric_sql(cols, table, extended):
    parts = []
    for c in cols:
        ext = f""",
  round(stddev_samp({c})/sqrt(count({c})),4) AS std_error,
  round(avg({c})-1.96*stddev_samp({c})/sqrt(count({c})),4) AS ci_low,
  round(avg({c})+1.96*stddev_samp({c})/sqrt(count({c})),4) AS ci_high,
  round(quantile_cont({c},0.01),4) AS p01, round(quantile_cont({c},0.05),4) AS p05, round(quantile_cont({c},0.1),4) AS p10,
  round(quantile_cont({c},0.9),4) AS p90, round(quantile_cont({c},0.95),4) AS p95, round(quantile_cont({c},0.99),4) AS p99""" if extended else ""
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}),4) AS mean, round(median({c}),4) AS median,
  round((SELECT {c}::DOUBLE FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1),4) AS mode,
  round(stddev_samp({c}),4) AS std, round(var_samp({c}),2) AS variance, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  round(max({c})-min({c}),4)::DOUBLE AS range, round(quantile_cont({c},0.25),4) AS q1, round(quantile_cont({c},0.75),4) AS q3,
  round(quantile_cont({c},0.75)-quantile_cont({c},0.25),4) AS iqr, round(stddev_samp({c})/avg({c})*100,4) AS cv_pct,
  round(skewness({c}),4)+0.0 AS skewness, round(kurtosis({c}),4)+0.0 AS kurtosis,
  count(*)-count({c}) AS null_count, round((count(*)-count({c}))/count(*)::DOUBLE,4) AS null_rate{ext}
FROM {table}""")
    return "\nUNION ALL\n".join(parts)


@query("c01_numeric_descriptive", _numeric_sql(
    ["o_totalprice", "price_gap"], "(SELECT o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price_gap FROM orders)", False))
def _(t):
    df = t.orders.select("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END").alias("price_gap"))
    return rounded(D.numeric_descriptive(df), variance=2)


@query("c02_extended_descriptive", _numeric_sql(LINE_NUM, "lineitem", True))
def _(t):
    return rounded(D.numeric_descriptive(t.lineitem, LINE_NUM, extended=True), variance=2)


@query("c03_temporal_descriptive", """
SELECT 'o_orderdate' AS "column", count(o_orderdate) AS count, min(o_orderdate) AS min, max(o_orderdate) AS max,
 count(DISTINCT o_orderdate) AS periods, count(*)-count(o_orderdate) AS null_count FROM orders""")
def _(t):
    return D.temporal_descriptive(t.orders)


@query("c04_identifier_descriptive", """
SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) AS cardinality, count(c_custkey) AS count, 0::BIGINT AS null_count,
 round(count(DISTINCT c_custkey)/count(c_custkey)::DOUBLE,6) AS uniqueness FROM customer
UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(c_name), 0, round(count(DISTINCT c_name)/count(c_name)::DOUBLE,6) FROM customer
UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), count(c_nationkey), 0, round(count(DISTINCT c_nationkey)/count(c_nationkey)::DOUBLE,6) FROM customer""")
def _(t):
    return rounded(D.identifier_descriptive(t.customer, ["c_custkey", "c_name", "c_nationkey"]), 6)


@query("c05_categorical_descriptive", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) AS cardinality, count({c}) AS count, count(*)-count({c}) AS null_count,
 (SELECT {c} FROM part GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
 (SELECT count(*) FROM part GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_frequency FROM part"""
                                                     for c in ("p_name", "p_brand", "p_type")))
def _(t):
    return D.categorical_descriptive(t.part, ["p_name", "p_brand", "p_type"])


@query("c05_top_values", """
SELECT * FROM (SELECT 'p_name' AS "column", p_name AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name)::INT AS position FROM part GROUP BY p_name
UNION ALL SELECT 'p_brand', p_brand, count(*), row_number() OVER (ORDER BY count(*) DESC, p_brand)::INT FROM part GROUP BY p_brand) WHERE position <= 10""")
def _(t):
    return D.top_values(t.part, ["p_name", "p_brand"])


@query("c06_describe_all", """
SELECT "column", statistic, round(value,4)+0.0 AS value FROM (
 SELECT 'c_acctbal' AS "column", unnest(['count','mean','median','min','max','q1','q3','skewness','kurtosis','p05','p95']) AS statistic,
  unnest([count(c_acctbal)::DOUBLE, avg(c_acctbal), median(c_acctbal), min(c_acctbal), max(c_acctbal), quantile_cont(c_acctbal,.25),
   quantile_cont(c_acctbal,.75), skewness(c_acctbal), kurtosis(c_acctbal), quantile_cont(c_acctbal,.05), quantile_cont(c_acctbal,.95)]) AS value FROM customer
 UNION ALL SELECT 'c_mktsegment', unnest(['cardinality','count']), unnest([count(DISTINCT c_mktsegment)::DOUBLE, count(c_mktsegment)]) FROM customer
 UNION ALL SELECT 'c_custkey', unnest(['cardinality','count','uniqueness']), unnest([count(DISTINCT c_custkey)::DOUBLE, count(c_custkey), 1.0]) FROM customer)""")
def _(t):
    out = D.describe_all(t.customer, {"c_acctbal": "numeric", "c_mktsegment": "categorical", "c_custkey": "identifier"})
    wanted = ["count", "mean", "median", "min", "max", "q1", "q3", "skewness", "kurtosis", "p05", "p95", "cardinality", "uniqueness"]
    return out.where(F.col("statistic").isin(wanted)).select("column", "statistic", rnd(F.col("value").cast("double"), 4).alias("value"))


@query("c07_histogram", """
WITH s AS (SELECT count(o_totalprice) n, min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
p AS (SELECT lo, (hi-lo)/least(30, greatest(8, n//12)) AS w, least(30, greatest(8, n//12)) AS bins FROM s)
SELECT bin, round(lo+bin*w,4) AS low, round(lo+(bin+1)*w,4) AS high, n FROM (
 SELECT least(floor((o_totalprice-lo)/w)::BIGINT, bins-1) AS bin, any_value(lo) lo, any_value(w) w, count(*) AS n FROM orders, p GROUP BY 1)""")
def _(t):
    return rounded(CH.histogram(t.orders, "o_totalprice"))


@query("c08_grouped_aggregate", """
SELECT c_nationkey, round(value,2) AS value FROM (SELECT c_nationkey, avg(c_acctbal) AS value FROM customer GROUP BY 1) ORDER BY value DESC, c_nationkey LIMIT 10""")
def _(t):
    return rounded(CH.grouped_aggregate(t.customer, "c_nationkey", "c_acctbal", "mean", 10), 2)


@query("c08_grouped_median", "SELECT l_returnflag, round(median(l_extendedprice),4) AS value FROM lineitem GROUP BY 1")
def _(t):
    return rounded(CH.grouped_aggregate(t.lineitem, "l_returnflag", "l_extendedprice", "median"))


@query("c09_pivot_aggregate", """
SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus='F') AS "F", sum(l_quantity) FILTER (l_linestatus='O') AS "O" FROM lineitem GROUP BY 1""")
def _(t):
    return CH.pivot_aggregate(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity", "sum")


@query("c10_crosstab", "SELECT o_orderpriority, o_orderstatus, count(*) AS value FROM orders GROUP BY 1,2")
def _(t):
    return CH.crosstab(t.orders, "o_orderpriority", "o_orderstatus")


@query("c10_heatmap", """
WITH xs AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50), ys AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)
SELECT p_brand, p_type, round(coalesce(v,0),4) AS value FROM xs CROSS JOIN ys LEFT JOIN
 (SELECT p_brand, p_type, avg(p_retailprice) v FROM part GROUP BY 1,2) USING (p_brand, p_type)""")
def _(t):
    return rounded(CH.heatmap(t.part, "p_brand", "p_type", "p_retailprice", "mean"))


@query("c11_pie_shares", """
SELECT event_type, value, round(100*value/sum(value) OVER (),4) AS percent FROM (
 SELECT event_type, count(*)::DOUBLE AS value FROM events GROUP BY 1 ORDER BY value DESC, event_type LIMIT 3)""")
def _(t):
    return rounded(CH.pie_shares(t.events, "event_type", top=3))


@query("c12_radar", "SELECT p_type, round(avg(p_size),4) AS p_size, round(avg(p_retailprice),4) AS p_retailprice FROM part GROUP BY 1")
def _(t):
    return rounded(CH.radar(t.part, "p_type", ["p_size", "p_retailprice"]))


@query("c13_temporal_buckets", """
SELECT CASE WHEN (SELECT count(*) FROM orders) > 15000 THEN strftime(o_orderdate,'%Y') WHEN (SELECT count(*) FROM orders) > 1500
 THEN strftime(o_orderdate,'%Y-%m') ELSE strftime(o_orderdate,'%Y-%m-%d') END AS period, round(sum(o_totalprice),2) AS value, count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    return rounded(CH.temporal_buckets(t.orders, "o_orderdate", "o_totalprice"), 2)


@query("c14_scatter_grid", """
WITH s AS (SELECT min(p_size)::DOUBLE x0, max(p_size)::DOUBLE x1, min(p_retailprice) y0, max(p_retailprice) y1 FROM part)
SELECT least(floor((p_size-x0)/((x1-x0)/30)),29)::BIGINT AS cell_x, least(floor((p_retailprice-y0)/((y1-y0)/30)),29)::BIGINT AS cell_y,
 count(*) AS n, round(avg(p_size),4) AS x, round(avg(p_retailprice),4) AS y FROM part, s GROUP BY 1,2""")
def _(t):
    return rounded(CH.scatter_grid(t.part, "p_size", "p_retailprice"))


@query("c15_line_thinning", """
WITH s AS (SELECT min(event_id)::DOUBLE lo, max(event_id)::DOUBLE hi FROM events)
SELECT least(floor((event_id-lo)/((hi-lo)/1000)),999)::BIGINT AS bucket, count(*) AS n, min(value) AS y_min, max(value) AS y_max,
 max_by(value, event_id) AS y_last, max(event_id)::DOUBLE AS x_last FROM events, s GROUP BY 1""")
def _(t):
    return CH.line_thinning(t.events, "event_id", "value")


@query("c16_chart_choice", """
SELECT unnest(['l_extendedprice','l_returnflag','l_linenumber','l_shipdate']) AS "column", unnest(['numeric','categorical','categorical','temporal']) AS kind,
 unnest(['histogram', CASE WHEN count(DISTINCT l_returnflag) <= 6 THEN 'pie' ELSE 'bar' END, CASE WHEN count(DISTINCT l_linenumber) <= 6 THEN 'pie' ELSE 'bar' END, 'line']) AS chart FROM lineitem""")
def _(t):
    return CH.suggest_charts(t.lineitem, {"l_extendedprice": "numeric", "l_returnflag": "categorical", "l_linenumber": "categorical", "l_shipdate": "temporal"})


@query("c17_box_statistics", """
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice,.25) q1, median(o_totalprice) median, quantile_cont(o_totalprice,.75) q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, count(*) AS n, round(any_value(q1),4) AS q1, round(any_value(median),4) AS median, round(any_value(q3),4) AS q3,
 min(o_totalprice) FILTER (o_totalprice >= q1-1.5*(q3-q1)) AS whisker_low, max(o_totalprice) FILTER (o_totalprice <= q3+1.5*(q3-q1)) AS whisker_high,
 count(*) FILTER (o_totalprice < q1-1.5*(q3-q1) OR o_totalprice > q3+1.5*(q3-q1)) AS outliers
FROM orders JOIN q USING (o_orderpriority) GROUP BY 1 HAVING count(*) >= 5""")
def _(t):
    return rounded(D.box_statistics(t.orders, "o_orderpriority", "o_totalprice"))


def _pairs_sql(cols, table, corr="corr({a},{b})"):
    rows = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            rows.append(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, {corr.format(a=a, b=b)} AS r FROM {table}")
    return " UNION ALL ".join(rows)


@query("c18_pearson_pairs", f"""
SELECT a, b, n, round(r,6)+0.0 AS r, round(r*sqrt(n-2)/sqrt(1-r*r),4)+0.0 AS t,
 CASE WHEN abs(r)>=.8 THEN 'very strong' WHEN abs(r)>=.6 THEN 'strong' WHEN abs(r)>=.4 THEN 'moderate' WHEN abs(r)>=.2 THEN 'weak' ELSE 'negligible' END AS strength
FROM ({_pairs_sql(LINE_NUM, "lineitem")})""")
def _(t):
    return rounded(CO.pearson_pairs(t.lineitem, LINE_NUM), 4, r=6)


_RANK_SQL = """(SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0 AS {c}"""


@query("c19_spearman_pairs", f"""
WITH k AS (SELECT {", ".join(f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0)::DOUBLE AS {c}" for c in LINE_NUM)} FROM lineitem)
SELECT a, b, n, round(r,6)+0.0 AS r FROM ({_pairs_sql(LINE_NUM, "k")})""")
def _(t):
    return rounded(CO.spearman_pairs(t.lineitem, LINE_NUM).select("a", "b", "n", "r"), 6)


@query("c20_temporal_trend", """
SELECT "column", round(r,6)+0.0 AS r, CASE WHEN r > .3 THEN 'up' WHEN r < -.3 THEN 'down' ELSE 'flat' END AS direction FROM (
 SELECT 'value' AS "column", corr(epoch_us(ts), value) AS r FROM events UNION ALL SELECT 'event_id', corr(epoch_us(ts), event_id) FROM events)""")
def _(t):
    return rounded(CO.temporal_trend(t.events, "ts", ["value", "event_id"]), 6)


@query("c21_vif", """
WITH c AS (SELECT corr(l_quantity, l_extendedprice) r12, corr(l_quantity, l_discount) r13, corr(l_extendedprice, l_discount) r23 FROM lineitem),
d AS (SELECT *, 1 + 2*r12*r13*r23 - r12*r12 - r13*r13 - r23*r23 AS det FROM c)
SELECT 'l_quantity' AS "column", round((1-r23*r23)/det,6) AS vif, 'low' AS level FROM d
UNION ALL SELECT 'l_extendedprice', round((1-r13*r13)/det,6), 'low' FROM d
UNION ALL SELECT 'l_discount', round((1-r12*r12)/det,6), 'low' FROM d""")
def _(t):
    return rounded(CO.vif(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), 6)


@query("c22_strong_pairs", """
SELECT 'p_partkey' AS a, 'key2' AS b, count(*) AS n, round(corr(p_partkey, 2*p_partkey + p_size),6) AS r FROM part""")
def _(t):
    df = t.part.select("p_partkey", "p_size", (2 * F.col("p_partkey") + F.col("p_size")).alias("key2"))
    return rounded(CO.strong_pairs(df), 6)


@query("c23_class_imbalance", """
SELECT count(*) AS classes, sum(n)::BIGINT AS n, round(min(n)/max(n)::DOUBLE,6) AS imbalance_ratio, round(max(n)/sum(n)::DOUBLE,6) AS majority_share
FROM (SELECT count(*) n FROM labels GROUP BY toxic)""")
def _(t):
    return rounded(D.class_balance(t.labels, "toxic"), 6)


def _shape_sql(c, table):
    return f"""SELECT '{c}' AS "column", count({c}) AS count,
 round(skewness({c})*(count({c})-2)/sqrt(count({c})::DOUBLE*(count({c})-1)),5)+0.0 AS skewness, round(kurtosis_pop({c}),5)+0.0 AS kurtosis FROM {table}"""


@query("c24_shape_moments", _shape_sql("l_extendedprice", "lineitem") + " UNION ALL " + _shape_sql("l_discount", "lineitem"))
def _(t):
    return rounded(D.shape_moments(t.lineitem, ["l_extendedprice", "l_discount"]), 5)


@query("c25_tukey_bounds", """
WITH q AS (SELECT quantile_cont(value,.25) q1, quantile_cont(value,.75) q3 FROM events)
SELECT 'value' AS "column", round(q1-1.5*(q3-q1),4) AS lower, round(q3+1.5*(q3-q1),4) AS upper,
 count(*) FILTER (value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1)) AS outliers,
 round(count(*) FILTER (value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1))/count(value)::DOUBLE,6) AS outlier_ratio FROM events, q GROUP BY q1, q3""")
def _(t):
    return rounded(D.tukey_bounds(t.events, ["value"]), 4, outlier_ratio=6)


@query("c26_bootstrap_ci")
def _(t):
    return B.bootstrap_ci(t.orders, "o_totalprice", ORDER_KEY, ["mean", "std", "median"], replicates=200)


@query("c27_bootstrap_correlations")
def _(t):
    return B.bootstrap_correlations(t.lineitem, LINE_NUM, LINE_KEY, replicates=100)


@query("c28_bootstrap_regression")
def _(t):
    return B.bootstrap_regression(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEY, replicates=100)


@query("c29_bootstrap_metric")
def _(t):
    df = t.lineitem.withColumn("predicted", F.col("l_quantity") * 1500.0)
    return B.bootstrap_metric(df, "l_extendedprice", "predicted", "rmse", LINE_KEY, replicates=100)


@query("c30_bootstrap_pca")
def _(t):
    return B.bootstrap_pca(t.lineitem, LINE_NUM, LINE_KEY, replicates=100)


@query("c31_mutual_information", """
WITH e AS (SELECT list_distinct(quantile_cont(l_quantity,[.1,.2,.3,.4,.5,.6,.7,.8,.9])) q, list_distinct(quantile_cont(l_discount,[.1,.2,.3,.4,.5,.6,.7,.8,.9])) d,
 list_distinct(quantile_cont(l_extendedprice,[.1,.2,.3,.4,.5,.6,.7,.8,.9])) y FROM lineitem),
b AS (SELECT len(list_filter(y, lambda v: v < l_extendedprice)) AS y, unnest(['l_quantity','l_discount','l_returnflag']) AS "column",
 unnest([len(list_filter(q, lambda v: v < l_quantity))::VARCHAR, len(list_filter(d, lambda v: v < l_discount))::VARCHAR, l_returnflag]) AS x FROM lineitem, e),
c AS (SELECT "column", x, y, count(*)::DOUBLE n FROM b GROUP BY 1,2,3),
m AS (SELECT *, sum(n) OVER (PARTITION BY "column") t, sum(n) OVER (PARTITION BY "column", x) nx, sum(n) OVER (PARTITION BY "column", y) ny FROM c),
r AS (SELECT "column", any_value(t)::BIGINT n, sum(n/t*ln(n*t/(nx*ny))) mi FROM m GROUP BY 1)
SELECT "column", n, round(mi,6)+0.0 AS mi, round(mi/max(mi) OVER (),6)+0.0 AS score FROM r""")
def _(t):
    return rounded(CO.mutual_information(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_returnflag"]), 6)


CUSTOMER_HISTORY = """h AS (SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS nation, floor(c_acctbal/500) AS balance, coalesce(n,0)::DOUBLE AS n_orders, coalesce(urgent,0)::DOUBLE AS urgent,
 coalesce(n_open,0)::DOUBLE AS n_open, coalesce(n_lines,0)::DOUBLE AS n_lines, coalesce(quantity,0)::DOUBLE AS quantity, coalesce(returned,0)::DOUBLE AS returned, round(spent,2) AS spent
FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, count(*) FILTER (o_orderpriority LIKE '1%') urgent, count(*) FILTER (o_orderstatus='O') n_open, sum(o_totalprice) spent FROM orders GROUP BY 1) ON o_custkey=c_custkey
LEFT JOIN (SELECT o_custkey AS k, count(*) n_lines, sum(l_quantity) quantity, count(*) FILTER (l_returnflag='R') returned FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1) ON k=c_custkey)"""


def customer_history(t):
    """Whole numbers about each customer, and what they spent (null without orders)."""
    def count_if(condition):
        return F.count(F.when(condition, 1))

    orders = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"),
                                               count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    lines = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(
        F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"), count_if(F.col("l_returnflag") == "R").alias("returned"))
    whole = t.customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("k") == F.col("c_custkey"), "left")
    return whole.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), F.floor(F.col("c_acctbal") / 500).cast("double").alias("balance"),
                        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("n_orders", "urgent", "n_open", "n_lines", "quantity", "returned")], "spent")


@query("c31_mutual_information_neighbours", f"""
WITH {CUSTOMER_HISTORY}, m AS (SELECT c_custkey AS id, spent AS y, unnest(['c_acctbal','quantity','n_orders']) AS "column", unnest([c_acctbal,quantity,n_orders]) AS x FROM h WHERE spent IS NOT NULL),
z AS (SELECT "column", id, x/stddev_samp(x) OVER w AS x, y/stddev_samp(y) OVER w AS y FROM m WINDOW w AS (PARTITION BY "column")),
e AS (SELECT "column", a.id, any_value(a.x) AS x, any_value(a.y) AS y, min(greatest(abs(a.x-b.x),abs(a.y-b.y)),4)[4] AS r FROM z a JOIN z b USING ("column") GROUP BY 1,2),
c AS (SELECT "column", e.id, count(*) FILTER (abs(e.x-z.x) < greatest(r-1e-12*(abs(e.x)+r),1e-12*(abs(e.x)+r))) AS nx,
 count(*) FILTER (abs(e.y-z.y) < greatest(r-1e-12*(abs(e.y)+r),1e-12*(abs(e.y)+r))) AS ny FROM e JOIN z USING ("column") GROUP BY 1,2),
s AS (SELECT i AS n, coalesce(sum(1.0/i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) - 0.5772156649015329 AS psi FROM (SELECT unnest(range(1,(SELECT count(*)+2 FROM customer))) AS i)),
g AS (SELECT "column", count(*) AS n, avg(a.psi+b.psi) AS p FROM c JOIN s a ON a.n=nx JOIN s b ON b.n=ny GROUP BY 1),
r AS (SELECT "column", g.n, greatest(0, t.psi + 1.5 - 0.5772156649015329 - p) AS mi FROM g JOIN s t ON t.n=g.n)
SELECT "column", n, round(mi,6)+0.0 AS mi, round(mi/max(mi) OVER (),6)+0.0 AS score FROM r""")
def _(t):
    return rounded(CO.mutual_information_neighbours(customer_history(t), "spent", ["c_acctbal", "quantity", "n_orders"], "c_custkey"), 6)


@query("c32_target_entropy", "SELECT sum(n)::BIGINT AS n, round(-sum(n/t*ln(n/t)),6) AS entropy FROM (SELECT count(*)::DOUBLE n, sum(count(*)) OVER () t FROM events GROUP BY event_type)")
def _(t):
    return rounded(D.entropy(t.events, "event_type"), 6)


@query("c33_qq_points", """
SELECT (row_number() OVER () - 1)::INT AS point, round((q-m)/s,5)+0.0 AS sample FROM (
 SELECT unnest(quantile_cont(o_totalprice, [""" + ",".join(str((i + .5) / 100) for i in range(100)) + """])) AS q, avg(o_totalprice) m, stddev_samp(o_totalprice) s FROM orders)""")
def _(t):
    return CH.qq_points(t.orders, "o_totalprice").select("point", rnd("sample", 5).alias("sample"))


@query("c34_kernel_density", """
WITH s AS (SELECT count(value) n, min(value) lo, max(value) hi, avg(value) m, stddev_samp(value) sd FROM events),
p AS (SELECT *, 1.06*sd*pow(n,-0.2) h, (hi-lo)/512 w, (hi-lo)/99 step FROM s),
b AS (SELECT least(floor((value-lo)/w),511) AS b, count(*) c FROM events, p GROUP BY 1),
g AS (SELECT range AS point FROM range(100))
SELECT point::INT AS point, round(any_value(lo+point*step),5) AS x, round(sum(c*exp(-pow((lo+point*step-(lo+(b+0.5)*w))/h,2)/2))/any_value(n*h*sqrt(2*pi())),7) AS density,
 round(any_value(exp(-pow((lo+point*step-m)/sd,2)/2)/(sd*sqrt(2*pi()))),7) AS normal FROM g, b, p GROUP BY point""")
def _(t):
    return rounded(CH.kernel_density(t.events, "value"), 7, x=5)
