"""User SQL, and user functions over tables."""

from pyspark.sql import functions as F

from lodestat.functions.expr import rnd
from lodestat.plans import sqlview as V
from lodestat.queries.registry import query
from lodestat.session import scratch_path
from lodestat.sources.versions import Dataset


def shared(name, sql, views):
    """Register a statement that reads the same in both engines; tables appear under their own names."""
    query(name, sql)(lambda t: V.run_sql(sql, **{v: getattr(t, v) for v in views}))


shared("j01_projection_case", """
SELECT o_orderkey, round(o_totalprice / 1000, 3) AS thousands, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band
FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice IS NOT NULL""", ["orders"])

shared("j02_aggregates_having", """
SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice), 2) AS total, count(*) FILTER (WHERE l_discount > 0.05) AS discounted
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20""", ["lineitem"])

shared("j03_grouping_sets", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""", ["lineitem"])

shared("j03_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)", ["customer"])
shared("j03_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)", ["nation"])

shared("j04_inner_join", """
SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""", ["orders", "customer", "nation"])

shared("j04_outer_joins", """
SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, customers FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s
FULL OUTER JOIN (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal < 1000 GROUP BY c_nationkey) c ON s_nationkey = c_nationkey""", ["supplier", "customer"])

shared("j04_semi_anti", """
SELECT 'with' AS side, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""", ["customer", "orders"])

shared("j04_self_theta_join", """
SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""", ["nation"])

shared("j05_set_operations", """
(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""", ["customer", "supplier"])
shared("j05_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", ["customer", "supplier"])

shared("j06_windows", """
SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS price_rank, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three,
 ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders""", ["orders"])

shared("j07_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25", ["lineitem"])

shared("j08_subqueries", """
WITH per AS (SELECT o_custkey, avg(o_totalprice) AS mean_price FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, count(*) AS n FROM customer JOIN per ON o_custkey = c_custkey WHERE mean_price > (SELECT avg(o_totalprice) FROM orders) GROUP BY c_mktsegment""", ["customer", "orders"])


@query("j09_scalar_functions", """
SELECT event_id, upper(substr(event_type,1,2)) AS head, year(ts)*100+month(ts) AS ym, round(ln(1+value),6) AS l, json_extract_string(props,'$.k')::INT AS k, length(event_type) AS len FROM events""")
def _(t):
    return V.run_sql("""SELECT event_id, upper(substr(event_type,1,2)) AS head, year(ts)*100+month(ts) AS ym, round(ln(1+value),6) AS l,
 CAST(get_json_object(props,'$.k') AS INT) AS k, length(event_type) AS len FROM df""", df=t.events)


@query("j10_save_as_version", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def _(t):
    ds = Dataset(t.spark, scratch_path(t.spark, "part"))
    ds.write(t.part, "raw")
    return ds.read(V.sql_to_version(ds, "SELECT p_brand, count(*) AS n FROM df WHERE p_size > 10 GROUP BY p_brand"))


@query("k01_user_transform", "SELECT o_orderkey, o_totalprice * 1.2::DOUBLE AS gross FROM orders")
def _(t):
    return V.user_transform(t.orders, lambda d: d.select("o_orderkey", (F.col("o_totalprice") * 1.2).alias("gross")))


@query("k01_user_group_transform", "SELECT event_type, round(max(value)-min(value),6) AS span FROM events GROUP BY 1")
def _(t):
    import pandas as pd

    def span(p):
        return pd.DataFrame({"event_type": [p["event_type"].iloc[0]], "span": [p["value"].max() - p["value"].min()]})

    # values are reduced to daily extremes first, so no group carries its raw rows
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    small = daily.select("event_type", F.explode(F.array("hi", "lo")).alias("value"))
    return V.user_group_transform(small, ["event_type"], span, "event_type string, span double").select("event_type", rnd("span").alias("span"))


@query("k02_user_analysis", "SELECT p_brand, round(avg(p_retailprice),4) AS mean_price FROM part WHERE p_size >= 20 GROUP BY 1")
def _(t):
    V.register_analysis("brand_price")(lambda df, size: df.where(F.col("p_size") >= size).groupBy("p_brand").agg(rnd(F.avg("p_retailprice"), 4).alias("mean_price")))
    return V.run_analysis("brand_price", t.part, size=20)
