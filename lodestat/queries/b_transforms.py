"""Projection, filters, cleaning and column transforms."""

from pyspark.sql import functions as F

from lodestat.functions.expr import rnd
from lodestat.operators import cleaning as C
from lodestat.operators import describe as D
from lodestat.operators import transforms as X
from lodestat.queries.c_describe import rounded
from lodestat.queries.registry import query

HOLES_SQL = "(SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 7 IN (0,1) THEN NULL ELSE o_totalprice END AS price FROM orders)"


def holes(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority",
                           F.expr("CASE WHEN o_orderkey % 7 IN (0,1) THEN NULL ELSE o_totalprice END").alias("price"))


@query("b01_computed_column", """
SELECT o_orderkey, round(log10(o_totalprice)*2 + sqrt(o_totalprice) / (1 + o_custkey) - (o_custkey - 7*floor(o_custkey/7)),6) AS score,
 round(CASE WHEN o_totalprice - 200000 > 0 THEN ln(o_totalprice - 200000) END,6) AS gap FROM orders""")
def _(t):
    df = X.compute_column(t.orders, "score", "log10(o_totalprice)*2 + sqrt(o_totalprice)/(1 + o_custkey) - o_custkey % 7")
    return rounded(X.compute_column(df, "gap", "log(o_totalprice - 200000)").select("o_orderkey", "score", "gap"), 6)


@query("b02_deduplicate", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, min_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def _(t):
    return C.deduplicate(t.orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("b02_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return C.deduplicate(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("b03_impute_drop", f"SELECT o_orderkey, price FROM {HOLES_SQL} WHERE price IS NOT NULL")
def _(t):
    return C.impute_drop(holes(t), ["price"]).select("o_orderkey", "price")


@query("b04_impute_values", f"""
WITH h AS (SELECT o_orderkey, price AS a, price AS b, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS c, price AS d FROM {HOLES_SQL})
SELECT o_orderkey, round(coalesce(a, (SELECT avg(a) FROM h)),4) AS a, round(coalesce(b, (SELECT median(b) FROM h)),4) AS b,
 coalesce(c, (SELECT c FROM h WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)) AS c, coalesce(d, -1.5) AS d FROM h""")
def _(t):
    df = holes(t).select("o_orderkey", F.col("price").alias("a"), F.col("price").alias("b"),
                         F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END").alias("c"), F.col("price").alias("d"))
    return rounded(C.impute(df, {"a": "mean", "b": "median", "c": "mean", "d": "constant"}, {"d": -1.5}))


@query("b05_impute_knn", """
WITH s AS (SELECT stddev_samp(p_retailprice) AS sr, stddev_samp(p_size) AS ss FROM part WHERE p_partkey % 9 <> 0),
p AS (SELECT a.p_partkey, b.p_retailprice AS price, row_number() OVER (PARTITION BY a.p_partkey
 ORDER BY sqrt(pow((a.p_retailprice-b.p_retailprice)/sr,2)+pow((a.p_size-b.p_size)/ss,2)), b.p_partkey) AS rank FROM part a, part b, s WHERE a.p_partkey % 9 = 0 AND b.p_partkey % 9 <> 0),
g AS (SELECT p_partkey, avg(price) AS guess FROM p WHERE rank <= 5 GROUP BY 1)
SELECT p_partkey, p_size, p_retailprice, round(coalesce(guess, p_retailprice),4)+0.0 AS price FROM part LEFT JOIN g USING (p_partkey)""")
def _(t):
    df = t.part.select("p_partkey", "p_size", "p_retailprice", F.expr("CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END").alias("price"))
    return C.impute_knn(df, "price", ["p_retailprice", "p_size"], "p_partkey").withColumn("price", rnd("price", 4))


@query("b06_fill_order", f"""
SELECT o_orderkey, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING),
 first_value(price IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM {HOLES_SQL}""")
def _(t):
    return C.impute_fill(holes(t), ["price"], ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "price")


@query("b06_fill_whole_table", f"""
SELECT o_orderkey, coalesce(last_value(price IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING),
 first_value(price IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM {HOLES_SQL}""")
def _(t):
    return C.impute_fill(holes(t), ["price"], ["o_orderkey"], rows_per_slice=4000).select("o_orderkey", "price")


@query("b07_interpolate", f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM {HOLES_SQL}),
w AS (SELECT *, last_value(price IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0,
 first_value(price IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1 FROM p
 WINDOW a AS (ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT o_orderkey, round(coalesce(price, v0 + (v1-v0)*(i-i0)/(i1-i0), v1, v0, 0),4) AS price FROM w""")
def _(t):
    return rounded(C.interpolate(holes(t), ["price"], ["o_orderkey"], rows_per_slice=4000).select("o_orderkey", "price"))


@query("b08_outlier_detect", """
WITH s AS (SELECT quantile_cont(value,.25) q1, quantile_cont(value,.75) q3, avg(value) m, stddev_samp(value) sd FROM events)
SELECT event_id, value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1) AS iqr, abs(value-m)/sd > 3 AS z FROM events, s""")
def _(t):
    return t.events.select("event_id", C.outlier_test(t.events, ["value"], "iqr")["value"].alias("iqr"),
                           C.outlier_test(t.events, ["value"], "zscore")["value"].alias("z"))


@query("b09_isolation_forest")
def _(t):
    return C.isolation_outliers(t.events, ["value"], "event_id", trees=50).where("is_outlier").select("event_id", "value", "anomaly_score")


@query("b09_isolation_forest_many_columns")
def _(t):
    df = t.lineitem.withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return C.isolation_outliers(df, ["l_quantity", "l_extendedprice", "l_discount"], "key", trees=50).where("is_outlier").select(
        "l_orderkey", "l_linenumber", "anomaly_score")


_B10 = "WITH s AS (SELECT quantile_cont(value,.25) q1, quantile_cont(value,.75) q3, quantile_cont(value,.01) lo, quantile_cont(value,.99) hi, min(value) mn FROM events) "


@query("b10_outlier_cap", _B10 + "SELECT event_id, round(greatest(lo, least(hi, value)),6) AS value FROM events, s")
def _(t):
    return rounded(C.treat_outliers(t.events, ["value"]).select("event_id", "value"), 6)


@query("b10_outlier_remove", _B10 + "SELECT event_id, value FROM events, s WHERE NOT (value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1))")
def _(t):
    return C.treat_outliers(t.events, ["value"], treatment="remove").select("event_id", "value")


@query("b10_outlier_flag_log", _B10 + """SELECT event_id, round(ln(1 + CASE WHEN mn <= 0 THEN value - mn + 1 ELSE value END),6) AS value,
 (value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1))::INT AS value_is_outlier FROM events, s""")
def _(t):
    flagged = C.treat_outliers(t.events, ["value"], treatment="flag")
    logged = C.treat_outliers(flagged, ["value"], treatment="log")
    return rounded(logged.select("event_id", "value", "value_is_outlier"), 6)


@query("b11_scale", """
WITH s AS (SELECT avg(p_size) m, stddev_pop(p_size) sd, min(p_size) lo, max(p_size) hi, median(p_size) md, quantile_cont(p_size,.25) q1, quantile_cont(p_size,.75) q3 FROM part)
SELECT p_partkey, round((p_size-m)/sd,6)+0.0 AS standard, round((p_size-lo)/(hi-lo)::DOUBLE,6) AS minmax, round((p_size-md)/(q3-q1),6)+0.0 AS robust,
 round(p_size/hi::DOUBLE,6) AS maxabs, round(ln(1+p_size),6) AS log FROM part, s""")
def _(t):
    methods = ["standard", "minmax", "robust", "maxabs", "log"]
    df = t.part.select("p_partkey", *[F.col("p_size").cast("double").alias(m) for m in methods])
    for m in methods:
        df = C.scale(df, [m], m)
    return rounded(df, 6)


@query("b12_one_hot", """
SELECT o_orderkey, (o_orderstatus='O')::INT AS "o_orderstatus_O", (o_orderstatus='P')::INT AS "o_orderstatus_P" FROM orders""")
def _(t):
    return C.encode_one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus")


_LABEL = "(SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)"


def segments(t):
    return t.customer.select("c_custkey", "c_acctbal", F.expr("CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END").alias("seg"))


@query("b13_label", f"SELECT c_custkey, CASE WHEN seg IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY seg NULLS LAST) - 1 END AS seg FROM {_LABEL}")
def _(t):
    return C.encode_label(segments(t), "seg").select("c_custkey", "seg")


@query("b14_target_mean", f"SELECT c_custkey, CASE WHEN seg IS NOT NULL THEN round(avg(c_acctbal) OVER (PARTITION BY seg),4) END AS seg FROM {_LABEL}")
def _(t):
    return rounded(C.encode_target(segments(t), "seg", "c_acctbal").select("c_custkey", "seg"))


@query("b15_binary_bits", f"""SELECT c_custkey, (code & 1)::INT AS seg_bit0, ((code >> 1) & 1)::INT AS seg_bit1, ((code >> 2) & 1)::INT AS seg_bit2 FROM
 (SELECT c_custkey, CASE WHEN seg IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY seg NULLS LAST) - 1 END AS code FROM {_LABEL})""")
def _(t):
    return C.encode_binary(segments(t), "seg").drop("c_acctbal")


@query("b16_cleaning_steps", f"""
WITH d AS (SELECT DISTINCT o_custkey, price FROM {HOLES_SQL}), f AS (SELECT o_custkey, coalesce(price, (SELECT median(price) FROM d)) AS price FROM d)
SELECT o_custkey::DOUBLE AS o_custkey, round(price,4) AS price FROM f""")
def _(t):
    df, _log = C.clean(holes(t).select("o_custkey", "price"))
    return rounded(df.select(F.col("o_custkey").cast("double").alias("o_custkey"), "price"))


@query("b17_logs_and_root", """
WITH m AS (SELECT min(c_acctbal) lo FROM customer)
SELECT c_custkey, round(log10(c_acctbal + CASE WHEN lo <= 0 THEN abs(lo)+1 ELSE 0 END),6)+0.0 AS c_acctbal_log, round(ln(1 + c_acctbal + CASE WHEN lo < 0 THEN abs(lo)+1 ELSE 0 END),6)+0.0 AS c_acctbal_log1p,
 round(sqrt(c_acctbal + CASE WHEN lo < 0 THEN abs(lo) ELSE 0 END),6) AS c_acctbal_sqrt FROM customer, m""")
def _(t):
    df = t.customer.select("c_custkey", "c_acctbal")
    for k in ("log", "log1p", "sqrt"):
        df = X.transform(df, "c_acctbal", k)
    return rounded(df.drop("c_acctbal"), 6)


@query("b18_reciprocal_square", "SELECT event_id, round(CASE WHEN value <> 0 THEN 1/value END,6) AS inv, round(value*value,4) AS sq FROM events")
def _(t):
    df = X.transform(X.transform(t.events, "value", "reciprocal", "inv"), "value", "square", "sq")
    return df.select("event_id", rnd("inv", 6).alias("inv"), rnd("sq", 4).alias("sq"))


@query("b19_box_cox")
def _(t):
    return X.transform(t.events, "value", "boxcox").select("event_id", "value", "value_boxcox")


@query("b20_yeo_johnson")
def _(t):
    return X.transform(t.customer, "c_acctbal", "yeo_johnson").select("c_custkey", "c_acctbal", "c_acctbal_yeo_johnson")


@query("b21_rescale", """
WITH s AS (SELECT avg(p_retailprice) m, stddev_samp(p_retailprice) sd, min(p_retailprice) lo, max(p_retailprice) hi, median(p_retailprice) md,
 quantile_cont(p_retailprice,.25) q1, quantile_cont(p_retailprice,.75) q3 FROM part)
SELECT p_partkey, round((p_retailprice-m)/sd,6)+0.0 AS p_retailprice_standardize, round((p_retailprice-lo)/(hi-lo),6)+0.0 AS p_retailprice_minmax,
 round((p_retailprice-md)/(q3-q1),6)+0.0 AS p_retailprice_robust_scale FROM part, s""")
def _(t):
    df = t.part.select("p_partkey", "p_retailprice")
    for k in ("standardize", "minmax", "robust_scale"):
        df = X.transform(df, "p_retailprice", k)
    return rounded(df.drop("p_retailprice"), 6)


@query("b22_differences", """
SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w,4)+0.0 AS o_totalprice_diff, round(o_totalprice - 2*lag(o_totalprice) OVER w + lag(o_totalprice,2) OVER w,4)+0.0 AS o_totalprice_diff2,
 round(o_totalprice - lag(o_totalprice,12) OVER w,4)+0.0 AS o_totalprice_seasonal_diff FROM orders WINDOW w AS (ORDER BY o_orderkey)""")
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    for k in ("diff", "diff2", "seasonal_diff"):
        df = X.transform(df, "o_totalprice", k, order=["o_orderkey"])
    return rounded(df.drop("o_totalprice"), 4)


@query("b23_detrend", """
WITH p AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events),
f AS (SELECT event_type, regr_slope(value, i) b, regr_intercept(value, i) a FROM p GROUP BY 1)
SELECT event_id, round(value - a - b*i,5)+0.0 AS value_detrend FROM p JOIN f USING (event_type)""")
def _(t):
    return rounded(X.transform(t.events, "value", "detrend", order=["event_id"], by=["event_type"]).select("event_id", "value_detrend"), 5)


@query("b24_winsorize", "SELECT event_id, round(greatest((SELECT quantile_cont(value,.01) FROM events), least((SELECT quantile_cont(value,.99) FROM events), value)),6) AS value_winsorize FROM events")
def _(t):
    return rounded(X.transform(t.events, "value", "winsorize").select("event_id", "value_winsorize"), 6)


@query("b25_average_rank", "SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1)/2.0::DOUBLE AS value_rank FROM events")
def _(t):
    return X.transform(t.events, "value", "rank").select("event_id", "value_rank")


@query("b26_lag", "SELECT event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS value_lag FROM events")
def _(t):
    return X.transform(t.events, "value", "lag", order=["event_id"], by=["user_id"], lag=2).select("event_id", "value_lag")


@query("b27_rolling", """
SELECT event_id, round(avg(value) OVER w,5) AS value_rolling_mean, round(CASE WHEN count(value) OVER w >= 2 THEN stddev_samp(value) OVER w END,5) AS value_rolling_std
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(t):
    df = X.transform(t.events, "value", "rolling_mean", order=["event_id"], by=["event_type"], window=5)
    df = X.transform(df, "value", "rolling_std", order=["event_id"], by=["event_type"], window=5)
    return rounded(df.select("event_id", "value_rolling_mean", "value_rolling_std"), 5)


@query("b28_pct_change", "SELECT o_orderkey, round(o_totalprice/lag(o_totalprice,3) OVER (ORDER BY o_orderkey) - 1,5)+0.0 AS o_totalprice_pct_change FROM orders")
def _(t):
    return rounded(X.transform(t.orders, "o_totalprice", "pct_change", order=["o_orderkey"], periods=3).select("o_orderkey", "o_totalprice_pct_change"), 5)


@query("b29_transform_list", """
WITH x AS (SELECT log10(o_totalprice) AS a, sqrt(o_totalprice) AS b FROM orders)
SELECT 'o_totalprice_log' AS result, round((SELECT avg(o_totalprice) FROM orders),2) AS mean_before, round(avg(a),6) AS mean_after, round(stddev_samp(a),6) AS std_after, round(skewness(a),4) AS skewness_after FROM x
UNION ALL SELECT 'o_totalprice_sqrt', round((SELECT avg(o_totalprice) FROM orders),2), round(avg(b),6), round(stddev_samp(b),6), round(skewness(b),4) FROM x""")
def _(t):
    df = X.apply_transforms(t.orders, [{"column": "o_totalprice", "transform": "log"}, {"column": "o_totalprice", "transform": "sqrt"}])
    out = X.before_after(df, [("o_totalprice", "o_totalprice_log"), ("o_totalprice", "o_totalprice_sqrt")])
    return out.select("result", rnd("mean_before", 2).alias("mean_before"), rnd("mean_after").alias("mean_after"),
                      rnd("std_after").alias("std_after"), rnd("skewness_after", 4).alias("skewness_after"))


@query("b30_transform_catalogue")
def _(t):
    # each transform starts from the table: in a chain, every one would run those before it again
    base, out = t.events.select("event_id", "value"), None
    for key in X.CATALOGUE:
        one = D.moment_table(X.transform(base, "value", key, order=["event_id"]), [f"value_{key}"]).select("column", "n", "mean", "std")
        out = one if out is None else out.unionByName(one)
    return out


@query("b31_recommendations", """
WITH s AS (SELECT skewness(value) sk, kurtosis(value) ku, quantile_cont(value,.25) q1, quantile_cont(value,.75) q3 FROM events),
o AS (SELECT 100.0*count(*) FILTER (value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1))/count(*) AS pct FROM events, s)
SELECT 'value' AS "column", unnest(CASE WHEN sk > 2 THEN ['skewness_positive'] WHEN sk > 1 THEN ['skewness_moderate'] WHEN sk < -1 THEN ['skewness_negative'] ELSE [] END
 || CASE WHEN ku > 7 THEN ['heavy_tails'] ELSE [] END || CASE WHEN pct > 5 THEN ['outliers'] ELSE [] END) AS issue FROM s, o
UNION ALL SELECT 'v2', unnest(CASE WHEN sk > 2 THEN ['skewness_positive'] WHEN sk > 1 THEN ['skewness_moderate'] ELSE [] END || CASE WHEN ku > 7 THEN ['heavy_tails'] ELSE [] END || CASE WHEN pct > 5 THEN ['outliers'] ELSE [] END) FROM s, o
UNION ALL SELECT unnest(['value','v2']), unnest(['scale_difference','scale_difference'])
UNION ALL SELECT unnest(['value','v2']), unnest(['multicollinearity','multicollinearity']) UNION ALL SELECT 'value', 'high_correlation' """)
def _(t):
    df = t.events.select("value", (F.col("value") * 1000 + F.col("event_id") % 3).alias("v2"))
    return X.recommend(df).select("column", "issue")


def _missing_sql(c, text):
    top = f"(SELECT max(k) FROM (SELECT count(*) k FROM h WHERE {c} IS NOT NULL GROUP BY {c}))"
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count(DISTINCT {c}) AS cardinality, count(*)-count({c}) AS null_count,
 round((count(*)-count({c}))/count(*)::DOUBLE,6) AS null_rate, round({top}/count({c})::DOUBLE,6) AS top_share, count(DISTINCT {c}) <= 1 AS constant,
 count(DISTINCT {c}) <= 1 OR {top}/count({c})::DOUBLE > .98 AS near_constant,
 {text} AND count({c}) >= 20 AND count(DISTINCT {c}) >= .95*count({c}) AS identifier_like FROM h"""


@query("b32_missing_and_constant", f"WITH h AS (SELECT o_orderkey, price, o_orderpriority, 1 AS one, 'k' || o_orderkey AS tag FROM {HOLES_SQL}) " + " UNION ALL ".join(
    _missing_sql(c, x) for c, x in (("o_orderkey", "false"), ("price", "false"), ("o_orderpriority", "true"), ("one", "false"), ("tag", "true"))))
def _(t):
    df = holes(t).select("o_orderkey", "price", "o_orderpriority", F.lit(1).alias("one"), F.concat(F.lit("k"), "o_orderkey").alias("tag"))
    return rounded(D.missing_summary(df), 6)


@query("b32_duplicate_rows", """
SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)) AS duplicates,
 round(1 - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem))/count(*)::DOUBLE,6) AS duplicate_ratio FROM lineitem""")
def _(t):
    return rounded(D.duplicate_summary(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")), 6)


@query("b33_predicate_filters", """
SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag IN ('A','R') AND l_shipdate IS NOT NULL""")
def _(t):
    return X.filter_rows(t.lineitem, [("l_quantity", ">=", 45), ("l_discount", "<", 0.03), ("l_returnflag", "in", ["A", "R"]),
                                      ("l_shipdate", "is not null")]).select("l_orderkey", "l_quantity", "l_discount")


@query("b34_decimal_year", "SELECT o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate)-1)/365.25,6) AS t FROM orders")
def _(t):
    return rounded(X.decimal_year(t.orders, "o_orderdate", "t").select("o_orderkey", "t"), 6)


@query("b35_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '#42'), o_orderkey LIMIT 500")
def _(t):
    return X.sample_rows(t.orders, "o_orderkey", 500).select("o_orderkey")


@query("b35_stratified_sample", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE ('0x' || substr(md5(o_orderpriority || '|' || o_orderkey),1,8))::BIGINT/4294967296.0::DOUBLE < 0.1""")
def _(t):
    return X.stratified_sample(t.orders, "o_orderkey", "o_orderpriority", 0.1).select("o_orderkey", "o_orderpriority")


@query("b36_transform_preview", """
SELECT 'value' AS source, 'log1p' AS result, count(value) AS n_before, round(avg(value),5) AS mean_before, round(skewness(value),4) AS skewness_before, round(kurtosis(value),4) AS kurtosis_before,
 round(avg(ln(1+value)),5) AS mean_after, round(skewness(ln(1+value)),4) AS skewness_after, round(kurtosis(ln(1+value)),4) AS kurtosis_after FROM events""")
def _(t):
    out = X.transform_preview(t.events, "value", "log1p")
    return rounded(out.select("source", "result", "n_before", rnd("mean_before", 5).alias("mean_before"), "skewness_before", "kurtosis_before",
                              rnd("mean_after", 5).alias("mean_after"), "skewness_after", "kurtosis_after"), 5,
                   skewness_before=4, kurtosis_before=4, skewness_after=4, kurtosis_after=4)


@query("b37_drop_poor_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(t):
    df = t.orders.select("o_orderkey", "o_orderpriority", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 1.5 END").alias("sparse"), F.lit("x").alias("one"))
    return C.drop_poor_columns(df)
