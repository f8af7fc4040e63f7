"""Factor analysis, clustering, supervised models, what-if scoring."""

import numpy as np
from pyspark.sql import functions as F

from lodestat.functions.expr import local_rows, rnd, unit_hash
from lodestat.operators import attributions as AT
from lodestat.operators import boosting as BO
from lodestat.operators import clustering as K
from lodestat.operators import dendrogram as DG
from lodestat.operators import factor as FA
from lodestat.operators import linear as L
from lodestat.operators import supervised as M
from lodestat.operators import whatif as W
from lodestat.operators.pivot_join import pivot_join
from lodestat.queries.c_describe import CUSTOMER_HISTORY, LINE_KEY, LINE_NUM, customer_history, rounded
from lodestat.queries.registry import query
from lodestat.session import cut_lineage


@query("f01_pca_variance")
def _(t):
    return FA.pca_variance(t.lineitem, LINE_NUM)


@query("f01_pca_variables")
def _(t):
    return FA.pca_variables(t.lineitem, LINE_NUM, 2)


@query("f01_pca_scores")
def _(t):
    return FA.pca_scores(t.lineitem, LINE_NUM).select("l_orderkey", "l_linenumber", "axis1", "axis2", "cos2")


@query("f02_correspondence")
def _(t):
    return FA.correspondence(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "o_orderpriority", "c_mktsegment")


@query("f02_inertia", """
WITH c AS (SELECT lang a, source b, count(*)::DOUBLE o FROM documents GROUP BY 1,2), r AS (SELECT a, sum(o) r FROM c GROUP BY 1), s AS (SELECT b, sum(o) s FROM c GROUP BY 1), n AS (SELECT sum(o) n FROM c)
SELECT round((sum(pow(coalesce(o,0)-r*s/n,2)/(r*s/n)))/any_value(n),6) AS inertia FROM r CROSS JOIN s CROSS JOIN n LEFT JOIN c USING (a,b)""")
def _(t):
    ca = FA.correspondence(t.documents, "lang", "source", axes=3).select("axis", "inertia").distinct()
    return ca.groupBy("axis").agg(F.max("inertia").alias("inertia")).agg(rnd(F.sum("inertia")).alias("inertia"))


@query("f03_multiple_correspondence")
def _(t):
    return FA.mca_levels(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("f03_mca_variance", "SELECT round(count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) + count(DISTINCT l_linenumber) - 3, 6)/3.0::DOUBLE AS total FROM lineitem")
def _(t):
    return FA.mca_variance(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"]).agg(rnd(F.sum("inertia")).alias("total"))


@query("f03_mca_rows_and_links")
def _(t):
    links = FA.mca_links(t.lineitem, ["l_returnflag", "l_linestatus"], 2)
    rows = FA.mca_rows(t.lineitem, ["l_returnflag", "l_linestatus"], 2).groupBy("l_returnflag", "l_linestatus").agg(F.avg("axis1").alias("axis1"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("what"), "axis1", F.col("n").cast("double").alias("value")).unionByName(
        links.select(F.concat_ws("@", "variable", F.col("axis").cast("string")).alias("what"), F.lit(None).cast("double").alias("axis1"), F.col("eta2").alias("value")))


@query("f04_k_means")
def _(t):
    return K.k_means(t.part, ["p_size", "p_retailprice"], ks=(2, 3, 4))[0].select("p_partkey", "cluster")


@query("f05_gaussian_mixture")
def _(t):
    return K.mixture(t.part, ["p_size", "p_retailprice"], ks=(2, 3))[0].select("p_partkey", "cluster")


@query("f06_density_clusters")
def _(t):
    return K.density_clusters(t.customer.withColumn("bal", F.col("c_acctbal")), ["bal", "c_nationkey"], "c_custkey", eps=0.15, min_points=5)


@query("f07_top_down_clusters")
def _(t):
    return K.top_down(t.part, ["p_size", "p_retailprice"], ks=(2, 3, 4))[0].select("p_partkey", "cluster")


@query("f07_ward_tree")
def _(t):
    return DG.agglomerative(t.part, ["p_size", "p_retailprice"]).table().withColumn("height", rnd("height"))


@query("f07_ward_clusters")
def _(t):
    tree = DG.agglomerative(t.part, ["p_size", "p_retailprice"])
    return tree.cut_by_silhouette(t.part, (2, 3, 4))[0].select("p_partkey", "cluster")


# what the merges add to the sum of squares, with what lies inside the summaries, is the whole sum of squares
@query("f07_ward_balance", """
WITH s AS (SELECT count(*) AS n, var_pop(p_size) AS a, var_pop(p_retailprice) AS b, avg(p_size) AS ma, avg(p_retailprice) AS mb FROM part)
SELECT any_value(n) AS rows, round(sum((p_size-ma)*(p_size-ma)/a + (p_retailprice-mb)*(p_retailprice-mb)/b)/any_value(n),6) AS squares_per_row FROM part, s""")
def _(t):
    tree = DG.agglomerative(t.part, ["p_size", "p_retailprice"])
    whole = tree.table().agg(F.max("rows").alias("rows"), F.sum(F.col("height") * F.col("height") / 2).alias("joined"))
    return whole.select("rows", rnd(F.col("joined") / (1 - tree.within) / F.col("rows")).alias("squares_per_row"))


# in one column single linkage joins at the gaps between neighbouring values, smallest first
@query("f07_single_linkage", """
WITH v AS (SELECT DISTINCT p_retailprice * p_retailprice AS x FROM part), g AS (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM v)
SELECT row_number() OVER (ORDER BY gap) - 1 AS step, round(gap,4) AS height FROM g WHERE gap IS NOT NULL""")
def _(t):
    squared = t.part.withColumn("x", F.col("p_retailprice") * F.col("p_retailprice"))
    return DG.agglomerative(squared, ["x"], "single", summaries=2000, standardise=False).table().select("step", rnd("height", 4).alias("height"))


@query("f08_cluster_summary", """
SELECT c_nationkey % 4 AS cluster, count(*) AS rows, round(count(*)*100.0::DOUBLE/(SELECT count(*) FROM customer),6) AS percent, round(avg(c_acctbal),4) AS mean_c_acctbal FROM customer GROUP BY 1""")
def _(t):
    return rounded(K.cluster_summary(t.customer.withColumn("cluster", F.col("c_nationkey") % 4), ["c_acctbal"]), 6, mean_c_acctbal=4)


_H = "('0x' || substr(md5({}),1,8))::BIGINT/4294967296.0::DOUBLE"


@query("f09_random_split", f"SELECT o_orderkey, CASE WHEN {_H.format(chr(39).join(['o_orderstatus || ', '|', ' || o_orderkey || ', '|42', '']))} < .2 THEN 'test' ELSE 'train' END AS part FROM orders")
def _(t):
    return M.random_split(t.orders, "o_orderkey", "o_orderstatus").select("o_orderkey", "part")


@query("f10_time_split", """
SELECT event_id, CASE WHEN epoch_us(ts)::DOUBLE > (SELECT quantile_cont(epoch_us(ts)::DOUBLE,.8) FROM events) THEN 'test' ELSE 'train' END AS part FROM events""")
def _(t):
    return M.time_split(t.events, "ts").select("event_id", "part")


def documents_labelled(t):
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("f11_feature_preparation")
def _(t):
    data, nums, cats = M.prepare(documents_labelled(t).drop("toxic"), "quality", ["doc_id"])
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    out = Pipeline(stages=M.feature_stages(nums, cats)).fit(data).transform(data)
    return out.select("doc_id", F.size(vector_to_array("features")).alias("width"))


def _fit_lines(t, names):
    data = t.lineitem.select(*[F.col(c).cast("double").alias(c) for c in LINE_NUM]).withColumn("label", F.col("l_extendedprice") / 1000)
    nums = ["l_quantity", "l_discount", "l_tax"]
    models, ready, out = M.regressors(), M.prepared_features(data, nums, []), None
    for n in names:
        scored = M.train(data, nums, [], models[n](), ready).transform(data)
        row = M.regression_metrics(scored, "label", "prediction").withColumn("model", F.lit(n))
        out = row if out is None else out.unionByName(row)
    return out


@query("f12_linear_models")
def _(t):
    return _fit_lines(t, ["linear", "ridge", "lasso", "elastic_net"])


@query("f12_linear_fit", """
WITH c AS (SELECT count(*) n, var_pop(l_extendedprice) v, regr_slope(l_extendedprice,l_quantity) b, regr_intercept(l_extendedprice,l_quantity) a FROM lineitem)
SELECT any_value(n) AS n, round(sqrt(avg(pow(l_extendedprice-a-b*l_quantity,2))),3) AS rmse, round(1-avg(pow(l_extendedprice-a-b*l_quantity,2))/any_value(v),6)+0.0 AS r2 FROM lineitem, c""")
def _(t):
    data = t.lineitem.select(F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").alias("label"))
    scored = M.train(data, ["l_quantity"], [], M.regressors()["linear"]()).transform(data)
    return rounded(M.regression_metrics(scored, "label", "prediction").select("n", "rmse", "r2"), 3, r2=6)


@query("f13_polynomial")
def _(t):
    return _fit_lines(t, ["polynomial"])


@query("f14_f15_f16_tree_regressors")
def _(t):
    return _fit_lines(t, ["decision_tree", "random_forest", "gradient_boosting"])


def _fit_classes(t, names):
    data, nums, cats = M.prepare(documents_labelled(t).drop("toxic"), "quality", ["doc_id"])
    data, levels = M.label_column(data, "quality", True)
    out = None
    for n in names:
        scored = M.train(data, nums, cats, M.classifiers(len(levels))[n]()).transform(data)
        row = M.classification_metrics(scored, "label", "prediction").withColumn("model", F.lit(n))
        out = row if out is None else out.unionByName(row)
    return out


@query("f14_f15_f16_tree_classifiers")
def _(t):
    return _fit_classes(t, ["decision_tree", "random_forest", "gradient_boosting"])


@query("f17_f19_f21_linear_classifiers")
def _(t):
    return _fit_classes(t, ["logistic", "linear_svm", "boosted_stumps"])


@query("f19_kernel_classifier")
def _(t):
    return _fit_classes(t, ["kernel_svm"])


@query("f19_kernel_regression")
def _(t):
    return _fit_lines(t, ["kernel_svr"])


@query("f18_nearest_neighbour_models")
def _(t):
    df = M.random_split(t.part, "p_partkey")
    return M.nearest_predict(df.where("part = 'train'"), df.where("part = 'test'"), ["p_size", "p_retailprice"], "p_size", "p_partkey", "p_partkey")


HISTORY = ["nation", "balance", "n_orders", "urgent", "n_open", "n_lines", "quantity", "returned"]


@query("f18_pivot_neighbours", f"""
WITH {CUSTOMER_HISTORY}, p AS (SELECT a.c_custkey, b.c_custkey AS neighbour, sqrt({"+".join(f"pow(a.{c}-b.{c},2)" for c in HISTORY)}) AS distance FROM h a, h b),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY distance, neighbour)::INT AS rank FROM p)
SELECT c_custkey, neighbour, round(distance,9) AS distance, rank FROM r WHERE rank <= 6""")
def _(t):
    history = cut_lineage(customer_history(t))
    found = pivot_join(history, history, HISTORY, "c_custkey", "c_custkey", k=6, standardise=False)
    return found.select("c_custkey", "neighbour", rnd("distance", 9).alias("distance"), "rank")


@query("f20_discriminants")
def _(t):
    df = documents_labelled(t).withColumn("week", (F.col("doc_id") % 7).cast("double"))
    out = None
    for quadratic in (False, True):
        m = M.GaussianClassifier(quadratic).fit(df, ["n_chars", "week"], "quality")
        row = M.classification_metrics(m.transform(df), "quality", "prediction").withColumn("quadratic", F.lit(quadratic))
        out = row if out is None else out.unionByName(row)
    return out


def _boosting_sql(rounds: int) -> str:
    """Every round's best stump, its error and its vote by plain counting: weights by class and bin, cumulated along each feature."""
    parts = ["""x AS (SELECT CASE WHEN l_quantity < 20 AND l_discount < 0.045 THEN 0 WHEN l_tax > 0.045 THEN 1 ELSE 2 END y,
[1 + least(9, ceil(l_quantity/5.0)::INT - 1), 1 + round(l_discount*100)::INT, 1 + round(l_tax*100)::INT] b, 1.0::DOUBLE w FROM lineitem)"""]
    size = "[10, 11, 9]"
    for r in range(rounds):
        source = f"x{r}" if r else "x"
        parts += [
            f"c{r} AS (SELECT f, b[f] AS bin, y, sum(w) w FROM {source}, range(1, 4) t(f) GROUP BY ALL)",
            f"""g{r} AS (SELECT t.f, t.bin, y.y, coalesce(sum(w) FILTER (c.bin <= t.bin), 0) l, coalesce(sum(w) FILTER (c.bin > t.bin), 0) r FROM (SELECT f, unnest(range(0, {size}[f] + 1)) bin FROM range(1, 4) u(f)) t, range(0, 3) y(y) LEFT JOIN c{r} c ON c.f = t.f AND c.y = y.y GROUP BY ALL)""",
            f"s{r} AS (SELECT f, bin, 1 - (max(l) + max(r))/sum(l + r) e, arg_max(y, (l, -y)) ly, arg_max(y, (r, -y)) ry FROM g{r} GROUP BY 1, 2)",
            f"m{r} AS (SELECT *, ln((1 - e)/e) + ln(2) a FROM s{r} ORDER BY round(e, 11), f, bin LIMIT 1)",
            f"x{r + 1} AS (SELECT y, b, w * CASE WHEN (CASE WHEN b[m.f] <= m.bin THEN m.ly ELSE m.ry END) <> y THEN 1 ELSE exp(-m.a) END w FROM {source}, m{r} m)"]
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(
        f"SELECT {r + 1}::BIGINT AS \"round\", f - 1 AS feature, bin, ly::BIGINT AS left_class, ry::BIGINT AS right_class, round(e, 8) AS error, round(a, 7) AS vote FROM m{r}" for r in range(rounds))


@query("f21_boosted_stumps", _boosting_sql(6))
def _(t):
    y = F.when((F.col("l_quantity") < 20) & (F.col("l_discount") < 0.045), 0).when(F.col("l_tax") > 0.045, 1).otherwise(2)
    cuts = {"l_quantity": [5.0 * i for i in range(1, 10)], "l_discount": [i / 100 + 0.005 for i in range(10)], "l_tax": [i / 100 + 0.005 for i in range(8)]}
    model = BO.BoostedStumps(rounds=6).fit(t.lineitem.withColumn("y", y), list(cuts), "y", cuts)
    rows = [(i + 1, s.feature, s.bin, s.left, s.right, s.error, s.weight) for i, s in enumerate(model.stumps)]
    out = local_rows(t.spark, rows, "round long, feature long, bin long, left_class long, right_class long, error double, vote double")
    return rounded(out, 7, error=8)


@query("f21_boosted_stumps_quality")
def _(t):
    df = documents_labelled(t).withColumn("week", (F.col("doc_id") % 7).cast("double"))
    return M.classification_metrics(BO.BoostedStumps().fit(df, ["n_chars", "week"], "quality").transform(df), "quality", "prediction")


@query("f22_model_comparison")
def _(t):
    return M.compare_models(documents_labelled(t).drop("toxic"), "quality", "doc_id", True, names=["logistic", "decision_tree"], k=2)


@query("f23_naive_baseline", f"""
WITH f AS (SELECT o_orderkey, o_totalprice y, floor({_H.format("o_orderkey || '|fold'")}*5)::INT fold FROM orders), s AS (SELECT fold, sum(y) s, count(*) n FROM f GROUP BY 1)
SELECT fold, round(((SELECT sum(s) FROM s)-s)/((SELECT sum(n) FROM s)-n),4) AS prediction, n FROM s""")
def _(t):
    df = M.folds(t.orders.withColumn("label", F.col("o_totalprice")), "o_orderkey", 5)
    return rounded(M.naive_baseline(df, "label", False).groupBy("fold").agg(F.first("prediction").alias("prediction"), F.count(F.lit(1)).alias("n")))


@query("f23_naive_class_baseline", f"""
WITH f AS (SELECT quality y, floor({_H.format("quality || '|' || doc_id || '|fold'")}*3)::INT fold FROM labels), g AS (SELECT DISTINCT fold FROM f)
SELECT fold, (SELECT y FROM f b WHERE b.fold <> g.fold GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)::INT AS prediction FROM g""")
def _(t):
    df = M.folds(t.labels, "doc_id", 3, "stratified", "quality")
    return M.naive_baseline(df, "quality", True).select("fold", "prediction").distinct()


@query("f24_fold_schemes", f"""
WITH q AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE,[.25,.5,.75]) q FROM events)
SELECT 'random' AS scheme, floor({_H.format("event_id || '|fold'")}*4)::INT AS fold, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'stratified', floor({_H.format("event_type || '|' || event_id || '|fold'")}*4)::INT, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'time', len(list_filter(q, lambda v: v < epoch_us(ts)))::INT, count(*) FROM events, q GROUP BY 2""")
def _(t):
    out = None
    for kind, key in (("random", "event_id"), ("stratified", "event_id"), ("time", "ts")):
        one = M.folds(t.events, key, 4, kind, "event_type").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).withColumn("scheme", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("f25_regression_metrics", """
WITH d AS (SELECT l_extendedprice y, l_quantity*1500 p FROM lineitem)
SELECT count(*) AS n, round(sqrt(avg(pow(y-p,2))),4) AS rmse, round(avg(abs(y-p)),4) AS mae, round(1-avg(pow(y-p,2))/var_pop(y),6) AS r2, round(avg(abs((y-p)/y))*100,5) AS mape FROM d""")
def _(t):
    return rounded(M.regression_metrics(t.lineitem.withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p"), 4, r2=6, mape=5)


_CLS = "(SELECT l_returnflag y, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_quantity > 15 THEN 'N' ELSE 'A' END p FROM lineitem)"


def flags(t):
    return t.lineitem.select(F.col("l_returnflag").alias("y"), F.expr("CASE WHEN l_quantity > 30 THEN 'R' WHEN l_quantity > 15 THEN 'N' ELSE 'A' END").alias("p"))


@query("f26_classification_metrics", f"""
WITH c AS (SELECT y, p, count(*)::DOUBLE n FROM {_CLS} GROUP BY 1,2), k AS (SELECT y k, sum(n) s, sum(n) FILTER (y=p) tp FROM c GROUP BY 1), q AS (SELECT p k, sum(n) m FROM c GROUP BY 1),
r AS (SELECT s, tp, tp/m pr, tp/s rc FROM k JOIN q USING (k))
SELECT sum(s)::BIGINT AS n, round(sum(tp)/sum(s),6) AS accuracy, round(sum(pr*s)/sum(s),6) AS precision, round(sum(rc*s)/sum(s),6) AS recall, round(sum(2*pr*rc/(pr+rc)*s)/sum(s),6) AS f1 FROM r""")
def _(t):
    return rounded(M.classification_metrics(flags(t), "y", "p"), 6)


@query("f26_confusion", f"SELECT y AS actual, p AS predicted, count(*) AS n FROM {_CLS} GROUP BY 1,2")
def _(t):
    return M.confusion(flags(t), "y", "p")


@query("f27_roc_auc", """
WITH k AS (SELECT quality y, (rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars)-1)/2.0)::DOUBLE r FROM labels JOIN documents USING (doc_id)),
s AS (SELECT sum(y)::DOUBLE p, count(*)::DOUBLE n, sum(r) FILTER (y=1) r FROM k) SELECT round((r-p*(p+1)/2)/(p*(n-p)),6) AS auc FROM s""")
def _(t):
    return rounded(M.roc_auc(documents_labelled(t), "quality", "n_chars"), 6)


@query("f28_feature_importance")
def _(t):
    data = t.lineitem.select(*[F.col(c).cast("double").alias(c) for c in LINE_NUM]).withColumn("label", F.col("l_extendedprice") / 1000 + F.col("l_quantity"))
    nums = ["l_quantity", "l_discount", "l_tax"]
    return M.feature_importance(M.train(data, nums, [], M.regressors()["decision_tree"]()), data)


@query("f29_permutation_importance")
def _(t):
    df = t.part.withColumn("y", F.col("p_size") * 2 + F.col("p_retailprice") / 100)
    fit = L.fit_ols(df, "y", ["p_size", "p_retailprice"])
    return M.permutation_importance(df, lambda d: d.withColumn("prediction", fit.predict()), ["p_size", "p_retailprice"], "y", "p_partkey", repeats=2)


COEF = {"l_quantity": 2.0, "l_discount": -30.0, "l_tax": 12.5}
FEATS = list(COEF)
SCORE = W.linear_scorer(5.0, COEF)
_P = "(5 + 2*{q} - 30*{d} + 12.5*{x})"


def _p(q="l_quantity", d="l_discount", x="l_tax"):
    return _P.format(q=q, d=d, x=x)


@query("f30_linear_contributions", """
WITH m AS (SELECT avg(l_quantity) q, avg(l_discount) d FROM lineitem)
SELECT 'l_quantity' AS feature, round(avg(abs(2*(l_quantity-q))),6) AS mean_abs FROM lineitem, m UNION ALL SELECT 'l_discount', round(avg(abs(-30*(l_discount-d))),6) FROM lineitem, m""")
def _(t):
    coef = {"l_quantity": 2.0, "l_discount": -30.0}
    return rounded(M.global_contributions(M.linear_contributions(t.lineitem, coef, ["l_orderkey"]), list(coef)), 6)


# on every row the attributions of all features and the base must add up to the prediction
@query("f30_tree_contributions", """
SELECT l_orderkey, l_linenumber, m, 0.0::DOUBLE AS gap FROM lineitem, (VALUES ('decision_tree'), ('random_forest'), ('gradient_boosting')) v(m)""")
def _(t):
    names = ["l_quantity", "l_discount", "l_tax"]
    data = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in names], (F.col("l_extendedprice") / 1000).alias("label"))
    models, ready, out = M.regressors(), M.prepared_features(data, names, []), None
    for m in ("decision_tree", "random_forest", "gradient_boosting"):
        fitted = M.train(data, names, [], models[m](), ready)
        parts = AT.tree_contributions(fitted.stages[-1], fitted.transform(data), ["l_orderkey", "l_linenumber", "prediction"], names)
        row = parts.select("l_orderkey", "l_linenumber", F.lit(m).alias("m"), rnd(F.col("total") - F.col("prediction"), 7).alias("gap"))
        out = row if out is None else out.unionByName(row)
    return out


@query("f31_batch_predict")
def _(t):
    data = t.lineitem.select(*[F.col(c).cast("double").alias(c) for c in LINE_NUM], "l_orderkey").withColumn("label", F.col("l_extendedprice") / 1000)
    model = M.train(data, ["l_quantity", "l_discount"], [], M.regressors()["linear"]())
    return M.batch_predict(model, t.lineitem.select("l_orderkey", "l_quantity"), ["l_quantity", "l_discount"], [], {"l_discount": 0.05}).select("l_orderkey", "prediction")


@query("f32_feature_ranges", """
SELECT 'p_size' AS "column", min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, round(avg(p_size),6) AS mean, NULL::VARCHAR AS levels FROM part
UNION ALL SELECT 'p_type', NULL, NULL, NULL, (SELECT string_agg(p_type, ',' ORDER BY p_type) FROM (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10))""")
def _(t):
    return rounded(M.feature_ranges(t.part, ["p_size"], ["p_type"]), 6).withColumn("levels", F.array_join("levels", ","))


def _scen_sql(rows):
    return " UNION ALL ".join(f"SELECT '{n}' AS scenario, count(*) AS n, round(avg({e}),6) AS mean, round(coalesce(stddev_samp({e}),0),6) AS std FROM lineitem, q" for n, e in rows)


_Q = "WITH q AS (SELECT quantile_cont(l_quantity,.1) q1, quantile_cont(l_quantity,.5) q5, quantile_cont(l_quantity,.9) q9, quantile_cont(l_discount,.1) d1, quantile_cont(l_discount,.5) d5, quantile_cont(l_discount,.9) d9, quantile_cont(l_tax,.1) x1, quantile_cont(l_tax,.5) x5, quantile_cont(l_tax,.9) x9 FROM lineitem) "

SCENARIOS = {"cheap": {"l_discount": ("set", 0.1)}, "more": {"l_quantity": ("shift_pct", 10.0)}, "double_tax": {"l_tax": ("multiply", 2.0)},
             "plus": {"l_quantity": ("add", 5.0)}, "top": {"l_quantity": ("set_quantile", .9)}}


@query("f33_what_if", _Q + _scen_sql([("baseline", _p()), ("cheap", _p(d="0.1")), ("more", _p(q="l_quantity*1.1")), ("double_tax", _p(x="(l_tax*2)")), ("plus", _p(q="(l_quantity+5)")), ("top", _p(q="q9"))]))
def _(t):
    return rounded(W.run_scenarios(t.lineitem, SCORE, FEATS, SCENARIOS).select("scenario", "n", "mean", "std"), 6)


@query("f34_preset_scenarios", _Q + _scen_sql([("baseline", _p()), ("p10", _p("q1", "d1", "x1")), ("p50", _p("q5", "d5", "x5")), ("p90", _p("q9", "d9", "x9"))]))
def _(t):
    return rounded(W.preset_scenarios(t.lineitem, SCORE, FEATS).select("scenario", "n", "mean", "std"), 6)


@query("f35_scenario_comparison", f"""
WITH r AS (SELECT 'baseline' AS scenario, avg({_p()}) m FROM lineitem UNION ALL SELECT 'cheap', avg({_p(d="0.1")}) FROM lineitem UNION ALL SELECT 'plus', avg({_p(q="(l_quantity+5)")}) FROM lineitem),
b AS (SELECT m b FROM r WHERE scenario='baseline')
SELECT scenario, round(m,6) AS mean, round(m-b,6)+0.0 AS difference, round((m-b)/abs(b)*100,6)+0.0 AS percent, round((SELECT max(m)-min(m) FROM r),6) AS spread FROM r, b""")
def _(t):
    return rounded(W.compare_scenarios(W.run_scenarios(t.lineitem, SCORE, FEATS, {k: SCENARIOS[k] for k in ("cheap", "plus")})), 6)


@query("f36_sensitivity", f"""
WITH g AS (SELECT range::INT AS point, -20 + 40*range/19.0::DOUBLE s FROM range(20)), b AS (SELECT avg({_p()}) b FROM lineitem), m AS (SELECT avg(l_quantity) q, avg(-30*l_discount+12.5*l_tax) r FROM lineitem)
SELECT point, round(s,6)+0.0 AS shift_pct, round(5+2*q*(1+s/100)+r,6) AS mean, round(((5+2*q*(1+s/100)+r)/b-1)/(s/100),6) AS elasticity FROM g, b, m""")
def _(t):
    return rounded(W.sensitivity(t.lineitem, SCORE, FEATS, "l_quantity"), 6)


@query("f37_tornado", f"""
WITH s AS (SELECT avg({_p()}) b, stddev_samp(l_quantity) q, stddev_samp(l_discount) d, stddev_samp(l_tax) x FROM lineitem)
SELECT 'l_quantity' AS feature, round(b-2*q,6) AS low, round(b+2*q,6) AS high, round(4*q,6) AS swing FROM s UNION ALL SELECT 'l_discount', round(b+30*d,6), round(b-30*d,6), round(60*d,6) FROM s
UNION ALL SELECT 'l_tax', round(b-12.5*x,6), round(b+12.5*x,6), round(25*x,6) FROM s""")
def _(t):
    return rounded(W.tornado(t.lineitem, SCORE, FEATS).drop("baseline"), 6)


@query("f38_partial_dependence", f"""
WITH s AS (SELECT min(l_quantity) lo, max(l_quantity) hi, avg({_p(q="0")}) r FROM lineitem), g AS (SELECT range::INT AS point FROM range(30))
SELECT point, round(lo+(hi-lo)*point/29,6) AS value, round(r+2*(lo+(hi-lo)*point/29),6) AS mean FROM g, s""")
def _(t):
    return rounded(W.partial_dependence(t.lineitem, SCORE, FEATS, "l_quantity"), 6)


@query("f39_stress", f"""
WITH s AS (SELECT avg({_p()}) b, stddev_samp(l_quantity) q, stddev_samp(l_discount) d, stddev_samp(l_tax) x FROM lineitem), k AS (SELECT unnest([-2,-1,1,2])::DOUBLE k)
SELECT 'l_quantity' AS feature, k AS sigma, round(b+2*k*q,6) AS mean, round(2*k*q/abs(b)*100,6)+0.0 AS impact_pct FROM s, k UNION ALL SELECT 'l_discount', k, round(b-30*k*d,6), round(-30*k*d/abs(b)*100,6)+0.0 FROM s, k
UNION ALL SELECT 'l_tax', k, round(b+12.5*k*x,6), round(12.5*k*x/abs(b)*100,6)+0.0 FROM s, k""")
def _(t):
    return rounded(W.stress(t.lineitem, SCORE, FEATS), 6)


@query("f40_noise_scoring")
def _(t):
    beta = np.array([2.0, -30.0, 12.5])
    return W.noise_scoring(t.lineitem, lambda x: 5.0 + x @ beta, FEATS, LINE_KEY, copies=40)


@query("f41_linear_warnings")
def _(t):
    return L.linear_warnings(t.orders, "o_totalprice", ["o_custkey"], ["o_orderkey"])
