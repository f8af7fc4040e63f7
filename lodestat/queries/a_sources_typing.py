"""Sources, sinks, typing, casts, profiling."""

from pyspark.sql import functions as F

from lodestat.functions import casts, dates
from lodestat.functions.expr import as_col, rnd
from lodestat.operators import typing as TY
from lodestat.queries.c_describe import rounded
from lodestat.queries.registry import query
from lodestat.session import scratch_path
from lodestat.sources import readers as R
from lodestat.sources.versions import Dataset

# dirty text made from the tables, the same on both sides
DIRTY_SPARK = """
  CASE o_orderkey % 5 WHEN 0 THEN concat(' ', cast(o_custkey AS string), ',5') WHEN 1 THEN concat(cast(o_custkey AS string), '%')
   WHEN 2 THEN concat('1 ', lpad(cast(o_custkey AS string), 3, '0')) WHEN 3 THEN 'N/A' ELSE cast(o_custkey AS string) END"""
DIRTY_SQL = """
  CASE o_orderkey % 5 WHEN 0 THEN ' ' || o_custkey || ',5' WHEN 1 THEN o_custkey || '%'
   WHEN 2 THEN '1 ' || CASE WHEN length(o_custkey::VARCHAR) >= 3 THEN substr(o_custkey::VARCHAR,1,3) ELSE lpad(o_custkey::VARCHAR, 3, '0') END WHEN 3 THEN 'N/A' ELSE o_custkey::VARCHAR END"""
DATE_SPARK = """
  CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy')
   WHEN 2 THEN date_format(o_orderdate, 'd MMMM yyyy') ELSE date_format(o_orderdate, 'yyyyMMdd') END"""


@query("a01_csv_scan", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(t):
    path = scratch_path(t.spark, "customer.csv")
    t.customer.write.csv(path, header=True, sep=";")
    df = R.read_csv(t.spark, path)
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"))


@query("a02_json_scan", "SELECT c_custkey AS \"key\", c_name AS \"info.name\", c_custkey + 1 AS \"info.deep.next\" FROM customer")
def _(t):
    path = scratch_path(t.spark, "customer.json")
    nested = t.customer.select(F.col("c_custkey").alias("key"), F.struct(F.col("c_name").alias("name"), F.struct(
        (F.col("c_custkey") + 1).alias("next")).alias("deep")).alias("info"))
    # documents of at most 200 records, each a file of its own
    documents = nested.groupBy(F.floor(F.col("key") / 200)).agg(F.to_json(F.struct(F.collect_list(F.struct("key", "info")).alias("records"))).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    df = R.read_json(t.spark, path)
    return df.select(as_col("key").cast("long").alias("key"), as_col("info.name"), as_col("info.deep.next").cast("long").alias("info.deep.next"))


@query("a03_jsonl_scan", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    path = scratch_path(t.spark, "supplier.jsonl")
    t.supplier.write.json(path)
    return R.read_table(t.spark, path).select("s_suppkey", "s_acctbal")


@query("a04_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def _(t):
    return R.read_parquet(t.spark, f"{t.folder}/orders.parquet").where("o_totalprice > 400000").select("o_orderkey", "o_totalprice")


@query("a05_format_registry", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return R.read_table(t.spark, f"{t.folder}/part.parquet").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("a06_header_cleanup", "SELECT c_custkey AS \"key\", c_name AS \"Colonne_2\", c_mktsegment AS \"key_1\" FROM customer")
def _(t):
    return R.clean_header(t.customer.select("c_custkey", "c_name", "c_mktsegment").toDF(" key", "  ", "key "))


@query("a07_column_exclusion", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return R.drop_excluded(t.customer, ["c_name", "c_acctbal", "not_there"])


@query("a08_preview", "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 20")
def _(t):
    return R.preview(t.supplier, ["s_suppkey"], 20)


@query("a09_versioned_snapshot", """
SELECT version::INT AS version, (SELECT count(*) FROM part WHERE version <> 2 OR p_size > 25) AS n, label FROM
 (VALUES (1,'raw'),(2,'filtered'),(3,'restored from 1')) v(version,label)""")
def _(t):
    ds = Dataset(t.spark, scratch_path(t.spark, "part"))
    ds.write(t.part, "raw")
    ds.write(t.part.where("p_size > 25"), "filtered")
    ds.restore(1)
    rows = None
    for v in (1, 2, 3):
        one = ds.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.join(ds.history().select("version", "label"), "version")


@query("a10_copy_dataset", "SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier")
def _(t):
    ds = Dataset(t.spark, scratch_path(t.spark, "supplier"))
    ds.write(t.supplier, "raw")
    return ds.copy_to(scratch_path(t.spark, "copy")).read().agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("keys"))


@query("a11_parquet_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "events")
    R.write_parquet(t.events, path)
    return R.read_parquet(t.spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a12_json_export", "SELECT '{\"s_suppkey\":' || s_suppkey || ',\"gap\":' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE '1.5' END || '}' AS json FROM supplier")
def _(t):
    gap = F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5))
    return R.json_rows(t.supplier.select("s_suppkey", gap.alias("gap")))


@query("a13_type_inference", """
SELECT unnest(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment','half','dirty']) AS "column",
 unnest(['identifier','identifier', CASE WHEN count(DISTINCT c_nationkey) <= 20 THEN 'discrete' ELSE
  CASE WHEN count(DISTINCT c_nationkey)/count(c_nationkey)::DOUBLE < .05 AND count(DISTINCT c_nationkey) <= 30 THEN 'discrete' ELSE 'continuous' END END,
  'continuous','nominal','binary','ambiguous']) AS statistical_type, unnest([count(*),count(*),count(*),count(*),count(*),count(*),count(*)]) AS count FROM customer""")
def _(t):
    df = t.customer.select("*", (F.col("c_custkey") % 2).alias("half"),
                           F.expr("CASE WHEN c_custkey % 2 = 0 THEN cast(c_nationkey AS string) ELSE c_mktsegment END").alias("dirty"))
    return TY.infer_types(df).select("column", "statistical_type", "count")


@query("a14_temporal_detection", """
SELECT unnest(['native_d','text_d','french_d','order_year','order_month','order_day','weeks','plain']) AS "column",
 unnest(['native','text','text','year','month','day','text',NULL]) AS time_form FROM (SELECT count(*) FROM orders)""")
def _(t):
    df = t.orders.select(
        F.col("o_orderdate").alias("native_d"), F.expr(DATE_SPARK).alias("text_d"),
        F.concat_ws(" ", F.dayofmonth("o_orderdate"), F.element_at(F.array(*[F.lit(m) for m in (
            "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre",
            "décembre")]), F.month("o_orderdate")), F.year("o_orderdate")).alias("french_d"),
        F.year("o_orderdate").alias("order_year"), F.date_format("o_orderdate", "yyyyMM").cast("int").alias("order_month"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("order_day"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("-W"), F.lpad((F.col("o_custkey") % 52 + 1).cast("string"), 2, "0")).alias("weeks"),
        F.col("o_orderpriority").alias("plain"))
    return TY.infer_types(df).select("column", "time_form")


@query("a15_date_text", """
SELECT o_orderkey, day(o_orderdate) || ' ' || lower(strftime(o_orderdate, '%B')) || ' ' || year(o_orderdate) AS normal FROM orders""")
def _(t):
    months = F.array(*[F.lit(m) for m in ("Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août",
                                          "Septembre", "Octobre", "Novembre", "Décembre")])
    text = F.concat_ws(" ", F.lit(" Lundi"), F.dayofmonth("o_orderdate"), F.element_at(months, F.month("o_orderdate")), F.year("o_orderdate"))
    return t.orders.select("o_orderkey", dates.normalise_date_text(text).alias("normal"))


@query("a16_compact_dates", """
SELECT o_orderkey, date_trunc('year', o_orderdate) AS y, date_trunc('month', o_orderdate) AS m, o_orderdate AS d, o_orderdate AS s FROM orders""")
def _(t):
    df = t.orders.select("o_orderkey", F.year("o_orderdate").alias("yy"), F.date_format("o_orderdate", "yyyyMM").cast("int").alias("mm"),
                         F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("dd"),
                         F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).alias("ss"))
    for src, dst in (("yy", "y"), ("mm", "m"), ("dd", "d"), ("ss", "s")):
        df = TY.parse_compact(df, src, dst)
    return df.select("o_orderkey", *[F.col(c).cast("timestamp_ntz").alias(c) for c in "ymds"])


@query("a17_robust_dates", "SELECT o_orderkey, o_orderdate AS parsed FROM orders")
def _(t):
    df = t.orders.select("o_orderkey", F.expr(DATE_SPARK).alias("text"))
    return TY.parse_dates(df, "text", "parsed").select("o_orderkey", F.col("parsed").cast("timestamp_ntz").alias("parsed"))


@query("a18_semantic_types", """
SELECT 'url' AS "column", CASE WHEN avg(regexp_matches(url,'^https?://')::INT) >= .8 THEN 'url' END AS semantic_type,
 round(avg(regexp_matches(url,'^https?://')::INT),6) AS best_rate FROM pages
UNION ALL SELECT 'mail', 'email', 1.0 FROM (SELECT count(*) FROM pages) UNION ALL SELECT 'day', 'iso_date', 1.0 FROM (SELECT count(*) FROM pages)""")
def _(t):
    df = t.pages.select("url", F.concat(F.lit("u"), F.col("page_id").cast("string"), F.lit("@example.org")).alias("mail"),
                        F.concat(F.lit("2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("T00")).alias("day"))
    return rounded(TY.semantic_types(df), 6)


@query("a19_units")
def _(t):
    df = t.events.select(F.col("value").alias("amount_EUR"), F.col("value").alias("load_kg"), F.col("value").alias("rate (%)"), F.col("value").alias("plain"))
    return TY.data_dictionary(df).select("column", "unit", "unit_domain", "count")


@query("a20_titles")
def _(t):
    return TY.data_dictionary(t.orders).select("column", "title", "count")


_PROFILE_SQL = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS count, count(*)-count({c}) AS null_count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}),4) AS mean,
 round(stddev_samp({c}),4) AS std, round(median({c}),4) AS median, round(quantile_cont({c},.05),4) AS p5, round(quantile_cont({c},.25),4) AS p25,
 round(quantile_cont({c},.75),4) AS p75, round(quantile_cont({c},.95),4) AS p95, round(skewness({c}),4)+0.0 AS skewness, round(kurtosis({c}),4)+0.0 AS kurtosis,
 count(DISTINCT {c}) AS cardinality, round((count(*)-count({c}))/count(*)::DOUBLE,4) AS null_rate FROM p""" for c in ("p_size", "p_retailprice", "holes"))


@query("a21_column_profile", "WITH p AS (SELECT *, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS holes FROM part) " + _PROFILE_SQL)
def _(t):
    df = t.part.withColumn("holes", F.expr("CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END"))
    return rounded(TY.column_profile(df, ["p_size", "p_retailprice", "holes"]))


@query("a22_data_dictionary", """
SELECT unnest(['o_orderkey','o_totalprice','o_orderdate','o_orderstatus']) AS "column", unnest(['identifier','continuous','temporal','nominal']) AS statistical_type,
 unnest([count(DISTINCT o_orderkey),count(DISTINCT o_totalprice),count(DISTINCT o_orderdate),count(DISTINCT o_orderstatus)]) AS cardinality,
 unnest([NULL, round(avg(o_totalprice),2), NULL, NULL]) AS mean2, unnest([count(*),count(*),count(*),count(*)]) AS count FROM orders""")
def _(t):
    out = TY.data_dictionary(t.orders, ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"])
    return out.select("column", "statistical_type", "cardinality", F.when(F.col("column") == "o_totalprice", rnd("mean", 2)).alias("mean2"), "count")


@query("a23_dataset_profile", """
SELECT (SELECT count(*) FROM part) AS rows, 6 AS columns, unnest(['p_partkey','p_name','p_brand','p_type','p_size','p_retailprice']) AS "column",
 unnest(['bigint','string','string','string','int','double']) AS stored_type""")
def _(t):
    return TY.dataset_profile(t.part).select("rows", "columns", "column", "stored_type")


@query("a24_boolean_cast", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN NULL ELSE NULL END AS flag FROM orders""")
def _(t):
    word = F.element_at(F.array(*[F.lit(w) for w in (" Oui", "FAUX ", "1", "peut-être", "inconnu")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select("o_orderkey", casts.to_boolean(word).alias("flag"))


_NUM_SQL = f"""SELECT o_orderkey, o_custkey, try_cast(regexp_replace(regexp_replace(regexp_replace(dirty, '\\s+', '', 'g'), '%$', ''), ',', '.') AS DOUBLE) AS number
 FROM (SELECT o_orderkey, o_custkey, {DIRTY_SQL} AS dirty FROM orders)"""


@query("a25_numeric_cast", _NUM_SQL.replace("o_custkey, try", "try", 1))
def _(t):
    return t.orders.select("o_orderkey", F.expr(DIRTY_SPARK).alias("dirty")).select("o_orderkey", casts.to_number(F.col("dirty")).alias("number"))


@query("a26_temporal_cast", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_orderdate END AS day FROM orders")
def _(t):
    df = t.orders.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 10 = 9 THEN 'erreur' ELSE date_format(o_orderdate, 'dd/MM/yyyy') END").alias("day"))
    return TY.apply_overrides(df, {"day": "temporel"}).select("o_orderkey", F.col("day").cast("timestamp_ntz").alias("day"))


@query("a27_conversion_report", f"""
SELECT 'dirty' AS "column", 'continuous' AS target, count(*) AS total, count(number) AS valid, count(*)-count(number) AS lost, 0::BIGINT AS original_null,
 round((count(*)-count(number))/count(*)::DOUBLE,6) AS loss_rate, false AS lossless FROM ({_NUM_SQL})""")
def _(t):
    df = t.orders.select(F.expr(DIRTY_SPARK).alias("dirty"))
    return rounded(TY.conversion_report(df, {"dirty": "numeric"}), 6).drop("samples")


@query("a28_type_overrides", """
SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment, c_acctbal::DOUBLE AS c_acctbal, CAST(round(c_nationkey) AS BIGINT) AS c_nationkey FROM customer""")
def _(t):
    return TY.apply_overrides(t.customer, {"c_custkey": "identifiant", "c_mktsegment": "continu", "c_nationkey": "discret", "c_acctbal": "auto"}).drop("c_name")


@query("a29_declared_schema", """
SELECT c_name, strptime('19' || (60 + c_nationkey), '%Y') AS annee, c_nationkey::VARCHAR AS code, c_acctbal AS solde FROM customer""")
def _(t):
    df = t.customer.select("c_custkey", "c_name", (F.col("c_nationkey") + 1960).alias("annee"), F.col("c_nationkey").alias("code"),
                           F.col("c_acctbal").cast("string").alias("solde"))
    done = TY.apply_schema(df, {"c_custkey": "identifiant", "annee": "temporel", "code": "categorical", "solde": "numeric", "c_name": "text"})
    return done.frame.select(*done.analysable).withColumn("annee", F.col("annee").cast("timestamp_ntz"))


@query("a30_analysable_columns")
def _(t):
    df = t.orders.withColumn("order_year", F.year("o_orderdate")).withColumn("half_price", F.col("o_totalprice") / 2)
    return df.select(*TY.analysable_columns(df)).agg(*[F.count(c).alias(c) for c in TY.analysable_columns(df)])


@query("a31_panel_detection", """
WITH p AS (SELECT c_nationkey, strftime(o_orderdate,'%Y') AS y, sum(o_totalprice) v FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2),
e AS (SELECT c_nationkey, count(DISTINCT y) k FROM p GROUP BY 1)
SELECT 'c_nationkey' AS entity_column, 'y' AS time_column, count(*) AS n_entities, (SELECT count(DISTINCT y) FROM p)::INT AS n_periods, min(k) AS min_periods,
 min(k)=max(k) AS balanced, count(*) >= 2 AND count(*) <= .5*(SELECT count(*) FROM p) AND min(k) >= 2 AS is_panel FROM e""")
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return TY.panel_shape(df, "c_nationkey", "y")


@query("a32_target_suggestion")
def _(t):
    return TY.suggest_targets(t.orders)


@query("a33_problem_type", """
SELECT 'toxic' AS target, count(DISTINCT toxic) AS levels, CASE WHEN count(DISTINCT toxic) < 2 THEN 'exploration' WHEN count(DISTINCT toxic) = 2 THEN 'binary_classification'
 ELSE 'multiclass_classification' END AS problem_type FROM labels
UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), 'regression' FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 'multiclass_classification' FROM orders""")
def _(t):
    return TY.problem_type(t.labels, "toxic").unionByName(TY.problem_type(t.orders, "o_totalprice")).unionByName(TY.problem_type(t.orders, "o_orderpriority"))


@query("a34_profile_flags", """
WITH o AS (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE 1 END AS sparse FROM orders), d AS (SELECT count(*)-1 AS x FROM o GROUP BY o_custkey, o_orderstatus, sparse)
SELECT unnest(['rows','columns','duplicate_rows','duplicate_ratio','overall_null_rate','high_missing_columns','near_constant_columns','small_sample','large_sample','wide','high_dimensional']) AS fact,
 unnest([count(*)::DOUBLE, 3, (SELECT sum(x) FROM d), round((SELECT sum(x) FROM d)/count(*),6), round((count(*)-count(sparse))/count(*)/3.0,6), 1, 1, (count(*)<100)::INT, (count(*)>100000)::INT, 0, 0]) AS value FROM o""")
def _(t):
    df = t.orders.select("o_custkey", "o_orderstatus", F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE 1 END").alias("sparse"))
    return rounded(TY.profile_flags(df), 6)


@query("a35_capability_matrix")
def _(t):
    return TY.capabilities(t.customer)


@query("a36_magic_bytes", "SELECT 'parquet' AS extension, true AS valid, count(*) AS n FROM (VALUES (1),(2)) v")
def _(t):
    files = R.check_magic(t.spark, f"{t.folder}/{{nation,region}}.parquet")
    return files.groupBy("extension", "valid").agg(F.count(F.lit(1)).alias("n"))
