"""Registered queries `opN_<name>` over the given tables, and the SQL that checks them where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.decontamination import find_leaks
from lodestat.llm.exact_dedup import exact_groups
from lodestat.llm.language_id import identify_language, language_dictionaries
from lodestat.llm.packing import pack_documents
from lodestat.llm.paragraph_dedup import repeated_passages
from lodestat.llm.periodic_runs import periodic_runs
from lodestat.llm.pii import find_pii
from lodestat.llm.pivot_clusters import pivot_clusters
from lodestat.llm.simhash_dedup import simhash_components
from lodestat.llm.token_counts import token_counts
from lodestat.llm.token_files import token_files
from lodestat.llm.toxicity import fit_chain, score_toxicity
from lodestat.llm.web_archives import archived_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op5_exact_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""")
def op5(table):
    return exact_groups(table("documents"), keep="max")


@query("op4_pii")
def op4(table):
    return find_pii(table("documents"))


@query("op7_decontamination")
def op7(table):
    return find_leaks(table("documents"), table("benchmark"))


def toxicity_chain(docs: DataFrame, labels: DataFrame):
    """The chain of the two labels there are: low quality first, then toxic."""
    return fit_chain(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


@query("op8_toxicity")
def op8(table):
    docs = table("documents")
    return score_toxicity(docs, toxicity_chain(docs, table("labels")))


@query("op9_simhash_near_dedup")
def op9(table):
    return simhash_components(table("documents"), shingle=4, radius=4)


@query("op10_token_counts")
def op10(table):
    return token_counts(table("documents"), public_tokenizers.path("piece_bpe_32k.model"), whole_runs=True)


@query("op1_substring_dedup")
def op1(table):
    return repeated_passages(table("documents"))


@query("op2_language_id")
def op2(table):
    docs = table("documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    dictionaries = language_dictionaries(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = identify_language(docs, dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "narrow")


@query("op3_best_fit_packing")
def op3(table):
    return pack_documents(table("documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_token_files")
def op6(table):
    return token_files(table("documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query("op11_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), g AS (SELECT *, strlen(t) AS n, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM g""")
def op11(table):
    return archived_pages(table("pages")).drop("intact")


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """`doc_id, text` where texts whose crc32 of the id ends in 0 have their words from one place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    a, p = F.col("a"), F.col("p")
    changed = F.transform("w", lambda w, i: F.when(i < a, w).otherwise(F.get("w", (a + (i - a) % p).cast("int"))))
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(table):
    found = periodic_runs(with_periodic_ends(table("documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.short")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The clustering over all pairs of vector and centroid."""
    parts = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT c, m FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM v) WHERE c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT r, vec_id, v, c, m, list_sum(list_transform(v, lambda x, j: (x - m[j]) * (x - m[j])))::BIGINT AS d FROM v, c{i}
QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY ALL)""")
            parts.append(f"""c{i + 1} AS (SELECT c0.c, coalesce(b.m, old.m) AS m FROM c0 JOIN c{i} old USING (c)
LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM s{i} GROUP BY c) b USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds}"""


@query("op13_centroid_clustering", _clusters_sql())
def op13(table):
    return pivot_clusters(table("embeddings"), dims=64, scale=64, k=16, rounds=3).drop("compared")
