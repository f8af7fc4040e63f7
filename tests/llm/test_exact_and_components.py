import random

from pyspark.sql import functions as F

from lodestat.llm.components import components
from lodestat.llm.exact_dedup import exact_dedup, exact_groups
from lodestat.llm.paragraph_dedup import strip_repeats


def rows(df):
    return {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()}


def test_groups_ties_nulls_and_case(docs_of):
    docs = docs_of([(3, "Abc"), (1, "aBC"), (2, None), (5, ""), (4, "É"), (6, "é"), (7, "abc ")])
    assert rows(exact_groups(docs)) == {(3, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True), (5, 2, 2, False), (4, 4, 1, True), (6, 6, 1, True), (7, 7, 1, True)}
    assert rows(exact_groups(docs, keep="max")) >= {(3, 3, 2, True), (1, 3, 2, False), (2, 5, 2, False)}


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    docs = docs_of([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (None, "y"), (None, "y")])
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_groups(docs).collect())
    assert got == [("1", "1", 4, True), ("1", "1", 4, True), ("2", "1", 4, False), ("None", "1", 4, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    assert exact_groups(docs.limit(0)).count() == 0
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == 4


def test_texts_that_only_share_a_hash_stay_apart(docs_of):
    docs = docs_of({k: f"text {k % 5}" for k in range(40)})
    weak = exact_groups(docs, digest=lambda t: F.lit(b"0"))
    assert rows(weak) == rows(exact_groups(docs)) and {r[2] for r in rows(weak)} == {8}


def test_long_text(docs_of):
    docs = docs_of([(1, "a" * 3_000_000), (2, "A" * 3_000_000), (3, "a" * 3_000_000 + "b")])
    assert rows(exact_groups(docs)) == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_of_chains_stars_and_random_links(spark):
    r = random.Random(7)
    links = [(k, k + 1) for k in range(100, 160)] + [(200, 200 + k) for k in range(1, 50)] + [(r.randint(300, 500), r.randint(300, 500)) for _ in range(150)]
    links += [(9, 9), (1, None), (160, 100), (100, 101)]
    parent = {x: x for pair in links for x in pair if x is not None}
    for a, b in links:
        if b is not None:
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
    found = {row["node"]: row["component"] for row in components(spark.createDataFrame(links, "u long, v long"), "u", "v").collect()}
    assert found == {x: find(parent, x) for x in parent if x not in (9, 1) and any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "u long, v long"), "u", "v").count() == 0


def test_columns_with_clashing_names_stay(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"{passage}.", "a", "b", "c", 7), (2, f"{passage}.", "d", "e", "f", 8), (3, None, "g", "h", "i", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text_sha256 string, __of string, __spans string, keep_id int")
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
    cut = strip_repeats(docs)
    assert cut.columns == docs.columns
    got = {r["doc_id"]: tuple(r) for r in cut.collect()}
    assert [got[r[0]][2:] for r in rows] == [r[2:] for r in rows] and got[3][1] is None
    assert min(len(got[1][1]), len(got[2][1])) < len(rows[0][1])
