import numpy as np
import xxhash

from lodestat.llm.shingles import bit_counts, shingle_hashes, simhash
from lodestat.llm import simhash_dedup
from lodestat.llm.simhash_dedup import grouped_bits, near_dedup, near_groups, near_links, pigeonhole_plan, simhash_components


def test_fingerprint_by_definition():
    words = "the cat saw the dog the cat saw the".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(6)]
    assert shingle_hashes("The\tCAT saw  the dog the cat saw the", 4).tolist() == hashes
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 6)
    assert simhash(np.array(hashes, np.uint64))[0] % 2**64 == want
    assert simhash(shingle_hashes(None, 4)) == simhash(shingle_hashes(" \n", 4)) == [0]
    assert shingle_hashes("Two words", 4).tolist() == [xxhash.xxh64_intdigest(b"two words", 42)]


def test_bit_counts_of_any_length():
    r = np.random.default_rng(1)
    for n in (1, 254, 255, 256, 511, 255 * 256 + 3):
        h = r.integers(0, 2**64, n, dtype=np.uint64)
        assert (bit_counts(h) == np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0)).all()


def test_search_finds_every_pair_within_the_radius(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**64, 60, dtype=np.uint64)
    near = np.concatenate([base, *[base ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (k, 60)).astype(np.uint64), axis=0) for k in (1, 2, 3, 4, 5, 6)]])
    near = np.unique(np.append(near, [np.uint64(0), np.uint64(2**64 - 1)]))
    prints = spark.createDataFrame([(int(x), 1) for x in near.view(np.int64)], "w0 long, size int")
    bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    for rows in (len(near), 10**9):  # the plan changes with the number of rows, the links do not
        plan = pigeonhole_plan(rows, (bits.T @ bits * rows / len(near))[None], 4)
        assert sum(p.threshold + 1 for p in plan) == 5
        got = {(x["a"], x["b"]) for x in near_links(prints, "w0", 1, 4, plan).collect()}
        values = near.view(np.int64)
        want = {(int(min(values[i], values[j])), int(max(values[i], values[j]))) for i in range(len(near)) for j in range(i) if int(near[i] ^ near[j]).bit_count() <= 4}
        assert got == want


def test_unlike_thresholds_where_bits_are_correlated():
    both = np.zeros((1, 64, 64))
    n = 10**9
    both[0] = n / 4
    both[0][:24, :24] = n / 2  # 24 bits that are always equal
    np.fill_diagonal(both[0], n / 2)
    corr = np.where(both[0] == n / 2, 1.0, 0.0)
    groups = grouped_bits(corr, 4)
    assert any(set(g) <= set(range(24)) for g in groups) and sorted(sum(groups, [])) == list(range(64))
    assert len({p.threshold for p in pigeonhole_plan(n, both, 4)}) > 1


def test_components_with_nulls_ties_and_repeats(docs_of, prose):
    a, b = prose(1, 300), prose(2, 300)
    docs = docs_of([(5, a), (3, a + " end"), (9, a), (9, a), (4, b), (8, None), (7, ""), (6, " \n "), (None, b)])
    got = simhash_components(docs).collect()
    of = {r["doc_id"]: r for r in got}
    assert len(got) == 9 and of[8]["fingerprint"] == "0" * 16
    assert [of[k]["component_id"] for k in (5, 3, 9, 4, None, 8, 7, 6)] == [3, 3, 3, 4, 4, 6, 6, 6]
    assert simhash_components(docs.limit(0)).count() == 0


def test_near_copies_by_shingle_similarity(docs_of, prose):
    texts = {k: prose(k, 400) for k in range(30)}
    texts[100] = texts[3].replace(texts[3].split()[200], "changed")  # 5 of 396 shingles
    texts[101] = " ".join(texts[4].split()[:340])  # 0.85
    texts[102] = " ".join(texts[5].split()[:200])  # 0.5
    texts[103], texts[104] = None, ""
    docs = docs_of(list(texts.items()) + [(None, texts[3])])
    groups = {r["doc_id"]: r["group_id"] for r in near_groups(docs).collect()}
    assert groups[100] == 3 and groups[101] == 4 and groups[102] == 102 and groups[104] == 103
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - {100, 101, 104} | {None}


def test_equal_fingerprints_of_unlike_texts_are_not_copies(docs_of, prose):
    filler = " -" * 230  # over half of all shingles
    rows = {1: prose(1, 200) + filler, 2: prose(2, 200) + filler, 3: prose(1, 200) + filler, 4: None, 5: " "}
    groups = {r["doc_id"]: r["group_id"] for r in near_groups(docs_of(rows)).collect()}
    assert groups == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}
    assert {r["doc_id"] for r in near_dedup(docs_of(rows)).collect()} == {1, 2, 4}


def test_near_copies_with_a_part_repeated_more_often(docs_of, prose):
    rows = {1: prose(1, 1_100), 3: prose(3, 1_100)}
    rows |= {k + 1: rows[k] + (" " + " ".join(rows[k].split()[-20:])) * n for k, n in ((1, 40), (3, 60))}
    groups = {r["doc_id"]: r["group_id"] for r in near_groups(docs_of(rows)).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 3}


def test_a_large_group_costs_no_pairs_by_the_square(docs_of, prose, monkeypatch):
    base, other = prose(1, 150).split(), prose(2, 150).split()

    def changed(words, places):
        return " ".join("x" + w if k in places else w for k, w in enumerate(words))

    rows = {k: changed(base, {k % 150, k // 150 * 7}) for k in range(1, 201)}  # about 10 of 146 shingles apart from each other
    rows |= {1_000 + k: changed(other, range(k, 150, 12)) for k in range(12)}  # most of the shingles changed, no similar pair
    kept = {}

    def spy(df, name):
        kept.setdefault(name, []).append(found := saved(df, name))
        return found

    saved = simhash_dedup.saved
    monkeypatch.setattr(simhash_dedup, "saved", spy)
    groups = {r["doc_id"]: r["group_id"] for r in near_groups(docs_of(rows)).collect()}
    assert groups == {k: 1 if k < 1_000 else k for k in rows}
    assert sum(links.count() for links in kept["near_links"]) < 20 * len(rows)  # 19,900 pairs of the group are similar
