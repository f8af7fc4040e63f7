"""Near copies by SimHash, searched with the generalised pigeonhole principle.

Fingerprint bits that go together in the corpus share a partition. If partition i is searched to radius T_i and the
T_i + 1 add up to the radius plus one, two fingerprints within the radius agree to T_i bits in some partition i. Dynamic
programming chooses the number of partitions and the T_i, unequal where that is cheaper, from candidate counts that the
bits' frequencies and correlations over all fingerprints predict. One side of the search stores each fingerprint under
its partition values, the other probes every value within T_i; both meet in an equi-join whose condition verifies the
whole distance, so only verified links leave it. The choice changes the cost, never the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.components import components
from lodestat.llm.rows import id_and_text, with_null_ids
from lodestat.llm.shingles import PARITY_WORDS, SEED, parity, shingle_hashes, simhash
from lodestat.session import saved

ROW_COST, COMPARE_COST = 50.0, 1.0  # of a shuffled row, and of a comparison inside the join
PARITY = [f"p{k}" for k in range(PARITY_WORDS)]
MOST_PROBES = 2_000  # of one partition; plans that need more are passed over for ones with more partitions


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, repeats: bool = True) -> DataFrame:
    """`doc_id, size, content, w0 ..., p0 ...`: the SimHash of each whole text in 64-bit words, its number of distinct shingles, a hash of their set and their parity.

    With `repeats` a shingle counts as often as it is found, without it once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = shingle_hashes(text, shingle)
                distinct = np.unique(h)
                rows.append((len(distinct), signed(xxhash.xxh64_intdigest(distinct.tobytes(), SEED)), *simhash(h if repeats else distinct, words), *parity(distinct)))
            out = pd.DataFrame(rows, columns=["size", "content", *names])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    names = [f"w{k}" for k in range(words)] + PARITY
    return with_null_ids(id_and_text(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, size int, content long, " + ", ".join(f"{n} long" for n in names)
    ))


def bit_moments(prints: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each word how many have bit i and bit j set (64 x 64), from one pass over all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, both = 0, np.zeros((words, 64, 64))
        for batch in batches:
            total += len(batch)
            for k in range(words):
                values = np.ascontiguousarray(batch[f"w{k}"].to_numpy(np.int64))
                bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both[k] += bits.T @ bits
        yield pd.DataFrame({"at": np.arange(both.size + 1), "n": np.append(both.ravel(), total).astype(np.int64)})

    sums = prints.select([f"w{k}" for k in range(words)]).mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(words * 64 * 64 + 1)
    for at, n in sums:
        flat[at] = n
    return int(flat[-1]), flat[:-1].reshape(words, 64, 64)


@dataclass(frozen=True)
class Partition:
    word: int
    bits: tuple[int, ...]
    threshold: int  # differing bits allowed in the search of this partition

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    @property
    def deltas(self) -> list[int]:
        """The differences to probe: every choice of at most `threshold` bits."""
        return [signed(sum(1 << b for b in some)) for r in range(self.threshold + 1) for some in combinations(self.bits, r)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into `parts` groups, as equal in size as can be, each grown from the bit most correlated with what is left."""
    left, groups, n = list(range(len(correlation))), [], len(correlation)
    for k in range(parts):
        width = (n * (k + 1)) // parts - (n * k) // parts
        group = [max(left, key=lambda b: (round(float(correlation[b, left].sum()), 6), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (round(float(correlation[b, group].sum()), 6), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def chance_within(bits: list[int], differ: np.ndarray, correlation: np.ndarray) -> np.ndarray:
    """Estimated share of fingerprint pairs that differ in at most 0, 1, ... of `bits`; correlated bits count for fewer."""
    pdf = np.array([1.0])
    for b in bits:
        pdf = np.convolve(pdf, [1 - differ[b], differ[b]])
    effective = len(bits) / float((correlation[np.ix_(bits, bits)] ** 2).sum())
    return np.clip(np.cumsum(pdf), 0, 1) ** effective


def allocate(rows: int, groups: list[list[int]], stats: list[tuple[np.ndarray, np.ndarray]], budget: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum of (T_i + 1) equal to `budget`, by dynamic programming; -1 leaves a group out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, (differ, correlation) in zip(groups, stats):
        within = chance_within(bits, differ, correlation)
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for u in range(min(budget - spent, len(bits)) + 1):
                probes = sum(math.comb(len(bits), r) for r in range(u))
                if probes > MOST_PROBES:
                    break
                extra = u and ROW_COST * rows * (probes + 1) + COMPARE_COST * rows * rows / 2 * within[u - 1]
                if spent + u not in new or cost + extra < new[spent + u][0]:
                    new[spent + u] = (cost + extra, [*chosen, u - 1])
        best = new
    return best.get(budget, (math.inf, []))


def pigeonhole_plan(rows: int, both: np.ndarray, radius: int, parts_per_word: range | None = None) -> list[Partition]:
    """Partitions and thresholds that find every pair within `radius`, the cheapest for this corpus."""
    rows, stats = max(rows, 1), []
    for m in both:
        p = np.diag(m) / rows
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        correlation = np.clip(np.abs(m / rows - np.outer(p, p)) / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(correlation, 1.0)
        stats.append((2 * p * (1 - p), correlation))
    found: tuple[float, list[Partition]] = (math.inf, [])
    for parts in parts_per_word or range(2, radius + 4):
        split = [(word, bits) for word, (_, correlation) in enumerate(stats) for bits in grouped_bits(correlation, parts)]
        cost, thresholds = allocate(rows, [bits for _, bits in split], [stats[word] for word, _ in split], radius + 1)
        if cost < found[0]:
            found = (cost, [Partition(word, tuple(bits), t) for (word, bits), t in zip(split, thresholds) if t >= 0])
    return found[1]


def may_be_similar(one: list[Column], other: list[Column], sizes: Column, min_similarity: float) -> Column:
    """False where more parity bits differ than shingles may that stand in one of two sets only, given the sum of their sizes."""
    apart = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(one, other)]
    return sum(apart[1:], apart[0]) <= sizes * ((1 - min_similarity) / (1 + min_similarity)) + 1e-6


def near_links(prints: DataFrame, key: str, words: int, radius: int, plan: list[Partition], min_ratio: float | None = None, group: str | None = None, provable: bool = False) -> DataFrame:
    """`a, b`: keys of fingerprints at most `radius` bits apart that agree in a partition of `plan`, each pair once, a < b.

    With `min_ratio`, only pairs whose sizes are at least that close; the class of sizes joins the key of the search. With
    `group`, only pairs that differ in that column; with `provable`, none whose parities prove that their sets' similarity is below `min_ratio`.
    """
    names = [f"w{k}" for k in range(words)]
    more = [*([group] if group else []), *(PARITY if provable else [])]

    def value(delta: Column | None) -> Column:
        word = F.element_at(F.array(*names), F.col("s.word") + 1)
        return (word if delta is None else word.bitwiseXOR(delta)).bitwiseAND(F.col("s.mask"))

    def literals(with_deltas: bool) -> Column:
        rows = [(i, p.word, p.mask, d) for i, p in enumerate(plan) for d in (p.deltas if with_deltas else [0])]
        return F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("part"), F.lit(w).cast("int").alias("word"), F.lit(m).cast("long").alias("mask"), F.lit(d).cast("long").alias("delta")) for i, w, m, d in rows]))

    kind = F.floor(F.log(F.greatest("size", F.lit(1))) / -math.log(min_ratio) + 1e-9).cast("int") if min_ratio else F.lit(0)
    base = prints.select(F.col(key).alias("key"), *names, "size", kind.alias("kind"), *more)
    # a size within the ratio lies in the same class or the next
    kinds = F.explode(F.array(F.col("kind"), F.col("kind") + 1)) if min_ratio else F.col("kind")
    stored = base.withColumn("s", literals(False)).select(F.col("s.part").alias("part"), value(None).alias("value"), "kind", F.col("key").alias("b"), F.col("size").alias("b_size"), *[F.col(n).alias(f"b_{n}") for n in names], *more)
    probes = base.withColumn("kind", kinds).withColumn("s", literals(True)).select(F.col("s.part").alias("part"), value(F.col("s.delta")).alias("value"), "kind", F.col("key").alias("a"), F.col("size").alias("a_size"), *[F.col(n).alias(f"a_{n}") for n in names], *more)
    apart = [F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}")) for n in names]
    ok = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0])) <= radius
    if min_ratio:
        ok = ok & (F.col("a_size") >= F.col("b_size") * min_ratio - 1e-9) & (F.struct("a_size", "a") < F.struct("b_size", "b"))
    else:
        ok = ok & (F.col("a") < F.col("b"))
    # a pair counts in the first partition that finds it
    agree = [F.when(F.bit_count(apart[p.word].bitwiseAND(F.lit(p.mask).cast("long"))) <= p.threshold, F.lit(i)) for i, p in enumerate(plan)]
    first = F.coalesce(*agree) == F.col("p.part")
    on = (F.col("p.part") == F.col("q.part")) & (F.col("p.value") == F.col("q.value")) & (F.col("p.kind") == F.col("q.kind"))
    if group:
        on = on & (F.col(f"p.{group}") != F.col(f"q.{group}"))
    if provable:
        ok = ok & may_be_similar([F.col(f"p.{n}") for n in PARITY], [F.col(f"q.{n}") for n in PARITY], F.col("a_size") + F.col("b_size"), min_ratio)
    return probes.alias("p").join(stored.alias("q"), on & ok & first).select("a", "b")


def neighbour_links(prints: DataFrame, key: str, words: int, radius: int, plan: list[Partition], min_ratio: float, turn: int = 0) -> DataFrame:
    """`a, b`: some of the pairs of `near_links` that differ in the column `group`, for each fingerprint at most one in each partition of `plan`.

    The fingerprints that agree in a partition and in the class of sizes are put in a row, and each is held against the one
    before: sorted by their words from the one after the partition's on, where near copies, which agree in most bits, come to
    stand together, and in further turns by a hash, another one each.
    """
    names = [f"w{k}" for k in range(words)]
    kind = F.floor(F.log(F.greatest("size", F.lit(1))) / -math.log(min_ratio) + 1e-9).cast("int")
    turns = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("part"), F.lit(p.word).cast("int").alias("word"), F.lit(p.mask).cast("long").alias("mask")) for i, p in enumerate(plan)]))
    word = [F.element_at(F.array(*names), (F.col("s.word") + k) % words + 1) for k in range(words)]
    base = prints.select(F.col(key).alias("key"), "group", *names, "size", kind.alias("kind")).withColumn("s", turns)
    dealt = base.select("s.part", word[0].bitwiseAND(F.col("s.mask")).alias("value"), "kind", "key", "group", "size", *[word[(k + 1) % words].alias(f"w{k}") for k in range(words)])
    of = Window.partitionBy("part", "value", "kind").orderBy(*([F.xxhash64(F.lit(turn), "part", "key")] if turn else names), "key")
    pairs = dealt.withColumn("before", F.lag(F.struct("key", "group", "size", *names)).over(of))
    apart = [F.bit_count(F.col(n).bitwiseXOR(F.col(f"before.{n}"))) for n in names]
    least, most = F.least("size", "before.size"), F.greatest("size", "before.size")
    near = pairs.where((F.col("group") != F.col("before.group")) & (sum(apart[1:], apart[0]) <= radius) & (least >= most * min_ratio - 1e-9))
    return near.select(F.least("key", "before.key").alias("a"), F.greatest("key", "before.key").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: `doc_id, fingerprint, component_id`.

    Fingerprints of 64 bits are linked at `radius` or fewer differing bits; a document's component is the smallest id that
    links reach, itself included. Rows of equal fingerprint are one node from the start, so copies cost one row however
    many there are, and links are made between different fingerprints only.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Null ids are
    ignored when the smallest id is taken; a component without ids has a null one. Repeated rows each get their row. Other
    columns are ignored. An empty table gives no rows.
    """
    prints = saved(fingerprints(docs, id_col, text_col, shingle).select("doc_id", "w0"), "fingerprints")
    nodes = saved(prints.groupBy("w0").agg(F.min("doc_id").alias("first_id")).withColumn("size", F.lit(1)), "nodes")
    rows, both = bit_moments(nodes, 1)
    plan = pigeonhole_plan(rows, both, radius)
    links = saved(near_links(nodes, "w0", 1, radius, plan), "near_links")
    member = components(links, "a", "b")
    first = member.join(nodes, member["node"] == nodes["w0"]).groupBy("component").agg(F.min("first_id").alias("linked_id"))
    linked = member.join(first, "component").select(F.col("node").alias("w0"), "linked_id")
    named = nodes.join(linked, "w0", "left").select("w0", F.least("first_id", "linked_id").alias("component_id"))
    return prints.join(named, "w0").select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, ends: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """`id, shingles`: the set of shingle hashes of each text whose id is in `ends`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "shingles": [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch["text"]]})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ends, "id", "left_semi")
    return saved(texts.dropDuplicates(["id"]).mapInPandas(run, "id long, shingles array<long>"), "shingle_sets")


def similar_pairs(sets: DataFrame, links: DataFrame, min_similarity: float) -> DataFrame:
    """The rows `a, b` of `links` whose shingle sets have a Jaccard similarity of `min_similarity` or more."""
    one = links.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return two.where(shared >= min_similarity * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def link_ends(links: DataFrame) -> DataFrame:
    return saved(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "ends")


def joined_nodes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """`nodes` with the component of each as `group`, its own id where it is in none."""
    member = components(pairs, "a", "b")
    named = nodes.drop("group").join(member, nodes["doc_id"] == member["node"], "left")
    return saved(named.withColumn("group", F.coalesce("component", "doc_id")).drop("node", "component"), "joined_nodes")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, min_similarity: float = 0.8,
                words: int = 4, parts_per_word: int = 5, spread: float = 2.4, turns: int = 2) -> DataFrame:
    """`doc_id, group_id` of the documents that have a near copy: texts that share `min_similarity` of their word shingles.

    The fingerprint counts each distinct shingle once, as the similarity does. It has 64 * `words` bits, and as many partitions less one is the radius within which every pair is
    sure to be found. Beyond it a pair meets in a partition by chance: at a similarity of 0.8 bits differ in 15 of 100, so
    20 partitions of about 13 bits find it with probability 0.93, and at 0.9 with 0.996. Pairs within the distance
    expected at `min_similarity` plus `spread` standard deviations, and with sizes and parities that allow the similarity, are then held
    against the exact similarity of their shingle sets. Pairs that cannot change a group are left out: up to `turns` + 1 searches link each text to a few
    neighbours, the last one takes all pairs whose ends these links leave apart, so a large group costs links in proportion to its size. Texts with equal shingle sets are in one group from the start; equal
    fingerprints alone make texts candidates like any others.

    A group is named by its smallest id. Rows without an id are in no group; texts without words are copies of each other,
    as are texts of fewer words than a shingle if all words agree. Repeated rows of one id count once.
    """
    names = [f"w{k}" for k in range(words)]
    prints = saved(fingerprints(docs, id_col, text_col, shingle, words, repeats=False).where("doc_id IS NOT NULL"), "fingerprints")
    same = ["size", "content", *names]
    nodes = saved(prints.groupBy(*same).agg(F.min("doc_id").alias("doc_id"), *[F.first(n).alias(n) for n in PARITY]), "nodes")
    rows, both = bit_moments(nodes, words)
    parts = words * parts_per_word
    plan = pigeonhole_plan(rows, both, parts - 1, range(parts_per_word, parts_per_word + 1))
    p = math.acos(2 * min_similarity / (1 + min_similarity)) / math.pi
    bits = 64 * words
    radius = max(parts - 1, math.ceil(bits * p + spread * math.sqrt(bits * p * (1 - p))))

    # a few links of each text, in turns until they join no more, then all others but those inside a component that these make
    links = saved(neighbour_links(nodes.withColumn("group", F.col("doc_id")), "doc_id", words, radius, plan, min_similarity), "near_links")
    ends = link_ends(links)
    sets = shingle_sets(docs, ends, id_col, text_col, shingle)
    pairs = saved(similar_pairs(sets, links, min_similarity), "pairs")
    linked = joined_nodes(nodes.join(ends, nodes["doc_id"] == ends["id"], "left_semi"), pairs)
    for turn in range(1, turns + 1):
        links = saved(neighbour_links(linked, "doc_id", words, radius, plan, min_similarity, turn), "near_links")
        more = saved(similar_pairs(sets, links, min_similarity), "pairs")
        if more.isEmpty():
            break
        pairs = pairs.union(more)
        linked = joined_nodes(linked, pairs)
    grouped = nodes.join(linked.select("doc_id", "group"), "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id"))
    links = saved(near_links(saved(grouped, "grouped_nodes"), "doc_id", words, radius, plan, min_similarity, group="group", provable=True), "near_links")
    others = similar_pairs(shingle_sets(docs, link_ends(links), id_col, text_col, shingle), links, min_similarity)
    member = components(pairs.union(others), "a", "b")
    of = nodes.join(member, nodes["doc_id"] == member["node"], "left").select(F.col("doc_id").alias("first_id"), F.coalesce("component", "doc_id").alias("group_id"), *same)
    return prints.join(of, same).select("doc_id", "group_id", "first_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each near-copy group the document with the smallest id."""
    groups = near_groups(docs, id_col, text_col, **options)
    gone = groups.where("doc_id <> group_id").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone_id"], "left_anti")
