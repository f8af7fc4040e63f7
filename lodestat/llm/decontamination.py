"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.rows import id_and_text, with_null_ids

WORD = re.compile(r"\w+")
BLOCKS = 8  # blocks of a fingerprint in the index, of 8 bits each
ITEMS = 4_096  # benchmark items that are held against all documents at a time


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` words, from the hashes of the words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
            out ^= out >> np.uint64(29)
        out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def window_prints(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The SimHash of `count` shingles from each of `starts`: a bit is 1 if set in over half of them."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    set_ = (sums[starts + count] - sums[starts]) * 2 > count
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()


class BenchmarkIndex:
    """A bounded block of items: their shingles, their fingerprints by size, and the multi-index of these.

    Two fingerprints within `radius` differ in at most radius // BLOCKS bits in one of the blocks; for each block and value
    the index knows the items that near, so no fingerprint within the radius is missed.
    """

    def __init__(self, items: list[tuple[int, str]], shingle: int, min_similarity: float, radius: int):
        self.shingle, self.min_similarity, self.radius = shingle, min_similarity, radius
        self.ids, self.counts, self.sizes, prints = [], [], [], []
        self.vocabulary: dict[str, int] = {}
        self.holders: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # by shingle size, hash: sizes of the items that hold it
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
            size = min(shingle, len(words))
            found = shingles_of(word_hashes(words), size)
            self.ids.append(item_id)
            self.sizes.append(len(words))
            self.counts.append(Counter(found.tolist()))
            prints.append(window_prints(found, np.zeros(1, np.int64), len(found))[0])
            for h in found.tolist():
                self.holders[size][h].add(len(words))
        self.sizes, self.prints = np.array(self.sizes, np.int64), np.array(prints, np.uint64)
        self.wanted = {size: np.array(sorted(h), np.uint64) for size, h in self.holders.items()}
        self.hash_of = word_hashes(list(self.vocabulary))
        value = np.arange(256, dtype=np.uint8)
        own = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        self.near = [np.bitwise_count(value[:, None] ^ own[:, b][None, :]) <= radius // BLOCKS for b in range(BLOCKS)]

    def hits(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """`item_id, first word, end word, similarity` of the best window of each item found in the text.

        A window without a shingle of any item has similarity 0 to all; only windows around such shingles are printed.
        """
        words = words_of(text)
        if not words or not self.ids:
            return []
        known = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        windows: set[tuple[int, int]] = set()  # item size, first word
        for size, wanted in self.wanted.items():
            if len(words) < size:
                continue
            gaps = np.concatenate(([0], np.cumsum(known < 0)))
            at = np.flatnonzero(gaps[size:] == gaps[:-size])
            if not len(at):
                continue
            first, last = at[0], at[-1] + size
            found = shingles_of(self.hash_of[np.maximum(known[first:last], 0)], size)[at - first]
            spot = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            for p, h in zip(at[wanted[spot] == found].tolist(), found[wanted[spot] == found].tolist()):
                for n in self.holders[size][h]:
                    width = min(n, len(words))
                    windows.update((n, s) for s in range(max(0, p + size - width), min(p, len(words) - width) + 1))
        best: dict[int, tuple[float, int, int]] = {}
        by_size: dict[int, list[int]] = defaultdict(list)
        for n, s in windows:
            by_size[n].append(s)
        hashes = word_hashes(words) if windows else None
        for n, starts in by_size.items():
            size, width = min(self.shingle, n), min(n, len(words))
            starts = np.sort(np.array(starts))
            items = np.flatnonzero(self.sizes == n)
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
                base = part[0]
                shingles = shingles_of(hashes[base : part[-1] + width], size)
                prints = window_prints(shingles, part - base, width - size + 1)
                blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
                close = np.zeros((len(part), len(items)), bool)
                for b in range(BLOCKS):
                    close |= self.near[b][blocks[:, b]][:, items]
                close &= np.bitwise_count(prints[:, None] ^ self.prints[items][None, :]) <= self.radius
                for k, i in zip(*np.nonzero(close)):
                    s, item = int(part[k]), int(items[i])
                    here, there = Counter(shingles[s - base : s - base + width - size + 1].tolist()), self.counts[item]
                    shared = sum((here & there).values())
                    similarity = shared / (here.total() + there.total() - shared)
                    if similarity >= self.min_similarity - 1e-9 and (item not in best or (-similarity, s) < (-best[item][0], best[item][1])):
                        best[item] = (similarity, s, s + width)
        return sorted((self.ids[k], a, b, sim) for k, (sim, a, b) in best.items())


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, items: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about `items` rows, each small enough for the driver and every task."""
    named = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    blocks = -(-named.count() // items)
    for k in range(blocks):
        block = named.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).distinct()
        yield [(r["id"], r["text"]) for r in block.orderBy("id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
               shingle: int = 5, min_similarity: float = 0.8, radius: int = 23, items: int = ITEMS) -> DataFrame:
    """`doc_id, item_id, first_word, end_word, similarity`: the best window of each benchmark item found in each document.

    Words are lower-cased runs of letters and digits. A window is as many words as the item has (or the whole document if
    that is shorter); its fingerprint must be within `radius` of the item's, which the multi-index guarantees to find, and
    its shingles, weighted by how often they stand there, must have a Jaccard similarity of `min_similarity`. An item of
    fewer words than a shingle is looked for as one shingle. The benchmark is held in blocks of about `items` rows
    against all documents, whole texts.

    Documents without a hit have no row; null and empty texts have none, nor have items without words, without text or
    without an id. A document or item that is repeated is reported for each distinct one and each row. Other columns are
    ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, first_word int, end_word int, similarity double"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_id_col, item_text_col, items):

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            index = BenchmarkIndex(block, shingle, min_similarity, radius)
            for batch in batches:
                hits = [(d, *hit) for d, text in zip(batch["doc_id"].array, batch["text"]) for hit in index.hits(text)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "first_word", "end_word", "similarity"])

        found = found.union(rows.mapInPandas(run, schema))
    return with_null_ids(found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
               shingle: int = 5, min_similarity: float = 0.8, radius: int = 23, items: int = ITEMS) -> DataFrame:
    """The rows of `docs` without a hit of any benchmark item, with all their columns; rules as in `find_leaks`."""
    for block in item_blocks(benchmark, item_id_col, item_text_col, items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = BenchmarkIndex(block, shingle, min_similarity, radius)
            for batch in batches:
                yield batch.filter(pa.array([not index.hits(t) for t in batch.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
