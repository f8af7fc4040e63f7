"""Stretches of words that repeat with a period, found on the Re-Pair grammar of each text.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol until no pair stands twice. A run of the text
lies across the middle of the lowest symbol whose expansion holds it, or across two neighbours of what is left at the top. So
each symbol's middle is searched once, inside the expansion of its first place; what is found is carried to all its places, and
a piece that its surroundings continue there is dropped, as it is part of a run that a higher middle gives whole.

At a middle, a run with four periods or more has two of them on one side. Periods from 2^k to before 2^(k+1) are candidates where
the 2^k words at the middle stand again at that distance; ids of all 2^k-word windows confirm a candidate without reading words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.rows import id_and_text, with_null_ids

FIRST_RULE = 1 << 30  # symbols from here on are rules, below are words
LOW = (1 << 32) - 1
WORD_IDS = 1_000_000  # words that keep their number from one text to the next, before the numbering starts anew


class Grammar:
    """Re-Pair of a word sequence: `at`, the places of the symbols left at the top, `is_rule` for each, and of every rule its
    places in the text, the length of its left part and its own. A rule's places are where it replaced a pair."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        sym, nxt, prv = [*words.tolist(), -1], list(range(1, n + 2)), list(range(-1, n))
        self.places: list[list[int]] = []
        self.left: list[int] = []
        self.size: list[int] = []
        pairs, heap = repeated_pairs(words), []
        for pair, places in pairs.items():
            heap.append((-len(places), pair))
        heapify(heap)
        while heap:
            claimed, pair = heappop(heap)
            x, y = pair >> 32, pair & LOW
            live = [p for p in pairs[pair] if sym[p] == x and sym[nxt[p]] == y]
            here = live
            if x == y:  # of overlapping pairs every other one, from the left
                here, last = [], -1
                for p in live:
                    if p != last:
                        here.append(p)
                        last = nxt[p]
            if len(here) < 2:
                del pairs[pair]
                continue
            if heap and len(here) < -claimed and -len(here) > heap[0][0]:
                pairs[pair] = live
                heappush(heap, (-len(here), pair))
                continue
            del pairs[pair]
            rule = FIRST_RULE + len(self.size)
            one = 1 if x < FIRST_RULE else self.size[x - FIRST_RULE]
            self.places.append(here)
            self.left.append(one)
            self.size.append(one + (1 if y < FIRST_RULE else self.size[y - FIRST_RULE]))
            fresh: defaultdict[int, list[int]] = defaultdict(list)
            for p in here:
                q = nxt[p]
                r = nxt[q]
                sym[p], sym[q], nxt[p], prv[r] = rule, -2, r, p
                before = prv[p]
                if before >= 0:
                    fresh[sym[before] << 32 | rule].append(before)
                if r < n:
                    fresh[rule << 32 | sym[r]].append(p)
            for new, places in fresh.items():
                if len(places) > 1:
                    pairs[new] = places
                    heappush(heap, (-len(places), new))
        top = np.array(sym[:n])
        self.at = np.flatnonzero(top >= 0)
        self.is_rule = top[self.at] >= FIRST_RULE


def repeated_pairs(words: np.ndarray) -> dict[int, list[int]]:
    """The places, ascending, of every pair of neighbouring words that stands more than once."""
    if len(words) < 3:
        return {}
    key = words[:-1] << 32 | words[1:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    step = np.diff(np.concatenate([[0], (key[1:] == key[:-1]).view(np.int8), [0]]))
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1
    order = order.tolist()
    return {k: order[a:b] for k, a, b in zip(key[begins].tolist(), begins.tolist(), ends.tolist())}


class Windows:
    """For windows of `size` words that stand more than once: ids of all windows, and the places of each id in order."""

    def __init__(self, ids: np.ndarray, size: int):
        self.size, self.n = size, len(ids)
        self.ids = ids
        self.sorted = np.sort(ids * self.n + np.arange(self.n))

    @classmethod
    def of_pairs(cls, words: np.ndarray, size: int = 2) -> Windows:
        return cls(numbered(words[:-1], words[1:]), size)

    def doubled(self) -> Windows:
        return Windows(numbered(self.ids[: -self.size], self.ids[self.size :]), 2 * self.size)

    def repeats(self) -> bool:
        gap = np.diff(self.sorted // max(self.n, 1))
        return bool((gap == 0).any())

    def after(self, window: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each window place, the first place of the same window at `least` or behind; the number of windows if there is none."""
        at = np.searchsorted(self.sorted, self.ids[window] * self.n + least)
        found = self.sorted[np.minimum(at, self.n - 1)]
        return np.where((at < self.n) & (found // self.n == self.ids[window]) & (least < self.n), found % self.n, self.n)

    def before(self, window: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The last place of the same window at `most` or before; -1 if there is none."""
        at = np.searchsorted(self.sorted, self.ids[window] * self.n + most, "right") - 1
        found = self.sorted[np.maximum(at, 0)]
        return np.where((at >= 0) & (found // self.n == self.ids[window]) & (most >= 0), found % self.n, -1)


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs (a, b) numbered: equal pairs, equal numbers below their count."""
    return np.unique(a << 32 | b, return_inverse=True)[1]


def equal_ahead(words: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words from a on equal those from b on (a < b), before b reaches `end`."""
    done, step = 0, 64
    while b + done < end:
        size = min(step, end - b - done)
        differ = words[a + done : a + done + size] != words[b + done : b + done + size]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + size, step * 2
    return done


def equal_behind(words: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words before a equal those before b (a < b), down to `end`."""
    done, step = 0, 64
    while a - done > end:
        size = min(step, a - done - end)
        differ = words[a - done - size : a - done] != words[b - done - size : b - done]
        if differ.any():
            return done + int(differ[::-1].argmax())
        done, step = done + size, step * 2
    return done


def runs_at(words: np.ndarray, middles: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, exponent: int) -> list[tuple[int, int, int, int]]:
    """(number of the middle, start, end, period) of the repetitions across each middle inside its [low, high)."""
    found: list[tuple[int, int, int, int]] = []
    # what the repetitions so far cover on a middle's right and left: squares inside them have a multiple of a known period
    right, left = middles.copy(), middles.copy()
    n, widest = len(words), (high - low) // exponent

    def take(which: int, q: int, ahead: bool) -> None:
        b, lo, hi = int(middles[which]), int(low[which]), int(high[which])
        # words from lo + q on are compared with those q before
        begin = b if ahead else b - 2 * q
        end = begin + 2 * q
        end += equal_ahead(words, end - q, end, hi)
        begin -= equal_behind(words, begin, begin + q, lo)
        if begin < b < end and end - begin >= max(length, exponent * q):
            found.append((which, begin, end, q))
        right[which], left[which] = max(right[which], end), min(left[which], begin)

    def single() -> None:
        for ahead, at in ((True, middles), (False, middles - 2)):
            fits = (at >= low) & (at + 2 <= high)
            same = np.zeros(len(middles), bool)
            same[fits] = words[at[fits]] == words[at[fits] + 1]
            for which in np.flatnonzero(same).tolist():
                take(which, 1, ahead)

    def level(windows: Windows, least: int, most: int) -> None:
        m = windows.size
        # ahead: the window at the middle and its next places
        live = np.flatnonzero((least <= widest) & (middles + 2 * least <= high))
        since = middles[live] + least
        while len(live):
            b = middles[live]
            since = np.maximum(since, b + (right[live] - b) // 2 + 1)
            at = windows.after(b, since)
            q = at - b
            keep = (q < most) & (q <= widest[live]) & (b + 2 * q <= high[live])
            live, b, q, at = live[keep], b[keep], q[keep], at[keep]
            square = windows.ids[b + q - m] == windows.ids[b + 2 * q - m]
            for which, period in zip(live[square].tolist(), q[square].tolist()):
                take(which, period, True)
            since = at + 1
        live = np.flatnonzero((least <= widest) & (middles - 2 * least >= low))
        until = middles[live] - m - least
        while len(live):
            b = middles[live]
            until = np.minimum(until, b - m - (b - left[live]) // 2 - 1)
            at = windows.before(b - m, until)
            q = b - m - at
            keep = (at >= 0) & (q < most) & (q <= widest[live]) & (b - 2 * q >= low[live])
            live, b, q, at = live[keep], b[keep], q[keep], at[keep]
            square = windows.ids[b - q] == windows.ids[b - 2 * q]
            for which, period in zip(live[square].tolist(), q[square].tolist()):
                take(which, period, False)
            until = at - 1

    single()
    windows = Windows.of_pairs(words)
    reach = int((high - low).max(initial=0))
    while windows.repeats():
        level(windows, windows.size, 2 * windows.size)
        if exponent * 2 * windows.size > reach or 2 * windows.size >= n:
            break
        windows = windows.doubled()
    return found


def find_runs(words: np.ndarray, length: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of `length` words and `exponent` periods or more, by start, then period."""
    if length < 6 or exponent < 4:
        raise ValueError("runs have at least 6 words and 4 periods")
    if len(words) < length:
        return []
    grammar = Grammar(words)
    if not grammar.size:
        return []  # no pair of words stands twice
    # a run holds a rule: words alone would repeat a pair. So a middle between two words that are no rules needs no search
    beside = np.flatnonzero(grammar.is_rule[1:] | grammar.is_rule[:-1]) + 1
    size, left = np.array(grammar.size), np.array(grammar.left)
    long = np.flatnonzero(size >= length)
    first = np.array([grammar.places[r][0] for r in long.tolist()], np.int64)
    middles = np.concatenate([grammar.at[beside], first + left[long]]).astype(np.int64)
    low = np.concatenate([np.zeros(len(beside), np.int64), first])
    high = np.concatenate([np.full(len(beside), len(words), np.int64), first + size[long]])
    runs: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, period: int) -> None:
        runs[start, end] = min(period, runs.get((start, end), period))

    for which, start, end, period in runs_at(words, middles, low, high, length, exponent):
        if which < len(beside):
            keep(start, end, period)
            continue
        rule = int(long[which - len(beside)])
        place = np.array(grammar.places[rule])
        begin, stop = place + (start - low[which]), place + (end - low[which])
        whole = np.ones(len(place), bool)
        if start == low[which]:  # what stands before the rule may go on with the period
            whole &= (begin == 0) | (words[begin - 1] != words[begin - 1 + period])
        if end == high[which]:
            inside = stop < len(words)
            whole &= ~inside | (words[np.where(inside, stop, 0)] != words[np.where(inside, stop - period, 1)])
        for a, b in zip(begin[whole].tolist(), stop[whole].tolist()):
            keep(a, b, period)
    return sorted((start, end - start, period) for (start, end), period in runs.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """`words` without those that any run holds behind its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        depth[start + period] += 1
        depth[start + size] -= 1
    return [words[i] for i in np.flatnonzero(depth[:-1].cumsum() == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 6, exponent: int = 4) -> DataFrame:
    """One row per input row: `doc_id, n_words, runs, collapsed`.

    Words are what stands between spaces, tabs and line ends (x20, x09-x0D). `runs` is an array of (start, length, period) in
    word numbers from 0, by start, then period: stretches of `length` words or more that repeat with smallest period `period`
    at least `exponent` times and that no word at either end continues. `collapsed` is the text without the words that any run
    holds behind its first period, joined by one space.

    Null counts as the empty text: no words, no runs, an empty string. Whole texts are read, one at a time. Repeated rows each
    get their row, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                sizes, found, rest = [], [], []
                for text in some["text"]:
                    words = text.encode("utf-8", "surrogatepass").split() if text else []
                    if len(numbers) > WORD_IDS:
                        numbers = defaultdict(count().__next__)
                    runs = find_runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), length, exponent)
                    sizes.append(len(words))
                    found.append([{"start": a, "length": b, "period": c} for a, b, c in runs])
                    rest.append(b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass"))
                yield pd.DataFrame({"doc_id": some["doc_id"].array, "n_words": sizes, "runs": found, "collapsed": rest})

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return with_null_ids(id_and_text(docs, id_col, text_col).mapInPandas(run, schema))


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 6, exponent: int = 4) -> DataFrame:
    """`docs` with the repeats of every run taken out of `text_col`; texts without a run, null among them, stay as they are."""

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
            runs = find_runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), length, exponent)
            return b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass") if runs else text

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text_col, rewritten(F.col(text_col)))
