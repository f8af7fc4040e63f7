"""Repeated passages: paragraphs by MinHash banding with exact verification, and runs of sentences that stand elsewhere.

A paragraph is a line of a text. Paragraphs of enough words get MinHash bands over their five-word shingles; those that
collide are held against the exact Jaccard similarity of their shingle sets and clustered by components; left out before are
only those whose numbers of shingles, or bits that shingles flip, prove that they differ too much. A passage that was
set into the middle of a line makes no similar line, so every line is also cut at its sentences and clauses, which depend on the
words there alone and so fall alike wherever the passage stands; those that stand elsewhere, in a row of enough words, are
a repeated passage. So that this needs neither stops nor line breaks, the whole text is cut a second time where the hash of
five words is the lowest of a window; a passage of 40 words shares all cuts but those near its ends. Of each cluster, and of each sentence, the first copy by document id and place stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.components import components
from lodestat.llm.shingles import LOWER, PARITY_WORDS, SEED, mixed, parity, run_hashes
from lodestat.session import saved

SHINGLE = 5
BANDS, ROWS = 14, 5  # a pair of similarity 0.8 shares a band with probability 0.996, one of 0.9 with 0.999998
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
STOPS = frozenset(".!?;:,")
WINDOW = 12  # five-word hashes of which the lowest one cuts; a repeated passage of n words shares n - 2 * (WINDOW - 1) or more
SENTENCE_WORDS = 6  # a shorter sentence or clause goes with the next one of its line
PIECE = "doc_id long, kind int, pos int, start int, end int, words int, c1 long, c2 int, bands array<long>, size int, parity array<long>"


class Layout:
    """Words of a text with their places, its lines and its sentences as ranges of words."""

    def __init__(self, text: str | None):
        lines = [line.split() for line in text.split("\n")] if text else []
        words = [w for line in lines for w in line]
        self.words = " ".join(words).encode("utf-8", "surrogatepass").translate(LOWER).split(b" ") if words else []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if text and lengths.sum() + len(words) - 1 == len(text):  # one character between words
            self.starts = np.cumsum(lengths + 1) - lengths - 1
        else:
            at, places = 0, []
            for w in words:
                at = text.index(w, at)
                places.append(at)
                at += len(w)
            self.starts = np.array(places, np.int64)
        self.ends = self.starts + lengths
        last = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
        self.lines = np.unique(last[last > 0])  # ends of lines that have words
        stops = np.fromiter((k for k, w in enumerate(words, 1) if w[-1] in STOPS), np.int64)
        cuts = np.union1d(stops, self.lines)
        long = np.diff(cuts, prepend=0) >= SENTENCE_WORDS
        self.sentences = cuts[long | np.isin(cuts, self.lines)] if len(cuts) else cuts
        self.shingles = run_hashes(self.words, SHINGLE)

    def content_cuts(self) -> np.ndarray:
        """Words before which some window of WINDOW five-word hashes has its lowest; a window whose lowest comes twice gives none.

        Every window inside a passage cuts alike wherever the passage stands, so cuts there are WINDOW words apart at most.
        """
        if len(self.shingles) < WINDOW:
            return np.zeros(0, np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(self.shingles, WINDOW)
        first, last = windows.argmin(axis=1), WINDOW - 1 - windows[:, ::-1].argmin(axis=1)
        return np.unique((np.arange(len(windows)) + first)[first == last])

    def contents(self, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the words of each range, which do not depend on what stands around it."""
        full = np.flatnonzero(ends - begins >= SHINGLE)
        c1, c2 = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.uint64)
        if len(full):
            at = np.column_stack([begins[full], ends[full] - SHINGLE + 1]).ravel()
            for c, k in ((c1, 1), (c2, 2)):
                c[full] = np.add.reduceat(np.append(mixed(self.shingles, k), np.uint64(0)), at)[::2]
        for k in np.flatnonzero(ends - begins < SHINGLE):
            whole = b" ".join(self.words[begins[k] : ends[k]])
            c1[k], c2[k] = xxhash.xxh64_intdigest(whole, SEED), xxhash.xxh64_intdigest(whole, SEED + 1)
        return c1.view(np.int64), (c2 >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def band_keys(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each range of words (of a shingle or more) one key a band, from the minima of BANDS * ROWS hashes."""
        at = np.column_stack([begins, ends - SHINGLE + 1]).ravel()
        keys = np.zeros((len(begins), BANDS), np.uint64)
        shingles = np.append(self.shingles, np.uint64(0))
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                for odd in FACTORS[b]:  # the hashes are uniform, so an odd factor orders them anew
                    low = np.minimum.reduceat(shingles * odd, at)[::2]
                    keys[:, b] = mixed(keys[:, b] * np.uint64(31) + low, b + 1)
        return keys.view(np.int64)


def pieces_of(doc_id: int, text: str | None, min_words: int) -> list[tuple]:
    """Columns of PIECE, a tuple for each kind: every sentence (kind 0), every line of `min_words` or more with its band keys, number of distinct shingles and their parity (kind 1), and what lies between content cuts (kind 2).

    A piece of kind 2 goes on over the five words behind its second cut, so that pieces in a row overlap and only come from
    one place together; `words` leaves these five out.
    """
    layout, found = Layout(text), []
    for kind, ends in ((0, layout.sentences), (1, layout.lines)):
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        keep = np.flatnonzero(ends - begins >= (max(min_words, SHINGLE) if kind else 1))
        if not len(keep):
            continue
        c1, c2 = layout.contents(begins, ends)
        bands, sizes, parities = np.full(len(keep), None, object), np.zeros(len(keep), np.int64), np.full(len(keep), None, object)
        if kind:
            bands = list(layout.band_keys(begins[keep], ends[keep]))
            sets = [np.unique(layout.shingles[a : b - SHINGLE + 1]) for a, b in zip(begins[keep], ends[keep])]
            sizes, parities = np.array([len(x) for x in sets]), [parity(x) for x in sets]
        found.append((np.full(len(keep), doc_id), np.full(len(keep), kind), keep, layout.starts[begins[keep]], layout.ends[ends[keep] - 1], (ends - begins)[keep], c1[keep], c2[keep], sizes, bands, parities))
    cuts = layout.content_cuts()
    if len(cuts) > 1:
        begins, ends, n, none = cuts[:-1], cuts[1:] + SHINGLE, len(cuts) - 1, np.full(len(cuts) - 1, None, object)
        c1, c2 = layout.contents(begins, ends)
        found.append((np.full(n, doc_id), np.full(n, 2), np.arange(n), layout.starts[begins], layout.ends[ends - 1], np.diff(cuts), c1, c2, np.zeros(n, np.int64), none, none))
    return found


def repeated_runs(pieces: DataFrame, min_words: int) -> DataFrame:
    """`doc_id, start, end, n_words, keep_doc_id` of the runs of sentences, and of pieces between content cuts, that stand elsewhere, first copies left out."""
    units = pieces.where("kind <> 1").select("kind", "doc_id", "pos", "start", "end", "words", "c1", "c2")
    shared = units.groupBy("kind", "c1", "c2").agg(F.min("doc_id").alias("keep_doc_id"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = units.join(shared.select("kind", "c1", "c2", "keep_doc_id", F.col("first.pos").alias("keep_pos")), ["kind", "c1", "c2"]).where("doc_id <> keep_doc_id OR pos <> keep_pos")
    of = Window.partitionBy("doc_id", "kind").orderBy("pos")  # the pieces of one document
    once = again.withColumn("before", F.lag("pos").over(of)).where("before IS NULL OR before <> pos")  # of repeated rows
    behind = F.when(F.col("kind") == 2, SHINGLE).otherwise(0)
    return once.withColumn("run", F.col("pos") - F.row_number().over(of)).groupBy("doc_id", "kind", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("words") + behind).cast("int").alias("n_words"), F.min_by("keep_doc_id", "pos").alias("keep_doc_id")
    ).where(F.col("n_words") >= min_words).drop("kind", "run")


def similar_lines(texts: DataFrame, nodes: DataFrame, min_similarity: float) -> DataFrame:
    """`a, b`: pairs of different lines that share a band and whose shingle sets have the Jaccard similarity."""
    words = range(PARITY_WORDS)
    keyed = nodes.select("node", "size", *[F.col("parity")[k].alias(f"w{k}") for k in words], F.posexplode("bands").alias("band", "key"))
    left, right = keyed.alias("l"), keyed.alias("r")
    apart = [F.bit_count(F.col(f"l.w{k}").bitwiseXOR(F.col(f"r.w{k}"))) for k in words]
    may_differ = (F.col("l.size") + F.col("r.size")) * ((1 - min_similarity) / (1 + min_similarity)) + 1e-6  # shingles that stand in one set only
    possible = (sum(apart[1:], apart[0]) <= may_differ) & (F.abs(F.col("l.size") - F.col("r.size")) <= may_differ)
    on = (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & possible
    pairs = saved(left.join(right, on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct(), "line_pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    places = saved(ends.groupBy(F.col("node.doc_id").alias("doc_id")).agg(F.sort_array(F.collect_list("node.pos")).alias("places")), "line_places")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, wanted in zip(batch["doc_id"], batch["text"], batch["places"]):
                layout = Layout(text)
                for pos in wanted:
                    begin = layout.lines[pos - 1] if pos else 0
                    rows.append((doc_id, pos, np.unique(layout.shingles[begin : layout.lines[pos] - SHINGLE + 1]).view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "shingles"])

    found = texts.join(places, "doc_id").mapInPandas(run, "doc_id long, pos int, shingles array<long>")
    sets = saved(found.select(F.struct("doc_id", "pos").alias("node"), "shingles"), "line_shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= min_similarity * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, min_similarity: float = 0.8, passage_words: int = 18) -> DataFrame:
    """`doc_id, kind, start, end, n_words, keep_doc_id`: spans (code points, end exclusive) to remove, and where a first copy stays.

    Kind `paragraph` is a line of `min_words` or more that is equal or similar to a line that stays; `passage` is a run of
    sentences, or of pieces between content cuts, `passage_words` together, each of which stands elsewhere before. Of a passage the broken sentences and
    up to 11 words at either end can be left, so one of `passage_words` + 22 words is sure to be found, whatever its stops and line breaks. Spans are listed where they overlap.

    Words are what white space separates, A-Z lower-cased. Null and empty texts have no spans. A row without an id is not
    looked at; a repeated row of one id counts once. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):  # a few documents' rows at a time
                some = batch.iloc[at : at + 500]
                found = [columns for d, t in zip(some["doc_id"], some["text"]) for columns in pieces_of(d, t, min_words)]
                if found:
                    *numbers, bands, parities = zip(*found)
                    data = dict(zip(names, map(np.concatenate, numbers)))
                    yield pd.DataFrame(data | {"bands": [x for part in bands for x in part], "parity": [x for part in parities for x in part]})

    names = [c.split()[0] for c in PIECE.split(", ") if "array" not in c]
    pieces = saved(texts.mapInPandas(run, PIECE), "pieces")
    lines = pieces.where("kind = 1")
    nodes = saved(lines.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "pos")).alias("node"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("parity").alias("parity")), "lines")
    member = components(similar_lines(texts, nodes, min_similarity), "a", "b")
    of = nodes.join(member, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("keep"))
    paragraphs = lines.join(of, ["c1", "c2"]).where("struct(doc_id, pos) <> keep").select("doc_id", F.lit("paragraph").alias("kind"), "start", "end", F.col("words").alias("n_words"), F.col("keep.doc_id").alias("keep_doc_id"))
    passages = repeated_runs(pieces, passage_words).select("doc_id", F.lit("passage").alias("kind"), "start", "end", "n_words", "keep_doc_id")
    return paragraphs.union(passages).distinct()


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with the spans of `repeated_passages` cut out of `text_col`; other rows and columns as they are."""
    spans = repeated_passages(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias("__of")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str | None, found) -> str | None:
            if text is None or found is None:
                return text
            out, at = [], 0
            for span in found:
                out.append(text[at : max(at, span["start"])])
                at = max(at, span["end"])
            return "".join(out) + text[at:]

        return pd.Series([one(t, s) for t, s in zip(texts, spans)])

    here = {c: F.col(f"here.`{c}`") for c in docs.columns}
    joined = docs.alias("here").join(spans.alias("found"), here[id_col].cast("long") == F.col("found.__of"), "left")
    return joined.select(*[cut(v, F.col("found.__spans")).alias(c) if c == text_col else v for c, v in here.items()])
