"""Token counts under a unigram vocabulary, by a Viterbi search that keeps counts instead of pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.rows import id_and_text, with_null_ids

MARK = "▁"  # stands for a space in the vocabulary
UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character scores this much below the lowest piece


class UnigramCounter:
    """Counts the pieces of the best segmentation of a word, as the unigram tokenizer with these pieces would cut it.

    An Aho-Corasick automaton enumerates every vocabulary match of the word; for each end position the best score is
    kept with its number of pieces. Matches are tried from the longest to the shortest, and a later one wins only with a
    strictly better score, so ties go to the longest last piece. A character that is not a piece itself may stand for one
    unknown piece; neighbouring unknown characters are one token, or one token a byte if the vocabulary has byte pieces.
    """

    def __init__(self, pieces: list[tuple[str, float]], bytes_known: bool, kept: int = 500_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(reversed(pieces)).items():  # the first of equal pieces counts
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.known = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_known, self.kept, self.cache = bytes_known, kept, {}
        # no piece, known or not, can go on from another character to a mark
        self.cuttable = MARK in self.known and not any(MARK in p.lstrip(MARK) for p, _ in pieces)

    def count(self, word: str) -> tuple[int, int, float]:
        """Pieces, unknown pieces and score of one word (a mark and what follows up to the next)."""
        found = self.cache.get(word)
        if found is None:
            found = self._viterbi(word)
            if len(word) <= 64:
                if len(self.cache) >= self.kept:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def _viterbi(self, word: str) -> tuple[int, int, float]:
        n = len(word)
        # for each end: score, pieces, unknown pieces, whether the last piece is unknown
        best: list[tuple[float, int, int, bool] | None] = [(0.0, 0, 0, False), *[None] * n]
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (length, score) in self.automaton.iter(word) if len(self.automaton) else ():
            matches[end + 1].append((length, score))
        for end in range(1, n + 1):
            top = None
            for length, score in sorted(matches[end], key=lambda m: -m[0]):
                before = best[end - length]
                total = before[0] + score
                if top is None or total > top[0]:
                    top = (total, before[1] + 1, before[2], False)
            if word[end - 1] not in self.known:
                before = best[end - 1]
                total = before[0] + self.unknown
                if top is None or total > top[0]:
                    if self.bytes_known:
                        size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                        top = (total, before[1] + size, before[2] + 1, True)
                    else:
                        top = (total, before[1] + (not before[3]), before[2] + (not before[3]), True)
            best[end] = top
        score, pieces, unknown, _ = best[n]
        return pieces, unknown, score


@lru_cache(maxsize=2)
def scored_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The ordinary pieces of a sentencepiece model with their scores, and whether it has a piece for every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return pieces, sum(map(model.is_byte, ids)) == 256


@lru_cache(maxsize=2)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(*scored_vocabulary(path))


def words_of(text: str | None) -> list[str]:
    """The text with a mark before it and for each space, cut before each mark."""
    parts = text.replace(MARK, " ").split(" ") if text else []
    return [MARK + part for part in (parts[1:] if parts and not parts[0] else parts)]


RUN = re.compile(f"(?<=[^{MARK}])(?={MARK})")


def runs_of(text: str | None, cuttable: bool = True) -> list[str]:
    """The text with a mark before it, unless it starts with one, and for each space; cut, if `cuttable`, only where a mark follows something else."""
    if not text:
        return []
    if cuttable and "  " not in text and MARK not in text:
        return words_of(text)
    marked = text.replace(" ", MARK)
    marked = marked if marked[0] == MARK else MARK + marked
    return RUN.split(marked) if cuttable else [marked]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", whole_runs: bool = False) -> DataFrame:
    """One row per input row: `doc_id, n_tokens, n_unknown, score`, over the whole text.

    `vocabulary` is the path of a sentencepiece model file on every executor; its ordinary pieces and their scores are the
    unigram vocabulary, and its byte pieces, if it has them, spell out unknown characters. Words are cut at every space before
    the search, so only distinct words are searched within a task; the memory of them is bounded and changes no count. With
    `whole_runs` they are cut only where no piece can lie across, so pieces of several spaces count as in a search of the
    whole text without cuts.

    Null and empty texts have 0 tokens. Repeated rows each get their row, other columns are ignored, an empty table gives
    no rows. A text without spaces is one word and is searched whole, in time linear in its length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(vocabulary)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = unknown = 0
                score = 0.0
                for word in runs_of(text, counter.cuttable) if whole_runs else words_of(text):
                    t, u, s = counter.count(word)
                    tokens, unknown, score = tokens + t, unknown + u, score + s
                rows.append((tokens, unknown, score))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_unknown", "score"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return with_null_ids(id_and_text(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, n_tokens long, n_unknown long, score double"
    ))
