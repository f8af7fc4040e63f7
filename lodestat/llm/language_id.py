"""Language identification by compression: the language whose text, as a dictionary, makes a document smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.rows import id_and_text, with_null_ids

BLOCK = 2_048  # bytes of a text that are compressed at a time
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text in lower case with everything between words as one space; script and spelling tell the language, not numbers or marks."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def hash_rank(id_col: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the row alone."""
    return (F.xxhash64(id_col, text) / F.lit(2.0**64) + 0.5).cast("double")


def language_dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                          sample: int = 400, piece: int = 512, size: int = 100_000) -> dict[str, bytes]:
    """Raw-content dictionaries of at most `size` bytes, one for each language, from a bounded sample of labelled rows.

    Of each language the `sample` rows of lowest hash are taken, so a sample is the same whatever the partitioning: a
    first pass counts the rows of each language, a second keeps the rows whose hash is low enough to hold about twice the
    sample. Each row gives `piece` characters from the middle of its letters. Rows with a null text or language, or without
    a letter, are not learned from. Languages come in descending order of their rows.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("low", hash_rank(F.col("id"), F.col("text")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return {}
    cut = F.lit(1.0)
    for lang, n in counts.items():
        if n > 4 * sample:
            cut = F.when(F.col("lang") == lang, F.lit(2.0 * sample / n)).otherwise(cut)
    some = rows.where(F.col("low") < cut).where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("low", "id", "text")
    taken = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)

    @F.pandas_udf("string")
    def middle(texts: pd.Series) -> pd.Series:
        clean = texts.map(letters)
        return pd.Series([t[max(0, (len(t) - piece) // 2) :][:piece] for t in clean])

    found: dict[str, list[str]] = {lang: [] for lang, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))}
    for r in taken.select("lang", "k", middle("text").alias("part")).orderBy("lang", "k").collect():  # at most `sample` a language
        found[r["lang"]].append(r["part"])
    return {lang: " ".join(reversed(parts)).encode()[-size:] for lang, parts in found.items() if parts}


class LanguageModel:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int):
        self.names, self.coders = list(dictionaries), []
        for data in dictionaries.values():
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """For each language the sum over the text's blocks; blocks keep the dictionary in reach of the whole text."""
        data = letters(text).encode("utf-8", "surrogatepass")
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and relative margin. Ties go to the language named first; `und` if nothing can be said."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(sizes) > 1 else 1.0
        return self.names[order[0]], min(1.0, 0.5 + 5 * margin) if len(sizes) > 1 else 1.0, margin


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
                      level: int = 6, min_margin: float = 0.01) -> DataFrame:
    """One row per input row: `doc_id, lang_pred, score, margin, narrow`.

    Every block of the whole text is compressed with each language's dictionary and the smallest total wins; `margin` is
    by how much of the second smallest, `narrow` marks predictions to be rejected because it is under `min_margin`.
    `score` is 0.5 for equal sizes and reaches 1 at a margin of one tenth.

    A null text, and one without a letter, is `und` with score 0 and narrow; so is every text if there are no
    dictionaries. Ties go to the language named first, which is the one with most rows learned. Repeated rows each get their row, other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LanguageModel(dictionaries, level)
        for batch in batches:
            out = pd.DataFrame([model.classify(t) for t in batch["text"]], columns=["lang_pred", "score", "margin"])
            out["narrow"] = out["margin"] < min_margin
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return with_null_ids(id_and_text(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, lang_pred string, score double, margin double, narrow boolean"
    ))
