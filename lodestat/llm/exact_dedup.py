"""Exact duplicates by 128-bit content hash, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 normalise: Callable[[Column], Column] = ascii_lower, digest: Callable[[Column], Column] = digest128) -> DataFrame:
    """One row per input row: `doc_id, keep_id, group_size, kept, text_sha256`.

    Rows are grouped by a 128-bit hash and, inside a hash group, by their bytes: the text is part of the grouping key, so
    texts that only share a hash stay apart. The partial aggregate holds one row per distinct text and map task, which
    folds a group of copies of any size before the shuffle; the text crosses it once for each. Rows then meet their group
    through the hash and the SHA-256 of the text, without the text; a group that holds a large share of the rows is split
    there by adaptive skew-join handling.

    Null texts count as empty. Of equal texts the row with the smallest (`keep="max"`: largest) id stays; rows that repeat
    this id and text are the same document and stay with it. Null ids never win over an id; where all ids of a group are
    null, its rows stay. Other input columns are ignored, so their names cannot clash. An empty table gives no rows.
    """
    text = normalise(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    groups = (
        rows.withColumn("hash", digest("text")).groupBy("hash", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    keyed = rows.select("doc_id", digest(F.col("text")).alias("hash"), F.sha2("text", 256).alias("text_sha256"))
    return keyed.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                normalise: Callable[[Column], Column] = ascii_lower) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one document of each set of equal texts.

    Same rules as `exact_groups`. Documents are matched by id and text, so an id that stands on different texts keeps each
    text that won its group.
    """
    gone = exact_groups(docs, id_col, text_col, keep, normalise).where(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    here, text = docs.alias("here"), normalise(F.col(f"here.`{text_col}`"))
    same = F.col(f"here.`{id_col}`").eqNullSafe(F.col("gone.doc_id")) & (F.sha2(text, 256) == F.col("gone.text_sha256"))
    return here.join(gone.alias("gone"), same, "left_anti")
