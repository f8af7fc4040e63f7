"""Ids and texts on their way through Python: a column of longs with nulls would become floats there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)  # stands for a null id


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`doc_id, text` as long and string, whatever the other columns are called; a null id is NO_ID."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def with_null_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))
