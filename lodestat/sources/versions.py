"""Numbered snapshots of a table: one folder per version and a manifest row each."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "version int, parent int, label string, operations string, created string"


class Dataset:
    """`root/version=k` holds the rows of version k; `root/_manifest` its history. Single writer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def _manifest(self) -> str:
        return f"{self.root}/_manifest"

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(_SCHEMA).json(self._manifest).orderBy("version")
        except AnalysisException:
            return self.spark.createDataFrame([], _SCHEMA)

    def latest(self) -> int:
        return self.history().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def write(self, df: DataFrame, label: str, parent: int | None = None, operations: str = "") -> int:
        """Rows first, manifest last: a failed write leaves no listed version."""
        last = self.latest()
        version = last + 1
        df.write.mode("overwrite").parquet(f"{self.root}/version={version}")
        entry = [(version, parent if parent is not None else (last or None), label, operations,
                  datetime.now(timezone.utc).isoformat())]
        self.spark.createDataFrame(entry, _SCHEMA).coalesce(1).write.mode("append").json(self._manifest)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        version = version or self.latest()
        if not version:
            raise ValueError("dataset has no version")
        return self.spark.read.parquet(f"{self.root}/version={version}")

    def restore(self, version: int) -> int:
        return self.write(self.read(version), f"restored from {version}", version, "restore")

    def copy_to(self, root: str, version: int | None = None) -> "Dataset":
        other = Dataset(self.spark, root)
        other.write(self.read(version), f"copy of {self.root}", None, "copy")
        return other
