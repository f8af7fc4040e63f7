"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def as_col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Round and fold negative zero into zero."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null (ANSI mode raises on plain division)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate over complete pairs, null without variation (`corr` raises there in ANSI mode)."""
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]


def hash32(c: str | Column) -> Column:
    """Unsigned 32-bit number from md5(key): stable under repartitioning and portable to SQL."""
    return F.conv(F.substring(F.md5(as_col(c).cast("string")), 1, 8), 16, 10).cast("bigint")


def unit_hash(c: str | Column) -> Column:
    return hash32(c) / F.lit(4294967296.0)


def melt(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "value",
         keep: Sequence[str] = (), cast: str | None = None) -> DataFrame:
    """Long form (keep…, column, value); one narrow generate, no shuffle."""
    pairs = [F.struct(F.lit(c).alias(name), (as_col(c).cast(cast) if cast else as_col(c)).alias(value)) for c in cols]
    return df.select(*[as_col(k) for k in keep], F.explode(F.array(*pairs)).alias("__p")).select(
        *[as_col(k) for k in keep], F.col(f"__p.{name}").alias(name), F.col(f"__p.{value}").alias(value))


def rows_from_wide(agg: DataFrame, keys: Iterable[str], stats: Sequence[str], label: str = "column") -> DataFrame:
    """Turn a one-row aggregate with columns `key|stat` into one row per key."""
    structs = [F.struct(F.lit(k).alias(label), *[F.col(f"`{k}|{s}`").alias(s) for s in stats]) for k in keys]
    return agg.select(F.explode(F.array(*structs)).alias("__r")).select("__r.*")


def local_rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small result table from driver values; NumPy scalars become plain ones."""
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], schema)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches null keys; right key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = as_col(k).eqNullSafe(F.col(f"`__r_{k}`"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])
