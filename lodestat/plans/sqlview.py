"""User SQL over named views, and user functions over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestat.sources.versions import Dataset


def run_sql(sql: str, **views: DataFrame) -> DataFrame:
    """Any SELECT over the given tables (one is usually called df); Catalyst plans it as part of the whole."""
    if not views:
        raise ValueError("at least one table is needed")
    spark = next(iter(views.values())).sparkSession
    statement = sql.strip().rstrip(";")
    if not statement.lower().startswith(("select", "with", "(")):
        raise ValueError("only SELECT statements are accepted")
    theirs = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in views if name.lower() in theirs}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(statement)  # analysed at once, so the views may go
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def sql_to_version(dataset: Dataset, sql: str, label: str = "sql") -> int:
    """Save a query over the latest version as the next one."""
    return dataset.write(run_sql(sql, df=dataset.read()), label, operations=sql)


def user_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out = df.transform(fn)
    if not isinstance(out, DataFrame):
        raise TypeError("a table function must return a DataFrame")
    return out


def user_group_transform(df: DataFrame, by: list[str], fn: Callable, schema: str) -> DataFrame:
    """A pandas function per group with a declared result; groups must fit a task by the caller's choice of keys."""
    return df.groupBy(*by).applyInPandas(fn, schema)


ANALYSES: dict[str, Callable[..., DataFrame]] = {}


def register_analysis(name: str):
    def keep(fn: Callable[..., DataFrame]):
        ANALYSES[name] = fn
        return fn

    return keep


def run_analysis(name: str, df: DataFrame, **params) -> DataFrame:
    if name not in ANALYSES:
        raise KeyError(f"no analysis named {name}; known: {sorted(ANALYSES)}")
    return ANALYSES[name](df, **params)
