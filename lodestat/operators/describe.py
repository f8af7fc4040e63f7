"""Descriptive statistics: one aggregate for all columns, one grouped count for modes and top values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.expr import (as_col, melt, numeric_columns, ratio, rows_from_wide, string_columns,
                                     temporal_columns)
from lodestat.operators.quantiles import exact_quantiles, quantiles_by

Z95 = 1.96
MIN_MOMENT_ROWS = 3
MIN_TUKEY_ROWS = 12


def adjusted_skew(g1: Column, n: Column) -> Column:
    """Sample skewness G1 from the population moment ratio."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis G2 from the population moment ratio."""
    n = n.cast("double")
    return F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3)))


def column_modes(df: DataFrame, cols: Sequence[str], cast: str | None = None) -> DataFrame:
    """Most frequent value per column, smallest value on ties: (column, mode, mode_n)."""
    counts = melt(df, cols, cast=cast).where("value IS NOT NULL").groupBy("column", "value").count()
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("count")).alias("k"), "value")).alias("b"))
    return best.select("column", F.col("b.value").alias("mode"), (-F.col("b.k")).alias("mode_n"))


def moment_table(df: DataFrame, cols: Sequence[str], constants: dict[str, dict[str, float | None]] | None = None) -> DataFrame:
    """One row per column: n, nulls, mean, std, variance, min, max and population skew/kurtosis."""
    aggs = []
    stats = ["n", "nulls", "mean", "std", "variance", "min", "max", "g1", "g2"]
    for c in cols:
        v = as_col(c).cast("double")
        parts = [F.count(v), F.count_if(v.isNull()), F.avg(v), F.stddev_samp(v), F.var_samp(v), F.min(v), F.max(v),
                 F.skewness(v), F.kurtosis(v)]
        aggs += [p.alias(f"{c}|{s}") for p, s in zip(parts, stats)]
    extra: list[str] = []
    wide = df.agg(*aggs)
    for c in cols:
        for k, v in (constants or {}).get(c, {}).items():
            wide = wide.withColumn(f"{c}|{k}", F.lit(v).cast("double"))
            if k not in extra:
                extra.append(k)
    return rows_from_wide(wide, cols, [*stats, *extra])


def numeric_descriptive(df: DataFrame, cols: Sequence[str] | None = None, extended: bool = False) -> DataFrame:
    """Count, centre, spread and shape per numeric column; `extended` adds standard error, CI and percentiles."""
    cols = list(cols or numeric_columns(df))
    probs = {"q1": .25, "median": .5, "q3": .75}
    if extended:
        probs |= {"p01": .01, "p05": .05, "p10": .1, "p90": .9, "p95": .95, "p99": .99}
    q = exact_quantiles(df, cols, list(probs.values()))
    table = moment_table(df, cols, {c: dict(zip(probs, q[c])) for c in cols})
    out = table.join(F.broadcast(column_modes(df, cols, "double")), "column", "left")  # one row per column
    n = F.col("n").cast("double")
    picked = [
        "column", F.col("n").alias("count"), "mean", "median", "mode", "std", "variance", "min", "max",
        (F.col("max") - F.col("min")).alias("range"), "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        (ratio(F.col("std"), F.col("mean")) * 100).alias("cv_pct"),
        adjusted_skew(F.col("g1"), n).alias("skewness"), adjusted_kurtosis(F.col("g2"), n).alias("kurtosis"),
        F.col("nulls").alias("null_count"), ratio(F.col("nulls"), F.col("nulls") + F.col("n")).alias("null_rate")]
    if extended:
        se = ratio(F.col("std"), F.sqrt(n))
        picked += [se.alias("std_error"), (F.col("mean") - Z95 * se).alias("ci_low"),
                   (F.col("mean") + Z95 * se).alias("ci_high"), "p01", "p05", "p10", "p90", "p95", "p99"]
    return out.select(*picked)


def temporal_descriptive(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or temporal_columns(df))
    aggs = [e.alias(f"{c}|{s}") for c in cols for e, s in (
        (F.count(as_col(c)), "count"), (F.min(as_col(c)), "min"), (F.max(as_col(c)), "max"),
        (F.count_distinct(as_col(c)), "periods"), (F.count_if(as_col(c).isNull()), "null_count"))]
    return rows_from_wide(df.agg(*aggs), cols, ["count", "min", "max", "periods", "null_count"])


def identifier_descriptive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [e.alias(f"{c}|{s}") for c in cols for e, s in (
        (F.count_distinct(as_col(c)), "cardinality"), (F.count(as_col(c)), "count"),
        (F.count_if(as_col(c).isNull()), "null_count"))]
    out = rows_from_wide(df.agg(*aggs), cols, ["cardinality", "count", "null_count"])
    return out.withColumn("uniqueness", ratio(F.col("cardinality"), F.col("count")))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column (ties by value): (column, value, n, position)."""
    counts = melt(df, cols, cast="string").where("value IS NOT NULL").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    # the rank limit is applied on the map side before the per-column sort
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def categorical_descriptive(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or string_columns(df))
    counts = melt(df, cols, cast="string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.count("value").alias("cardinality"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("k"), "value"))).alias("b"),
    ).select("column", "cardinality", "count", "null_count", F.col("b.value").alias("mode"),
             (-F.col("b.k")).alias("mode_frequency"))


def describe_all(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Every column by its kind, in long form (column, kind, statistic, value as text)."""
    kinds = kinds or {c: ("numeric" if c in numeric_columns(df) else "temporal" if c in temporal_columns(df)
                          else "categorical") for c in df.columns}
    makers = {"numeric": lambda d, c: numeric_descriptive(d, c, extended=True), "temporal": temporal_descriptive,
              "identifier": identifier_descriptive, "categorical": categorical_descriptive}
    out = None
    for kind, make in makers.items():
        cols = [c for c, k in kinds.items() if k == kind]
        if not cols:
            continue
        wide = make(df, cols)
        stats = [s for s in wide.columns if s != "column"]
        part = wide.select("column", F.lit(kind).alias("kind"), F.explode(F.array(*[
            F.struct(F.lit(s).alias("statistic"), F.col(s).cast("string").alias("value")) for s in stats])).alias("r")
        ).select("column", "kind", "r.*")
        out = part if out is None else out.unionByName(part)
    return out


def shape_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population skewness and excess kurtosis; null under three rows or without variation."""
    t = moment_table(df, cols)
    ok = (F.col("n") >= MIN_MOMENT_ROWS) & (F.col("max") > F.col("min"))
    return t.select("column", F.col("n").alias("count"), F.when(ok, F.col("g1")).alias("skewness"),
                    F.when(ok, F.col("g2")).alias("kurtosis"))


def tukey_limits(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float] | None]:
    """Fence values per column; None when there are under 12 values or no interquartile spread."""
    q = exact_quantiles(df, cols, [.25, .75])
    counts = df.agg(*[F.count(as_col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else []
    out: dict[str, tuple[float, float] | None] = {}
    for i, c in enumerate(cols):
        a, b = q[c]
        usable = counts[i] >= MIN_TUKEY_ROWS and a is not None and b > a
        out[c] = (a - factor * (b - a), b + factor * (b - a)) if usable else None
    return out


def tukey_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    limits = tukey_limits(df, cols, factor)
    aggs = []
    for c in cols:
        lo, hi = limits[c] or (None, None)
        v = as_col(c).cast("double")
        out = F.count_if((v < F.lit(lo)) | (v > F.lit(hi))) if lo is not None else F.lit(None).cast("long")
        aggs += [F.lit(lo).cast("double").alias(f"{c}|lower"), F.lit(hi).cast("double").alias(f"{c}|upper"),
                 out.alias(f"{c}|outliers"), F.count(v).alias(f"{c}|n")]
    t = rows_from_wide(df.agg(*aggs), cols, ["lower", "upper", "outliers", "n"])
    return t.select("column", "lower", "upper", "outliers", ratio(F.col("outliers"), F.col("n")).alias("outlier_ratio"))


def class_balance(df: DataFrame, col: str) -> DataFrame:
    """Smallest-to-largest class ratio and majority share."""
    return df.where(as_col(col).isNotNull()).groupBy(as_col(col)).count().agg(
        F.count(F.lit(1)).alias("classes"), F.sum("count").alias("n"),
        ratio(F.min("count"), F.max("count")).alias("imbalance_ratio"),
        ratio(F.max("count"), F.sum("count")).alias("majority_share"))


def entropy(df: DataFrame, col: str) -> DataFrame:
    counts = df.where(as_col(col).isNotNull()).groupBy(as_col(col)).agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = counts.agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log("n")).alias("h"))
    return s.select(F.col("N").cast("long").alias("n"), (F.log("N") - F.col("h") / F.col("N")).alias("entropy"))


def missing_summary(df: DataFrame) -> DataFrame:
    """Per column: null rate, distinct values, share of the commonest value, and the flags drawn from them."""
    counts = melt(df, df.columns, cast="string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    t = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.count("value").alias("cardinality"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("top_n"))
    valid = F.col("rows") - F.col("null_count")
    text = [c for c in df.columns if c in string_columns(df)]
    return t.select(
        "column", "rows", "cardinality", "null_count", ratio(F.col("null_count"), F.col("rows")).alias("null_rate"),
        F.coalesce(ratio(F.col("top_n"), valid), F.lit(0.0)).alias("top_share"),
        (F.col("cardinality") <= 1).alias("constant"),
        ((valid > 0) & ((F.col("cardinality") <= 1) | (ratio(F.col("top_n"), valid) > 0.98))).alias("near_constant"),
        (F.col("column").isin(text) & (valid >= 20) & (F.col("cardinality") >= 0.95 * valid)).alias("identifier_like"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row."""
    g = df.groupBy(*[as_col(c) for c in df.columns]).count()
    return g.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
                 F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates")).withColumn(
        "duplicate_ratio", F.coalesce(ratio(F.col("duplicates"), F.col("rows")), F.lit(0.0)))


def box_statistics(df: DataFrame, group: str, value: str, min_rows: int = 5) -> DataFrame:
    """Quartiles, whisker ends inside 1.5 IQR and outlier count per group."""
    q = quantiles_by(df, [group], value, [.25, .5, .75], ["q1", "median", "q3"])
    v = as_col(value).cast("double")
    joined = df.where(v.isNotNull()).join(q, group)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return joined.groupBy(as_col(group)).agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.min(F.when(v >= lo, v)).alias("whisker_low"),
        F.max(F.when(v <= hi, v)).alias("whisker_high"), F.count_if((v < lo) | (v > hi)).alias("outliers"),
    ).where(F.col("n") >= min_rows)
