"""The aggregated data behind charts; nothing here draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.dist import norm_ppf
from lodestat.functions.expr import local_rows, as_col, ratio
from lodestat.operators.quantiles import exact_quantiles

AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "median": F.median, "min": F.min, "max": F.max}


def aggregate(name: str, c: Column) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name}; choose from {sorted(AGGREGATES)}")
    return AGGREGATES[name](c)


def bin_of(v: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based equal-width bin, last bin closed on the right."""
    if hi <= lo:
        return F.when(v.isNotNull(), F.lit(0)).cast("long")
    return F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")


def value_range(df: DataFrame, col: str) -> tuple[int, float, float]:
    r = df.agg(F.count(as_col(col)), F.min(as_col(col)).cast("double"), F.max(as_col(col)).cast("double")).first()
    return r[0], r[1], r[2]


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Counts per equal-width bin, empty bins left out; by default 8 to 30 bins grow with the rows."""
    n, lo, hi = value_range(df, col)
    bins = bins or min(30, max(8, n // 12))
    width = (hi - lo) / bins if hi is not None and hi > lo else 0.0
    b = bin_of(as_col(col).cast("double"), lo, hi, bins)
    return df.where(as_col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n")


def grouped_aggregate(df: DataFrame, x: str, y: str, agg: str = "mean", top: int | None = None) -> DataFrame:
    """One value per group; with `top`, the groups with the largest values (ties by name)."""
    if agg == "median":
        from lodestat.operators.quantiles import quantiles_by
        out = quantiles_by(df, [x], y, [.5], ["value"])
    else:
        out = df.groupBy(as_col(x)).agg(aggregate(agg, as_col(y)).alias("value"))
    return out if top is None else out.orderBy(F.desc("value"), F.asc(x)).limit(top)


def pivot_aggregate(df: DataFrame, x: str, group: str, y: str, agg: str = "sum",
                    levels: Sequence[str] | None = None) -> DataFrame:
    levels = levels or [r[0] for r in df.select(as_col(group)).where(as_col(group).isNotNull()).distinct()
                        .orderBy(as_col(group)).limit(1001).collect()]
    if len(levels) > 1000:
        raise ValueError("too many levels for a pivot; use crosstab, which stays in long form")
    return df.groupBy(as_col(x)).pivot(group, list(levels)).agg(aggregate(agg, as_col(y)))


def crosstab(df: DataFrame, x: str, y: str, z: str | None = None, agg: str = "count") -> DataFrame:
    """Long contingency table (x, y, value); only cells that occur."""
    v = F.count(F.lit(1)) if z is None else aggregate(agg, as_col(z))
    return df.where(as_col(x).isNotNull() & as_col(y).isNotNull()).groupBy(as_col(x), as_col(y)).agg(v.alias("value"))


def heatmap(df: DataFrame, x: str, y: str, z: str | None = None, agg: str = "count", levels: int = 50) -> DataFrame:
    """Dense grid of the commonest levels on each side, empty cells 0."""
    def common(c: str) -> list:
        rows = df.where(as_col(c).isNotNull()).groupBy(as_col(c)).count().orderBy(F.desc("count"), F.asc(c)).limit(levels)
        return [r[0] for r in rows.collect()]

    xs, ys = common(x), common(y)
    v = F.count(F.lit(1)) if z is None else aggregate(agg, as_col(z))
    wide = df.where(as_col(x).isin(xs) & as_col(y).isin(ys)).groupBy(as_col(x)).pivot(y, ys).agg(v)
    cells = [F.struct(F.lit(k).alias(y), F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("double").alias("value")) for k in ys]
    return wide.select(as_col(x), F.explode(F.array(*cells)).alias("c")).select(x, "c.*")


def pie_shares(df: DataFrame, x: str, y: str | None = None, agg: str = "count", top: int = 10) -> DataFrame:
    """Value and percentage of the top groups; percentages are of their own total."""
    v = F.count(F.lit(1)) if y is None else aggregate(agg, as_col(y))
    best = df.where(as_col(x).isNotNull()).groupBy(as_col(x)).agg(v.cast("double").alias("value")).orderBy(
        F.desc("value"), F.asc(x)).limit(top)
    return best.withColumn("percent", ratio(F.col("value"), F.sum("value").over(Window.partitionBy(F.lit(0)))) * 100)


def radar(df: DataFrame, x: str, measures: Sequence[str], agg: str = "mean") -> DataFrame:
    return df.groupBy(as_col(x)).agg(*[aggregate(agg, as_col(m)).alias(m) for m in measures])


def period_unit(rows: int) -> str:
    return "year" if rows > 15_000 else "month" if rows > 1_500 else "day"


PERIOD_FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def period_label(ts: Column, unit: str) -> Column:
    return F.date_format(ts, PERIOD_FORMATS[unit])


def temporal_buckets(df: DataFrame, ts: str, y: str, agg: str = "sum", unit: str = "auto") -> DataFrame:
    """Aggregate per day, month or year; `auto` coarsens as the table grows."""
    if unit == "auto":
        unit = period_unit(df.where(as_col(ts).isNotNull()).count())
    return df.where(as_col(ts).isNotNull()).groupBy(period_label(as_col(ts), unit).alias("period")).agg(
        aggregate(agg, as_col(y)).alias("value"), F.count(F.lit(1)).alias("n"))


def scatter_grid(df: DataFrame, x: str, y: str, size: str | None = None, cells: int = 30) -> DataFrame:
    """Scatter/bubble reduced to a grid: cell, count, mean position (and mean size) over all rows."""
    _, x0, x1 = value_range(df, x)
    _, y0, y1 = value_range(df, y)
    vx, vy = as_col(x).cast("double"), as_col(y).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(vx).alias("x"), F.avg(vy).alias("y")]
    if size:
        aggs.append(F.avg(as_col(size)).alias("size"))
    return df.where(vx.isNotNull() & vy.isNotNull()).groupBy(
        bin_of(vx, x0, x1, cells).alias("cell_x"), bin_of(vy, y0, y1, cells).alias("cell_y")).agg(*aggs)


def line_thinning(df: DataFrame, x: str, y: str, points: int = 1000) -> DataFrame:
    """A long line as at most `points` buckets of x with the range and last value in each."""
    _, lo, hi = value_range(df, x)
    vx, vy = as_col(x).cast("double"), as_col(y).cast("double")
    return df.where(vx.isNotNull() & vy.isNotNull()).groupBy(bin_of(vx, lo, hi, points).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min(vy).alias("y_min"), F.max(vy).alias("y_max"),
        F.max_by(vy, vx).alias("y_last"), F.max(vx).alias("x_last"))


def choose_chart(x_kind: str, y_kind: str | None = None, x_levels: int = 0, y_levels: int = 0) -> str:
    """Chart family for one or two columns, from their kinds and numbers of levels."""
    if y_kind is None:
        if x_kind == "numeric":
            return "histogram"
        return "line" if x_kind == "temporal" else ("pie" if x_levels <= 6 else "bar")
    kinds = {x_kind, y_kind}
    if x_kind == "temporal" or y_kind == "temporal":
        return "line"
    if kinds == {"numeric"}:
        return "scatter"
    if kinds == {"categorical"}:
        return "heatmap"
    levels = x_levels if x_kind == "categorical" else y_levels
    return "box" if levels <= 12 else "bar"


def qq_points(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """Standardised sample quantiles against normal quantiles on an even grid of probabilities."""
    probs = [(i + 0.5) / points for i in range(points)]
    q = exact_quantiles(df, [col], probs)[col]
    m, s = df.agg(F.avg(as_col(col)), F.stddev_samp(as_col(col))).first()
    rows = [(i, probs[i], norm_ppf(probs[i]), (q[i] - m) / s if s else None) for i in range(points)]
    return local_rows(df.sparkSession, rows, "point int, p double, normal double, sample double")


def kernel_density(df: DataFrame, col: str, points: int = 100, bins: int = 512) -> DataFrame:
    """Gaussian density (Silverman bandwidth) on a grid from a fine histogram, with the normal curve.

    Work after the histogram is bins x points, whatever the rows.
    """
    n, lo, hi = value_range(df, col)
    mean, sd = df.agg(F.avg(as_col(col)), F.stddev_samp(as_col(col))).first()
    h = 1.06 * sd * n ** (-0.2)
    width = (hi - lo) / bins
    step = (hi - lo) / (points - 1)
    fine = df.where(as_col(col).isNotNull()).groupBy(bin_of(as_col(col).cast("double"), lo, hi, bins).alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    root = 2.5066282746310002
    spread = fine.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.lit(lo) + F.col("point") * F.lit(step)
    u = (x - (F.lit(lo) + (F.col("b") + 0.5) * width)) / h
    dens = spread.groupBy("point").agg(F.sum(F.col("n") * F.exp(-u * u / 2)).alias("s"))
    z = (x - mean) / sd
    return dens.select("point", x.alias("x"), (F.col("s") / (n * h * root)).alias("density"),
                       (F.exp(-z * z / 2) / (sd * root)).alias("normal"))


def suggest_charts(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One chart per column, from its kind (numeric, categorical, temporal) and exact number of levels."""
    from lodestat.functions.expr import local_rows, melt
    cats = [c for c, k in kinds.items() if k == "categorical"]
    levels = {}
    if cats:
        counts = melt(df, cats, cast="string").where("value IS NOT NULL").distinct().groupBy("column").count()
        levels = {r["column"]: r["count"] for r in counts.collect()}  # one row per column
    return local_rows(df.sparkSession, [(c, k, choose_chart(k, x_levels=levels.get(c, 0))) for c, k in kinds.items()],
                      "column string, kind string, chart string")
