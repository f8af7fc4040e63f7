"""Correlation, collinearity and dependence between columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.dist import p_t
from lodestat.functions.expr import local_rows, as_col, numeric_columns, ratio, safe_corr
from lodestat.operators.gram import Gram, gram
from lodestat.operators.ordering import average_rank, running_total
from lodestat.operators.pivot_join import pivot_join
from lodestat.operators.quantiles import exact_quantiles
from lodestat.session import cut_lineage


def strength(r: Column) -> Column:
    a = F.abs(r)
    return (F.when(a.isNull(), None).when(a >= 0.8, "very strong").when(a >= 0.6, "strong")
            .when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("negligible"))


def t_of_r(r: Column, n: Column) -> Column:
    return ratio(r * F.sqrt(F.greatest(n - 2, F.lit(0))), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))


def _pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]], column=lambda c: as_col(c)) -> DataFrame:
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = column(a).cast("double"), column(b).cast("double")
        aggs += [safe_corr(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def pearson_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """All pairs in one aggregate, pairwise-complete: (a, b, n, r, t, strength)."""
    cols = list(cols or numeric_columns(df))
    out = _pair_rows(df, list(combinations(cols, 2)))
    return out.withColumn("t", t_of_r(F.col("r"), F.col("n"))).withColumn("strength", strength(F.col("r")))


def with_p(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p", p_t(F.col("t"), F.col("n") - 2))


def significant_pairs(df: DataFrame, cols: Sequence[str] | None = None, alpha: float = 0.05,
                      floor: float = 0.1) -> DataFrame:
    return with_p(pearson_pairs(df, cols)).where((F.col("p") < alpha) & (F.abs("r") > floor))


def spearman_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rank correlation of every pair over the rows where both are present."""
    cols = list(cols or numeric_columns(df))
    nulls = df.agg(*[F.count_if(as_col(c).isNull()).alias(c) for c in cols]).first()
    if not any(nulls):
        ranked = average_rank(df.select(*[as_col(c) for c in cols]), cols)
        out = _pair_rows(ranked, list(combinations(cols, 2)), lambda c: F.col(f"`{c}_rank`"))
    else:
        out = None
        for a, b in combinations(cols, 2):
            both = df.select(as_col(a), as_col(b)).where(as_col(a).isNotNull() & as_col(b).isNotNull())
            part = _pair_rows(average_rank(both, [a, b]), [(a, b)], lambda c: F.col(f"`{c}_rank`"))
            out = part if out is None else out.unionByName(part)
    return out.withColumn("t", t_of_r(F.col("r"), F.col("n"))).withColumn("strength", strength(F.col("r")))


def strong_pairs(df: DataFrame, cols: Sequence[str] | None = None, floor: float = 0.9) -> DataFrame:
    return pearson_pairs(df, cols).where(F.abs("r") >= floor).select("a", "b", "n", "r").orderBy(F.desc(F.abs("r")), "a", "b")


def temporal_trend(df: DataFrame, ts: str, cols: Sequence[str]) -> DataFrame:
    """Correlation of each column with time, and its direction beyond 0.3."""
    from lodestat.operators.ordering import order_number
    t = order_number(df, ts)
    rows = df.agg(*[safe_corr(t, as_col(c).cast("double")).alias(c) for c in cols]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), as_col(c).alias("r")) for c in cols])).alias("e")).select("e.*")
    return rows.withColumn("direction", F.when(F.col("r") > 0.3, "up").when(F.col("r") < -0.3, "down").otherwise("flat"))


def vif_values(g: Gram, cols: Sequence[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix; infinite for exact combinations of other columns."""
    block = g.sub(cols)
    usable = [c for c, v in zip(cols, np.diag(block.cross)) if v > 0]
    r = block.sub(usable).corr
    out = {c: float("nan") for c in cols}
    for i, c in enumerate(usable):
        others = [j for j in range(len(usable)) if j != i]
        if not others:
            out[c] = 1.0
            continue
        fit = r[i, others] @ np.linalg.pinv(r[np.ix_(others, others)], rcond=1e-12, hermitian=True) @ r[others, i]
        out[c] = float("inf") if 1 - fit < 1e-12 else float(1 / (1 - fit))
    return out


def vif(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    rows = [(c, v, "severe" if v > 10 else "moderate" if v > 5 else "low")
            for c, v in vif_values(gram(df, cols), cols).items()]
    return local_rows(df.sparkSession, rows, "column string, vif double, level string")


def quantile_bin(v: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges strictly below the value: 0 … len(edges)."""
    out = F.lit(0)
    for e in edges:
        out = out + (v > F.lit(float(e))).cast("int")
    return F.when(v.isNotNull(), out)


def inner_edges(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, list[float]]:
    q = exact_quantiles(df, cols, [(i + 1) / bins for i in range(bins - 1)])
    return {c: sorted({e for e in q[c] if e is not None}) for c in cols}


def mutual_information(df: DataFrame, target: str, cols: Sequence[str], bins: int = 10,
                       discrete_target: bool = False) -> DataFrame:
    """Plug-in mutual information (nats) of each column with the target over quantile bins.

    Normalised by the target's entropy when it is discrete, else by the largest value.
    """
    nums = set(numeric_columns(df))
    edges = inner_edges(df, [c for c in [*cols, target] if c in nums and not (c == target and discrete_target)], bins)

    def code(c: str) -> Column:
        return quantile_bin(as_col(c).cast("double"), edges[c]).cast("string") if c in edges else as_col(c).cast("string")

    long = df.select(code(target).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), code(c).alias("x")) for c in cols])).alias("e")).select("y", "e.*")
    cells = long.where("x IS NOT NULL AND y IS NOT NULL").groupBy("column", "x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    # MI = H(x) + H(y) - H(x, y), each from sums of n ln n, so no cell-to-margin join is needed

    def nlogn(*keys: str) -> DataFrame:
        g = cells.groupBy("column", *keys).agg(F.sum("n").alias("n")) if keys != ("x", "y") else cells
        return g.groupBy("column").agg(F.sum(F.col("n") * F.log("n")).alias("_".join(("s", *keys))), F.sum("n").alias("N"))

    t = nlogn("x", "y").join(nlogn("x").drop("N"), "column").join(nlogn("y").drop("N"), "column")
    n = F.col("N")
    t = t.select("column", n.cast("long").alias("n"),
                 F.greatest(F.lit(0.0), F.log(n) + (F.col("s_x_y") - F.col("s_x") - F.col("s_y")) / n).alias("mi"),
                 (F.log(n) - F.col("s_y") / n).alias("h"))
    if discrete_target:
        return t.select("column", "n", "mi", F.least(F.lit(1.0), F.coalesce(ratio(F.col("mi"), F.col("h")), F.lit(0.0))).alias("score"))
    top = F.max("mi").over(Window.partitionBy(F.lit(0)))
    return t.select("column", "n", "mi", F.coalesce(ratio(F.col("mi"), top), F.lit(0.0)).alias("score"))


def digamma(n: Column) -> Column:
    """Of whole numbers from 1: the recurrence up to 7 or more, then the asymptotic series (error below 1e-11)."""
    x = n.cast("double") + 6
    tail = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8) - 1 / (132 * x**10)
    return tail - sum((1 / (n + i) for i in range(6)), F.lit(0.0))


def within_reach(rows: DataFrame, key: str, value: str, reach: str) -> DataFrame:
    """How many values lie nearer than `reach` to each row's own, itself included: (key, n).

    Counts below either end come from running totals over values and ends in one order. A value within 1e-12 (relative) of an
    end counts as on it, so not as nearer; with reach 0 equal values count.
    """
    v, r = as_col(value), as_col(reach)
    rounding = 1e-12 * (F.abs(v) + r)
    ends = F.explode(F.array(
        F.struct(F.greatest(v + r - rounding, v + rounding).alias("at"), F.lit(0).alias("turn"), F.lit(1).alias("side")),
        F.struct(F.least(v - r + rounding, v - rounding).alias("at"), F.lit(2).alias("turn"), F.lit(-1).alias("side"))))
    asked = rows.select(as_col(key).alias("id"), ends.alias("e")).select("e.*", "id", F.lit(0).cast("long").alias("m"))
    values = rows.groupBy(v.alias("at")).agg(F.count(F.lit(1)).alias("m")).select(
        "at", F.lit(1).alias("turn"), F.lit(0).alias("side"), F.lit(None).cast(asked.schema["id"].dataType).alias("id"), "m")
    below = running_total(asked.unionByName(values), {"below": "m"}, ["at", "turn", "id"]).where("turn <> 1")
    return below.groupBy(F.col("id").alias(key)).agg(F.greatest(F.sum(F.col("below") * F.col("side")), F.lit(1)).alias("n"))


def mutual_information_neighbours(df: DataFrame, target: str, cols: Sequence[str], key: str, k: int = 3) -> DataFrame:
    """Mutual information (nats) of each numeric column with a numeric target by k-th neighbours, without bins: (column, n, mi, score).

    Both are divided by their standard deviation. For each row the distance to its k-th neighbour in the maximum norm of
    the pair gives a reach, within which the values of either column are counted; with N rows the estimate is
    psi(N) + psi(k) - mean(psi(n_x) + psi(n_y)), the row itself in both counts, and 0 where that is negative. Values are
    taken as they are: no noise is added to break ties. `key` is unique. Rows without either value (null, NaN or
    infinite) are left out; with k rows or fewer `mi` is null. `score` is relative to the largest.
    """
    parts = []
    for c in cols:
        x, y = as_col(c).cast("double"), as_col(target).cast("double")
        rows = df.select(as_col(key).alias("id"), x.alias("x"), y.alias("y")).where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
        n, sx, sy = rows.agg(F.count(F.lit(1)), F.stddev_samp("x"), F.stddev_samp("y")).first()
        if n <= k:
            parts.append(df.sparkSession.range(1).select(F.lit(c).alias("column"), F.lit(n).cast("long").alias("n"), F.lit(None).cast("double").alias("mi")))
            continue
        rows = cut_lineage(rows.select("id", (F.col("x") / (sx or 1.0)).alias("x"), (F.col("y") / (sy or 1.0)).alias("y")))
        near = pivot_join(rows, rows, ["x", "y"], "id", "id", k + 1, standardise=False, metric="maximum")
        reach = near.where(F.col("rank") == k + 1).select("id", F.col("distance").alias("reach"))
        known = cut_lineage(rows.join(reach, "id"))
        counts = within_reach(known, "id", "x", "reach").unionByName(within_reach(known, "id", "y", "reach"))
        mean = F.sum(digamma(F.col("n"))) / n
        parts.append(counts.agg((digamma(F.lit(n)) + digamma(F.lit(k)) - mean).alias("mi")).select(
            F.lit(c).alias("column"), F.lit(n).cast("long").alias("n"), F.greatest(F.lit(0.0), "mi").alias("mi")))
    t = parts[0]
    for part in parts[1:]:
        t = t.unionByName(part)
    top = F.max("mi").over(Window.partitionBy(F.lit(0)))  # one row a column
    return t.select("column", "n", "mi", F.coalesce(ratio(F.col("mi"), top), F.lit(0.0)).alias("score"))
