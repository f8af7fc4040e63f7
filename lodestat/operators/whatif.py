"""What-if scoring: scenarios, sensitivity, tornado, partial dependence, stress, noise.

A scorer maps {feature: Column} to a prediction Column. Because every scenario is then an
aggregate expression, a whole grid of scenarios is scored in one scan without copying rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, local_rows
from lodestat.operators.quantiles import exact_quantiles

Scorer = Callable[[dict[str, Column]], Column]


def linear_scorer(intercept: float, coef: dict[str, float]) -> Scorer:
    def score(values: dict[str, Column]) -> Column:
        out = F.lit(float(intercept))
        for c, b in coef.items():
            out = out + F.lit(float(b)) * values[c].cast("double")
        return out

    return score


def present(features: Sequence[str]) -> dict[str, Column]:
    return {c: as_col(c).cast("double") for c in features}


def change(df: DataFrame, col: str, kind: str, amount: float) -> Column:
    """set, shift_pct, multiply, add or set_quantile."""
    v = as_col(col).cast("double")
    if kind == "set":
        return F.lit(float(amount))
    if kind == "shift_pct":
        return v * (1 + amount / 100)
    if kind == "multiply":
        return v * float(amount)
    if kind == "add":
        return v + float(amount)
    if kind == "set_quantile":
        return F.lit(exact_quantiles(df, [col], [amount])[col][0])
    raise ValueError(f"unknown change {kind}")


def _summaries(df: DataFrame, named: Sequence[tuple[str, Column]]) -> DataFrame:
    """(scenario, n, mean, std, min, max) of several prediction columns in one aggregate."""
    aggs = [e.alias(f"{i}|{s}") for i, (_, p) in enumerate(named) for s, e in (
        ("n", F.count(p)), ("mean", F.avg(p)), ("std", F.stddev_samp(p)), ("min", F.min(p)), ("max", F.max(p)))]
    rows = [F.struct(F.lit(n).alias("scenario"), *[F.col(f"`{i}|{s}`").alias(s) for s in ("n", "mean", "std", "min", "max")]) for i, (n, _) in enumerate(named)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def run_scenarios(df: DataFrame, score: Scorer, features: Sequence[str], scenarios: dict[str, dict[str, tuple[str, float]]]) -> DataFrame:
    """Baseline and scenarios, each a set of {column: (change, amount)}."""
    base = present(features)
    named = [("baseline", score(base))]
    for name, edits in scenarios.items():
        named.append((name, score({**base, **{c: change(df, c, k, a) for c, (k, a) in edits.items()}})))
    return _summaries(df, named)


def preset_scenarios(df: DataFrame, score: Scorer, features: Sequence[str]) -> DataFrame:
    """All features at their 10th, 50th and 90th percentile."""
    q = exact_quantiles(df, features, [.1, .5, .9])
    base = present(features)
    named = [("baseline", score(base))]
    for i, name in enumerate(("p10", "p50", "p90")):
        named.append((name, score({c: F.lit(q[c][i]) for c in features})))
    return _summaries(df, named)


def compare_scenarios(results: DataFrame) -> DataFrame:
    """Difference and percentage from the baseline, and the spread over scenarios."""
    base = results.where("scenario = 'baseline'").first()["mean"]
    spread = results.agg(F.max("mean") - F.min("mean")).first()[0]
    return results.select("scenario", "mean", (F.col("mean") - F.lit(base)).alias("difference"),
                          (F.try_divide(F.col("mean") - F.lit(base), F.abs(F.lit(base))) * 100).alias("percent"), F.lit(spread).alias("spread"))


def sensitivity(df: DataFrame, score: Scorer, features: Sequence[str], col: str, reach_pct: float = 20.0, points: int = 20) -> DataFrame:
    """Mean prediction as one feature is scaled over a range, with the elasticity at each point."""
    base = present(features)
    shifts = [float(v) for v in np.linspace(-reach_pct, reach_pct, points)]
    row = df.agg(F.avg(score(base)).alias("b"), *[F.avg(score({**base, col: base[col] * (1 + s / 100)})).alias(f"p{i}") for i, s in enumerate(shifts)]).first()
    rows = [(i, s, row[f"p{i}"], (row[f"p{i}"] / row["b"] - 1) / (s / 100) if s and row["b"] else None) for i, s in enumerate(shifts)]
    return local_rows(df.sparkSession, rows, "point int, shift_pct double, mean double, elasticity double")


def tornado(df: DataFrame, score: Scorer, features: Sequence[str], sigmas: float = 1.0) -> DataFrame:
    """Mean prediction with one feature moved by its deviation either way, widest swing first."""
    base = present(features)
    sd = df.agg(*[F.stddev_samp(as_col(c)).alias(c) for c in features]).first()
    aggs = [F.avg(score(base)).alias("b")]
    for c in features:
        for tag, sign in (("lo", -1), ("hi", 1)):
            aggs.append(F.avg(score({**base, c: base[c] + F.lit(sign * sigmas * float(sd[c] or 0.0))})).alias(f"{tag}|{c}"))
    row = df.agg(*aggs).first()
    rows = sorted(((c, row[f"lo|{c}"], row[f"hi|{c}"], abs(row[f"hi|{c}"] - row[f"lo|{c}"]), row["b"]) for c in features), key=lambda r: -r[3])
    return local_rows(df.sparkSession, rows, "feature string, low double, high double, swing double, baseline double")


def partial_dependence(df: DataFrame, score: Scorer, features: Sequence[str], col: str, points: int = 30) -> DataFrame:
    """Mean prediction with one feature fixed along its range."""
    base = present(features)
    lo, hi = df.agg(F.min(as_col(col)).cast("double"), F.max(as_col(col)).cast("double")).first()
    grid = [float(v) for v in np.linspace(lo, hi, points)]
    row = df.agg(*[F.avg(score({**base, col: F.lit(g)})).alias(f"p{i}") for i, g in enumerate(grid)]).first()
    return local_rows(df.sparkSession, [(i, g, row[f"p{i}"]) for i, g in enumerate(grid)], "point int, value double, mean double")


def stress(df: DataFrame, score: Scorer, features: Sequence[str], shocks: Sequence[float] = (-2, -1, 1, 2)) -> DataFrame:
    """Impact of shocks in deviations of each feature."""
    base = present(features)
    sd = df.agg(*[F.stddev_samp(as_col(c)).alias(c) for c in features]).first()
    aggs = [F.avg(score(base)).alias("b")]
    aggs += [F.avg(score({**base, c: base[c] + F.lit(float(s) * float(sd[c] or 0.0))})).alias(f"{c}|{s}") for c in features for s in shocks]
    row = df.agg(*aggs).first()
    b = row["b"]
    rows = [(c, float(s), row[f"{c}|{s}"], (row[f"{c}|{s}"] - b) / abs(b) * 100 if b else None) for c in features for s in shocks]
    return local_rows(df.sparkSession, rows, "feature string, sigma double, mean double, impact_pct double")


def noise_scoring(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], features: Sequence[str], key: Sequence[str], noise: float = .05,
                  copies: int = 100, seed: int = 42) -> DataFrame:
    """Distribution of the mean prediction over noisy copies of the data.

    Copies are made and summed inside Arrow batches from a key hash, so what leaves a task is
    one row per copy.
    """
    sd = df.agg(*[F.stddev_samp(as_col(c)).alias(c) for c in features]).first()
    scale = np.array([float(sd[c] or 0.0) * noise for c in features])
    work = df.select(F.xxhash64(*[as_col(k) for k in key]).alias("h"), *[as_col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).na.drop()
    d = len(features)

    def normal(h: np.ndarray, copy: int) -> np.ndarray:
        """Standard normals from a 64-bit mix of (row hash, copy, feature)."""
        with np.errstate(over="ignore"):
            salt = (np.arange(2 * d, dtype=np.uint64) + np.uint64(1 + copy * 2 * d)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
            z = h.astype(np.uint64)[:, None] ^ salt[None, :]
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
        u = ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
        return np.sqrt(-2 * np.log(u[:, :d])) * np.cos(2 * np.pi * u[:, d:])

    def copy_sums(batches):
        s, n = np.zeros(copies), 0
        for pdf in batches:
            x = pdf[[f"x{i}" for i in range(d)]].to_numpy(float)
            h = pdf["h"].to_numpy(np.int64)
            n += len(pdf)
            for c in range(copies):
                s[c] += predict(x + normal(h, c) * scale).sum()
        yield pd.DataFrame({"copy": np.arange(copies), "s": s, "n": n})

    means = work.mapInPandas(copy_sums, "copy long, s double, n long").groupBy("copy").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return means.agg(F.count(F.lit(1)).alias("copies"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"),
                     *[F.percentile("mean", F.lit(p)).alias(f"p{int(p * 100):02d}") for p in (.05, .5, .95)])  # one row per copy
