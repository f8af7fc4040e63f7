"""Survival curves, log-rank test and proportional hazards from per-time counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.functions.expr import local_rows, as_col
from lodestat.operators.gram import complete, dot, gram, standardised
from lodestat.operators.ordering import running_total


def risk_table(df: DataFrame, time: str, event: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Events, censored and rows at risk at each time (a backward running count)."""
    t = as_col(time).cast("double")
    e = as_col(event).cast("int")
    per = df.where(t.isNotNull() & e.isNotNull()).groupBy(*[as_col(b) for b in by], t.alias("time")).agg(
        F.count_if(e == 1).alias("events"), F.count_if(e == 0).alias("censored"))
    return running_total(per, {"at_risk": F.col("events") + F.col("censored")}, ["time"], by, forward=False, **kw)


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Survival with Greenwood 95 % limits at each time; after everyone at risk has failed it is 0."""
    r = risk_table(df, time, event, by, **kw)
    n, d = F.col("at_risk").cast("double"), F.col("events").cast("double")
    alive = n > d
    out = running_total(r, {"__log": F.when(alive, F.log1p(-d / n)).otherwise(0.0), "__dead": F.when(alive, 0).otherwise(1).cast("long"),
                            "__green": F.when(alive, F.try_divide(d, n * (n - d))).otherwise(0.0)}, ["time"], by, **kw)
    s = F.when(F.col("__dead") > 0, 0.0).otherwise(F.exp("__log"))
    se = F.col("survival") * F.sqrt("__green")
    return out.withColumn("survival", s).withColumn("ci_low", F.greatest(F.lit(0.0), F.col("survival") - 1.96 * se)).withColumn(
        "ci_high", F.least(F.lit(1.0), F.col("survival") + 1.96 * se)).drop("__log", "__dead", "__green")


def median_survival(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*[as_col(b) for b in by]).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_time"),
                                                       F.sum("events").alias("events"), F.max("at_risk").alias("rows"))


def log_rank(df: DataFrame, time: str, event: str, group: str, **kw) -> DataFrame:
    """Mantel-Cox test of two groups (the first in sorted order is compared)."""
    data = df.where(as_col(group).isNotNull() & as_col(time).isNotNull() & as_col(event).isNotNull())
    first, last, kinds = data.agg(F.min(as_col(group)), F.max(as_col(group)), F.count_distinct(as_col(group))).first()
    if kinds != 2:
        raise ValueError(f"two groups needed, found {kinds}")
    one = as_col(group) == F.lit(first)
    e = as_col(event).cast("int") == 1
    per = data.groupBy(as_col(time).cast("double").alias("time")).agg(
        F.count_if(one).alias("r1"), F.count_if(~one).alias("r2"), F.count_if(one & e).alias("d1"), F.count_if(e).alias("d"))
    r = running_total(per, {"n1": "r1", "n2": "r2"}, ["time"], forward=False, **kw)
    n1, n2, d = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("d").cast("double")
    n = n1 + n2
    s = r.where((n > 1) & (d > 0)).agg(F.sum("d1").cast("double").alias("observed"), F.sum(n1 * d / n).alias("expected"),
                                       F.sum(n1 * n2 * d * (n - d) / (n * n * (n - 1))).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    return s.where("variance > 0").select(F.lit(str(first)).alias("group1"), F.lit(str(last)).alias("group2"), "observed", "expected",
                                          (gap * gap / F.col("variance")).alias("chi2"))


def log_rank_p(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    return log_rank(df, time, event, group).withColumn("p", dist.p_chi2(F.col("chi2"), F.lit(1.0)))


def cox(df: DataFrame, time: str, event: str, xs: Sequence[str], rounds: int = 25) -> DataFrame:
    """Proportional hazards (Breslow ties) by Newton steps.

    Each step groups rows by time and takes backward running sums of the risk-weighted
    moments, so a step is two aggregates whatever the number of rows at risk.
    """
    data = complete(df, [time, event, *xs])
    g = gram(data, xs)
    cols, mean, sd = standardised(g, xs)
    z = cols[1:]
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    dead = as_col(event).cast("int") == 1
    beta, inv = np.zeros(k), np.eye(k)
    for _ in range(rounds):
        w = F.exp(dot(beta, z))
        per = data.groupBy(as_col(time).cast("double").alias("time")).agg(
            F.count_if(dead).cast("double").alias("d"), F.sum(w).alias("w"), *[F.sum(w * z[i]).alias(f"w{i}") for i in range(k)],
            *[F.sum(w * z[i] * z[j]).alias(f"w{i}_{j}") for i, j in pairs], *[F.sum(F.when(dead, z[i]).otherwise(0.0)).alias(f"e{i}") for i in range(k)])
        names = ["w", *[f"w{i}" for i in range(k)], *[f"w{i}_{j}" for i, j in pairs]]
        r = running_total(per, {f"S{n}": n for n in names}, ["time"], forward=False)
        d, s0 = F.col("d"), F.col("Sw")
        row = r.where("d > 0").agg(*[F.sum(F.col(f"e{i}") - d * F.col(f"Sw{i}") / s0).alias(f"u{i}") for i in range(k)],
                                   *[F.sum(d * (F.col(f"Sw{i}_{j}") / s0 - F.col(f"Sw{i}") * F.col(f"Sw{j}") / (s0 * s0))).alias(f"h{i}_{j}") for i, j in pairs]).first()
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
        inv = np.linalg.pinv(h, hermitian=True)
        step = inv @ np.array([row[f"u{i}"] or 0.0 for i in range(k)])
        step *= min(1.0, 2.0 / max(np.max(np.abs(step)), 1e-12))
        beta = beta + step
        if np.max(np.abs(step)) < 1e-8:
            break
    coef, cov = beta / sd, inv / np.outer(sd, sd)
    rows = []
    for n, b, s in zip(xs, coef, np.sqrt(np.diag(cov))):
        zz = b / s if s > 0 else 0.0
        rows.append((n, float(b), float(s), float(np.exp(b)), float(zz), 2 * dist.norm_sf(abs(zz)), float(np.exp(b - 1.96 * s)), float(np.exp(b + 1.96 * s))))
    return local_rows(df.sparkSession, rows, "variable string, coefficient double, std_error double, hazard_ratio double, z double, p double, hr_low double, hr_high double")
