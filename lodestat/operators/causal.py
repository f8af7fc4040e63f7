"""Difference in differences, instruments, and matching on a propensity score."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.functions.expr import local_rows, as_col, ratio
from lodestat.operators.charts import bin_of
from lodestat.operators.glm import _glm
from lodestat.operators.gram import complete, gram, ols
from lodestat.operators.linear import COEF_SCHEMA, coefficient_rows
from lodestat.operators.ordering import fill_order


def did_cells(df: DataFrame, y: str, treated: Column, post: Column) -> DataFrame:
    """Four cell means and the difference in differences, one row."""
    v = as_col(y).cast("double")

    def mean(a: int, b: int) -> Column:
        return F.avg(F.when((treated.cast("int") == a) & (post.cast("int") == b), v))

    s = df.agg(mean(1, 1).alias("treated_post"), mean(1, 0).alias("treated_pre"), mean(0, 1).alias("control_post"), mean(0, 0).alias("control_pre"))
    return s.withColumn("effect", F.col("treated_post") - F.col("treated_pre") - F.col("control_post") + F.col("control_pre"))


def did_regression(df: DataFrame, y: str, treated: Column, post: Column) -> DataFrame:
    wide = df.select(as_col(y).alias("__y"), treated.cast("double").alias("treated"), post.cast("double").alias("post")).withColumn(
        "treated_x_post", F.col("treated") * F.col("post"))
    xs = ["treated", "post", "treated_x_post"]
    fit = ols(gram(wide, [*xs, "__y"]), "__y", xs)
    return local_rows(df.sparkSession, coefficient_rows(fit.names, fit.coef, fit.se, fit.df_resid), COEF_SCHEMA)


def two_stage(df: DataFrame, y: str, endogenous: str, instrument: str) -> DataFrame:
    """Instrumented slope with its error, first-stage F, and the least-squares slope beside it."""
    g = gram(df, [endogenous, instrument, y])
    sxx, sxz, sxy = g.cross[0]
    szz, szy, syy = g.cross[1, 1], g.cross[1, 2], g.cross[2, 2]
    b = szy / sxz
    rss = syy - 2 * b * sxy + b * b * sxx
    se = math.sqrt(rss / (g.n - 2) * szz / sxz ** 2)
    r2 = sxz ** 2 / (sxx * szz)
    f = r2 / (1 - r2) * (g.n - 2) if r2 < 1 else float("inf")
    naive = sxy / sxx
    t = b / se
    return local_rows(df.sparkSession, [(int(g.n), float(g.mean[2] - b * g.mean[0]), float(b), se, t, dist.t_two_sided(t, g.n - 2), float(f), f < 10, float(naive), float(b - naive))],
        "n long, intercept double, coefficient double, std_error double, t double, p double, first_stage_f double, weak boolean, ols double, gap double")


def standardised_difference(df: DataFrame, arm: Column, covariates: Sequence[str]) -> DataFrame:
    """Mean difference over the pooled deviation of the two arms, per covariate."""
    rows = []
    aggs = []
    for i, c in enumerate(covariates):
        v = as_col(c).cast("double")
        for a in (1, 0):
            x = F.when(arm.cast("int") == a, v)
            aggs += [F.avg(x).alias(f"m{i}_{a}"), F.var_samp(x).alias(f"v{i}_{a}")]
        pooled = F.sqrt(F.greatest(F.lit(1e-8), (F.col(f"v{i}_1") + F.col(f"v{i}_0")) / 2))
        rows.append(F.struct(F.lit(c).alias("covariate"), ((F.col(f"m{i}_1") - F.col(f"m{i}_0")) / pooled).alias("smd")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("balanced", F.abs("smd") < 0.1)


def with_propensity(df: DataFrame, treatment: str, covariates: Sequence[str], name: str = "propensity") -> DataFrame:
    """Logistic score fitted on all rows and added as an expression."""
    model, _ = _glm(df, treatment, covariates, "binomial", "logit")
    eta = F.lit(float(model.intercept))
    for b, c in zip(model.coefficients, covariates):
        eta = eta + F.lit(float(b)) * as_col(c).cast("double")
    return complete(df, [treatment, *covariates]).withColumn(name, 1 / (1 + F.exp(-eta)))


def match_nearest(df: DataFrame, treatment: str, score: str, key: str, carry: Sequence[str], caliper: float | None, **kw) -> DataFrame:
    """Nearest control of every treated row on the score, with replacement.

    Along the score order the nearest control is the last one before or the first one
    after, so two carry passes replace a search. Equal distances take the earlier one.
    """
    is_control = as_col(treatment).cast("int") == 0
    me = F.struct(as_col(score).alias("score"), as_col(key).alias("key"), *[as_col(c).alias(c) for c in carry])
    work = df.withColumn("__c", F.when(is_control, me))
    order = [score, key]
    near = fill_order(fill_order(work, ["__c"], order, forward=True, prefix="__prev", **kw), ["__c"], order, forward=False, prefix="__next", **kw)
    s = as_col(score)
    before, after = s - F.col("__prev__c.score"), F.col("__next__c.score") - s
    pick = F.when(F.col("__next__c").isNull() | (before <= after), F.col("__prev__c")).otherwise(F.col("__next__c"))
    out = near.where(~is_control).withColumn("control", F.coalesce(pick, F.col("__next__c"))).drop("__c", "__prev__c", "__next__c")
    out = out.withColumn("distance", F.abs(s - F.col("control.score")))
    return out if caliper is None else out.where(F.col("distance") <= caliper)


def propensity_matching(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str], key: str, caliper: float = 0.2) -> DataFrame:
    """Matched pairs: treated row, its control and the outcome difference."""
    scored = with_propensity(df.where(as_col(outcome).isNotNull()), treatment, covariates)
    sd = scored.agg(F.stddev_pop("propensity")).first()[0] or 1.0
    pairs = match_nearest(scored, treatment, "propensity", key, [outcome, *covariates], caliper * sd)
    return pairs.withColumn("difference", as_col(outcome).cast("double") - F.col(f"control.{outcome}").cast("double"))


def matching_effect(pairs: DataFrame) -> DataFrame:
    """Average effect on the treated, its error, t and interval."""
    s = pairs.agg(F.count("difference").alias("pairs"), F.avg("difference").alias("att"),
                  (F.stddev_samp("difference") / F.sqrt(F.count("difference").cast("double"))).alias("std_error"))
    t = ratio(F.col("att"), F.col("std_error"))
    return s.select("pairs", "att", "std_error", t.alias("t"), dist.p_t(t, F.col("pairs") - 1).alias("p"),
                    (F.col("att") - 1.96 * F.col("std_error")).alias("ci_low"), (F.col("att") + 1.96 * F.col("std_error")).alias("ci_high"))


def balance_table(df: DataFrame, pairs: DataFrame, treatment: str, covariates: Sequence[str]) -> DataFrame:
    """Standardised differences before and after matching."""
    both = pairs.select(F.lit(1).alias("arm"), *[as_col(c).alias(c) for c in covariates]).unionByName(
        pairs.select(F.lit(0).alias("arm"), *[F.col(f"control.{c}").alias(c) for c in covariates]))
    before = standardised_difference(df, as_col(treatment), covariates).select("covariate", F.col("smd").alias("smd_before"))
    after = standardised_difference(both, F.col("arm"), covariates).select("covariate", F.col("smd").alias("smd_after"), "balanced")
    return before.join(F.broadcast(after), "covariate")  # one row per covariate


def common_support(df: DataFrame, treatment: str, score: Column, bins: int = 15) -> DataFrame:
    arm = as_col(treatment).cast("int")
    return df.groupBy(bin_of(score, 0.0, 1.0, bins).alias("bin")).agg(F.count_if(arm == 1).alias("treated"), F.count_if(arm == 0).alias("control"))
