"""Hypothesis tests. Statistics come from group moments, ranks or counted cells; only those reach a formula."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.functions.dist import p_chi2, p_f, p_norm, p_studentized_range, p_t
from lodestat.functions.expr import local_rows, as_col, join_null_safe, numeric_columns, ratio
from lodestat.operators import describe
from lodestat.operators.correlate import pearson_pairs, spearman_pairs, strength, with_p
from lodestat.operators.ordering import running_total, value_ranks, with_position
from lodestat.operators.quantiles import quantiles_by


def _label(v: Column, cuts: Sequence[tuple[float, str]], top: str) -> Column:
    out = F.when(v.isNull(), None)
    for limit, word in cuts:
        out = out.when(F.abs(v) < limit, word)
    return out.otherwise(top)


def cohen_label(d: Column) -> Column:
    return _label(d, [(.2, "negligible"), (.5, "small"), (.8, "medium")], "large")


def eta_label(e: Column) -> Column:
    return _label(e, [(.01, "negligible"), (.06, "small"), (.14, "medium")], "large")


def cramer_label(v: Column) -> Column:
    return _label(v, [(.1, "negligible"), (.3, "weak"), (.5, "moderate")], "strong")


def group_moments(df: DataFrame, group: str, value: str, fewest: int = 2) -> DataFrame:
    """(g, n, mean, variance, skewness) per group with at least `fewest` values."""
    v = as_col(value).cast("double")
    return df.where(as_col(group).isNotNull() & v.isNotNull()).groupBy(as_col(group).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"),
        F.skewness(v).alias("skewness")).where(F.col("n") >= fewest)


def two_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row with both groups' moments, in sorted order of the group values."""
    m = group_moments(df, group, value)
    return m.agg(F.count(F.lit(1)).alias("groups"), *[
        pick(c, "g").cast("double" if c != "n" else "long").alias(f"{c}{i}")
        for i, pick in ((1, F.min_by), (2, F.max_by)) for c in ("n", "mean", "variance")],
        F.min("g").cast("string").alias("group1"), F.max("g").cast("string").alias("group2"))


def _pooled() -> Column:
    n1, n2 = F.col("n1"), F.col("n2")
    return ((n1 - 1) * F.col("variance1") + (n2 - 1) * F.col("variance2")) / (n1 + n2 - 2)


def t_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """Student and Welch statistics with degrees of freedom, and Cohen's d, for two groups."""
    a, b = F.col("variance1") / F.col("n1"), F.col("variance2") / F.col("n2")
    diff = F.col("mean1") - F.col("mean2")
    d = ratio(diff, F.sqrt(_pooled()))
    return two_groups(df, group, value).where("groups = 2").select(
        "group1", "group2", "n1", "n2", diff.alias("difference"),
        ratio(diff, F.sqrt(_pooled() * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t_student"),
        (F.col("n1") + F.col("n2") - 2).cast("double").alias("df_student"),
        ratio(diff, F.sqrt(a + b)).alias("t_welch"),
        ratio((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1)).alias("df_welch"),
        d.alias("cohen_d"), cohen_label(d).alias("magnitude"))


def one_way(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: F and eta squared."""
    v = as_col(value).cast("double")
    m = group_moments(df, group, value)
    centre = m.agg(ratio(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).first()[0]
    s = m.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
              F.sum(F.col("n") * (F.col("mean") - F.lit(centre)) * (F.col("mean") - F.lit(centre))).alias("ss_between"),
              F.sum((F.col("n") - 1) * F.col("variance")).alias("ss_within"))
    k, n = F.col("groups"), F.col("n")
    eta = ratio(F.col("ss_between"), F.col("ss_between") + F.col("ss_within"))
    return s.where("groups >= 2").select(
        "groups", "n", "ss_between", "ss_within", (k - 1).cast("double").alias("df_between"), (n - k).cast("double").alias("df_within"),
        ratio(F.col("ss_between") / (k - 1), ratio(F.col("ss_within"), n - k)).alias("f"),
        eta.alias("eta_squared"), eta_label(eta).alias("magnitude"))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median-centred Levene: a one-way analysis of absolute deviations from group medians."""
    data = df.where(as_col(group).isNotNull() & as_col(value).isNotNull()).select(as_col(group).alias("g"), as_col(value).cast("double").alias("v"))
    medians = quantiles_by(data, ["g"], "v", [.5], ["median"])
    dev = data.join(medians, "g").select("g", F.abs(F.col("v") - F.col("median")).alias("deviation"))
    return one_way(dev, "g", "deviation").select("groups", "n", F.col("f").alias("w"), "df_between", "df_within")


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """U of the first group (sorted), tie-corrected z with continuity, rank-biserial r."""
    data = df.where(as_col(group).isNotNull() & as_col(value).isNotNull())
    first, last, kinds = data.agg(F.min(as_col(group)), F.max(as_col(group)), F.count_distinct(as_col(group))).first()
    if kinds != 2:
        raise ValueError(f"two groups needed, found {kinds}")
    counts = data.groupBy(as_col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(as_col(group) == F.lit(first)).alias("n1"))
    ranked = running_total(counts, {"upto": "n"}, ["v"])
    n = F.col("n").cast("double")
    rank = F.col("upto") - n + (n + 1) / 2
    s = ranked.agg(F.sum("n1").cast("double").alias("n1"), (F.sum("n") - F.sum("n1")).cast("double").alias("n2"),
                   F.sum(F.col("n1") * rank).alias("r1"), F.sum(n * n * n - n).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    total = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    top = F.greatest(u, n1 * n2 - u)
    return s.select(F.lit(str(first)).alias("group1"), F.lit(str(last)).alias("group2"), n1.cast("long").alias("n1"), n2.cast("long").alias("n2"),
                    u.alias("u"), ratio(top - n1 * n2 / 2 - 0.5, sd).alias("z"), (1 - 2 * u / (n1 * n2)).alias("r"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """Tie-corrected H and its eta squared."""
    data = df.where(as_col(group).isNotNull() & as_col(value).isNotNull()).select(as_col(group).alias("g"), as_col(value).alias("v"))
    cells = data.groupBy("v", "g").agg(F.count(F.lit(1)).alias("c"))
    ranks = value_ranks(data, "v").select("v", "n", "avg_rank")
    per = cells.join(ranks.select("v", "avg_rank"), "v").groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("avg_rank")).alias("r"))
    n = F.col("n").cast("double")
    ties = ranks.agg(F.sum(n * n * n - n)).first()[0] or 0.0
    s = per.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.lit(ties) / (n * n * n - n))
    return s.select("groups", n.cast("long").alias("n"), h.alias("h"), (F.col("groups") - 1).cast("double").alias("df"),
                    ((h - F.col("groups") + 1) / (n - F.col("groups"))).alias("eta_squared_h"))


# ---------------------------------------------------------------- normality

def skew_z(n: Column, g1: Column) -> Column:
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    a = F.sqrt(2 / (w2 - 1))
    return F.asinh(y / a) / F.sqrt(0.5 * F.log(w2))


def kurtosis_z(n: Column, g2: Column) -> Column:
    expected = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - expected) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    down = 1 + x * F.sqrt(2 / (a - 4))
    return (1 - 2 / (9 * a) - F.signum(down) * F.cbrt((1 - 2 / a) / F.abs(down))) / F.sqrt(2 / (9 * a))


def normality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D'Agostino K2 and Jarque-Bera from moments at any size; null under 8 rows or without variation."""
    t = describe.moment_table(df, cols)
    n = F.col("n").cast("double")
    ok = (n >= 8) & (F.col("max") > F.col("min"))
    safe = F.when(ok, n)
    zs, zk = skew_z(safe, F.col("g1")), kurtosis_z(safe, F.col("g2"))
    return t.select("column", F.col("n").alias("n"), (zs * zs + zk * zk).alias("k2"),
                    F.when(ok, n / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)).alias("jarque_bera"))


def normality_p(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return normality(df, cols).withColumn("p_k2", p_chi2(F.col("k2"), F.lit(2.0))).withColumn(
        "p_jarque_bera", p_chi2(F.col("jarque_bera"), F.lit(2.0))).withColumn("normal", F.col("p_k2") > 0.05)


def kolmogorov_smirnov(df: DataFrame, col: str) -> DataFrame:
    """Largest gap between the sample distribution and the normal with its mean and spread (distinct values ranked)."""
    v = as_col(col).cast("double")
    n, m, s = df.agg(F.count(v), F.avg(v), F.stddev_pop(v)).first()
    ranked = value_ranks(df.select(v.alias("v")), "v")
    cdf = dist._columns(1, dist.norm_cdf)((F.col("v") - m) / s)
    gap = F.greatest(F.abs((F.col("below") + F.col("n")) / n - F.col("c")), F.abs(F.col("c") - F.col("below") / n))
    d = ranked.withColumn("c", cdf).agg(F.max(gap).alias("d"))

    def tail(x: float) -> float:
        lam = x * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)))) if lam > 0.2 else 1.0

    return d.select(F.lit(col).alias("column"), F.lit(n).alias("n"), "d", dist._columns(1, tail)(F.col("d")).alias("p"))


# ---------------------------------------------------------------- selection

def groups_look_normal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: skewness under 2 suffices from 50 rows on; smaller groups must pass Jarque-Bera at 5 %."""
    v = as_col(value).cast("double")
    m = df.where(as_col(group).isNotNull() & v.isNotNull()).groupBy(as_col(group).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k")).where("n >= 2")
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    return m.select("g", "n", F.coalesce(F.when(F.col("n") >= 50, F.abs("s") < 2).otherwise(jb < 5.991464547107979), F.lit(False)).alias("normal"))


def compare_means(df: DataFrame, group: str, value: str) -> DataFrame:
    """Choose among Student, Welch, Mann-Whitney, analysis of variance and Kruskal-Wallis; one result row."""
    look = groups_look_normal(df, group, value).agg(F.count(F.lit(1)).alias("groups"), F.min(F.col("normal").cast("int")).alias("normal")).first()
    normal = bool(look["normal"])
    if look["groups"] < 2:
        raise ValueError("at least two groups of two values are needed")
    if look["groups"] == 2 and normal:
        lv = levene(df, group, value).first()
        equal = dist.f_sf(lv["w"], lv["df_between"], lv["df_within"]) > 0.05
        kind = "student" if equal else "welch"
        out = t_test(df, group, value).select(F.lit(kind).alias("test"), F.col(f"t_{kind}").alias("statistic"),
                                              p_t(F.col(f"t_{kind}"), F.col(f"df_{kind}")).alias("p"), F.col("cohen_d").alias("effect"))
    elif look["groups"] == 2:
        out = mann_whitney(df, group, value).select(F.lit("mann_whitney").alias("test"), F.col("u").alias("statistic"), p_norm(F.col("z")).alias("p"), F.col("r").alias("effect"))
    elif normal:
        out = one_way(df, group, value).select(F.lit("anova").alias("test"), F.col("f").alias("statistic"),
                                               p_f(F.col("f"), F.col("df_between"), F.col("df_within")).alias("p"), F.col("eta_squared").alias("effect"))
    else:
        out = kruskal_wallis(df, group, value).select(F.lit("kruskal_wallis").alias("test"), F.col("h").alias("statistic"),
                                                      p_chi2(F.col("h"), F.col("df")).alias("p"), F.col("eta_squared_h").alias("effect"))
    return out.withColumn("significant", F.col("p") < 0.05).withColumn("normality_assumed", F.lit(normal))


def correlation_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson when both columns look normal, else Spearman."""
    both = df.where(as_col(a).isNotNull() & as_col(b).isNotNull())
    looks = [r["p_k2"] is not None and r["p_k2"] > 0.05 for r in normality_p(both, [a, b]).collect()]
    kind = "pearson" if all(looks) else "spearman"
    pairs = pearson_pairs(both, [a, b]) if kind == "pearson" else spearman_pairs(both, [a, b])
    return with_p(pairs).withColumn("test", F.lit(kind))


def independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square with continuity correction on 2 x 2 tables, Fisher's p when such a table is sparse."""
    data = df.where(as_col(a).isNotNull() & as_col(b).isNotNull()).select(as_col(a).alias("a"), as_col(b).alias("b"))
    cells = data.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("c"))
    r = rows.agg(F.count(F.lit(1)).alias("k"), F.min("r").alias("low"), F.sum("r").alias("n"), F.max("a").alias("top")).first()
    c = cols.agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("low"), F.max("b").alias("top")).first()
    n = r["n"] or 0.0
    dof = (r["k"] - 1) * (c["k"] - 1)
    if dof < 1:
        raise ValueError("independence needs at least two levels on both sides")
    low = r["low"] * c["low"] / n
    fisher = None
    if dof == 1:
        q = {(x["i"], x["j"]): x["o"] for x in cells.select((F.col("a") == F.lit(r["top"])).alias("i"), (F.col("b") == F.lit(c["top"])).alias("j"), "o").collect()}
        t = [[q.get((i, j), 0.0) for j in (False, True)] for i in (False, True)]
        r1, r2, c1, c2 = sum(t[0]), sum(t[1]), t[0][0] + t[1][0], t[0][1] + t[1][1]
        gap = abs(t[0][0] * t[1][1] - t[0][1] * t[1][0]) / n
        chi2 = (gap - min(0.5, gap)) ** 2 * n * (1 / (r1 * c1) + 1 / (r1 * c2) + 1 / (r2 * c1) + 1 / (r2 * c2))
        if low < 5:
            fisher = dist.fisher_exact_2x2(*(int(v) for v in (t[0][0], t[0][1], t[1][0], t[1][1])))
    else:
        # sum over all cells of (o-e)^2/e equals n * (sum over filled cells of o^2/(r c) - 1)
        s = cells.join(rows, "a").join(cols, "b").agg(F.sum((F.col("o") - F.col("r") * F.col("c") / n) * (F.col("o") - F.col("r") * F.col("c") / n)
                                                              / (F.col("r") * F.col("c") / n)).alias("x"), F.sum(F.col("r") * F.col("c") / n).alias("e")).first()
        chi2 = s["x"] + (n - s["e"])  # empty cells add their expected counts
    v = math.sqrt(chi2 / (n * min(r["k"] - 1, c["k"] - 1)))
    p = fisher if fisher is not None else dist.chi2_sf(chi2, dof)
    out = local_rows(df.sparkSession, [("fisher" if fisher is not None else "chi_square", float(chi2), int(dof), float(p), float(low), float(v))],
        "test string, statistic double, df long, p double, min_expected double, cramers_v double")
    return out.withColumn("magnitude", cramer_label(F.col("cramers_v")))


# ---------------------------------------------------------------- pairs of groups

def _group_pairs(m: DataFrame) -> DataFrame:
    """All unordered pairs of groups: each group is numbered and joined to the numbers after it."""
    numbered = with_position(m, ["g"], name="i")
    k = numbered.count()
    left = numbered.select(*[F.col(c).alias(f"{c}1") for c in m.columns], F.explode(
        F.when(F.col("i") < k - 1, F.sequence(F.col("i") + 1, F.lit(k - 1)))).alias("i"))
    right = numbered.select(*[F.col(c).alias(f"{c}2") for c in m.columns], "i")
    return left.join(right, "i").drop("i").withColumn("groups", F.lit(k))


def tukey_hsd(df: DataFrame, group: str, value: str) -> DataFrame:
    m = group_moments(df, group, value).select("g", "n", "mean", "variance")
    s = m.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum((F.col("n") - 1) * F.col("variance")).alias("w")).first()
    dof = float(s["n"] - s["k"])
    mse = s["w"] / dof
    diff = F.col("mean2") - F.col("mean1")
    se = F.sqrt(F.lit(mse / 2) * (1 / F.col("n1") + 1 / F.col("n2")))
    return _group_pairs(m).select(F.col("g1").cast("string").alias("group1"), F.col("g2").cast("string").alias("group2"), diff.alias("difference"),
                                  ratio(F.abs(diff), se).alias("q"), se.alias("se"), "groups", F.lit(dof).alias("df"),
                                  ratio(-diff, F.sqrt(_pooled())).alias("cohen_d"))


def tukey_hsd_p(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    out = tukey_hsd(df, group, value)
    first = out.select("groups", "df").first()
    crit = dist.studentized_range_ppf(1 - alpha, first["groups"], first["df"]) if first else 0.0
    return out.withColumn("p", p_studentized_range(F.col("q"), F.col("groups"), F.col("df"))).withColumn(
        "ci_low", F.col("difference") - crit * F.col("se")).withColumn("ci_high", F.col("difference") + crit * F.col("se"))


def games_howell(df: DataFrame, group: str, value: str) -> DataFrame:
    m = group_moments(df, group, value).select("g", "n", "mean", "variance")
    a, b = F.col("variance1") / F.col("n1"), F.col("variance2") / F.col("n2")
    diff = F.col("mean1") - F.col("mean2")
    return _group_pairs(m).where(a + b > 0).select(
        F.col("g1").cast("string").alias("group1"), F.col("g2").cast("string").alias("group2"), diff.alias("difference"),
        (F.abs(diff) / F.sqrt(a + b) * math.sqrt(2)).alias("q"), "groups",
        ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("df"),
        ratio(diff, F.sqrt(_pooled())).alias("cohen_d"))


def games_howell_p(df: DataFrame, group: str, value: str) -> DataFrame:
    return games_howell(df, group, value).withColumn("p", p_studentized_range(F.col("q"), F.col("groups"), F.col("df")))


def post_hoc(df: DataFrame, group: str, value: str) -> DataFrame:
    """Tukey where variances are comparable (Levene at 5 %), else Games-Howell; smallest p first."""
    lv = levene(df, group, value).first()
    equal = dist.f_sf(lv["w"], lv["df_between"], lv["df_within"]) >= 0.05
    out = tukey_hsd_p(df, group, value) if equal else games_howell_p(df, group, value)
    return out.select(F.lit("tukey_hsd" if equal else "games_howell").alias("test"), "group1", "group2", "difference", "q", "p", "cohen_d").orderBy("p", "group1", "group2")


# ---------------------------------------------------------------- equivalence and power

def equivalence(df: DataFrame, group: str, value: str, margin: float | None = None) -> DataFrame:
    """Two one-sided tests against a margin (0.2 pooled deviations by default)."""
    m = F.lit(float(margin)) if margin else 0.2 * F.sqrt(_pooled())
    diff = F.col("mean1") - F.col("mean2")
    se = F.sqrt(_pooled() * (1 / F.col("n1") + 1 / F.col("n2")))
    return two_groups(df, group, value).where("groups = 2").select(
        "group1", "group2", diff.alias("difference"), m.alias("margin"), se.alias("se"), (F.col("n1") + F.col("n2") - 2).cast("double").alias("df"),
        ((diff + m) / se).alias("t_low"), ((diff - m) / se).alias("t_high"))


def equivalence_p(df: DataFrame, group: str, value: str, margin: float | None = None, alpha: float = 0.05) -> DataFrame:
    out = equivalence(df, group, value, margin)
    crit = dist.t_critical(1 - 2 * alpha, F.col("df"))
    p = F.greatest(dist.p_t_upper(F.col("t_low"), F.col("df")), dist.p_t_upper(-F.col("t_high"), F.col("df")))
    return out.withColumn("p", p).withColumn("equivalent", F.col("p") < alpha).withColumn(
        "ci_low", F.col("difference") - crit * F.col("se")).withColumn("ci_high", F.col("difference") + crit * F.col("se"))


def power_two_groups(df: DataFrame, group: str, value: str, wanted: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """Power at the observed effect, smallest detectable effect, and rows per group needed."""
    r = two_groups(df, group, value).withColumn("sp", F.sqrt(_pooled())).first()
    if r["groups"] != 2 or not r["sp"]:
        raise ValueError("two groups with variation are needed")
    n1, n2, d = r["n1"], r["n2"], (r["mean1"] - r["mean2"]) / r["sp"]

    def power(effect: float, a: float, b: float) -> float:
        dof = a + b - 2
        crit, shift = dist.t_ppf(1 - alpha / 2, dof), effect * math.sqrt(a * b / (a + b))
        return 1 - dist.nct_cdf(crit, dof, shift) + dist.nct_cdf(-crit, dof, shift)

    smallest = dist._bisect(lambda e: power(e, n1, n2), wanted, 1e-9, 50.0)
    size = abs(d) or 0.01
    need = dist._bisect(lambda n: power(size, n, n * n2 / n1), wanted, 2.0, 1e10)
    return local_rows(df.sparkSession, [(r["group1"], r["group2"], int(n1), int(n2), float(d), float(power(abs(d), n1, n2)), float(smallest), float(smallest * r["sp"]), float(math.ceil(need)))],
        "group1 string, group2 string, n1 long, n2 long, observed_d double, power double, detectable_d double, detectable_units double, rows_needed double")


# ---------------------------------------------------------------- many tests

def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "test", alpha: float = 0.05, **kw) -> DataFrame:
    """q-values: running minimum of p m / rank from the largest p down; rows without p keep a null q."""
    has = tests.where(as_col(p).isNotNull())
    ranked = running_total(has, {"__rank": F.lit(1)}, [p, key], **kw)
    m = has.count()
    q = running_total(ranked.withColumn("__raw", as_col(p) * m / F.col("__rank")), {"q": "__raw"}, [p, key], how="min", forward=False, **kw)
    done = q.drop("__rank", "__raw").withColumn("q", F.least(F.lit(1.0), F.col("q"))).withColumn("rejected", F.col("q") <= alpha)
    rest = tests.where(as_col(p).isNull()).withColumn("q", F.lit(None).cast("double")).withColumn("rejected", F.lit(None).cast("boolean"))
    return done.unionByName(rest)


def bonferroni(tests: DataFrame, by: Sequence[str], p: str = "p") -> DataFrame:
    """Smallest p of each family times its number of tests, at most 1."""
    return tests.groupBy(*[as_col(b) for b in by]).agg(F.count(as_col(p)).alias("tests"), F.min(as_col(p)).alias("p_min")).withColumn(
        "p_corrected", F.least(F.lit(1.0), F.col("p_min") * F.col("tests")))


def assumption_checks(df: DataFrame, kind: str, group: str | None = None, value: str | None = None, a: str | None = None, b: str | None = None) -> DataFrame:
    """Statistics behind the assumptions of a test: (assumption, subject, statistic)."""
    if kind == "correlation":
        return normality(df, [a, b]).select(F.lit("normality").alias("assumption"), F.col("column").alias("subject"), F.col("k2").alias("statistic"))
    homogeneous = levene(df, group, value).select(F.lit("equal_variances").alias("assumption"), F.lit(value).alias("subject"), F.col("w").alias("statistic"))
    if kind == "means_comparison":
        normal = normality(df, [value]).select(F.lit("normality").alias("assumption"), F.col("column").alias("subject"), F.col("k2").alias("statistic"))
        return normal.unionByName(homogeneous)
    v = as_col(value).cast("double")
    m = df.where(as_col(group).isNotNull() & v.isNotNull()).groupBy(as_col(group).cast("string").alias("subject")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")).where("n >= 8")
    zs, zk = skew_z(F.col("n"), F.col("g1")), kurtosis_z(F.col("n"), F.col("g2"))
    return m.select(F.lit("normality").alias("assumption"), "subject", (zs * zs + zk * zk).alias("statistic")).unionByName(homogeneous)


def recommend_tests(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tests that suit two columns, from their kinds and group counts, best first."""
    from lodestat.operators.typing import column_types, evidence
    kinds = column_types(df, [a, b])
    number = {c: kinds[c] in ("continuous", "discrete") for c in (a, b)}
    if number[a] and number[b]:
        names = ["correlation_pearson", "correlation_spearman", "linear_regression"]
    elif number[a] or number[b]:
        other = b if number[a] else a
        levels = evidence(df, [other])[other]["d"]
        names = (["t_test", "mann_whitney"] if levels == 2 else ["anova", "kruskal_wallis", "post_hoc"]) if levels >= 2 else []
    else:
        names = ["chi_square", "fisher_if_sparse_2x2"]
    return local_rows(df.sparkSession, [(i + 1, n, a, b) for i, n in enumerate(names)], "priority int, test string, a string, b string")


def advisories(df: DataFrame) -> DataFrame:
    """Dataset warnings: (severity, topic, column, metric)."""
    nums = numeric_columns(df)
    miss = describe.missing_summary(df).collect()  # one row per column
    rows = miss[0]["rows"] if miss else 0
    out: list[tuple] = []
    if rows < 100:
        out.append(("critical" if rows < 30 else "warning", "sample_size", None, float(rows)))
    if nums and rows / len(nums) < 10:
        out.append(("warning", "dimensionality", None, rows / len(nums)))
    for m in miss:
        rate = m["null_rate"] or 0.0
        if rate > 0.3:
            out.append(("warning", "missing_data", m["column"], rate))
        if rate > 0.7:
            out.append(("critical", "nearly_empty", m["column"], rate))
        if m["constant"]:
            out.append(("info", "constant", m["column"], float(m["cardinality"])))
    dup = describe.duplicate_summary(df).first()
    if dup["duplicates"]:
        out.append(("critical" if dup["duplicate_ratio"] > 0.2 else "warning", "duplicates", None, dup["duplicate_ratio"]))
    if len(nums) >= 2:
        out += [("warning", "collinear", f"{r['a']}~{r['b']}", float(r["r"])) for r in pearson_pairs(df, nums).where(F.abs("r") > 0.9).collect()]
    if nums:
        m = describe.moment_table(df, nums).select("column", describe.adjusted_skew(F.col("g1"), F.col("n")).alias("s")).where(F.abs("s") > 2)
        out += [("info", "skewness", r["column"], float(r["s"])) for r in m.collect()]
    return local_rows(df.sparkSession, out, "severity string, topic string, column string, metric double")


def recommend_models(df: DataFrame, target: str) -> DataFrame:
    """Model families for the target's task, sized to rows and columns, best first."""
    from lodestat.operators.typing import problem_type
    kind = problem_type(df, target).first()["problem_type"]
    rows, cols = df.count(), max(1, len(df.columns) - 1)
    if kind == "exploration":
        names = []
    elif kind == "regression":
        names = [("linear_regression", "readable coefficients")]
        if rows / cols < 20:
            names.insert(0, ("ridge", "few rows per column"))
        if cols > 10:
            names.append(("lasso", "selects among many columns"))
        if rows >= 200:
            names += [("random_forest", "non-linear effects"), ("gradient_boosting", "accuracy on larger tables")]
    else:
        names = [("logistic_regression", "readable odds")]
        if rows >= 100:
            names.append(("decision_tree", "readable rules"))
        if rows >= 200:
            names += [("random_forest", "non-linear effects"), ("gradient_boosting", "accuracy on larger tables")]
    return local_rows(df.sparkSession, [(i + 1, kind, n, why) for i, (n, why) in enumerate(names)],
                                           "priority int, task string, model string, reason string")


def methodology_warnings(spark, tests: int = 0, test_rows: int | None = None, causal_claim: bool = False,
                         stationary: bool | None = None, significant: int = 0) -> DataFrame:
    out = []
    if causal_claim:
        out.append(("causality", "association in observed data does not show cause"))
    if tests > 1:
        out.append(("multiple_testing", f"{tests} tests: about {0.05 * tests:.1f} false alarms at 5 %; correct for it"))
    if test_rows is not None and test_rows < 30:
        out.append(("small_test_set", f"{test_rows} test rows give unstable scores"))
    if stationary is False:
        out.append(("non_stationary", "trending series correlate by chance; difference them first"))
    if significant and tests:
        out.append(("significance", "a small p says nothing about the size of an effect"))
    return local_rows(spark, out, "topic string, message string")
