"""A full analysis as an ordered list of named steps, its execution, and short readings of results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.functions.expr import as_col, local_rows, numeric_columns
from lodestat.operators import bootstrap, cleaning, correlate, describe, factor, forecast, hypothesis, linear, multivariate_ts, panel, stationarity, supervised
from lodestat.operators.typing import apply_schema, column_types, data_dictionary, detect_panel, problem_type
from lodestat.plans import diagnose as D


@dataclass
class Step:
    name: str
    why: str
    options: dict = field(default_factory=dict)


@dataclass
class TableFacts:
    rows: int
    kinds: dict[str, str]
    duplicate_ratio: float
    null_rate: float
    poor: list[str]
    panel: tuple[str, str] | None
    target: str | None
    task: str

    def of(self, *kinds: str) -> list[str]:
        return [c for c, k in self.kinds.items() if k in kinds]


def table_facts(df: DataFrame, target: str | None = None) -> TableFacts:
    kinds = column_types(df)
    miss = describe.missing_summary(df).collect()  # one row per column
    dup = describe.duplicate_summary(df).first()
    times = [c for c, k in kinds.items() if k == "temporal"]
    groups = [c for c, k in kinds.items() if k in ("nominal", "identifier", "discrete")]
    return TableFacts(dup["rows"], kinds, dup["duplicate_ratio"], sum(m["null_rate"] or 0 for m in miss) / max(1, len(miss)),
                      sorted(m["column"] for m in miss if (m["null_rate"] or 0) > 0.5 or m["near_constant"]),
                      detect_panel(df, times, groups) if times and groups else None, target,
                      problem_type(df, target).first()["problem_type"] if target else "exploration")


def build_recipe(f: TableFacts, integrated: Sequence[str] = (), wanted: Sequence[str] | None = None) -> list[Step]:
    """Steps the table supports, each with the fact that called for it."""
    nums, cats, times = [c for c in f.of("continuous", "discrete") if c != f.target], f.of("nominal", "ordinal", "binary"), f.of("temporal")
    steps = []
    actions = [a for a, on in (("duplicates", f.duplicate_ratio > .01), ("poor_columns", bool(f.poor)), ("impute", f.null_rate > .05)) if on]
    steps.append(Step("clean", "defects found" if actions else "integrity check", {"actions": actions}))
    steps.append(Step("describe", "overview of every column", {"intervals": f.rows < 1000}))
    if len(nums) >= 2:
        steps += [Step("correlate", f"{len(nums)} numeric columns"), Step("vif", "several numeric columns")]
    if len(nums) >= 3:
        steps.append(Step("components", "three or more numeric columns"))
    if f.target and f.task == "regression" and cats:
        steps.append(Step("compare_groups", "numeric target with groups", {"groups": cats}))
    horizon = min(24, max(5, int(f.rows * 0.2)))
    if f.panel:
        steps.append(Step("panel", "entity and time identify rows", {"entity": f.panel[0], "time": f.panel[1]}))
    elif times and nums:
        steps.append(Step("stationarity", "dated rows", {"time": times[0]}))
        steps.append(Step("forecast", "dated rows", {"time": times[0], "horizon": horizon}))
        if len(integrated) >= 2:
            steps.append(Step("cointegration", "two or more integrated series", {"time": times[0], "columns": list(integrated)}))
    if f.target and f.task == "regression" and nums:
        steps += [Step("regression", "numeric target"), Step("models", "numeric target")]
    elif f.target and f.task.endswith("classification"):
        steps.append(Step("models", "categorical target"))
    return [s for s in steps if wanted is None or s.name in wanted]


def recipe_table(spark, steps: Sequence[Step]) -> DataFrame:
    return local_rows(spark, [(i + 1, s.name, s.why, str(s.options)) for i, s in enumerate(steps)], "position int, step string, why string, options string")


def run_recipe(df: DataFrame, f: TableFacts, steps: Sequence[Step], key: str) -> tuple[DataFrame, dict[str, DataFrame], dict[str, str]]:
    """(table after cleaning, result per step, reason per step that could not run)."""
    frame, results, failed = df, {}, {}
    nums = [c for c in f.of("continuous", "discrete") if c in numeric_columns(df) and c != f.target]

    def clean(s: Step) -> DataFrame:
        nonlocal frame
        if "duplicates" in s.options["actions"]:
            frame = frame.dropDuplicates()
        if "poor_columns" in s.options["actions"]:
            frame = frame.drop(*[c for c in f.poor if c not in (f.target, key)])
        if "impute" in s.options["actions"]:
            frame = cleaning.clean(frame, [("missing_values", {"default": "median"})])[0]
        return local_rows(df.sparkSession, [(a,) for a in s.options["actions"]], "action string")

    def here() -> list[str]:
        return [c for c in nums if c in frame.columns]

    classify = f.task.endswith("classification")
    run: dict[str, Callable[[Step], DataFrame]] = {
        "clean": clean,
        "describe": lambda s: bootstrap.bootstrap_ci(frame, here()[0], [key]) if s.options.get("only_intervals") else describe.numeric_descriptive(frame, here(), True),
        "correlate": lambda s: correlate.with_p(correlate.pearson_pairs(frame, here())),
        "vif": lambda s: correlate.vif(frame, here()),
        "components": lambda s: factor.pca_variance(frame, here()),
        "compare_groups": lambda s: hypothesis.compare_means(frame, s.options["groups"][0], f.target),
        "panel": lambda s: panel.fixed_effects(frame, s.options["entity"], f.target or here()[0], [c for c in here() if c != (f.target or here()[0])]),
        "stationarity": lambda s: stationarity.stationarity(frame, here(), [s.options["time"], key]),
        "forecast": lambda s: forecast.autoregressive_forecast(frame, f.target if f.task == "regression" else here()[0], [s.options["time"], key], s.options["horizon"]),
        "cointegration": lambda s: multivariate_ts.johansen(frame, s.options["columns"], [s.options["time"], key], check=False),
        "regression": lambda s: linear.ols_summary(frame, f.target, here(), "hc1"),
        "models": lambda s: supervised.compare_models(frame.select(*dict.fromkeys([key, f.target, *here(), *[c for c in f.of("nominal", "binary") if c in frame.columns]])),
                                                      f.target, key, classify, names=["logistic", "decision_tree"] if classify else ["linear", "decision_tree"], k=2),
    }
    for s in steps:
        try:
            results[s.name] = run[s.name](s)
        except (ValueError, ZeroDivisionError, ArithmeticError, KeyError) as e:
            failed[s.name] = f"{type(e).__name__}: {e}"
    return frame, results, failed


# ---------------------------------------------------------------- readings

READING = "source string, subject string, reading string, severity string, confidence double, value double"


def _reading(df: DataFrame, source: str, subject, value, rules: Sequence[tuple], confidence=None) -> DataFrame:
    """One row per (input row, rule that holds)."""
    items = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(r).alias("reading"), F.lit(s).alias("severity"))) for cond, r, s in rules]))
    return df.select(F.lit(source).alias("source"), subject.cast("string").alias("subject"), F.explode(items).alias("i"),
                     (confidence if confidence is not None else F.lit(1.0)).cast("double").alias("confidence"), value.cast("double").alias("value")).select(
        "source", "subject", "i.reading", "i.severity", "confidence", "value")


def read_descriptive(t: DataFrame) -> DataFrame:
    sure = F.least(F.lit(1.0), F.col("count") / 100.0)
    return _reading(t, "descriptive", F.col("column"), F.col("skewness"), [
        (F.abs("skewness") > 2, "strongly_skewed", "warning"), ((F.abs("skewness") > 1) & (F.abs("skewness") <= 2), "skewed", "info"), (F.col("kurtosis") > 7, "heavy_tails", "warning"),
        (F.col("null_rate") > .3, "many_missing", "warning"), (F.abs("cv_pct") > 100, "widely_dispersed", "info"), (F.col("std") == 0, "constant", "warning")], sure)


def read_correlation(t: DataFrame) -> DataFrame:
    return _reading(t, "correlation", F.concat_ws("~", "a", "b"), F.col("r"), [(F.abs("r") >= .9, "redundant", "warning"), (F.abs("r").between(.6, .9), "strong_link", "info")], 1 - F.coalesce(F.col("p"), F.lit(1.0)))


def read_vif(t: DataFrame) -> DataFrame:
    return _reading(t, "vif", F.col("column"), F.col("vif"), [(F.col("level") == "severe", "collinear", "critical"), (F.col("level") == "moderate", "somewhat_collinear", "warning")])


def read_test(t: DataFrame) -> DataFrame:
    return _reading(t, "test", F.col("test"), F.col("p"), [(F.col("p") < .001, "very_strong_evidence", "info"), (F.col("p").between(.001, .05), "evidence", "info"), (F.col("p") >= .05, "no_evidence", "info")], 1 - F.col("p"))


def read_models(t: DataFrame) -> DataFrame:
    score = "f1" if "f1" in t.columns else "r2"
    floor = t.where("model = 'naive'").first()
    base = float(floor[score] or 0.0) if floor else 0.0
    return _reading(t.where("model <> 'naive'"), "model", F.col("model"), F.col(score), [
        (F.col("reason").isNotNull(), "did_not_run", "warning"), (F.col(score) <= base + .01, "no_better_than_naive", "critical"), (F.col(score) > base + .2, "useful", "info"), (F.col(score) > .98, "suspiciously_good", "warning")])


def read_series(t: DataFrame) -> DataFrame:
    return _reading(t, "series", F.col("column"), F.col("adf_p"), [(F.col("verdict") == "non_stationary", "difference_before_modelling", "warning"), (F.col("verdict") == "stationary", "ready_for_modelling", "info"),
                                                                   (F.col("verdict").isin("inconclusive", "difference_stationary"), "tests_disagree", "info")])


READERS = {"describe": read_descriptive, "correlate": read_correlation, "vif": read_vif, "compare_groups": read_test, "models": read_models, "stationarity": read_series}


def insights(results: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in results.items():
        if name in READERS:
            part = READERS[name](t)
            out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- staged run

STAGES = ["problem", "understanding", "quality", "univariate", "bivariate", "diagnostics", "correction", "univariate_after", "modelling", "validation", "interpretation"]


def staged_run(df: DataFrame, target: str, key: str, declared: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The eleven stages from problem statement to reading; results by stage, and the corrected table."""
    spark = df.sparkSession
    applied = apply_schema(df, declared or {})
    frame = applied.frame
    if key not in frame.columns:
        raise ValueError(f"no key column {key}")
    skip = [key, *[c for c, k in applied.kinds.items() if k == "identifier"]]
    out = {"problem": problem_type(frame, target), "understanding": data_dictionary(frame), "quality": describe.missing_summary(frame)}
    nums = [c for c in numeric_columns(frame) if c not in skip]
    out["univariate"] = describe.numeric_descriptive(frame, nums)
    out["bivariate"] = correlate.with_p(correlate.pearson_pairs(frame, nums))
    out["diagnostics"] = D.issue_table(spark, D.diagnose(frame, target, skip=skip))
    fixed = D.correct(frame, target, skip=skip)
    out["correction"] = D.rounds_table(spark, fixed)
    clean = fixed.frame
    kept = [c for c in numeric_columns(clean) if c not in skip]
    out["univariate_after"] = describe.numeric_descriptive(clean, kept)
    task = out["problem"].first()["problem_type"]
    classify = task != "regression"
    names = ["logistic", "decision_tree"] if classify else ["linear", "decision_tree"]
    out["modelling"] = supervised.compare_models(clean, target, key, classify, drop=[c for c in skip if c != key], names=names, k=2)
    xs = [c for c in kept if c != target]
    out["validation"] = linear.breusch_pagan(clean, target, xs) if xs and target in kept else out["modelling"].select("model", "reason")
    out["interpretation"] = insights({"describe": out["univariate_after"], "correlate": out["bivariate"], "models": out["modelling"]})
    return out, clean
