"""Feature preparation, splits, models, comparison and metrics."""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import Imputer, OneHotEncoder, PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, local_rows, numeric_columns, ratio, string_columns, temporal_columns, unit_hash
from lodestat.operators import describe
from lodestat.operators.cell_trees import CellTrees
from lodestat.operators.gram import gram, gram_by
from lodestat.operators.kernel import KernelMachine, StumpEnsemble
from lodestat.operators.neighbours import nearest
from lodestat.operators.ordering import running_total, with_position
from lodestat.operators.quantiles import exact_quantiles
from lodestat.operators.transforms import decimal_year
from lodestat.session import saved

# ---------------------------------------------------------------- splits

def random_split(df: DataFrame, key: str, stratum: str | None = None, test: float = .2, seed: int = 42) -> DataFrame:
    """Add `part` (train/test) from a key hash: stable under repartitioning, no shuffle, per-class shares kept in expectation."""
    parts = [as_col(stratum).cast("string")] if stratum else []
    return df.withColumn("part", F.when(unit_hash(F.concat_ws("|", *parts, as_col(key).cast("string"), F.lit(str(seed)))) < test, "test").otherwise("train"))


def time_split(df: DataFrame, ts: str, test: float = .2) -> DataFrame:
    """The latest rows are the test part: cut at a quantile of time."""
    from lodestat.operators.ordering import order_number
    t = order_number(df, ts)
    cut = exact_quantiles(df.select(t.alias("t")), ["t"], [1 - test])["t"][0]
    return df.withColumn("part", F.when(t > cut, "test").otherwise("train"))


def folds(df: DataFrame, key: str, k: int = 5, kind: str = "random", stratum: str | None = None) -> DataFrame:
    """Add `fold` 0…k-1: by key hash (within the stratum when stratified), or by quantile of an ordered key."""
    if kind == "time":
        from lodestat.operators.ordering import order_number
        t = order_number(df, key)
        cuts = exact_quantiles(df.select(t.alias("t")), ["t"], [(i + 1) / k for i in range(k - 1)])["t"]
        out = F.lit(0)
        for c in cuts:
            out = out + (t > c).cast("int")
        return df.withColumn("fold", out)
    parts = [as_col(stratum).cast("string")] if kind == "stratified" else []
    return df.withColumn("fold", F.floor(unit_hash(F.concat_ws("|", *parts, as_col(key).cast("string"), F.lit("fold"))) * k).cast("int"))


# ---------------------------------------------------------------- features

def feature_plan(df: DataFrame, target: str, drop: Sequence[str] = (), most_levels: int = 50) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns fit for modelling: no identifiers, constants or very wide categories."""
    from lodestat.operators.typing import column_types
    cols = [c for c in df.columns if c != target and c not in drop]
    kinds = column_types(df.select(*[as_col(c) for c in cols]))
    miss = {r["column"]: r for r in describe.missing_summary(df.select(*[as_col(c) for c in cols])).collect()}  # one row per column
    usable = [c for c in cols if c in kinds and kinds[c] not in ("identifier", "unknown") and not miss[c]["constant"]]
    nums = [c for c in usable if c in numeric_columns(df)]
    cats = [c for c in usable if c in string_columns(df) and 2 <= miss[c]["cardinality"] < most_levels]
    return nums, cats


def feature_stages(nums: Sequence[str], cats: Sequence[str], scale: bool = True) -> list:
    """Median and mode imputation, dummies without the last level, scaling."""
    stages: list = []
    parts = []
    if nums:
        stages += [Imputer(strategy="median", inputCols=list(nums), outputCols=[f"__n_{c}" for c in nums]),
                   VectorAssembler(inputCols=[f"__n_{c}" for c in nums], outputCol="__nums")]
        parts.append("__nums")
    if cats:
        stages += [StringIndexer(inputCols=list(cats), outputCols=[f"__i_{c}" for c in cats], handleInvalid="keep", stringOrderType="frequencyDesc"),
                   OneHotEncoder(inputCols=[f"__i_{c}" for c in cats], outputCols=[f"__o_{c}" for c in cats], dropLast=True, handleInvalid="keep")]
        parts += [f"__o_{c}" for c in cats]
    stages.append(VectorAssembler(inputCols=parts, outputCol="__raw" if scale else "features"))
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    return stages


def prepare(df: DataFrame, target: str, drop: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """Dates as decimal years, numbers as doubles, rows with a target; with the chosen columns."""
    df = df.where(as_col(target).isNotNull())
    for c in temporal_columns(df):
        df = decimal_year(df, c)
    nums, cats = feature_plan(df, target, drop)
    return df.withColumns({c: as_col(c).cast("double") for c in nums}), nums, cats


# ---------------------------------------------------------------- models

class GaussianClassifier:
    """Linear (pooled covariance) or quadratic discriminant, scored by one expression per class."""

    def __init__(self, quadratic: bool = False):
        self.quadratic = quadratic

    def fit(self, df: DataFrame, cols: Sequence[str], label: str) -> "GaussianClassifier":
        blocks = gram_by(df.where(as_col(label).isNotNull()), cols, label)
        n = sum(g.n for _, g in blocks)
        pooled = sum(g.cross for _, g in blocks) / max(1.0, n - len(blocks))
        self.cols, self.classes = list(cols), []
        for level, g in blocks:
            cov = g.cov if self.quadratic else pooled
            sign, logdet = np.linalg.slogdet(cov)
            self.classes.append((level, g.mean, np.linalg.pinv(cov, hermitian=True), math.log(g.n / n) - (0.5 * logdet if self.quadratic and sign > 0 else 0.0)))
        return self

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        scores = []
        for _, mean, inv, base in self.classes:
            d = [as_col(c).cast("double") - float(m) for c, m in zip(self.cols, mean)]
            q = F.lit(base)
            for i in range(len(d)):
                for j in range(len(d)):
                    q = q - 0.5 * float(inv[i, j]) * d[i] * d[j]
            scores.append(q)
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        pick = F.lit(None)
        for (level, *_), s in reversed(list(zip(self.classes, scores))):
            pick = F.when(s == best, F.lit(level)).otherwise(pick)
        return df.withColumn(name, pick)


def nearest_predict(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, train_key: str, test_key: str, k: int = 5, classify: bool = False) -> DataFrame:
    """Mean or majority vote (smallest label on ties) of the k nearest training rows: (test_key, prediction)."""
    found = nearest(test, train.withColumnRenamed(train_key, "__donor"), cols, test_key, "__donor", k, [label])
    if not classify:
        return found.groupBy(as_col(test_key)).agg(F.avg(as_col(label).cast("double")).alias("prediction"))
    votes = found.groupBy(as_col(test_key), as_col(label).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(as_col(test_key)).agg(F.min(F.struct((-F.col("n")).alias("k"), "v")).alias("b")).select(as_col(test_key), F.col("b.v").alias("prediction"))


def regressors(seed: int = 42) -> dict[str, Callable[[], list]]:
    """Stages per regression model, to follow the feature stages. Trees fitted to one DataFrame read a large one's cells once."""
    shared: dict = {}
    lr = dict(featuresCol="features", labelCol="label", maxIter=100)
    tree = dict(featuresCol="features", labelCol="label", seed=seed)
    return {
        "linear": lambda: [LinearRegression(**lr)], "ridge": lambda: [LinearRegression(regParam=1.0, elasticNetParam=0.0, **lr)],
        "lasso": lambda: [LinearRegression(regParam=0.1, elasticNetParam=1.0, **lr)],
        "elastic_net": lambda: [LinearRegression(regParam=0.1, elasticNetParam=0.5, **lr)],
        "polynomial": lambda: [PolynomialExpansion(degree=2, inputCol="features", outputCol="poly"), LinearRegression(featuresCol="poly", labelCol="label", regParam=1.0, elasticNetParam=0.0)],
        "decision_tree": lambda: [CellTrees(lambda: DecisionTreeRegressor(maxDepth=6, **tree), shared)],
        "random_forest": lambda: [CellTrees(lambda: RandomForestRegressor(numTrees=50, maxDepth=8, **tree), shared)],
        "gradient_boosting": lambda: [CellTrees(lambda: GBTRegressor(maxIter=30, maxDepth=4, **tree), shared)], "kernel_svr": lambda: [KernelMachine(seed=seed)],
    }


def classifiers(classes: int, seed: int = 42) -> dict[str, Callable[[], list]]:
    lab = dict(featuresCol="features", labelCol="label")

    def several(make):
        return make if classes == 2 else (lambda: OneVsRest(classifier=make(), **lab))

    return {
        "logistic": lambda: [LogisticRegression(maxIter=100, **lab)], "decision_tree": lambda: [DecisionTreeClassifier(maxDepth=6, seed=seed, **lab)],
        "random_forest": lambda: [RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **lab)],
        "gradient_boosting": lambda: [several(lambda: GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **lab))()],
        "boosted_stumps": lambda: [several(lambda: GBTClassifier(maxIter=30, maxDepth=1, seed=seed, **lab))()],
        "linear_svm": lambda: [several(lambda: LinearSVC(maxIter=50, regParam=0.01, **lab))()],
        "kernel_svm": lambda: [KernelMachine(classes=classes, seed=seed)], "adaboost": lambda: [StumpEnsemble()],
    }


def label_column(df: DataFrame, target: str, classify: bool) -> tuple[DataFrame, list]:
    """Add `label`: the number itself, or the position among the sorted classes."""
    if not classify:
        return df.withColumn("label", as_col(target).cast("double")), []
    from lodestat.operators.cleaning import levels_of
    levels = levels_of(df, target, 200)
    pairs = [x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(float(i)))]
    return df.withColumn("label", F.element_at(F.create_map(*pairs), as_col(target))), levels


@dataclass
class Prepared:
    """Fitted feature stages and the table with their features, for several models."""
    stages: PipelineModel
    frame: DataFrame


def prepared_features(df: DataFrame, nums: Sequence[str], cats: Sequence[str]) -> Prepared:
    fitted = Pipeline(stages=feature_stages(nums, cats)).fit(df)
    return Prepared(fitted, fitted.transform(df))


def train(df: DataFrame, nums: Sequence[str], cats: Sequence[str], stages: list, prepared: Prepared | None = None) -> PipelineModel:
    """Feature stages and model stages fitted to `df`; `prepared` are the former, when other models have them already."""
    prepared = prepared or prepared_features(df, nums, cats)
    return PipelineModel([*prepared.stages.stages, *Pipeline(stages=stages).fit(prepared.frame).stages])


def compare_models(df: DataFrame, target: str, key: str, classify: bool, drop: Sequence[str] = (), names: Sequence[str] | None = None,
                   k: int = 3, budget: float | None = None) -> DataFrame:
    """Cross-validated score of every applicable model, best first, with a naive floor; failures and skips carry their reason."""
    data, nums, cats = prepare(df, target, [key, *drop])
    data, levels = label_column(data, target, classify)
    data = folds(data, key, k, "stratified" if classify else "random", target if classify else None)
    makers = classifiers(len(levels)) if classify else regressors()
    rows, started = [], time.monotonic()

    @functools.cache
    def fold_features(f: int) -> tuple[DataFrame, DataFrame]:
        """Features of the other folds and of this one, fitted on the others; written once for all models."""
        known = data.where(F.col("fold") != f)
        ready = Pipeline(stages=feature_stages(nums, cats)).fit(known).transform(data).select("features", "label", "fold")
        ready = saved(ready, "fold_features")
        return ready.where(F.col("fold") != f), ready.where(F.col("fold") == f)

    for name in names or list(makers):
        if budget is not None and time.monotonic() - started > budget:
            rows.append((name, None, None, None, "skipped: time budget used"))
            continue
        try:
            first, second = [], []
            for f in range(k):
                known, held_out = fold_features(f)
                model = Pipeline(stages=makers[name]()).fit(known)
                m = (classification_metrics if classify else regression_metrics)(model.transform(held_out), "label", "prediction").first()
                first.append(m["f1"] if classify else m["r2"])
                second.append(m["accuracy"] if classify else m["rmse"])
            rows.append((name, float(np.mean(first)), float(np.std(first)), float(np.mean(second)), None))
        except Exception as e:  # one model's failure must not hide the others; the reason is reported
            rows.append((name, None, None, None, f"failed: {type(e).__name__}: {str(e).splitlines()[0][:200]}"))
    base = naive_baseline(data, "label", classify)
    floor = (classification_metrics if classify else regression_metrics)(base, "label", "prediction").first()
    rows.append(("naive", floor["f1"] if classify else floor["r2"], None, floor["accuracy"] if classify else floor["rmse"], None))
    schema = f"model string, {'f1' if classify else 'r2'} double, spread double, {'accuracy' if classify else 'rmse'} double, reason string"
    return local_rows(df.sparkSession, sorted(rows, key=lambda r: -(r[1] if r[1] is not None else -1e300)), schema)


def naive_baseline(df: DataFrame, label: str, classify: bool, fold: str = "fold") -> DataFrame:
    """Each fold predicted by the mean (or commonest label) of the other folds."""
    if not classify:
        per = df.groupBy(as_col(fold)).agg(F.sum(as_col(label)).alias("s"), F.count(as_col(label)).alias("n"))
        w = Window.partitionBy(F.lit(0))
        other = per.select(as_col(fold), ((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))).alias("prediction"))
    else:
        per = df.groupBy(as_col(fold), as_col(label).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        whole = per.groupBy("v").agg(F.sum("n").alias("whole"))
        ids = per.select(as_col(fold)).distinct()
        # folds x classes rows: few by construction
        grid = ids.withColumn("v", F.explode(F.array(*[F.lit(r["v"]) for r in whole.select("v").collect()])))
        rest = grid.join(whole, "v").join(per, [fold, "v"], "left").select(as_col(fold), "v", (F.col("whole") - F.coalesce("n", F.lit(0))).alias("m"))
        other = rest.groupBy(as_col(fold)).agg(F.min(F.struct((-F.col("m")).alias("k"), "v")).alias("b")).select(as_col(fold), F.col("b.v").alias("prediction"))
    return df.join(F.broadcast(other), fold)  # one row per fold


# ---------------------------------------------------------------- metrics

def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    a, b = as_col(y).cast("double"), as_col(p).cast("double")
    s = df.where(a.isNotNull() & b.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg((a - b) * (a - b)).alias("mse"), F.avg(F.abs(a - b)).alias("mae"), F.var_pop(a).alias("v"),
        (F.avg(F.when(a != 0, F.abs(F.try_divide(a - b, a)))) * 100).alias("mape"))
    return s.select("n", F.sqrt("mse").alias("rmse"), "mae", (1 - ratio(F.col("mse"), F.col("v"))).alias("r2"), "mape")


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(as_col(y).alias("actual"), as_col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion cells."""
    c = confusion(df, y, p)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    act = c.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    pre = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    t = act.join(pre, "class", "full").na.fill(0, ["support", "tp", "predicted"])
    precision, recall = F.coalesce(ratio(F.col("tp"), F.col("predicted")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("support")), F.lit(0.0))
    return t.select("class", "support", "tp", precision.alias("precision"), recall.alias("recall"),
                    F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    r = class_report(df, y, p)
    n = F.sum("support")
    return r.agg(n.alias("n"), ratio(F.sum("tp"), n).alias("accuracy"), *[ratio(F.sum(F.col(c) * F.col("support")), n).alias(c) for c in ("precision", "recall", "f1")])


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the curve from the rank sum of the positives, ties counted half."""
    counts = df.where(as_col(y).isNotNull() & as_col(score).isNotNull()).groupBy(as_col(score).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(as_col(y).cast("int") == 1).alias("pos"))
    r = running_total(counts, {"upto": "n"}, ["s"])
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    s = r.agg(F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("n"), F.sum(F.col("pos") * rank).alias("r"))
    return s.select(ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def roc_auc_weighted(df: DataFrame, y: str, scores: dict[object, str]) -> DataFrame:
    """One-versus-rest areas weighted by class size."""
    total, weight = 0.0, 0
    for level, col in scores.items():
        d = df.withColumn("__y", (as_col(y) == F.lit(level)).cast("int"))
        n = d.agg(F.sum("__y")).first()[0] or 0
        if n:
            total += n * roc_auc(d, "__y", col).first()[0]
            weight += n
    return local_rows(df.sparkSession, [(total / weight if weight else None,)], "auc double")


# ---------------------------------------------------------------- explanation

def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    attrs = df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    pairs = [(a["idx"], a.get("name", f"f{a['idx']}")) for group in attrs.values() for a in group]
    return [n for _, n in sorted(pairs)]


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Tree importances or mean absolute coefficients, by feature."""
    last = model.stages[-1]
    vector = "poly" if last.hasParam("featuresCol") and last.getOrDefault("featuresCol") == "poly" else "features"
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = np.abs(np.asarray(last.coefficients))
    raw = model.transform(df.limit(1))
    names = feature_names(raw, "__raw") if "__raw" in raw.columns and vector == "features" else []
    names = names if len(names) == len(values) else [f"f{i}" for i in range(len(values))]
    names = [n.removeprefix("__n_").removeprefix("__nums_") for n in names]
    return local_rows(df.sparkSession, sorted(zip(names, map(float, values)), key=lambda r: -r[1]), "feature string, importance double")


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], DataFrame], features: Sequence[str], label: str, key: str, metric: str = "r2",
                           repeats: int = 3, seed: int = 42) -> DataFrame:
    """Loss of score when one feature's values are exchanged between rows.

    Rows are numbered in two hash orders; joining the numberings gives each row a random
    partner (unique keys, so balanced), whose value replaces one feature at a time.
    """
    evaluate = regression_metrics if metric in ("r2", "rmse", "mae") else classification_metrics
    base = evaluate(score(df), label, "prediction").first()[metric]
    rows = []
    for r in range(repeats):
        def numbered(tag: str) -> DataFrame:
            return with_position(df.withColumn("__h", F.xxhash64(as_col(key), F.lit(f"{tag}{r}{seed}"))), ["__h", key], name="__at").drop("__h")
        donor = numbered("b").select("__at", *[as_col(c).alias(f"__o_{c}") for c in features])
        paired = numbered("a").join(donor, "__at").drop("__at")
        for f in features:
            m = evaluate(score(paired.withColumn(f, as_col(f"__o_{f}"))), label, "prediction").first()[metric]
            rows.append((f, base - m if metric not in ("rmse", "mae") else m - base))
    t = pd.DataFrame(rows, columns=["feature", "loss"]).groupby("feature")["loss"].agg(["mean", "std"]).reset_index()
    return local_rows(df.sparkSession, [(a, float(b), float(c) if c == c else 0.0) for a, b, c in t.itertuples(index=False)], "feature string, importance double, spread double")


def linear_contributions(df: DataFrame, coef: dict[str, float], key: Sequence[str]) -> DataFrame:
    """Exact additive attributions of a linear model: coefficient times distance from the mean, every row."""
    means = df.agg(*[F.avg(as_col(c)).alias(c) for c in coef]).first()
    return df.select(*[as_col(k) for k in key], *[(F.lit(float(b)) * (as_col(c).cast("double") - float(means[c]))).alias(f"shap_{c}") for c, b in coef.items()])


def global_contributions(contributions: DataFrame, features: Sequence[str]) -> DataFrame:
    row = contributions.agg(*[F.avg(F.abs(F.col(f"`shap_{c}`"))).alias(c) for c in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), as_col(c).alias("mean_abs")) for c in features])).alias("r")).select("r.*")


def batch_predict(model: PipelineModel, df: DataFrame, nums: Sequence[str], cats: Sequence[str], fallback: dict[str, object]) -> DataFrame:
    """Score new rows; absent features take the training mean or mode."""
    for c in [*nums, *cats]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(fallback[c]))
    return model.transform(df.withColumns({c: as_col(c).cast("double") for c in nums}))


def feature_ranges(df: DataFrame, nums: Sequence[str], cats: Sequence[str]) -> DataFrame:
    """Range and mean per number, up to ten commonest levels per category."""
    none = F.lit(None)
    out = None
    if nums:
        out = describe.moment_table(df, nums).select("column", "min", "max", "mean", none.cast("array<string>").alias("levels"))
    if cats:
        top = describe.top_values(df, cats).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("levels"))  # ten values at most
        part = top.select("column", none.cast("double").alias("min"), none.cast("double").alias("max"), none.cast("double").alias("mean"), "levels")
        out = part if out is None else out.unionByName(part)
    return out
