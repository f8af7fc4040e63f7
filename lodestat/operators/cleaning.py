"""Deduplication, imputation, outliers, scaling and encoding."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, hash32, join_null_safe, numeric_columns, string_columns
from lodestat.operators import describe
from lodestat.operators.neighbours import nearest
from lodestat.operators.ordering import fill_order, lookup_by_value, with_position
from lodestat.operators.quantiles import exact_quantiles

UNKNOWN_TEXT = "Inconnu"


# ---------------------------------------------------------------- duplicates

def deduplicate(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Drop repeated rows; on a subset, keep the first in `order` (an aggregate, so hot keys combine early)."""
    if not subset:
        return df.dropDuplicates()
    first = F.min_by(F.struct(*[as_col(c) for c in df.columns]), F.struct(*[as_col(c) for c in (order or df.columns)]))
    return df.groupBy(*[as_col(c).alias(f"__k_{c}") for c in subset]).agg(first.alias("__row")).select("__row.*")


# ---------------------------------------------------------------- missing values

def impute_drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def _mode_values(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Commonest value per column (smallest on ties)."""
    out = {}
    for c in cols:
        counts = df.where(as_col(c).isNotNull()).groupBy(as_col(c).alias("v")).count()
        best = counts.agg(F.min(F.struct((-F.col("count")).alias("k"), "v")).alias("b")).first()["b"]
        out[c] = None if best is None else best["v"]
    return out


def impute(df: DataFrame, strategies: dict[str, str], constants: dict[str, object] | None = None) -> DataFrame:
    """mean, median, mode or constant per column; text falls back to the mode, empty columns to 0 or a word."""
    nums = set(numeric_columns(df))
    mean = [c for c, s in strategies.items() if s == "mean" and c in nums]
    median = [c for c, s in strategies.items() if s == "median" and c in nums]
    constant = [c for c, s in strategies.items() if s == "constant"]
    mode = [c for c in strategies if c not in mean and c not in median and c not in constant]
    fill: dict[str, object] = {}
    if mean:
        row = df.agg(*[F.avg(as_col(c)).alias(c) for c in mean]).first()
        fill |= {c: row[c] for c in mean}
    if median:
        fill |= {c: q[0] for c, q in exact_quantiles(df, median, [.5]).items()}
    if mode:
        fill |= _mode_values(df, mode)
    fill = {c: (v if v is not None else 0 if c in nums else UNKNOWN_TEXT) for c, v in fill.items()}
    fill |= {c: (constants or {}).get(c, 0) for c in constant}

    def filled(c: str) -> Column:
        if c not in fill:
            return as_col(c)
        widen = c in nums and isinstance(fill[c], float)
        return F.coalesce(as_col(c).cast("double") if widen else as_col(c), F.lit(fill[c])).alias(c)

    return df.select(*[filled(c) for c in df.columns])


def impute_fill(df: DataFrame, cols: Sequence[str], order: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """Carry the last value forward, then the next one back over a leading gap."""
    return fill_order(fill_order(df, cols, order, by, True, **kw), cols, order, by, False, **kw)


def interpolate(df: DataFrame, cols: Sequence[str], order: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """Linear in row position between known values; ends take the nearest known value, empty columns 0."""
    placed = with_position(df, order, by, "__pos", **kw)
    marked = placed.withColumns({f"__at_{c}": F.when(as_col(c).isNotNull(), F.col("__pos")) for c in cols})
    both = [*cols, *[f"__at_{c}" for c in cols]]
    out = fill_order(fill_order(marked, both, order, by, True, "__prev_", **kw), both, order, by, False, "__next_", **kw)
    values = {}
    for c in cols:
        a, b = F.col(f"`__prev_{c}`").cast("double"), F.col(f"`__next_{c}`").cast("double")
        i, j = F.col(f"`__prev___at_{c}`"), F.col(f"`__next___at_{c}`")
        step = F.try_divide((F.col("__pos") - i).cast("double"), (j - i).cast("double"))
        values[c] = F.coalesce(as_col(c).cast("double"), a + (b - a) * step, b, a, F.lit(0.0))
    return out.withColumns(values).select(*[as_col(c) for c in df.columns])


def impute_knn(df: DataFrame, col: str, features: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """Mean of the k nearest complete rows; rows lacking a feature take the median."""
    known = F.lit(True)
    for c in features:
        known = known & as_col(c).isNotNull()
    donors = df.where(known & as_col(col).isNotNull())
    found = nearest(df.where(known & as_col(col).isNull()), donors.withColumnRenamed(key, "__donor"), features, key, "__donor", k, [col])
    guess = found.groupBy(as_col(key)).agg(F.avg(as_col(col)).alias("__guess"))
    middle = exact_quantiles(df, [col], [.5])[col][0]
    out = join_null_safe(df, guess, [key])
    return out.withColumn(col, F.coalesce(as_col(col).cast("double"), F.col("__guess"), F.lit(middle))).drop("__guess")


# ---------------------------------------------------------------- outliers

def outlier_test(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float | None = None) -> dict[str, Column]:
    """Boolean expression per column; the limits are numbers computed once over all rows."""
    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        q = exact_quantiles(df, cols, [.25, .75])
        return {c: (as_col(c) < a - k * (b - a)) | (as_col(c) > b + k * (b - a)) for c, (a, b) in q.items() if a is not None}
    if method == "zscore":
        k = 3.0 if threshold is None else threshold
        row = df.agg(*[e for i, c in enumerate(cols) for e in (
            F.avg(as_col(c)).alias(f"m{i}"), F.stddev_samp(as_col(c)).alias(f"s{i}"))]).first()
        return {c: (F.abs(as_col(c) - row[f"m{i}"]) / row[f"s{i}"] > k) if row[f"s{i}"] else F.lit(False)
                for i, c in enumerate(cols)}
    raise ValueError(f"unknown outlier method {method}")


def treat_outliers(df: DataFrame, cols: Sequence[str], method: str = "iqr", treatment: str = "cap",
                   threshold: float | None = None, low: float = .01, high: float = .99) -> DataFrame:
    """remove rows, cap at percentiles, log the column, or flag; columns without outliers are left alone."""
    tests = {c: F.coalesce(t, F.lit(False)) for c, t in outlier_test(df, cols, method, threshold).items()}
    counts = df.agg(*[F.count_if(t).alias(c) for c, t in tests.items()]).first()
    hit = [c for c in tests if counts[c] > 0]
    if treatment == "flag":
        return df.withColumns({f"{c}_is_outlier": tests[c].cast("int") for c in hit})
    if not hit:
        return df
    if treatment == "remove":
        keep = F.lit(True)
        for c in hit:
            keep = keep & ~tests[c]
        return df.where(keep)
    if treatment == "cap":
        q = exact_quantiles(df, hit, [low, high])
        return df.withColumns({c: F.when(as_col(c).isNotNull(), F.greatest(F.lit(q[c][0]), F.least(F.lit(q[c][1]), as_col(c).cast("double"))))
                               for c in hit})
    if treatment == "log":
        return df.withColumns(_log_columns(df, hit))
    raise ValueError(f"unknown treatment {treatment}")


def _log_columns(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    low = df.agg(*[F.min(as_col(c)).cast("double").alias(c) for c in cols]).first()
    return {c: F.log1p(as_col(c) - low[c] + 1 if low[c] is not None and low[c] <= 0 else as_col(c)) for c in cols}


@dataclass
class IsolationTree:
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray  # path length credited at a leaf


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> IsolationTree:
    rows: list[list[float]] = []

    def node(idx: np.ndarray, depth: int) -> int:
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, depth + _average_path(len(idx))])
        spread = np.ptp(x[idx], axis=0) if len(idx) else np.zeros(x.shape[1])
        if depth < limit and len(idx) > 1 and spread.max() > 0:
            f = int(rng.choice(np.flatnonzero(spread > 0)))
            cut = float(rng.uniform(x[idx, f].min(), x[idx, f].max()))
            below = x[idx, f] < cut
            rows[at][:2] = [f, cut]
            rows[at][2] = node(idx[below], depth + 1)
            rows[at][3] = node(idx[~below], depth + 1)
        return at

    node(np.arange(len(x)), 0)
    a = np.array(rows)
    return IsolationTree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])


def isolation_scores(df: DataFrame, cols: Sequence[str], key: str, trees: int = 100, sample: int = 256,
                     seed: int = 42, name: str = "anomaly_score") -> DataFrame:
    """Isolation-forest score of every row.

    The method itself grows each tree on a small random sample (trees x sample rows,
    chosen by key hash, is all the driver sees); scoring covers the whole table.
    """
    draw = df.select(*[as_col(c).cast("double").alias(c) for c in cols], hash32(F.concat_ws("|", as_col(key).cast("string"), F.lit(str(seed)))).alias("__h"))
    picked = draw.na.drop().orderBy("__h", *[as_col(c) for c in cols]).limit(trees * sample).drop("__h").toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(picked))
    limit = int(np.ceil(np.log2(max(size, 2))))
    forest = [_grow(picked[rng.choice(len(picked), size, replace=False)], rng, limit) for _ in range(trees)]
    norm = _average_path(size)

    def score(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in forest:
            at = np.zeros(len(x), dtype=int)
            for _ in range(limit):
                f = t.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                go_left = x[rows, f[rows]] < t.cut[at[rows]]
                at[rows] = np.where(go_left, t.left[at[rows]], t.right[at[rows]])
            total += t.depth[at]
        return np.power(2.0, -total / len(forest) / norm)

    @F.pandas_udf("double")
    def anomaly(point: pd.Series) -> pd.Series:
        return pd.Series(score(np.stack(point.to_numpy()).astype(float)) if len(point) else [])

    point = F.array(*[F.coalesce(as_col(c).cast("double"), F.lit(float("nan"))) for c in cols])
    return df.withColumn(name, anomaly(point))


def isolation_outliers(df: DataFrame, cols: Sequence[str], key: str, contamination: float = .05, **kw) -> DataFrame:
    scored = isolation_scores(df, cols, key, **kw)
    cut = exact_quantiles(scored, ["anomaly_score"], [1 - contamination])["anomaly_score"][0]
    return scored.withColumn("is_outlier", F.col("anomaly_score") > cut)


# ---------------------------------------------------------------- scaling

def scale(df: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    """standard (population spread), minmax, robust, maxabs or log; a zero spread divides by 1."""
    if method == "log":
        return df.withColumns(_log_columns(df, cols))
    if method == "robust":
        limits = {c: (m, (b - a) or 1.0) for c, (a, m, b) in exact_quantiles(df, cols, [.25, .5, .75]).items()}
    else:
        pick = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
                "maxabs": lambda c: (F.lit(0.0), F.max(F.abs(c)))}
        if method not in pick:
            raise ValueError(f"unknown scaling {method}")
        row = df.agg(*[e.cast("double").alias(f"{t}{i}") for i, c in enumerate(cols)
                       for t, e in zip("ab", pick[method](as_col(c).cast("double")))]).first()
        limits = {c: (row[f"a{i}"] or 0.0, row[f"b{i}"] or 1.0) for i, c in enumerate(cols)}
    return df.withColumns({c: (as_col(c).cast("double") - limits[c][0]) / limits[c][1] for c in cols})


# ---------------------------------------------------------------- encoding

def levels_of(df: DataFrame, col: str, most: int = 1000) -> list:
    rows = df.where(as_col(col).isNotNull()).select(as_col(col)).distinct().orderBy(as_col(col)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{col} has more than {most} levels; use label, target or binary encoding")
    return [r[0] for r in rows]


def encode_one_hot(df: DataFrame, col: str) -> DataFrame:
    """A 0/1 column per level but the first in sorted order; null rows are all 0."""
    levels = levels_of(df, col)
    return df.withColumns({f"{col}_{v}": F.coalesce((as_col(col) == F.lit(v)).cast("int"), F.lit(0)) for v in levels[1:]}).drop(col)


def label_table(df: DataFrame, col: str) -> DataFrame:
    """(level, code, n): codes follow the sorted order of the levels."""
    counts = df.where(as_col(col).isNotNull()).groupBy(as_col(col)).agg(F.count(F.lit(1)).alias("n"))
    return with_position(counts, [col], name="code")


def encode_label(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    out = lookup_by_value(df, label_table(df, col).withColumnRenamed("code", "__label"), col)
    return out.withColumn(name or col, F.coalesce(F.col("__label"), F.lit(-1)).cast("long")).drop("__label")


def encode_target(df: DataFrame, col: str, target: str) -> DataFrame:
    means = df.where(as_col(col).isNotNull()).groupBy(as_col(col)).agg(
        F.avg(as_col(target)).alias("__mean"), F.count(F.lit(1)).alias("n"))
    return lookup_by_value(df, means, col).withColumn(col, F.col("__mean")).drop("__mean")


def encode_binary(df: DataFrame, col: str) -> DataFrame:
    """Bits of the label code; -1 (null) has every bit set."""
    top = label_table(df, col).agg(F.max("code")).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(top + 1)))) if top > 0 else 1
    out = encode_label(df, col, "__code")
    return out.withColumns({f"{col}_bit{b}": F.shiftright("__code", b).bitwiseAND(F.lit(1)).cast("int") for b in range(bits)}).drop(col, "__code")


# ---------------------------------------------------------------- ordered steps

@dataclass
class CleaningLog:
    rows: list[tuple[str, str]] = field(default_factory=list)


def _step_duplicates(df: DataFrame, cfg: dict) -> tuple[DataFrame, str]:
    before = df.count()
    out = deduplicate(df, cfg.get("subset"), cfg.get("order", ()))
    return out, f"removed {before - out.count()}"


def _step_missing(df: DataFrame, cfg: dict) -> tuple[DataFrame, str]:
    nulls = df.agg(*[F.count_if(as_col(c).isNull()).alias(c) for c in df.columns]).first()
    short = [c for c in df.columns if nulls[c]]
    plan = {c: cfg.get("columns", {}).get(c, cfg.get("default", "median")) for c in short}
    out = impute_drop(df, [c for c, s in plan.items() if s == "drop"]) if "drop" in plan.values() else df
    rest = {c: s for c, s in plan.items() if s in ("mean", "median", "mode", "constant")}
    out = impute(out, rest, cfg.get("constants")) if rest else out
    order, by = cfg.get("order", ()), cfg.get("by", ())
    for name, fn in (("fill", impute_fill), ("interpolate", interpolate)):
        some = [c for c, s in plan.items() if s == name]
        if some:
            out = fn(out, some, order, by)
    return out, f"filled {sum(nulls[c] for c in short)} in {len(short)} columns"


def _step_outliers(df: DataFrame, cfg: dict) -> tuple[DataFrame, str]:
    cols = cfg.get("columns") or numeric_columns(df)
    tests = outlier_test(df, cols, cfg.get("method", "iqr"), cfg.get("threshold"))
    counts = df.agg(*[F.count_if(t).alias(c) for c, t in tests.items()]).first()
    out = treat_outliers(df, cols, cfg.get("method", "iqr"), cfg.get("treatment", "cap"), cfg.get("threshold"))
    return out, f"found {sum(counts)}"


def _step_scale(df: DataFrame, cfg: dict) -> tuple[DataFrame, str]:
    cols = cfg.get("columns") or numeric_columns(df)
    return scale(df, cols, cfg.get("method", "standard")), f"scaled {len(cols)} columns"


def _step_encode(df: DataFrame, cfg: dict) -> tuple[DataFrame, str]:
    cols = cfg.get("columns") or {c: cfg.get("default", "onehot") for c in string_columns(df)}
    for c, method in cols.items():
        if method == "target":
            df = encode_target(df, c, cfg["target"])
        else:
            df = {"onehot": encode_one_hot, "label": encode_label, "binary": encode_binary}[method](df, c)
    return df, f"encoded {len(cols)} columns"


STEPS: dict[str, Callable[[DataFrame, dict], tuple[DataFrame, str]]] = {
    "deduplication": _step_duplicates, "missing_values": _step_missing, "outliers": _step_outliers,
    "normalization": _step_scale, "encoding": _step_encode,
}
AUTOMATIC = [("deduplication", {}), ("missing_values", {"default": "median"}), ("outliers", {"method": "iqr", "treatment": "cap"})]


def clean(df: DataFrame, steps: Sequence[tuple[str, dict]] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Apply named steps in order; returns the frame and a log line per step."""
    log = []
    for name, cfg in (AUTOMATIC if steps is None else steps):
        if name not in STEPS:
            log.append((name, "unknown step"))
            continue
        df, note = STEPS[name](df, cfg)
        log.append((name, note))
    return df, log


def drop_poor_columns(df: DataFrame, missing: float = .5) -> DataFrame:
    """Without columns mostly missing or nearly constant."""
    rows = describe.missing_summary(df).collect()  # one row per column
    poor = [r["column"] for r in rows if (r["null_rate"] or 0) > missing or r["near_constant"]]
    return df.drop(*poor)
