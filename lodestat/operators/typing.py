"""Statistical types of columns, casts with a loss report, declared schemas, and rules over the profile."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions import casts, dates
from lodestat.functions.expr import (local_rows, INTEGRAL, NUMERIC, TEMPORAL, as_col, join_null_safe, melt, numeric_columns, ratio,
                                     rows_from_wide, string_columns)
from lodestat.operators import describe
from lodestat.operators.quantiles import exact_quantiles

TYPES = ["continuous", "discrete", "binary", "temporal", "nominal", "ordinal", "identifier", "ambiguous", "unknown"]

# Accepted spellings of each type.
ALIASES = {
    "continuous": ["continu", "continuous", "numeric", "numérique", "numerique", "float", "reel"],
    "discrete": ["discret", "discrete", "integer", "int"],
    "binary": ["binaire", "binary", "bool", "booleen", "boolean"],
    "nominal": ["catégoriel_nominal", "categoriel_nominal", "nominal", "catégoriel", "categoriel", "categorical",
                "texte", "text", "string", "qualitative", "qualitatif"],
    "ordinal": ["catégoriel_ordinal", "categoriel_ordinal", "ordinal"],
    "temporal": ["temporel", "temporal", "date", "datetime", "time", "annee"],
    "identifier": ["identifiant", "identifier", "id", "cle", "key", "uuid"],
    "ambiguous": ["ambigu", "ambiguous", "mixte", "mixed"],
}
_ALIAS = {word: kind for kind, words in ALIASES.items() for word in words}
ID_HINTS = ["id", "code", "uuid", "identifiant", "num_", "ref_"]

# Semantic patterns in order of precedence.
SEMANTIC_PATTERNS = {
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "phone": r"^[\+]?[\d\s\-().]{7,20}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "postal_code_fr": r"^\d{5}$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "url": r"^https?://",
    "iso_date": r"^\d{4}-\d{2}-\d{2}",
    "gps_coord": r"^-?\d{1,3}\.\d{4,}$",
}

# Unit suffixes of column names.
UNIT_SUFFIXES = {
    "temperature": ["°C", "°F"], "currency": ["USD", "EUR", "GBP", "CHF", "CAD", "JPY"],
    "mass": ["kg", "g", "mg", "lb", "oz"], "length": ["km", "m", "cm", "mm", "mi", "ft", "in"],
    "duration": ["ms", "s", "min", "h", "hr"], "percentage": ["pct", "%"], "volume": ["L", "mL", "gal"],
    "power": ["W", "kW", "MW", "HP"], "pressure": ["Pa", "hPa", "bar", "psi", "atm"],
}

# Words that make a column a likely target.
TARGET_WORDS = ["target", "label", "y", "outcome", "result", "class", "category", "churn", "default", "fraud", "click",
                "buy", "purchase", "convert", "price", "prix", "value", "valeur", "amount", "montant", "revenue",
                "sales", "ventes", "score", "rating", "note", "satisfaction", "status", "etat", "état", "is_", "has_"]


def canonical_type(word: str) -> str:
    word = str(word or "").strip().lower()
    return _ALIAS.get(word, word)


def family(kind: str) -> str:
    """Fold a statistical type to numeric / categorical / temporal / identifier."""
    kind = canonical_type(kind)
    return {"continuous": "numeric", "discrete": "numeric", "temporal": "temporal", "identifier": "identifier"}.get(
        kind, "categorical")


def unit_of_name(name: str) -> tuple[str, str] | None:
    """(unit, domain) from the suffix of a column name, set off by an underscore, bracket or space."""
    for domain, units in UNIT_SUFFIXES.items():
        for unit in sorted(units, key=len, reverse=True):
            if re.search(rf"(?:[_(\s]|^)\s*{re.escape(unit)}\s*\)?$", name, re.IGNORECASE):
                return unit, domain
    return None


def humanise(name: str) -> str:
    text = re.sub(r"[_-]+", " ", re.sub(r"[_(][^_(]*[)]$", "", str(name)))
    return re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).strip().title()


# ---------------------------------------------------------------- evidence

_TEXT = ["n_number", "n_integer", "n_truth", "n_date"]
_NUM = ["n_whole", "n_year", "n_month", "n_day", "n_month_ok", "n_day_ok", "n_serial", "n_modern"]


def _evidence_aggs(df: DataFrame, c: str) -> dict[str, Column]:
    kind = df.schema[c].dataType
    v = as_col(c)
    out = {"rows": F.count(F.lit(1)), "n": F.count(v), "d_approx": F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), 12)), F.lit(0))}
    zero = F.lit(0).cast("long")
    out |= {k: zero for k in _TEXT + _NUM}
    if isinstance(kind, T.StringType):
        number = casts.to_number(v)
        out |= {"n_number": F.count(number), "n_integer": F.count_if(number == F.rint(number)),
                "n_truth": F.count(casts.to_boolean(v)), "n_date": F.count(dates.parse_date(v))}
    elif isinstance(kind, NUMERIC):
        x = v.cast("double")
        whole = x == F.rint(x)
        month, day = x.between(100_000, 999_999), x.between(10_000_000, 99_999_999)
        out |= {
            "n_whole": F.count_if(whole), "n_year": F.count_if(x.between(1000, 3000)),
            "n_month": F.count_if(month), "n_day": F.count_if(day),
            "n_month_ok": F.count_if(month & dates.compact_date(F.when(month, x), "month").isNotNull()),
            "n_day_ok": F.count_if(day & dates.compact_date(F.when(day, x), "day").isNotNull()),
            "n_serial": F.count_if(x.between(20_000, 60_000)), "n_modern": F.count_if(x.between(1800, 2100))}
    return out


def _needs_exact(estimate: int, n: int, rows: int) -> bool:
    """Is an approximate distinct count too close to a threshold of the typing rules?"""
    if estimate <= 64:
        return True
    return any(abs(estimate - t) <= 0.08 * max(t, 1) for t in (0.75 * n, 0.98 * rows, 200))


def evidence(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """Counts behind the typing rules, over all rows: one aggregate, plus exact distinct
    counts only for columns whose estimate lies near a threshold."""
    per = {c: _evidence_aggs(df, c) for c in cols}
    row = df.agg(*[e.alias(f"{i}|{k}") for i, c in enumerate(cols) for k, e in per[c].items()]).first()
    out = {c: {k: row[f"{i}|{k}"] for k in per[c]} for i, c in enumerate(cols)}
    close = [c for c in cols if _needs_exact(out[c]["d_approx"], out[c]["n"], out[c]["rows"])]
    exact = {}
    if close:
        counts = melt(df, close, cast="string").where("value IS NOT NULL").distinct().groupBy("column").count()
        exact = {r["column"]: r["count"] for r in counts.collect()}
    for c in cols:
        out[c]["d"] = exact.get(c, 0) if c in close else out[c]["d_approx"]
    return out


def is_compact(e: dict) -> str | None:
    if e["d"] < 3 or not e["n"]:
        return None
    for kind in ("month", "day"):
        inside, ok = e[f"n_{kind}"], e[f"n_{kind}_ok"]
        if inside >= 0.95 * e["n"] and ok >= 0.95 * inside:
            return kind
    return None


def temporal_evidence(kind: T.DataType, name: str, e: dict) -> str | None:
    """How a column carries time (native, text, year, month, day, serial), or None."""
    if isinstance(kind, TEMPORAL):
        return "native"
    n = e["n"]
    if not n:
        return None
    named = dates.has_temporal_name(name)
    if isinstance(kind, NUMERIC):
        if e["n_whole"] < n:
            return None
        if named and (e["n_year"] > 0.8 * n or (e["n_modern"] == n and 2 <= e["d"] <= 200)):
            return "year"
        return is_compact(e) or ("serial" if named and e["d"] >= 3 and e["n_serial"] >= 0.95 * n else None)
    if isinstance(kind, T.StringType):
        return "text" if e["n_date"] >= 0.8 * n or (named and e["n_date"] > 0.7 * n) else None
    return None


def decide_type(kind: T.DataType, name: str, e: dict) -> str:
    n, d = e["n"], e["d"]
    if not n:
        return "unknown"
    if temporal_evidence(kind, name, e):
        return "temporal"
    lowered = name.lower()
    if any(h in lowered for h in ID_HINTS) and d >= 0.75 * n:
        return "identifier"
    if d >= 0.98 * e["rows"] and e["rows"] >= 50 and isinstance(kind, (T.StringType, *INTEGRAL)):
        return "identifier"
    if d == 2 or isinstance(kind, T.BooleanType):
        return "binary"
    text = isinstance(kind, T.StringType)
    if text and e["n_truth"] == n:
        return "binary"
    if isinstance(kind, NUMERIC):
        if isinstance(kind, INTEGRAL) and d <= 20:
            return "discrete"
        return "discrete" if d / n < 0.05 and d <= 30 else "continuous"
    if text:
        rate = e["n_number"] / n
        if rate >= 0.95:
            return "discrete" if e["n_integer"] == e["n_number"] and d <= 20 else "continuous"
        if rate >= 0.15:
            return "ambiguous"
    return "nominal"


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def column_types(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    cols = list(cols or scalar_columns(df))
    e = evidence(df, cols)
    return {c: decide_type(df.schema[c].dataType, c, e[c]) for c in cols}


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: statistical type, how it carries time, counts used."""
    cols = list(cols or scalar_columns(df))
    e = evidence(df, cols)
    rows = [(c, decide_type(df.schema[c].dataType, c, e[c]), temporal_evidence(df.schema[c].dataType, c, e[c]),
             int(e[c]["n"]), int(e[c]["rows"] - e[c]["n"])) for c in cols]
    return local_rows(df.sparkSession, rows, "column string, statistical_type string, time_form string, count long, null_count long")


def semantic_types(df: DataFrame, cols: Sequence[str] | None = None, floor: float = 0.8) -> DataFrame:
    """Share of values matching each pattern, over all rows; the first pattern at `floor` names the type."""
    cols = list(cols or string_columns(df))
    names = list(SEMANTIC_PATTERNS)
    aggs = [e.alias(f"{c}|{k}") for c in cols for k, e in (
        [(p, ratio(F.count_if(as_col(c).cast("string").rlike(SEMANTIC_PATTERNS[p])), F.count(as_col(c)))) for p in names])]
    t = rows_from_wide(df.agg(*aggs), cols, names)
    pick = F.coalesce(*[F.when(F.col(p) >= floor, F.lit(p)) for p in names])
    return t.select("column", pick.alias("semantic_type"), F.greatest(*[F.col(p) for p in names]).alias("best_rate"))


# ---------------------------------------------------------------- dates

def compact_kind(df: DataFrame, col: str) -> str | None:
    """Which compact layout a numeric column uses, or None when over a tenth of it is not numeric."""
    x = as_col(col).cast("string").try_cast("double")
    work = df.select(x.alias("x"), as_col(col).alias("raw"))
    e = {**evidence(work.select("x"), ["x"])["x"]}
    rows = work.agg(F.count("raw"), F.count("x")).first()
    if not rows[1] or rows[1] < 0.9 * rows[0] or e["n_whole"] < e["n"]:
        return None
    if e["n_year"] > 0.9 * e["n"]:
        return "year"
    return is_compact(e) or ("serial" if e["n_serial"] >= 0.95 * e["n"] else None)


def parse_compact(df: DataFrame, col: str, name: str, kind: str | None = None, max_loss: float = 0.2) -> DataFrame:
    """Add the compact date as a timestamp; all null when the layout is unknown or too many values fail."""
    kind = kind or compact_kind(df, col)
    if kind is None:
        return df.withColumn(name, F.lit(None).cast("timestamp"))
    value = dates.compact_date(as_col(col).cast("string").try_cast("double"), kind)
    total, good = df.agg(F.count(as_col(col)), F.count(value)).first()
    return df.withColumn(name, value if good >= (1 - max_loss) * total else F.lit(None).cast("timestamp"))


def day_first_vote(df: DataFrame, col: str) -> bool:
    """Do more values show a day above 12 in first place than in second?"""
    shape = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
    text = F.trim(as_col(col).cast("string"))
    first = F.regexp_extract(text, shape, 1).try_cast("int")
    second = F.regexp_extract(text, shape, 2).try_cast("int")
    a, b = df.agg(F.count_if(first > 12), F.count_if(second > 12)).first()
    return a >= b


def parse_dates(df: DataFrame, col: str, name: str) -> DataFrame:
    """Robust date reading: compact numbers, then a vote on day order, then layouts in order."""
    kind = compact_kind(df, col)
    if kind is not None:
        return parse_compact(df, col, name, kind)
    return df.withColumn(name, dates.parse_date(as_col(col), day_first_vote(df, col)))


# ---------------------------------------------------------------- casts with a report

@dataclass
class Cast:
    column: str
    target: str
    value: Column


def cast_column(df: DataFrame, col: str, target: str) -> Column:
    kind = canonical_type(target)
    v, stored = as_col(col), df.schema[col].dataType
    if kind == "binary":
        return v if isinstance(stored, T.BooleanType) else casts.to_boolean(v)
    if kind in ("continuous", "discrete"):
        if isinstance(stored, NUMERIC):
            return v.cast("double") if kind == "continuous" else F.rint(v.cast("double")).cast("bigint")
        return casts.to_number(v, whole=kind == "discrete")
    if kind == "temporal":
        if isinstance(stored, TEMPORAL):
            return v
        compact = compact_kind(df, col) if isinstance(stored, NUMERIC) else None
        return dates.compact_date(v, compact) if compact else dates.parse_date(v, day_first_vote(df, col))
    return v.cast("string")


def conversion_report(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Per column: valid, lost and null counts, loss rate, and up to five lost values (smallest first)."""
    plan = [Cast(c, canonical_type(t), cast_column(df, c, t)) for c, t in targets.items()]
    aggs = [e.alias(f"{p.column}|{k}") for p in plan for k, e in (
        ("total", F.count(F.lit(1))), ("valid", F.count(p.value)),
        ("lost", F.count_if(as_col(p.column).isNotNull() & p.value.isNull())),
        ("original_null", F.count_if(as_col(p.column).isNull())))]
    t = rows_from_wide(df.agg(*aggs), [p.column for p in plan], ["total", "valid", "lost", "original_null"])
    lost = df.select(F.explode(F.array(*[
        F.when(as_col(p.column).isNotNull() & p.value.isNull(),
               F.struct(F.lit(p.column).alias("column"), as_col(p.column).cast("string").alias("v"))) for p in plan])).alias("e"))
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy("v")
    five = lost.where("e IS NOT NULL").select("e.*").distinct().withColumn("k", F.row_number().over(w)).where("k <= 5")
    shown = five.groupBy("column").agg(F.sort_array(F.collect_list("v")).alias("samples"))
    kinds = F.create_map(*[x for p in plan for x in (F.lit(p.column), F.lit(p.target))])
    return t.join(F.broadcast(shown), "column", "left").select(  # one row per column
        "column", kinds[F.col("column")].alias("target"), "total", "valid", "lost", "original_null",
        F.coalesce(ratio(F.col("lost"), F.greatest(F.lit(1), F.col("total") - F.col("original_null"))), F.lit(0.0)).alias("loss_rate"),
        (F.col("lost") == 0).alias("lossless"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def apply_overrides(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Cast declared columns; a column that would lose everything keeps its stored form."""
    targets = {c: t for c, t in overrides.items() if c in df.columns and t and t != "auto"}
    if not targets:
        return df
    plan = {c: cast_column(df, c, t) for c, t in targets.items()}
    counts = df.agg(*[e for i, c in enumerate(plan) for e in (
        F.count(as_col(c)).alias(f"a{i}"), F.count(plan[c]).alias(f"b{i}"))]).first()
    keep = {c for i, c in enumerate(plan) if counts[f"a{i}"] > 0 and counts[f"b{i}"] == 0}
    return df.select(*[plan[c].alias(c) if c in plan and c not in keep else as_col(c) for c in df.columns])


@dataclass
class Applied:
    frame: DataFrame
    kinds: dict[str, str]
    coerced: list[str]
    failures: list[str]

    @property
    def analysable(self) -> list[str]:
        return [c for c in self.frame.columns if self.kinds.get(c) != "identifier"]


def apply_schema(df: DataFrame, declared: dict[str, str]) -> Applied:
    """Coerce columns to their declared family where enough values survive (70 % dates, 50 % numbers)."""
    wanted = {c: family(t) for c, t in declared.items() if c in df.columns and t and t != "auto"}
    plan: dict[str, Column] = {}
    for c, f in wanted.items():
        if f == "temporal" and not isinstance(df.schema[c].dataType, TEMPORAL):
            plan[c] = cast_column(df, c, "temporal")
        elif f == "numeric" and not isinstance(df.schema[c].dataType, NUMERIC):
            plan[c] = casts.to_number(as_col(c))
        elif f == "categorical" and isinstance(df.schema[c].dataType, NUMERIC):
            plan[c] = as_col(c).cast("string")
    free = [c for c in df.columns if c not in wanted and isinstance(df.schema[c].dataType, NUMERIC)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [e for i, c in enumerate(plan) for e in (F.count(as_col(c)).alias(f"a{i}"), F.count(plan[c]).alias(f"b{i}"))]
    aggs += [F.approx_count_distinct(as_col(c)).alias(f"d{i}") for i, c in enumerate(free)]
    row = df.agg(*aggs).first()
    kinds, coerced, failures = {}, [], []
    for i, c in enumerate(plan):
        base = row["rows"] if wanted[c] == "numeric" else row[f"a{i}"]
        floor = {"temporal": 0.7, "numeric": 0.5}.get(wanted[c], 0.0)
        if base and row[f"b{i}"] >= floor * base:
            coerced.append(c)
            kinds[c] = wanted[c]
        else:
            failures.append(c)
            kinds[c] = "categorical"
    for c in df.columns:
        if c in kinds:
            continue
        if c in wanted:
            kinds[c] = wanted[c]
        elif isinstance(df.schema[c].dataType, TEMPORAL):
            kinds[c] = "temporal"
        elif c in free:
            kinds[c] = "numeric" if row[f"d{free.index(c)}"] > 2 else "categorical"
        else:
            kinds[c] = "categorical"
    frame = df.select(*[plan[c].alias(c) if c in coerced else as_col(c) for c in df.columns])
    return Applied(frame, kinds, coerced, failures)


# ---------------------------------------------------------------- profile

_PROFILE = ["count", "null_count", "min", "max", "mean", "std", "median", "p5", "p25", "p75", "p95", "skewness", "kurtosis"]


def column_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Profile statistics per column; numeric fields are null for other columns."""
    cols = list(cols or scalar_columns(df))
    nums = [c for c in cols if c in numeric_columns(df)]
    q = exact_quantiles(df, nums, [.5, .05, .25, .75, .95])
    none = F.lit(None).cast("double")
    aggs = []
    for c in cols:
        v = as_col(c)
        x = v.cast("double") if c in nums else none
        a, b, d, e, f = q.get(c, [None] * 5)
        n = F.count(v)
        parts = [F.count(F.lit(1)), F.count_if(v.isNull()), F.min(x), F.max(x), F.avg(x), F.stddev_samp(x),
                 *[F.lit(k).cast("double") for k in (a, b, d, e, f)],
                 describe.adjusted_skew(F.skewness(x), n), describe.adjusted_kurtosis(F.kurtosis(x), n)]
        aggs += [p.alias(f"{c}|{s}") for p, s in zip(parts, _PROFILE)]
    wide = rows_from_wide(df.agg(*aggs), cols, _PROFILE)
    card = melt(df, cols, cast="string").where("value IS NOT NULL").distinct().groupBy("column").agg(
        F.count(F.lit(1)).alias("cardinality"))
    return wide.join(F.broadcast(card), "column", "left").withColumn(  # one row per column
        "cardinality", F.coalesce("cardinality", F.lit(0))).withColumn(
        "null_rate", F.coalesce(ratio(F.col("null_count"), F.col("count")), F.lit(0.0)))


def data_dictionary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: names, types, unit, null rate, cardinality and profile."""
    cols = list(cols or scalar_columns(df))
    spark = df.sparkSession
    names = local_rows(spark, [(c, humanise(c), *(unit_of_name(c) or (None, None))) for c in cols],
                                  "column string, title string, unit string, unit_domain string")
    kinds = infer_types(df, cols).select("column", "statistical_type", "time_form")
    text = [c for c in cols if c in string_columns(df)]
    out = names.join(F.broadcast(kinds), "column").join(F.broadcast(column_profile(df, cols)), "column")
    if text:
        return out.join(F.broadcast(semantic_types(df, text).select("column", "semantic_type")), "column", "left")
    return out.withColumn("semantic_type", F.lit(None).cast("string"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """The dictionary with the table's size and stored types attached to each row."""
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    return data_dictionary(df).select(F.col("count").alias("rows"), F.lit(len(df.columns)).alias("columns"),
                                      types[F.col("column")].alias("stored_type"), "*")


def analysable_columns(df: DataFrame, minimum: int = 2) -> list[str]:
    """Numeric columns that are neither identifiers nor time markers; all of them if too few remain."""
    nums = numeric_columns(df)
    kinds = column_types(df, nums)
    kept = [c for c in nums if kinds[c] not in ("identifier", "temporal")]
    return kept if len(kept) >= minimum else nums


# ---------------------------------------------------------------- panels and targets

def panel_shape(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Is (entity, time) a key with at least two periods per entity? One row with the panel's shape."""
    e, t = as_col(entity), as_col(time)
    both = df.where(e.isNotNull() & t.isNotNull())
    pairs = both.groupBy(e.alias("e"), t.alias("t")).count()
    per = pairs.groupBy("e").agg(F.count(F.lit(1)).alias("periods"), F.sum("count").alias("rows"), F.max("count").alias("most"))
    shape = per.agg(F.count(F.lit(1)).alias("n_entities"), F.min("periods").alias("min_periods"),
                    F.max("periods").alias("max_periods"), F.sum("rows").alias("complete_rows"), F.max("most").alias("most"))
    total = df.count()
    return shape.select(
        F.lit(entity).alias("entity_column"), F.lit(time).alias("time_column"), "n_entities",
        F.lit(pairs.select("t").distinct().count()).alias("n_periods"), "min_periods",
        (F.col("min_periods") == F.col("max_periods")).alias("balanced"),
        ((F.col("n_entities") >= 2) & (F.col("n_entities") <= 0.5 * total) & (F.col("complete_rows") >= 0.9 * total)
         & (F.col("most") == 1) & (F.col("min_periods") >= 2)).alias("is_panel"))


def detect_panel(df: DataFrame, times: Sequence[str], entities: Sequence[str]) -> tuple[str, str] | None:
    for t in times:
        for e in entities:
            if e != t and panel_shape(df, e, t).first()["is_panel"]:
                return e, t
    return None


def target_score(kind: str, name: str, null_rate: float, levels: int) -> float:
    score = 30.0 + (25 if any(w in name.lower() for w in TARGET_WORDS) else 0)
    score -= 50 if kind in ("identifier", "temporal") else 0
    score += 10 if null_rate < 0.05 else -20 if null_rate > 0.3 else 0
    if kind in ("continuous", "binary", "discrete"):
        score += 15
    elif kind in ("nominal", "ordinal", "ambiguous"):
        score += 10 if 2 <= levels <= 10 else -10
    return max(0.0, min(100.0, score))


def suggest_targets(df: DataFrame) -> DataFrame:
    """Columns scored 0-100 as modelling targets."""
    e = evidence(df, scalar_columns(df))
    rows = []
    for c, v in e.items():
        kind = decide_type(df.schema[c].dataType, c, v)
        nulls = 1 - v["n"] / v["rows"] if v["rows"] else 0.0
        rows.append((c, kind, target_score(kind, c, nulls, v["d"])))
    return local_rows(df.sparkSession, rows, "column string, statistical_type string, score double")


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """exploration, binary_classification, multiclass_classification or regression for a target."""
    v, kind = as_col(target), df.schema[target].dataType
    counts = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.lit(1).alias("one"))
    number = isinstance(kind, NUMERIC)
    whole = F.min((F.col("v").cast("double") == F.rint(F.col("v").cast("double"))).cast("int")) if number else F.lit(1)
    levels = F.count(F.lit(1))
    few = (whole == 1) & (levels <= 10)
    verdict = (F.when(levels < 2, "exploration").when(levels == 2, "binary_classification")
               .when(F.lit(not number) | few, "multiclass_classification").otherwise("regression"))
    return counts.agg(F.lit(target).alias("target"), levels.alias("levels"), verdict.alias("problem_type"))


def profile_flags(df: DataFrame) -> DataFrame:
    """Table-level facts and flags."""
    dup = describe.duplicate_summary(df).first()
    miss = describe.missing_summary(df).collect()  # one row per column
    rows, cols = dup["rows"], len(df.columns)
    out = [("rows", float(rows)), ("columns", float(cols)), ("duplicate_rows", float(dup["duplicates"])),
           ("duplicate_ratio", dup["duplicate_ratio"]),
           ("overall_null_rate", sum(m["null_rate"] or 0.0 for m in miss) / max(cols, 1)),
           ("high_missing_columns", float(sum((m["null_rate"] or 0) > 0.5 for m in miss))),
           ("near_constant_columns", float(sum(bool(m["near_constant"]) for m in miss))),
           ("small_sample", float(rows < 100)), ("large_sample", float(rows > 100_000)), ("wide", float(cols > 50)),
           ("high_dimensional", float(cols > rows))]
    return local_rows(df.sparkSession, out, "fact string, value double")


_RULES = [
    # analysis, minimum counts (numeric, categorical, grouping, binary, temporal)
    ("descriptive_numeric", (1, 0, 0, 0, 0)), ("descriptive_categorical", (0, 1, 0, 0, 0)),
    ("correlation_pearson", (2, 0, 0, 0, 0)), ("correlation_spearman", (2, 0, 0, 0, 0)), ("vif", (2, 0, 0, 0, 0)),
    ("compare_means", (1, 0, 1, 0, 0)), ("correlation_test", (2, 0, 0, 0, 0)), ("independence", (0, 0, 2, 0, 0)),
    ("stationarity", (1, 0, 0, 0, 0)), ("regression", (2, 0, 0, 0, 0)), ("classification", (1, 0, 1, 0, 0)),
    ("principal_components", (2, 0, 0, 0, 0)), ("correspondence", (0, 0, 2, 0, 0)),
    ("multiple_correspondence", (0, 2, 0, 0, 0)), ("clustering", (2, 0, 0, 0, 0)),
    ("univariate_forecast", (1, 0, 0, 0, 1)), ("multivariate_forecast", (2, 0, 0, 0, 1)),
    ("panel_models", (2, 0, 1, 0, 1)), ("survival", (1, 0, 0, 1, 0)), ("difference_in_differences", (1, 0, 0, 2, 0)),
    ("matching", (2, 0, 0, 1, 0)), ("instrumental_variables", (3, 0, 0, 0, 0)), ("count_model", (2, 0, 0, 0, 0)),
    ("quantile_regression", (2, 0, 0, 0, 0)),
]


def capabilities(df: DataFrame) -> DataFrame:
    """Which analyses the table's columns allow, and what is missing for the others."""
    kinds = column_types(df)
    groups = {
        "numeric": [c for c, k in kinds.items() if k in ("continuous", "discrete")],
        "categorical": [c for c, k in kinds.items() if k in ("nominal", "ordinal", "binary")],
        "grouping": [c for c, k in kinds.items() if k in ("nominal", "ordinal", "binary", "discrete")],
        "binary": [c for c, k in kinds.items() if k == "binary"],
        "temporal": [c for c, k in kinds.items() if k == "temporal"],
    }
    rows = []
    for name, need in _RULES:
        lacking = [f"needs {m} {g} column(s), found {len(groups[g])}" for m, g in zip(need, groups) if len(groups[g]) < m]
        usable = sorted({c for m, g in zip(need, groups) if m for c in groups[g]})
        rows.append((name, not lacking, "; ".join(lacking) or None, usable))
    return local_rows(df.sparkSession, rows, "analysis string, available boolean, reason string, columns array<string>")
