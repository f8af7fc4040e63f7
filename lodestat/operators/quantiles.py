"""Exact quantiles (linear interpolation) of whole columns and of groups."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import as_col, join_null_safe
from lodestat.operators.ordering import ROWS_PER_SLICE, value_ranks

SINGLE_PASS_ROWS = 5_000_000
SKETCH_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    single_pass_rows: int = SINGLE_PASS_ROWS,
                    rows_per_slice: int = ROWS_PER_SLICE) -> dict[str, list[float | None]]:
    """Quantiles of whole columns as plain numbers.

    Up to `single_pass_rows` rows the exact aggregate is used (its value map is then
    bounded). Above, a mergeable sketch brackets every quantile, one scan counts rows
    below each bracket, and only the rows inside brackets (about 4 in 10 000) are
    grouped and ranked. The count checks the bracket; a miss widens it to the full range.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}
    if df.count() <= single_pass_rows:
        row = df.agg(*[F.percentile(as_col(c).cast("double"), F.array(*[F.lit(p) for p in probs])) for c in cols]).first()
        return {c: (list(row[i]) if row[i] is not None else [None] * len(probs)) for i, c in enumerate(cols)}

    eps = 2.0 / SKETCH_ACCURACY
    nodes = sorted({max(0.0, p - eps) for p in probs} | {min(1.0, p + eps) for p in probs})
    aggs = []
    for i, c in enumerate(cols):
        v = as_col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.percentile_approx(v, nodes, SKETCH_ACCURACY).alias(f"q{i}")]
    sketch = df.agg(*aggs).first()
    slots = []
    for i, c in enumerate(cols):
        n = sketch[f"n{i}"]
        if not n:
            continue
        at = dict(zip(nodes, sketch[f"q{i}"]))
        for j, p in enumerate(probs):
            lo = sketch[f"lo{i}"] if p - eps <= 0 else at[max(0.0, p - eps)]
            hi = sketch[f"hi{i}"] if p + eps >= 1 else at[min(1.0, p + eps)]
            h = p * (n - 1)
            slots.append({"col": c, "i": i, "j": j, "lo": float(lo), "hi": float(hi),
                          "k": (math.floor(h), math.ceil(h)), "f": h - math.floor(h)})
    checks = df.agg(*[e for s, slot in enumerate(slots) for e in (
        F.count_if(as_col(slot["col"]).cast("double") < slot["lo"]).alias(f"b{s}"),
        F.count_if(as_col(slot["col"]).cast("double").between(slot["lo"], slot["hi"])).alias(f"m{s}"))]).first()
    for s, slot in enumerate(slots):
        slot["below"] = checks[f"b{s}"]
        if not (slot["below"] <= slot["k"][0] and slot["k"][1] < slot["below"] + checks[f"m{s}"]):
            slot["lo"], slot["hi"], slot["below"] = sketch[f"lo{slot['i']}"], sketch[f"hi{slot['i']}"], 0
    # a bracket of one value is already the answer
    open_slots = [(s, slot) for s, slot in enumerate(slots) if slot["lo"] < slot["hi"]]
    hits = {s: as_col(slot["col"]).cast("double").between(slot["lo"], slot["hi"]) for s, slot in open_slots}
    found = {s: (slot["lo"], slot["lo"]) for s, slot in enumerate(slots) if slot["lo"] >= slot["hi"]}
    if open_slots:
        some = reduce(lambda x, y: x | y, hits.values())
        inside = F.array(*[F.when(hits[s], F.struct(F.lit(s).alias("slot"), as_col(slot["col"]).cast("double").alias("v"))) for s, slot in open_slots])
        picked = df.where(some).select(F.explode(F.array_compact(inside)).alias("e")).select("e.slot", "e.v")
        ranked = value_ranks(picked, "v", ["slot"], rows_per_slice=rows_per_slice)
        found |= _pick(ranked, slots)
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for s, slot in enumerate(slots):
        a, b = found[s]
        out[slot["col"]][slot["j"]] = a + (b - a) * slot["f"]
    return out


def _pick(ranked: DataFrame, slots: Sequence[dict]) -> dict[int, tuple[float, float]]:
    """The two order statistics each slot asks for, from its ranked values."""
    where = F.array(*[F.array(F.lit(float(slot["k"][0] - slot["below"])), F.lit(float(slot["k"][1] - slot["below"])))
                      for slot in slots])
    ks = F.element_at(where, F.col("slot") + 1)

    def holds(k):
        return (F.col("below") <= k) & (k < F.col("below") + F.col("n"))

    return {r["slot"]: (r["a"], r["b"]) for r in ranked.groupBy("slot").agg(
        F.max(F.when(holds(F.element_at(ks, 1)), F.col("v"))).alias("a"),
        F.max(F.when(holds(F.element_at(ks, 2)), F.col("v"))).alias("b")).collect()}  # one row per slot


def quantiles_by(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                 names: Sequence[str] | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Exact quantiles per group.

    While the largest group is bounded the built-in aggregate does it in one shuffle;
    a larger group is pre-counted by value and ranked in slices.
    """
    names = list(names or [f"q{p}" for p in probs])
    keys = [as_col(b) for b in by]
    present = df.where(as_col(value).isNotNull())
    biggest = present.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if biggest <= rows_per_slice:
        out = present.groupBy(*keys).agg(
            F.percentile(as_col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias("__q"))
        return out.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    ranked = value_ranks(present, value, by, rows_per_slice=rows_per_slice)
    sizes = ranked.groupBy(*keys).agg(F.sum("n").alias("__N"))
    joined = join_null_safe(ranked, sizes, list(by))
    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("__N") - 1)
        for tag, k in (("a", F.floor(h)), ("b", F.ceil(h))):
            hit = (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(hit, as_col(value).cast("double"))).alias(f"__{tag}{i}"))
    out = joined.groupBy(*keys, "__N").agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}"))
         * (F.lit(float(p)) * (F.col("__N") - 1) - F.floor(F.lit(float(p)) * (F.col("__N") - 1)))).alias(n)
        for i, (p, n) in enumerate(zip(probs, names))])
